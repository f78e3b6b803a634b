"""Fingerprints, alignment and hard negatives against brute force, with nulls, empties, ties, repeats and odd columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from strideframe.llm import alignment, fingerprints, negatives, queries

SCHEMA = "doc_id long, text string, lang string, _row string, range int, kind string, packed string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    passage = " ".join(f"word{i}" for i in range(60))
    random = np.random.default_rng(3)
    letters = list("ab .,\n\t é漢🤔▁　'<|>1\r") + ["<|endoftext|>", "</s>", "  ", " the", "<0x41>"]
    noise = ["".join(random.choice(letters, random.integers(1, 60))) for _ in range(60)]
    return [
        None, "", " ", " \n\t ", "one two", "one two three four five", passage, passage, passage + " end more words here",
        "x " + passage, passage.upper(), " ".join(f"t{i * 7919 % 5003}" for i in range(20_000)), "z" * 5000, " " * 3000,
        "\n\n\na\n b \n", "日本語のテキスト 🤔🤔 é", "end.\nStart of line", "a  b", " a", "a ", *noise,
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(3 * i, t, "en", "r", i, "k", "p") for i, t in enumerate(odd_texts())]
    rows += [rows[6], rows[1], (None, "no id here", "de", None, None, None, None), (None, None, "de", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints(odd, nothing):
    got = fingerprints.edited_likeness(odd).collect()
    assert len(got) == odd.count()
    texts = {}
    for r in odd.collect():
        texts.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r.text or "")
    ids = sorted(texts)
    following = {i: texts[j] for i, j in zip(ids, [*ids[1:], ids[0]])}
    prints, errors = {}, []
    for r in got:
        own = texts[-1 if r.doc_id is None else r.doc_id]
        i = -1 if r.doc_id is None else r.doc_id
        fits = []
        for text in own:
            for after in following[i] + (own if len(own) > 1 else []):
                half = len(text) // 2
                edited = text[: len(text) - half] + after[:half]
                if hashlib.sha256(edited.encode()).hexdigest() == r.edited_sha256 and r.n_chars == len(text):
                    fits.append((text, edited, after))
        assert fits, r
        text, edited, after = fits[0]
        prints.setdefault(text, set()).add(r.fingerprint)
        prints.setdefault(edited, set()).add(r.edited_fingerprint)
        errors.append(r.near_edited - similarity(text, edited))
        if len(own) == 1:
            errors.append(r.near_next - min((similarity(text, a) for a in following[i]), key=lambda s: abs(s - r.near_next)))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values()), "equal texts have equal fingerprints"
    assert all(("" in p) == (not shingles(t)) for t, p in prints.items())
    assert np.abs(errors).max() < 0.16 and np.sqrt(np.mean(np.square(errors))) < 0.04
    assert fingerprints.edited_likeness(nothing).count() == 0
    out = fingerprints.with_fingerprints(odd)
    assert out.columns == [*odd.columns, "fingerprint"] and out.count() == odd.count()


def test_fingerprints_estimate(spark):
    """Without bias over the whole range, for short texts (mostly empty bins) and long ones."""
    random = np.random.default_rng(1)
    rows, true = [], []
    for n in (8, 30, 120, 1000):
        for share in (0.1, 0.5, 0.9):
            for _ in range(12):
                words = [f"w{x}" for x in random.integers(0, 10**9, n)]
                other = words[: int(n * share)] + [f"v{x}" for x in random.integers(0, 10**9, n - int(n * share))]
                rows.append((len(rows), " ".join(words), " ".join(other)))
                true.append((n, share, similarity(*rows[-1][1:])))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    df = fingerprints.with_packed(fingerprints.with_packed(df, "a", "x"), "b", "y")
    got = [r[0] for r in df.orderBy("i").select(fingerprints.likeness(F.col("x"), F.col("y"))).collect()]
    for n in (30, 120, 1000):
        for share in (0.1, 0.5, 0.9):
            off = [g - t for g, (m, s, t) in zip(got, true) if (m, s) == (n, share)]
            assert abs(np.mean(off)) < 0.05, (n, share, np.mean(off))


def test_fingerprints_use_no_python(spark, sf_dir):
    plan = queries.op11_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert plan.count("CartesianProduct") == 0


def aligned_by_hand(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    rows, count = [], Counter()
    for text in texts:
        text = text or ""
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xb = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        yb = []
        for i in y:
            p = b.id_to_piece(i)
            yb.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode())
        if not text or b"".join(xb) != (" " + text).encode() or b"".join(yb) != (" " + text).encode():
            rows.append(([], [], [], Counter()))
            continue
        xe, ye = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
        groups, links, i, j = [], Counter(), 0, 0
        for end in sorted(set(xe) & set(ye)):
            k, m = xe.index(end, i) + 1, ye.index(end, j) + 1
            groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            links.update((p, q) for p in x[i:k] for q in y[j:m])
            i, j = k, m
        count.update(links.keys())
        rows.append((x, y, groups, links))
    most = {}
    for (p, _), n in count.items():
        most[p] = max(most.get(p, 0), n)
    out = []
    for x, y, groups, links in rows:
        best = sum(n for (p, q), n in links.items() if count[p, q] == most[p])
        total = sum(n * count[k] for k, n in links.items())
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((len(x), len(y), len(groups), sum(links.values()), best, total, sha))
    return out


@pytest.mark.parametrize("max_bytes", [1 << 26, 3200])
def test_alignment(odd, nothing, max_bytes):
    given = odd.collect()
    want = Counter(zip([r.doc_id for r in given], aligned_by_hand([r.text for r in given])))
    rows = alignment.aligned(odd, A, B)
    out = alignment.with_counts(rows, alignment.pair_counts(rows), max_bytes)
    assert out.select("_row.*").columns == [c for c in odd.columns if c != "text"]
    got = out.select("_row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert Counter((r[0], tuple(r[1:])) for r in got) == want
    assert alignment.alignments(nothing, A, B).count() == 0


def test_alignment_keeps_little():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        model = alignment.Aligner(f.read(), g.read())
    assert model.splits
    texts = ["a" * 300_000, " " * 300_000, "word " * 50_000, "🤔" * 20_000]
    out = alignment.align_texts(model, texts)
    assert (np.asarray(out["n_a"]) > 0).all()
    assert all(len(p) <= alignment.LONG for p in model.slots)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row string, score int, key int")


def mined(rows, anchor):
    rows = [(i, tuple(int(np.floor(256 * x)) if abs(256 * x) < 2**53 else int(256 * x) for x in v), str(c)) for i, v, c, *_ in rows
            if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows, out = set(rows), set()
    clamp = lambda x: max(negatives.LEAST, min(negatives.MOST, x))
    for a in rows:
        if not anchor(a[0]):
            continue
        scored = [(clamp(sum(x * y for x, y in zip(a[1], r[1]))), r) for r in rows if len(r[1]) == len(a[1]) and r[0] != a[0]]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for p, pr in [s for s in scored if s[1][2] == a[2]][:5]:
            band = [(s, r) for s, r in scored if r[2] != a[2] and 50 * p <= 100 * s <= 95 * p]
            out |= {(a[0], pr[0], k + 1, r[0], p, s) for k, (s, r) in enumerate(band[:3])}
    return out


def test_negatives(spark, monkeypatch):
    random = np.random.default_rng(5)
    rows = [(i, (random.standard_normal(6) / 3 + 0.2).tolist(), int(random.integers(0, 3)) if i % 4 else 0, "r", 1, 1) for i in range(300)]
    rows += [rows[5], (None, [0.1] * 6, 1, "r", 1, 1), (301, None, 1, None, 1, 1), (302, [0.1] * 5 + [None], 1, None, 1, 1)]
    rows += [(303, [float("nan")] + [0.1] * 5, 1, None, 1, 1), (304, [float("inf")] * 6, 0, None, 1, 1), (305, [0.5] * 6, None, None, 1, 1)]
    rows += [(400 + i, [0.3, 0.4, 0.5], i % 2, None, 1, 1) for i in range(30)] + [(500, [], 1, None, 1, 1), (501, [], 0, None, 1, 1)]
    rows += [(600 + i, [(1e9 + i) * (-1) ** (i % 3 == 0), 3e14 * i, 7.0], i % 2, None, 1, 1) for i in range(20)]
    monkeypatch.setattr(negatives, "PART_ROWS", 40)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 9)
    monkeypatch.setattr(negatives, "TILE_SCORES", 500)
    out = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows, lambda i: i % 10 == 0)
    assert negatives.hard_negatives(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_packed_products():
    random = np.random.default_rng(2)
    for top in (1, 300, 10**6, 10**12):
        a, c = random.integers(-top, top, (7, 12)).astype(float), random.integers(-top, top, (11, 12)).astype(float)
        want = [[max(negatives.LEAST, min(negatives.MOST, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in c] for p in a]
        assert negatives.packed_scores(a, c).tolist() == want
