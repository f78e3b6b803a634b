"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from strideframe.llm import bpe, jaccard, licenses, mixing, quality, queries, repeats, sharding, suffixes, token_counts, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, words int"


@pytest.fixture(scope="module")
def odd(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    long = " ".join(f"t{i * 7919 % 5003}" for i in range(30_000))
    texts = [
        None, "", " \n\t ", "one two", "a a a a a", passage, passage, passage + " end", "x " + passage + " y\n" + passage,
        long, "Licensed under CC BY-NC 4.0. All rights reserved.", "GNU General Public License cc by cc by",
        "é" * 150 + "<|endoftext|> ▁▁ \n\n x", "z" * 5000,
    ]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 1, "r", 1) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id " + passage, "de", None, 2, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_suffix_arrays():
    random = np.random.default_rng(0)
    for _ in range(300):
        s = random.integers(0, 3, random.integers(1, 50)).astype(np.int16)
        found = suffixes.suffix_array(s, len(s) + 1)
        assert found.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_repeats(odd, nothing):
    docs = {(-1 if r.doc_id is None else r.doc_id): (r.text or "").encode() for r in odd.collect()}
    seen, want = {}, {}
    for i in sorted(docs):
        b, gone = docs[i], np.zeros(len(docs[i]) + 1, int)
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    for r in repeats.with_kept_bytes(odd).collect():
        assert want[-1 if r._row.doc_id is None else r._row.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert repeats.with_kept_bytes(nothing).count() == 0


def test_jaccard(odd, nothing):
    sets = {}
    for r in odd.collect():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(r.text)]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = jaccard.jaccard_classes(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), label.get(r.doc_id))
    kept = jaccard.one_per_component(odd)
    assert kept.columns == odd.columns
    left = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in left if i is not None) == sorted(set(label.values()))
    assert jaccard.jaccard_classes(nothing).count() == 0


def test_jaccard_families(spark):
    """Near copies around the limit, edited at few and at many places, some at the same ones, beside texts that
    share a passage."""
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(90):
        copy = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            copy[at] = f"edit{i}x{at}"
        if i % 3 == 0:
            copy[30 : 30 + i % 4] = ["same"] * (i % 4)
        texts.append(copy[: 120 - i % 5])
    texts += [base[:40] + [f"own{i}w{k}" for k in range(5 + i)] for i in range(30)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    label = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(label)
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert 3 < len(set(label)) < len(sets)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs.repartition(4)).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_jaccard_families_meet_in_proportion(spark, monkeypatch):
    """Two families: copies that are linked beside copies edited at too many places to be linked with any, and copies
    linked with each other but not with their leader. Their rows of different components that meet stay few."""
    rng = np.random.default_rng(11)

    def edited(name, i, places):
        copy = [f"{name}{k}" for k in range(150)]
        for at in rng.choice(150, places, replace=False):
            copy[at] = f"edit{i}x{at}"
        return (i, " ".join(copy))

    rows = [edited("a", i, 2 if i < 40 else 7 + i % 3) for i in range(140)]
    rows += [edited("b", 1000 + i, 2 if i else 9) for i in range(60)]
    pairs = collections.Counter()
    met = jaccard._met

    def counted(lists, apart, *rest):
        if apart == ["component"]:
            k = lists.groupBy("shingle", "component").agg(F.count("*").alias("k"))
            k = k.groupBy("shingle").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("m"))
            pairs.update({r.a: int(r.m) for r in k.groupBy("shingle.a").agg(F.sum("m").alias("m")).collect()})
        return met(lists, apart, *rest)

    monkeypatch.setattr(jaccard, "_met", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == shingle_labels(rows)
    assert max(pairs[0], pairs[1000]) <= len(rows)


def test_quality(odd, nothing):
    for r in quality.with_measures(odd).collect():
        t, w = r.text or "", words(r.text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = collections.Counter(grams)
        covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality.passing(odd).columns == odd.columns
    assert quality.passing(nothing).count() == 0


def test_licenses(odd, nothing):
    for r in licenses.with_licenses(odd).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, x) for p, x in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
    assert licenses.with_licenses(nothing).count() == 0


def test_tokens(odd, nothing):
    import sentencepiece
    from tokenizers import Tokenizer

    path, model = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    library, pieces = Tokenizer.from_file(path), sentencepiece.SentencePieceProcessor(model_file=model)
    for r in bpe.with_round_trip(odd, path).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.decoded == (r.text or "")
    for r in token_counts.with_token_counts(odd, model).collect():
        assert r.n_tokens == len(pieces.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
    assert bpe.with_round_trip(nothing, path).count() == 0
    assert token_counts.with_token_counts(nothing, model).count() == 0


def test_sharding(odd, nothing):
    rows = sharding.balanced_shards(odd, 3).toPandas()
    assert len(rows) == odd.count()
    sums = rows.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * rows["size"].max()
    for _, shard in rows.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in odd.collect() if r.doc_id is not None}
    assert all(crc[i] == c for i, c in zip(rows.doc_id, rows.text_crc32, strict=True) if i == i)
    assert sharding.balanced_shards(nothing, 3).count() == 0


def test_mixing(spark, odd, nothing):
    rows = mixing.planned_draws(odd).collect()
    assert len(rows) == odd.count() and sorted(map(str, rows)) == sorted(map(str, mixing.planned_draws(odd).collect()))
    assert all(len(r.draws) <= 2 for r in rows)
    total = sum({r._source: r.source_size for r in rows}.values())
    assert abs(sum({r._source: r.target for r in rows}.values()) - 1.5 * total) < 1e-6 * total
    mix = mixing.mixed(odd)
    assert mix.columns == odd.columns and mix.count() == sum(len(r.draws) for r in rows)
    assert mixing.planned_draws(nothing).count() == 0
    tree = mixing.splitting_tree(np.array([10, 0, 33]), 5, 1)
    assert tree.sum(0).tolist() == [10, 0, 33] and np.ptp(tree.sum(1)) <= 1


def test_mixing_meets_targets_without_ids(spark):
    """Rows without an id, or with the same one, are taken one by one, so sources come within a document of their targets."""
    rows = [(None if i % 3 else 7, " ".join(["w"] * (1 + i * 37 % 60)) + f" {i}", "en", f"s{i % 2}", 1, "r", 1) for i in range(900)]
    taken, target, longest = collections.Counter(), {}, 0
    for r in mixing.planned_draws(spark.createDataFrame(rows, SCHEMA)).collect():
        taken[r._source] += r._size * len(r.draws)
        target[r._source] = r.target
        longest = max(longest, r._size)
    assert len(target) == 2 and all(abs(taken[s] - target[s]) <= longest for s in target), (taken, target)


def test_top_k(spark):
    random = np.random.default_rng(1)
    data = [[float(x) for x in random.normal(size=4)] for _ in range(300)]
    data[7], data[8], data[9] = None, [1.0, None, 0.0, 0.0], [float("nan")] * 4
    data[20:60] = [data[0]] * 40
    rows = [(i, v, "x") for i, v in enumerate(data)] + [(30, data[30], "x"), (None, data[1], "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect()
    whole = {r.vec_id: [int(np.floor(256 * np.float64(x))) for x in r.embedding] for r in vectors.collect() if r.vec_id not in (None, 7, 8, 9)}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in best]
    assert topk.top_k(vectors.where("false"), F.lit(True), 5).count() == 0


def test_top_k_many_leaves(spark, monkeypatch):
    """Small blocks and groups, a hot vector, vectors of three lengths (one outside the sample), huge components."""
    for name, value in (("BLOCK_ROWS", 40), ("GROUP_ROWS", 5), ("LEAF", 8), ("SAMPLE_ROWS", 120)):
        monkeypatch.setattr(topk, name, value)
    random = np.random.default_rng(2)
    data = {i: [float(x) for x in random.normal(i % 9, 0.2, size=5)] for i in range(600)}
    data |= {i: [1.0] * 5 for i in range(200, 400)} | {i: [float(i), 2.0] for i in range(600, 650)}
    data |= {i: [1e15 * (i - 650), -3.0, 1.0, float(i)] for i in range(650, 665)} | {i: [] for i in range(665, 668)}
    vectors = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 10 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [int(np.floor(256 * np.float64(x))) for x in v] for i, v in data.items()}
    limit = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in (i for i in whole if i % 10 == 0):
        alike = [(limit(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
        best = sorted(alike, key=lambda x: (-x[0], x[1]))[:5]
        found = sorted(got.get(q, []))
        assert [s for _, _, s in found] == [s for s, _ in best], q
        if all(abs(s) < 2**63 - 1 for s, _ in best):
            assert [i for _, i, _ in found] == [i for _, i in best], q


def test_toxicity(spark, sf_dir, nothing):
    from strideframe.llm import toxicity

    rows = queries.op5_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    random = np.random.default_rng(0)
    texts = [sorted(set(random.integers(0, 50, 8).tolist()) | ({60} if k % 2 else set())) for k in range(400)]
    model = toxicity.fit([np.array(t) for t in texts], np.array([k % 2 for k in range(400)]))
    assert toxicity.score(model, [3, 60]) > 0.7 > 0.5 > toxicity.score(model, [3])
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert nothing.select(toxicity.scorer(nothing, toxicity.train(nothing, labels))("text")).count() == 0


def shingle_labels(rows):
    """Brute force: smallest id reachable by links between the texts of ids, or None."""
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t else set() for _, t in rows]
    label = [i for i, _ in rows]
    for _ in rows:
        before = list(label)
        for a, (i, _) in enumerate(rows):
            for b, (j, _) in enumerate(rows[:a]):
                alike = sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
                if None not in (i, j) and (i == j or alike):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {(i, len(s), x) for (i, _), s, x in zip(rows, sets, label, strict=True)}


def test_jaccard_repeated_rows(spark):
    """A repeated row beside a text it shares half with, and beside one it is linked with; ids with different texts."""
    base = [f"w{k}" for k in range(104)]
    half = " ".join([*base[:71], *(f"v{k}" for k in range(33))])
    rows = [(1, " ".join(base)), (2, half)] + [(2, half)] * 2 + [(1, " ".join(base))]
    rows += [(11, " ".join(f"x{k}" for k in range(60))), (12, " ".join(f"x{k}" for k in range(58)))] * 2
    a, b, c = (" ".join(f"{p}{k}" for k in range(50)) for p in "abc")
    rows += [(20, a), (21, a), (21, b), (22, b + " end"), (22, None), (23, c), (23, c.upper()), (24, None), (24, ""), (None, a)]
    rows += [(None, half), (31, c + " other"), (-40, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == shingle_labels([(i, t and t.lower()) for i, t in rows])
    assert len(jaccard.jaccard_classes(docs).collect()) == len(rows)
    kept = collections.Counter(r.doc_id for r in jaccard.one_per_component(docs).collect())
    assert kept == {1: 1, 2: 1, 11: 1, 20: 1, 24: 1, -40: 1, None: 2}


def test_jaccard_repeated_rows_in_families(spark):
    """Near copies of one text, each of many rows: a multiple of what they lack from their leader takes no link away."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        copy = [f"b{k}" for k in range(120)]
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            copy[at] = f"edit{i}x{at}"
        rows += [(i, " ".join(copy))] * (1 + i % 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in jaccard.jaccard_classes(docs).collect()]
    assert len(got) == len(rows) and set(got) == shingle_labels(rows)


def test_repeats_texts_that_share_an_id(spark, monkeypatch):
    """Texts of different length without an id and under one id, and repeated rows; the longest ones repeat passages."""
    passage, other = (" ".join(f"{p}{k}" for k in range(50)) for p in ("pass", "more"))
    fill = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(None, fill("short", 30)), (None, fill("long", 300) + passage + fill("mid", 40) + passage), (None, "tiny")]
    rows += [(None, fill("head", 40) + fill("one", 30)), (None, fill("head", 40) + fill("two", 90))]
    rows += [(7, fill("a", 400) + other + "." + other), (7, fill("b", 60)), (7, ""), (7, None), (9, fill("c", 30) + other)]
    rows += [(9, fill("c", 30) + other), (8, passage), (None, fill("short", 30)), (10, fill("b", 60))]
    order = lambda r: (-1 if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).hexdigest())
    eldest = {}
    for r in {(i, t or "") for i, t in rows}:
        for p in range(len(r[1]) - 99):
            place = (order(r)[0], p, order(r)[1])
            eldest[r[1][p : p + 100]] = min(eldest.get(r[1][p : p + 100], place), place)
    want = collections.Counter()
    for r in rows:
        gone, text = np.zeros(len(r[1] or "") + 1, int), r[1] or ""
        for p in range(len(text) - 99):
            if eldest[text[p : p + 100]] != (order(r)[0], p, order(r)[1]):
                gone[p : p + 100] = 1
        kept = "".join(x for x, g in zip(text, gone, strict=False) if not g)
        want[r[0], len(text), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), kept] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (repeats.MOST_SEGMENTS, 0):
        monkeypatch.setattr(repeats, "MOST_SEGMENTS", most)
        out = repeats.with_kept_bytes(docs, as_text=True).collect()
        assert collections.Counter((r._row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in out) == want


def test_licenses_of_several_notices(spark):
    """Files of up to five notices, with ordinary words that templates also hold, against a scan of all templates; the
    same files in a corpus of other frequencies."""
    rng, notices = np.random.default_rng(11), [n for _, n, _ in licenses.TEMPLATES]
    common = "source forms terms subject charge public license software granted international permission".split()
    texts = []
    for i in range(150):
        parts = [notices[k] for k in rng.choice(len(notices), 1 + i % 5, replace=False)]
        if i % 4 == 0:
            parts = [" ".join(w for w in p.split() if rng.random() > 0.1) for p in parts]
        texts.append(" ".join(x for p in parts for x in (" ".join(rng.choice(common, rng.integers(0, 9))), p.title(), ".")))

    def scanned(text):
        w, labels, score = re.findall(r"[a-z0-9]+", text.lower()), set(), 0.0
        holds = lambda at, phrase: at >= 0 and w[at : at + len(phrase)] == phrase
        labels.update(x for p, x in licenses.BASE.items() for i in range(len(w)) if holds(i, p.split()))
        for label, notice, key in licenses.TEMPLATES:
            n, must = notice.split(), key.split()
            offset = next(i for i in range(len(n)) if n[i : i + len(must)] == must)
            for i in (i for i in range(len(w)) if holds(i, must)):
                labels.add(label)
                stand = sum(0 <= i - offset + k < len(w) and w[i - offset + k] == x for k, x in enumerate(n))
                score = max(score, stand / len(n))
        return ",".join(sorted(labels)), pytest.approx(score)

    rows = list(enumerate(texts))
    for more in ([], [(-1, " ".join(notices[:4]))] * 200):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        for r in licenses.with_licenses(docs).where("doc_id >= 0").collect():
            assert (r.labels, r.score) == scanned(texts[r.doc_id])


def test_prefixes_by_words_of_symbols():
    """Common prefixes against a look at every symbol; only those of the places asked for are compared."""
    random = np.random.default_rng(3)
    for case in range(300):
        s = random.integers(0, (2, 4, 257)[case % 3], random.integers(1, 80)).astype(np.int16)
        s = np.r_[s, s][: random.integers(1, 120)]
        found, most = suffixes.suffix_array(s, len(s) + 1), int(random.integers(1, 40))
        want = np.zeros(len(s), int)
        for a, b in zip(found, found[1:], strict=False):
            while want[b] < most and max(a, b) + want[b] < len(s) and s[a + want[b]] == s[b + want[b]]:
                want[b] += 1
        some = np.flatnonzero(random.random(len(s)) < 0.5)
        assert suffixes.permuted_prefixes(s, found, most).tolist() == want.tolist()
        assert suffixes.permuted_prefixes(s, found, most, some).tolist() == np.where(np.isin(np.arange(len(s)), some), want, 0).tolist()


def test_texts_without_their_spans():
    """Overlapping, touching and repeated spans of many texts at once against marks on every byte."""
    random, kind = np.random.default_rng(5), pa.list_(pa.struct([("at", pa.int64()), ("end", pa.int64())]))
    texts = [random.integers(97, 123, random.integers(0, 40)).astype(np.uint8).tobytes() for _ in range(400)]
    spans = []
    for t in texts:
        cuts = [sorted(random.integers(0, len(t) + 1, 2).tolist()) for _ in range(random.integers(0, 5))]
        spans.append([{"at": a, "end": b} for a, b in cuts if a < b] if random.random() < 0.8 else None)
    gone, runs, kept = repeats.without_spans(texts[100:], pa.array(spans, kind).slice(100))
    for i, (t, found) in enumerate(zip(texts[100:], spans[100:], strict=True)):
        marks = np.zeros(len(t), bool)
        for x in found or []:
            marks[x["at"] : x["end"]] = True
        assert gone[i] == marks.sum() and runs[i] == (np.diff(np.r_[0, marks]) == 1).sum()
        assert kept[i] == bytes(b for b, m in zip(t, marks, strict=True) if not m)
    assert repeats.without_spans([], pa.array([], kind))[2] == [] and repeats.without_spans([b"a"], pa.array([None], kind))[2] == [b"a"]
