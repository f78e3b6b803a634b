"""The pipeline over a small corpus, each stage against brute force on what the stage before kept."""

import collections
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strideframe.llm import queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus(spark, sf_dir, tmp_path_factory):
    """The smallest documents with nulls, an empty text, a repeated row, a near copy and a row without id or source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    long = max(rows[:50], key=lambda r: len(r.text or ""))
    near = long.text + " tail of the copy"
    extra = [
        (90_001, None, "en", "s0", 0), (90_002, "", "en", "s0", 0), (90_003, near, "en", "s1", len(near)),
        tuple(rows[3]), tuple(rows[3]), (None, rows[5].text + " " + rows[6].text, "en", None, None),
    ]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "source_mix", "bpe_encoding"]

    def step(name, given):
        out = stages[name](spark, given, corpus)
        path = f"{corpus}/{name}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        assert name == "bpe_encoding" or out.columns == docs.columns
        return out, out.collect()

    # quality: as the query of the operator judges, and no clean document of any length goes unjudged
    kept, rows = step("quality_rules", docs)
    judged = collections.Counter(r.doc_id for r in queries.op4_quality_rules(spark, corpus).collect() if r.kept)
    assert collections.Counter(r.doc_id for r in rows) == judged and 0 < len(rows) < docs.count()
    assert all(len(words(r.text)) >= 50 for r in rows)

    # near duplicates: one row of each group of linked texts; rows without an id stay
    def shingles(text):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [(r, shingles(r.text)) for r in rows]
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if None not in (sets[i][0].doc_id, sets[j][0].doc_id) and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    kept, alone = step("ngram_jaccard_join", kept)
    assert len(alone) == len(set(group)) < len(rows)
    of = collections.defaultdict(set)
    for (r, _), g in zip(sets, group):
        of[r.doc_id].add(g)
    assert len({min(of[r.doc_id]) for r in alone}) == len(alone)

    # repeated passages: bytes of 100-byte strings that start earlier
    kept, cut = step("suffix_array_dedup", kept)
    seen, want = {}, []
    for n, r in enumerate(sorted(alone, key=lambda r: (r.doc_id is not None, r.doc_id))):
        b = r.text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (n, p)) != (n, p):
                gone[p : p + 100] = b"\1" * 100
        want.append((r.doc_id, bytes(x for x, g in zip(b, gone) if not g)))
    assert len(cut) == len(alone)
    whole = {i: t for i, t in want}
    for r in cut:  # a cut inside a character takes the whole character
        assert abs(len(r.text.encode()) - len(whole[r.doc_id])) < 4 + 4 * whole[r.doc_id].count(b"\x80") + 0.02 * len(whole[r.doc_id])
        assert r.n_chars == len(r.text)

    # the mix: no document over twice, sources near their targets
    sizes = collections.Counter()
    for r in cut:
        sizes[r.source] += len(words(r.text))
    kept, mix = step("source_mix", kept)
    taken, times = collections.Counter(), collections.Counter()
    for r in mix:
        taken[r.source] += len(words(r.text))
        times[r.doc_id, r.text] += 1
    assert max(times.values()) <= 2 and {k for k, _ in times} <= {r.doc_id for r in cut}
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = dict(zip(names, [3, 1, 2] * len(names)))
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(target.values())
        over = {s for s in free if rest * weights[s] / sum(weights[x] for x in free) > 2 * sizes[s]}
        if not over:
            target |= {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
            break
        target |= {s: 2 * sizes[s] for s in over}
        free -= over
    for s in names:
        longest = max(len(words(r.text)) for r in cut if r.source == s)
        assert abs(taken[s] - target[s]) <= 2 * longest, (s, taken[s], target[s])

    # token ids: those of the library, and they decode to the text
    _, ids = step("bpe_encoding", kept)
    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    texts = collections.Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in mix)
    got = collections.Counter(
        (r.doc_id, tuple(int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4))) for r in ids
    )
    assert got == texts


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "source", "lang", "n_tokens", "ids", "decoded_sha256"} == set(out.columns)
    assert out.count() == spark.read.parquet(f"{corpus}/source_mix").count()
