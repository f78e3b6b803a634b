"""The round trip encodes each text once, and gives what encoder and decoder give one after the other."""

import pyarrow as pa
from pyspark.sql import functions as F

import public_tokenizers
from strideframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_each_text_is_encoded_once(spark):
    texts = [None, "", "one two one two", "é漢🤔 <|endoftext|>", "x" * 300, "one two one two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = bpe.with_round_trip(docs, PATH).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("i"), F.sha2("decoded", 256).alias("d"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    evaluated = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(evaluated) == 1 and evaluated[0].split("], [")[0].count("(text#") == 1

    encode, decode = bpe.bpe_codec(PATH)
    twice = docs.withColumn("ids", encode("text")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long"), F.sha2("ids", 256), F.sha2(decode("ids"), 256)
    )
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, twice.collect()))


def test_results_leave_in_bounded_batches(spark):
    """A batch of Spark's holds 10,000 rows; results come back in smaller ones, in order, none missing."""
    docs = spark.range(2 * bpe.SLICE + 7, numPartitions=1).select(F.col("id").alias("doc_id"), F.format_string("one %d two", "id").alias("text"))
    both = bpe.round_trip(PATH)
    sizes = []
    for n in (0, 1, bpe.SLICE, 2 * bpe.SLICE + 7):
        sizes.append([len(x) for x in both.func(iter([pa.array([f"one {i}" for i in range(n)], pa.string())]))])
    assert sizes == [[], [1], [bpe.SLICE], [bpe.SLICE, bpe.SLICE, 7]]
    rows = bpe.with_round_trip(docs, PATH).select("doc_id", "text", "decoded").collect()
    assert len(rows) == 2 * bpe.SLICE + 7 and all(r.text == r.decoded == f"one {r.doc_id} two" for r in rows)
