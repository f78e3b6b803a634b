"""From raw documents to token ids, in stages that each apply one operator to all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps or changes, with the columns of
``documents``; the last returns token ids. Between stages the rows are written as Parquet and read again.

Every stage takes nulls in any column, texts of any length, repeated rows and empty tables (which give empty
results); further columns stay until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import bpe, jaccard, mixing, quality, repeats
from strideframe.llm.queries import table, tokenizer
from strideframe.storage import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them. Repeated rows share a verdict."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, the one with the smallest
    id stays; of rows with that id, one (the longest text, ties by the text). Rows without an id stay."""
    return jaccard.one_per_component(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier in the corpus go (rows without an id come first); ``n_chars``
    follows the text. No row goes, though a text may end up empty."""
    out = repeats.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per take, at most two of a document; sources weigh 3, 1, 2 in turn, rows without a source being one
    source, the last. Empty texts take nothing. Reruns draw the same rows."""
    return mixing.mixed(docs, weights=(3, 1, 2), share=1.5, most=2.0, shards=24)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (little-endian unsigned 32-bit numbers), their number and the digest of the decoded text, a row per row
    given; null and empty texts have no ids."""
    out = bpe.with_round_trip(docs.select("doc_id", "source", "lang", "text"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "source", "lang", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mix", source_mix),
    ("bpe_encoding", token_ids),
]

#: Draws, suffix arrays and merges have no SQL form; the tests hold each stage's operator against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
