"""Token counts of whole texts: a broadcast table of frequent pre-token lengths, worker caches for the rest.

The model is a byte-pair model over pieces in which the word mark (U+2581) only stands at the start of a piece
or fills it, and in which no piece holds a line feed. So no merge crosses the start of a run of word marks or a
line feed, and a text's count is the sum over its pre-tokens. Both properties are verified when a model is
loaded; a model without them is applied to whole texts.

Nulls and empty texts have no tokens. A pre-token of any length is counted; those over ``LONG`` characters are
encoded each time instead of being held. Repeated rows give repeated results. Columns other than the text are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"

#: Pre-tokens longer than this many characters are not held in a cache.
LONG = 48

#: Entries a worker's cache holds before it starts again with the frequent ones.
CACHE_ENTRIES = 200_000

#: Documents (about) whose pre-tokens choose the frequent ones, and how many of these are broadcast. Both only
#: decide what is looked up and what is encoded, never a count.
SAMPLE_DOCUMENTS = 2_000
FREQUENT = 20_000

_loaded: dict[str, "PieceLengths"] = {}


class PieceLengths(dict):
    """Pre-token -> number of tokens; a missing one is encoded and kept."""

    def __init__(self, model: bytes, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.frequent = frequent
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.splits = not any(MARK in n.lstrip(MARK) or "\n" in n for n in names)

    def __missing__(self, part: str) -> int:
        n = self.encoded(part)
        if len(part) <= LONG:
            if len(self) > CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[part] = n
        return n

    def encoded(self, part: str) -> int:
        """Tokens of a pre-token. The library puts a word mark before any text, so one that starts with a
        mark is given without it, and one that does not is given behind a line feed, whose two tokens go."""
        if part.startswith(" "):
            return len(self.pieces.encode(part[1:])) if len(part) > 1 else 1
        return len(self.pieces.encode("\n" + part)) - 2

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.pieces.encode(text))
        total = 0
        for i, line in enumerate(text.replace(MARK, " ").split("\n")):
            total += i > 0  # the line feed
            words = line.split(" ")
            first = words[0] if i else " " + words[0]  # a text begins with a word mark
            if "" in words:
                total += sum(self[p] for p in pre_tokens(line if i else " " + line))
            else:
                total += self[first] + sum(map(self.__getitem__, [" " + w for w in words[1:]]))
        return total


def pre_tokens(line: str) -> Iterator[str]:
    """Runs of spaces with what follows them up to the next space."""
    begin, n = 0, len(line)
    while begin < n:
        at = begin
        while at < n and line[at] == " ":
            at += 1
        end = line.find(" ", at)
        end = n if end < 0 else end
        yield line[begin:end]
        begin = end


def lengths(model: bytes, frequent: dict[str, int]) -> PieceLengths:
    """The worker's table for a model; one stays for all tasks of the worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded or _loaded[key].frequent.keys() != frequent.keys():
        _loaded[key] = PieceLengths(model, frequent)
    return _loaded[key]


def model_bytes(path: str) -> bytes:
    """The vocabulary file, read on the driver: under a few MB by the formats' nature."""
    with open(path, "rb") as f:
        return f.read()


def frequent_lengths(docs: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """Lengths of at most ``FREQUENT`` pre-tokens, those most frequent in about ``SAMPLE_DOCUMENTS`` documents."""
    rows = docs.count()
    if rows == 0:
        return {}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for value in batch.column(0):
                for line in (value.as_py() or "").split("\n"):
                    found.update(" " + w for w in line.split(" ") if 0 < len(w) < LONG)
            top = found.most_common(FREQUENT)
            yield pa.RecordBatch.from_pydict({"part": [p for p, _ in top], "n": [n for _, n in top]})

    sample = docs.sample(fraction=min(1.0, SAMPLE_DOCUMENTS / rows), seed=9).select(F.col(text).alias("text"))
    parts = sample.mapInArrow(counted, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    top = parts.where("n > 1").orderBy(F.desc("n"), "part").limit(FREQUENT).collect()
    table = PieceLengths(model_bytes(path), {})
    return {r["part"]: table.encoded(r["part"]) for r in top}


def token_count(path: str, frequent: dict[str, int]) -> Callable[[Column], Column]:
    """A column function: number of tokens of a text, without begin, end or other added tokens."""
    model = model_bytes(path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        table = lengths(model, frequent)
        return texts.map(lambda t: table.count(t) if t else 0).astype("int64")

    return count


def with_token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Columns of these names that ``docs`` already has are replaced. The rows are not shuffled.
    """
    count = token_count(path, frequent_lengths(docs, path, text))
    source = F.col(f"`{text}`")
    out = docs.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(source), F.lit(0)).cast("long"), "n_tokens": count(source)}
    )
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
