"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

A is a byte-level model applied to a space and the text, B a model of pieces that puts its word mark before the text. The
tokens' spans give coarse cuts: character offsets of the tokenizers library, spans of sentencepiece's proto. Where a span
does not hold as many bytes as its token stands for (parts of a multibyte character, pieces that are single
bytes) the end follows from the token's decoded bytes. Offsets at which tokens of both end cut the text into groups.

Texts are encoded in parts that begin with a single space or line feed between characters that are no white space: neither tokenizer
forms a token across such a place (for B this is verified when it is loaded; otherwise whole texts are encoded).
So each worker keeps the alignment of parts it has met.

Null and empty texts, and texts whose tokens' bytes differ from the text (such as those with the word mark itself), have
no tokens: zeros and an empty string. A part of any length is aligned; long ones are not kept. Repeated rows count as
documents of their own. An empty table gives an empty result. Columns of the input stay in ``_row``, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.stored import stored
from strideframe.storage import BROADCAST_BYTES

MARK = "▁"

#: Parts longer than this many characters are aligned each time; parts a worker keeps before it starts again; new parts
#: encoded at once; documents aligned at once.
LONG = 64
KEPT_PARTS = 300_000
JOINED_PARTS = 4_000
BATCH = 500

#: Links of a group from which equal ids are counted before they are paired.
LARGE_GROUP = 64

#: Bytes of a row of counts in a broadcast table, amply.
COUNT_BYTES = 32

_SINGLE_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_FIRM = frozenset(map(chr, range(0x21, 0x7F)))

_NOT_FIRM = re.compile(r"[^!-~\w \n]")

_loaded: dict[tuple[str, str], "Aligner"] = {}


def byte_letters() -> dict[str, int]:
    """The letter each byte is written as in a byte-level vocabulary: printable Latin-1 bytes as themselves, the others
    as the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Alignment:
    """Of some parts: their groups as text, tokens and groups, and id pairs (``sizes`` of each part) with links."""

    parts: list[str]
    texts: list[str | None]
    numbers: np.ndarray
    sizes: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


class Aligner:
    """The two tokenizers, and the alignments of parts met so far, by slot."""

    def __init__(self, json_model: str, piece_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(json_model)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [_piece_bytes(n) for n in names]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # ids as text, with what follows: the next of the group, or the group's other side, or the next group
        self.a_texts = np.array([f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"], object)
        self.b_texts = np.array([f"{i}{c}" for i in range(len(self.b_bytes)) for c in ",;"], object)
        self.splits = not any(MARK in n.lstrip(MARK) or "\n" in n for n in names)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.texts: list[str | None] = []  # the groups; None: the tokens' bytes are not the part's
        self.numbers = np.zeros((0, 3), np.int64)  # tokens of A, tokens of B, groups
        self.ends = np.zeros(1, np.int64)  # of each slot's pairs
        self.pairs, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def thin(self) -> None:
        """Parts that were used most stay, at most half of ``KEPT_PARTS`` and none used once only."""
        least = 2
        if len(self.uses) > KEPT_PARTS // 2:
            least = max(least, 1 + int(np.partition(self.uses, -(KEPT_PARTS // 2))[-(KEPT_PARTS // 2)]))
        kept = sorted((i, part) for part, i in self.slots.items() if self.uses[i] >= least)
        at = np.array([i for i, _ in kept], np.int64)
        texts, numbers, uses = [self.texts[i] for i in at.tolist()], self.numbers[at], self.uses[at] // 2
        sizes = self.ends[at + 1] - self.ends[at]
        rows = np.arange(sizes.sum()) + np.repeat(self.ends[at] - np.cumsum(sizes) + sizes, sizes)
        pairs, links = self.pairs[rows], self.links[rows]
        self.slots = {part: i for i, (_, part) in enumerate(kept)}
        self.texts, self.numbers, self.uses, self.pairs, self.links = texts, numbers, uses, pairs, links
        self.ends = np.r_[0, np.cumsum(sizes)]
        if len(self.pairs) > 8 * KEPT_PARTS:
            self.forget()

    def parts(self, text: str) -> list[str]:
        """Parts of a space and the text. Each begins with a space or a line feed, and is joined to the one before
        where the cut has no firm character on either side."""
        if not self.splits:
            return [" " + text]
        parts = []
        for i, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            parts.append(("\n" if i else " ") + first)
            parts += [" " + w for w in rest]
        if _is_tight(text):
            return parts
        cuts, before = [0], False
        for i, part in enumerate(parts):
            if before and _is_firm(part[1:2]):
                cuts.append(i)
            before = _is_firm(part[-1])
        if len(cuts) == len(parts):
            return parts
        return ["".join(parts[i:j]) for i, j in zip(cuts, [*cuts[1:], len(parts)], strict=True)]

    def slots_of(self, texts: list[str]) -> list[np.ndarray]:
        """The slots of each text's parts, new ones aligned first."""
        if len(self.texts) > KEPT_PARTS or len(self.pairs) > 16 * KEPT_PARTS:
            self.thin()
        split = [self.parts(t) for t in texts]
        new = {p for parts in split for p in parts} - self.slots.keys()
        # parts that are firm at both ends are encoded as one text
        firm = [p for p in new if self.splits and _is_firm(p[1:2]) and _is_firm(p[-1])]
        found = []
        for begin in range(0, len(firm), JOINED_PARTS):
            found += self.aligned(firm[begin : begin + JOINED_PARTS])
        for part in new.difference(firm):
            found += self.aligned([part])
        self.keep(found)
        get = self.slots.__getitem__
        slots = [np.fromiter(map(get, parts), np.int64, len(parts)) for parts in split]
        used = np.bincount(np.concatenate([np.zeros(0, np.int64), *slots]), minlength=len(self.texts))
        used[: len(self.uses)] += self.uses
        self.uses = used
        return slots

    def keep(self, found: list[Alignment]) -> None:
        for one in found:
            for part, text in zip(one.parts, one.texts, strict=True):
                self.slots[part] = len(self.texts)
                self.texts.append(text)
        if found:
            self.numbers = np.concatenate([self.numbers, *(x.numbers for x in found)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([x.sizes for x in found]))])
            self.pairs = np.concatenate([self.pairs, *(x.pairs for x in found)])
            self.links = np.concatenate([self.links, *(x.links for x in found)])

    def drop_long(self) -> None:
        """Long parts are met anew next time."""
        for part in [p for p in self.slots if len(p) > LONG]:
            self.texts[self.slots.pop(part)] = ""

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, their byte ends, ids of B, their byte ends) of a text that begins with a space or a line feed.

        sentencepiece puts a word mark before a text: that is the space; before a line feed it is a piece too many.
        """
        encoding = self.a.encode(text, add_special_tokens=False)
        a_ids = np.array(encoding.ids, np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # byte of each character
        offsets = at[np.fromiter(chain.from_iterable(encoding.offsets), np.int64).reshape(-1, 2)]
        a_ends = _refined(offsets[:, 0], offsets[:, 1], self.a_sizes[a_ids])
        spaced = text[0] == " "
        pieces = self.b.encode(text[1:] if spaced else text, return_type="proto").pieces
        b_ids = np.fromiter((p.id for p in pieces), np.int64, len(pieces))
        ends = np.fromiter((p.end for p in pieces), np.int64, len(pieces)) + spaced
        if not spaced:
            b_ids, ends = b_ids[1:], ends[1:]
        return a_ids, a_ends, b_ids, _refined(np.r_[0, ends[:-1]], ends, self.b_sizes[b_ids])

    def aligned(self, parts: list[str]) -> list[Alignment]:
        """The alignment of parts between which both tokenizers cut. Where the joined tokens' bytes are not the text, each
        part is taken for itself."""
        lead = [] if len(parts) == 1 else [" a"]  # a firm part to begin with
        text = "".join(lead + parts)
        data = text.encode()
        a_ids, a_ends, b_ids, b_ends = self.spans(text)
        sizes = np.array([len(p.encode()) for p in lead + parts])
        bounds = np.cumsum(sizes)
        common = np.intersect1d(a_ends, b_ends)
        if (
            b"".join([self.a_bytes[i] for i in a_ids.tolist()]) != data
            or b"".join([self.b_bytes[i] for i in b_ids.tolist()]) != data
            or not np.isin(bounds, common).all()
        ):
            if len(parts) > 1:
                return [x for p in parts for x in self.aligned([p])]
            nothing = np.zeros(0, np.int64)
            return [Alignment(parts, [None], np.zeros((1, 3), np.int64), np.zeros(1, np.int64), nothing, nothing)]
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        part_of = np.searchsorted(bounds, common)  # of a group
        n_a, n_b = np.bincount(a_group, minlength=len(common)), np.bincount(b_group, minlength=len(common))
        numbers = np.stack([np.bincount(part_of, x, len(bounds)) for x in (n_a, n_b, np.ones(len(common)))], 1).astype(np.int64)
        a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b

        # groups as text: A's and B's ids in turn
        written = np.empty(len(a_ids) + len(b_ids), object)
        written[np.arange(len(a_ids)) + b_first[a_group]] = self.a_texts[2 * a_ids + np.r_[a_group[1:] != a_group[:-1], True]]
        b_last = np.r_[b_group[1:] != b_group[:-1], True]
        written[np.arange(len(b_ids)) + (a_first + n_a)[b_group]] = self.b_texts[2 * b_ids + b_last]
        listed, stops = written.tolist(), np.cumsum(numbers[:, 0] + numbers[:, 1]).tolist()
        texts = ["".join(listed[i:j])[:-1] for i, j in zip([0, *stops], stops, strict=False)]

        # links: every A token with every B token of its group; large groups by distinct ids
        large = np.flatnonzero(n_a * n_b > LARGE_GROUP)
        times = np.where(np.isin(a_group, large), 0, n_b[a_group])
        left = np.repeat(np.arange(len(a_ids)), times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + b_first[a_group[left]]
        pairs = [a_ids[left] << 32 | b_ids[right]]
        links, of = [np.ones(len(left), np.int64)], [part_of[a_group[left]]]
        for g in large.tolist():
            x, nx = np.unique(a_ids[a_first[g] : a_first[g] + n_a[g]], return_counts=True)
            y, ny = np.unique(b_ids[b_first[g] : b_first[g] + n_b[g]], return_counts=True)
            pairs.append((x[:, None] << 32 | y[None, :]).ravel())
            links.append((nx[:, None] * ny[None, :]).ravel())
            of.append(np.full(len(x) * len(y), part_of[g]))
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        skip = int((of < len(lead)).sum())
        return [
            Alignment(
                parts,
                texts[len(lead) :],
                numbers[len(lead) :],
                np.bincount(of, minlength=len(bounds))[len(lead) :],
                np.concatenate(pairs)[order][skip:],
                np.concatenate(links)[order][skip:],
            )
        ]


def _is_firm(character: str) -> bool:
    """No white space for either tokenizer."""
    return character in _FIRM or character.isalnum()


def _is_tight(text: str) -> bool:
    """Whether firm characters stand on both sides of every space and line feed: no cut needs a look."""
    doubled = any(gap in text for gap in ("  ", " \n", "\n ", "\n\n"))
    return not doubled and text[0] not in " \n" and text[-1] not in " \n" and not _NOT_FIRM.search(text)


def _piece_bytes(name: str) -> bytes:
    byte = _SINGLE_BYTE.fullmatch(name)
    return bytes([int(byte[1], 16)]) if byte else name.replace(MARK, " ").encode()


def _refined(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the span's end where the span holds as many bytes as the token stands for, else as far
    behind the last such end as the tokens' bytes since then reach."""
    total = np.cumsum(sizes)
    sure = np.maximum.accumulate(np.where(ends - begins == sizes, np.arange(len(ends)), -1))
    return total + np.where(sure >= 0, ends[sure] - total[sure], 0) if len(ends) else total


def aligner(json_model: str, piece_model: bytes) -> Aligner:
    """The worker's aligner; one stays for all tasks of the worker."""
    key = (hashlib.sha256(json_model.encode()).hexdigest(), hashlib.sha256(piece_model).hexdigest())
    if key not in _loaded:
        _loaded[key] = Aligner(json_model, piece_model)
    return _loaded[key]


COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def align_texts(model: Aligner, texts: list[str | None]) -> dict[str, list | np.ndarray | pa.Array]:
    """The columns ``COLUMNS`` of a batch of texts."""
    full = [i for i, t in enumerate(texts) if t]
    slots = model.slots_of([texts[i] for i in full])
    kept, digests = [], [""] * len(texts)
    for i, own in zip(full, slots, strict=True):
        written = [model.texts[s] for s in own.tolist()]
        if None not in written:
            kept.append((i, own))
            digests[i] = hashlib.sha256(";".join(written).encode()).hexdigest()
    of = np.repeat([i for i, _ in kept], [len(own) for _, own in kept]).astype(np.int64)
    slot = np.concatenate([np.zeros(0, np.int64), *(own for _, own in kept)])
    numbers = [np.bincount(of, model.numbers[slot, k], len(texts)).astype(np.int64) for k in range(3)]
    # pairs of a document's distinct parts, times how often each part stands there; then equal pairs in one
    width = max(1, len(model.texts))
    code, times = np.unique(of * width + slot, return_counts=True)
    row, slot = code // width, code % width
    sizes = model.ends[slot + 1] - model.ends[slot]
    at = np.arange(sizes.sum()) + np.repeat(model.ends[slot] - np.cumsum(sizes) + sizes, sizes)
    bits = 32 + len(model.a_bytes).bit_length()
    code, back = np.unique(np.repeat(row, sizes) << bits | model.pairs[at], return_inverse=True)
    links = np.bincount(back, model.links[at] * np.repeat(times, sizes), len(code)).astype(np.int64)
    row = code >> bits
    offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    model.drop_long()
    return {
        "n_a": numbers[0],
        "n_b": numbers[1],
        "n_groups": numbers[2],
        "n_links": np.bincount(row, links, len(texts)).astype(np.int64),
        "groups_sha256": digests,
        "pairs": pa.ListArray.from_arrays(offsets, code & ((1 << bits) - 1)),
        "links": pa.ListArray.from_arrays(offsets, links),
    }


def aligned(docs: DataFrame, json_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """(row, _row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links), stored: ``pairs`` are the distinct id pairs
    (A's id times 2^32 plus B's) of a document and ``links`` how many links each stands for. ``row`` numbers the rows."""
    with open(json_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        json_model, piece_model = f.read(), g.read()
    held = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row")
        if len(docs.columns) > 1
        else F.struct(F.lit(None).alias("_none")).alias("_row"),
        F.col(f"`{text}`").alias("_text"),
    )
    kept = held.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = aligner(json_model, piece_model)
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                part = batch.slice(begin, BATCH)
                found = align_texts(model, part.column("_text").to_pylist())
                columns = {"row": part.column("row"), "_row": part.column("_row")} | found
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))

    return stored(held.mapInArrow(run, f"row long, _row {kept}, {COLUMNS}"), "alignment")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, documents, best): how many documents hold each linked pair, and whether none of its A id's pairs has more.
    Stored; a row per distinct pair. A window holds at most as many rows as B has pieces."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))
    most = F.max("documents").over(Window.partitionBy(F.shiftright("pair", 32)))
    return stored(counts.withColumn("best", F.col("documents") == most), "alignment_counts")


def with_counts(rows: DataFrame, counts: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with ``n_best`` and ``count_sum``.

    Counts up to ``max_bytes`` are broadcast. Of more, the pairs of the most documents are, as many as fit, and the others meet
    their counts in a shuffle: no key of that shuffle is frequent.
    """
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    held, n = max(1, max_bytes // COUNT_BYTES), counts.count()
    if n <= held:
        met = links.join(F.broadcast(counts), "pair")
    else:
        least = counts.agg(F.percentile_approx("documents", F.lit(1 - held / n), F.lit(100_000))).first()[0]
        often, seldom = counts.where(F.col("documents") > least), counts.where(F.col("documents") <= least)
        tried = links.join(F.broadcast(often), "pair", "left")
        rest = tried.where("documents is null").select("row", "pair", "links")
        met = tried.where("documents is not null").unionByName(rest.join(seldom, "pair"))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("documents")).alias("count_sum"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "links").join(sums, "row", "left").select(
        "_row", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )


def alignments(docs: DataFrame, json_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """Tokens, groups and links of every document, and how its links stand in the whole table."""
    rows = aligned(docs, json_path, piece_path, text)
    return with_counts(rows, pair_counts(rows))
