"""Byte-level BPE: greedy longest-match proposals, a vectorised test of all neighbours, exact merging of the rest.

A word is encoded by applying merges in order of rank. Its result is the only sequence of tokens in which every
token encodes to itself and no pair of neighbours would have been merged across their boundary at some point.
So a greedy proposal is right exactly when all its tokens are stable and all its neighbours compatible; only
words that fail are merged step by step. Results are kept per worker by word.

A null text is encoded as the empty one. Texts of any length are encoded whole. The special token's string in a
text is the special token, as the library has it by default. Decoding accepts any bytes of ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a worker holds before it starts afresh, and the longest word (characters) it holds.
CACHE_WORDS = 400_000
LONG = 64

#: Characters of text whose words are looked up together.
CHUNK = 500_000

#: Rows whose ids and decoded texts a worker holds at a time.
SLICE = 500

#: Fixed value: the split of byte-level vocabularies into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Outside these ranges the Unicode versions of the two regular-expression engines may differ; a text with such
#: a character is split into words by the tokenizers library.
COMMON = r"[^\x00-ԯ -⁯₠-₿　-〿ぁ-ゖァ-ヺ一-龥가-힣]"

#: The same split in the standard library's terms, for texts of Latin, Greek and Cyrillic letters, common punctuation and
#: digits, among which both agree; numbers that are no digits and control characters are told apart differently.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
UNLIKE = re.compile(r"[^\t-\r -~¡-±´-¸º»¿-ԯ‐-‧‹›₠-₿]")

#: Rank of a pair that never merges; base of the byte strings' hash (odd).
NEVER = 1 << 40
BASE = 0x5851F42D4C957F2D

_loaded: dict[str, "ByteBpe"] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable ones for themselves, the others
    in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def running_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of byte * base^place in 64 bits, and the inverse powers."""
    with np.errstate(over="ignore"):
        powers, inverse = (
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(data), x, np.uint64))])
            for x in (BASE, pow(BASE, -1, 1 << 64))
        )
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    return sums, inverse


def span_hash(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of bytes starts..ends, the same wherever they stand; never 0."""
    with np.errstate(over="ignore"):
        mixed = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed | np.uint64(1)


class Lookup:
    """Whole numbers from 64-bit keys other than 0, for arrays of keys: open addressing, half empty at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 8 - 1).bit_length()))
        self.keys = np.zeros((1 << (64 - int(self.shift))) + len(keys) + 1, np.uint64)
        self.values = np.full(len(self.keys), missing, np.int64)
        self.missing = missing
        for key, value in zip(keys.astype(np.uint64), values, strict=True):
            at = int(self.slot(key))
            while self.keys[at]:
                at += 1
            self.keys[at], self.values[at] = key, value

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        at = self.slot(keys).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.missing)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            at[open_] += 1
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out


class ByteBpe:
    def __init__(self, spec: bytes):
        data = json.loads(spec)
        letters = byte_letters()
        model = data["model"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        as_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in self.special}
        self.ids = {b: model["vocab"][t] for t, b in as_bytes.items()}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for b, i in self.ids.items():
            self.tokens[i] = b
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.size = size
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank = np.full(size, -1, np.int64)  # when a token is made; single bytes: from the start
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.ids[self.tokens[a] + self.tokens[b]]
            self.merges[a, b] = (r, made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, a, b
        self.made = np.array([i for _, i in self.merges.values()], np.int64)  # by rank
        keys = np.array([a * size + b + 1 for a, b in self.merges], np.int64)
        self.pair_rank = Lookup(keys, np.arange(len(keys)), NEVER)
        names = list(self.ids)
        self.find = Lookup(*self.keyed(names), -1)
        longest: dict[int, int] = {}  # entry, by its first two bytes
        for b in names:
            k = b[0] * 256 + b[1] if len(b) > 1 else -1
            longest[k] = max(longest.get(k, 1), len(b))
        self.longest = np.ones(1 << 16, np.int64)
        for k, n in longest.items():
            if k >= 0:
                self.longest[k] = n
        self.stable = np.array([True] * size)
        ordinary = [i for b, i in self.ids.items() if len(b) > 1]
        for i, x in zip(ordinary, self.merge_words([self.tokens[i] for i in ordinary]), strict=True):
            self.stable[i] = x == array("I", [i]).tobytes()
        self.cache: dict[str, bytes] = {}
        self.words = regex.compile(WORDS)
        self.uncommon = regex.compile(COMMON)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def keyed(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([len(b) for b in names])
        starts = ends - [len(b) for b in names]
        sums, inverse = running_hash(np.frombuffer(b"".join(names), np.uint8))
        return span_hash(sums, inverse, starts, ends), np.array([self.ids[b] for b in names], np.int64)

    def proposed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest vocabulary entry first, all words a token at a time: (ids, tokens per word), flat."""
        sums, inverse = running_hash(data)
        two = np.zeros(len(data), np.int64)
        two[:-1] = data[:-1].astype(np.int64) * 256 + data[1:]
        at, live, found_at, found = starts.copy(), np.arange(len(starts)), [], []
        while len(live):
            p = at[live]
            most = np.minimum(self.longest[two[p]], ends[live] - p)
            token = np.full(len(live), -1, np.int64)
            for n in range(int(most.max()), 1, -1):
                some = np.flatnonzero((token < 0) & (most >= n))
                if len(some):
                    token[some] = self.find(span_hash(sums, inverse, p[some], p[some] + n))
            single = token < 0
            token[single] = self.byte_ids[data[p[single]]]
            found_at.append(p)
            found.append(token)
            at[live] = p + self.lengths[token]
            live = live[at[live] < ends[live]]
        place, token = np.concatenate(found_at), np.concatenate(found)
        order = np.argsort(place, kind="stable")
        return token[order], np.searchsorted(place[order], ends) - np.searchsorted(place[order], starts)

    def test_pairs(self, keys: np.ndarray) -> np.ndarray:
        """For each key left * size + right: would the two stay apart? Goes back in time: the token of the two
        that was made last is taken apart, and the tokens at the boundary before must not have merged earlier.
        Of merges of one rank the left one comes first, so a right neighbour's own merge loses a tie."""
        a, b = keys // self.size, keys % self.size
        until = np.full(len(keys), 2 * NEVER)  # twice the rank, plus one where a tie counts too
        good, live = np.ones(len(keys), bool), np.arange(len(keys))
        while len(live):
            x, y = a[live], b[live]
            merged = 2 * self.pair_rank(x * self.size + y + 1) < until[live]
            good[live[merged]] = False
            rx, ry = self.rank[x], self.rank[y]
            split_x = ~merged & (rx > ry)
            split_y = ~merged & (ry >= rx) & (ry >= 0)
            i, j = live[split_x], live[split_y]
            until[i], a[i] = 2 * rx[split_x], self.right[x[split_x]]
            until[j], b[j] = 2 * ry[split_y] + 1, self.left[y[split_y]]
            live = live[split_x | split_y]
        return good

    def merged(self, word: bytes) -> list[int]:
        """Exact: always the pair of least rank, the leftmost of these."""
        part = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(part) > LONG:
            return self.merged_long(part)
        get, none = self.merges.get, (1 << 40, -1)
        pairs = [get(p, none) for p in zip(part, part[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            part[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get((part[i - 1], part[i]), none)
            if i < len(pairs):
                pairs[i] = get((part[i], part[i + 1]), none)
        return part

    def merged_long(self, part: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words without any space."""
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get((part[i], part[j]))):
                heapq.heappush(heap, (m[0], i, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j >= n or part[j] != y:
                continue
            part[i], part[j] = self.merges[x, y][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p >= 0]

    def ranks_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 fills a row and pairs with nothing."""
        out = np.full(len(x), NEVER)
        both = np.flatnonzero(y >= 0)
        out[both] = self.pair_rank(x[both] * self.size + y[both] + 1)
        return out

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many words: rows of tokens, in each round one merge per row."""
        out: list[bytes] = [b""] * len(words)
        for low, high in ((0, 8), (8, 16), (16, 32)):
            some = [i for i, w in enumerate(words) if low < len(w) <= high]
            if not some:
                continue
            n = np.array([len(words[i]) for i in some])
            padded = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in some), np.uint8).reshape(-1, high)
            done = np.where(np.arange(high) < n[:, None], self.byte_ids[padded], -1)
            live, rows = np.arange(len(some)), done.copy()
            ranks = self.ranks_of(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(some), -1)
            while len(live) and rows.shape[1] > 1:
                i = ranks.argmin(1)  # the leftmost of the least
                least = ranks[np.arange(len(live)), i]
                go = least < NEVER
                if not go.all():
                    done[live[~go], : rows.shape[1]] = rows[~go]
                    done[live[~go], rows.shape[1] :] = -1
                    live, rows, ranks, i, least = live[go], rows[go], ranks[go], i[go], least[go]
                if not len(live):
                    break
                k, width = np.arange(len(live)), rows.shape[1] - 1
                rows[k, i] = self.made[least]
                keep = np.ones(rows.shape, bool)
                keep[k, i + 1] = False
                rows = rows[keep].reshape(-1, width)
                if width == 1:
                    break
                keep = np.ones(ranks.shape, bool)
                keep[k, i] = False
                ranks = ranks[keep].reshape(-1, width - 1)
                for left in (i - 1, i):
                    at = np.flatnonzero((left >= 0) & (left < width - 1))
                    j = left[at]
                    ranks[at, j] = self.ranks_of(rows[at, j], rows[at, j + 1])
            done[live, : rows.shape[1]] = rows
            done[live, rows.shape[1] :] = -1
            tokens = done
            kept = tokens >= 0
            packed, ends = tokens[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
            begin = 0
            for i, end in zip(some, ends, strict=True):
                out[i] = packed[begin:end]
                begin = end
        for i, w in enumerate(words):
            if len(w) > 32:
                out[i] = array("I", self.merged(w)).tobytes()
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        raw = [w.encode() for w in words]
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(b) for b in raw], np.int64)
        ends = np.cumsum(sizes)
        flat, counts = self.proposed(data, ends - sizes, ends)
        last = np.cumsum(counts)
        good = self.stable[flat]
        apart = self.test_pairs(flat[:-1] * self.size + flat[1:])
        apart[last[:-1] - 1] = True  # two words' boundary
        good[:-1] &= apart
        good = np.logical_and.reduceat(good, last - counts)
        if b"".join([self.tokens[i] for i in flat.tolist()]) != joined:
            good[:] = False  # two byte strings of one hash: merge all instead
        failing = np.flatnonzero(~good).tolist()
        packed, cuts = flat.astype("<u4").tobytes(), [0, *(4 * last).tolist()]
        out = [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i, ids in zip(failing, self.merge_words([raw[i] for i in failing]), strict=True):
            out[i] = ids
        return out

    def split(self, text: str) -> list[str]:
        if not UNLIKE.search(text):
            return PLAIN_WORDS.findall(text)
        if not self.uncommon.search(text):
            return self.words.findall(text)
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; words not met before are proposed and verified together."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK):
                chars += len(texts[end])
                end += 1
            out += self.encode_some(texts[at:end])
            at = end
        return out

    def encode_some(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        parts = [self.specials.split(t) if self.specials and self.specials.search(t) else [t] for t in texts]
        words = [[self.split(p) if i % 2 == 0 else p for i, p in enumerate(x)] for x in parts]
        new = list(set().union(*(y for x in words for y in x[::2])).difference(cache))
        if new:
            cache.update(zip(new, self.encode_words(new), strict=True))
        out = [
            b"".join(
                b"".join(map(cache.__getitem__, y)) if i % 2 == 0 else array("I", [self.special[y]]).tobytes()
                for i, y in enumerate(x)
            )
            for x in words
        ]
        for w in new:
            if len(w) > LONG:
                del cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")


def codec(spec: bytes) -> ByteBpe:
    key = hashlib.sha256(spec).hexdigest()
    if key not in _loaded:
        _loaded[key] = ByteBpe(spec)
    return _loaded[key]


def bpe_codec(path: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Column functions (encode, decode): a text to its ids as little-endian unsigned 32-bit numbers, and back.
    The vocabulary at ``path`` is read on the driver and travels with the functions."""
    with open(path, "rb") as f:
        spec = f.read()

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(codec(spec).encode_all([t or "" for t in texts]), dtype=object)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        bpe = codec(spec)
        return ids.map(lambda x: bpe.decode(x) if x else "")

    return encode, decode


def round_trip(path: str) -> Callable[[Column], Column]:
    """A column function: a text to a struct of ``ids`` and ``decoded``, each text encoded once. Results leave in
    batches of ``SLICE`` rows: those of a whole batch of Spark's would stand in the worker and in the JVM at once."""
    with open(path, "rb") as f:
        spec = f.read()

    @F.arrow_udf("ids binary, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = codec(spec)
        for texts in batches:
            for i in range(0, len(texts), SLICE):
                ids = bpe.encode_all([t or "" for t in texts.slice(i, SLICE).to_pylist()])
                columns = [pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())]
                yield pa.StructArray.from_arrays(columns, ["ids", "decoded"])

    return both


def with_round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, 4 bytes each), ``n_tokens`` and ``decoded``; such columns are replaced.
    Rows are not shuffled. Both come from one function: a decoder over an encoder would have every text encoded
    twice, once for the ids and once for what is decoded."""
    both = round_trip(path)(F.col(f"`{text}`"))
    return docs.withColumns(
        {"ids": both["ids"], "n_tokens": (F.octet_length(both["ids"]) / 4).cast("long"), "decoded": both["decoded"]}
    )
