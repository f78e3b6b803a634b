"""License scans with a positional index of rare template words, in DataFrame expressions only.

Templates of license notices are indexed by word: (template, position). Of every template's mandatory key phrase the
words with the highest inverse document frequency in the whole corpus are looked up; every occurrence votes for the place at
which a template would start (its own position less the word's position in the template). Places with votes from two words are
candidates, and a candidate counts if the template's mandatory key phrase stands there. Its score is the share
of template words that stand at their places. Wherever a key phrase stands, its looked-up words vote, so no place is
missed, whatever else the file holds and whichever words the corpus makes rare.

Beside the templates, base phrases are looked up word by word and keep their own labels.

Null and empty texts have no words and no labels. Texts are scanned whole; a file that repeats a notice
many times costs a sort of its places. Repeated rows give equal results; columns of the input other than the
text are kept, and replaced where they have a result's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything that is no digit, lower-case letter or character beyond ASCII separates words.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice, mandatory key phrase (part of the notice).
TEMPLATES: list[tuple[str, str, str]] = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("reserved", "all rights reserved", "rights reserved"),
]

#: Template words that say nothing about a licence; they are verified, not looked up.
PLAIN = set("the is to a of this in and with or any are free use under work person copy without 0 2 3 4 all by".split())

#: Words that must agree on a place, and words looked up per key phrase; every key phrase has as many that are not plain.
VOTES = 2


def postings() -> dict[str, list[tuple[int, int]]]:
    """Word -> (template, position)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, _) in enumerate(TEMPLATES):
        for p, word in enumerate(notice.split()):
            if word not in PLAIN:
                out.setdefault(word, []).append((t, p))
    return out


def lowered(text: Column) -> Column:
    """(Lower-casing beyond ASCII changes neither the words' number nor base phrases.)"""
    return F.lower(F.coalesce(text, F.lit("")))


def words_of(lower: Column) -> Column:
    return F.array_remove(F.split(lower, SEPARATOR), "")


def licence_words_by_rarity(docs: DataFrame, text: str) -> list[str]:
    """Template words, rarest in the corpus first: one pass, one small sum per word."""
    vocabulary = F.array(*map(F.lit, postings()))
    words = words_of(lowered(F.col(f"`{text}`")))
    found = docs.select(F.explode(F.array_intersect(vocabulary, words)).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(postings(), key=lambda w: (counts.get(w, 0), w))


def looked_up(by_rarity: list[str]) -> list[str]:
    """The ``VOTES`` rarest words of every key phrase, rarest first."""
    chosen: set[str] = set()
    for _, _, key in TEMPLATES:
        chosen.update(sorted(set(key.split()) - PLAIN, key=by_rarity.index)[:VOTES])
    return [w for w in by_rarity if w in chosen]


def _base_places(words: Column) -> Column:
    """(start, label) of every base phrase."""

    def at(word: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in BASE.items():
            first, *rest = phrase.split()
            here = word == first
            for k, w in enumerate(rest, 1):
                here = here & (F.get(words, i + k) == w)
            out = F.when(here, F.lit(label)).otherwise(out)
        return F.struct(i.cast("long").alias("start"), out.alias("label"))

    starts = sorted({p.split()[0] for p in BASE})
    places = F.transform(words, lambda w, i: F.when(w.isin(*starts), at(w, i)))
    return F.filter(places, lambda p: p["label"].isNotNull())


def _votes(words: Column, rare: Column) -> Column:
    """(template, start) per occurrence of a rare word and posting, sorted."""
    table = F.create_map(
        *[x for w, at in postings().items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in at]))]
    )
    hits = F.filter(
        F.transform(words, lambda w, i: F.struct(F.array_contains(rare, w).alias("hit"), w.alias("w"), i.alias("i"))),
        lambda h: h["hit"],
    )
    votes = F.transform(
        hits,
        lambda h: F.transform(
            F.element_at(table, h["w"]), lambda x: F.struct(x["t"].alias("t"), (h["i"] - x["p"]).alias("start"))
        ),
    )
    return F.sort_array(F.flatten(votes))


def _stands(words: Column, start: Column, offset: int, phrase: list[str]) -> Column:
    """How many of the words stand at their places."""
    total = F.lit(0)
    for k, word in enumerate(phrase):
        total = total + F.when(F.get(words, start + (offset + k)) == word, 1).otherwise(0)
    return total


def _verified(words: Column, place: Column) -> Column:
    """(label, share of the template) where the key phrase stands, else nulls."""
    label, share = F.lit(None).cast("string"), F.lit(None).cast("double")
    for t, (name, notice, key) in enumerate(TEMPLATES):
        whole, must = notice.split(), key.split()
        offset = next(i for i in range(len(whole)) if whole[i : i + len(must)] == must)
        good = (place["t"] == t) & (_stands(words, place["start"], offset, must) == len(must))
        label = F.when(good, F.lit(name)).otherwise(label)
        share = F.when(good, _stands(words, place["start"], 0, whole) / len(whole)).otherwise(share)
    return F.struct(label.alias("label"), share.alias("share"))


def with_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``
    and ``places`` (base places). One narrow pass besides the pass that counts licence words."""
    by_rarity = licence_words_by_rarity(docs, text)
    words, present, rare, votes = (F.col(f"_license_{x}") for x in ("words", "present", "rare", "votes"))
    out = docs.withColumn("_license_words", words_of(lowered(F.col(f"`{text}`"))))
    known = list(dict.fromkeys([*by_rarity, *(w for phrase in BASE for w in phrase.split())]))
    out = out.withColumn("_license_present", F.array_intersect(F.array(*map(F.lit, known)), words))
    out = out.withColumn("_license_rare", F.array_intersect(F.array(*map(F.lit, looked_up(by_rarity))), present))
    possible = F.lit(False)  # all words of a phrase are somewhere
    for phrase in BASE:
        possible = possible | (F.size(F.array_except(F.array(*map(F.lit, phrase.split())), present)) == 0)
    nowhere = F.array().cast("array<struct<start:bigint,label:string>>")
    none = F.array().cast("array<struct<t:int,start:int>>")
    out = out.withColumns(
        {
            "places": F.when(possible, _base_places(words)).otherwise(nowhere),
            "_license_votes": F.when(F.size(rare) >= VOTES, _votes(words, rare)).otherwise(none),
        }
    )
    # sorted: a place has enough votes if the vote VOTES - 1 further on is for it too
    agreed = F.filter(
        votes,
        lambda v, j: F.coalesce(F.get(votes, j + (VOTES - 1)) == v, F.lit(False))
        & ~F.coalesce(F.get(votes, j - 1) == v, F.lit(False)),
    )
    out = out.withColumn("_license_agreed", agreed)
    found = F.filter(F.transform("_license_agreed", lambda v: _verified(words, v)), lambda x: x["label"].isNotNull())
    out = out.withColumn("_license_found", found)
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    all_labels = F.array_sort(F.array_union(labels, F.transform("_license_found", lambda x: x["label"])))
    return out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_base": F.size("places").cast("long"),
            "first_word": F.array_min(F.transform("places", lambda p: p["start"])),
            "last_word": F.array_max(F.transform("places", lambda p: p["start"])),
            "base_labels": F.array_join(labels, ","),
            "labels": F.array_join(all_labels, ","),
            "score": F.coalesce(F.array_max(F.transform("_license_found", lambda x: x["share"])), F.lit(0.0)),
        }
    ).drop(*[f"_license_{x}" for x in ("words", "present", "rare", "votes", "agreed", "found")])
