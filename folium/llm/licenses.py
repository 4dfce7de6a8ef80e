"""License scans: exact set-similarity join of text blocks with license templates.

DataFrame operations only. A block is a line of a text. Tokens are put in one global order,
rarest first by document frequency over the whole table (tokens of no template come last;
any total order is exact). A block can contain a template to the threshold only if

* prefix: one of the template's first |T| - a + 1 tokens is in it, a = ceil(threshold |T|),
* length: it has at least a distinct tokens,
* position: the tokens from the first common one on are enough on both sides,

and what passes is verified on the full sets. The templates are a fixed list, so the index
side is a constant of bounded size and the join needs no shuffle; the one shuffle is the
count of the templates' tokens, at most one row a token from each task.

Defined cases: a null text is empty: no words, null first and last word, empty labels and
score 0; repeated rows are rows of their own; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit": "released under the mit license",
    "apache-2": "licensed under the apache license version 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
THRESHOLD = 0.8
#: A word in the given text, whose A-Z are not yet lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BEFORE, _AFTER = r"(?<![0-9A-Za-z\x{80}-\x{10FFFF}]%s)", r"(?![0-9A-Za-z\x{80}-\x{10FFFF}])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: Column) -> Column:
    """Lower case for matching words of a-z and digits: the two signs beyond ASCII whose lower case has such letters are put out of the way."""
    return F.lower(F.regexp_replace(text, "[\u0130\u212A]", "\u00FF"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(RAW_WORD), 0)


def _literal(words) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _split(text: Column) -> Column:
    """All words of a text, and an empty one at an end that has none: cheaper than taking the words out one by one."""
    return F.split(_lower(text), _GAP)


def _lines(text: Column, tokens: list[str]) -> Column:
    """The lines that hold one of the tokens as a word."""
    pattern = rf"(?i){_BEFORE % ''}(?:{'|'.join(tokens)}){_AFTER}"
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))


def _blocks(lines: Column, vocabulary: list[str], least: int) -> Column:
    """Of each line with enough of the vocabulary: its distinct tokens of it, in the
    vocabulary's order, and the number of all its distinct tokens."""
    words = F.transform(lines, lambda x: F.array_distinct(_words(x)))
    found = F.transform(words, lambda w: F.struct(F.array_intersect(_literal(vocabulary), w).alias("hits"), F.size(w).alias("n")))
    return F.filter(found, lambda b: F.size(b["hits"]) >= least)


def frequencies(docs: DataFrame, templates: dict[str, str]) -> dict[str, int]:
    """Documents of the table that hold each token of the templates; as many rows as tokens."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    held = docs.select(F.explode(F.array_intersect(_split(F.col("text")), _literal(vocabulary))).alias("token"))
    counted = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches."""
    frequency = frequencies(docs, templates)
    order = sorted(frequency, key=lambda w: (frequency[w], w))
    place = {w: i for i, w in enumerate(order)}
    ordered = {label: sorted(set(t.split()), key=place.__getitem__) for label, t in templates.items()}
    needed = {label: math.ceil(threshold * len(t) - 1e-9) for label, t in ordered.items()}

    def shares(label: str, block: Column) -> Column:
        t, least = ordered[label], needed[label]
        common = F.array_intersect(_literal(t[: len(t) - least + 1]), block["hits"])
        first = F.element_at(common, 1)
        i, j = F.array_position(_literal(t), first), F.array_position(block["hits"], first)  # from 1
        passes = (F.size(common) > 0) & (block["n"] >= least) & (1 + F.least(F.lit(len(t)) - i, block["n"] - j) >= least)
        shared = F.size(F.array_intersect(_literal(t), block["hits"]))
        return F.when(passes & (shared >= least), shared / F.lit(float(len(t))))

    def places(words: Column, phrase: list[str]) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.slice(words, i + 1, len(phrase)) == _literal(phrase))

    text = F.coalesce("text", F.lit(""))
    pattern = {p: "(?i)" + _GAP.join([w + _BEFORE % w if i == 0 else w for i, w in enumerate(p.split())]) + _AFTER for p in phrases}
    counts = [F.regexp_count(text, F.lit(x)) for x in pattern.values()]
    base = docs.select("doc_id", text.alias("text"), _split(text).alias("words"), *(c.cast("long").alias(f"c{i}") for i, c in enumerate(counts)))
    n_base = sum((F.col(f"c{i}") for i in range(len(counts))), F.lit(0).cast("long"))
    prefixes = sorted({w for label, t in ordered.items() for w in t[: len(t) - needed[label] + 1]})
    ends = sum((F.when(F.element_at("words", i) == "", 1).otherwise(0) for i in (1, -1)), F.lit(0))
    base = base.withColumn("n_base", n_base).withColumn("n_words", F.greatest(F.size("words") - ends, F.lit(0)).cast("long"))
    base = base.withColumn("lines", F.when(F.arrays_overlap("words", _literal(prefixes)), _lines(F.col("text"), prefixes)).otherwise(_literal([])))
    base = base.withColumn("blocks", _blocks(F.col("lines"), order, min(needed.values())))
    best = {label: F.array_max(F.transform("blocks", partial(shares, label))) for label in ordered}
    # the words go through a lambda variable, else they would be taken from the text again for each place
    found = F.transform(F.array(_words(F.col("text"))), lambda w: F.flatten(F.array(*(places(w, p.split()) for p in phrases))))
    starts = F.when(F.col("n_base") > 0, F.array_sort(F.element_at(found, 1)))
    base = base.select("doc_id", "n_words", "n_base", *(f"c{i}" for i in range(len(counts))), starts.alias("starts"), *(b.alias(f"t{i}") for i, b in enumerate(best.values())))
    base_labels = [F.when(F.col(f"c{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]
    method = [F.when(F.col(f"t{i}").isNotNull(), F.lit(label)) for i, label in enumerate(best)]
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*xs)))), ",")
    return base.select(
        "doc_id",
        "n_words",
        "n_base",
        F.element_at("starts", 1).cast("long").alias("first_word"),
        F.element_at("starts", -1).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(base_labels + method).alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), *(F.coalesce(F.col(f"t{i}"), F.lit(0.0)) for i in range(len(best)))).alias("score"),
    )


def license_sql(threshold: float = THRESHOLD) -> str:
    """Every line against every template, without filters."""
    words = "regexp_extract_all(translate(coalesce({}, ''), '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    sets = {label: sorted(set(t.split())) for label, t in TEMPLATES.items()}
    places = " || ".join(f"[{{'at': i, 'label': {label!r}}} for i in range(len(w)) if w[i + 1:i + {len(p.split())}] = {p.split()!r}]" for p, label in PHRASES.items())
    shares = ", ".join(f"list_max([len(list_intersect(b, {t!r})) / {len(t)}.0 for b in blocks])" for t in sets.values())
    names = ", ".join(map(repr, sets))
    return f"""
with d as (select doc_id, {words.format("text")} as w, [list_distinct({words.format("x")}) for x in string_split(coalesce(text, ''), chr(10))] as blocks from documents),
e as (select doc_id, len(w) as n, {places} as places, [{names}] as names, [{shares}] as shares from d),
f as (select *, [names[i] for i in range(1, len(names) + 1) if shares[i] >= {threshold} - 1e-9] as more,
  list_max([x for x in shares if x >= {threshold} - 1e-9]) as best from e)
select doc_id, n::bigint as n_words, len(places)::bigint as n_base, list_min([p.at for p in places])::bigint as first_word, list_max([p.at for p in places])::bigint as last_word,
  array_to_string(list_sort(list_distinct([p.label for p in places])), ',') as base_labels,
  array_to_string(list_sort(list_distinct([p.label for p in places] || more)), ',') as labels,
  greatest(case when len(places) > 0 then 1.0 else 0.0 end, coalesce(best, 0.0))::double as score
from f"""
