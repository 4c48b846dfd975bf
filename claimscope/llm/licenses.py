"""Licence scan by a positional index of rare tokens, in DataFrame functions alone.

Templates are short passages: the phrases that name a licence, and the notices that grant one. Each is indexed under its
words of highest inverse document frequency, which is counted over all documents, with their places in the template.
A document's words that stand in this index (its rarest licence words) are looked up: a word at place i that the template
has at place r puts the template's start at i - r. There the postings of the template's other rare words are intersected by
relative position, within the template's slack, and weighed by their frequencies; a start is a find if enough of that weight
is there and all of the template's mandatory key phrases stand in their places, word for word.

A phrase is its own key phrase and has no slack, and each of its occurrences holds its rarest word, so its finds are exactly
the places where its words stand consecutively. A notice is looked for around either of its two rarest words.

A document's words stay in its row: the scan has no join and no shuffle. Only the frequencies of the templates' words, a
fixed list, are aggregated, and collected.

Nulls: a null text is empty (no words, no labels, score 0); a null ``doc_id`` is passed through. Each row is judged by
itself, so repeated rows get equal results; an empty table gives no rows. Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import text_or_empty

#: Words that a template is indexed under, those whose places start a look-up, and the share of their weight that a find needs.
RARE, ANCHORS, LEAST_SHARE = 6, 2, 0.6

#: Phrases (fixed values), found exactly: label, words.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Notices: label, passage as words, mandatory key phrases in it.
NOTICES = (
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "provided that the following conditions are met")),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy", "covered by this license")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it", "gnu general public license")),
    ("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge to any person obtaining a copy of this software", "without restriction")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", ("in no event will the authors be held liable",)),
)
#: How far a notice's words may be from their places.
SLACK = 2

#: What stands between words: ASCII but for digits and lower-case letters (texts are lower-cased before).
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ENDS = "".join(c for c in map(chr, range(128)) if re.fullmatch(_BETWEEN, c))


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]  # place in the template, words
    slack: int
    base: bool


def templates() -> list[Template]:
    """Phrases first, then notices."""
    out = [Template(label, w, ((0, w),), 0, True) for label, w in ((label, tuple(x.split())) for label, x in PHRASES)]
    for label, passage, keys in NOTICES:
        words = tuple(passage.split())
        own = [tuple(k.split()) for k in keys]
        at = [next(i for i in range(len(words)) if words[i : i + len(k)] == k) for k in own]
        out.append(Template(label, words, tuple(zip(at, own, strict=True)), SLACK, False))
    return out


def words_of(text: Column) -> Column:
    """The words of a text in order; letters from A to Z are lower-cased."""
    # other letters change too, none of them into a letter or digit of a template and none into what stands between words
    own = F.btrim(F.lower(text), F.lit(_ENDS))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, _BETWEEN, -1))


def frequencies(words: DataFrame, of: list[Template]) -> tuple[int, dict[str, int]]:
    """(documents, documents that hold each of the templates' words). ``words``: words."""
    vocabulary = sorted({w for t in of for w in t.words})
    own = words.select(F.explode(F.array_append(F.array_distinct(F.filter("words", lambda w: w.isin(*vocabulary))), F.lit(""))).alias("word"))  # an empty word a document
    found = {r["word"]: r["n"] for r in own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.get("", 0), {w: found.get(w, 0) for w in vocabulary}


def rare_words(template: Template, df: dict[str, int]) -> list[tuple[str, int]]:
    """The template's words of highest inverse document frequency with their first places, rarest first."""
    first = {w: k for k, w in reversed(list(enumerate(template.words)))}
    return sorted(first.items(), key=lambda x: (df[x[0]], x[1]))[:RARE]


def idf(documents: int, df: int) -> float:
    return math.log(1 + documents / (1 + df))


def _constant(schema: str, value: list) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _stands(words: Column, at: Column, phrase: Column) -> Column:
    """Whether a phrase (array of words) stands at a place."""
    return F.forall(F.transform(phrase, lambda w, j: F.get(words, at + j).eqNullSafe(w)), lambda x: x)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, found: array of (label, base, start, share) of every document, without order."""
    of = templates()
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(text_or_empty()).alias("words"))
    documents, df = frequencies(words, of)
    rare = [rare_words(t, df) for t in of]
    anchors = [(w, r, k) for k, (t, own) in enumerate(zip(of, rare, strict=True)) for w, r in own[: 1 if t.base else ANCHORS]]
    # one constant each: the optimizer folds them before the scan
    index = _constant("array<struct<word:string,place:int,t:int>>", [{"word": w, "place": r, "t": k} for w, r, k in anchors])
    weights = [[(w, r, idf(documents, df[w])) for w, r in own] for own in rare]
    table = _constant(
        "array<struct<label:string,base:boolean,slack:int,total:double,rare:array<struct<word:string,place:int,weight:double>>,keys:array<struct<place:int,words:array<string>>>>>",
        [
            {
                "label": t.label, "base": t.base, "slack": t.slack, "total": sum(x for _, _, x in own), "rare": [{"word": w, "place": r, "weight": x} for w, r, x in own],
                "keys": [{"place": p, "words": k} for p, k in t.keys],
            }
            for t, own in zip(of, weights, strict=True)
        ],
    )
    looked_up = sorted({w for w, _, _ in anchors})
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(*looked_up), i)))
    hit = words.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", hits.alias("hits"))
    postings = lambda i: F.filter(index, lambda p: p["word"] == F.get("words", i))
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.transform(postings(i), lambda p: _struct(t=p["t"], start=i - p["place"])))))
    near = lambda slack, at, test: F.exists(F.sequence(at - slack, at + slack), test)

    def weighed(c: Column) -> Column:
        t = F.get(table, c["t"])
        held = lambda r: near(t["slack"], c["start"] + r["place"], lambda at: F.get("words", at).eqNullSafe(r["word"]))
        share = F.aggregate(t["rare"], F.lit(0.0), lambda total, r: total + F.when(held(r), r["weight"]).otherwise(0.0)) / t["total"]
        keyed = F.forall(t["keys"], lambda k: near(t["slack"], c["start"] + k["place"], lambda at: _stands(F.col("words"), at, k["words"])))
        return _struct(label=t["label"], base=t["base"], start=c["start"].cast("long"), share=F.round(share, 6), keyed=keyed)

    candidates = hit.select("doc_id", "n_words", F.transform(starts, weighed).alias("c"))
    found = F.filter("c", lambda x: x["keyed"] & (x["share"] >= LEAST_SHARE))
    return candidates.select("doc_id", "n_words", F.transform(found, lambda x: _struct(label=x["label"], base=x["base"], start=x["start"], share=x["share"])).alias("found"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: the finds of each document in figures."""
    own = find(docs).withColumn("base", F.filter("found", lambda x: x["base"]))
    starts = F.transform("base", lambda x: x["start"])
    named = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return own.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named("base").alias("base_labels"), named("found").alias("labels"), score.alias("score"),
    )


def _oracle() -> str:
    of = templates()
    quoted = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    first = [(k, w, p) for k, t in enumerate(of) for w, p in {w: p for p, w in reversed(list(enumerate(t.words)))}.items()]
    keyed = [(k, n, p, j, w, len(key)) for k, t in enumerate(of) for n, (p, key) in enumerate(t.keys) for j, w in enumerate(key)]
    return rf"""
WITH templates(t, label, base, slack, n_keys) AS (VALUES {quoted((k, t.label, t.base, t.slack, len(t.keys)) for k, t in enumerate(of))}),
tokens(t, word, place) AS (VALUES {quoted(first)}),
keys(t, k, place, j, word, len) AS (VALUES {quoted(keyed)}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
every AS (SELECT r, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM docs),
w AS (SELECT * FROM every WHERE word IN (SELECT word FROM tokens)),
df AS (SELECT word, count(DISTINCT r) AS df FROM w GROUP BY word),
n AS (SELECT count(*) AS n FROM docs),
ranked AS (SELECT t, tokens.word, place, ln(1 + n / (1.0 + coalesce(df, 0))) AS weight, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), place) AS rank FROM tokens LEFT JOIN df USING (word), n),
rare AS (SELECT * FROM ranked WHERE rank <= {RARE}),
totals AS (SELECT t, sum(weight) AS total FROM rare GROUP BY t),
starts AS (SELECT DISTINCT r, t, pos - place AS start FROM rare JOIN templates USING (t) JOIN w USING (word) WHERE rank <= CASE WHEN base THEN 1 ELSE {ANCHORS} END),
held AS (SELECT DISTINCT s.r, s.t, s.start, rare.word, weight FROM starts s JOIN templates USING (t) JOIN rare ON rare.t = s.t JOIN w ON w.r = s.r AND w.word = rare.word AND w.pos BETWEEN s.start + place - slack AND s.start + place + slack),
shares AS (SELECT h.r, h.t, start, round(sum(weight) / any_value(total), 6) AS share FROM held h JOIN totals USING (t) GROUP BY h.r, h.t, start),
placed AS (SELECT s.r, s.t, s.start, k, w.pos - j AS at, count(*) AS words, any_value(len) AS len FROM starts s JOIN templates USING (t) JOIN keys ON keys.t = s.t JOIN w ON w.r = s.r AND w.word = keys.word
  AND w.pos - j BETWEEN s.start + place - slack AND s.start + place + slack GROUP BY ALL),
keyed AS (SELECT r, t, start, count(DISTINCT k) AS k FROM placed WHERE words = len GROUP BY ALL),
found AS (SELECT r, label, base, start, share FROM shares JOIN keyed USING (r, t, start) JOIN templates USING (t) WHERE k = n_keys AND share >= {LEAST_SHARE}),
summed AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN summed USING (r)"""


ORACLE = _oracle()
