"""Licence scan by a positional index of rare tokens, in DataFrame functions alone.

Templates are word sequences of licence texts and notices. Their postings give the places of
its words of highest IDF (counted over all documents): VOTES places more than a text can get
wrong and still reach SIMILARITY, so at every start worth comparing that many agree. In a document that
holds a template's mandatory key phrase these words are looked up: each occurrence less each
posting's place is where the template would start, and the postings are intersected by those
starts. Where enough of them meet, the template is compared word by word, and its best share
counts. Everything is row by row but for the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.llm.common import ascii_lower, computed, texts
from contactmine.llm.literals import literal

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIMILARITY = 0.6
VOTES = 3
# The phrases that count as places, and the label of each.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Label, mandatory key phrase, words of the notice or licence text.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "in compliance with the license", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc0", "cc0 1 0", "to the extent possible under law waived all copyright under cc0 1 0 universal"),
]
WORDS = sorted({w for _, _, text in TEMPLATES for w in text.split()})
TEMPLATE_TYPE = "array<struct<label:string,phrase:string,words:array<string>,places:map<string,array<int>>,votes:int>>"


def _postings(weights: dict[str, float]) -> list[dict]:
    made = []
    for label, phrase, text in TEMPLATES:
        words = text.split()
        needed = next(n for n in range(len(words) + 1) if n / len(words) >= SIMILARITY)
        rarest = sorted(range(len(words)), key=lambda i: (-weights[words[i]], words[i], i))[:len(words) - needed + min(VOTES, needed)]
        places = {words[i]: sorted(j for j in rarest if words[j] == words[i]) for i in rarest}
        made.append({"label": label, "phrase": phrase, "words": words, "places": places, "votes": min(VOTES, needed)})
    return made


def _spaced(text: Column) -> Column:
    """The words between single spaces, with one at either end; one space if there is none."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), SEPARATORS, " ")


def _count(text: Column, char: str = " ") -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _base(df: DataFrame) -> DataFrame:
    """Places of the phrases. Two never overlap, for none starts with another's last word."""
    found = "(?<= )(?:" + "|".join(p for p, _ in PHRASES) + ")(?= )"
    spaced = F.col("spaced")
    any_phrase = spaced.contains(" license ")
    first = F.length(F.split(spaced, found, 2)[0])
    last = F.length(F.regexp_replace(spaced, f"(?s)^.*{found}", ""))
    with_counts = df.withColumn("n_words", (_count(spaced) - 1).cast("bigint")).withColumn(
        "n_base", F.when(any_phrase, F.regexp_count(spaced, F.lit(found))).otherwise(0).cast("bigint")
    )
    hit = F.col("n_base") > 0
    # what follows the last phrase starts with the space before each of its words
    before = _count(F.substring(spaced, F.lit(1), first)) - 1
    after = _count(F.substring(spaced, -last, last)) - 1
    at = F.regexp_extract(spaced, f"(?s)^.*{found}", 0)
    length = F.when(at.endswith(" general public license"), 3).otherwise(2)
    labels = F.filter(
        F.array(*(F.when(spaced.contains(f" {p} "), F.lit(name)) for p, name in PHRASES)), lambda x: x.isNotNull()
    )
    return with_counts.select(
        "*", F.when(hit, before).cast("bigint").alias("first_word"),
        F.when(hit, F.col("n_words") - after - length).cast("bigint").alias("last_word"),
        F.when(hit, labels).otherwise(F.array().cast("array<string>")).alias("base"),
    )


def _weights(df: DataFrame) -> dict[str, float]:
    """IDF of the licence words: one row per word comes to the driver, they are fixed values."""
    words = F.array_intersect(F.split("spaced", " "), F.lit(WORDS))
    counts = df.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    found = {r.w: r["count"] for r in counts}
    documents = found.pop("", 0)
    return {w: math.log((1 + documents) / (1 + found.get(w, 0))) for w in WORDS}


def _scored(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``matched``: label and share of words of each template that aligns well enough."""
    postings = _postings(weights)
    templates = literal(postings, TEMPLATE_TYPE)
    rare = sorted({w for t in postings for w in t["places"]})
    phrases = sorted({p for _, p, _ in TEMPLATES})
    guard = F.lit(False)
    for phrase in phrases:
        guard = guard | F.col("spaced").contains(f" {phrase} ")
    words = F.split(F.substring("spaced", F.lit(2), F.length("spaced") - 2), " ")
    placed = F.transform(F.col("words"), lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    hits = F.filter(placed, lambda x: x.w.isin(rare))

    def starts(t: Column) -> Column:
        at = F.filter(F.col("hits"), lambda h: F.map_contains_key(t.places, h.w))
        each = F.array_sort(F.flatten(F.transform(at, lambda h: F.transform(t.places[h.w], lambda p: h.i - p))))
        # a start that enough postings name stands so often in a row
        agreed = F.transform(F.array(each), lambda e: F.filter(e, lambda s, i: F.get(e, i + t.votes - 1) == s))
        return F.array_distinct(F.flatten(agreed))

    def share(t: Column, start: Column) -> Column:
        same = F.filter(t.words, lambda w, j: F.get(F.col("words"), start + j) == w)
        return F.size(same) / F.size(t.words)

    def best(t: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(starts(t), lambda s: share(t, s))), F.lit(0.0))

    aligned = F.transform(templates, lambda t: F.struct(
        t.label.alias("label"), F.when(F.col("spaced").contains(F.concat(F.lit(" "), t.phrase, F.lit(" "))), best(t)).otherwise(0.0).alias("share"),
    ))
    some = F.col("words").isNotNull()
    df = computed(df, "words", F.when(guard, words))
    df = computed(df, "hits", F.when(some, hits))
    return computed(df, "matched", F.when(some, F.filter(aligned, lambda x: x.share >= SIMILARITY)))


def scan(docs: DataFrame) -> DataFrame:
    """``[doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score]`` of every row.

    ``labels`` has the base labels and those of the templates found; ``score`` is the largest
    share of a template's words that stand in its order anywhere in the text, 0 without any. Null and empty texts
    have no words; rows that repeat, or lack an id, are each scanned. An empty table gives
    an empty result; other columns are ignored."""
    rows = computed(texts(docs), "spaced", _spaced(ascii_lower(F.col("text")))).drop("text")
    scored = _scored(_base(rows), _weights(rows))
    more = F.coalesce(F.transform("matched", lambda x: x.label), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("matched", lambda x: x.share)), F.lit(0.0))
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    return scored.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", more)).alias("labels"), best.alias("score"),
    )
