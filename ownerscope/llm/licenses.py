"""License scans by a positional index of rare words.

Templates (phrases and notices) are word sequences. Each is indexed under its rarest words, by the documents' own word
counts: word -> (template, position). A file's words that stand in the index are looked up; postings of one template that
agree on where the template would start are intersected, and each start that has enough of them is verified word by word,
mandatory key phrases included. A base phrase is a template all of whose words are mandatory, so every place where it
stands is found from its rarest word and nothing else is.

Only DataFrame functions run here; a document's work stays in its row, so neither a common phrase nor a long text
gathers rows in a task. What is shared is the index of the fixed templates.

Defined results: null and empty texts have no words: 0 places, null first and last word, empty labels, score 0. An empty
table gives no rows; repeated rows give equal rows. Places may overlap. Only the id and text columns are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ownerscope.llm.common import lower_ascii
from ownerscope.session import computed_once

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases with their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Label, notice as it is published, mandatory key phrase of the notice.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction", "free of charge to any person"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                 "with the license", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", "with or without fee"),
    ("gpl-3", "gnu general public license version 3", "general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

RARE = 4          # rarest words of a template in the index
AGREE = 0.5       # share of a notice's index words that must agree on a start
COVER = 0.6       # share of a notice's words in place for its label


def _templates() -> list[dict]:
    out = [{"words": p.split(), "label": label, "key": p.split(), "base": True} for p, label in BASE]
    return out + [{"words": t.split(), "label": label, "key": k.split(), "base": False} for label, t, k in NOTICES]


def word_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc and its words, in order, A-Z in lower case."""
    rows = docs.select(F.col(id_col).alias("doc"), F.split(lower_ascii(F.col(text_col)), WORD_GAP).alias("w"))
    return computed_once(rows.select("doc", F.col("w").alias("_w")), "w", F.filter("_w", lambda x: x != "")).drop("_w")


def rarity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of the templates' words over all documents (one row per such word comes back)."""
    vocabulary = sorted({w for t in _templates() for w in t["words"]})
    held = F.array(*[F.lit(w) for w in vocabulary])
    rows = docs.select(F.split(lower_ascii(F.col(text_col)), WORD_GAP).alias("w"))
    found = rows.select(F.explode(F.array_intersect("w", held)).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in found.collect()}
    return {w: -math.log((counts.get(w, 0) + 1) / (max(counts.values(), default=0) + 2)) for w in vocabulary}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    idf = rarity(docs, id_col, text_col)
    templates = _templates()
    postings: dict[str, list[tuple[int, int]]] = {}
    needed = []
    for t, template in enumerate(templates):
        words = template["words"]
        rare = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:1 if template["base"] else RARE]
        needed.append(max(1, math.ceil(AGREE * len(rare))))
        for i in rare:
            postings.setdefault(words[i], []).append((t, i))
    index = F.create_map(*[x for w, found in postings.items() for x in (
        F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in found]))])
    known = F.array(*[F.array(*[F.lit(w) for w in t["words"]]) for t in templates])
    keys = F.array(*[F.lit(" " + " ".join(t["key"]) + " ") for t in templates])
    labels = F.array(*[F.lit(t["label"]) for t in templates])
    bases = F.array(*[F.lit(t["base"]) for t in templates])
    enough = F.array(*[F.lit(n) for n in needed])

    rows = word_rows(docs, id_col, text_col)
    # places of index words: (position, word)
    rows = computed_once(rows, "hits", F.filter(
        F.transform("w", lambda x, p: F.when(x.isin(list(postings)), F.struct(p.alias("p"), x.alias("x")))), lambda h: h.isNotNull()))
    # where each template would start, once for every posting that says so
    starts = F.flatten(F.transform("hits", lambda h: F.transform(
        F.element_at(index, h["x"]), lambda e: F.struct(e["t"].alias("t"), (h["p"] - e["i"]).alias("s")))))
    rows = computed_once(rows, "starts", F.when(F.size("hits") > 0, F.sort_array(starts)).otherwise(
        F.array().cast("array<struct<t:int,s:int>>")))
    # postings that agree stand side by side: the k-th and the (k + needed - 1)-th are equal at a start with enough of them
    n = F.size("starts")

    def agreeing(count: int):
        own = F.filter("starts", lambda e: F.element_at(enough, e["t"] + 1) == count)
        if count == 1:
            return own
        m = F.size(own)
        return F.when(m >= count, F.filter(F.zip_with(F.slice(own, 1, m - count + 1), F.slice(own, F.lit(count), m - count + 1),
                                                      lambda a, b: F.when(a == b, a)), lambda e: e.isNotNull())).otherwise(
            F.array().cast("array<struct<t:int,s:int>>"))

    rows = computed_once(rows, "candidates", F.when(n > 0, F.array_distinct(F.concat(*[agreeing(c) for c in sorted(set(needed))])))
                         .otherwise(F.array().cast("array<struct<t:int,s:int>>")))

    def verify(c):
        words = F.element_at(known, c["t"] + 1)
        begin = F.greatest(c["s"], F.lit(0))
        there = F.slice("w", begin + 1, F.size(words) + F.least(c["s"], F.lit(0)))
        lead = F.array_repeat(F.lit(""), F.greatest(-c["s"], F.lit(0)))
        same = F.aggregate(F.zip_with(F.concat(lead, there), words, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))),
                           F.lit(0), lambda acc, x: acc + x)
        key = F.contains(F.concat(F.lit(" "), F.array_join(there, " "), F.lit(" ")), F.element_at(keys, c["t"] + 1))
        return F.struct(c["t"].alias("t"), c["s"].alias("s"), (same / F.size(words)).alias("cover"), key.alias("key"))

    rows = computed_once(rows, "verified", F.when(F.size("candidates") > 0, F.transform("candidates", verify)).otherwise(
        F.array().cast("array<struct<t:int,s:int,cover:double,key:boolean>>")))
    base = F.filter("verified", lambda v: F.element_at(bases, v["t"] + 1) & (v["cover"] == 1.0))
    held = F.filter("verified", lambda v: v["key"] & (v["cover"] >= COVER))
    name = lambda v: F.element_at(labels, v["t"] + 1)
    rows = rows.select("doc", F.size("w").cast("long").alias("n_words"), base.alias("base"), held.alias("held"))
    places = F.transform("base", lambda v: v["s"].cast("long"))
    return rows.select(
        F.col("doc").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", name))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.transform("base", name), F.transform("held", name)))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("held", lambda v: v["cover"])), F.when(F.size("base") > 0, 1.0), F.lit(0.0)).alias("score"),
    )
