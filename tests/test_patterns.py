"""Patterns in Java's form, gates and offsets of mentions against plain Python."""

import re
import string

from pyspark.sql import functions as F

from ownerscope import dictionaries as D
from ownerscope.functions import text as T
from ownerscope.operators import mentions as M

TEXTS = [
    "Apple Inc. and xApple Inc, A's revenue, BB's  stock; the CEO of Big Corp's sales", "É Acme Co., Ltd Ünited Group Inc 5 Star LLC_ LLC",
    "it's " + "Long " * 30 + "Name's revenue $ABC $ABCDEF NYSE: ibm (nasdaq:AAPL)", "JPM C XC C_ KK Kaisha KK Foo-Bar AS A/S", "", " x 　 y  z \t",
    "a-B Holdings Corp" + " quite common words" * 50 + " were acquired by Tail Partners LP", "Inc Co LLC " * 20,
]


def test_matches_and_offsets_equal_a_plain_search(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, raw string").withColumn("t", T.sanitize_nlp(F.col("raw")))
    columns, plain = [], []
    for name, (_, _, patterns) in D.MENTION_FAMILIES.items():
        for flags, pattern, parts, ending in patterns:
            gate = M.may_match(F.col("t"), F.lower("t"), flags, parts, ending)
            columns.append(M.match_positions(F.col("t"), T.regex(pattern, flags), gate).alias(f"c{len(columns)}"))
            plain.append(re.compile(pattern, re.ASCII | (re.IGNORECASE if flags else 0)))
    for row in df.select("t", *columns).collect():
        for n, p in enumerate(plain):
            assert [tuple(h) for h in row[f"c{n}"]] == [(m[1], m.start()) for m in p.finditer(row["t"])], (row["t"], p.pattern)


def test_white_space_collapses_to_single_spaces(spark):
    texts = ["", " ", "a b", "a  b", "a b", "   a 　﻿b\t", "é é   ü", "a b c d", "\n", "a \n"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [r[0] for r in df.select(T.collapse(F.col("t"))).collect()]
    assert got == [re.sub(f"[{T.SPACES}]+", " ", t).strip(" ") for t in texts] + [None]


def test_first_characters_only_where_they_are_plain():
    head = lambda p: T.regex(p).split("(?<!\\w)")[0]
    assert head(r"\b([A-Z]{1,5})\b") == f"(?=[{string.ascii_uppercase}])"
    assert head(r"\b(?:Inc|corp)\b") == "(?=[Ic])"
    for p in (r"\b([A-Z]{1,5}|foo)\b", r"\b(?:Inc|corp)?x", r"\b([A-Z]?x)", r"\b(a|b)c|d", r"\b(a?b|c)", r"\b([A-Z][a-z]+|foo)\b", r"\b(a*b)"):
        assert head(p) == "", p


def test_gates_look_for_rare_ends_first(spark):
    assert M.rare_end(" Inc") == "Inc" and M.rare_end(" stock") == "stock" and M.rare_end("acquired ") == "quired "
    row = spark.sql("select 'we stock up. Acme Inc' as t").select(
        M.holds(F.col("t"), " stock"), M.holds(F.col("t"), " Inc"), M.holds(F.col("t"), "acquired "), M.holds(F.lit("Income"), " Inc")).first()
    assert list(row) == [True, True, False, False]
