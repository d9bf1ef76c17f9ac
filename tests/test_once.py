"""Work per row is planned once."""

from pyspark.sql import functions as F

from ownerscope.operators import integrity as I
from ownerscope.operators import scoring as C


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filter_on_the_score_repeats_no_factor(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.1), (None, None)], "text string, x double")
    factors = {k: F.col("x") * F.length(F.sha2("text", 256)) / 64 for k in C.FACTORS}
    scored = C.score_entities(df, factors).filter(F.col("score") >= 0.5)
    assert optimized(scored.select("score")).count("sha2(") <= len(C.FACTORS)
    assert [(r["text"], round(r["score"], 9), r["level"]) for r in scored.collect()] == [("a", 0.9, "high")]


def test_integrity_checks_read_a_row_once(spark):
    rows = [(1, "A <Script> b", "5%"), (1, "a <script> B", "x"), (2, None, None), (2, "", ""), (3, "Test Fund", "7.5%"), (3, "Fine", "8%")]
    df = spark.createDataFrame(rows, "company_id int, name string, percent string").selectExpr(
        "*", "'s' as source", "timestamp '2024-01-01 12:00:00' as seen_at")
    checked = I.ownership_checks(df, "company_id")
    plan = optimized(checked)
    assert plan.count("lower(") <= 3, plan  # of the name and of the row as JSON
    got = {r["company_id"]: (r["owners"], r["bad_owners"], r["injection"], r["fake"], r["total_percent"], r["distinct_names"]) for r in checked.collect()}
    assert got[1] == (2, 2, True, False, 5.0, 1) and got[2][:2] == (2, 2) and got[2][4:] == (0.0, 1)
    assert got[3] == (2, 0, False, True, 15.5, 2)
