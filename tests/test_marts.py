"""Enrichment marts."""

from ownerscope.operators import marts as R


def test_contract_amounts_sum_exactly(spark):
    agency = "DEPARTMENT OF ENERGY"
    rows = [(1, agency, "A", 0.1)] * 10 + [(2, agency, "A", None), (3, agency, "A", float("inf")), (3, agency, "B", 1.0),
                                           (4, agency, "A", 1e300), (4, agency, "B", 0.25), (5, agency, "A", 1e-9), (5, None, "B", 2.0)]
    df = spark.createDataFrame(rows, "company long, agency string, award_type string, amount double").selectExpr("*", "'' as description").coalesce(1)
    got = {r["company"]: (r["total_value"], r["agencies"]) for r in R.gov_dependency(df, "company").collect()}
    assert got[1] == (1.0, {agency: 1.0})  # the doubles, added one by one, give 0.9999999999999999
    assert got[2] == (None, {agency: None}) and got[3] == (float("inf"), {agency: float("inf")}) and got[4] == (1e300, {agency: 1e300})
    assert got[5] == (2.000000001, {agency: 1e-9, "Unknown": 2.0})
