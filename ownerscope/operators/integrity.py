"""Feed integrity: rule checks, anomaly score, fingerprints, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ownerscope import dictionaries as D
from ownerscope.functions.text import any_of, contains_any, leading_number
from ownerscope.operators.running import PART, balanced, running
from ownerscope.session import computed_once


def _checks(pairs: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())


def _owner_rules(name: Column, percent: Column) -> list[tuple[str, Column]]:
    missing_pct = percent.isNull() | (percent == "")
    return [
        ("missing_name", name.isNull() | (name == "")),
        ("missing_percent", missing_pct),
        ("bad_name", ~name.rlike(D.OWNER_NAME_PATTERN)),
        ("bad_percent", ~missing_pct & ~percent.rlike(D.OWNER_PERCENT_PATTERN)),
    ]


def owner_violations(name: Column, percent: Column) -> Column:
    """Broken owner rules, in checking order."""
    return _checks(_owner_rules(name, percent))


def entity_violations(name: Column, code: Column) -> Column:
    return _checks([
        ("missing_name", name.isNull() | (name == "")),
        ("missing_jurisdiction", code.isNull() | (code == "")),
        ("bad_jurisdiction", ~code.rlike(D.JURISDICTION_PATTERN)),
    ])


def contract_violations(award_id: Column, recipient: Column, amount: Column) -> Column:
    value = leading_number(amount)
    return _checks([
        ("missing_award", award_id.isNull()), ("missing_recipient", recipient.isNull()),
        ("missing_amount", amount.isNull()),
        ("bad_award", (award_id != "") & ~award_id.rlike("(?i)" + D.AWARD_ID_PATTERN)),
        ("bad_amount", (value < 0) | (value > D.MAX_AWARD_AMOUNT)),
    ])


def unlisted_jurisdiction(code: Column) -> Column:
    """Not on the allow-list: a flag, not a failure."""
    return ~F.coalesce(F.lower(code).isin(*D.ALLOWED_JURISDICTIONS), F.lit(False))


def has_injection(text: Column, low: Column | None = None) -> Column:
    """``low`` is the lower-cased text where the caller has it."""
    low = F.lower(text) if low is None else low
    return any_of([low.rlike(p) for p in D.INJECTION_PATTERNS])


def is_fake_owner(name: Column, low: Column | None = None) -> Column:
    low = F.lower(name) if low is None else low
    return F.coalesce(contains_any(low, D.FAKE_NAME_PARTS) | name.isin(*D.FAKE_NAMES), F.lit(False))


def owner_shape(depth: Column, owners: Column) -> Column:
    """Minimal shape of an ownership record; null parts make it false."""
    return F.coalesce(depth.isNotNull() & owners.isNotNull() & F.forall(
        owners, lambda o: o["name"].isNotNull() & o["percent"].isNotNull()), F.lit(False))


def off_hours(ts: Column) -> Column:
    return F.when((F.hour(ts) < 6) | (F.hour(ts) > 22), 0.1).otherwise(0.0)


def ownership_checks(owners: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Integrity verdict per ownership record (rows of owners: name, percent, seen_at).

    One aggregation on the record key: counts, the violated rules, the ownership
    total and the anomaly parts. All parts are algebraic or distinct counts, so a
    hot record combines on the map side.
    """
    # once per row: each test of an alternative would repeat the texts it reads
    json = F.to_json(F.struct("name", "percent"))
    rows = computed_once(owners, "_c", F.struct(
        leading_number(F.col("percent")).alias("pct"), F.lower(json).alias("json"), F.lower("name").alias("name"),
        any_of([F.coalesce(c, F.lit(False)) for _, c in _owner_rules(F.col("name"), F.col("percent"))]).alias("bad")))
    pct, low = F.col("_c.pct"), F.col("_c.name")
    pos = F.when(pct > 0, pct)
    agg = rows.groupBy(key, source).agg(
        F.count("*").alias("owners"), F.sum(F.col("_c.bad").cast("int")).alias("bad_owners"),
        F.max(has_injection(json, F.col("_c.json"))).alias("injection"),
        F.max(is_fake_owner(F.col("name"), low)).alias("fake"),
        F.sum(pct).alias("total_percent"), F.count(pos).alias("_n"), F.var_pop(pos).alias("variance"),
        F.countDistinct(low).alias("distinct_names"), F.max("seen_at").alias("seen_at"))
    var = F.col("variance")
    stat = F.when(F.col("_n") > 0, F.when(var > 100, 0.3).otherwise(0.0)
                  + F.when((var < 0.01) & (F.col("_n") > 3), 0.5).otherwise(0.0)).otherwise(0.0)
    dup = F.when(F.col("distinct_names") < F.col("owners"), 0.4).otherwise(0.0)
    score = F.least(F.lit(1.0), stat + dup + off_hours(F.col("seen_at")))
    out = agg.withColumn("anomaly", score)
    structural = (F.col("owners") > D.MAX_OWNERS) | (F.col("bad_owners") > 0)
    content = F.col("injection") | F.col("fake") | (F.col("total_percent") > D.MAX_OWNERSHIP_TOTAL)
    return out.withColumn("failed", structural | content).withColumn(
        "action", F.when(F.col("failed"), "reject").when(F.col("anomaly") > D.ANOMALY_QUARANTINE, "quarantine")
        .when(F.col("anomaly") > D.ANOMALY_WARN, "warn").otherwise("accept")).drop("_n")


def running_failures(checked: DataFrame, source: str, order: list[str], limit: int = 5, before: DataFrame | None = None) -> DataFrame:
    """Failures per source in arrival order; from the sixth on records are quarantined.

    ``before`` (source, _before) are failures that were counted earlier.
    """
    rows = balanced(checked, [source], order)
    out = running(rows, [source], order, F.col(PART), {"failures": F.col("failed").cast("bigint")}).drop(PART)
    if before is not None:
        earlier = before.select(F.col(source).alias("_source"), "_before")
        out = out.join(earlier, F.col(source).eqNullSafe(F.col("_source")), "left").withColumn(
            "failures", F.col("failures") + F.coalesce("_before", F.lit(0))).drop("_source", "_before")
    return out.withColumn("action", F.when(F.col("failed") & (F.col("failures") > limit), "quarantine")
                          .otherwise(F.col("action")))


def split_quarantine(checked: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): quarantined payloads are kept aside and emptied in the clean output."""
    held = F.col("action") == "quarantine"
    reason = F.when(F.col("failed"), F.lit("Multiple integrity failures detected")).otherwise(
        F.lit("Critical anomaly detected"))
    quarantined = checked.filter(held).withColumn("reason", reason)
    clean = checked.withColumn("warning", F.when(held, F.concat(F.lit("Data quarantined: "), reason)))
    for c in payload:
        kind = checked.schema[c].dataType
        empty = F.array().cast(kind) if kind.typeName() == "array" else F.lit(None).cast(kind)
        clean = clean.withColumn(c, F.when(held, empty).otherwise(F.col(c)))
    return clean, quarantined


def quarantine_stats(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count_if(F.col("action") == "quarantine").alias("quarantined"),
        F.count_if(F.col("failed")).alias("failures"),
        F.countDistinct("fingerprint").alias("fingerprints"))


def fingerprint(fields: list[Column]) -> Column:
    """First 16 hex digits of the SHA-256 of the record's shape as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16)


def ownership_fingerprint(count: Column, source: Column) -> Column:
    return fingerprint([count.alias("ownerCount"), F.lit(True).alias("hasOwnershipData"), source.alias("source")])


def new_fingerprints(prints: DataFrame, seen: DataFrame) -> DataFrame:
    """Prints per source that were not seen before."""
    return prints.select("source", "fingerprint").distinct().join(seen, ["source", "fingerprint"], "left_anti")


def baselines(checked: DataFrame, size: Column) -> DataFrame:
    """Mean owner count and record size per source over unsuspicious records."""
    return checked.filter(F.col("anomaly") < 0.3).groupBy("source").agg(
        F.count("*").alias("samples"), F.avg("owners").alias("avg_owners"), F.avg(size).alias("avg_size"))


def anomaly_counter(flags: DataFrame, limit: int = 5) -> DataFrame:
    """Flags per (source, type); suspicious once a flag finds more than ``limit`` before it."""
    return flags.groupBy("source", "type").agg(F.count("*").alias("flags")).withColumn(
        "suspicious", F.col("flags") - 1 > limit)


def symbol_conflicts(symbols: DataFrame) -> DataFrame:
    """Companies whose sources disagree on the symbol.

    One symbol per (company, source) first, so a company has at most as many rows
    as there are sources when they meet.
    """
    one = symbols.filter(F.col("symbol") != "").groupBy("company_id", "source").agg(
        F.max_by("symbol", "ord").alias("symbol"))
    per = one.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("source", "symbol"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(
        F.filter("s", lambda b, j: (j > i) & (a["symbol"] != b["symbol"])),
        lambda b: F.struct(a["source"].alias("source_a"), b["source"].alias("source_b"),
                           a["symbol"].alias("symbol_a"), b["symbol"].alias("symbol_b")))))
    return per.select("company_id", F.explode(pairs).alias("p")).select("company_id", "p.*")
