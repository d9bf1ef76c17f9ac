"""Landed provider feeds (JSON text) flattened to rows, and knowledge-base files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ownerscope.functions.text import agency_weight, half_up, is_classified, is_offshore, leading_number, registry_match
from ownerscope.operators.kb import COMPANY_SCHEMA, with_normalized

OWNERSHIP = ("quoteSummary struct<result: array<struct<institutionOwnership: struct<ownershipList: "
             "array<struct<organization: string, pctHeld: struct<raw: double>, position: struct<raw: bigint>>>>>>>")
REGISTRY = ("results struct<companies: array<struct<company: struct<name: string, jurisdiction_code: string, "
            "jurisdiction_name: string, company_number: string, incorporation_date: string, company_type: string, "
            "current_status: string, registered_address_in_full: string>>>, total_count: bigint>")
CONTRACTS = ("results array<struct<`Award ID`: string, `Recipient Name`: string, `Award Amount`: string, "
             "`Award Type`: string, `Awarding Agency`: string, `Awarding Sub Agency`: string, "
             "`Period of Performance Start Date`: string, `Period of Performance Current End Date`: string, "
             "Description: string>>")
SERIES = "series_id string, observations array<struct<date: string, value: string>>"
NEWS = ("articles array<struct<title: string, description: string, url: string, "
        "source: struct<id: string, name: string>, publishedAt: string>>, totalResults bigint")


def read_landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON documents, one per line, read with a declared schema."""
    return spark.read.schema(schema).json(path)


def flatten_ownership(raw: DataFrame, keys: list[str], payload: str = "payload", first: int | None = None) -> DataFrame:
    """Owners of each document: the list or its first entries, then incomplete ones drop."""
    doc = F.from_json(payload, OWNERSHIP)
    listed = F.try_element_at(doc["quoteSummary"]["result"], F.lit(1))["institutionOwnership"]["ownershipList"]
    rows = raw.select(*keys, F.posexplode(listed if first is None else F.slice(listed, 1, first)).alias("ord", "o"))
    complete = (F.col("o.organization") != "") & F.col("o.pctHeld").isNotNull()
    return rows.filter(complete).select(
        *keys, "ord", F.col("o.organization").alias("name"),
        (half_up(F.col("o.pctHeld.raw") * 100 * 100) / 100).alias("percent"),
        F.coalesce("o.position.raw", F.lit(0)).cast("bigint").alias("shares"))


def flatten_registry(raw: DataFrame, keys: list[str], term: str, payload: str = "payload", first: int | None = None) -> DataFrame:
    """Registry entities of each search document with offshore flag and match score."""
    companies = F.from_json(payload, REGISTRY)["results"]["companies"]
    listed = companies if first is None else F.slice(companies, 1, first)
    rows = raw.select(*keys, term, F.posexplode(listed).alias("ord", "e")).select(*keys, term, "ord", "e.company.*")
    return rows.select(
        *keys, "ord", "name", F.col("jurisdiction_code").alias("jurisdiction"),
        F.col("jurisdiction_name").alias("jurisdiction_label"), "company_number",
        F.col("incorporation_date").try_cast("date").alias("incorporation_date"), "company_type",
        F.col("current_status").alias("status"), F.col("registered_address_in_full").alias("address"),
        is_offshore(F.col("jurisdiction_code")).alias("is_offshore"),
        registry_match(F.col(term), F.col("name")).alias("confidence"))


def flatten_contracts(raw: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    rows = raw.select(*keys, F.posexplode(F.from_json(payload, CONTRACTS)["results"]).alias("ord", "c"))
    f = lambda name: F.col("c")[name]
    return rows.select(
        *keys, "ord", f("Award ID").alias("award_id"), f("Recipient Name").alias("recipient_name"),
        leading_number(f("Award Amount")).alias("amount"), f("Award Type").alias("award_type"),
        f("Awarding Agency").alias("agency"), f("Awarding Sub Agency").alias("sub_agency"),
        f("Period of Performance Start Date").try_cast("date").alias("start_date"),
        f("Period of Performance Current End Date").try_cast("date").alias("end_date"),
        F.coalesce(F.nullif(f("Description"), F.lit("")), F.lit("No description available")).alias("description"),
        is_classified(f("Description")).alias("is_classified"), agency_weight(f("Awarding Agency")).alias("agency_risk"))


def flatten_series(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Observations in long form; '.' becomes null."""
    doc = F.from_json(payload, SERIES)
    rows = raw.select(doc["series_id"].alias("series_id"), F.explode(doc["observations"]).alias("o"))
    return rows.select("series_id", F.col("o.date").try_cast("date").alias("date"), F.col("o.value").try_cast("double").alias("value"))


def flatten_news(raw: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    rows = raw.select(*keys, F.posexplode(F.from_json(payload, NEWS)["articles"]).alias("ord", "a"))
    return rows.select(*keys, "ord", "a.title", "a.description", "a.url", F.col("a.source.id").alias("source_id"),
                       F.col("a.source.name").alias("source_name"), F.col("a.publishedAt").alias("published_at"))


# --- knowledge-base files ------------------------------------------------------
def write_kb(kb: DataFrame, path: str) -> None:
    """Companies as JSON lines, one file per partition."""
    kb.select("ord", "id", "name", "aliases", "ticker", "exchange", "industry", "type", "subsidiaries",
              "previous_names").write.mode("overwrite").json(path)


def write_kb_export(kb: DataFrame, path: str, export_date, version: str = "1.0") -> None:
    """An export of a knowledge base of any size: ``companies`` as JSON lines, and ``metadata`` with their count."""
    write_kb(kb, f"{path}/companies")
    kb.agg(F.lit(version).alias("version"), F.lit(export_date).alias("exportDate"), F.count("*").alias("count")).write.mode(
        "overwrite").json(f"{path}/metadata")


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    return with_normalized(spark.read.schema("ord bigint, " + COMPANY_SCHEMA).json(path))


def read_kb_export(spark: SparkSession, path: str) -> DataFrame:
    """A single exported document {companies: [...], metadata: {...}}."""
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("companies").alias("ord", "c")).select("ord", "c.*")
    for c, kind in (("ticker", "string"), ("exchange", "string"), ("industry", "string"), ("type", "string"),
                    ("subsidiaries", "array<string>"), ("previousNames", "array<string>")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    return with_normalized(rows.select("ord", "id", "name", "aliases", "ticker", "exchange", "industry", "type",
                                       "subsidiaries", F.col("previousNames").alias("previous_names")))
