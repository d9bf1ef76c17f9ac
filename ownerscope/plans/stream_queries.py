"""Streams over whole tables, run to their end; their SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ownerscope.operators import monitor
from ownerscope.plans import integrity_queries, mention_queries, monitor_queries  # noqa: F401  their SQL is used again
from ownerscope.plans.registry import ORACLES, query
from ownerscope.plans.workload import VIEWS, cte, table
from ownerscope.session import materialize
from ownerscope.streaming import jobs as J, sinks


def stream_of(spark, sf: str, source: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf}/{source}.parquet"
    schema = table(spark, sf, source).schema
    return J.read_stream(spark, path, schema, 1) if sinks.is_folder(spark, path) else J.read_stream(spark, sf, schema, 1, only=f"{source}.parquet")


def streamed(spark, sf: str, name: str, source: str) -> DataFrame:
    """A view over a table that is read as a stream."""
    rows = stream_of(spark, sf, source)
    return spark.sql(VIEWS[name].replace(f"from {source}", "from {rows}"), rows=rows)


@query("streamed_mentions", ORACLES["extracted_mentions"])
def streamed_mentions(spark, sf):
    """Incremental detection over the landed texts."""
    texts = streamed(spark, sf, "v_text", "documents").withColumn("ts", F.timestamp_seconds(F.lit(1704067200)))
    found = J.stream_detections(texts)
    return sinks.run_to_table(found.drop("ts"))


@query("streamed_site_metrics", f"""{cte('v_fetch')} select source, count(*) as detections, round(avg(case when ok then 1.0::double else 0.25::double end), 6) as mean_score from v_fetch group by source""")
def streamed_site_metrics(spark, sf):
    """Detections and mean score per source while the log lands."""
    log = streamed(spark, sf, "v_fetch", "events").withColumn("score", F.when(F.col("ok"), 1.0).otherwise(0.25))
    return sinks.run_to_table(J.stream_metrics(log), "complete").withColumn("mean_score", F.round("mean_score", 6))


@query("streamed_rate_alarms", ORACLES["rate_alarms"])
def streamed_rate_alarms(spark, sf):
    """Windows with too many detections while the log lands."""
    events = stream_of(spark, sf, "events")
    out = sinks.run_to_table(monitor.rate_alarm(events.withWatermark("ts", "1 hour"), "ts", 3600, 15), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("quarantine_sink", ORACLES["quarantine_split"])
def quarantine_sink(spark, sf):
    """The split of landed records, three batches in arrival order, as a reader of the sink finds it."""
    checked = materialize(integrity_queries._checked(spark, sf))
    folder, landing = sinks.new_folder(spark, "split"), sinks.new_folder(spark, "landing")
    first, second = checked.agg(F.percentile_approx(F.unix_micros(F.col("seen_at").cast("timestamp")), [0.33, 0.66])).first()[0]
    at = F.unix_micros(F.col("seen_at").cast("timestamp"))
    for part in (at <= first, (at > first) & (at <= second), at > second):
        sinks.landed(checked.where(part).coalesce(1), landing)
    sink = sinks.SplitSink(spark, folder, checked.schema, ["owners"], order=["seen_at", "company_id"])
    sink.run(spark.readStream.schema(checked.schema).option("maxFilesPerTrigger", 1).parquet(landing))
    clean, held = sink.committed(spark, "clean"), sink.committed(spark, "quarantined")
    return clean.select("company_id", "owners").join(held.select("company_id", "reason"), "company_id", "left")
