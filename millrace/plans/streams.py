"""Structured Streaming forms of the log operators, run over what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs
from .registry import query


@query("select event_type, count(distinct event_id)::bigint as events from memory_lifecycle_events group by event_type")
def x02_stream_dedupe(spark: SparkSession, base: str) -> DataFrame:
    """Lifecycle events delivered once each, counted by type."""
    events = jobs.table_stream(spark, base, "memory_lifecycle_events")
    return jobs.run_to_table(jobs.first_deliveries(events, "event_id", "created_at", "90 days")).groupBy("event_type").agg(F.count("*").alias("events"))


@query("select project_id, memory_key, count(*)::bigint as seen, arg_max(memory_id, (created_at, memory_id)) as newest from memories where memory_key is not null group by 1, 2")
def x03_keyed_fold(spark: SparkSession, base: str) -> DataFrame:
    """For each key the newest record and the number seen, kept as state."""
    records = jobs.table_stream(spark, base, "memories").where("memory_key is not null")
    return jobs.newest_by_key(records, ["project_id", "memory_key"], "created_at", "memory_id")


@query("select date_trunc('hour', ts) as hour, event_type, count(*)::bigint as n, round(sum(value), 6) as total from events group by 1, 2")
def ext_windowed(spark: SparkSession, base: str) -> DataFrame:
    """Events by hour and type with a watermark (extension)."""
    events = jobs.table_stream(spark, base, "events")
    out = jobs.run_to_table(jobs.hourly(events, "ts", "1 hour"), mode="complete")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


@query("select project_id, path, max(content_hash) as hash from (select project_id, path, sha256(content) as content_hash, row_number() over (partition by project_id, path order by scanned_at desc, draft_id desc) as r from chunk_drafts) where r = 1 group by 1, 2")
def x08_incremental_index(spark: SparkSession, base: str) -> DataFrame:
    """The index after all file changes, written micro-batch by micro-batch into versions."""
    changes = jobs.table_stream(spark, base, "chunk_drafts").select("project_id", "path", F.sha2("content", 256).alias("hash"), "scanned_at", "draft_id")
    return jobs.incremental_index(changes, ["project_id", "path"], ["scanned_at", "draft_id"]).select("project_id", "path", "hash")
