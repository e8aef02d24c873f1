"""Aggregations: counts, percentiles, rates, frequencies and first-of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieval import nearest_rank
from ..runtime import read_table
from .registry import query


def _events(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "events")


@query("select project_id, count(*)::bigint as chunks from rag_chunks group by project_id")
def a01_count_per_project(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of each project."""
    return read_table(spark, base, "rag_chunks").groupBy("project_id").agg(F.count("*").alias("chunks"))


@query("""with e as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null)
  select event_type, max(n)::bigint as samples, max(value) filter (r = round_even((n - 1) * 0.5, 0) + 1) as p50, max(value) filter (r = round_even((n - 1) * 0.95, 0) + 1) as p95, max(value) filter (r = round_even((n - 1) * 0.99, 0) + 1) as p99 from e group by event_type""")
def a08_nearest_rank(spark: SparkSession, base: str) -> DataFrame:
    """Nearest-rank percentiles of the values of each event type."""
    return nearest_rank(_events(spark, base), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "event_type")


@query("""with e as (select value, row_number() over (order by value) as r, count(*) over () as n from events where value is not null)
  select max(n)::bigint as samples, max(value) filter (r = round_even((n - 1) * 0.5, 0) + 1) as p50, max(value) filter (r = round_even((n - 1) * 0.95, 0) + 1) as p95, max(value) filter (r = round_even((n - 1) * 0.99, 0) + 1) as p99, round(avg(value), 6) as mean from e""")
def a09_latency_summary(spark: SparkSession, base: str) -> DataFrame:
    """Samples, percentiles and mean of all values."""
    e = _events(spark, base)
    return nearest_rank(e, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).crossJoin(e.agg(F.round(F.avg("value"), 6).alias("mean")))


@query("select claim_status as arm, count(*)::bigint as runs, count(*) filter (status = 'active')::bigint as passed, round(coalesce(count(*) filter (status = 'active') / nullif(count(*), 0), 0), 6) as pass_rate, round(avg(importance) filter (status = 'superseded'), 6) as mean_superseded from memories group by 1")
def a11_arms(spark: SparkSession, base: str) -> DataFrame:
    """Counts, rates and a mean that is null for an arm without rows of its kind."""
    m = read_table(spark, base, "memories").groupBy(F.col("claim_status").alias("arm"))
    passed = F.count_if(F.col("status") == "active")
    return m.agg(F.count("*").alias("runs"), passed.alias("passed"), F.round(passed / F.count("*"), 6).alias("pass_rate"), F.round(F.avg(F.when(F.col("status") == "superseded", F.col("importance"))), 6).alias("mean_superseded"))


@query("with k as (select project_id, memory_key, count(distinct claim_status) as kinds, avg(case when claim_status = 'verified' then 1.0 else 0.0 end) as accuracy from memories where memory_key is not null group by 1, 2) select project_id, count(*)::bigint as keys, round(avg(accuracy), 6) as accuracy, round(avg(case when kinds = 1 then 1.0 else 0.0 end), 6) as consistency from k group by 1")
def a12_accuracy_consistency(spark: SparkSession, base: str) -> DataFrame:
    """Mean accuracy over keys, and the share of keys with one outcome only."""
    one = F.lit(1.0).cast("double")
    zero = F.lit(0.0).cast("double")
    k = read_table(spark, base, "memories").where("memory_key is not null").groupBy("project_id", "memory_key").agg(F.count_distinct("claim_status").alias("kinds"), F.avg(F.when(F.col("claim_status") == "verified", one).otherwise(zero)).alias("accuracy"))
    return k.groupBy("project_id").agg(F.count("*").alias("keys"), F.round(F.avg("accuracy"), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("kinds") == 1, one).otherwise(zero)), 6).alias("consistency"))


@query("select project_id, (count(*) - count(distinct event_id))::bigint as repeated, count(distinct memory_id)::bigint as memories from memory_lifecycle_events group by project_id")
def a13_duplicate_keys(spark: SparkSession, base: str) -> DataFrame:
    """Deliveries beyond the first of each event."""
    return read_table(spark, base, "memory_lifecycle_events").groupBy("project_id").agg((F.count("*") - F.count_distinct("event_id")).alias("repeated"), F.count_distinct("memory_id").alias("memories"))


@query("select source, round(1 - sum(least(n_chars, 1000)) / sum(n_chars), 6) as reduction, round(avg(least(n_chars, 1000) / n_chars), 6) as retention, count(*) filter (n_chars > 1000)::bigint as compressed from documents group by source")
def a14_reduction(spark: SparkSession, base: str) -> DataFrame:
    """What cutting texts to 1,000 characters would save, for each source."""
    kept = F.least(F.col("n_chars"), F.lit(1000))
    return read_table(spark, base, "documents").groupBy("source").agg(F.round(1 - F.sum(kept) / F.sum("n_chars"), 6).alias("reduction"), F.round(F.avg(kept / F.col("n_chars")), 6).alias("retention"), F.count_if(F.col("n_chars") > 1000).alias("compressed"))


@query("select project_id, bool_and(file_hash is not null) as all_hashed, bool_or(chunk_count = 0) as any_empty from rag_documents group by project_id")
def a15_all_any(spark: SparkSession, base: str) -> DataFrame:
    """Whether all files have a hash and any has no chunks."""
    return read_table(spark, base, "rag_documents").groupBy("project_id").agg(F.bool_and(F.col("file_hash").isNotNull()).alias("all_hashed"), F.bool_or(F.col("chunk_count") == 0).alias("any_empty"))


@query("select user_id, event_type, count(*)::bigint as calls, greatest(count(*), 5)::bigint as needed from events group by 1, 2")
def a16_frequencies(spark: SparkSession, base: str) -> DataFrame:
    """Calls of each kind by run, with a least required count merged in."""
    return _events(spark, base).groupBy("user_id", "event_type").agg(F.count("*").alias("calls")).withColumn("needed", F.greatest("calls", F.lit(5).cast("bigint")))


@query("select project_id, min(epoch(expires_at) - epoch(created_at))::bigint as least_ttl from memories where expires_at is not null group by project_id")
def a17_min_ttl(spark: SparkSession, base: str) -> DataFrame:
    """The shortest time to live of each project's records, in whole seconds."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return read_table(spark, base, "memories").where("expires_at is not null").groupBy("project_id").agg(F.round(F.min(seconds("expires_at") - seconds("created_at"))).cast("bigint").alias("least_ttl"))


@query("select suite, coalesce(difficulty, 'none') as difficulty, count(*)::bigint as cases from eval_cases group by 1, 2")
def a19_histogram(spark: SparkSession, base: str) -> DataFrame:
    """Cases by suite and difficulty."""
    return read_table(spark, base, "eval_cases").groupBy("suite", F.coalesce("difficulty", F.lit("none")).alias("difficulty")).agg(F.count("*").alias("cases"))


@query("select symbol from rag_chunks where symbol is not null group by symbol having count(*) = 1")
def a20_unique_names(spark: SparkSession, base: str) -> DataFrame:
    """Symbols that occur exactly once."""
    return read_table(spark, base, "rag_chunks").where("symbol is not null").groupBy("symbol").agg(F.count("*").alias("n")).where("n = 1").select("symbol")


@query("select memory_id, array_to_string(from_json(evidence_json, '[\"VARCHAR\"]'), '; ') as evidence from memories")
def a22_joined_evidence(spark: SparkSession, base: str) -> DataFrame:
    """The pieces of evidence of each record in one text."""
    return read_table(spark, base, "memories").select("memory_id", F.array_join(F.from_json("evidence_json", "array<string>"), "; ").alias("evidence"))


@query("select memory_id, created_at from (select *, row_number() over (partition by project_id order by created_at desc, memory_id desc) as r from memories) where r <= 3")
def t05_audit_newest(spark: SparkSession, base: str) -> DataFrame:
    """The three newest records of each project, newest first."""
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("memory_id"))
    return read_table(spark, base, "memories").withColumn("r", F.row_number().over(w)).where("r <= 3").select("memory_id", "created_at")


@query("select candidate_id, created_at from (select distinct candidate_id, created_at, project_id from memory_curation_decisions where action = 'pending_review') order by created_at, candidate_id limit 100")
def t06_pending_oldest(spark: SparkSession, base: str) -> DataFrame:
    """The 100 oldest pending decisions."""
    d = read_table(spark, base, "memory_curation_decisions").where("action = 'pending_review'").select("candidate_id", "created_at", "project_id").distinct()
    return d.orderBy("created_at", "candidate_id").limit(100).select("candidate_id", "created_at")


@query("select project_id, memory_id, rank::int as rank from (select project_id, memory_id, row_number() over (partition by project_id order by importance desc, created_at desc, memory_id) as rank from memories where status = 'active') where rank <= 4")
def t02_filter_then_cut(spark: SparkSession, base: str) -> DataFrame:
    """The four most important active records of each project: filtered first, cut afterwards."""
    w = Window.partitionBy("project_id").orderBy(F.desc("importance"), F.desc("created_at"), "memory_id")
    return read_table(spark, base, "memories").where("status = 'active'").withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("project_id", "memory_id", "rank")


@query("select project_id, path, chunk_count::bigint as chunk_count, r::int as position from (select *, row_number() over (partition by project_id order by chunk_count desc, path) as r from rag_documents)")
def t07_descending_scores(spark: SparkSession, base: str) -> DataFrame:
    """Files of each project by descending size, equal ones by path."""
    w = Window.partitionBy("project_id").orderBy(F.desc("chunk_count"), "path")
    return read_table(spark, base, "rag_documents").select("project_id", "path", F.col("chunk_count").cast("bigint").alias("chunk_count"), F.row_number().over(w).alias("position"))


@query("select item_id, list_slice(relevant_paths, 1, 10) as signals from eval_cases")
def t08_first_signals(spark: SparkSession, base: str) -> DataFrame:
    """The first ten paths of each case."""
    return read_table(spark, base, "eval_cases").select("item_id", F.slice("relevant_paths", 1, 10).alias("signals"))


@query("select project_id, r::int as position from (select project_id, row_number() over (order by lower(trim(display_name)), project_id) as r from projects)")
def t09_casefolded_names(spark: SparkSession, base: str) -> DataFrame:
    """Projects by name without regard to case and stray blanks; a fixed, small table."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.lower(F.trim("display_name")), "project_id")
    return read_table(spark, base, "projects").select("project_id", F.row_number().over(w).alias("position"))


@query("with r as (select chunk_id, row_number() over (partition by project_id order by path, start_line, chunk_id) as rn, project_id from rag_chunks) select chunk_id, row_number() over (order by rn, project_id)::bigint as position from r")
def w07_round_robin(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of all projects in turn: the order (number in the project, project), numbered through by turns."""
    w = Window.partitionBy("project_id").orderBy("path", "start_line", "chunk_id")
    r = read_table(spark, base, "rag_chunks").select("chunk_id", "project_id", F.row_number().over(w).alias("rn"))
    # Positions without one global sort: rows of earlier turns, then the projects before within the turn.
    turns = r.groupBy("rn").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("rn")) - F.col("n"))
    within = F.row_number().over(Window.partitionBy("rn").orderBy("project_id"))
    return r.withColumn("within", within).join(turns.select("rn", "before"), "rn").select("chunk_id", (F.col("before") + F.col("within")).alias("position"))


@query("select doc_id, sha256(concat_ws(chr(0), 'seed-7', doc_id::varchar)) as h from documents")
def w08_hash_order(spark: SparkSession, base: str) -> DataFrame:
    """The key of a stable pseudo-random order."""
    return read_table(spark, base, "documents").select("doc_id", F.sha2(F.concat_ws("\x00", F.lit("seed-7"), F.col("doc_id").cast("string")), 256).alias("h"))
