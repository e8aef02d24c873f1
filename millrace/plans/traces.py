"""Execution traces and append-only logs: run lengths, repeats, snapshots, temporal joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables
from ..runtime import read_table
from .registry import query

def by_run() -> WindowSpec:
    """The events of a run in order."""
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def _events(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "events")


def streaks(events: DataFrame) -> DataFrame:
    """Events with ``streak``: the number of errors in a row up to and with this one, 0 for others."""
    island = events.withColumn("island", F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(by_run()))
    w = Window.partitionBy("user_id", "island").orderBy("ts", "event_id")
    return island.withColumn("streak", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w)).drop("island")


_STREAK_SQL = """
  i as (select *, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) as island from events),
  st as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, island order by ts, event_id) as streak from i)
"""


@query(f"with {_STREAK_SQL} select event_id, streak::bigint as streak from st")
def w10_error_streaks(spark: SparkSession, base: str) -> DataFrame:
    """Consecutive errors of each run, reset by a success."""
    return streaks(_events(spark, base)).select("event_id", "streak")


@query("select event_id, row_number() over (partition by user_id, event_type, props order by ts, event_id)::int as occurrence from events")
def w11_occurrence(spark: SparkSession, base: str) -> DataFrame:
    """The number of an identical call within its run."""
    w = Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id")
    return _events(spark, base).select("event_id", F.row_number().over(w).alias("occurrence"))


@query("select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def w12_latest_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """The last state of each run."""
    return tables.latest(_events(spark, base), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts", "event_type")


@query("select user_id, event_id, r::int as age from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 5")
def w12_bounded_history(spark: SparkSession, base: str) -> DataFrame:
    """The five last states of each run, newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, base).select("user_id", "event_id", F.row_number().over(w).alias("age")).where("age <= 5")


@query("with e as (select *, row_number() over (partition by user_id order by ts, event_id) as i from events), f as (select user_id, min(i) as first_error from e where event_type = 'error' group by 1) select event_id, 'kept' as part from e left join f using (user_id) where first_error is null or i < first_error union all select event_id, 'replaced' from e join f using (user_id) where i >= first_error")
def w15_retained_prefix(spark: SparkSession, base: str) -> DataFrame:
    """The part of each run before its first error is kept, the rest is replaced."""
    seen = F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(by_run().rowsBetween(Window.unboundedPreceding, 0))
    return _events(spark, base).select("event_id", F.when(seen == 1, "replaced").otherwise("kept").alias("part"))


@query("select c.event_id, exists (select 1 from events p where p.user_id = c.user_id and p.event_type = 'error' and (p.ts < c.ts or p.ts = c.ts and p.event_id < c.event_id)) as after_error from events c where c.event_type = 'purchase'")
def j15_any_earlier(spark: SparkSession, base: str) -> DataFrame:
    """Whether an error came before each purchase of a run: a running maximum in place of a join on inequality."""
    before = F.coalesce(F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(by_run().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return _events(spark, base).withColumn("after_error", before).where("event_type = 'purchase'").select("event_id", "after_error")


@query("select p.event_id, arg_max(v.event_id, (v.ts, v.event_id)) as last_view from events p join events v on p.user_id = v.user_id and v.event_type = 'view' and (v.ts < p.ts or v.ts = p.ts and v.event_id < p.event_id) where p.event_type = 'purchase' group by p.event_id")
def j15_as_of(spark: SparkSession, base: str) -> DataFrame:
    """The last view before each purchase (as-of join by a running last value)."""
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(by_run().rowsBetween(Window.unboundedPreceding, -1))
    return _events(spark, base).withColumn("last_view", last).where("event_type = 'purchase' and last_view is not null").select("event_id", "last_view")


@query(f"""with {_STREAK_SQL}, o as (select event_id, row_number() over (partition by user_id, event_type, props order by ts, event_id) as occurrence from events),
  n as (select st.*, occurrence, row_number() over (partition by user_id order by ts, event_id) as i from st join o using (event_id)),
  v as (select user_id, i, case when i > 60 then 'budget' when streak >= 3 then 'errors' when occurrence >= 3 then 'duplicate' end as stop from n)
  select user_id, coalesce(min(i) filter (stop is not null), max(i))::int as stopped_at, coalesce(arg_min(stop, i) filter (stop is not null), 'completed') as verdict from v group by user_id""")
def g29_run_verdict(spark: SparkSession, base: str) -> DataFrame:
    """Where and why each run stops: budget, errors in a row or a repeated call, whichever comes first."""
    again = Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id")
    n = streaks(_events(spark, base)).withColumn("occurrence", F.row_number().over(again)).withColumn("i", F.row_number().over(by_run()))
    stop = F.when(F.col("i") > 60, "budget").when(F.col("streak") >= 3, "errors").when(F.col("occurrence") >= 3, "duplicate")
    first = n.withColumn("stop", stop).groupBy("user_id").agg(F.min(F.when(F.col("stop").isNotNull(), F.struct("i", "stop"))).alias("s"), F.max("i").alias("last"))
    return first.select("user_id", F.coalesce("s.i", "last").alias("stopped_at"), F.coalesce("s.stop", F.lit("completed")).alias("verdict"))


@query("select sha256(concat_ws(chr(0), user_id::varchar, event_type, props)) as fingerprint, count(*)::bigint as times, count(*) > 1 as repeated from events group by 1")
def g24_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """Fingerprints of calls and whether they repeat."""
    f = T.joined_id(F.col("user_id").cast("string"), F.col("event_type"), F.col("props"))
    return _events(spark, base).groupBy(f.alias("fingerprint")).agg(F.count("*").alias("times"), (F.count("*") > 1).alias("repeated"))


@query("with d as (select distinct event_id, memory_id, event_type, created_at, recorded_at from memory_lifecycle_events), k as (select event_id, min(recorded_at) as recorded_at from d group by event_id) select k.event_id, date_diff('second', arg_min(created_at, d.recorded_at), k.recorded_at)::bigint as delay_s from k join d on k.event_id = d.event_id group by k.event_id, k.recorded_at")
def x06_replay_safe(spark: SparkSession, base: str) -> DataFrame:
    """Each event once, by its first delivery, with the delay of that delivery."""
    first = tables.latest(read_table(spark, base, "memory_lifecycle_events"), ["event_id"], [F.asc("recorded_at")])
    return first.select("event_id", (F.unix_seconds(F.col("recorded_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))).alias("delay_s"))


@query("with recursive o as (select user_id, ts, event_id, lag(ts) over (partition by user_id order by ts, event_id) as before from events), s as (select *, sum(case when before is null or ts - before >= interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts, event_id) as session from o) select user_id, min(ts) as started, count(*)::bigint as calls from s group by user_id, session")
def x09_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Sessions of each run with gaps below 30 minutes (extension)."""
    e = _events(spark, base).withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes").alias("s")).agg(F.count("*").alias("calls")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("started"), "calls")
