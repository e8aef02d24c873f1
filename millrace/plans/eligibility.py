"""Which records a search may see, their state under a key, sweeps of expired ones, and rules for single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as N
from ..functions import text as T
from ..runtime import read_table
from ..streaming import jobs
from .registry import query

NOW_SQL = "(select max(created_at) from memories)"
CURRENT_SQL = "cur as (select project_id, max(repo_revision) as current from rag_documents group by project_id)"
_ELIGIBLE_SQL = f"status = 'active' and importance >= {{least}} and (expires_at is null or expires_at > {NOW_SQL}) and (scope = 'project' or repo_revision = current)"


def with_current(spark: SparkSession, base: str) -> DataFrame:
    """The records with the current revision of their project and the time of the newest record.

    The times are one row and the projects a fixed table, so both go to every task.
    """
    m = read_table(spark, base, "memories")
    current = read_table(spark, base, "rag_documents").groupBy("project_id").agg(F.max("repo_revision").alias("current"))
    return m.join(current, "project_id", "left").crossJoin(F.broadcast(m.agg(F.max("created_at").alias("now"))))


def eligible(spark: SparkSession, base: str, **rules) -> DataFrame:
    """The records that a search may see."""
    return with_current(spark, base).where(N.eligible(F.col("now"), F.col("current"), **rules))


@query(f"with {CURRENT_SQL} select memory_id from memories left join cur using (project_id) where {_ELIGIBLE_SQL.format(least=0.3)} and memory_type in ('semantic', 'episodic') and claim_status in ('verified', 'hypothesis')")
def p02_eligible(spark: SparkSession, base: str) -> DataFrame:
    """Active records of allowed types and claims, important enough, neither expired nor stale."""
    return eligible(spark, base, types=("semantic", "episodic"), claims=("verified", "hypothesis"), least_importance=0.3).select("memory_id")


@query(f"with {CURRENT_SQL} select memory_id, memory_type, content from memories left join cur using (project_id) where {_ELIGIBLE_SQL.format(least=0.0)} and claim_status = 'verified'")
def p03_read_only_view(spark: SparkSession, base: str) -> DataFrame:
    """What a reading tool sees: eligible records that are verified."""
    return eligible(spark, base, claims=("verified",)).select("memory_id", "memory_type", "content")


@query(f"with {CURRENT_SQL} select memory_id, coalesce(scope = 'revision' and repo_revision is distinct from current, false) as stale from memories left join cur using (project_id)")
def p14_stale(spark: SparkSession, base: str) -> DataFrame:
    """Records that hold for another revision than the current one."""
    return with_current(spark, base).select("memory_id", N.stale(F.col("scope"), F.col("repo_revision"), F.col("current")).alias("stale"))


_RANKED_SQL = f"with {CURRENT_SQL}, r as (select memory_id, importance, coalesce(scope = 'revision' and repo_revision is distinct from current, false) as stale, row_number() over (partition by project_id order by importance desc, memory_id) as rank from memories left join cur using (project_id) where status = 'active' and importance is not null)"


@query(f"{_RANKED_SQL} select memory_id, (greatest(10, least(89, round_even(80 * importance, 0)::int - rank)) - case when stale then 30 else 0 end)::int as priority from r")
def f36_priorities(spark: SparkSession, base: str) -> DataFrame:
    """Priorities of the active records of each project, ranked by importance."""
    m = with_current(spark, base).where("status = 'active' and importance is not null")
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("importance"), "memory_id"))
    flag = N.stale(F.col("scope"), F.col("repo_revision"), F.col("current"))
    return m.withColumn("rank", rank).select("memory_id", N.priority(F.col("importance"), F.col("rank"), flag).alias("priority"))


@query(f"""with due as (select * from memories where status = 'active' and expires_at <= {NOW_SQL})
  select 'record' as part, memory_id as id, 'expired' as status, '[expired]' as body from due
  union all select 'event', sha256(concat_ws(chr(0), memory_id, 'expired', epoch_us({NOW_SQL})::varchar)), 'expired', memory_id from due""")
def x01_expiry_sweep(spark: SparkSession, base: str) -> DataFrame:
    """A sweep over active records whose time is over: the tombstone of each and the event that tells of it."""
    due = with_current(spark, base).where((F.col("status") == "active") & (F.col("expires_at") <= F.col("now")))
    event = T.joined_id(F.col("memory_id"), F.lit("expired"), F.unix_micros(F.col("now").cast("timestamp")).cast("string"))
    part = lambda name, i, body: F.struct(F.lit(name).alias("part"), i.alias("id"), F.lit("expired").alias("status"), body.alias("body"))
    return due.select(F.explode(F.array(part("record", F.col("memory_id"), F.lit("[expired]")), part("event", event, F.col("memory_id")))).alias("x")).select("x.*")


@query("""with r as (select project_id, memory_key, memory_id, coalesce(content, '') as content, coalesce(claim_status, '') = 'verified' as sure, created_at, row_number() over w as n from memories where memory_key is not null window w as (partition by project_id, memory_key order by created_at, memory_id)),
  s as (select *, last_value(case when n = 1 or sure then content end ignore nulls) over (partition by project_id, memory_key order by created_at, memory_id rows between unbounded preceding and 1 preceding) as held from r)
  select memory_id, case when n = 1 then 'create' when content = held then 'duplicate' when sure then 'supersede' else 'pending' end as action from s""")
def x03_key_states(spark: SparkSession, base: str) -> DataFrame:
    """What each record does to the state of its key (create, duplicate, supersede, pending), as state that lives across micro-batches."""
    records = jobs.table_stream(spark, base, "memories").where("memory_key is not null")
    return jobs.key_actions(records, ["project_id", "memory_key"], "created_at", "memory_id", "content", F.coalesce(F.col("claim_status") == "verified", F.lit(False))).select("memory_id", "action")


@query("select distinct sha256(concat_ws(chr(0), memory_id, event_type, event_id)) as execution_key, memory_id from memory_lifecycle_events")
def x06_idempotent_sink(spark: SparkSession, base: str) -> DataFrame:
    """Events written once under their execution key, however often they are delivered."""
    events = jobs.table_stream(spark, base, "memory_lifecycle_events").select(T.joined_id(F.col("memory_id"), F.col("event_type"), F.col("event_id")).alias("execution_key"), "memory_id")
    return jobs.write_once(events, "execution_key")


@query("select candidate_id, list_sort(json_keys(candidate_json)) as outer_keys, list_sort(list_filter(json_keys(candidate_json, '$.memory'), lambda k: k <> 'evidence')) as inner_keys from (select distinct candidate_id, candidate_json from memory_curation_decisions)")
def p11_pruned(spark: SparkSession, base: str) -> DataFrame:
    """The entries of nested JSON that are left when those of one name are taken out at any depth."""
    d = read_table(spark, base, "memory_curation_decisions").select("candidate_id", "candidate_json").distinct()
    pruned = d.select("candidate_id", N.without_key(F.col("candidate_json"), "evidence").alias("j"))
    keys = lambda c: F.array_sort(F.json_object_keys(c))
    return pruned.select("candidate_id", keys(F.col("j")).alias("outer_keys"), keys(F.get_json_object("j", "$.memory")).alias("inner_keys"))


@query("select candidate_id, strlen(candidate_json)::bigint as bytes from (select distinct candidate_id, candidate_json from memory_curation_decisions)")
def f39_json_bytes(spark: SparkSession, base: str) -> DataFrame:
    """The size of JSON texts in bytes."""
    d = read_table(spark, base, "memory_curation_decisions").select("candidate_id", "candidate_json").distinct()
    return d.select("candidate_id", F.octet_length("candidate_json").cast("bigint").alias("bytes"))


@query("with recursive t as (select candidate_id, candidate_json::json as j, 0 as depth from (select distinct candidate_id, candidate_json from memory_curation_decisions) union all select candidate_id, unnest(case json_type(j) when 'OBJECT' then list_transform(json_keys(j), lambda k: json_extract(j, '$.\"' || k || '\"')) else json_extract(j, '$[*]') end), depth + 1 from t where json_type(j) in ('OBJECT', 'ARRAY')) select candidate_id, max(case when json_type(j) in ('OBJECT', 'ARRAY') then depth + 1 else depth end)::int as depth from t group by candidate_id")
def f45_json_depth(spark: SparkSession, base: str) -> DataFrame:
    """The levels of nested JSON."""
    d = read_table(spark, base, "memory_curation_decisions").select("candidate_id", "candidate_json").distinct()
    return d.select("candidate_id", N.json_depth(F.col("candidate_json")).alias("depth"))


_V03 = """select 'perceptual_evidence' as rule, memory_id as id from memories where memory_type = 'perceptual' and len(from_json(evidence_json, '["VARCHAR"]')) = 0
  union all select 'tag_length', memory_id from memories where len(list_filter(from_json(tags_json, '["VARCHAR"]'), lambda t: len(t) not between 1 and 6)) > 0
  union all select 'replaces_itself', memory_id from memories where supersedes_memory_id = memory_id
  union all select 'replaced_without_key', memory_id from memories where supersedes_memory_id is not null and memory_key is null"""


@query(_V03)
def v03_record_rules(spark: SparkSession, base: str) -> DataFrame:
    """Records that break rules on evidence, lengths of tags (six characters here) and replacement, in one scan."""
    arr = lambda c: F.from_json(c, "array<string>")
    rules = {
        "perceptual_evidence": (F.col("memory_type") == "perceptual") & (F.size(arr("evidence_json")) == 0),
        "tag_length": F.exists(arr("tags_json"), lambda t: ~F.length(t).between(1, 6)),
        "replaces_itself": F.col("supersedes_memory_id") == F.col("memory_id"),
        "replaced_without_key": F.col("supersedes_memory_id").isNotNull() & F.col("memory_key").isNull(),
    }
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return read_table(spark, base, "memories").select(F.explode(named).alias("rule"), F.col("memory_id").alias("id"))


@query("select project_id, path, count(*)::bigint as chunks, list(i order by i) = range(0, count(*)) as contiguous, chunk_count = count(*) as complete from (select project_id, path, row_number() over (partition by project_id, path order by start_line, chunk_id) - 1 as i, start_line from rag_chunks) join rag_documents using (project_id, path) group by project_id, path, chunk_count")
def v12_contiguous(spark: SparkSession, base: str) -> DataFrame:
    """Whether the indexes of the chunks of each file are contiguous from 0, and as many as the file says."""
    c = read_table(spark, base, "rag_chunks").select("project_id", "path", "start_line", "chunk_id")
    i = F.row_number().over(Window.partitionBy("project_id", "path").orderBy("start_line", "chunk_id")) - 1
    per = c.withColumn("i", i).groupBy("project_id", "path").agg(F.count("*").alias("chunks"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_distinct("i").alias("distinct"))
    contiguous = (F.col("lo") == 0) & (F.col("hi") == F.col("chunks") - 1) & (F.col("distinct") == F.col("chunks"))
    return per.join(read_table(spark, base, "rag_documents"), ["project_id", "path"]).select("project_id", "path", "chunks", contiguous.alias("contiguous"), (F.col("chunk_count") == F.col("chunks")).alias("complete"))


@query("""select user_id, count(*)::bigint as events, list(event_id order by ts, event_id) filter (event_type = 'error') as errors, arg_max(event_id, (ts, event_id)) filter (event_type = 'purchase') as last_purchase from events group by user_id""")
def x04_reduced_states(spark: SparkSession, base: str) -> DataFrame:
    """The state of each run after its events: errors are appended, the last purchase is replaced."""
    e = read_table(spark, base, "events")
    when = lambda kind: F.when(F.col("event_type") == kind, F.col("event_id"))
    out = jobs.reduced_states(e, ["user_id"], ["ts", "event_id"], {"errors": when("error")}, {"last_purchase": when("purchase")})
    return out.withColumn("errors", F.when(F.size("errors") > 0, F.col("errors")))


@query("select memory_id, case when lead(memory_id) over w is null then status else 'superseded' end as status_after, lag(memory_id) over w as points_to from memories where memory_key is not null and status in ('active', 'superseded') window w as (partition by project_id, memory_key order by created_at, memory_id)")
def g03_superseded(spark: SparkSession, base: str) -> DataFrame:
    """Records under a key after each has superseded the one before: only the newest keeps its status, each points back."""
    w = Window.partitionBy("project_id", "memory_key").orderBy("created_at", "memory_id")
    m = read_table(spark, base, "memories").where("memory_key is not null and status in ('active', 'superseded')")
    return m.select("memory_id", F.when(F.lead("memory_id").over(w).isNull(), F.col("status")).otherwise("superseded").alias("status_after"), F.lag("memory_id").over(w).alias("points_to"))


@query("""with d as (select *, row_number() over (partition by project_id, candidate_id order by created_at, updated_at, action) as r from memory_curation_decisions)
  select candidate_id, action from d where r = 1""")
def g11_replayed(spark: SparkSession, base: str) -> DataFrame:
    """Decisions after a replay of all deliveries: what was decided first under a key stays."""
    d = read_table(spark, base, "memory_curation_decisions")
    first = F.min_by(F.struct("candidate_id", "action"), F.struct("created_at", "updated_at", "action"))
    return d.groupBy("project_id", "candidate_id").agg(first.alias("x")).select("x.candidate_id", "x.action")


_PATCH_RULES = """
  select 'fields_of_action' as rule, candidate_id as id from (select distinct candidate_id, action, result_memory_id from memory_curation_decisions) where (action in ('create', 'supersede')) <> (result_memory_id is not null)
  union all select 'path_repeated', project_id || ':' || path from chunk_drafts where project_id is not null and path is not null group by project_id, path, scanned_at having count(*) > 1
  union all select 'expected_repeated', item_id::varchar from eval_cases where len(relevant_paths) <> len(list_distinct(relevant_paths))
  union all select 'steps', item_id::varchar from eval_cases where len(relevant_paths) not between 1 and 6
"""


@query(_PATCH_RULES)
def v08_change_rules(spark: SparkSession, base: str) -> DataFrame:
    """What breaks the rules of changes: fields that don't fit the action, paths given twice, repeated expectations, other than 1 to 6 steps (V08 to V11)."""
    d = read_table(spark, base, "memory_curation_decisions").select("candidate_id", "action", "result_memory_id").distinct()
    fields = d.where(F.col("action").isin("create", "supersede") != F.col("result_memory_id").isNotNull()).select(F.lit("fields_of_action").alias("rule"), F.col("candidate_id").alias("id"))
    paths = read_table(spark, base, "chunk_drafts").where("project_id is not null and path is not null").groupBy("project_id", "path", "scanned_at").count().where("count > 1")
    paths = paths.select(F.lit("path_repeated").alias("rule"), F.concat("project_id", F.lit(":"), "path").alias("id"))
    n = F.size("relevant_paths")
    rules = F.array_compact(F.array(F.when(n != F.size(F.array_distinct("relevant_paths")), "expected_repeated"), F.when(~n.between(1, 6), "steps")))
    cases = read_table(spark, base, "eval_cases").select(F.explode(rules).alias("rule"), F.col("item_id").cast("string").alias("id"))
    return fields.unionByName(paths).unionByName(cases)
