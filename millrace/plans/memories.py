"""The record table as a log: latest views, chains, tombstones, validation; memory ranking; context packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packing, tables
from ..operators import retrieval as R
from ..runtime import read_table
from .eligibility import CURRENT_SQL, NOW_SQL, eligible
from .registry import query
from .retrieval import _BIG, DIM, FUSED_SQL, _vectors_sql, _words, fused


def _memories(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "memories")


@query("select project_id, memory_key, memory_id from (select *, row_number() over (partition by project_id, memory_key order by created_at desc, memory_id desc) as r from memories where memory_key is not null) where r = 1")
def g02_latest_by_key(spark: SparkSession, base: str) -> DataFrame:
    """The newest record of each key."""
    m = _memories(spark, base).where("memory_key is not null")
    return tables.latest(m, ["project_id", "memory_key"], [F.desc("created_at"), F.desc("memory_id")]).select("project_id", "memory_key", "memory_id")


@query("select memory_id, lag(memory_id) over (partition by project_id, memory_key order by created_at, memory_id) as before, supersedes_memory_id as declared from memories where memory_key is not null")
def g03_chains(spark: SparkSession, base: str) -> DataFrame:
    """The record before each one under the same key, and the one that it says it replaces."""
    w = Window.partitionBy("project_id", "memory_key").orderBy("created_at", "memory_id")
    return _memories(spark, base).where("memory_key is not null").select("memory_id", F.lag("memory_id").over(w).alias("before"), F.col("supersedes_memory_id").alias("declared"))


@query("select m.memory_id, case when e.memory_id is not null then '[forgotten]' else content end as content, case when e.memory_id is not null then null else tags_json end as tags_json, e.memory_id is not null as erased from memories m left join (select distinct memory_id from memory_lifecycle_events where event_type = 'forgotten') e on m.memory_id = e.memory_id")
def g04_tombstones(spark: SparkSession, base: str) -> DataFrame:
    """Records with body and tags erased where the log says so."""
    e = read_table(spark, base, "memory_lifecycle_events").where("event_type = 'forgotten'").select(F.col("memory_id"), F.lit(True).alias("gone")).distinct()
    m = _memories(spark, base).join(e, "memory_id", "left")
    gone = F.coalesce("gone", F.lit(False))
    return m.select("memory_id", F.when(gone, "[forgotten]").otherwise(F.col("content")).alias("content"), F.when(~gone, F.col("tags_json")).alias("tags_json"), gone.alias("erased"))


@query("select memory_id, expires_at, coalesce(expires_at <= (select max(created_at) from memories), false) as due from memories where expires_at is not null")
def g05_due(spark: SparkSession, base: str) -> DataFrame:
    """Records whose time is over when the newest record comes in."""
    m = _memories(spark, base)
    now = m.agg(F.max("created_at").alias("now"))
    return m.where("expires_at is not null").crossJoin(F.broadcast(now)).select("memory_id", "expires_at", F.coalesce(F.col("expires_at") <= F.col("now"), F.lit(False)).alias("due"))


@query()
def g07_reembedded(spark: SparkSession, base: str) -> DataFrame:
    """Vectors of the active records computed anew in one embedding space."""
    from ..functions import vector as V

    return V.feature_hash(_memories(spark, base).where("status = 'active'"), "memory_id", T.features(F.coalesce("content", F.lit(""))), 64)


@query("select distinct sha256(concat_ws(chr(0), project_id, source_id, memory_type)) as consolidation_key, project_id, memory_type from memories where source_id is not null")
def g11_consolidation_keys(spark: SparkSession, base: str) -> DataFrame:
    """Keys under which repeated runs are recognised."""
    return _memories(spark, base).where("source_id is not null").select(T.joined_id(F.col("project_id"), F.col("source_id"), F.col("memory_type")).alias("consolidation_key"), "project_id", "memory_type").distinct()


_VIOLATIONS = """
  select 'line_order' as rule, draft_id::varchar as id from chunk_drafts where start_line < 1 or end_line < start_line
  union all select 'dimensions', chunk_id from rag_chunks where embedding is not null and len(embedding) <> embedding_dimensions
  union all select 'evidence_missing', memory_id from memories where claim_status = 'verified' and len(from_json(evidence_json, '["VARCHAR"]')) = 0
  union all select 'revision_missing', memory_id from memories where scope = 'revision' and repo_revision is null
  union all select 'tags_repeated', memory_id from memories where len(from_json(tags_json, '["VARCHAR"]')) <> len(list_distinct(from_json(tags_json, '["VARCHAR"]')))
  union all select 'importance_range', memory_id from memories where importance not between 0 and 1
  union all select 'hash_format', draft_id::varchar from chunk_drafts where not coalesce(regexp_full_match(content_hash, '[0-9a-f]{64}'), false)
  union all select 'key_taken', memory_id from (select memory_id, count(*) over (partition by project_id, memory_key) as n from memories where status = 'active' and memory_key is not null) where n > 1
  union all select 'path', draft_id::varchar from chunk_drafts where path is null or path = '' or path like '/%' or contains(path, '..')
"""


@query(_VIOLATIONS)
def v01_violations(spark: SparkSession, base: str) -> DataFrame:
    """Rows that break a rule of their table, with the rule; nothing is raised."""
    drafts, chunks, m = read_table(spark, base, "chunk_drafts"), read_table(spark, base, "rag_chunks"), _memories(spark, base)
    arr = lambda c: F.from_json(c, "array<string>")
    key = Window.partitionBy("project_id", "memory_key")
    taken = m.where("status = 'active' and memory_key is not null").withColumn("n", F.count("*").over(key)).where("n > 1")

    def rows(df: DataFrame, id_col: str, **rules: F.Column) -> DataFrame:
        """One scan for all rules of a table."""
        named = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
        return df.select(F.explode(named).alias("rule"), F.col(id_col).cast("string").alias("id"))

    bad_path = F.col("path").isNull() | (F.col("path") == "") | F.col("path").startswith("/") | F.col("path").contains("..")
    out = rows(drafts, "draft_id", line_order=(F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), hash_format=~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), path=bad_path)
    out = out.unionByName(rows(chunks, "chunk_id", dimensions=F.col("embedding").isNotNull() & (F.size("embedding") != F.col("embedding_dimensions"))))
    out = out.unionByName(rows(m, "memory_id", evidence_missing=(F.col("claim_status") == "verified") & (F.size(arr("evidence_json")) == 0), revision_missing=(F.col("scope") == "revision") & F.col("repo_revision").isNull(), tags_repeated=F.size(arr("tags_json")) != F.size(F.array_distinct(arr("tags_json"))), importance_range=~F.col("importance").between(0, 1)))
    return out.unionByName(rows(taken, "memory_id", key_taken=F.lit(True)))


@query("select project_id, path, count(*)::bigint as chunks, max(start_line)::bigint as last_start, list(start_line order by start_line) = list(distinct start_line order by start_line) as starts_unique from rag_chunks group by project_id, path")
def v12_unique_positions(spark: SparkSession, base: str) -> DataFrame:
    """Whether the chunks of a file begin on different lines."""
    return read_table(spark, base, "rag_chunks").groupBy("project_id", "path").agg(F.count("*").alias("chunks"), F.max("start_line").cast("bigint").alias("last_start"), (F.count("*") == F.count_distinct("start_line")).alias("starts_unique"))


# The 28 words of a query that are left out elsewhere count here, and words aren't split.
_QUERIES_SQL = "cq as (select distinct project_id, candidate_id, coalesce(json_extract_string(candidate_json, '$.rationale'), '') as q from memory_curation_decisions)"
_QT = f"qt as (select distinct project_id, candidate_id, term from (select project_id, candidate_id, unnest(flatten(list_transform({_words('q', False)}, lambda w: list_concat([w], {_BIG})))) as term from cq))"
_MW = f"mw as (select memory_id, term, sum(w) as f from (select memory_id, 1.0::double as w, unnest(flatten(list_transform({_words('content', False)}, lambda w: list_concat([w], {_BIG})))) as term from mm union all select memory_id, 1.5::double, unnest(flatten(list_transform({_words('tags_json', False)}, lambda w: list_concat([w], {_BIG})))) from mm) group by 1, 2)"
_ML = "ml as (select memory_id, sum(n) as length from (select memory_id, count(*) as n from (select memory_id, unnest(flatten(list_transform({a}, lambda w: list_concat([w], {b})))) as t from mm) group by 1 union all select memory_id, count(*) from (select memory_id, unnest(flatten(list_transform({c}, lambda w: list_concat([w], {b})))) as t from mm) group by 1) group by 1)".format(a=_words("content", False), b=_BIG, c=_words("tags_json", False))


@query(f"""with {CURRENT_SQL}, mm as (select memory_id, project_id, coalesce(content, '') as content, coalesce(tags_json, '') as tags_json, importance from memories left join cur using (project_id)
    where status = 'active' and importance >= 0 and (expires_at is null or expires_at > {NOW_SQL}) and (scope = 'project' or repo_revision = current)), {_QUERIES_SQL}, {_QT}, {_MW}, {_ML},
  d as (select term, count(*) as df from mw group by term), t as (select (select count(*) from mm) as n, (select sum(length) from ml) / (select count(*) from mm) as avgdl),
  s as (select candidate_id, memory_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avgdl))), 6) as score from mw join d using (term) join ml using (memory_id) join mm using (memory_id) cross join t join qt on qt.term = mw.term and qt.project_id = mm.project_id group by 1, 2),
  lex as (select * from (select *, row_number() over (partition by candidate_id order by score desc, memory_id) as rank from s) where rank <= 20),
  qv as ({_vectors_sql('cq', 'candidate_id', 'q')}), mv as ({_vectors_sql('mm', 'memory_id', 'content')}),
  ds as (select qv.candidate_id, mv.memory_id, round(sum(qv.x * mv.x), 6) as score from qv join cq using (candidate_id) join mm using (project_id) join mv on mv.memory_id = mm.memory_id and mv.dim = qv.dim group by 1, 2),
  den as (select * from (select *, row_number() over (partition by candidate_id order by score desc, memory_id) as rank from ds where score > 0) where rank <= 20),
  b as (select coalesce(lex.candidate_id, den.candidate_id) as candidate_id, coalesce(lex.memory_id, den.memory_id) as memory_id, lex.rank as lr, den.rank as dr from lex full join den on lex.candidate_id = den.candidate_id and lex.memory_id = den.memory_id),
  p as (select candidate_id, memory_id, lr, dr, round(0.01 * importance + coalesce(1.0::double / (60 + lr), 0) + coalesce(1.0::double / (60 + dr), 0), 6) as score from b join mm using (memory_id))
  select candidate_id, memory_id, lr::int as lexical_rank, dr::int as dense_rank, score, rank::int as rank from (select *, row_number() over (partition by candidate_id order by score desc, memory_id) as rank from p) where rank <= 5""")
def w04_memory_rank(spark: SparkSession, base: str) -> DataFrame:
    """Eligible records of its project for the rationale of each candidate: BM25 with weighted tags and cosine, fused by reciprocal ranks, with a prior by importance."""
    m = eligible(spark, base)
    c = read_table(spark, base, "memory_curation_decisions").select("project_id", "candidate_id", F.coalesce(F.get_json_object("candidate_json", "$.rationale"), F.lit("")).alias("q")).distinct()
    terms = c.select("project_id", "candidate_id", F.explode(T.query_terms(F.col("q"), limit=None, stop_words=False, camel=False)).alias("term"))
    fields = {"content": (F.col("content"), 1.0), "tags": (F.col("tags_json"), 1.5)}
    lexical = R.bm25_ranked(m, "memory_id", fields, terms, "candidate_id", 20, "project_id")
    qv = R.hashed_vectors(c, "candidate_id", F.col("q"), DIM, "project_id")
    mv = R.hashed_vectors(m, "memory_id", F.col("content"), DIM, "project_id")
    dense = R.dense_ranked(qv, "candidate_id", mv, "memory_id", 20, "project_id")
    both = R.fuse(lexical, dense, "candidate_id", "memory_id", 40).drop("score", "rank").join(m.select("memory_id", "importance"), "memory_id")
    part = lambda r: F.coalesce(F.lit(1.0).cast("double") / (60 + F.col(r)), F.lit(0.0).cast("double"))
    score = F.round(0.01 * F.col("importance") + part("lexical_rank") + part("dense_rank"), 6)
    return R.ranked(both.select("candidate_id", "memory_id", "lexical_rank", "dense_rank", score.alias("score")), "candidate_id", "memory_id", 5)


def _packets(spark: SparkSession, base: str) -> DataFrame:
    hits = fused(spark, base, 20).select("item_id", "doc_id", "rank")
    docs = read_table(spark, base, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), F.col("created_at").cast("timestamp").alias("created_at"))
    return hits.join(docs, "doc_id").select("item_id", F.col("doc_id").cast("string").alias("packet_id"), "content", F.greatest(F.lit(20), 80 - F.col("rank")).alias("priority"), F.lit(False).alias("mandatory"), F.lit(7).alias("source_rank"), "created_at", F.col("rank").alias("position"), F.lit(None).cast("string").alias("dedupe_key"))


_FUSED20 = FUSED_SQL.replace("where rank <= 5)", "where rank <= 20)")
_PACKETS_SQL = f"{_FUSED20}, pk as (select fr.item_id, doc_id::varchar as packet_id, coalesce(text, '') as content, greatest(20, 80 - rank)::int as priority, created_at, rank::int as position from fr join documents using (doc_id))"
_KEY_SQL = "sha256(replace(lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 'ß', 'ss'))"


@query(f"with {_PACKETS_SQL} select item_id, packet_id, priority from pk")
def g13_packets(spark: SparkSession, base: str) -> DataFrame:
    """Packets from the fused hits, their priority falling with the rank."""
    return _packets(spark, base).select("item_id", "packet_id", "priority")


@query(f"with {_PACKETS_SQL} select item_id, packet_id, row_number() over (partition by item_id, {_KEY_SQL} order by priority desc, coalesce(created_at, timestamp '1970-01-01') desc, position) > 1 as duplicate from pk")
def w05_dedupe_keep_best(spark: SparkSession, base: str) -> DataFrame:
    """Packets that repeat another one of the same query in a less good place."""
    return packing.best_of_duplicates(_packets(spark, base), "item_id").select("item_id", "packet_id", "duplicate")


@query(f"with {_PACKETS_SQL} select item_id, packet_id, row_number() over (partition by item_id order by priority desc, coalesce(created_at, timestamp '1970-01-01') desc, packet_id)::int as place from pk")
def w06_packet_order(spark: SparkSession, base: str) -> DataFrame:
    """The order in which packets are considered."""
    w = Window.partitionBy("item_id").orderBy(F.desc("priority"), "source_rank", F.desc(F.coalesce("created_at", F.lit(0).cast("timestamp"))), "packet_id")
    return _packets(spark, base).select("item_id", "packet_id", F.row_number().over(w).alias("place"))


@query()
def g14_context(spark: SparkSession, base: str) -> DataFrame:
    """What the context of every query takes in under a budget of 900 tokens, and why not the rest."""
    return packing.pack_context(_packets(spark, base), "item_id", 900)


@query(f"""with {_FUSED20}, q as (select distinct item_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as w from eval_cases), nq as (select item_id, count(*) as n from q group by 1),
  d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as ws from documents), o as (select fr.item_id, fr.doc_id, fr.rank, count(*) filter (list_contains(ws, w)) as c from fr join d using (doc_id) join q using (item_id) group by 1, 2, 3)
  select item_id, doc_id, round(c / n, 6) as score, row_number() over (partition by item_id order by round(c / n, 6) desc, rank)::int as place from o join nq using (item_id)""")
def d06_rerank(spark: SparkSession, base: str) -> DataFrame:
    """Fused hits put in order by the share of the query's words that they hold."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    q = read_table(spark, base, "eval_cases").select("item_id", words(F.col("query")).alias("qw"))
    d = read_table(spark, base, "documents").select("doc_id", words(F.col("text")).alias("dw"))
    j = fused(spark, base, 20).select("item_id", "doc_id", "rank").join(q, "item_id").join(d, "doc_id")
    s = j.select("item_id", "doc_id", "rank", F.round(F.size(F.array_intersect("qw", "dw")) / F.size("qw"), 6).alias("score"))
    return s.select("item_id", "doc_id", "score", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "rank")).alias("place"))
