"""Keyed tables: differences of two scans, upserts, deletes, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables
from ..runtime import read_table
from .registry import query

#: Two revisions of the files: the newest draft of each path in the first and in the last four fifths of its project's scans.
_REVISIONS_SQL = """
  span as (select project_id, min(epoch_us(scanned_at)) as lo, max(epoch_us(scanned_at)) as hi from chunk_drafts group by project_id),
  dr as (select d.project_id, path, draft_id, sha256(content) as hash, length(content) as size, scanned_at,
                epoch_us(scanned_at) <= hi - (hi - lo) // 5 as early, epoch_us(scanned_at) >= lo + (hi - lo) // 5 as late from chunk_drafts d join span using (project_id)),
  o as (select project_id, path, draft_id, hash, size from (select *, row_number() over (partition by project_id, path order by scanned_at desc, draft_id desc) as r from dr where early) where r = 1),
  n as (select project_id, path, draft_id, hash, size from (select *, row_number() over (partition by project_id, path order by scanned_at desc, draft_id desc) as r from dr where late) where r = 1)
"""
_DIFF_SQL = f"""{_REVISIONS_SQL},
  df as (select coalesce(o.project_id, n.project_id) as project_id, coalesce(o.path, n.path) as path,
                case when o.path is null then 'added' when n.path is null then 'deleted' when o.hash is not distinct from n.hash then 'unchanged' else 'changed' end as change
         from o full join n on o.project_id = n.project_id and o.path = n.path)
"""
KEYS = ["project_id", "path"]


def revisions(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The files of all projects at two revisions."""
    drafts = read_table(spark, base, "chunk_drafts").select("project_id", "path", "draft_id", F.sha2("content", 256).alias("hash"), F.length("content").alias("size"), "scanned_at")
    micros = F.unix_micros(F.col("scanned_at").cast("timestamp"))
    span = drafts.groupBy("project_id").agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).withColumn("fifth", F.expr("(hi - lo) div 5"))
    marked = drafts.join(span, "project_id").withColumn("early", micros <= F.col("hi") - F.col("fifth")).withColumn("late", micros >= F.col("lo") + F.col("fifth"))
    newest = [F.desc("scanned_at"), F.desc("draft_id")]
    columns = ["project_id", "path", "draft_id", "hash", "size"]
    return tables.latest(marked.where("early"), KEYS, newest).select(*columns), tables.latest(marked.where("late"), KEYS, newest).select(*columns)


@query(f"with {_DIFF_SQL} select * from df")
def j01_index_diff(spark: SparkSession, base: str) -> DataFrame:
    """Files added, deleted, changed and unchanged between two revisions."""
    old, new = revisions(spark, base)
    return tables.diff(old, new, KEYS, "hash")


@query(f"with {_DIFF_SQL} select project_id, count(*)::bigint as files, count(*) filter (change = 'added')::bigint as added, count(*) filter (change = 'changed')::bigint as changed, count(*) filter (change = 'deleted')::bigint as deleted, count(*) filter (change = 'unchanged')::bigint as unchanged from df group by project_id")
def a02_index_report(spark: SparkSession, base: str) -> DataFrame:
    """The indexing report of each project in one pass."""
    old, new = revisions(spark, base)
    change = tables.diff(old, new, KEYS, "hash")
    return change.groupBy("project_id").agg(F.count("*").alias("files"), *(F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "deleted", "unchanged")))


@query(f"with {_REVISIONS_SQL} select project_id, path from o except select project_id, path from n")
def u02_deleted_paths(spark: SparkSession, base: str) -> DataFrame:
    """Paths of the old revision that the new one lacks."""
    old, new = revisions(spark, base)
    return old.select(*KEYS).exceptAll(new.select(*KEYS)).distinct()


@query(f"with {_REVISIONS_SQL} select project_id, path from o intersect select project_id, path from n")
def u02_common_paths(spark: SparkSession, base: str) -> DataFrame:
    """Paths of both revisions."""
    old, new = revisions(spark, base)
    return old.select(*KEYS).intersect(new.select(*KEYS))


@query(f"with {_REVISIONS_SQL} select * from n union all select o.* from o where not exists (select 1 from n where n.project_id = o.project_id and n.path = o.path)")
def u04_upsert_update(spark: SparkSession, base: str) -> DataFrame:
    """The old revision with the new one written over it."""
    old, new = revisions(spark, base)
    return tables.upsert(old, new, KEYS)


@query(f"with {_REVISIONS_SQL} select * from o union all select n.* from n where not exists (select 1 from o where n.project_id = o.project_id and n.path = o.path)")
def u04_upsert_ignore(spark: SparkSession, base: str) -> DataFrame:
    """The old revision with only the new paths added."""
    old, new = revisions(spark, base)
    return tables.upsert(old, new, KEYS, replace=False)


@query(f"with {_DIFF_SQL} select o.* from o where not exists (select 1 from df where df.project_id = o.project_id and df.path = o.path and change in ('deleted', 'changed'))")
def u05_delete_by_key(spark: SparkSession, base: str) -> DataFrame:
    """The old revision without what was deleted or changed."""
    old, new = revisions(spark, base)
    return tables.delete(old, tables.diff(old, new, KEYS, "hash").where("change in ('deleted', 'changed')"), KEYS)


@query(f"with {_DIFF_SQL} select n.* from n join df using (project_id, path) where change in ('added', 'changed') union all select o.* from o join df using (project_id, path) where change = 'unchanged'")
def g01_reindexed(spark: SparkSession, base: str) -> DataFrame:
    """The index after an incremental run: new rows only for changed files, old rows for unchanged ones, none for deleted ones."""
    old, new = revisions(spark, base)
    change = tables.diff(old, new, KEYS, "hash")
    fresh = new.join(change.where("change in ('added', 'changed')"), KEYS, "left_semi")
    return fresh.unionByName(old.join(change.where("change = 'unchanged'"), KEYS, "left_semi"))


@query(f"with {_REVISIONS_SQL} select project_id, path, case when o.hash is null then 'create' when n.hash is null then 'delete' else 'modify' end as operation, coalesce(n.size, 0) - coalesce(o.size, 0) as growth from o full join n using (project_id, path) where o.hash is distinct from n.hash")
def j08_changed_files(spark: SparkSession, base: str) -> DataFrame:
    """The operation that makes the new revision of each file, with the growth in characters."""
    old, new = revisions(spark, base)
    o, n = old.select(*KEYS, F.col("hash").alias("oh"), F.col("size").alias("os")), new.select(*KEYS, F.col("hash").alias("nh"), F.col("size").alias("ns"))
    both = o.join(n, KEYS, "full_outer").where("not (oh <=> nh)")
    operation = F.when(F.col("oh").isNull(), "create").when(F.col("nh").isNull(), "delete").otherwise("modify")
    return both.select(*KEYS, operation.alias("operation"), (F.coalesce("ns", F.lit(0)) - F.coalesce("os", F.lit(0))).alias("growth"))


@query(f"with {_REVISIONS_SQL}, c as (select project_id, count(*) as in_old from o group by 1), d as (select project_id, count(*) as in_new from n group by 1), k as (select project_id, count(*) as copied from n where not exists (select 1 from o where o.project_id = n.project_id and o.path = n.path) group by 1) select project_id, coalesce(in_old, 0)::bigint as in_old, coalesce(in_new, 0)::bigint as in_new, coalesce(copied, 0)::bigint as copied from c full join d using (project_id) left join k using (project_id)")
def s08_bulk_copy_counts(spark: SparkSession, base: str) -> DataFrame:
    """Rows on both sides of a copy and the rows it would add, for each project."""
    old, new = revisions(spark, base)
    counts = old.groupBy("project_id").agg(F.count("*").alias("in_old")).join(new.groupBy("project_id").agg(F.count("*").alias("in_new")), "project_id", "full_outer")
    copied = new.join(old, KEYS, "left_anti").groupBy("project_id").agg(F.count("*").alias("copied"))
    zero = F.lit(0).cast("bigint")
    return counts.join(copied, "project_id", "left").select("project_id", *(F.coalesce(c, zero).alias(c) for c in ("in_old", "in_new", "copied")))


@query("with k as (select doc_id, sha256(text) as key from documents), c as (select distinct key, 'cached' as state from (select sha256(text) as key, created_at from documents) where created_at < timestamp '2031-06-01') select key, coalesce(state, 'computed') as state, count(*)::bigint as requests from k left join c using (key) group by 1, 2")
def s12_value_cache(spark: SparkSession, base: str) -> DataFrame:
    """Requests by content hash answered from a cache of the older texts or computed once."""
    docs = read_table(spark, base, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "created_at")
    cache = docs.where("created_at < timestamp_ntz '2031-06-01 00:00:00'").select("key", F.lit("cached").alias("state")).distinct()
    answers, _ = tables.through_cache(docs.select("doc_id", "key"), cache, "key", lambda m: m.select("key", F.lit("computed").alias("state")))
    return answers.groupBy("key", "state").agg(F.count("*").alias("requests"))


@query("""with p as (select sha256(concat_ws(chr(0), 'overlap-v1', query, path)) as key, suite, query, path from eval_cases, unnest(relevant_paths) as t(path)), c as (select distinct key from p where suite = (select min(suite) from eval_cases))
  select key, case when key in (select key from c) then 'cached' else 'computed' end as state, count(*)::bigint as requests from p group by 1, 2""")
def s13_pair_cache(spark: SparkSession, base: str) -> DataFrame:
    """Scores of pairs of query and document under a model name: those of the first suite are cached, missing ones are computed once and written back."""
    cases = read_table(spark, base, "eval_cases")
    first = cases.agg(F.min("suite").alias("first"))
    pairs = cases.crossJoin(F.broadcast(first)).select((F.col("suite") == F.col("first")).alias("scored"), "query", F.explode("relevant_paths").alias("path"))
    pairs = pairs.select(T.joined_id(F.lit("overlap-v1"), "query", "path").alias("key"), "scored")
    cache = pairs.where("scored").select("key", F.lit("cached").alias("state")).distinct()
    answers, _ = tables.through_cache(pairs.select("key"), cache, "key", lambda m: m.select("key", F.lit("computed").alias("state")))
    return answers.groupBy("key", "state").agg(F.count("*").alias("requests"))


@query("select d.candidate_id, d.action, m.memory_id, m.claim_status from (select distinct * from memory_curation_decisions) d join memories m on d.result_memory_id = m.memory_id")
def j12_decision_results(spark: SparkSession, base: str) -> DataFrame:
    """Decisions with the record they led to; rows delivered twice count once."""
    d = read_table(spark, base, "memory_curation_decisions").distinct()
    m = read_table(spark, base, "memories").select("memory_id", "claim_status")
    return d.join(m, d.result_memory_id == m.memory_id).select("candidate_id", "action", "memory_id", "claim_status")


@query("select d.candidate_id, d.project_id, m.memory_id as active_memory from (select distinct project_id, candidate_id, json_extract_string(candidate_json, '$.memory_key') as memory_key from memory_curation_decisions) d left join (select project_id, memory_key, min(memory_id) as memory_id from memories where status = 'active' and memory_key is not null group by 1, 2) m using (project_id, memory_key)")
def j11_candidate_to_active(spark: SparkSession, base: str) -> DataFrame:
    """Each candidate with the active record of its key, if there is one."""
    d = read_table(spark, base, "memory_curation_decisions").select("project_id", "candidate_id", F.get_json_object("candidate_json", "$.memory_key").alias("memory_key")).distinct()
    m = read_table(spark, base, "memories").where("status = 'active' and memory_key is not null").groupBy("project_id", "memory_key").agg(F.min("memory_id").alias("active_memory"))
    return d.join(m, ["project_id", "memory_key"], "left").select("candidate_id", "project_id", "active_memory")


@query("select memory_id from memories where memory_id not in (select memory_id from memory_lifecycle_events where memory_id is not null) and status <> 'active'")
def j07_missing_events(spark: SparkSession, base: str) -> DataFrame:
    """Records that ended without a lifecycle event."""
    m = read_table(spark, base, "memories").where("status <> 'active'").select("memory_id")
    return m.join(read_table(spark, base, "memory_lifecycle_events").where("memory_id is not null"), "memory_id", "left_anti")


@query("select memory_id from memories where memory_id in (select memory_id from memory_lifecycle_events)")
def j05_with_events(spark: SparkSession, base: str) -> DataFrame:
    """Records that have a lifecycle event."""
    return read_table(spark, base, "memories").select("memory_id").join(read_table(spark, base, "memory_lifecycle_events"), "memory_id", "left_semi")


@query("with e as (select distinct project_id, path from chunk_drafts), i as (select project_id, path from rag_documents) select coalesce(e.project_id, i.project_id) as project_id, coalesce(e.path, i.path) as path, case when i.path is null then 'unexpected' else 'missing' end as problem from e full join i on e.project_id = i.project_id and e.path = i.path where e.path is null or i.path is null")
def j09_expected_vs_found(spark: SparkSession, base: str) -> DataFrame:
    """Paths that only one of two tables has."""
    e, i = read_table(spark, base, "chunk_drafts").select(*KEYS).distinct(), read_table(spark, base, "rag_documents").select(*KEYS)
    return e.join(i, KEYS, "left_anti").withColumn("problem", F.lit("unexpected")).unionByName(i.join(e, KEYS, "left_anti").withColumn("problem", F.lit("missing")))


@query("select d.project_id, d.path, d.chunk_count, count(c.chunk_id)::bigint as found, count(c.chunk_id) = d.chunk_count as agrees from rag_documents d left join rag_chunks c on c.project_id = d.project_id and c.path = d.path group by d.project_id, d.path, d.chunk_count")
def j10_declared_counts(spark: SparkSession, base: str) -> DataFrame:
    """Declared chunk counts against the chunks that exist."""
    found = read_table(spark, base, "rag_chunks").groupBy(*KEYS).agg(F.count("chunk_id").alias("found"))
    d = read_table(spark, base, "rag_documents").select(*KEYS, "chunk_count").join(found, KEYS, "left").withColumn("found", F.coalesce("found", F.lit(0).cast("bigint")))
    return d.withColumn("agrees", F.col("found") == F.col("chunk_count"))


@query("with d as (select doc_id, path, project_id, source from documents) select d.source, count(*)::bigint as documents, count(r.path)::bigint as indexed from d left join rag_documents r on r.project_id = d.project_id and r.path = d.path group by d.source")
def j04_lookup_missing_dropped(spark: SparkSession, base: str) -> DataFrame:
    """How many documents of each source an index lookup finds."""
    r = read_table(spark, base, "rag_documents").select(*KEYS, F.lit(1).alias("hit"))
    return read_table(spark, base, "documents").join(r, KEYS, "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("hit").alias("indexed"))


@query("select memory_id, evidence from memories, unnest(from_json(evidence_json, '[\"VARCHAR\"]')) as t(evidence)")
def j13_exploded_evidence(spark: SparkSession, base: str) -> DataFrame:
    """One row for each piece of evidence."""
    return read_table(spark, base, "memories").select("memory_id", F.explode(F.from_json("evidence_json", "array<string>")).alias("evidence"))


@query("""with s as (select symbol, path, project_id, chunk_id, start_line, row_number() over (partition by project_id order by path, start_line, chunk_id) as pos from rag_chunks where kind = 'python_symbol')
  select chunk_id, next_chunk from (select a.chunk_id, arg_min(b.chunk_id, b.pos) as next_chunk from s a join s b on a.project_id = b.project_id and b.pos > a.pos and b.path <> a.path group by a.chunk_id)""")
def j14_next_on_other_path(spark: SparkSession, base: str) -> DataFrame:
    """For each symbol the next one of the project on another path: the first position after the last one of its own path."""
    s = read_table(spark, base, "rag_chunks").where("kind = 'python_symbol'").select("project_id", "path", "start_line", "chunk_id")
    # Paths stand together in this order, so the next other path begins where the own path ends.
    firsts = s.groupBy("project_id", "path").agg(F.min(F.struct("start_line", "chunk_id")).alias("f"))
    nxt = firsts.withColumn("next_chunk", F.lead("f.chunk_id").over(Window.partitionBy("project_id").orderBy("path"))).where("next_chunk is not null").select("project_id", "path", "next_chunk")
    return s.join(nxt, ["project_id", "path"]).select("chunk_id", "next_chunk")


@query("select item_id, coalesce(len(list_filter(relevant_paths, lambda p: p in ('src/prefix.py', 'src/trace.py', 'src/valve.py'))) > 0, false) or coalesce(suite in ('explain', 'patch'), false) as relevant from eval_cases")
def j18_either_qualifier(spark: SparkSession, base: str) -> DataFrame:
    """Cases that qualify by one of their paths or by their suite."""
    e = read_table(spark, base, "eval_cases")
    by_path = F.arrays_overlap("relevant_paths", F.array(F.lit("src/prefix.py"), F.lit("src/trace.py"), F.lit("src/valve.py")))
    return e.select("item_id", (F.coalesce(by_path, F.lit(False)) | F.coalesce(F.col("suite").isin("explain", "patch"), F.lit(False))).alias("relevant"))


@query("select item_id, list_transform(list_sort(list_transform(list_distinct(string_split(lower(query), ' ')), lambda x: {'p': list_position(string_split(lower(query), ' '), x), 'x': x})), lambda s: s.x) as words from eval_cases")
def u03_ordered_distinct(spark: SparkSession, base: str) -> DataFrame:
    """Distinct words in the order in which they are first seen."""
    return read_table(spark, base, "eval_cases").select("item_id", F.array_distinct(F.split(F.lower("query"), " ")).alias("words"))


@query("with t as (select unnest(from_json(tags_json, '[\"VARCHAR\"]')) as tag, memory_type from memories) select tag from t where memory_type = 'semantic' intersect select tag from t where memory_type = 'episodic' intersect select tag from t where memory_type = 'perceptual'")
def u06_three_way_intersection(spark: SparkSession, base: str) -> DataFrame:
    """Tags that records of all three kinds have, by one pass over the tags."""
    t = read_table(spark, base, "memories").select(F.explode(F.from_json("tags_json", "array<string>")).alias("tag"), "memory_type").where("memory_type in ('semantic', 'episodic', 'perceptual')")
    return t.groupBy("tag").agg(F.count_distinct("memory_type").alias("kinds")).where("kinds = 3").select("tag")


@query("select m.memory_id, p.memory_id as before, len(list_filter(from_json(p.tags_json, '[\"VARCHAR\"]'), lambda t: not list_contains(from_json(m.tags_json, '[\"VARCHAR\"]'), t))) = 0 as subset from memories m join memories p on m.supersedes_memory_id = p.memory_id")
def u07_subset_check(spark: SparkSession, base: str) -> DataFrame:
    """Whether the tags of a superseded record are all among those of its successor."""
    m = read_table(spark, base, "memories")
    p = m.select(F.col("memory_id").alias("before"), F.from_json("tags_json", "array<string>").alias("old"))
    j = m.join(p, m.supersedes_memory_id == p.before)
    return j.select("memory_id", "before", (F.size(F.array_except("old", F.from_json("tags_json", "array<string>"))) == 0).alias("subset"))


@query("select sha256(array_to_string(list_sort(list_distinct(from_json(tags_json, '[\"VARCHAR\"]'))), '|')) as tag_set, count(*)::bigint as memories from memories group by 1")
def u08_set_equality(spark: SparkSession, base: str) -> DataFrame:
    """Records with equal sets of tags."""
    tags = F.array_join(F.sort_array(F.array_distinct(F.from_json("tags_json", "array<string>"))), "|")
    return read_table(spark, base, "memories").groupBy(F.sha2(tags, 256).alias("tag_set")).agg(F.count("*").alias("memories"))


@query("with c as (select project_id, symbol, content_hash from rag_chunks where symbol is not null), a as (select project_id, symbol, max(content_hash) as h from c group by 1, 2), b as (select project_id, symbol, max(content_hash) as h from chunk_drafts where symbol is not null group by 1, 2) select coalesce(a.project_id, b.project_id) as project_id, coalesce(a.symbol, b.symbol) as symbol, case when a.symbol is null then 'added' when b.symbol is null then 'removed' when a.h = b.h then 'same' else 'changed' end as change from a full join b on a.project_id = b.project_id and a.symbol = b.symbol")
def u09_symbol_diff(spark: SparkSession, base: str) -> DataFrame:
    """Symbols added, removed and changed between the index and the drafts."""
    a = read_table(spark, base, "rag_chunks").where("symbol is not null").groupBy("project_id", "symbol").agg(F.max("content_hash").alias("h"))
    b = read_table(spark, base, "chunk_drafts").where("symbol is not null").groupBy("project_id", "symbol").agg(F.max("content_hash").alias("h"))
    d = tables.diff(a, b, ["project_id", "symbol"], "h")
    return d.withColumn("change", F.when(F.col("change") == "deleted", "removed").when(F.col("change") == "unchanged", "same").otherwise(F.col("change")))


@query("select project_id, count(*)::bigint as entries, sha256(string_agg(path || ' ' || coalesce(file_hash, ''), chr(10) order by path || ' ' || coalesce(file_hash, ''))) as digest from rag_documents group by project_id")
def a18_manifest_hash(spark: SparkSession, base: str) -> DataFrame:
    """The hash of each project's sorted manifest."""
    return tables.ordered_hash(read_table(spark, base, "rag_documents"), ["project_id"], F.concat("path", F.lit(" "), F.coalesce("file_hash", F.lit(""))))


@query("with a as (select project_id, sha256(string_agg(path, chr(10) order by path)) as d from rag_documents group by 1), b as (select project_id, sha256(string_agg(path, chr(10) order by path)) as d from (select distinct project_id, path from rag_chunks) group by 1) select coalesce(a.project_id, b.project_id) as project_id, a.d is distinct from b.d as drift from a full join b on a.project_id = b.project_id")
def g28_manifest_drift(spark: SparkSession, base: str) -> DataFrame:
    """Projects whose manifest and chunks name different files."""
    a = tables.ordered_hash(read_table(spark, base, "rag_documents"), ["project_id"], F.col("path")).select("project_id", F.col("digest").alias("a"))
    b = tables.ordered_hash(read_table(spark, base, "rag_chunks").select("project_id", "path").distinct(), ["project_id"], F.col("path")).select("project_id", F.col("digest").alias("b"))
    return a.join(b, "project_id", "full_outer").select("project_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("drift"))
