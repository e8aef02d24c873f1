"""Queries over the files of a corpus: scan rules, listings, line ranges, literal search, globs and path checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables
from ..runtime import new_folder, read_table
from ..sources.files import EXTENSIONS, IGNORED, PagedSource
from .registry import query

_EXT = ", ".join(f"'{x}'" for x in EXTENSIONS)
_IGN = ", ".join(f"'{x}'" for x in IGNORED)
MAX_BYTES = 512_000


def _drafts(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "chunk_drafts")


def scan_verdict() -> F.Column:
    """kept, or why a file is left out: folder, extension or size."""
    folders = F.split("path", "/")
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    return F.when(F.exists(folders, lambda s: s.isin(*IGNORED)), "folder").when(~ext.isin(*EXTENSIONS), "extension").when(F.octet_length("content") > MAX_BYTES, "size").otherwise("kept")


_SCAN = f"case when len(list_filter(string_split(path, '/'), lambda s: s in ({_IGN}))) > 0 then 'folder' when lower(list_last(string_split(path, '.'))) not in ({_EXT}) then 'extension' when strlen(content) > {MAX_BYTES} then 'size' else 'kept' end"


@query(f"select project_id, {_SCAN} as verdict, count(*)::bigint as files from chunk_drafts group by 1, 2")
def s01_scan(spark: SparkSession, base: str) -> DataFrame:
    """What a scan of the drafts keeps and leaves out."""
    return _drafts(spark, base).groupBy("project_id", scan_verdict().alias("verdict")).agg(F.count("*").alias("files"))


@query(f"select project_id, path, row_number() over (partition by project_id order by path)::int as position from (select distinct project_id, path from chunk_drafts where len(list_filter(string_split(path, '/'), lambda s: s in ({_IGN}))) = 0)")
def s02_iterate_files(spark: SparkSession, base: str) -> DataFrame:
    """All files outside of ignored folders, in order of their path."""
    kept = _drafts(spark, base).where(~F.exists(F.split("path", "/"), lambda s: s.isin(*IGNORED))).select("project_id", "path").distinct()
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy("path")))


@query("""with p as (select distinct project_id, string_split(path, '/') as s from chunk_drafts), e as (select distinct project_id, array_to_string(s[1:k], '/') as entry, k < len(s) as is_folder, k as depth from (select project_id, s, unnest(range(1, len(s) + 1)) as k from p) where k <= 2)
  select project_id, entry, is_folder, depth::int as depth from e""")
def s03_listing(spark: SparkSession, base: str) -> DataFrame:
    """Folders and files of each project to a depth of two."""
    s = _drafts(spark, base).select("project_id", F.split("path", "/").alias("s")).distinct()
    e = s.select("project_id", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(2), F.size("s")))).alias("depth"))
    return e.select("project_id", F.array_join(F.slice("s", F.lit(1), F.col("depth")), "/").alias("entry"), (F.col("depth") < F.size("s")).alias("is_folder"), "depth").distinct()


@query("select case_id, count(*)::bigint as rows, case when case_id is null or case_id = '' then 'missing id' when count(*) > 1 then 'repeated id' when min(len(query)) not between 1 and 2000 then 'query length' else 'valid' end as verdict from eval_cases group by case_id")
def s04_case_validation(spark: SparkSession, base: str) -> DataFrame:
    """Evaluation cases by what is wrong with them."""
    n = F.count("*")
    verdict = F.when(F.col("case_id").isNull() | (F.col("case_id") == ""), "missing id").when(n > 1, "repeated id").when(~F.min(F.length("query")).between(1, 2000), "query length").otherwise("valid")
    return read_table(spark, base, "eval_cases").groupBy("case_id").agg(n.alias("rows"), verdict.alias("verdict"))


@query("""with l as (select doc_id, string_split(text, chr(10)) as ls from documents), x as (select doc_id, len(ls) as total_lines, generate_subscripts(ls, 1) as n, unnest(ls) as line from l),
  y as (select *, sum(len(line) + 1) over (partition by doc_id order by n) as upto from x where n between 3 and 12)
  select doc_id, n::int as line_no, total_lines::int as total_lines, case when upto <= 400 then line else left(line, greatest(0, 400 - (upto - len(line) - 1))::int) end as line, upto > 400 as cut from y where upto - len(line) - 1 < 400""")
def s10_line_range(spark: SparkSession, base: str) -> DataFrame:
    """Lines 3 to 12 of every document, cut at 400 characters."""
    lines = read_table(spark, base, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    x = lines.select("doc_id", F.size("ls").alias("total_lines"), F.posexplode(F.slice("ls", 3, 10)).alias("i", "line")).withColumn("line_no", F.col("i") + 3)
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("line_no"))
    y = x.withColumn("upto", upto).withColumn("before", F.col("upto") - F.length("line") - 1).where("before < 400")
    text = F.when(F.col("upto") <= 400, F.col("line")).otherwise(F.expr("left(line, cast(400 - before as int))"))
    return y.select("doc_id", "line_no", "total_lines", text.alias("line"), (F.col("upto") > 400).alias("cut"))


@query("""with p as (select project_id, path, max(strlen(content)) as size from chunk_drafts where path is not null group by 1, 2), s as (select *, string_split(path, '/') as s from p),
  e as (select distinct project_id, array_to_string(s[1:k], '/') as entry, true as is_folder, null::bigint as size from (select project_id, s, unnest(range(1, len(s))) as k from s) where k <= 2 union all select project_id, path, false, size from s where len(s) - 1 <= 2),
  r as (select *, row_number() over (partition by project_id order by entry) as r, count(*) over (partition by project_id) as n from e where contains(entry, 'te'))
  select project_id, entry, is_folder, size::bigint as size, n > 40 as limit_reached from r where r <= 40""")
def s03_bounded_listing(spark: SparkSession, base: str) -> DataFrame:
    """Entries of each project to a depth of two whose path or name matches a glob, 40 at most, and whether there are more."""
    files = _drafts(spark, base).where("path is not null").groupBy("project_id", "path").agg(F.max(F.octet_length("content")).cast("bigint").alias("size"))
    return tables.listing(files, "project_id", "path", "size", max_depth=2, max_results=40, glob="*te*")


@query("""with l as (select draft_id, string_split(content, chr(10)) as ls from chunk_drafts), x as (select draft_id, generate_subscripts(ls, 1)::int as line_no, unnest(ls) as line from l), h as (select draft_id, line_no from x where contains(line, 'return'))
  select draft_id, line_no, (select count(*) > 100 from h) as limit_reached from h order by draft_id, line_no limit 100""")
def t04_limit_with_flag(spark: SparkSession, base: str) -> DataFrame:
    """The first 100 lines with a literal, and whether there are more: one more is taken than given."""
    lines = _drafts(spark, base).select("draft_id", F.posexplode(F.split("content", "\n")).alias("i", "line")).where(F.contains("line", F.lit("return")))
    return tables.first_rows(lines.select("draft_id", (F.col("i") + 1).alias("line_no")), ["draft_id", "line_no"], 100)


@query("select project_id, display_name from projects")
def t03_bounded_scan(spark: SparkSession, base: str) -> DataFrame:
    """The projects, of which there may be 5,000 at most: one more is an error."""
    return tables.bounded(read_table(spark, base, "projects").select("project_id", "display_name"), 5_000)


PAGE = 25


@query(f"with r as (select path, project_id, row_number() over (order by project_id, path) - 1 as i from rag_documents) select (i // {PAGE})::int as page, (i % {PAGE})::int as position, project_id || ':' || path as item from r")
def s14_paged_listing(spark: SparkSession, base: str) -> DataFrame:
    """The indexed files as a source hands them over page by page, each page naming the next one."""
    items = read_table(spark, base, "rag_documents").select(F.concat("project_id", F.lit(":"), "path").alias("item"), "project_id", "path")
    place = tables.numbered(items, ["project_id", "path"], "i")
    pages = place.groupBy(F.floor(F.col("i") / PAGE).alias("page")).agg(F.sort_array(F.collect_list(F.struct("i", "item"))).alias("x"))
    last = read_table(spark, base, "rag_documents").count() - 1
    token = lambda n: F.concat(F.lit("page-"), n.cast("string"))
    lines = pages.select(F.when(F.col("page") == 0, "").otherwise(token(F.col("page"))).alias("token"), F.when(F.col("page") < last // PAGE, token(F.col("page") + 1)).alias("next"), F.transform("x", lambda e: e["item"]).alias("items"))
    folder = new_folder(spark, "pages")
    lines.write.json(folder)
    spark.dataSource.register(PagedSource)
    return spark.read.format("pages").option("path", folder).option("max_pages", str(10**7)).option("pages_per_task", "64").load()


@query("""with l as (select draft_id, string_split(content, chr(10)) as ls from chunk_drafts), x as (select draft_id, generate_subscripts(ls, 1) as n, unnest(ls) as line from l),
  y as (select draft_id, n, line, string_split(line, 'return') as parts from x where contains(line, 'return'))
  select draft_id, n::int as line_no, (list_sum(list_transform(parts[1:k], lambda p: len(p))) + (k - 1) * 6 + 1)::int as col, left(line, 500) as line from (select *, unnest(range(1, len(parts))) as k from y)""")
def f12_literal_search(spark: SparkSession, base: str) -> DataFrame:
    """All occurrences of a literal in the drafts with line and column."""
    lines = _drafts(spark, base).select("draft_id", F.posexplode(F.split("content", "\n")).alias("i", "line")).where(F.contains("line", F.lit("return")))
    return lines.select("draft_id", (F.col("i") + 1).alias("line_no"), F.explode(T.occurrences(F.col("line"), "return")).alias("col"), F.left("line", F.lit(500)).alias("line"))


@query("select draft_id, path from chunk_drafts where regexp_full_match(path, 'src/.*/test_.*[.]py') or regexp_full_match(list_last(string_split(path, '/')), 'src/.*/test_.*[.]py') or regexp_full_match(list_last(string_split(path, '/')), '.*_table[.]py')")
def p04_globs(spark: SparkSession, base: str) -> DataFrame:
    """Drafts whose path or file name matches one of two globs."""
    return _drafts(spark, base).where(T.glob_match(F.col("path"), "src/*/test_*.py") | T.glob_match(F.col("path"), "*_table.py")).select("draft_id", "path")


@query("with g as (select unnest(['*.py', '/etc/*', '../*.md', '', 'docs/**', 'a\\b']) as pattern) select pattern as glob, pattern = '' or pattern like '/%' or contains(pattern, '..') or len(pattern) > 200 as unsafe from g")
def p05_unsafe_globs(spark: SparkSession, base: str) -> DataFrame:
    """Globs that would leave the root, are empty or too long."""
    g = spark.createDataFrame([(x,) for x in ("*.py", "/etc/*", "../*.md", "", "docs/**", "a\\b")], "glob string")
    return g.select("glob", ((F.col("glob") == "") | F.col("glob").startswith("/") | F.col("glob").contains("..") | (F.length("glob") > 200)).alias("unsafe"))


# Relative parts that are appended: some stay inside, some leave the root.
_PARTS = ["", "/../x/./y", "//z", "/../../../../../../..", "/../../../../../../../../q"]


@query(f"""with e as (select distinct item_id, p || part as path from (select item_id, unnest(relevant_paths) as p from eval_cases), (select unnest({_PARTS}) as part)),
  f as (select item_id, path, list_reduce(list_transform(string_split(path, '/'), lambda x: [x]), lambda s, x: case when s is null then null when x[1] in ('', '.') then s when x[1] = '..' then case when len(s) > 0 then s[1:len(s) - 1] end else list_concat(s, x) end, []::varchar[]) as r from e)
  select item_id, path, array_to_string(r, '/') as resolved, r is not null as inside from f""")
def p06_resolved_paths(spark: SparkSession, base: str) -> DataFrame:
    """Paths with their ``.`` and ``..`` resolved by a fold over the segments, and whether they stay inside the root; null where one would leave it."""
    parts = F.array(*map(F.lit, _PARTS))
    e = read_table(spark, base, "eval_cases").select("item_id", F.explode("relevant_paths").alias("p")).select("item_id", F.explode(F.transform(parts, lambda x: F.concat("p", x))).alias("path")).distinct()
    none = F.lit(None).cast("array<string>")
    fold = F.aggregate(F.split("path", "/"), F.array().cast("array<string>"), lambda s, x: F.when(s.isNull(), none).when(x.isin("", "."), s).when(x == "..", F.when(F.size(s) > 0, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(none)).otherwise(F.concat(s, F.array(x))))
    return e.withColumn("r", fold).select("item_id", "path", F.array_join("r", "/").alias("resolved"), F.col("r").isNotNull().alias("inside"))


@query("select draft_id, path is null or path = '' or path like '/%' or contains(path, chr(92)) or len(list_filter(string_split(path, '/'), lambda s: s in ('', '.', '..'))) > 0 as invalid from chunk_drafts")
def p07_path_checks(spark: SparkSession, base: str) -> DataFrame:
    """Whether a path is fit to be taken relative to a root."""
    return _drafts(spark, base).select("draft_id", T.unsafe_path(F.col("path")).alias("invalid"))


@query("select chunk_id from rag_chunks where project_id in (select project_id from projects where display_name is not null) and embedding_model = 'feature-hash-64' and embedding_dimensions = 64")
def p01_scope(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of known projects in one embedding space."""
    known = read_table(spark, base, "projects").where("display_name is not null").select("project_id")
    return read_table(spark, base, "rag_chunks").where("embedding_model = 'feature-hash-64' and embedding_dimensions = 64").join(known, "project_id", "left_semi").select("chunk_id")


@query("select memory_id from memories where memory_type in ('semantic', 'episodic') and claim_status in ('verified')")
def p10_allow_lists(spark: SparkSession, base: str) -> DataFrame:
    """Records whose kind and claim are on allow lists."""
    return read_table(spark, base, "memories").where(F.col("memory_type").isin("semantic", "episodic") & F.col("claim_status").isin("verified")).select("memory_id")


@query("select chunk_id, path || ':' || start_line || '-' || end_line as citation, concat_ws(' ', symbol, array_to_string(from_json(heading_path_json, '[\"VARCHAR\"]'), ' ')) as structure from rag_chunks")
def p13_computed_columns(spark: SparkSession, base: str) -> DataFrame:
    """Citation and searchable structure of each chunk."""
    c = read_table(spark, base, "rag_chunks")
    return c.select("chunk_id", F.format_string("%s:%d-%d", "path", "start_line", "end_line").alias("citation"), F.concat_ws(" ", "symbol", F.array_join(F.from_json("heading_path_json", "array<string>"), " ")).alias("structure"))


@query("""with e as (select memory_id, generate_subscripts(x, 1) as n, unnest(x) as c from (select memory_id, regexp_extract_all(evidence_json, '[A-Za-z0-9_./-]+[.][A-Za-z0-9]+:[0-9]+(-[0-9]+)?') as x from memories)),
  p as (select memory_id, c, regexp_extract(c, '^(.*):', 1) as path, regexp_extract(c, ':([0-9]+)', 1)::int as first, coalesce(nullif(regexp_extract(c, '-([0-9]+)$', 1), ''), regexp_extract(c, ':([0-9]+)', 1))::int as last from e)
  select distinct memory_id, path, first, last from p where last >= first""")
def f13_citations(spark: SparkSession, base: str) -> DataFrame:
    """Citations in the evidence, with path and line range; ranges that run backwards are dropped."""
    c = read_table(spark, base, "memories").select("memory_id", F.explode(F.array_distinct(F.regexp_extract_all("evidence_json", F.lit("[A-Za-z0-9_./-]+[.][A-Za-z0-9]+:[0-9]+(?:-[0-9]+)?"), F.lit(0)))).alias("c"))
    p = c.select("memory_id", F.regexp_extract("c", "^(.*):", 1).alias("path"), F.regexp_extract("c", ":([0-9]+)", 1).cast("int").alias("first"), F.regexp_extract("c", "-([0-9]+)$", 1).alias("l"))
    return p.select("memory_id", "path", "first", F.when(F.col("l") == "", F.col("first")).otherwise(F.expr("try_cast(l as int)")).alias("last")).where("last >= first").distinct()


@query("select memory_id, list_concat(list_filter(x, lambda e: regexp_full_match(e, '.+:[0-9]+(-[0-9]+)?')), list_filter(x, lambda e: not regexp_full_match(e, '.+:[0-9]+(-[0-9]+)?')))[1:20] as evidence from (select memory_id, from_json(evidence_json, '[\"VARCHAR\"]') as x from memories)")
def f14_line_citations_first(spark: SparkSession, base: str) -> DataFrame:
    """Evidence with line citations in front, at most twenty pieces."""
    x = F.from_json("evidence_json", "array<string>")
    is_line = lambda e: e.rlike("^.+:[0-9]+(-[0-9]+)?$")
    return read_table(spark, base, "memories").select("memory_id", F.slice(F.concat(F.filter(x, is_line), F.filter(x, lambda e: ~is_line(e))), 1, 20).alias("evidence"))
