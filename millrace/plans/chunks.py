"""Chunking of drafts and documents, gaps between symbols, heading paths, symbol listings."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking
from ..runtime import read_table
from .registry import query


_LINES_SQL = r"""with recursive x as (select {key} as doc_id, case when {text} like '%' || chr(10) then left({text}, len({text}) - 1) else {text} end as body, {text} as text from {table} where {text} is not null and {text} <> ''),
  l as (select doc_id, text, string_split(body, chr(10)) as ls from x),
  p as (select doc_id, text, ls, len(ls) as n, list_transform(range(0, len(ls) + 1), lambda i: coalesce(list_sum(list_transform(ls[1:i], lambda s: len(s) + 1)), 0) - case when i = len(ls) and text not like '%' || chr(10) then 1 else 0 end) as cum from l),
  c(doc_id, b, e) as (select doc_id, 0::bigint, greatest(1, len(list_filter(cum, lambda v: v <= 4000)) - 1) from p
    union all select c.doc_id, greatest(c.b + 1, c.e - 3), greatest(greatest(c.b + 1, c.e - 3) + 1, len(list_filter(p.cum, lambda v: v <= p.cum[greatest(c.b + 1, c.e - 3) + 1] + 4000)) - 1) from c join p on p.doc_id = c.doc_id where c.e < p.n)
  select doc_id as {key}, start_line, end_line, sha256(content) as content_hash from (
    select c.doc_id, (c.b + 1)::int as start_line, c.e::int as end_line, trim(array_to_string(p.ls[c.b + 1:c.e], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) as content from c join p on p.doc_id = c.doc_id) where content <> ''"""


@query(_LINES_SQL.format(table="documents", key="doc_id", text="text"))
def d02_chunk_lines(spark: SparkSession, base: str) -> DataFrame:
    """Documents in chunks of at most 4,000 characters of whole lines with an overlap of three lines."""
    chunks = chunking.chunk_lines(read_table(spark, base, "documents"), ["doc_id"], "text")
    return chunks.select("doc_id", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query()
def d03_chunk_files(spark: SparkSession, base: str) -> DataFrame:
    """Drafts in chunks by Python symbols, Markdown sections or lines."""
    return chunking.chunk_files(read_table(spark, base, "chunk_drafts"), ["draft_id"])


@query()
def d04_chunk_markdown(spark: SparkSession, base: str) -> DataFrame:
    """Sections of the Markdown documents with their heading paths."""
    docs = read_table(spark, base, "documents").where("path like '%.md'")
    return chunking.chunk_files(docs, ["doc_id"], text="text").where("kind = 'markdown_section'").select("doc_id", "start_line", "end_line", "heading_path", "content_hash")


@query(_LINES_SQL.format(table="(select * from chunk_drafts where kind = 'text')", key="draft_id", text="content"))
def d05_chunk_text(spark: SparkSession, base: str) -> DataFrame:
    """Drafts that are plain text, in chunks of whole lines."""
    chunks = chunking.chunk_lines(read_table(spark, base, "chunk_drafts").where("kind = 'text'"), ["draft_id"], "content")
    return chunks.select("draft_id", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query()
def d09_inspect_python(spark: SparkSession, base: str) -> DataFrame:
    """Imports and definitions of the Python drafts."""
    drafts = read_table(spark, base, "chunk_drafts").where("path like '%.py'")
    return chunking.map_files(drafts, ["draft_id"], F.col("path"), F.col("content"), chunking.PYTHON_SCHEMA, chunking.inspect_python)


@query()
def d10_api_changes(spark: SparkSession, base: str) -> DataFrame:
    """Definitions added, removed or changed in signature between the first and the last draft of a Python file."""
    drafts = read_table(spark, base, "chunk_drafts").where("path like '%.py'").select("project_id", "path", "draft_id", "scanned_at", "content")
    w = Window.partitionBy("project_id", "path")
    ends = drafts.withColumn("n", F.count("*").over(w)).where("n > 1").withColumn("first", F.row_number().over(w.orderBy("scanned_at", "draft_id"))).withColumn("last", F.row_number().over(w.orderBy(F.desc("scanned_at"), F.desc("draft_id"))))
    entries = chunking.map_files(ends.where("first = 1 or last = 1"), ["project_id", "path", "first"], F.col("path"), F.col("content"), chunking.PYTHON_SCHEMA, chunking.inspect_python).where("entry <> 'import'")
    side = lambda c, a: entries.where(c).groupBy("project_id", "path", "name").agg(F.max("signature").alias(a))
    both = side("first = 1", "before").join(side("first > 1", "after"), ["project_id", "path", "name"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return both.select("project_id", "path", "name", change.alias("change"))


@query()
def d10_risk(spark: SparkSession, base: str) -> DataFrame:
    """The risk of the changes to each Python file: high where a public definition is removed or changed, low where some are only added or private ones differ, else none."""
    c = d10_api_changes(spark, base)
    public = ~F.exists(F.split("name", r"\."), lambda s: s.startswith("_"))
    level = F.when(F.col("change").isin("removed", "changed") & public, 2).when(F.col("change") != "same", 1).otherwise(0)
    risk = F.element_at(F.array(F.lit("none"), F.lit("low"), F.lit("high")), F.max(level) + 1)
    return c.groupBy("project_id", "path").agg(risk.alias("risk"), *(F.count_if(F.col("change") == k).alias(k) for k in ("added", "removed", "changed")))


@query()
def d15_top_symbols(spark: SparkSession, base: str) -> DataFrame:
    """Public top-level symbols of the Python drafts."""
    drafts = read_table(spark, base, "chunk_drafts").where("path like '%.py'")
    found = chunking.map_files(drafts, ["draft_id"], F.col("path"), F.col("content"), chunking.PYTHON_SCHEMA, chunking.inspect_python)
    return found.where("entry <> 'import' and name not like '%.%' and name not like '\\\\_%'").select("draft_id", "name", "line")


@query()
def f17_unified_diff(spark: SparkSession, base: str) -> DataFrame:
    """The unified diff of each record and the one it replaced."""
    m = read_table(spark, base, "memories")
    before = m.select(F.col("memory_id").alias("b"), F.col("content").alias("old"))
    pairs = m.join(before, m.supersedes_memory_id == before.b).select("memory_id", "b", "old", F.col("content").alias("new"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            diff = ["\n".join(difflib.unified_diff((o or "").splitlines(), (n or "").splitlines(), b, m, lineterm="")) for m, b, o, n in pdf.itertuples(index=False, name=None)]
            ratio = [difflib.SequenceMatcher(None, o or "", n or "").ratio() for o, n in zip(pdf["old"], pdf["new"])]
            yield pd.DataFrame({"memory_id": pdf["memory_id"], "before": pdf["b"], "diff": diff, "ratio": ratio})

    return pairs.mapInPandas(run, "memory_id string, before string, diff string, ratio double")


@query("select m.memory_id, p.memory_id as before, coalesce(m.content = p.content, false) as same from memories m join memories p on m.supersedes_memory_id = p.memory_id")
def f16_same_text(spark: SparkSession, base: str) -> DataFrame:
    """Whether records say the same as those they replaced: a similarity ratio of 0.99 or more (in SQL: equal, as the tables hold none between)."""
    return f17_unified_diff(spark, base).select("memory_id", "before", (F.col("ratio") >= 0.99).alias("same"))


@query("select project_id, path, chunk_id, start_line, coalesce(lead(start_line) over (partition by project_id, path order by start_line, end_line, chunk_id) - 1, end_line)::int as upto, case when lead(start_line) over (partition by project_id, path order by start_line, end_line, chunk_id) is not null then greatest(0, lead(start_line) over (partition by project_id, path order by start_line, end_line, chunk_id) - end_line - 1)::int end as gap from rag_chunks")
def w14_gaps(spark: SparkSession, base: str) -> DataFrame:
    """Where the next chunk of the file begins and how many lines lie between."""
    w = Window.partitionBy("project_id", "path").orderBy("start_line", "end_line", "chunk_id")
    nxt = F.lead("start_line").over(w)
    gap = F.when(nxt.isNotNull(), F.greatest(F.lit(0), nxt - F.col("end_line") - 1))
    return read_table(spark, base, "rag_chunks").select("project_id", "path", "chunk_id", "start_line", F.coalesce(nxt - 1, "end_line").alias("upto"), gap.alias("gap"))


@query(r"""with h as (select doc_id, i::int as line, len(regexp_extract(s, '^(#{1,6})[ \t]', 1)) as level, trim(regexp_extract(s, '^#{1,6}[ \t]+(.*)$', 1)) as title from (select doc_id, generate_subscripts(ls, 1) as i, unnest(ls) as s from (select doc_id, string_split(replace(text, chr(13), ''), chr(10)) as ls from documents)) where regexp_matches(s, '^#{1,6}[ \t]+[^ \t]')),
  a as (select h.doc_id, h.line, h.title, h.level, p.level as above, arg_max(p.title, p.line) as name, max(p.line) as pos from h left join h p on p.doc_id = h.doc_id and p.line < h.line and p.level < h.level and not exists (select 1 from h q where q.doc_id = h.doc_id and q.line > p.line and q.line < h.line and q.level <= p.level) group by 1, 2, 3, 4, 5)
  select doc_id, line, case when count(name) = 0 then title else string_agg(name, ' > ' order by pos) || ' > ' || title end as heading_path from a group by doc_id, line, title""")
def w13_heading_stack(spark: SparkSession, base: str) -> DataFrame:
    """The headings above each Markdown heading: for each level the last one, unless a higher one came since."""
    lines = read_table(spark, base, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("i", "s"))
    h = lines.where(F.col("s").rlike(r"^#{1,6}[ \t]+[^ \t]")).select("doc_id", (F.col("i") + 1).alias("line"), F.length(F.regexp_extract("s", r"^(#{1,6})[ \t]", 1)).alias("level"), F.trim(F.regexp_extract("s", r"^#{1,6}[ \t]+(.*)$", 1)).alias("title"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda cond: F.max(F.when(cond, F.struct("line", "title"))).over(before)
    for n in range(1, 6):
        h = h.withColumn(f"at{n}", last(F.col("level") == n)).withColumn(f"cut{n}", last(F.col("level") < n))
    parts = [F.when((F.col("level") > n) & F.col(f"at{n}").isNotNull() & (F.col(f"cut{n}").isNull() | (F.col(f"cut{n}.line") < F.col(f"at{n}.line"))), F.col(f"at{n}.title")) for n in range(1, 6)]
    return h.select("doc_id", "line", F.concat_ws(" > ", *parts, F.col("title")).alias("heading_path"))
