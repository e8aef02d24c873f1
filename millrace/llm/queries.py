"""Queries over the test tables, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read_table
from . import credentials, leakage, neardup, packing, provenance, quality, splitting, syntax, vectors


def _vectors(spark: SparkSession, base: str, kind: str) -> DataFrame:
    if kind == "chunk":
        return vectors.unit_vectors(read_table(spark, base, "rag_chunks"), "chunk_id", "embedding_model", F.col("embedding"))
    return vectors.unit_vectors(read_table(spark, base, "memories"), "memory_id", "embedding_model", F.col("embedding_json"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of vectors of which one is among the other's 5 most similar, with a cosine of 0.90 or more."""
    out = None
    for kind in ("chunk", "memory"):
        near = vectors.similar_pairs(_vectors(spark, base, kind), k=5, min_cos=0.90)
        near = near.select(F.lit(kind).alias("vector_of"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
        out = near if out is None else out.unionByName(near)
    return out.distinct()


def p1_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """For every chunk vector its 5 most similar ones, ranked."""
    return vectors.nearest_vectors(_vectors(spark, base, "chunk"), k=5).select("id", "other", F.round("cosine", 3).alias("cosine"), "rank")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Lines of drafts on which a literal credential begins."""
    found = credentials.credentials(read_table(spark, base, "chunk_drafts"), "draft_id", "content", "path")
    return found.select(F.col("id").alias("draft_id"), "line_no").distinct()


def p2_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Drafts with their credentials redacted."""
    drafts = read_table(spark, base, "chunk_drafts").select("draft_id", "path", "content")
    return credentials.redact_credentials(drafts, "content", "path").where("not (redacted <=> content)").select("draft_id", "path", "redacted")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Drafts that were not written by hand."""
    found = provenance.not_handwritten(read_table(spark, base, "chunk_drafts"), "draft_id", "project_id", "path", "content")
    return found.select(F.col("id").alias("draft_id")).distinct()


def p3_kinds(spark: SparkSession, base: str) -> DataFrame:
    """Drafts that were not written by hand, with kind and reason."""
    found = provenance.not_handwritten(read_table(spark, base, "chunk_drafts"), "draft_id", "project_id", "path", "content")
    return found.withColumnRenamed("id", "draft_id").distinct()


def _live_memories(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "memories").where("not (status <=> 'forgotten')")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of memories, none forgotten, whose words agree by 0.8 or more."""
    pairs = neardup.near_duplicate_pairs(_live_memories(spark, base), "memory_id", "content", 0.8)
    return pairs.select(F.col("id_a").alias("memory_id_a"), F.col("id_b").alias("memory_id_b"))


def p4_groups(spark: SparkSession, base: str) -> DataFrame:
    """For every memory its class of copies, the links of the class and the group that tells the same."""
    return neardup.near_duplicate_groups(_live_memories(spark, base), "memory_id", "content", 0.8)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Drafts whose content is over the limit."""
    pieces = splitting.split_items(read_table(spark, base, "chunk_drafts"), "draft_id", "content", "start_line")
    return pieces.select(F.col("id").cast("bigint").alias("draft_id")).distinct()


def p5_pieces(spark: SparkSession, base: str) -> DataFrame:
    """The pieces of all oversized drafts."""
    pieces = splitting.split_items(read_table(spark, base, "chunk_drafts"), "draft_id", "content", "start_line")
    return pieces.withColumn("id", F.col("id").cast("bigint")).withColumnRenamed("id", "draft_id")


def _flags(spark: SparkSession, base: str, *keep: str) -> DataFrame:
    return syntax.syntax_flags(read_table(spark, base, "chunk_drafts"), "draft_id", "path", "content", *keep)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Drafts that don't parse as what the extension of their path says."""
    return _flags(spark, base).where("checked and not valid").select(F.col("id").alias("draft_id")).distinct()


def p6_rates(spark: SparkSession, base: str) -> DataFrame:
    """Rates of broken files by project and language."""
    rates = syntax.syntax_rates(_flags(spark, base, "project_id", "language"), "project_id", "language")
    return rates.withColumn("broken_rate", F.round("broken_rate", 6))


def p7_packed(spark: SparkSession, base: str) -> DataFrame:
    """Documents in containers of 4,096 tokens."""
    sizes = packing.token_counts(read_table(spark, base, "documents"), "doc_id", "text")
    return packing.pack(sizes, capacity=4096).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that hold 15 consecutive words of an evaluation item."""
    return leakage.leaked_items(read_table(spark, base, "documents"), read_table(spark, base, "eval_cases"))


def _quality(spark: SparkSession, base: str) -> DataFrame:
    return quality.outlier_scores(read_table(spark, base, "documents"), "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents in which less than half of the characters stand in running sentences."""
    return quality.unnatural(_quality(spark, base)).select("doc_id").distinct()


def p9_statistics(spark: SparkSession, base: str) -> DataFrame:
    """All statistics and the outlier score of every document."""
    return _quality(spark, base).select("doc_id", "lang", *(F.round(s, 9).alias(s) for s in quality.STATISTICS), F.round("outlier_score", 6).alias("outlier_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this package by name."""
    found = [p1_found, p1_neighbours, p2_found, p2_redacted, p3_found, p3_kinds, p4_found, p4_groups, p5_found, p5_pieces, p6_found, p6_rates, p7_packed, p8_found, p9_found, p9_statistics]
    return {f.__name__: f for f in found}


_PAIRS = """
select distinct '{kind}' as vector_of, least(a, b) as id_a, greatest(a, b) as id_b from (
  select x.id as a, y.id as b, list_cosine_similarity(x.v, y.v) as s,
         row_number() over (partition by x.id order by list_cosine_similarity(x.v, y.v) desc, y.id) as r
  from {name} x join {name} y on x.model = y.model and x.id <> y.id)
where r <= 5 and s >= 0.9
"""

_VECTORS = """
select distinct id, model, v from (select {id} as id, embedding_model as model, {vector} as v from {table})
where v is not null and len(v) = 64 and list_sum(list_transform(v, lambda e: abs(e))) > 0 and not isnan(list_sum(v)) and model is not null
"""


def oracle_sql() -> dict[str, str]:
    """SQL over the whole tables for the queries that SQL can express."""
    chunk = _VECTORS.format(id="chunk_id", vector="cast(embedding as double[])", table="rag_chunks")
    memory = _VECTORS.format(id="memory_id", vector="try_cast(embedding_json as double[])", table="memories")
    return {
        "p1_found": f"with c as ({chunk}), m as ({memory}) {_PAIRS.format(kind='chunk', name='c')} union {_PAIRS.format(kind='memory', name='m')}",
        "p1_neighbours": f"""with c as ({chunk})
            select id, other, round(round(s, 6), 3) as cosine, rank::int as rank from (
              select x.id, y.id as other, list_cosine_similarity(x.v, y.v) as s, row_number() over (partition by x.id order by round(list_cosine_similarity(x.v, y.v), 6) desc, y.id) as rank
              from c x join c y on x.model = y.model and x.id <> y.id) where rank <= 5""",
        "p4_found": r"""
            with d as (select memory_id as id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from memories where status is distinct from 'forgotten' and memory_id is not null),
                 n as (select id, len(w) as n from d where len(w) > 0),
                 c as (select id, word, count(*) as c from (select id, unnest(w) as word from d) group by id, word),
                 p as (select x.id as a, y.id as b, sum(least(x.c, y.c)) as common from c x join c y on x.word = y.word and x.id < y.id group by x.id, y.id)
            select a as memory_id_a, b as memory_id_b from p join n na on na.id = a join n nb on nb.id = b
            where common >= 0.8 * greatest(na.n, nb.n) - 1e-9""",
        "p5_found": "select distinct draft_id from chunk_drafts where length(content) > 4000",
        "p8_found": r"""
            with d as (select doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
                 e as (select item_id as id, regexp_extract_all(lower(query), '[\p{L}\p{N}]+') as w from eval_cases),
                 dg as (select id, array_to_string(w[s:s + 14], ' ') as g from (select id, w, unnest(range(1, len(w) - 13)) as s from d)),
                 eg as (select id, array_to_string(w[s:s + 14], ' ') as g from (select id, w, unnest(range(1, len(w) - 13)) as s from e))
            select distinct dg.id as doc_id, eg.id as item_id from dg join eg on dg.g = eg.g""",
    }
