"""Retrieval of documents for the evaluation queries: statistics, rank lists, fusion, lookup, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import retrieval as R
from ..runtime import materialise, read_table, spread
from .registry import query

POOL, TOP = 20, 5
DIM = 64

_TOK = "[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[㐀-䶿一-鿿]+"
_CJK = "[㐀-䶿一-鿿]"
_FOLD = "replace(lower(w), 'ß', 'ss')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_BIG = f"case when regexp_matches(w, '{_CJK}') and len(w) > 1 then list_transform(range(1, len(w)), lambda i: substr(w, i, 2)) else [] end"


def _words(text: str, split: bool) -> str:
    """SQL: the folded tokens of a text, with those of the split text if asked."""
    raw = f"regexp_extract_all({text}, '{_TOK}')"
    both = f"list_concat({raw}, regexp_extract_all(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '{_TOK}'))" if split else raw
    return f"list_transform({both}, lambda w: {_FOLD})"


TERMS_SQL = f"""
  qt as (select item_id, unnest(list_slice(terms, 1, 32)) as term from (
    select item_id, list_distinct_ordered as terms from (
      select item_id, list_transform(list_sort(list_transform(list_distinct(ws), lambda x: {{'p': list_position(ws, x), 'x': x}})), lambda s: s.x) as list_distinct_ordered from (
        select item_id, flatten(list_transform(list_filter({_words('query', True)}, lambda w: w not in ({_STOP})), lambda w: list_concat([w], {_BIG}))) as ws from eval_cases))))
"""

POSTINGS_SQL = f"""
  ft as (select doc_id, 1.0::double as wt, flatten(list_transform({_words("coalesce(text, '')", False)}, lambda w: list_concat([w], {_BIG}))) as ts from documents
         union all
         select doc_id, 0.3::double, flatten(list_transform({_words("coalesce(path, '')", False)}, lambda w: list_concat([w], {_BIG}))) from documents),
  dl as (select doc_id, sum(len(ts)) as length from ft group by doc_id),
  po as (select doc_id, term, sum(wt) as f from (select doc_id, wt, unnest(ts) as term from ft) group by doc_id, term),
  tot as (select (select count(*) from documents) as n, (select sum(length) from dl) / (select count(*) from documents) as avgdl),
  dfs as (select term, count(*) as df from po group by term)
"""

BM25_SQL = f"""{TERMS_SQL}, {POSTINGS_SQL},
  sc as (select item_id, po.doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avgdl))), 6) as score
         from po join dfs using (term) join dl using (doc_id) cross join tot join qt using (term) group by item_id, po.doc_id),
  lex as (select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from sc) where rank <= {POOL})
"""

_FEATURES = f"flatten(list_transform({{words}}, lambda w: list_concat([w], case when regexp_matches(w, '{_CJK}') then list_concat(string_split(w, ''), {_BIG}) else [] end)))"
_HEX = "list_position(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], {c}) - 1"


def _vectors_sql(table: str, key: str, text: str) -> str:
    """SQL: (key, dim, x) of hashed features, scaled to length 1."""
    feats = _FEATURES.format(words=_words(f"coalesce({text}, '')", True))
    return f"""
      select {key}, dim, v / sqrt(sum(v * v) over (partition by {key})) as x from (
        select {key}, (('0x' || substr(md5(w), 1, 7))::bigint % {DIM})::int as dim,
               sum(case when ('0x' || substr(md5(w), 8, 1))::bigint % 2 = 1 then 1.0 else -1.0 end)::double as v
        from (select {key}, unnest({feats}) as w from {table}) group by 1, 2) where v <> 0"""


DENSE_SQL = f"""
  qv as ({_vectors_sql('eval_cases', 'item_id', 'query')}),
  dv as ({_vectors_sql('documents', 'doc_id', 'text')}),
  ds as (select item_id, doc_id, round(sum(qv.x * dv.x), 6) as score from qv join dv using (dim) group by item_id, doc_id),
  den as (select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from ds where score > 0) where rank <= {POOL})
"""

FUSED_SQL = f"""{BM25_SQL}, {DENSE_SQL},
  fu as (select coalesce(lex.item_id, den.item_id) as item_id, coalesce(lex.doc_id, den.doc_id) as doc_id, lex.rank as lexical_rank, den.rank as dense_rank,
                round(coalesce(1.0::double / (60 + lex.rank), 0) + coalesce(1.0::double / (60 + den.rank), 0), 6) as score
         from lex full join den on lex.item_id = den.item_id and lex.doc_id = den.doc_id),
  fr as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from fu) where rank <= {TOP})
"""

RUN = 12
QRELS_SQL = f"""
  qw as (select item_id, regexp_extract_all(lower(query), '[a-z0-9]+') as w from eval_cases),
  dw as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
  qg as (select item_id, array_to_string(w[s:s + {RUN - 1}], ' ') as run from (select item_id, w, unnest(range(1, len(w) - {RUN - 2})) as s from qw)),
  dg as (select doc_id, array_to_string(w[s:s + {RUN - 1}], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - {RUN - 2})) as s from dw)),
  qr as (select distinct item_id, doc_id from qg join dg using (run))
"""


def _documents(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "documents")


def _queries(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "eval_cases")


FIELDS = {"text": 1.0, "path": 0.3}


def _chunks(spark: SparkSession, base: str) -> DataFrame:
    return spread(_documents(spark, base).select("doc_id", *FIELDS))


def _posted(spark: SparkSession, base: str) -> DataFrame:
    return R.postings(_chunks(spark, base), "doc_id", _fields()).where("term is not null")


def _fields() -> dict:
    return {c: (F.col(c), w) for c, w in FIELDS.items()}


def _terms(spark: SparkSession, base: str) -> DataFrame:
    return _queries(spark, base).select("item_id", F.explode(T.query_terms(F.col("query"))).alias("term"))


def lexical(spark: SparkSession, base: str) -> DataFrame:
    """The BM25 rank list of every query."""
    return R.bm25_ranked(_chunks(spark, base), "doc_id", _fields(), _terms(spark, base), "item_id", POOL)


def _dense(spark: SparkSession, base: str, query_key: str, key: str) -> tuple[DataFrame, str, DataFrame, str]:
    q = R.hashed_vectors(_queries(spark, base), query_key, F.col("query"), DIM)
    d = R.hashed_vectors(spread(_documents(spark, base).select(key, "text")), key, F.col("text"), DIM)
    return q, query_key, d, key


def dense(spark: SparkSession, base: str) -> DataFrame:
    """The cosine rank list of every query."""
    return R.dense_ranked(*_dense(spark, base, "item_id", "doc_id"), POOL)


def fused(spark: SparkSession, base: str, top: int = TOP) -> DataFrame:
    """The fused rank list of every query."""
    return R.fuse(lexical(spark, base), dense(spark, base), "item_id", "doc_id", top)


def qrels(spark: SparkSession, base: str) -> DataFrame:
    """(item_id, doc_id): documents that hold 12 consecutive words of a query."""
    words = F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]+"), F.lit(0))
    q = _queries(spark, base).select("item_id", words.alias("w")).where(F.size("w") >= RUN)
    runs = q.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - RUN + 1), lambda i: F.array_join(F.slice("w", i, F.lit(RUN)), " "))).alias("run")).distinct()
    return R.runs_held(spread(_documents(spark, base).select("doc_id", "text")), "doc_id", F.col("text"), runs, RUN).select("item_id", "doc_id")


@query(f"with {POSTINGS_SQL} select dfs.term, df::bigint as df, round(sum(f), 6) as weight from dfs join po using (term) group by dfs.term, df")
def a03_corpus_statistics(spark: SparkSession, base: str) -> DataFrame:
    """Document frequency and weighted frequency of every term."""
    return _posted(spark, base).groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("f"), 6).alias("weight"))


@query(f"with {TERMS_SQL} select item_id, term from qt")
def f03_query_terms(spark: SparkSession, base: str) -> DataFrame:
    """The terms of every query."""
    return _terms(spark, base)


@query(f"with {TERMS_SQL}, {POSTINGS_SQL} select item_id, count(*)::bigint as matches from qt join po using (term) group by item_id")
def j17_terms_to_postings(spark: SparkSession, base: str) -> DataFrame:
    """Postings met by the terms of every query."""
    terms = _terms(spark, base)
    return _posted(spark, base).join(terms, "term").groupBy("item_id").agg(F.count("*").alias("matches"))


@query(f"with {BM25_SQL} select item_id, doc_id, score, rank::int as rank from lex")
def w01_bm25(spark: SparkSession, base: str) -> DataFrame:
    """BM25 rank lists."""
    return lexical(spark, base)


@query(f"with {DENSE_SQL} select item_id, doc_id, score, rank::int as rank from den")
def w02_cosine(spark: SparkSession, base: str) -> DataFrame:
    """Cosine rank lists over hashed features."""
    return dense(spark, base)


@query(f"with {FUSED_SQL} select item_id, doc_id, lexical_rank::int as lexical_rank, dense_rank::int as dense_rank, score, rank::int as rank from fr")
def w03_rrf(spark: SparkSession, base: str) -> DataFrame:
    """Both rank lists fused by reciprocal ranks: the flagship."""
    return fused(spark, base)


@query(f"with {BM25_SQL}, {DENSE_SQL} select coalesce(lex.item_id, den.item_id) as item_id, coalesce(lex.doc_id, den.doc_id) as doc_id, lex.rank::int as lexical_rank, den.rank::int as dense_rank from lex full join den on lex.item_id = den.item_id and lex.doc_id = den.doc_id")
def j02_rank_lists(spark: SparkSession, base: str) -> DataFrame:
    """Candidates of either ranker with both ranks."""
    lex, den = lexical(spark, base), dense(spark, base)
    return lex.select("item_id", "doc_id", F.col("rank").alias("lexical_rank")).join(den.select("item_id", "doc_id", F.col("rank").alias("dense_rank")), ["item_id", "doc_id"], "full_outer")


@query(f"with {FUSED_SQL} select item_id, rank::int as rank, doc_id, path || ':1-' || (len(text) - len(replace(text, chr(10), '')) + 1) as citation from fr join documents using (doc_id)")
def j03_hydrate(spark: SparkSession, base: str) -> DataFrame:
    """Fused ids joined with the wide rows only at the end, with their citations."""
    wide = _documents(spark, base).select("doc_id", F.concat("path", F.lit(":1-"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("string")).alias("citation"))
    return fused(spark, base).select("item_id", "rank", "doc_id").join(wide, "doc_id").select("item_id", "rank", "doc_id", "citation")


@query(f"with {BM25_SQL}, {DENSE_SQL} select item_id, doc_id from lex union select item_id, doc_id from den")
def u01_candidate_union(spark: SparkSession, base: str) -> DataFrame:
    """The union of both candidate lists."""
    return lexical(spark, base).select("item_id", "doc_id").union(dense(spark, base).select("item_id", "doc_id")).distinct()


@query(f"with {QRELS_SQL} select item_id, doc_id from qr")
def j06_relevant(spark: SparkSession, base: str) -> DataFrame:
    """Which documents are relevant for which query."""
    return qrels(spark, base)


_METRICS_SQL = f"""{FUSED_SQL}, {QRELS_SQL},
  tot2 as (select item_id, count(*) as relevant from qr group by item_id),
  hit as (select fr.item_id, count(*) as hits, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from fr join qr on fr.item_id = qr.item_id and fr.doc_id = qr.doc_id group by fr.item_id),
  per as (select item_id, relevant, coalesce(hits, 0) as hits, coalesce(hits / relevant, 0) as recall, coalesce(1 / first, 0) as reciprocal_rank, case when hits > 0 then 1 else 0 end as hit,
                 coalesce(dcg / list_sum(list_transform(range(1, least(relevant, {TOP}) + 1), lambda r: 1 / log2(r + 1))), 0) as ndcg
          from tot2 left join hit using (item_id))
"""


def _metrics(spark: SparkSession, base: str) -> DataFrame:
    return R.retrieval_metrics(fused(spark, base), qrels(spark, base), "item_id", "doc_id", TOP)


@query(f"with {_METRICS_SQL} select item_id, relevant::bigint as relevant, hits::bigint as hits, round(recall, 6) as recall, round(reciprocal_rank, 6) as reciprocal_rank, hit::int as hit, round(ndcg, 6) as ndcg from per")
def a07_metrics_per_query(spark: SparkSession, base: str) -> DataFrame:
    """Recall, reciprocal rank, hit and nDCG of every query with relevant documents."""
    return _metrics(spark, base).select("item_id", "relevant", "hits", *(F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank")), "hit", F.round("ndcg", 6).alias("ndcg"))


@query(f"with {_METRICS_SQL} select count(*)::bigint as cases, round(avg(recall), 6) as mean_recall, round(avg(reciprocal_rank), 6) as mrr from per")
def a05_recall_mrr(spark: SparkSession, base: str) -> DataFrame:
    """Mean recall and mean reciprocal rank."""
    return _metrics(spark, base).agg(F.count("*").alias("cases"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


_FUSED10_SQL = FUSED_SQL.replace(f"where rank <= {TOP})", "where rank <= 10)")
_AT_SQL = """
  select {k} as k, item_id, coalesce(hits, 0) / relevant as recall, coalesce(1 / first, 0) as reciprocal_rank, case when hits > 0 then 1 else 0 end as hit,
         coalesce(dcg / list_sum(list_transform(range(1, least(relevant, {k}) + 1), lambda r: 1 / log2(r + 1))), 0) as ndcg
  from tot2 left join (select fr.item_id, count(*) as hits, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from fr join qr on fr.item_id = qr.item_id and fr.doc_id = qr.doc_id where rank <= {k} group by fr.item_id) using (item_id)"""


@query(f"""with {_FUSED10_SQL}, {QRELS_SQL}, tot2 as (select item_id, count(*) as relevant from qr group by item_id), per as ({_AT_SQL.format(k=5)} union all {_AT_SQL.format(k=10)})
  select k, suite, count(*)::bigint as cases, round(avg(recall), 6) as recall, round(avg(reciprocal_rank), 6) as mrr, round(avg(hit), 6) as hit_rate, round(avg(ndcg), 6) as ndcg from per join eval_cases using (item_id) group by grouping sets ((k, suite), (k))""")
def a06_metrics_by_suite(spark: SparkSession, base: str) -> DataFrame:
    """Metrics at 5 and at 10 for each suite and over all, by grouping sets over one ranking."""
    ranking, rel = materialise(fused(spark, base, 10)), materialise(qrels(spark, base))
    at = lambda k: R.retrieval_metrics(ranking, rel, "item_id", "doc_id", k).withColumn("k", F.lit(k))
    per = at(5).unionByName(at(10)).join(_queries(spark, base).select("item_id", "suite"), "item_id")
    return per.groupingSets([["k", "suite"], ["k"]], "k", "suite").agg(F.count("*").alias("cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query(f"with {FUSED_SQL}, {QRELS_SQL} select fr.item_id, min(rank)::int as first_rank from fr join qr on fr.item_id = qr.item_id and fr.doc_id = qr.doc_id group by fr.item_id")
def a21_first_relevant(spark: SparkSession, base: str) -> DataFrame:
    """The rank of the first relevant document of every query that has one."""
    return fused(spark, base).join(qrels(spark, base), ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("first_rank"))


@query(f"with {BM25_SQL}, {DENSE_SQL}, e as (select item_id, list(doc_id) as x from den group by item_id), l as (select item_id, list(doc_id) as y from lex group by item_id) select round(avg(len(list_intersect(x, coalesce(y, []))) / len(x)), 6) as mean_overlap from e left join l using (item_id)")
def a10_list_recall(spark: SparkSession, base: str) -> DataFrame:
    """The mean share of an exact list that another list has too."""
    exact = dense(spark, base).groupBy("item_id").agg(F.collect_set("doc_id").alias("x"))
    other = lexical(spark, base).groupBy("item_id").agg(F.collect_set("doc_id").alias("y"))
    share = F.size(F.array_intersect("x", F.coalesce("y", F.array().cast("array<bigint>")))) / F.size("x")
    return exact.join(other, "item_id", "left").agg(F.round(F.avg(share), 6).alias("mean_overlap"))


@query(f"""with {DENSE_SQL}, sg as (select item_id, doc_id, sum(sign(qv.x) * sign(dv.x)) as agree from qv join dv using (dim) group by item_id, doc_id),
  cand as (select * from (select item_id, doc_id, row_number() over (partition by item_id order by agree desc, doc_id) as r from sg where agree > 0) where r <= 100),
  ap as (select * from (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rank from cand join ds using (item_id, doc_id) where score > 0) where rank <= {POOL}),
  e as (select item_id, list(doc_id) as x from den group by item_id), l as (select item_id, list(doc_id) as y from ap group by item_id)
  select round(avg(len(list_intersect(x, coalesce(y, []))) / len(x)), 6) as ann_recall from e left join l using (item_id)""")
def a10_ann_recall(spark: SparkSession, base: str) -> DataFrame:
    """The mean share of the exact cosine list that an approximate search finds: by agreement of signs, then the best 100 exactly."""
    q, query_key, d, key = _dense(spark, base, "item_id", "doc_id")
    q, d = materialise(q), materialise(d)
    exact = R.dense_ranked(q, query_key, d, key, POOL).groupBy("item_id").agg(F.collect_set("doc_id").alias("x"))
    near = R.sign_ranked(q, query_key, d, key, POOL, 100).groupBy("item_id").agg(F.collect_set("doc_id").alias("y"))
    share = F.size(F.array_intersect("x", F.coalesce("y", F.array().cast("array<bigint>")))) / F.size("x")
    return exact.join(near, "item_id", "left").agg(F.round(F.avg(share), 6).alias("ann_recall"))


_SIM = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query("with v as (select vec_id, label, embedding::double[] as e from embeddings), c as (select label, list(x order by k) as centre from (select label, k, avg(e[k]) as x from (select label, e, unnest(range(1, len(e) + 1)) as k from v) group by label, k) group by label)"
       f" select vec_id, c.label, round({_SIM.format(a='e', b='centre')}, 6) as cosine from v cross join c")
def j16_vectors_to_centres(spark: SparkSession, base: str) -> DataFrame:
    """Every vector against the mean vectors of the labels, which go to the tasks in blocks however many they are."""
    v = read_table(spark, base, "embeddings")
    each = v.select("label", F.posexplode("embedding").alias("k", "x"))
    centres = each.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centre"))
    units = lambda df, key, c: df.select(key, V.unit(F.col(c)).alias("vec"))
    return R.dense_pairs(units(centres, "label", "centre"), "label", units(v, "vec_id", "embedding"), "vec_id").select("vec_id", "label", F.col("score").alias("cosine"))


@query(f"with v as (select chunk_id, embedding::double[] as e, len(embedding) as dims from rag_chunks where embedding is not null) select chunk_id, dims::int as dims, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) as norm, round(coalesce(list_sum(list_transform(e, lambda x: x * x)), 0), 6) as square from v")
def a04_norms(spark: SparkSession, base: str) -> DataFrame:
    """Lengths of the stored vectors."""
    v = read_table(spark, base, "rag_chunks").where("embedding is not null")
    return v.select("chunk_id", F.size("embedding").alias("dims"), F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("square"))


@query("select chunk_id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.12g}', x::double)), ',') || ']' as literal from rag_chunks where embedding is not null")
def f35_vector_literals(spark: SparkSession, base: str) -> DataFrame:
    """The stored vectors as texts."""
    return read_table(spark, base, "rag_chunks").where("embedding is not null").select("chunk_id", V.literal(F.col("embedding")).alias("literal"))


@query("select chunk_id from rag_chunks where embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0")
def p09_nonzero_vectors(spark: SparkSession, base: str) -> DataFrame:
    """Chunks whose vector is not all zero."""
    return read_table(spark, base, "rag_chunks").where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("chunk_id")


@query(f"with {DENSE_SQL} select item_id, count(*)::bigint as positive from ds where score > 0 group by item_id")
def p08_positive_similarity(spark: SparkSession, base: str) -> DataFrame:
    """How many documents have a positive similarity to each query."""
    return R.dense_positive(*_dense(spark, base, "item_id", "doc_id"))


@query(f"with {FUSED_SQL} select item_id, doc_id, score from (select *, row_number() over (order by score desc, item_id, doc_id) as r from fu) where r <= 50")
def t01_top_k(spark: SparkSession, base: str) -> DataFrame:
    """The 50 best pairs of query and document over all queries."""
    lex, den = lexical(spark, base), dense(spark, base)
    return R.fuse(lex, den, "item_id", "doc_id", 2 * POOL).orderBy(F.desc("score"), "item_id", "doc_id").limit(50).select("item_id", "doc_id", "score")


@query()
def f32_feature_hash(spark: SparkSession, base: str) -> DataFrame:
    """Signed feature hashing of every document by BLAKE2b."""
    return V.feature_hash(_documents(spark, base), "doc_id", T.features(F.coalesce("text", F.lit(""))), 256)


@query(_vectors_sql("documents", "doc_id", "text").replace("as x from", "as x0 from").replace("select doc_id, dim, v", "select doc_id, dim, round(v", 1).replace("(partition by doc_id)) as x0", "(partition by doc_id)), 6) as x", 1))
def f34_unit_vectors(spark: SparkSession, base: str) -> DataFrame:
    """Hashed features scaled to length 1, in the sparse form."""
    each = R.hashed_vectors(spread(_documents(spark, base).select("doc_id", "text")), "doc_id", F.col("text"), DIM).select("doc_id", F.posexplode("vec").alias("dim", "x"))
    return each.where("x <> 0").withColumn("x", F.round("x", 6))
