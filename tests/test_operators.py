"""Operators of the core against brute force and small fixtures."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import runtime
from millrace.functions import ports as P
from millrace.functions import records as N
from millrace.functions import text as T
from millrace.functions import vector as V
from millrace.operators import chunking, packing, tables
from millrace.operators import retrieval as R
from millrace.operators.graph import connected_components
from millrace.operators.retrieval import fuse, nearest_rank, retrieval_metrics


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_query_terms_of_english_text(spark):
    got = one(spark, T.query_terms(F.col("q")), q="Where is the HybridSearch of parse_path defined")
    assert got == ["hybridsearch", "parse_path", "hybrid", "search"]


def test_query_terms_of_chinese_text(spark):
    assert one(spark, T.query_terms(F.col("q")), q="混合检索") == ["混合检索", "混合", "合检", "检索"]


@pytest.mark.parametrize("text,tokens", [("", 1), ("abcd", 1), ("abcde", 2), ("中文ab", 3)])
def test_estimated_tokens(spark, text, tokens):
    assert one(spark, T.estimated_tokens(F.col("t")), t=text) == tokens == packing.count_tokens(text)


def test_glob_and_path_checks(spark):
    rows = spark.createDataFrame([("src/a.py",), ("a.py",), ("docs/a.md",), ("../x",), ("/etc",), ("",), (None,)], "p string")
    got = rows.select("p", T.glob_match(F.col("p"), "*.py").alias("g"), T.unsafe_path(F.col("p")).alias("u")).collect()
    assert [r.g for r in got][:3] == [True, True, False]
    assert [r.u for r in got] == [False, False, False, True, True, True, True]


def test_feature_hash_matches_its_definition(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "id int, w array<string>")
    got = {r.id: r.embedding for r in V.feature_hash(df, "id", F.col("w"), 32).collect()}
    want = [0.0] * 32
    for w in ["a", "b", "a"]:
        d = hashlib.blake2b(w.encode(), digest_size=16).digest()
        want[int.from_bytes(d[:8], "big") % 32] += 1 if d[8] & 1 else -1
    n = math.sqrt(sum(x * x for x in want))
    assert got[1] == pytest.approx([x / n for x in want])
    assert got[2] == [0.0] * 32


def test_cosine_of_zero_and_unequal_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and got[1] == 0.0 and got[2] is None


def test_nearest_rank_is_half_even(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3, 3]], "v double")
    values = sorted([5, 1, 4, 2, 3, 3])
    r = nearest_rank(df, "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (r.p50, r.p90, r.samples) == (values[round(5 * 0.5)], values[round(5 * 0.9)], 6)


def test_fusion_with_one_ranker_keeps_its_order(spark):
    lex = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    den = spark.createDataFrame([(1, 12, 1)], "q int, d int, rank int")
    got = [(r.d, r.lexical_rank, r.dense_rank) for r in fuse(lex, den, "q", "d", 5, dense_weight=0.0).orderBy("rank").collect()]
    assert got == [(10, 1, None), (11, 2, None), (12, None, 1)]


def test_metrics_without_hits_are_zero(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    qrels = spark.createDataFrame([(1, 11), (2, 5)], "q int, d int")
    got = {r.q: r for r in retrieval_metrics(ranking, qrels, "q", "d", 5).collect()}
    assert got[1].recall == 1.0 and got[1].reciprocal_rank == 0.5 and got[1].ndcg == pytest.approx(1 / math.log2(3))
    assert got[2].recall == got[2].ndcg == 0.0 and got[2].hit == 0


def test_reindexing_an_unchanged_corpus_writes_nothing(spark):
    rows = spark.createDataFrame([("a", "h1"), ("b", None)], "path string, hash string")
    change = tables.diff(rows, rows, ["path"], "hash")
    assert {r.change for r in change.collect()} == {"unchanged"}


def test_diff_upsert_delete(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {(r.path, r.change) for r in tables.diff(old, new, ["path"], "hash").collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "added")}
    assert {tuple(r) for r in tables.upsert(old, new, ["path"]).collect()} == {("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")}
    assert {tuple(r) for r in tables.upsert(old, new, ["path"], replace=False).collect()} == {("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")}
    assert {r.path for r in tables.delete(old, new, ["path"]).collect()} == {"c"}


def test_cache_computes_only_misses(spark):
    requests = spark.createDataFrame([("x",), ("y",), ("y",)], "key string")
    cache = spark.createDataFrame([("x", "old")], "key string, value string")
    answers, filled = tables.through_cache(requests, cache, "key", lambda m: m.select("key", F.lit("new").alias("value")))
    assert sorted(tuple(r) for r in answers.collect()) == [("x", "old"), ("y", "new"), ("y", "new")]
    assert filled.count() == 2


def test_connected_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 11), (None, 5), (4, 3)], "a int, b int")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int")
    assert {r.component for r in connected_components(edges).collect()} == {0}


PY = '''"""Doc."""
A = 1

@decorated
def first(x):
    return x

B = 2

class Second:
    pass

C = 3
'''


def test_python_chunks_keep_the_text_between_symbols():
    got = [(k, a, b, s) for k, _, a, b, _, _, s, _ in chunking.chunk_file("m.py", PY, 4000, 3)]
    assert got == [("python_module", 1, 3, None), ("python_symbol", 4, 6, "first"), ("python_module", 7, 9, None), ("python_symbol", 10, 11, "Second"), ("python_module", 12, 13, None)]


def test_broken_python_falls_back_to_text():
    assert [c[:2] for c in chunking.chunk_file("m.py", "def f(:\n", 4000, 3)] == [("text", "python")]


def test_markdown_heading_paths():
    text = "intro\n# A\nx\n## B\ny\n# C\nz\n"
    assert [(c[2], c[3], c[7]) for c in chunking.chunk_file("a.md", text, 4000, 3)] == [(1, 1, []), (2, 3, ["A"]), (4, 5, ["A", "B"]), (6, 7, ["C"])]


def test_line_spans_always_advance():
    assert list(chunking.line_spans([10, 500, 10], 0, 3, 100, 3)) == [(0, 1), (1, 2), (2, 3)]
    assert list(chunking.line_spans([10] * 10, 0, 10, 50, 3)) == [(0, 5), (2, 7), (4, 9), (6, 10)]


def test_one_very_long_line_is_one_chunk():
    assert [(a, b) for _, _, a, b, *_ in chunking.chunk_file("a.txt", "x" * 20_001, 4000, 3)] == [(1, 1)]


def packets(spark, rows):
    return spark.createDataFrame(rows, "g int, packet_id string, content string, priority int, mandatory boolean, source_rank int, created_at timestamp, position int, dedupe_key string")


def test_packing_accounts_for_every_packet(spark):
    rows = [(1, f"p{i}", f"text number {i} " * 20, 50 - i, False, 7, None, i, None) for i in range(10)]
    rows.append((1, "dup", "text   NUMBER 0 " * 20, 1, False, 7, None, 99, None))
    rows.append((1, "must", "always here", 1, True, 0, None, 100, None))
    got = {r.packet_id: r for r in packing.pack_context(packets(spark, rows), "g", 200).collect()}
    assert len(got) == 12 and got["dup"].reason == "duplicate" and got["must"].reason == "included"
    assert sum(r.tokens for r in got.values() if r.included) <= 200
    assert {r.reason for r in got.values()} <= {"included", "compressed", "duplicate", "budget_exceeded"}


def test_mandatory_packets_over_the_budget(spark):
    got = packing.pack_context(packets(spark, [(1, "a", "x" * 400, 1, True, 0, None, 1, None), (1, "b", "y", 1, False, 1, None, 2, None)]), "g", 50).collect()
    assert {(r.packet_id, r.reason) for r in got} == {("a", "mandatory_over_budget"), ("b", "mandatory_over_budget")}


def test_large_evidence_is_compressed_within_budget():
    content = "abcd " * 1600
    short = packing.keep_head_and_tail(content, 300)
    assert short is not None and packing.count_tokens(short) <= 300 and "left out" in short and short.startswith("abcd") and short.endswith("abcd ")


def test_components_are_whole_or_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(chain).collect()} == {(i, 0) for i in range(41)}
    with pytest.raises(RuntimeError):
        connected_components(chain, rounds=1)


def test_listing_bounds_and_flag(spark):
    rows = spark.createDataFrame([("p", "a/b/c/d.py", 1), ("p", "a/x.py", 2), ("p", "y.md", 3), ("q", "z.md", 4)], "g string, path string, n long")
    got = {(r.g, r.entry, r.is_folder, r.limit_reached) for r in tables.listing(rows, "g", "path", "n", 1, 3).collect()}
    assert got == {("p", "a", True, False), ("p", "a/x.py", False, False), ("p", "y.md", False, False), ("q", "z.md", False, False)}
    assert {(r.entry, r.limit_reached) for r in tables.listing(rows.where("g = 'p'"), "g", "path", "n", 20, 2).collect()} == {("a", True), ("a/b", True)}
    assert [r.entry for r in tables.listing(rows, "g", "path", "n", 20, 50, "*.md").orderBy("entry").collect()] == ["y.md", "z.md"]
    with pytest.raises(ValueError):
        tables.listing(rows, "g", "path", "n", 21, 1)


def test_bounded_scan_fails_at_one_more(spark):
    assert tables.bounded(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        tables.bounded(spark.range(4), 3)


def test_first_rows_tell_of_more(spark):
    assert [(r.id, r.limit_reached) for r in tables.first_rows(spark.range(9), ["id"], 2).orderBy("id").collect()] == [(0, True), (1, True)]
    assert [r.limit_reached for r in tables.first_rows(spark.range(2), ["id"], 2).collect()] == [False, False]


def test_numbers_in_order_over_partitions(spark):
    got = tables.numbered(spark.range(1000).select((F.lit(999) - F.col("id")).alias("v")), ["v"], "i").collect()
    assert sorted((r.v, r.i) for r in got) == [(k, k) for k in range(1000)]


def test_nearest_rank_over_many_values_and_null_groups(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise("a").cast("string").alias("g"), (F.col("id") % 997).alias("v"))
    got = {r.g: (r.p, r.samples) for r in nearest_rank(df, "v", {"p": 0.95}, "g").collect()}
    for g, odd in (("a", 1), (None, 0)):
        values = sorted(i % 997 for i in range(5000) if i % 2 == odd)
        assert got[g] == (values[round((len(values) - 1) * 0.95)], len(values))


def test_terms_of_batches_are_those_of_columns(spark):
    texts = ["parseTree2Node of HTTPServer 混合检索x _a9B", "", None, "a a a.b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {(r.k, r.term): r.f for r in R.postings(df, "k", {"t": (F.col("t"), 2.0)}).where("term is not null").collect()}
    want = {}
    for r in df.select("k", T.with_bigrams(F.transform(T.tokens(F.coalesce("t", F.lit(""))), T.casefold)).alias("w")).collect():
        for w in r.w:
            want[r.k, w] = want.get((r.k, w), 0) + 2.0
    assert got == want
    for t in texts[:2]:
        words = df.where(F.col("t") == t).select(T.features(F.col("t")).alias("f")).first().f
        assert sorted(words) == sorted(f for w in T.TOKENS.findall(t) for f in T.word_features(w))


def test_terms_beyond_what_is_sent_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, None)], "d int, t string")
    terms = spark.createDataFrame([(7, "alpha"), (7, "gamma"), (8, "delta")], "q int, term string")
    run = lambda **k: {(r.q, r.d, r.score, r["rank"]) for r in R.bm25_ranked(docs, "d", {"t": (F.col("t"), 1.0)}, terms, "q", 5, **k).collect()}
    sent = run()
    assert run(block=1) == sent and {(q, d) for q, d, *_ in sent} == {(7, 1), (7, 2)}
    grouped = lambda df, **g: df.withColumn("g", F.when(F.col(df.columns[0]) == list(g.values())[0], "x").otherwise("y"))
    within = lambda: {(r.q, r.d) for r in R.bm25_ranked(grouped(docs, d=1), "d", {"t": (F.col("t"), 1.0)}, grouped(terms, q=8).union(terms.where("q = 7").selectExpr("8 as q", "term", "'x' as g")), "q", 5, "g").collect()}
    assert within() == {(7, 2), (8, 1)}
    monkeypatch.setattr(R, "SENT_TERMS", 1)
    assert run() == sent and within() == {(7, 2), (8, 1)}


def test_dense_ranking_against_brute_force(spark):
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(np.round(rng.normal(size=(n, 8)), 1) + 0.01)
    q, d = unit(11), unit(700)
    d[5] = d[9]
    qs = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(q)], "q int, vec array<double>, g int")
    ds = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(d)], "d int, vec array<double>, g int")
    for group in (None, "g"):
        got = {(r.q, r.d, r["rank"]) for r in R.dense_ranked(qs, "q", ds, "d", 6, group).collect()}
        want = set()
        for i in range(11):
            order = sorted((-round(float(q[i] @ d[j]), 6), j) for j in range(700) if not group or i % 2 == j % 2)
            want |= {(i, j, k + 1) for k, (s, j) in enumerate(order[:6]) if s < 0}
        assert got == want
    blocks = R.dense_map(qs, "q", ds, "d", "n bigint", lambda ids, scores: iter([pd.DataFrame({"n": [len(ids) * sum(len(k) for k, _ in scores)]})]), block=4)
    assert blocks.agg(F.sum("n")).first()[0] == 11 * 700


def test_json_by_structure(spark):
    text = '{"_meta": 1, "a": [{"_meta": {"x": 2}, "b": {"_meta": 0, "c": 3}}], "d": "_meta"}'
    schema = '{"title": "T", "type": "object", "properties": {"title": {"type": "string", "description": "d", "default": 1}}, "enum": [{"title": 1}], "required": ["title"]}'
    df = spark.createDataFrame([(text, schema, "[[1], 2]"), (None, "no json", "5")], "t string, s string, n string")
    rows = df.select(N.without_key(F.col("t"), "_meta").alias("t"), N.schema_structure(F.col("s")).alias("s"), N.json_depth(F.col("n")).alias("n")).collect()
    assert json.loads(rows[0].t) == {"a": [{"b": {"c": 3}}], "d": "_meta"} and rows[1].t is None and rows[1].s is None
    assert json.loads(rows[0].s) == {"type": "object", "properties": {"title": {"type": "string"}}, "enum": [{"title": 1}], "required": ["title"]}
    assert [r.n for r in rows] == [2, 0]


def test_eligibility_rules(spark):
    base = dict(status="active", importance=0.5, expires_at=None, memory_type="semantic", claim_status="verified", scope="project", repo_revision=None)
    changes = [{}, {"status": "expired"}, {"importance": None}, {"expires_at": 5}, {"expires_at": 20}, {"claim_status": "refuted"}, {"scope": "revision", "repo_revision": "r1"}, {"scope": "revision", "repo_revision": "r0"}, {"scope": "revision"}]
    rows = [tuple({**base, **c}.values()) for c in changes]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status string, importance double, expires_at int, memory_type string, claim_status string, scope string, repo_revision string")
    ids = lambda **k: [r.i for r in df.where(N.eligible(F.lit(10), F.lit("r1"), **k)).orderBy("i").collect()]
    assert ids() == [0, 4, 5, 6] and ids(claims=("verified",)) == [0, 4, 6] and ids(allow_stale=True) == [0, 4, 5, 6, 7, 8] and ids(types=("episodic",)) == []
    flags = df.select(N.stale(F.col("scope"), F.col("repo_revision"), F.lit("r1")).alias("s")).collect()
    assert [r.s for r in flags] == [False] * 7 + [True, True]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        runtime.ensure_checkpoint_dir(Session())


class Broken:
    model_id, dimensions = "broken", 3

    def embed_texts(self, texts):
        return [[1.0, 2.0]] * len(texts)


def test_embedders_are_plugged_in_and_checked(spark):
    df = spark.createDataFrame([(1, "parseTree of nodes"), (2, None)], "k int, t string")
    got = {r.k: r for r in P.embed(df, "k", F.col("t"), P.HashEmbedder(32)).collect()}
    want = {r.k: r.embedding for r in V.feature_hash(df, "k", T.features(F.coalesce("t", F.lit(""))), 32).collect()}
    assert got[1].embedding == pytest.approx(want[1], abs=1e-6) and got[2].embedding == [0.0] * 32 and got[1].embedding_model == "feature-hash-32"
    with pytest.raises(Exception):
        P.embed(df, "k", F.col("t"), Broken()).collect()


def test_extractors_are_plugged_in(spark):
    df = spark.createDataFrame([(1, "a=1 b=2"), (2, None), (3, "")], "k int, t string")
    got = P.extract(df, "k", F.col("t"), lambda t: [dict(zip(("name", "value"), x.split("="))) | {"other": 1} for x in t.split()], "name string, value string")
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a", "1"), (1, 1, "b", "2")]


def test_tools_are_called_through_an_allow_list(spark):
    tools = P.Registry()
    tools.register("add", lambda a, b=1: a + b, ("a",), ("b",))
    tools.register("drop", lambda: None)
    with pytest.raises(ValueError):
        tools.register("add", print)
    calls = [(1, "add", '{"a": 2}'), (2, "add", '{"a": 2, "b": 5}'), (3, "add", '{"c": 1}'), (4, "drop", "{}"), (5, "gone", "{}"), (6, "add", "no"), (7, "add", '{"a": "x"}'), (8, None, None)]
    got = {r.i: (r.verdict, r.answer) for r in tools.run(spark.createDataFrame(calls, "i int, n string, a string"), "i", "n", "a", ("add",)).collect()}
    assert [got[i] for i in (1, 2)] == [("done", "3"), ("done", "7")] and [got[i][0] for i in range(3, 9)] == ["invalid", "denied", "unknown", "invalid", "failed", "invalid"]


@pytest.mark.parametrize("query,k,mode,ok", [("q", 20, "dense", True), (" ", 5, "dense", False), ("q" * 2001, 5, "dense", False), ("q", 0, "dense", False), ("q", 21, "dense", False), ("q", 5, "magic", False)])
def test_search_arguments(query, k, mode, ok):
    if ok:
        P.check_search(query, k, mode)
    else:
        with pytest.raises(ValueError):
            P.check_search(query, k, mode)
