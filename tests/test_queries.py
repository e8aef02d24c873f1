"""Every query runs on the smallest tables, and equals its SQL where it has one."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import pytest

from millrace.plans import catalog

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="the test tables are not here")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, BASE)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(norm(x[names.index(c)]) for c in columns) for x in r.fetchall())


def test_json_paths_of_any_depth(spark, tmp_path):
    texts = ['{"a": {"b": {"c": {"d": 1}}, "e": [{"x": 1}]}, "f": "{\\"g\\": 1}", "h": null}', '{"a": {"b": 2}}', "{}"]
    spark.createDataFrame(list(enumerate(texts)), "candidate_id long, candidate_json string").write.parquet(f"{tmp_path}/memory_curation_decisions.parquet")
    con = duckdb.connect()
    con.execute(f"create view memory_curation_decisions as select * from '{tmp_path}/memory_curation_decisions.parquet/*.parquet'")
    got = {(r.path, r.n) for r in catalog.queries()["f41_json_paths"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(catalog.oracle_sql()["f41_json_paths"]).fetchall())
    assert ("a.b.c.d", 1) in got and ("f.g", 1) not in got


def drafts(spark, tmp_path, rows):
    columns = "draft_id long, project_id string, path string, scanned_at timestamp, content string"
    at = [r.t for r in spark.sql("select timestamp_seconds(id) as t from range(10) order by id").collect()]
    spark.createDataFrame([(i, p, path, at[k], text) for i, (p, path, k, text) in enumerate(rows)], columns).write.parquet(f"{tmp_path}/chunk_drafts.parquet")


def test_api_changes_and_their_risk(spark, tmp_path):
    drafts(spark, tmp_path, [("p", "a.py", 1, "def f(x): pass\ndef g(): pass\n"), ("p", "a.py", 2, "def f(x, y): pass\ndef h(): pass\n"), ("p", "b.py", 1, "def f(): pass\n"), ("p", "b.py", 2, "def f(): pass\ndef new(): pass\n"), ("p", "c.py", 1, "def f(): pass\n"), ("p", "c.py", 2, "def f():\n    return 1\n"), ("p", "d.py", 1, "def _f(x): pass\n"), ("p", "d.py", 2, "def _f(y): pass\n"), ("p", "e.py", 1, "x = 1\n")])
    changes = {(r.path, r.name): r.change for r in catalog.queries()["d10_api_changes"](spark, str(tmp_path)).collect()}
    assert changes == {("a.py", "f"): "changed", ("a.py", "g"): "removed", ("a.py", "h"): "added", ("b.py", "f"): "same", ("b.py", "new"): "added", ("c.py", "f"): "same", ("d.py", "_f"): "changed"}
    risk = {r.path: r.risk for r in catalog.queries()["d10_risk"](spark, str(tmp_path)).collect()}
    assert risk == {"a.py": "high", "b.py": "low", "c.py": "none", "d.py": "low"}


def test_inspected_symbols_and_chunks(spark, tmp_path):
    drafts(spark, tmp_path, [("p", "a.py", 1, "import os\n\nclass A:\n    def m(self): pass\n\ndef _b(): pass\ndef c(): pass\n"), ("p", "t.txt", 1, "x\n")])
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.draft_id, r.name) for r in run("d15_top_symbols")} == {(0, "A"), (0, "c")}
    assert {r.name for r in run("d09_inspect_python")} >= {"os", "A", "A.m", "_b", "c"}
    assert {(r.draft_id, r.kind, r.symbol) for r in run("d03_chunk_files")} >= {(0, "python_symbol", "A"), (0, "python_symbol", "c"), (1, "text", None)}


def test_diff_and_ratio_of_replaced_records(spark, tmp_path):
    rows = [("a", None, "one\ntwo\n" * 60), ("b", "a", "one\ntwo\n" * 60 + "x"), ("c", "b", "other"), ("d", "gone", "y")]
    spark.createDataFrame(rows, "memory_id string, supersedes_memory_id string, content string").write.parquet(f"{tmp_path}/memories.parquet")
    got = {r.memory_id: r for r in catalog.queries()["f17_unified_diff"](spark, str(tmp_path)).collect()}
    assert set(got) == {"b", "c"} and got["b"].ratio > 0.99 and got["c"].ratio < 0.5 and "+x" in got["b"].diff.splitlines()
    assert {tuple(r) for r in catalog.queries()["f16_same_text"](spark, str(tmp_path)).collect()} == {("b", "a", True), ("c", "b", False)}
