"""Sources and sinks on small files, and the streaming jobs on files that arrive in turn."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import files, sqlite
from millrace.streaming import jobs


def test_scan_counts_what_it_leaves_out(spark, tmp_path):
    for name, content in {"a.py": b"x = 1", "b/c.md": b"\xef\xbb\xbf# T", "node_modules/d.py": b"y", "e.bin": b"1", "f.txt": b"\xff\xfe\x00", "g.txt": b"x" * 3000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path: (r.verdict, r.content) for r in files.scan_tree(spark, str(tmp_path), max_bytes=2000).collect()}
    assert got == {"a.py": ("kept", "x = 1"), "b/c.md": ("kept", "# T"), "e.bin": ("extension", None), "f.txt": ("encoding", None), "g.txt": ("size", None)}


def test_cases_with_violations(spark, tmp_path):
    rows = ['{"case_id": "a", "query": "q"}', "", '{"case_id": "b", "query": "q"}', '{"case_id": "b", "query": "r"}', '{"case_id": "c", "other": 1}', "{broken", '{"query": "q"}']
    (tmp_path / "c.jsonl").write_text("\n".join(rows))
    schema = T.StructType().add("case_id", "string").add("query", "string")
    good, bad = files.read_cases(spark, str(tmp_path / "c.jsonl"), schema, "case_id")
    assert [tuple(r) for r in good.collect()] == [("a", "q")]
    assert sorted(r.problem for r in bad.collect()) == ["broken line", "missing key", "repeated key", "repeated key", "unknown field"]
    (tmp_path / "e.jsonl").write_text("\n")
    assert [r.problem for r in files.read_cases(spark, str(tmp_path / "e.jsonl"), schema, "case_id")[1].collect()] == ["no cases"]


def test_report_replaces_the_one_before(spark, tmp_path):
    for n in (3, 1):
        files.write_report(spark.range(n), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def pages(tmp_path, rows):
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    return str(tmp_path / "p.jsonl")


def test_pages_in_the_order_of_their_tokens(spark, tmp_path):
    spark.dataSource.register(files.PagedSource)
    path = pages(tmp_path, [{"token": "", "next": "x", "items": ["a", "b"]}, {"token": "y", "items": ["d"]}, {"token": "x", "next": "y", "items": ["c"]}])
    got = spark.read.format("pages").option("path", path).load().orderBy("page", "position")
    assert [r.item for r in got.collect()] == ["a", "b", "c", "d"]


@pytest.mark.parametrize("rows", [[{"token": "", "next": "", "items": []}], [{"token": "", "items": []}, {"token": "", "items": []}], [{"token": "", "next": "gone", "items": []}]])
def test_pages_that_lead_nowhere(tmp_path, rows):
    with pytest.raises(ValueError):
        files._PagedReader({"path": pages(tmp_path, rows)}).partitions()


def test_too_many_pages(tmp_path):
    path = pages(tmp_path, [{"token": "", "next": "1", "items": []}, {"token": "1", "items": []}])
    with pytest.raises(ValueError):
        files._PagedReader({"path": path, "max_pages": "1"}).partitions()


def test_missing_table_counts_zero(spark):
    assert files.count_or_zero(spark, "no_such_table") == 0


def stream(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_index_over_micro_batches_is_the_batch_result(spark, tmp_path):
    schema = "path string, hash string, at int"
    batches = [[("a", "1", 1), ("b", "1", 1)], [("a", "2", 2)], [("c", "1", 3), ("b", None, 3)]]
    got = jobs.incremental_index(stream(spark, tmp_path, batches, schema), ["path"], ["at"])
    assert {tuple(r) for r in got.collect()} == {("a", "2", 2), ("b", None, 3), ("c", "1", 3)}


def test_deliveries_count_once_over_micro_batches(spark, tmp_path):
    schema = "id string, at timestamp"
    rows = spark.sql("select timestamp '2030-01-01' as a, timestamp '2030-01-09' as b").first()
    events = stream(spark, tmp_path, [[("x", rows.a), ("y", rows.a)], [("x", rows.b)], [("z", rows.b)]], schema)
    assert sorted(r.id for r in jobs.run_to_table(jobs.first_deliveries(events, "id", "at", "30 days")).collect()) == ["x", "y", "z"]


def test_keyed_state_lives_across_micro_batches(spark, tmp_path):
    schema = "k string, id string, at timestamp"
    t = [r.t for r in spark.range(4).select(F.timestamp_seconds(F.col("id") * 100).alias("t")).collect()]
    records = stream(spark, tmp_path, [[("k", "a", t[1]), ("l", "b", t[0])], [("k", "c", t[3])], [("k", "d", t[2])]], schema)
    assert {tuple(r) for r in jobs.newest_by_key(records, ["k"], "at", "id").collect()} == {("k", 3, "c"), ("l", 1, "b")}


def test_index_goes_on_after_a_restart(spark, tmp_path):
    schema = "path string, hash string, at int"
    folder = str(tmp_path / "index")
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", "1", 1), ("b", "1", 1)])
    assert jobs.incremental_index(source, ["path"], ["at"], folder).count() == 2
    put([("a", "2", 2), ("c", "1", 2)])
    got = jobs.incremental_index(source, ["path"], ["at"], folder)
    assert {tuple(r) for r in got.select("path", "hash", "at").collect()} == {("a", "2", 2), ("b", "1", 1), ("c", "1", 2)}
    # Only the buckets of the second batch were written again.
    places = set(jobs.read_document(spark, f"{folder}/manifest-1.json").values())
    assert any("version-0" in x for x in places) and any("version-1" in x for x in places)


def test_sink_writes_a_key_once_after_a_restart(spark, tmp_path):
    folder = str(tmp_path / "sink")
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    put = lambda rows: spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", 1), ("a", 1)])
    jobs.write_once(source, "k", folder)
    put([("a", 1), ("b", 2)])
    assert sorted(r.k for r in jobs.write_once(source, "k", folder).collect()) == ["a", "b"]


def test_actions_on_a_key_over_micro_batches(spark, tmp_path):
    schema = "k string, id string, at timestamp, c string, sure boolean"
    t = [r.t for r in spark.range(6).select(F.timestamp_seconds(F.col("id") * 100).alias("t")).collect()]
    records = stream(spark, tmp_path, [[("k", "a", t[0], "x", False), ("k", "b", t[1], "y", False)], [("k", "c", t[2], "x", True), ("k", "d", t[3], "y", True), ("k", "e", t[4], "y", False)]], schema)
    got = jobs.key_actions(records, ["k"], "at", "id", "c", F.col("sure"))
    assert {(r.id, r.action) for r in got.collect()} == {("a", "create"), ("b", "pending"), ("c", "duplicate"), ("d", "supersede"), ("e", "duplicate")}


def test_documents_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "registry.json")
    assert jobs.read_document(spark, path, []) == []
    for value in ({"a": 1}, {"ä": [None, 2.5]}):
        jobs.write_document(spark, value, path)
        assert jobs.read_document(spark, path) == value
    assert [x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")] == ["registry.json"]


def test_report_is_found_after_a_crash_between_the_moves(spark, tmp_path):
    path = tmp_path / "report"
    files.write_report(spark.range(3), str(path))
    path.rename(tmp_path / "report.old")
    assert files.read_report(spark, str(path)).count() == 3
    files.write_report(spark.range(2), str(path))
    assert files.read_report(spark, str(path)).count() == 2


def test_large_files_are_left_out_unread(spark, tmp_path):
    (tmp_path / "a.PY").write_text("x")
    (tmp_path / "b.py").write_bytes(b"\xff" * 5000)
    df = files.scan_tree(spark, str(tmp_path), max_bytes=2000)
    assert {r.path: r.verdict for r in df.collect()} == {"a.PY": "kept", "b.py": "size"}


def test_pages_of_a_folder_by_uri(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"token": "n", "items": ["c"]}) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"token": "", "next": "n", "items": ["a", "b"]}) + "\n")
    spark.dataSource.register(files.PagedSource)
    got = spark.read.format("pages").option("path", f"file://{tmp_path}").option("pages_per_task", "8").load()
    assert [(r.page, r.item) for r in got.orderBy("page", "position").collect()] == [(0, "a"), (0, "b"), (1, "c")]


def test_cases_without_keys_are_no_group(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(['{"query": "q"}', '{"query": "q"}', '{"case_id": "a"}']))
    good, bad = files.read_cases(spark, str(tmp_path / "c.jsonl"), T.StructType().add("case_id", "string").add("query", "string"), "case_id")
    assert good.count() == 1 and [r.problem for r in bad.collect()] == ["missing key"] * 2


def test_sqlite_round_trip(spark, tmp_path):
    path = str(tmp_path / "store.db")
    df = spark.range(100).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("ü"), F.col("id").cast("string"))).alias("na me"), (F.col("id") / 4).alias("x"))
    sqlite.write_sqlite(df.repartition(3), path, "rows")
    back = sqlite.read_sqlite(spark, path, "rows", 5)
    assert back.rdd.getNumPartitions() == 5 and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sqlite.write_sqlite(df.limit(2), path, "rows")
    assert sqlite.read_sqlite(spark, path, "rows").count() == 102
    sqlite.write_sqlite(df.limit(4).coalesce(1), path, "rows", "overwrite")
    assert sqlite.read_sqlite(spark, path, "rows").count() == 4
    with pytest.raises(Exception):
        sqlite.write_sqlite(df.select("id", F.raise_error(F.lit("no")).cast("string").alias("na me"), "x"), path, "rows")
    import sqlite3

    with sqlite3.connect(path) as db:
        assert db.execute("select count(*) from rows").fetchone() == (4,) and db.execute("select count(*) from sqlite_master").fetchone() == (1,)


def test_a_job_goes_on_only_for_its_revision(spark, tmp_path):
    for _ in range(2):
        jobs.guard_revision(spark, str(tmp_path), "p", "r1")
    with pytest.raises(ValueError):
        jobs.guard_revision(spark, str(tmp_path), "p", "r2")
