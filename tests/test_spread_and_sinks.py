"""Ranks and running sums cut by rows, folder sums, and files written under their own names."""

import json
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintel.operators import fixes as FX
from lintel.operators import quality as Q
from lintel.operators import rollup as RU
from lintel.operators import scan
from lintel.operators.paths import path_edges, path_nodes, sibling_order
from lintel.sources import named_files, state as S


@pytest.fixture
def many_tasks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_a_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


def test_a_folder_with_a_third_of_the_rows_is_spread_over_all_tasks(many_tasks):
    n = 60_000
    nodes = many_tasks.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("/hot")).otherwise(F.concat(F.lit("/d"), F.col("id") % 4000)).alias("parent_path"),
        F.concat(F.lit("m"), F.col("id")).alias("name"), F.when(F.col("id") % 7 == 0, "folder").otherwise("file").alias("type"))
    out = sibling_order(nodes).cache()
    tasks = rows_a_task(out)
    assert len(tasks) == 16 and tasks[-1] < 2 * tasks[8]
    hot = out.filter("parent_path = '/hot'").orderBy("sibling_rank").select("sibling_rank", "type").collect()
    assert [r.sibling_rank for r in hot] == list(range(1, n // 3 + 1))
    folders = sum(r.type == "folder" for r in hot)
    assert all(r.type == "folder" for r in hot[:folders])
    out.unpersist()


def test_a_file_and_day_with_most_of_the_history_is_spread(many_tasks):
    n = 30_000
    h = many_tasks.range(n).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("f"), F.col("id") % 500)).alias("file_path"),
        (F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(secs=F.col("id") / 10)).alias("last_analyzed"), F.col("id").alias("seq"), F.lit(1).cast("decimal(12,2)").alias("sqale_debt_hours"))
    out = Q.debt_trend(h).cache()
    tasks = rows_a_task(out)
    assert len(tasks) == 16 and tasks[-1] < 2 * tasks[8]
    hot = out.filter("file_path = 'hot'").orderBy("seq").collect()
    assert [int(r.running_value) for r in hot] == list(range(1, len(hot) + 1)) and [r.delta is None for r in hot[:2]] == [True, False]
    out.unpersist()


def test_ranks_of_null_keys_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5), ("a", 5), ("b", None), ("b", 0)], "k string, v int")
    got = Counter((r.k, r.v, r.n) for r in scan.ranked(df, ["k"], ["v"], "n").collect())
    assert got == Counter([(None, 1, 1), (None, 2, 2), ("a", 5, 1), ("a", 5, 2), ("b", None, 1), ("b", 0, 2)])
    assert scan.ranked(df.limit(0), ["k"], ["v"], "n").collect() == []


def test_path_tables_are_hashed_and_keep_their_columns(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",), ("/x",)], "file_path string")
    got = {r.path: (r.parent_path, r.name, r.depth, r.type) for r in path_nodes(files).collect()}
    assert got == {"a": (None, "a", 0, "folder"), "a/b": ("a", "b", 1, "folder"), "a/b/c.py": ("a/b", "c.py", 2, "file"), "a/d.py": ("a", "d.py", 1, "file"),
                   "e.py": (None, "e.py", 0, "file"), "": (None, "", 0, "folder"), "/x": ("", "x", 1, "file")}
    for plan in (path_nodes(files), path_edges(files)):
        assert not re.search(r"SortAggregate\(key=\[[a-z]", plan._jdf.queryExecution().executedPlan().toString())


def test_folder_sums_explode_folders_and_not_files(spark):
    m = spark.range(1000).select(F.lit("r").alias("repo"), F.concat(F.lit("/a/b/f"), F.col("id")).alias("file_path"), F.lit(50.0).alias("maintainability_index"),
                                 F.lit(1).cast("decimal(12,2)").alias("sqale_debt_hours"), F.lit(2).alias("cognitive_complexity"), F.lit(3).alias("lines_of_code"))
    out = RU.folder_rollup(m)
    assert {(r.folder, r.files, float(r.total_debt_hours), r.total_loc, r.avg_mi) for r in out.collect()} == {("/", 1000, 1000.0, 3000, 50.0), ("/a", 1000, 1000.0, 3000, 50.0), ("/a/b", 1000, 1000.0, 3000, 50.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, line in enumerate(plan) if "Generate explode" in line]
    below = "\n".join(plan[at[0]:])
    assert len(at) == 1 and "Aggregate" in below


# ---------------------------------------------------------------- sink
def test_files_are_written_whole_under_their_names(spark, tmp_path):
    rows = [("/a/b.py", "x = 1\n"), ("c.py", "é" * 50_000), ("d/./e", None), ("a/empty", "")]
    root = named_files.write_named(spark.createDataFrame(rows, "path string, content string").repartition(3), f"file://{tmp_path}/out")
    named_files.write_named(spark.createDataFrame(rows[:1], "path string, content string"), root)  # again: the same files
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(tmp_path / "out") for f in names}
    assert json.loads(found.pop("_SUCCESS"))["files"] == 1
    assert found == {"a/b.py": "x = 1\n", "c.py": "é" * 50_000, "d/e": "", "a/empty": ""}


@pytest.mark.parametrize("path", [None, "", "/", "../x", "a/../../x"])
def test_paths_outside_the_root_fail_without_a_commit(spark, tmp_path, path):
    with pytest.raises(Exception, match="not a path below the root"):
        named_files.write_named(spark.createDataFrame([(path, "x")], "path string, content string"), f"{tmp_path}/out")
    assert not os.path.exists(tmp_path / "out/_SUCCESS") and not os.path.exists(tmp_path / "x")


def test_a_failed_task_leaves_no_half_file(tmp_path, monkeypatch):
    writer = named_files._Writer(str(tmp_path))
    from pyspark.sql import Row

    class Bad(str):
        def encode(self, *_):
            raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(iter([Row(path="a", content="fine"), Row(path="b", content=Bad("x"))]))
    assert sorted(os.listdir(tmp_path)) == ["a"]
    assert writer.write(iter([Row(path="a", content="fine"), Row(path="b", content="x")])) == named_files.Written(2, 5)
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_patched_texts_read_back_equal(spark, tmp_path):
    patched = spark.createDataFrame([("/r/a.py", "new\n"), ("/r/s/noext", "t")], "file_path string, content string")
    got = {r.file_path: r.written_as for r in S.export_patched(patched, str(tmp_path)).collect()}
    assert got == {"/r/a.py": "/r/a_fixed.py", "/r/s/noext": "/r/s/noext_fixed.py"}
    assert {p: open(f"{tmp_path}{w}").read() for p, w in got.items()} == {"/r/a.py": "new\n", "/r/s/noext": "t"}


# ---------------------------------------------------------------- requests and outcomes
def test_requests_of_each_kind(spark):
    files = spark.createDataFrame([("/r/a.py", "x" * 3000), ("/r/b.py", "y")], "file_path string, content string")
    head = FX.request_table(files).collect()
    assert {(r.file_name, len(r.content_head), r.code, r.content_chars) for r in head} == {("a.py", 2000, None, 3000), ("b.py", 1, None, 1)}
    scan_ = FX.request_table(files, "bug_scan", wanted=files.filter("file_path = '/r/b.py'").select("file_path")).collect()
    assert [(r.file_name, r.content_head, r.code, r.answer_keys) for r in scan_] == [("b.py", None, "y", "has_bug,issue,severity")]
    with pytest.raises(ValueError, match="unknown task"):
        FX.request_table(files, "other")


def test_outcomes_keep_scripts_outputs_and_the_last_attempt(spark):
    asked = [(1, "bug", True), (2, "bug", True), (3, "bug", True), (4, "typo", True), (5, "bug", False)]
    requests = spark.createDataFrame([(i, "f", k, v) for i, k, v in asked], "request_id long, file_path string, issue_type_raw string, verifier_available boolean")
    bad, good = "Error: x", "ok"
    runs = [(1, 0, bad, "repro1"), (1, 1, good, "fix1"), (2, 0, good, "repro2"), (2, 1, good, "fix2"), (3, 0, bad, "repro3"), *((3, n, f"{bad}{n}", f"fix3{n}") for n in (1, 2, 3)), (4, 1, good, "fix4")]
    attempts = spark.createDataFrame(runs, "request_id long, attempt int, output string, fixed_code string")
    files = spark.createDataFrame([("f", "x")], "file_path string, content string")
    got = {r.request_id: (r.status, r.fixed_code, r.repro_script, r.test_output, r.last_attempt, r.last_error) for r in FX.fix_outcomes(requests, attempts, files).collect()}
    assert got == {1: ("success", "fix1", "repro1", None, None, None), 2: ("failed", None, "repro2", "ok", None, None), 3: ("failed", None, "repro3", None, "fix33", "Error: x3"),
                   4: ("success", "fix4", None, None, None, None), 5: ("failed", None, None, None, None, None)}


def test_deliveries_of_the_stream_do_not_grow_with_the_partitions(spark, monkeypatch):
    from lintel.plans import catalog

    def delivered(spark, source, schema, *args, **kwargs):
        files = spark.read.schema(schema).parquet(source)
        assert len(files.inputFiles()) <= catalog.DELIVERED
        return files

    monkeypatch.setattr(catalog.STR, "stream_upsert", delivered)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = catalog.q_stream_upsert(spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
