"""The keyed store, stored metrics and streams: replays, crashes, bytes a batch, unchanged files, late rows."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lintel.operators import rollup as RU
from lintel.operators.metrics import METRIC_COLUMNS, METRIC_TYPES, analyze
from lintel.sources import stored as ST
from lintel.sources.store import KeyedStore
from lintel.streaming import upsert as STR

SCHEMA = StructType().add("k", "string").add("v", "integer").add("t", "long").add("note", "string")


def store(spark, path, **kw):
    return KeyedStore(spark, f"file://{path}", SCHEMA, ["k"], ["t"])


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def content(s):
    return sorted((str(r.k), r.v, r.t) for r in s.current().collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_random_merges_equal_a_dict(spark, tmp_path):
    r, want, s = random.Random(4), {}, store(spark, tmp_path)
    assert content(s) == [] and s.manifest() is None
    for batch in range(9):
        data = [(r.choice([None, *"abcdefghij"]), r.randrange(100), batch * 10 + r.randrange(3), None) for _ in range(r.choice([0, 1, 3, 12]))]
        gone = spark.createDataFrame([("a", batch * 10 + 9)], "k string, t long") if batch == 4 else None
        m = s.merge(rows(spark, *data), batch=batch, deleted=gone)
        for k, v, t, _ in data:
            best = max((t2, v2) for k2, v2, t2, _ in data if k2 == k)
            want[k] = next(iter({(v2, t2) for k2, v2, t2, _ in data if k2 == k and t2 == best[0]})) if sum(k2 == k and t2 == best[0] for k2, _, t2, _ in data) == 1 else (None, best[0])
        if batch == 4:
            want.pop("a", None)
        got = {r_[0]: r_[1:] for r_ in content(s)}
        assert {k: t for k, (_, t) in got.items()} == {str(k): t for k, (_, t) in want.items()}
        assert all(v is None or got[str(k)][0] == v for k, (v, _) in want.items())
        assert m["version"] == batch + 1 and len(m["generations"]) <= 4


def test_an_older_row_doesn_t_win_and_a_tie_goes_to_the_batch(spark, tmp_path):
    s = store(spark, tmp_path)
    s.merge(rows(spark, ("a", 1, 5, None), ("b", 1, 5, None)))
    s.merge(rows(spark, ("a", 2, 4, None), ("b", 2, 5, None)))
    assert content(s) == [("a", 1, 5), ("b", 2, 5)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    s.merge(rows(spark, ("a", 1, 1, None)), batch=0)
    s.merge(rows(spark, ("a", 2, 2, None)), batch=1)
    before = (content(s), sorted(os.listdir(tmp_path)))
    s.merge(rows(spark, ("a", 9, 9, None)), batch=1)
    s.merge(rows(spark, ("a", 9, 9, None)), batch=0)
    assert (content(s), sorted(os.listdir(tmp_path))) == before


def test_a_crash_before_the_commit_leaves_the_table_and_its_files_go(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.merge(rows(spark, ("a", 1, 1, None)), batch=0)

    def crash(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_commit", crash)
        with pytest.raises(OSError):
            s.merge(rows(spark, ("a", 2, 2, None), ("b", 2, 2, None)), batch=1)
    assert content(s) == [("a", 1, 1)]
    orphans = {n for n in os.listdir(tmp_path) if n.startswith("generation-")} - {g["path"] for g in s.manifest()["generations"]}
    assert orphans
    s.merge(rows(spark, ("a", 2, 2, None), ("b", 2, 2, None)), batch=1)
    assert content(s) == [("a", 2, 2), ("b", 2, 2)] and not orphans & set(os.listdir(tmp_path))


def test_bytes_written_follow_the_batch(spark, tmp_path):
    s = store(spark, tmp_path)
    big = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"), F.lit(0).cast("long").alias("t"), F.sha2(F.col("id").cast("string"), 256).alias("note"))
    s.merge(big, batch=0)
    first = size(tmp_path)
    for i in range(1, 4):
        before = set(os.listdir(tmp_path))
        s.merge(big.limit(50).select("k", F.lit(i).alias("v"), F.lit(i).cast("long").alias("t"), "note"), batch=i)
        new = sum(size(tmp_path / n) for n in os.listdir(tmp_path) if n not in before)
        assert new < first / 20
    assert s.current().agg(F.count(F.lit(1)), F.sum("v")).first()[:] == (20_000, 150)
    assert len(os.listdir(tmp_path)) < 20


# ---------------------------------------------------------------- stored metrics
FILES = "repo string, snapshot_id long, file_path string, content string"


def test_stored_types_are_those_of_the_analysis(spark):
    got = dict(analyze(spark.createDataFrame([], FILES), keep=[]).dtypes)
    assert tuple(got[c] for c in METRIC_COLUMNS) == METRIC_TYPES


def test_only_changed_files_are_analysed_again(spark, tmp_path):
    files = spark.createDataFrame([("r", 1, f"{i}.py", f"if x{i}:\n    pass\n") for i in range(6)] + [("q", 1, "0.py", None)], FILES)
    s = ST.metric_store(files, f"file://{tmp_path}/m", ["snapshot_id"])
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    ST.refresh(s, files, at=F.lit(t0))
    changed = files.filter("file_path <> '5.py'").withColumn("content", F.when(F.col("file_path") == "2.py", "x = 1\n").otherwise(F.col("content")))
    added = changed.unionByName(spark.createDataFrame([("r", 1, "new.py", "for a in b:\n    pass\n")], FILES))
    assert sorted((r.repo, r.file_path) for r in ST.changed_files(added, s.current()).collect()) == [("r", "2.py"), ("r", "new.py")]
    ST.refresh(s, added, at=F.lit(t1))
    got = {(r.repo, r.file_path): (r.complexity_score, r.last_analyzed) for r in s.current().collect()}
    assert got == {("q", "0.py"): (0, t0), ("r", "0.py"): (1, t0), ("r", "1.py"): (1, t0), ("r", "2.py"): (0, t1), ("r", "3.py"): (1, t0), ("r", "4.py"): (1, t0), ("r", "new.py"): (1, t1)}
    fresh = analyze(added, keep=["repo", "file_path"])
    assert sorted(map(str, s.current().select(*fresh.columns).collect())) == sorted(map(str, fresh.collect()))


def test_dashboards_read_narrow_rows_and_the_store_follows_its_source(spark, tmp_path):
    def given(n):
        spark.range(n).select(F.lit("r").alias("repo"), F.lit(1).cast("long").alias("snapshot_id"), F.concat(F.lit("f"), F.col("id")).alias("file_path"),
                              F.lit("if a:\n    pass\n").alias("content")).write.mode("overwrite").parquet(f"{tmp_path}/src")
        files = spark.read.parquet(f"{tmp_path}/src")
        return ST.stored_metrics(files, f"file://{tmp_path}/m", f"{tmp_path}/src", ["snapshot_id"])

    m = given(5)
    plan = RU.health_dashboard(m, ["repo"])._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "content" not in plan.replace("content_hash", "") and "description" not in plan
    version = ST.metric_store(spark.read.parquet(f"{tmp_path}/src"), f"file://{tmp_path}/m", ["snapshot_id"]).manifest()["version"]
    assert m.count() == 5 and ST.stored_metrics(spark.read.parquet(f"{tmp_path}/src"), f"file://{tmp_path}/m", f"{tmp_path}/src", ["snapshot_id"]).count() == 5
    assert ST.metric_store(spark.read.parquet(f"{tmp_path}/src"), f"file://{tmp_path}/m", ["snapshot_id"]).manifest()["version"] == version
    assert given(3).count() == 3


# ---------------------------------------------------------------- streams
def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    src, work = str(tmp_path / "src"), f"file://{tmp_path}/work"
    for i in range(3):
        rows(spark, ("a", i, i, None), (f"k{i}", i, i, None)).write.mode("append").parquet(src)
        out = STR.stream_upsert(spark, src, SCHEMA, ["k"], ["t"], work=work)
        assert sorted((r.k, r.v) for r in out.collect()) == sorted([("a", i), *((f"k{j}", j) for j in range(i + 1))])


def test_late_rows_are_dropped_and_those_within_the_watermark_kept(spark, tmp_path):
    day = datetime(2024, 1, 1)
    src, work = str(tmp_path / "src"), f"file://{tmp_path}/work"
    schema = StructType().add("ts", "timestamp").add("event_type", "string").add("value", "double")
    deliveries = [[(0, 1.0), (5, 1.0)], [(4.5, 10.0), (1, 100.0), (7, 1.0)], [(6.5, 10.0), (5.5, 100.0), (0.5, 100.0)]]
    for d in deliveries:
        spark.createDataFrame([(day + timedelta(hours=h), "x", v) for h, v in d], schema).coalesce(1).write.mode("append").parquet(src)
        out = STR.stream_window_counts(spark, src, schema, "ts", ["event_type"], "value", work=work)
    assert sorted((r.window_start.hour, r.events, r.value_sum) for r in out.collect()) == [(0, 1, 1.0), (4, 1, 10.0), (5, 1, 1.0), (6, 1, 10.0), (7, 1, 1.0)]
