"""Keyed state: upsert, sort order, empty table, streaming = batch."""

import datetime as dt

from pyspark.sql import functions as F

from lintel.operators import rollup as RU
from lintel.operators.metrics import analyze
from lintel.sources import state as S

T0 = dt.datetime(2024, 1, 1)


def metrics(spark, rows):
    df = spark.createDataFrame(rows, "file_path string, content string, last_analyzed timestamp, seq long")
    return analyze(df)


def test_upsert_replaces_and_never_duplicates(spark):
    cur = metrics(spark, [("app/utils.py", "if x:\n    pass\n", T0, 1)])
    upd = metrics(spark, [("app/utils.py", "if x:\n    for y in z:\n        pass\n", T0 + dt.timedelta(1), 2)])
    out = S.upsert(cur, upd).collect()
    assert len(out) == 1 and out[0].complexity_score == 2


def test_list_sorted_by_complexity_desc(spark):
    m = metrics(spark, [
        ("simple.py", "x = 1\n", T0, 1),
        ("medium.py", "if a:\n    pass\n", T0, 2),
        ("complex.py", "if a:\n    for b in c:\n        while d:\n            pass\n", T0, 3),
    ])
    assert [r.complexity_score for r in RU.list_metrics(m).collect()] == [3, 1, 0]


def test_empty_table(spark):
    m = metrics(spark, [])
    assert RU.list_metrics(m).collect() == []
    h = RU.project_health(m).collect()[0]
    assert h.files == 0 and h.avg_mi == 100.0 and h.avg_cognitive == 0.0


def test_patch_names(spark):
    df = spark.createDataFrame([("/a/b/mod.py",), ("/a/noext",), ("/a/x.tar.gz",), ("/a/.rc",)], "file_path string")
    got = {r.file_path: r.fixed_name for r in S.patch_names(df).collect()}
    assert got == {"/a/b/mod.py": "mod_fixed.py", "/a/noext": "noext_fixed.py",
                   "/a/x.tar.gz": "x.tar_fixed.gz", "/a/.rc": ".rc_fixed.py"}


def test_stream_upsert_equals_batch(spark, tmp_path):
    from lintel.sources import facts as FA
    from lintel.streaming.upsert import stream_upsert
    ev = FA.metric_events(spark, "/root/testdata/sf0.001")
    src = str(tmp_path / "src")
    ev.repartition(3, "seq").write.parquet(src)
    st = stream_upsert(spark, src, ev.schema, ["file_path"], ["last_analyzed", "seq"],
                       work=str(tmp_path / "work"), max_files_per_trigger=1)
    batch = S.upsert(ev.limit(0), ev, order=["last_analyzed", "seq"])
    cols = ["file_path", "last_analyzed", "seq", "sqale_debt_hours"]
    assert sorted(st.select(*cols).collect()) == sorted(batch.select(*cols).collect())
