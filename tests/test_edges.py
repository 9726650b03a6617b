"""Edges of the table operators: order, null values, bare names, several repos, answers of wrong types."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lintel.operators import issues as I
from lintel.operators import paths as P
from lintel.operators import quality as Q
from lintel.operators import rollup as RU
from lintel.operators.fixes import instruction
from lintel.sources import files as FS
from lintel.sources import state as S


def test_listing_is_ordered_and_counts_what_it_lists(spark):
    files = spark.createDataFrame([("/r/b.py",), ("/r/A.py",), ("/r/z/m.py",), ("/r/.git/x.py",), ("/r/venv/y.py",)], "file_path string")
    nodes = P.path_nodes(files)
    assert [r.name for r in P.list_children(nodes, "/r").collect()] == ["z", "A.py", "b.py"]
    count = {r.parent_path: (r.folder_count, r.file_count) for r in P.folder_counts(nodes).collect()}
    assert count["/r"] == (1, 2)


def test_siblings_follow_locale_order(spark):
    files = spark.createDataFrame([("r/b.py",), ("r/A.py",), ("r/\u00e4.py",), ("r/z.py",)], "file_path string")
    rank = {r.name: r.sibling_rank for r in P.sibling_order(P.path_nodes(files)).collect() if r.parent_path == "r"}
    assert sorted(rank, key=rank.get) == ["A.py", "\u00e4.py", "b.py", "z.py"]


def test_top_complex_orders_by_control_count(spark):
    m = spark.createDataFrame([("a", 3, 1), ("b", 1, 9), ("c", 2, 5)], "file_path string, complexity_score int, cognitive_complexity int")
    assert [r.file_path for r in RU.top_complex(m, 2).collect()] == ["a", "c"]


def test_trend_keeps_rows_without_time_and_true_nulls(spark):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [("f", None, 0, 5.0), ("f", day(1), 1, 1.0), ("f", day(1, 5), 2, None), ("f", day(2), 3, 2.0), ("f", day(2, 1), 4, 3.0)]
    h = spark.createDataFrame(rows, "file_path string, last_analyzed timestamp, seq int, sqale_debt_hours double")
    got = {r.seq: (r.previous_value, r.running_value) for r in Q.debt_trend(h).collect()}
    assert got == {0: (None, 5.0), 1: (5.0, 6.0), 2: (1.0, 6.0), 3: (None, 8.0), 4: (2.0, 11.0)}


def test_folders_of_repos_stay_apart_and_bare_names_have_none(spark):
    m = spark.createDataFrame([("p", "src/a.py", 50.0), ("q", "src/a.py", 70.0), ("p", "a.py", 10.0)],
                              "repo string, file_path string, maintainability_index double")
    m = m.select("*", F.lit(0).cast("decimal(12,2)").alias("sqale_debt_hours"), F.lit(0).alias("cognitive_complexity"), F.lit(1).alias("lines_of_code"))
    assert {(r.repo, r.folder, r.avg_mi) for r in RU.folder_rollup(m).collect()} == {("p", "src", 50.0), ("q", "src", 70.0)}


@pytest.mark.parametrize("answer, want", [
    ('\n\n```json\n{"has_bug": true}\n```', ("Potential issue detected", "medium")),
    ('{"has_bug": "false", "issue": "x"}', ("x", "medium")),
    ('{"has_bug": true, "issue": null}', None), ('{"has_bug": true, "severity": 3}', None),
    ('{"has_bug": 0}', None), ('{"has_bug": [1]}', ("Potential issue detected", "medium")), ('{"has_bug": {}}', None),
])
def test_bug_scan_answers(spark, answer, want):
    r = spark.createDataFrame([("f", answer)], "file_path string, response string")
    m = spark.createDataFrame([("f", 1, 2.0)], "file_path string, cognitive_complexity int, maintainability_index double")
    got = [(x.issue, x.severity) for x in I.parse_bug_scan(r, m).collect()]
    assert got == ([want] if want else [])


def test_diagnosis_of_wrong_types_failed(spark):
    answers = ['{"is_healthy": null}', '{"issue": 3}', '{"suggestions": null}', '{"is_healthy": "yes"}', "{}"]
    r = spark.createDataFrame([(str(i), a) for i, a in enumerate(answers)], "file_path string, response string")
    got = {x.file_path: (x.is_healthy, x.issue) for x in I.parse_diagnosis(r).collect()}
    failed = (False, "Analysis failed: invalid answer")
    assert got == {"0": failed, "1": failed, "2": failed, "3": (True, "Analysis complete"), "4": (False, "Analysis complete")}


def test_instruction_trims_all_white_space(spark):
    df = spark.createDataFrame([("\n\t fix it \n", "d"), (" \n ", "d"), (None, "")], "u string, d string")
    assert [r[0] for r in df.select(instruction(F.col("u"), F.col("d"))).collect()] == ["fix it", "d", "Fix any issues in this file"]


def test_lookup_tells_unreadable_from_missing(spark):
    src = spark.createDataFrame([("a", "x"), ("b", None)], "file_path string, content string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "file_path string")
    got = {r.file_path: (r.content, r.found) for r in S.content_lookup(src, asked).collect()}
    assert got == {"a": ("x", True), "b": ("# Error reading file: unreadable", True), "c": ("# File not found", False)}


def test_the_last_of_several_fixes_holds(spark):
    snap = spark.createDataFrame([("r", 1, "a", "old")], "repo string, snapshot_id long, file_path string, content string")
    fixes = spark.createDataFrame([("a", "one", 1), ("a", "two", 2)], "file_path string, new_code string, seq int")
    assert [r.content for r in S.patch_overlay(snap, fixes).collect()] == ["two"]


def test_a_second_snapshot_replaces_the_first(spark, tmp_path):
    row = lambda v: spark.createDataFrame([("r", 1, "a", v)], "repo string, snapshot_id long, file_path string, content string")
    S.replace_snapshot(row("first"), str(tmp_path / "t"))
    assert [r.content for r in S.replace_snapshot(row("second"), str(tmp_path / "t")).collect()] == ["second"]


def test_scan_below_a_folder_of_any_name_or_scheme(spark, tmp_path):
    df = spark.createDataFrame([("/srv/a.py", "x = 1\n", False), ("/srv/b.py", "y", True)], "rel_path string, content string, bad boolean")
    root = f"file://{tmp_path}/srv/tree"
    FS.write_tree(df, root, encoding_bad="bad")
    got = {r.file_path: r.content for r in FS.scan_sources(spark, root, keep_invalid=True).collect()}
    assert got == {f"{tmp_path}/srv/tree/srv/a.py": "x = 1\n", f"{tmp_path}/srv/tree/srv/b.py": None}


def test_one_path_in_two_repos_is_two_files(spark):
    m = spark.createDataFrame([("p", "setup.py", 1, 50.0, None), ("q", "setup.py", 2, 60.0, "A long enough docstring")],
                              "repo string, file_path string, cognitive_complexity int, maintainability_index double, description string")
    issues = spark.createDataFrame([("p", "setup.py", "x", "low")], "repo string, file_path string, issue string, severity string")
    assert [(r.repo, r.cognitive_complexity) for r in I.attach_metrics(issues, m).collect()] == [("p", 1)]
    assert {(r.repo, r.issues) for r in I.issues_per_file(m, issues).collect()} == {("p", 1), ("q", 0)}
    assert I.issue_navigation(issues, m.filter("repo = 'q'")).count() == 0
    src = spark.createDataFrame([("p", 1, "setup.py", "a"), ("q", 1, "setup.py", "b")], "repo string, snapshot_id long, file_path string, content string")
    asked = spark.createDataFrame([("q", "setup.py")], "repo string, file_path string")
    assert [r.content for r in S.content_lookup(src, asked).collect()] == ["b"]
    fix = spark.createDataFrame([("q", "setup.py", "new")], "repo string, file_path string, new_code string")
    assert {(r.repo, r.content) for r in S.patch_overlay(src, fix).collect()} == {("p", "a"), ("q", "new")}
    assert [r.repo for r in RU.triage(m, asked).collect()] == ["q"]
    from lintel.operators import describe as D
    cache = D.description_cache(spark.createDataFrame([("q", "setup.py", 1, "cached")], "repo string, file_path string, snapshot_id long, description string"))
    assert [r.repo for r in D.files_needing_generation(m, cache).collect()] == ["p"]
