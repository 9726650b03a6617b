"""Listing and reading folders of many small files by tasks."""

import os

import pyarrow as pa
import pytest

from lintel.sources import files as FS
from lintel.sources import local_files as LF


def write(path, data=b"x = 1\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_tasks_do_not_grow_with_the_number_of_files(spark, tmp_path):
    for i in range(1500):
        write(f"{tmp_path}/d{i % 7}/m{i}.py", b"\xff" if i % 11 == 0 else b"x = %d\n" % i)
    df = FS.scan_sources(spark, str(tmp_path), keep_invalid=True)
    assert df.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(df.inputFiles()) < 20  # the table of names, not the files
    got = {r.file_path: r.content for r in df.collect()}
    assert got == {f"{tmp_path}/d{i % 7}/m{i}.py": None if i % 11 == 0 else f"x = {i}\n" for i in range(1500)}


def test_same_rows_as_sparks_reader(spark, tmp_path):
    for i in range(60):
        write(f"{tmp_path}/a b/{'c/' * (i % 4)}é%20{i}{'.py' if i % 3 else '.txt'}", os.urandom(i * 100))
    raw = LF.read_files(LF.list_files(spark, str(tmp_path), ".py"))
    got = {(r.path.decode(), bytes(r.content)) for r in raw.collect()}
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(str(tmp_path))
    assert len(got) == 40 and got == {(r.path.removeprefix("file:"), bytes(r.content)) for r in plain.select("path", "content").collect()}


def test_folders_beyond_a_tasks_share_are_listed_by_others_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LF, "LISTED", 5)
    want = {f"{tmp_path}/a{i}/{'b/' * (i % 6)}m{j}.py" for i in range(30) for j in range(3)}
    for path in want:
        write(path)
    write(f"{tmp_path}/a1/skipped/n.py")
    got = [r.path.decode() for r in LF.list_files(spark, str(tmp_path), ".py", skip=["skipped"]).collect()]
    assert sorted(got) == sorted(want)


def test_names_of_any_kind_and_links(spark, tmp_path):
    root = os.fsencode(tmp_path / "r")
    names = [b"__init__.py", b"_private/a.py", b".hidden/b.py", b"new\nline.py", b"bad\xff.py", b"[1]*.py"]
    for name in names:
        write(root + b"/" + name, name)
    write(f"{tmp_path}/target.py", b"linked.py")
    os.symlink(f"{tmp_path}/target.py", root + b"/linked.py")
    os.symlink(root, root + b"/loop")
    os.symlink(f"{tmp_path}/gone.py", root + b"/broken.py")
    os.mkdir(root + b"/folder.py")
    raw = LF.read_files(LF.list_files(spark, os.fsdecode(root), ".py"))
    assert sorted((bytes(r.path), bytes(r.content)) for r in raw.collect()) == sorted((root + b"/" + n, n) for n in [*names, b"linked.py"])
    shown = {r.file_path for r in FS.scan_sources(spark, os.fsdecode(root), keep_invalid=True).select("file_path").collect()}
    assert f"{tmp_path}/r/bad�.py" in shown and len(shown) == 7


def test_unreadable_files_are_null_and_lost_ones_an_error(tmp_path, monkeypatch):
    monkeypatch.setattr(LF, "BYTES", 10)
    write(f"{tmp_path}/a", b"123456789012")
    write(f"{tmp_path}/b", b"")
    paths = [os.fsencode(tmp_path / n) for n in ("a", ".", "b")]  # a folder can't be read
    out = list(LF._read(iter([pa.RecordBatch.from_arrays([pa.array(paths, pa.binary())], ["path"])])))
    assert [b.column("content").to_pylist() for b in out] == [[b"123456789012"], [None, b""]]
    lost = pa.RecordBatch.from_arrays([pa.array([os.fsencode(tmp_path / "lost")], pa.binary())], ["path"])
    with pytest.raises(FileNotFoundError):
        list(LF._read(iter([lost])))


def test_a_single_file_as_root(spark, tmp_path):
    write(f"{tmp_path}/one.py")
    assert [r.content for r in FS.scan_sources(spark, f"{tmp_path}/one.py").collect()] == ["x = 1\n"]
