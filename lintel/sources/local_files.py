"""Names and bytes of many small files below one ``file:`` folder that driver and executors share.

Spark's file index lists folders one after another in the driver, keeps all names there and reads 32 small
files a task. Here tasks list folders and write the names as a table; what reads the files is dealt out by
name to a fixed number of tasks. The driver sees no names, only whether a round left folders to list.

Names are bytes, so that any name is read back. Folders that are links aren't entered (a loop of links would
never end), files that are links are read; both as ``rglob`` does in the reference.
"""

from __future__ import annotations

import os
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.session import scratch_path

#: Entries that a task of the first round lists before it hands the folders left to others; doubled in each round.
LISTED = 100_000
#: Names, and bytes of contents, in a batch that a task hands on.
NAMES, BYTES = 10_000, 8 << 20

FOUND = "path binary, folder boolean"


def _walk(limit: int, suffix: bytes, skip: frozenset[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(paths: Iterable[bytes], folder: bool) -> pa.RecordBatch:
        names = pa.array(list(paths), pa.binary())
        return pa.RecordBatch.from_arrays([names, pa.array([folder] * len(names), pa.bool_())], ["path", "folder"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = deque(p for b in batches for p in b.column(0).to_pylist())
        listed, files = 0, []
        while todo and listed < limit:
            try:
                entries = os.scandir(todo.popleft())
            except FileNotFoundError:  # gone since it was found
                continue
            with entries:
                for entry in entries:
                    listed += 1
                    if entry.is_dir(follow_symlinks=False):
                        if entry.name not in skip:
                            todo.append(entry.path)
                    elif entry.name.endswith(suffix) and entry.is_file():
                        files.append(entry.path)
                        if len(files) == NAMES:
                            yield found(files, False)
                            files = []
        yield found(files, False)
        yield found(todo, True)

    return run


def list_files(spark: SparkSession, root: str, suffix: str, skip: Iterable[str] = ()) -> DataFrame:
    """``path binary`` of all files below ``root`` whose names end with ``suffix``; folders named in ``skip`` aren't entered."""
    work = scratch_path(spark, f"listing-{uuid.uuid4().hex[:8]}")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo, n = spark.range(0, 1, 1, 1).select(F.lit(os.fsencode(root)).alias("path")), 0
    while n == 0 or not todo.isEmpty():
        walk = _walk(LISTED << n, os.fsencode(suffix), frozenset(map(os.fsencode, skip)))
        todo = todo.repartition(tasks, "path") if n else todo
        todo.mapInArrow(walk, FOUND).write.parquet(f"{work}/round={n}")
        todo = spark.read.schema(FOUND).parquet(f"{work}/round={n}").filter("folder").select("path")
        n += 1
    return spark.read.schema(FOUND).parquet(work).filter("not folder").select("path")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read(paths: list[bytes], contents: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(contents, pa.binary())], ["path", "content"])

    paths, contents, size = [], [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                with open(path, "rb") as file:
                    content = file.read()
            except FileNotFoundError:  # the listing is out of date
                raise
            except OSError:
                content = None
            paths.append(path)
            contents.append(content)
            size += len(content or b"")
            if size >= BYTES or len(paths) == NAMES:
                yield read(paths, contents)
                paths, contents, size = [], [], 0
    yield read(paths, contents)


def read_files(files: DataFrame) -> DataFrame:
    """``path binary, content binary`` of listed files, an even share of them a task; null content: unreadable."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(tasks, "path").mapInArrow(_read, "path binary, content binary")
