"""A sink that writes one file a row under its own name (S9 export).

``df.write.format("named_files").option("path", root).mode("append").save()``
writes the columns ``path`` (below the root) and ``content`` (text or bytes).
Tasks write their own rows in parallel through Arrow's file systems (local, HDFS,
S3, GCS by the scheme of the root); nothing passes through the driver.

Names are safe against retries: a file is written under a name of the attempt and
moved to its own name when whole, so a task that runs twice gives the same files and
no reader sees half of one. When all tasks are done, ``_SUCCESS`` gets the number
of files and bytes; without it a folder is unfinished.

Defined results: null content is an empty file; a null path, one that leaves the root
or one that names the root itself fails the job; of rows with equal paths the last
to be moved stays.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "named_files"


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("named files are added to a folder; remove the folder to start anew")
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = FileSystem.from_uri(self.root)
        files = size = 0
        made: set[str] = set()
        for row in rows:
            parts = [p for p in (row["path"] or "").split("/") if p not in ("", ".")]
            if not parts or ".." in parts:
                raise ValueError(f"not a path below the root: {row['path']!r}")
            content = row["content"]
            data = b"" if content is None else content.encode() if isinstance(content, str) else bytes(content)
            folder = "/".join([root, *parts[:-1]])
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made = {folder} if len(made) > 10_000 else made | {folder}
            draft = f"{folder}/.{uuid.uuid4().hex}"
            try:
                with fs.open_output_stream(draft) as out:
                    out.write(data)
                fs.move(draft, f"{folder}/{parts[-1]}")
            except BaseException:
                if fs.get_file_info(draft).is_file:
                    fs.delete_file(draft)
                raise
            files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        fs, root = FileSystem.from_uri(self.root)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}).encode())


def write_named(df: DataFrame, root: str, path: str = "path", content: str = "content") -> str:
    """Write the files and return the root."""
    df.sparkSession.dataSource.register(NamedFiles)
    df.select(df[path].alias("path"), df[content].alias("content")).write.format(FORMAT).option("path", root).mode("append").save()
    return root
