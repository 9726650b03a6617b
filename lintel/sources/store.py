"""A table with one current row a key, kept in generations (S4, S5, ST1).

A merge writes the batch's own newest rows as a new generation and commits a manifest
that names it. Generations are merged when the newer ones have grown to the size of the
one before, so that a batch costs its own size times the logarithm of the table's
size over time, and never the whole table each time. A reader gets the newest
row of every key over the few generations of the newest manifest.

- A merge is committed when its manifest is renamed into place; what a crash leaves
  behind before that is never read and is removed later. There is one writer
  at a time (a streaming query, or a job that refreshes the table).
- A batch number below or at the committed one is a replay and does nothing.
- Deleted keys are rows with ``deleted_``; a merge of all generations drops them.
- The files of the last ``KEEP`` manifests stay, for readers that are still at them.

Everything lies under one folder of the shared file system and is reached through
Spark and Hadoop alone. Defined results: null keys are a key like others; of rows
with equal order the batch wins over the table and the greater row within a batch;
a batch without rows commits its number; a table without a commit reads as empty.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Manifests whose files are kept; a generation joins the newer ones while it is smaller than this many times their rows.
KEEP, GROWTH = 2, 1
DELETED = "deleted_"


class KeyedStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: list[str], order: list[str]):
        self.spark, self.root, self.key, self.order = spark, root.rstrip("/"), key, order
        self.columns = [f.name for f in schema]
        self.schema = StructType([*(StructField(f.name, f.dataType) for f in schema), StructField(DELETED, BooleanType())])

    # ------------------------------------------------------------ manifests
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, fs = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _read(self, version: int) -> dict:
        path, fs = self._path(f"manifest-{version:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict | None:
        """The newest committed manifest: version, batch, mark and generations (path and rows, oldest first)."""
        versions = self._versions()
        return self._read(versions[-1]) if versions else None

    def _commit(self, manifest: dict) -> None:
        draft, fs = self._path(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not fs.rename(draft, self._path(f"manifest-{manifest['version']:010d}.json")[0]):
            raise RuntimeError(f"version {manifest['version']} of {self.root} was committed by another writer")
        self._clean()

    def _clean(self) -> None:
        """Remove manifests before the kept ones, and generations that none of the kept ones names."""
        versions = self._versions()
        used = {g["path"] for v in versions[-KEEP:] for g in self._read(v)["generations"]}
        root, fs = self._path("")
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            old = name.startswith("manifest-") and int(name[9:19]) in versions[:-KEEP]
            if old or (name.startswith("generation-") and name not in used):
                fs.delete(status.getPath(), True)

    # ------------------------------------------------------------ rows
    def _newest(self, df: DataFrame, *ties: str) -> DataFrame:
        payload = F.struct(*[c for c in df.columns if c not in (*self.key, *ties)])
        rank = F.struct(*self.order, *ties, F.xxhash64(payload).alias("hash_"))
        return df.groupBy(*self.key).agg(F.max_by(payload, rank).alias("row_")).select(*self.key, "row_.*").select(*self.columns, DELETED)

    def _generation(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}")

    def _merged(self, names: list[str]) -> DataFrame:
        if len(names) == 1:
            return self._generation(names[0])  # a generation has one row a key
        union = None
        for age, name in enumerate(names):
            one = self._generation(name).withColumn("age_", F.lit(age))
            union = one if union is None else union.unionByName(one)
        return self._newest(union, "age_")

    def _write(self, df: DataFrame) -> dict:
        name = f"generation-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return {"path": name, "rows": self._generation(name).count()}

    def current(self) -> DataFrame:
        """The newest row of every key that isn't deleted."""
        manifest = self.manifest()
        if not manifest or not manifest["generations"]:
            return self.spark.createDataFrame([], self.schema).drop(DELETED)
        rows = self._merged([g["path"] for g in manifest["generations"]])
        return rows.filter(~F.col(DELETED)).drop(DELETED)

    def merge(self, rows: DataFrame, batch: int | None = None, mark: str | None = None, deleted: DataFrame | None = None) -> dict:
        """Commit ``rows`` (and ``deleted`` keys with their order columns) as the newest of their keys; returns the manifest."""
        before = self.manifest() or {"version": 0, "batch": -1, "mark": None, "generations": []}
        if batch is not None and batch <= before["batch"]:
            return before
        new = rows.select(*self.columns, F.lit(False).alias(DELETED))
        if deleted is not None:
            gone = [F.col(c) if c in deleted.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns]
            new = new.unionByName(deleted.select(*gone, F.lit(True).alias(DELETED)))
        written = self._write(self._newest(new))
        generations = [*before["generations"], *([written] if written["rows"] else [])]
        at, total = len(generations) - 1, written["rows"]
        while at > 0 and generations[at - 1]["rows"] < GROWTH * total:
            at -= 1
            total += generations[at]["rows"]
        if 0 <= at < len(generations) - 1:
            rows = self._merged([g["path"] for g in generations[at:]])
            generations[at:] = [self._write(rows.filter(~F.col(DELETED)) if at == 0 else rows)]
        after = {"version": before["version"] + 1, "batch": before["batch"] if batch is None else batch,
                 "mark": before["mark"] if mark is None else mark, "generations": generations}
        self._commit(after)
        return after
