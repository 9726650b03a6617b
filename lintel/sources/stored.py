"""Metrics analysed once and kept: what dashboards read (M11 with S4, S5 and T1).

``refresh`` compares the content hash of every file with the stored one, analyses
the files that are new or changed, stamps them with the time and deletes the files that
are gone. The comparison shuffles keys and hashes; texts move only for changed files
(by a join that Spark turns into a broadcast of their keys while they are few). A
dashboard then reads narrow rows: no token pass, no text.

Defined results: a null text is a content of its own; of repeated keys in one scan one
row is kept; a repository that a scan doesn't name loses its files (a scan is whole).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from lintel.operators.metrics import METRIC_COLUMNS, METRIC_TYPES, analyze
from lintel.sources import state as S
from lintel.sources.store import KeyedStore

#: Raised when the metrics of an unchanged text change, so that stored ones are made anew.
ANALYSIS = 2
KEY = ["repo", "file_path"]


def _content_hash() -> Column:
    return F.coalesce(F.sha2(F.col("content"), 256), F.lit("null"))


def _parsed(kind: str) -> DataType:
    return DecimalType(12, 2) if kind.startswith("decimal") else {"int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "string": StringType()}[kind]


def metric_store(files: DataFrame, root: str, keep: list[str]) -> KeyedStore:
    """The store for the metrics of ``files`` with their columns ``keep``."""
    metrics = [StructField(c, _parsed(t)) for c, t in zip(METRIC_COLUMNS, METRIC_TYPES)]
    schema = StructType([*(files.schema[c] for c in [*KEY, *keep]), *metrics,
                         StructField("content_hash", StringType()), StructField("last_analyzed", TimestampType()), StructField("version", LongType())])
    return KeyedStore(files.sparkSession, root, schema, KEY, ["version"])


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't the stored one."""
    now = files.select(*KEY, _content_hash().alias("content_hash"))
    differ = now.join(known.select(*KEY, "content_hash"), [*KEY, "content_hash"], "left_anti").select(*KEY).distinct()
    return files.join(differ, KEY, "left_semi")


def refresh(store: KeyedStore, files: DataFrame, at: Column | None = None, mark: str | None = None) -> dict:
    """Bring the store up to the scan ``files``; returns the manifest."""
    before = store.manifest()
    known = store.current()
    some = changed_files(files, known) if before else files
    keep = [c for c in files.columns if c in store.columns]
    version = F.lit((before["version"] if before else 0) + 1).cast("long").alias("version")
    rows = S.stamp(analyze(some.withColumn("content_hash", _content_hash()), keep=[*keep, "content_hash"]), at).withColumn("version", version)
    gone = known.select(*KEY).join(files.select(*KEY), KEY, "left_anti").select(*KEY, version) if before else None
    return store.merge(rows, mark=mark, deleted=gone)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files below ``path``: whether an input is the one that was analysed."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files, seen = fs.listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return f"{ANALYSIS}:" + str(spark.range(1).select(F.sha2(F.lit(str(sorted(seen))), 256)).first()[0])


def stored_metrics(files: DataFrame, root: str, source: str, keep: list[str]) -> DataFrame:
    """The metrics of ``files``, refreshed first if the table at ``source`` has changed since they were stored."""
    store = metric_store(files, root, keep)
    mark, manifest = fingerprint(files.sparkSession, source), store.manifest()
    if manifest is None or manifest["mark"] != mark:
        stale = manifest is not None and (manifest["mark"] or "").split(":")[0] != str(ANALYSIS)
        if stale:  # another analysis: unchanged files count as changed
            store.merge(store.current().withColumn("content_hash", F.lit("")).withColumn("version", F.col("version") + 1))
        refresh(store, files, mark=mark)
    return store.current()
