"""Keyed state over metric snapshots.

Snapshots are append-only Parquet partitions ``(repo, snapshot_id)``;
"current" is the latest row per key. Upserts are a union plus one
``max_by`` aggregate on the key (partial aggregation first), so replaying
the same updates is idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel import rules as R
from lintel.functions import bands as B
from lintel.operators.keys import file_key
from lintel.sources.named_files import write_named


def stamp(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Set ``last_analyzed`` (injectable for tests)."""
    return df.withColumn("last_analyzed", at if at is not None else F.current_timestamp())


def upsert(current: DataFrame, updates: DataFrame, key: list[str] | None = None,
           order: list[str] | None = None) -> DataFrame:
    """One row per key; the newest row by ``order`` replaces the rest.

    ``order`` defaults to ``(last_analyzed, seq)``; rows of ``updates`` win
    ties over ``current``. One exchange on the key.
    """
    key = key or ["file_path"]
    order = order or ["last_analyzed", "seq"]
    cols = [c for c in current.columns]
    u = current.select(*cols, F.lit(0).alias("__src")).unionByName(
        updates.select(*cols, F.lit(1).alias("__src")))
    payload = F.struct(*[F.col(c) for c in cols if c not in key])
    rank = F.struct(*[F.col(c) for c in order], F.col("__src"))
    agg = u.groupBy(*key).agg(F.max_by(payload, rank).alias("__row"))
    return agg.select(*key, "__row.*").select(*cols)


def replace_snapshot(df: DataFrame, table_path: str) -> DataFrame:
    """Write a whole scan as its ``(repo, snapshot_id)`` partitions,
    replacing only those partitions (dynamic overwrite), and read them back."""
    (df.write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("repo", "snapshot_id")
       .parquet(table_path))
    return df.sparkSession.read.parquet(table_path)


def content_lookup(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Content per requested path; missing -> '# File not found', unreadable
    (NULL content) -> '# Error reading file: unreadable'.

    Plain left join: AQE turns it into a broadcast join at run time only if
    the requests side is measured below the broadcast threshold.
    """
    key = file_key(sources, requests)
    s = sources.select(*key, "content", F.lit(True).alias("__known"))
    return requests.select(*key).join(s, key, "left").select(
        *key,
        F.coalesce("content", F.when(F.col("__known"), F.lit(R.UNREADABLE_CONTENT)), F.lit(R.FILE_NOT_FOUND_CONTENT)).alias("content"),
        B.base_name(F.col("file_path")).alias("file_name"),
        F.col("__known").isNotNull().alias("found"))


def patch_names(df: DataFrame, path: str = "file_path") -> DataFrame:
    """``{stem}_fixed{suffix or '.py'}`` as Python's Path.stem/suffix."""
    name = B.base_name(F.col(path))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.expr("substring(__n, 1, length(__n) - length(__s))")
    x = df.withColumn("__n", name).withColumn("__s", suffix)
    return x.withColumn(
        "fixed_name",
        F.concat(stem, F.lit("_fixed"), F.when(F.col("__s") == "", ".py").otherwise(F.col("__s"))),
    ).drop("__n", "__s")


def export_patched(patched: DataFrame, root: str, path: str = "file_path", content: str = "content") -> DataFrame:
    """Write patched texts beside the names of their files (``patch_names``) below ``root`` and return what was asked for: path, written_as."""
    named = patch_names(patched, path)
    folder = F.regexp_extract(F.col(path), r"^(.*/)?[^/]*$", 1)
    named = named.withColumn("written_as", F.concat(folder, F.col("fixed_name")))
    write_named(named, root, "written_as", content)
    return named.select(path, "written_as")


def patch_overlay(snapshot: DataFrame, fixes: DataFrame) -> DataFrame:
    """Apply fixes as the next snapshot, with a status per fix.

    Full outer join on path: files without a fix are carried over, fixed
    files get the new code, fixes for unknown paths only report an error. Of
    several fixes for a path the last by ``seq`` holds (by text without one).
    """
    order = F.struct("seq", "new_code") if "seq" in fixes.columns else F.col("new_code")
    key = file_key(snapshot, fixes)
    f = fixes.groupBy(*key).agg(F.max_by("new_code", order).alias("new_code"))
    s = snapshot.select("repo", "snapshot_id", "file_path", "content")
    j = s.join(f, key, "full_outer")
    known = F.col("snapshot_id").isNotNull()
    return j.select(
        "repo",
        (F.col("snapshot_id") + 1).alias("snapshot_id"),
        "file_path",
        F.coalesce("new_code", "content").alias("content"),
        F.when(F.col("new_code").isNull(), F.lit(None).cast("string"))
        .when(~known, F.concat(F.lit("File not found: "), F.col("file_path")))
        .otherwise(F.concat(F.lit("Successfully updated "), B.base_name(F.col("file_path"))))
        .alias("message"),
        (F.col("new_code").isNotNull() & known).alias("applied"),
    )
