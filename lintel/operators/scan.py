"""Skew-safe running sums and lags per key (used by P6 and X1).

A plain ``Window.partitionBy(key)`` puts every row of a key in one task; if
one key holds a third of the data that task does a third of the work. Here
each key is cut into ordered segments: the running value is computed per
``(key, segment)`` (many tasks), and each segment adds the total of the
segments before it, taken from a per-segment aggregate that is smaller than
the data by the segment length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.session import scratch_path

#: Segments of ``cut_by_rows`` for each task of a shuffle, so that tasks get even shares of them.
SEGMENTS_PER_TASK = 8


def cut_by_rows(df: DataFrame, key: list[str], order: list[str], out: str = "__cut") -> DataFrame:
    """``df`` with a segment number: even shares of all rows, ascending in (key, order).

    A key with most of the rows is cut into most of the segments. Where the
    ranges end is sampled, hence the rows are written to the shared folder
    once and read from there, with the numbers that they got.
    """
    spark = df.sparkSession
    n = SEGMENTS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *key, *order).withColumn(out, F.spark_partition_id())
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
    cut.write.parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def ranked(df: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with each row's place (from 1) among those of its key, without a task that holds a key; equal rows share their order at will."""
    x = segmented_running(cut_by_rows(df, key, order), key, order, F.lit(1).cast("long"), F.col("__cut"), out=out)
    return x.drop("__cut")


def segmented_running(df: DataFrame, key: list[str], order: list[str], value: Column | str,
                      segment: Column, out: str = "running", inclusive: bool = True,
                      prev_out: str | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` per ``key`` in ``order``.

    ``segment`` must be non-decreasing in ``order`` within a key (for example
    ``pos div 4096`` or an hour bucket). With ``prev_out`` also adds the
    previous row's value per key (``lag``), crossing segment borders.
    """
    v = F.col(value) if isinstance(value, str) else value
    # a NULL segment (a row without a place in the order) is the first one
    x = df.withColumn("__seg", F.coalesce(segment.cast("long"), F.lit(-(1 << 62)))).withColumn("__v", v)
    ob = [F.col(c) for c in order]
    frame = Window.partitionBy(*key, "__seg").orderBy(*ob)
    hi = 0 if inclusive else -1
    x = x.withColumn("__local", F.coalesce(
        F.sum("__v").over(frame.rowsBetween(Window.unboundedPreceding, hi)), F.lit(0)))
    if prev_out:
        x = x.withColumn("__lag", F.lag("__v").over(frame)).withColumn("__nth", F.row_number().over(frame))
    seg = x.groupBy(*key, "__seg").agg(
        F.sum("__v").alias("__tot"),
        F.max_by(F.struct("__v"), F.struct(*ob)).alias("__last"),
    )
    sw = Window.partitionBy(*key).orderBy("__seg")
    seg = seg.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], F.col("__seg").alias("__s"),
        F.coalesce(F.sum("__tot").over(sw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.lag("__last").over(sw)["__v"].alias("__prev_last"),
    )
    same = F.col("__seg") == F.col("__s")
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    y = x.join(seg, same, "inner").withColumn(out, F.col("__local") + F.col("__off"))
    if prev_out:
        y = y.withColumn(prev_out, F.when(F.col("__nth") == 1, F.col("__prev_last")).otherwise(F.col("__lag")))
        y = y.drop("__lag", "__nth")
    return y.drop("__seg", "__v", "__local", "__off", "__prev_last", "__s", *[f"__k{i}" for i in range(len(key))])
