"""Line tables (P1) and side-by-side diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(files: DataFrame, content: str = "content", key: str = "file_path") -> DataFrame:
    """``(key, line_no, line)``, 1-based, split on '\\n' (trailing empty kept)."""
    return files.select(key, F.posexplode(F.split(F.col(content), "\n", -1)).alias("i", "line")).select(
        key, (F.col("i") + 1).alias("line_no"), "line")


def diff_lines(pairs: DataFrame, original: str = "original", fixed: str = "fixed",
               key: str = "file_path") -> DataFrame:
    """Original and fixed lines aligned by line number with a change flag.

    Both texts of a file sit in one row, so alignment is an ``arrays_zip``
    of the two line arrays (a full outer alignment: the shorter side is
    NULL-padded) followed by one explode: no join and no exchange. When the
    two versions live in different tables, join them on ``key`` first.
    """
    a = F.split(F.col(original), "\n", -1)
    b = F.split(F.col(fixed), "\n", -1)
    z = pairs.select(key, F.posexplode(F.arrays_zip(a.alias("o"), b.alias("f"))).alias("i", "z"))
    return z.select(
        key, (F.col("i") + 1).alias("line_no"),
        F.col("z.o").alias("original_line"), F.col("z.f").alias("fixed_line"),
        (~F.col("z.o").eqNullSafe(F.col("z.f"))).alias("changed"),
    )
