"""Aggregations, top-k and triage over ``file_metrics``.

Aggregates are plain ``groupBy().agg`` so Spark plans a partial (map-side)
hash aggregate before the exchange: only one small row per group and task
crosses the network, whatever the skew of the group key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions import bands as B
from lintel.operators.keys import file_key


#: Sums that health columns are made of; sums of sums give those of wider groups.
HEALTH_SUMS = {
    "files": lambda: F.count(F.lit(1)),
    # mean MI from exact hundredths: the same IEEE division in every engine,
    # so no summation-order drift between runs or engines
    "mi_cents": lambda: F.sum(F.round(F.col("maintainability_index") * 100).cast("long")),
    "debt": lambda: F.sum("sqale_debt_hours"),
    "cognitive": lambda: F.sum("cognitive_complexity"),
    "loc": lambda: F.sum("lines_of_code"),
}


def _health(sums: DataFrame, by: list[str]) -> DataFrame:
    files = F.col("files")
    return sums.select(
        *by, "files",
        F.coalesce(F.col("mi_cents") / files / 100.0, F.lit(100.0)).alias("avg_mi"),
        F.coalesce("debt", F.lit(0)).cast("decimal(22,2)").alias("total_debt_hours"),
        F.coalesce(F.col("cognitive") / files, F.lit(0.0)).alias("avg_cognitive"),
        F.coalesce("loc", F.lit(0).cast("long")).alias("total_loc"))


def project_health(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1: files, avg MI (100 if none), total debt, avg cognitive (0 if none), total LOC."""
    by = by or []
    aggs = [a().alias(n) for n, a in HEALTH_SUMS.items()]
    return _health(metrics.groupBy(*by).agg(*aggs) if by else metrics.agg(*aggs), by)


def health_dashboard(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1 with the gauge classifications."""
    h = project_health(metrics, by)
    return h.select(
        *(by or []), "files", "avg_mi", "total_debt_hours", "avg_cognitive", "total_loc",
        B.gauge_band(F.col("avg_mi")).alias("mi_band"),
        B.health_text(F.col("avg_mi")).alias("health_text"),
        B.debt_band(F.col("total_debt_hours")).alias("debt_band"),
        B.cognitive_band(F.col("avg_cognitive")).alias("cognitive_band"),
        B.debt_text(F.col("total_debt_hours")).alias("debt_text"),
        B.gauge_percent(F.col("avg_mi"), 100).alias("health_pct"),
        B.gauge_percent(F.least(F.col("total_debt_hours").cast("double"), F.lit(40.0)), 40).alias("debt_pct"),
        B.gauge_percent(F.least(F.col("avg_cognitive"), F.lit(30.0)), 30).alias("cognitive_pct"),
    )


def insight(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A5: the insight row exists only when files > 0 and debt > 0."""
    h = project_health(metrics, by)
    return h.filter((F.col("files") > 0) & (F.col("total_debt_hours") > 0)).select(
        *(by or []),
        F.round("avg_mi", 0).cast("int").alias("healthy_pct"),
        B.debt_text(F.col("total_debt_hours")).alias("remediation"),
    )


def scan_summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A2: files scanned and total complexity."""
    aggs = [F.count(F.lit(1)).alias("files_scanned"),
            F.coalesce(F.sum("complexity_score"), F.lit(0).cast("long")).alias("total_complexity")]
    return metrics.groupBy(*by).agg(*aggs) if by else metrics.agg(*aggs)


def list_metrics(metrics: DataFrame) -> DataFrame:
    """Whole table, highest complexity first, ties by path (total order)."""
    return metrics.orderBy(F.desc("complexity_score"), F.asc("file_path"))


def top_complex(metrics: DataFrame, k: int, by: list[str] | None = None,
                order_col: str = "complexity_score") -> DataFrame:
    """O2: the k most complex files, overall (TakeOrderedAndProject) or per group.

    Per group, a window rank keeps only k rows per key after a shuffle on the
    key; the overall form never shuffles more than k rows per task.
    """
    order = [F.desc(order_col), F.asc("file_path")]
    if not by:
        return metrics.orderBy(*order).limit(k)
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(*order)
    return metrics.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def triage(metrics: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """F1 + F2: files worth a diagnosis that still exist in ``sources``."""
    m = metrics.filter(B.needs_diagnosis(F.col("maintainability_index"), F.col("cognitive_complexity")))
    if sources is not None:
        key = file_key(m, sources)
        m = m.join(sources.select(*key), key, "left_semi")
    return m


def folder_rollup(metrics: DataFrame, root: str = "/") -> DataFrame:
    """A1 for every folder above each file (all ancestor folders), per repo.

    A bare file name has no folder above it and counts in none.

    Files are added up by their own folder first; the sums of each folder, not
    the files, are then given to the folders above it and added up again. A
    hot folder (the root holds every file) is pre-aggregated map-side, so each
    task sends one row per folder.
    """
    parts = F.split(F.col("file_path"), "/")
    own = metrics.withColumn("own", F.slice(parts, F.lit(1), F.size(parts) - 1)).filter(F.size("own") > 0)
    sums = own.groupBy("repo", "own").agg(*[a().alias(n) for n, a in HEALTH_SUMS.items()])
    above = F.transform(F.sequence(F.lit(1), F.size("own")), lambda i: F.array_join(F.slice(F.col("own"), F.lit(1), i), "/"))
    x = sums.select("repo", F.explode(above).alias("folder"), *HEALTH_SUMS)
    x = x.withColumn("folder", F.when(F.col("folder") == "", F.lit(root)).otherwise(F.col("folder")))
    return _health(x.groupBy("repo", "folder").agg(*[F.sum(n).alias(n) for n in HEALTH_SUMS]), ["repo", "folder"])
