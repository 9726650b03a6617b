"""Classification and formatting columns.

All are ``when`` chains or string builders: JVM-side, codegen'd, no shuffle.
Thresholds are FIXED VALUES equal to the reference's dashboards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gauge_band(mi: Column) -> Column:
    """Project gauge colour for a mean MI: >=80 green, >=50 amber, else red."""
    return F.when(mi >= 80, "green").when(mi >= 50, "amber").otherwise("red")


def file_band(mi: Column) -> Column:
    """Per-file colour: >=85 green, >=65 yellow, else red (NULL counts as 100)."""
    m = F.coalesce(mi, F.lit(100.0))
    return F.when(m >= 85, "green").when(m >= 65, "yellow").otherwise("red")


def component_status(mi: Column) -> Column:
    """>=65 NOMINAL, >=40 DEGRADED, else CRITICAL."""
    return F.when(mi >= 65, "NOMINAL").when(mi >= 40, "DEGRADED").otherwise("CRITICAL")


def health_text(mi: Column) -> Column:
    """C4: >=85 Excellent, >=70 Good, >=50 Moderate, >=30 Poor, else Critical."""
    return (
        F.when(mi >= 85, "Excellent").when(mi >= 70, "Good").when(mi >= 50, "Moderate")
        .when(mi >= 30, "Poor").otherwise("Critical")
    )


def debt_band(hours: Column) -> Column:
    """<=2 green, <=8 amber, else red."""
    return F.when(hours <= 2, "green").when(hours <= 8, "amber").otherwise("red")


def cognitive_band(cc: Column) -> Column:
    """<5 green, <15 amber, else red."""
    return F.when(cc < 5, "green").when(cc < 15, "amber").otherwise("red")


def complexity_rating(cc: Column) -> Column:
    """<5 LOW, <=15 MODERATE, <=30 HIGH, else VERY HIGH."""
    return F.when(cc < 5, "LOW").when(cc <= 15, "MODERATE").when(cc <= 30, "HIGH").otherwise("VERY HIGH")


def mi_class(mi: Column) -> Column:
    """Documented classes 85-100 high, 65-85 moderate, 0-65 low."""
    return F.when(mi >= 85, "high").when(mi >= 65, "moderate").otherwise("low")


def debt_text(hours: Column) -> Column:
    """<1h as minutes ``Nm``, <10h one decimal ``N.Nh``, else ``Nh``.

    Rounding is half away from zero on the decimal value (JavaScript rounds
    half up; equal for the non-negative hours produced here).
    """
    h = hours.cast("decimal(14,4)")
    return (
        F.when(h < 1, F.concat(F.round(h * 60, 0).cast("long").cast("string"), F.lit("m")))
        .when(h < 10, F.concat(F.format_number(F.round(h, 1), 1), F.lit("h")))
        .otherwise(F.concat(F.round(h, 0).cast("long").cast("string"), F.lit("h")))
    )


def gauge_percent(value: Column, max_value: float) -> Column:
    """min(value / max * 100, 100)."""
    return F.least(value / F.lit(float(max_value)) * 100.0, F.lit(100.0))


def node_weight(control: Column) -> Column:
    """C11: clamp(log2(control + 1) * 12, 35, 90)."""
    return F.greatest(F.lit(35.0), F.least(F.lit(90.0), F.log2(F.coalesce(control, F.lit(0)) + 1) * 12.0))


def base_name(path: Column) -> Column:
    """Last '/'-separated part (falls back to the whole path)."""
    name = F.substring_index(path, "/", -1)
    return F.when(name == "", path).otherwise(name)


def padded_id(idv: Column, width: int = 4) -> Column:
    """Left-pad with zeros like padStart (never truncates)."""
    s = idv.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def report_columns(metrics) -> list[Column]:
    """C12 and the figures of a file's report: base name, padded id, day of the scan, rounded metrics with their words."""
    mi, cog = F.col("maintainability_index"), F.col("cognitive_complexity")
    return [
        F.col("file_path"), base_name(F.col("file_path")).alias("file_name"), padded_id(F.col("doc_id")).alias("report_id"),
        F.to_date("last_analyzed").alias("scan_date"), component_status(mi).alias("status"), complexity_rating(cog).alias("complexity_rating"),
        F.format_number(F.round(mi, 0), 0).alias("maintainability"), cog, F.format_number("lines_of_code", 0).alias("lines_of_code"),
        F.round("halstead_volume", 0).cast("long").cast("string").alias("volume"), F.round("sqale_debt_hours", 1).cast("decimal(12,1)").cast("string").alias("debt_hours"),
        F.coalesce("description", F.lit("")).alias("description"),
    ]


def needs_diagnosis(mi: Column, cognitive: Column) -> Column:
    """F1 predicate: NOT (MI >= 85 AND cognitive < 5)."""
    return ~((mi >= 85) & (cognitive < 5))
