"""Description resolution.

Priority per file: a module docstring longer than 10 trimmed characters,
else a cached description, else (for non-blank files) a generated one, else
the 'unavailable' placeholder. Two equi left joins on the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel import rules as R
from lintel.operators.keys import file_key
from lintel.operators.metrics import is_blank as blank_source
from lintel.operators.metrics import strip_ws


def _usable_docstring():
    return F.length(strip_ws(F.col("description"))) > 10


def description_cache(previous: DataFrame) -> DataFrame:
    """Previous non-empty descriptions not starting 'Description
    unavailable'; the latest snapshot wins per path."""
    ok = previous.filter(
        F.col("description").isNotNull() & (F.col("description") != "")
        & ~F.col("description").startswith(R.DESCRIPTION_UNAVAILABLE_PREFIX))
    return ok.groupBy(*file_key(previous)).agg(
        F.max_by("description", "snapshot_id").alias("cached_description"))


def files_needing_generation(metrics: DataFrame, cache: DataFrame) -> DataFrame:
    """No usable docstring and no cache entry (left anti join)."""
    key = file_key(metrics, cache)
    return metrics.filter(~F.coalesce(_usable_docstring(), F.lit(False))).join(cache.select(*key), key, "left_anti")


def resolve_descriptions(metrics: DataFrame, cache: DataFrame, generated: DataFrame,
                         sources: DataFrame | None = None) -> DataFrame:
    """Final ``description`` per file.

    ``generated(file_path, description)`` holds answers that arrived; a file
    that needed one and has none gets the placeholder. Blank files (from
    ``sources`` when given, else ``lines_of_code == 0``) keep their value.
    """
    of_cache, of_answer = file_key(metrics, cache), file_key(metrics, generated)
    g = generated.select(*of_answer, F.col("description").alias("generated_description"))
    x = metrics.join(cache.select(*of_cache, "cached_description"), of_cache, "left").join(g, of_answer, "left")
    if sources is not None:
        of_source = file_key(metrics, sources)
        blank = sources.select(*of_source, blank_source(F.col("content")).alias("__blank"))
        x = x.join(blank, of_source, "left")
        is_blank = F.coalesce(F.col("__blank"), F.lit(True))
    else:
        is_blank = F.col("lines_of_code") == 0
    usable = F.coalesce(_usable_docstring(), F.lit(False))
    desc = (
        F.when(usable, F.col("description"))
        .when(F.col("cached_description").isNotNull(), F.col("cached_description"))
        .when(is_blank, F.col("description"))
        .when(F.col("generated_description").isNotNull(), F.col("generated_description"))
        .otherwise(F.lit(R.DESCRIPTION_UNAVAILABLE))
    )
    source = (
        F.when(usable, "docstring").when(F.col("cached_description").isNotNull(), "cache")
        .when(is_blank, "blank").when(F.col("generated_description").isNotNull(), "generated")
        .otherwise("unavailable")
    )
    cols = [c for c in metrics.columns if c != "description"]
    return x.select(*cols, desc.alias("description"), source.alias("description_source"))
