"""Path hierarchy operators.

Trees are never materialised as recursive values: a tree is the flat table
``path_nodes(path, parent_path, name, depth, type)`` and links are rows of
``path_edges``. Global facts (the common prefix) are one-row aggregates used
as scalar subqueries, so they are computed once and never joined row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel import rules as R
from lintel.functions.tokens import materialize
from lintel.operators.scan import ranked


def _lcp_len(a: Column, b: Column) -> Column:
    """Length of the longest common character prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    seq = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    run = F.aggregate(
        seq, F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.substring(a, i, 1) == F.substring(b, i, 1)), i)
        .otherwise(acc),
    )
    return F.when(n == 0, F.lit(0)).otherwise(run)


def common_prefix(files: DataFrame, path: str = "file_path") -> DataFrame:
    """H3: longest common character prefix of all paths, one trailing '/' removed.

    The LCP of a set equals the LCP of its minimum and maximum, so this is a
    single partial+final ``min``/``max`` aggregate.
    """
    mm = files.agg(F.min(path).alias("lo"), F.max(path).alias("hi"))
    pre = mm.select(F.coalesce(F.substring(F.col("lo"), 1, _lcp_len(F.col("lo"), F.col("hi"))), F.lit(""))
                    .alias("p"))
    return pre.select(
        F.when(F.col("p").endswith("/"), F.expr("substring(p, 1, length(p) - 1)"))
        .otherwise(F.col("p")).alias("common_prefix")
    )


def common_dir(files: DataFrame, path: str = "file_path") -> DataFrame:
    """H2: the folder the file tree unwraps to (descend while a folder has a
    single child that is a folder) = segment-wise common prefix of the
    folder parts of all paths (LCP of min/max of the segment arrays)."""
    dirs = F.expr(f"slice(split(`{path}`, '/'), 1, size(split(`{path}`, '/')) - 1)")
    mm = files.agg(F.min(dirs).alias("lo"), F.max(dirs).alias("hi"))
    n = F.least(F.size("lo"), F.size("hi"))
    k = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.try_element_at("lo", i) == F.try_element_at("hi", i)), i)
        .otherwise(acc),
    )
    k = F.when(n == 0, F.lit(0)).otherwise(k)
    return mm.select(F.array_join(F.slice("lo", 1, k), "/").alias("common_dir"),
                     k.alias("common_depth"))


def root_names(files: DataFrame, path: str = "file_path") -> DataFrame:
    """H5: scanned-folder and parent-folder names with defaults Project/Root."""
    cp = common_prefix(files, path)
    parts = F.split(F.col("common_prefix"), "/")
    n = F.size(parts)
    scanned = F.coalesce(F.nullif(F.try_element_at(parts, F.lit(-1)), F.lit("")), F.lit("Project"))
    parent = F.when(n >= 2, F.nullif(F.try_element_at(parts, F.lit(-2)), F.lit("")))
    return cp.select("common_prefix", scanned.alias("scanned_name"),
                     F.coalesce(parent, F.lit("Root")).alias("parent_name"))


def path_nodes(files: DataFrame, path: str = "file_path") -> DataFrame:
    """H1: every distinct prefix of every path.

    ``(path, parent_path, name, depth, type)``; depth 0 is the first part.
    Each file emits one row per part; duplicates are removed with a
    partial+final aggregate, so a folder shared by every file costs one row
    per task before the exchange.
    """
    parts = F.split(F.col(path), "/")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.array_join(F.slice(parts, 1, i), "/").alias("path"), F.when(i == n, 1).otherwise(0).alias("file")))
    x = files.select(F.explode(prefixes).alias("n")).select("n.*")
    x = x.groupBy("path").agg(F.max("file").alias("file"))  # a number: hashed, not sorted
    own = F.split("path", "/")
    depth = F.size(own) - 1
    return x.select(
        "path", F.when(depth > 0, F.array_join(F.slice(own, F.lit(1), depth), "/")).alias("parent_path"),
        F.element_at(own, -1).alias("name"), depth.alias("depth"), F.when(F.col("file") == 1, "file").otherwise("folder").alias("type"))


def sibling_order(nodes: DataFrame) -> DataFrame:
    """O3: folders first, then names in locale order, per parent.

    Ranks come from ranges of rows with offsets: a folder with a third of all
    children is sorted and numbered by many tasks.
    """
    x = nodes.withColumn("__file", F.when(F.col("type") == "folder", 0).otherwise(1)).withColumn("__name", F.collate("name", "UNICODE"))
    x = ranked(x, ["parent_path"], ["__file", "__name", "name"], "sibling_rank")
    return x.withColumn("sibling_rank", F.col("sibling_rank").cast("int")).drop("__file", "__name")


def path_edges(files: DataFrame, path: str = "file_path") -> DataFrame:
    """H4: parent->child links below the scanned folder, relative to the
    common prefix, plus the synthetic link from the parent-folder node.

    Output ``(parent_path, child_path, child_name, child_type)``; the scanned
    folder is ``''`` and the synthetic parent is ``'..'``.
    """
    names = root_names(files, path)
    pre = names.select("common_prefix").scalar()
    # the scalar subquery is evaluated outside any higher-order function
    files = materialize(files.select(path), F.substring(F.col(path), F.length(pre) + 1, 1 << 30), "__relpath")
    rel = F.filter(F.split(F.col("__relpath"), "/"), lambda s: s != "")
    n = F.size(rel)
    links = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(
        F.array_join(F.slice(rel, 1, i), "/").alias("child_path"), F.when(i == n, 1).otherwise(0).alias("file")))
    x = files.where(n > 0).select(F.explode(links).alias("l")).select("l.*")
    x = x.groupBy("child_path").agg(F.max("file").alias("file"))
    own = F.split("child_path", "/")
    x = x.select(F.array_join(F.slice(own, F.lit(1), F.size(own) - 1), "/").alias("parent_path"), "child_path",
                 F.element_at(own, -1).alias("child_name"), F.when(F.col("file") == 1, "file").otherwise("folder").alias("child_type"))
    top = names.select(
        F.lit("..").alias("parent_path"), F.lit("").alias("child_path"),
        F.col("scanned_name").alias("child_name"), F.lit("folder").alias("child_type"))
    return x.unionByName(top)


def _listed():
    """Names that a listing shows."""
    return ~F.col("name").startswith(".") & ~F.col("name").isin(*R.LISTING_HIDDEN)


def list_children(nodes: DataFrame, folder: str) -> DataFrame:
    """Direct children of ``folder``; dot-names and noise folders hidden;
    folders first, then case-insensitive name; with the listing's parent."""
    parent_of = folder.rsplit("/", 1)[0] if "/" in folder.strip("/") else ("/" if folder.startswith("/") else None)
    kids = nodes.filter(F.col("parent_path") == F.lit(folder)).filter(_listed())
    return kids.select(
        "name", "path", (F.col("type") == "folder").alias("is_dir"),
        F.lit(folder).alias("current_path"), F.lit(parent_of).cast("string").alias("parent_path"),
    ).orderBy(F.desc("is_dir"), F.lower("name"), "name")


def folder_counts(nodes: DataFrame) -> DataFrame:
    """Per folder, the number of listed child folders and child files."""
    return nodes.filter(F.col("parent_path").isNotNull() & _listed()).groupBy("parent_path").agg(
        F.count_if(F.col("type") == "folder").alias("folder_count"),
        F.count_if(F.col("type") == "file").alias("file_count"),
    )
