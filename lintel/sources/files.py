"""File sources (S1-S3): scan a folder tree of ``*.py`` files as a DataFrame.

Folders with the scheme ``file`` are listed and read by tasks (``local_files``).
Other stores are read by ``binaryFile``, with Hadoop's settings; their listing is
done by Spark's file index, which leaves out names that begin with ``_`` or ``.``.
Ignored folders are removed with one array predicate on the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel import rules as R
from lintel.sources import local_files as LF
from lintel.sources.named_files import write_named


def path_parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//)?", "/"), "/")


def ignored(path: Column, dirs=R.IGNORE_DIRS) -> Column:
    """S2 predicate: any part of the (absolute) path equals an ignored name."""
    return F.arrays_overlap(path_parts(path), F.array(*[F.lit(d) for d in dirs]))


def prune_ignored(df: DataFrame, path: str = "file_path", dirs=R.IGNORE_DIRS,
                  root: str | None = None) -> DataFrame:
    """Drop files under ignored folders.

    With ``root`` only the parts below the root are tested (the option
    ``relative_to_root`` of the README); by default every part is, as in the
    reference.
    """
    col = F.col(path)
    if root is not None:
        col = F.when(col.startswith(root.rstrip("/") + "/"),
                     F.substring(col, len(root.rstrip("/")) + 1, 1 << 30)).otherwise(col)
    return df.filter(~F.coalesce(ignored(col, dirs), F.lit(False)))


def scan_sources(spark: SparkSession, root: str, repo: str | None = None, snapshot_id: int = 1,
                 keep_invalid: bool = False) -> DataFrame:
    """S1 + S2 + S3: all ``*.py`` files below ``root`` with their UTF-8 text.

    Files that are not valid UTF-8 or unreadable are dropped (``keep_invalid`` keeps
    them with NULL content, for ``quarantine``). A missing root is an error.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise FileNotFoundError(f"Directory not found: {root}")
    if fs.getUri().getScheme() == "file" and fs.getFileStatus(jvm_path).isDirectory():
        shown = F.make_valid_utf8(F.col("path").cast("string"))
        listed = LF.list_files(spark, fs.makeQualified(jvm_path).toUri().getPath(), ".py", skip=R.IGNORE_DIRS)
        kept = prune_ignored(listed.withColumn("file_path", shown))
        raw = LF.read_files(kept).withColumn("file_path", shown)
    else:
        raw = (spark.read.format("binaryFile")
               .option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.py")
               .option("ignoreCorruptFiles", "true")
               .load(root)
               .select("path", "content"))
        raw = prune_ignored(raw.withColumn("file_path", F.regexp_replace("path", r"^file:/*", "/")))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    df = raw.select(
        F.lit(repo or root.rstrip("/").rsplit("/", 1)[-1]).alias("repo"),
        F.lit(snapshot_id).cast("long").alias("snapshot_id"),
        "file_path", text.alias("content"),
    )
    return df if keep_invalid else df.filter(F.col("content").isNotNull())


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: split rows into readable text and undecodable/unreadable rows."""
    good = df.filter(F.col("content").isNotNull())
    bad = df.filter(F.col("content").isNull()).select(
        "file_path", F.lit("not valid UTF-8 or unreadable").alias("reason"))
    return good, bad


def write_tree(df: DataFrame, out_dir: str, path: str = "rel_path", content: str = "content",
               encoding_bad: str | None = None) -> str:
    """Write one text file per row below ``out_dir`` (to build scan fixtures from tables);
    files marked ``encoding_bad`` begin with bytes that no UTF-8 text has."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    if encoding_bad is not None:
        data = F.when(F.col(encoding_bad), F.concat(F.lit(b"\xff\xfe"), data)).otherwise(data)
    return write_named(df.select(F.col(path).alias("path"), data.alias("content")), out_dir)
