"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import broadcast, col, count, create_map, lit, monotonically_increasing_id, pmod, xxhash64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session (one JVM) may go without the setting: it then gets a
    scratch folder. On a cluster a missing setting is an error, because a folder
    of one machine would hide the files from the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lintel-llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Bytes of a row group that a task writing a table holds in memory.
ROW_GROUP = 32 << 20


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files every executor can read again, so a lost
    executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lintel-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: what the JVM and a Python worker hold of whole texts at a time.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to Arrow batches of at most ``BATCH_ROWS`` rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    used = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in used:
        name += "_"
    return name


#: Ids up to this number are sent to the tasks; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def without(df: DataFrame, ids: DataFrame, *id: str) -> DataFrame:
    """The rows of ``df`` whose columns ``id`` (doc_id) aren't among the rows of ``ids``; null ids stay."""
    names = list(id) or ["doc_id"]
    ids = saved(ids.distinct().toDF(*names), "dropped")
    return df.join(broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, names, "left_anti")


def numbered(df: DataFrame, id: str = "doc_id", own: str = "own_id") -> DataFrame:
    """``df`` with a number of its own for each row: the id where no other row has it, else one above all ids.

    Only rows with a null or repeated id are written down to give them
    numbers that stay. Among rows that are alike the smallest number is
    that of a row with an id of its own.
    """
    ids = df.groupBy(id).agg(count("*").alias("rows"))
    odd = saved(ids.filter("rows > 1").select(id).filter(col(id).isNotNull()), "repeated")
    nulls = df.filter(col(id).isNull())
    some = odd.count()
    if not some and nulls.isEmpty():
        return df.withColumn(own, col(id).cast("long"))
    odd = broadcast(odd) if some <= BROADCAST_IDS else odd
    above = (df.agg({id: "max"}).first()[0] or 0) + 1
    others = nulls.unionByName(df.join(odd, id, "left_semi").select(*df.columns))
    others = saved(others.withColumn(own, lit(above).cast("long") + monotonically_increasing_id()), "numbered")
    clean = df.filter(col(id).isNotNull()).join(odd, id, "left_anti").select(*df.columns)
    return clean.withColumn(own, col(id).cast("long")).unionByName(others)


def sampled(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """At most ``n`` rows, by a hash of ``by``; the hash is cut first, so that tasks sort and send about 2 n rows in all."""
    place = pmod(xxhash64(by), lit(1_000_000))
    share = 2 * n / max(df.count(), 1)
    return df.filter(place < share * 1_000_000).orderBy(place, by, *ties).limit(n)


def _level(counts: list[int], n: int) -> int:
    """The largest share such that groups of these sizes give at most ``n`` in all, one of each group at least."""
    left, share = n, 0
    for i, size in enumerate(sorted(counts)):
        share = left // (len(counts) - i)
        if size > share:
            break
        left -= size
    return max(share, 1)


def shares(df: DataFrame, group: str, by: str, n: int) -> tuple[DataFrame, dict]:
    """``(rows, sizes)``: distinct values of ``by``, at most ``n`` in all and an even share of each ``group``, chosen by hash; how many distinct ones each group has.

    Copies count once, by their hash. Every group has a row, though that be more
    than ``n``. The driver gets about 2 n hashes, to find where to cut each group.
    """
    hashed = df.select(col(group), col(by), xxhash64(by).alias("hash_"), pmod(xxhash64(by), lit(1 << 40)).alias("place_"))
    once = saved(hashed.select(group, "hash_", "place_").distinct(), "hashes")
    sizes = {r[0]: r[1] for r in once.groupBy(group).count().collect()}
    if not sizes:
        return df.select(group, by).limit(0), sizes
    share, places = _level(list(sizes.values()), n), {}

    def below(cuts: dict) -> Column:
        return col("place_") <= create_map(*[lit(x) for pair in cuts.items() for x in pair])[col(group)]

    near = once.filter(below({g: int((1 << 40) * min(1.0, (2 * share + 20) / size)) for g, size in sizes.items()}))
    for g, place in near.select(group, "place_").collect():
        places.setdefault(g, []).append(place)
    return hashed.filter(below({g: sorted(p)[:share][-1] for g, p in places.items()})).select(group, by).distinct(), sizes
