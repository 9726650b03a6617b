"""Adapters for answers, issues, fix facts, events and pages.

All are map-side projections of the driver tables, plus one equi-join to
``documents`` (the dimension that gives a file its path) where needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.sources.corpus import table


def code_path(doc_id: Column, source: Column, lang: Column) -> Column:
    return F.concat(F.lit("/code/"), source, F.lit("/"), lang, F.lit("/mod_"), doc_id.cast("string"), F.lit(".py"))


def _doc_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", code_path(d.doc_id, d.source, d.lang).alias("file_path"))


def label_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues from labels: toxic -> high, low quality -> medium, else low;
    toxic and low quality -> 'critical' (an unknown severity)."""
    lab = table(spark, sf_dir, "labels")
    x = lab.join(_doc_dim(spark, sf_dir), "doc_id", "inner")
    sev = (F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "critical")
           .when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low"))
    issue = (F.when(F.col("toxic") == 1, "Unsafe content").when(F.col("quality") == 0, "Low quality text")
             .otherwise("Minor wording"))
    return x.select("file_path", issue.alias("issue"), sev.alias("severity"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers built from the turns, nine shapes by ``conv_id % 9``: fenced
    JSON, bare JSON, JSON with missing keys, a JSON array, prose, prose that
    mentions an error, and JSON with text, null or number where another type
    is expected. A conversation without a document has a path of its own."""
    c = table(spark, sf_dir, "conversations")
    c = c.join(_doc_dim(spark, sf_dir), c.conv_id == F.col("doc_id"), "left")
    path = F.coalesce("file_path", F.concat(F.lit("/code/none/conv_"), F.col("conv_id").cast("string"), F.lit(".py")))
    js = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    sev = F.try_element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("turn") % 3 + 1).cast("int"))
    flag = F.col("turn") % 4 == 1
    shape = F.col("conv_id") % 9
    resp = (
        F.when(shape == 0, F.concat(F.lit("\n\t```json\n"), js(has_bug=F.lit(True), issue=F.col("text"), severity=sev), F.lit("\n```")))
        .when(shape == 1, js(has_bug=flag, issue=F.col("text")))
        .when(shape == 2, F.lit('{"has_bug": true}'))
        .when(shape == 3, F.lit("[1, 2, 3]"))
        .when(shape == 4, F.col("text"))
        .when(shape == 6, F.lit('{"has_bug": "false", "is_healthy": true, "suggestions": ["a", "b"]}'))
        .when(shape == 7, F.lit('{"has_bug": true, "issue": null, "is_healthy": null}'))
        .when(shape == 8, F.lit('{"has_bug": 2, "severity": "low", "is_healthy": "yes", "suggestions": null}'))
        .otherwise(F.concat(F.lit("Found an error: "), F.col("text")))
    )
    return c.select(path.alias("file_path"), "conv_id", "turn", resp.alias("response"))


PRIORITY_TYPES = (
    ("1-URGENT", "Behavioral Bug"),
    ("2-HIGH", " Typo"),
    ("3-MEDIUM", "DOCS "),
    ("4-NOT SPECIFIED", "style"),
    ("5-LOW", "refactor"),
)


def fix_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order; the file is the customer's file; orders with
    status 'P' point at a missing file; 'F' orders have no verifier."""
    o = table(spark, sf_dir, "orders")
    raw = F.lit("unknown")
    for prio, t in reversed(PRIORITY_TYPES):
        raw = F.when(F.col("o_orderpriority") == prio, F.lit(t)).otherwise(raw)
    path = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("/fix/missing/c"), F.col("o_custkey").cast("string"),
                                                           F.lit(".py"))) \
        .otherwise(F.concat(F.lit("/fix/c"), F.col("o_custkey").cast("string"), F.lit(".py")))
    return o.select(
        F.col("o_orderkey").alias("request_id"), path.alias("file_path"),
        F.col("o_orderpriority").alias("instruction"), raw.alias("issue_type_raw"),
        (F.col("o_orderstatus") != "F").alias("verifier_available"),
    )


def fix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files for fix requests: one per customer; negative balance = unreadable."""
    cu = table(spark, sf_dir, "customer")
    return cu.select(
        F.concat(F.lit("/fix/c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("file_path"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("name = '"), F.col("c_name"), F.lit("'\n")))
        .alias("content"),
    )


def fix_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts per order from its line items: attempt 0 is the reproduction
    run, 1.. the fixes, numbered over all columns ((l_orderkey, l_linenumber)
    is not unique). Return flag R -> traceback, A -> error, N -> passes."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")
    out = (F.when(F.col("l_returnflag") == "R", F.lit("Traceback (most recent call last): boom"))
           .when(F.col("l_returnflag") == "A", F.lit("Error: assertion failed"))
           .otherwise(F.concat(F.lit("ok "), F.col("l_linenumber").cast("string"))))
    return li.select(
        F.col("l_orderkey").alias("request_id"),
        (F.row_number().over(w) - 1).alias("attempt"),
        out.alias("output"),
        F.concat(F.lit("fixed_"), F.col("l_partkey").cast("string")).alias("fixed_code"),
    )


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric updates from events: user = file, ts = analysis time,
    value = debt hours, event_id = sequence number."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("/events/user_"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.col("ts").alias("last_analyzed"), F.col("event_id").alias("seq"),
        F.col("value").cast("decimal(12,2)").alias("sqale_debt_hours"),
        F.col("event_type"),
    )


def arrivals(events: DataFrame, days: int = 5) -> DataFrame:
    """Events with the number of the delivery they come in: ``days`` days each, every tenth event one delivery late."""
    own = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (86400 * days)).cast("int")
    return events.withColumn("arrival", own + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
