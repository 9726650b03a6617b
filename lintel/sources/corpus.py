"""Adapters from the driver tables to the engine's input schemas.

The driver tables hold prose, pages, conversations and TPC-H-like facts but
no source code or model answers, so each adapter derives an engine input
from a table with plain DataFrame expressions (map-only, no shuffle). Each
one is mirrored by an SQL text in ``lintel.plans.oracle`` that DuckDB runs.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """Deal CPU-heavy rows out evenly by key, at any size.

    The metric pass costs far more than moving a text once, and a file may hold
    one large row group, which Spark can't split among tasks.
    """
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


# ---------------------------------------------------------------------------
# docs_corpus: documents as files with synthetic paths
# ---------------------------------------------------------------------------

def doc_path(doc_id: Column, source: Column, lang: Column) -> Column:
    sub = (
        F.when(doc_id % 13 == 0, "venv/")
        .when(doc_id % 17 == 0, ".git/")
        .when(doc_id % 19 == 0, "pkg/sub/")
        .otherwise("")
    )
    ext = F.when(doc_id % 7 == 0, ".txt").otherwise(".py")
    return F.concat(F.lit("/srv/"), source, F.lit("/"), lang, F.lit("/"), sub, F.lit("m"), doc_id.cast("string"), ext)


def docs_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, snapshot_id, file_path, content, doc_id)`` from documents."""
    d = spread(spark, table(spark, sf_dir, "documents"), "doc_id")
    return d.select(
        d.source.alias("repo"),
        F.lit(1).cast("long").alias("snapshot_id"),
        doc_path(d.doc_id, d.source, d.lang).alias("file_path"),
        d.text.alias("content"),
        d.doc_id,
    )


# ---------------------------------------------------------------------------
# code_corpus: one Python file per document, built from hand-counted blocks
# ---------------------------------------------------------------------------

# Each block: text, lines of code, control-flow nodes, cognitive complexity,
# statements, operator counts by node type, operand texts in order. The
# counts are made by hand from the Python grammar, never by the engine.
BLOCKS = [
    ("def add(a, b):\n    return a + b\n",
     2, 0, 0, 2, {"binary_operator": 1},
     ["add", "a", "b", "a", "b"]),
    ("def sign(v):\n    if v > 0:\n        return 1\n    else:\n        return -1\n",
     5, 2, 2, 5, {"comparison_operator": 1, "unary_operator": 1},
     ["sign", "v", "v", "0", "1", "1"]),
    ("def walk(items):\n    if items:\n        for item in items:\n            print(item)\n",
     4, 2, 3, 4, {},
     ["walk", "items", "items", "item", "items", "print", "item"]),
    ("try:\n    if ready:\n        state = 1\nexcept KeyError:\n    state = 0\n",
     5, 3, 4, 5, {"assignment": 2},
     ["ready", "state", "1", "KeyError", "state", "0"]),
    ("while count < limit:\n    if count % 2 == 0:\n        count += 1\n    elif count % 3 == 0:\n"
     "        count += 2\n    else:\n        count += 3\n",
     7, 4, 7, 7, {"comparison_operator": 3, "binary_operator": 2, "augmented_assignment": 3},
     ["count", "limit", "count", "2", "0", "count", "1", "count", "3", "0", "count", "2", "count", "3"]),
    ('with open(path) as handle:\n    for line in handle:\n        if line and not line.startswith("#"):\n'
     "            lines.append(line)\n",
     4, 3, 6, 4, {"boolean_operator": 1, "not_operator": 1},
     ["open", "path", "handle", "line", "handle", "line", "line", "startswith", '"#"', "lines", "append", "line"]),
    ('class Router:\n    def route(self, cmd):\n        match cmd:\n            case "go":\n                return 1\n'
     "            case other:\n                return 0\n",
     7, 1, 1, 7, {},
     ["Router", "route", "self", "cmd", "cmd", '"go"', "1", "other", "0"]),
    ("squares = [n * n for n in range(10) if n % 2]\nkey = lambda item: item[0]\n"
     'label = f"{squares} {key.name:>{width}} {{x}} {n * 2!r}"\n',
     3, 0, 0, 3, {"assignment": 3, "binary_operator": 3},
     ["squares", "n", "n", "n", "range", "10", "n", "2", "key", "item", "item", "0",
      "label", 'f"{squares} {key.name:>{width}} {{x}} {n * 2!r}"', "squares", "key", "name", "width", "n", "2"]),
    ("if debug:\n    def trace(msg):\n        for part in msg:\n            if part:\n                log(part)\n",
     5, 3, 6, 5, {},
     ["debug", "trace", "msg", "part", "msg", "part", "log", "part"]),
    ("@cache\ndef bounded(low, value, high):\n    ok = (low <= value\n          <= high)\n"
     "    return ok and value != 0\n",
     5, 0, 0, 4, {"assignment": 1, "comparison_operator": 2, "boolean_operator": 1},
     ["cache", "bounded", "low", "value", "high", "ok", "low", "value", "high", "ok", "value", "0"]),
]

# The per-line loop: one ``if`` inside a ``for`` for every line of the text.
LOOP_HEAD = "for row in rows:\n"
LOOP_LINE = "    if flag:\n        total += 1\n"
LOOP_HEAD_OPERANDS = ["row", "rows"]
LOOP_LINE_OPERANDS = ["flag", "total", "1"]


# Two special files: one of white space, one healthy statement.
BLANK_FILE, TINY_FILE = "\n  \t\n", "x = 1\n"


def code_text(doc_id: Column, text: Column) -> Column:
    """The Python file derived from one document: the text as module
    docstring, blocks ``doc_id % 10`` and ``doc_id / 10 % 10``, then a loop
    with one ``if`` per line of the text."""
    body = F.regexp_replace(text, '"""', "")
    d0 = (doc_id % 10).cast("int")
    d1 = (F.floor(doc_id / 10) % 10).cast("int")
    blocks = F.array(*[F.lit(b[0]) for b in BLOCKS])
    n_lines = F.size(F.split(text, "\n", -1))
    loop = F.concat(F.lit(LOOP_HEAD), F.repeat(F.lit(LOOP_LINE), n_lines))
    return F.concat(
        F.lit('"""\n'), body, F.lit('\n"""\n\n\n'),
        blocks[d0], F.lit("\n\n"), blocks[d1], F.lit("\n\n"),
        loop,
    )


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, snapshot_id, file_path, content, doc_id)``: code from documents."""
    d = spread(spark, table(spark, sf_dir, "documents"), "doc_id")
    content = (F.when(d.doc_id % 29 == 0, F.lit(BLANK_FILE)).when(d.doc_id % 31 == 0, F.lit(TINY_FILE))
               .otherwise(code_text(d.doc_id, d.text)))
    return d.select(
        d.source.alias("repo"),
        F.lit(1).cast("long").alias("snapshot_id"),
        F.concat(F.lit("/code/"), d.source, F.lit("/"), d.lang, F.lit("/mod_"), d.doc_id.cast("string"),
                 F.lit(".py")).alias("file_path"),
        content.alias("content"),
        d.doc_id,
    )
