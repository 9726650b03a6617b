"""Markup as a tree of nodes (P8), its depths (P6) and costs by rules.

``markup_nodes`` builds the tree of every page in one pass over its text: a stack of
open elements, and rules for what markup leaves out.

- Every tag name counts, A-Z lower-cased. Comments, declarations and processing
  instructions aren't nodes; the content of script, style, textarea and title is text.
- Void elements and tags that end in ``/>`` hold nothing.
- An opening tag first closes what it implies (``ENDS``): a new ``li`` the one before,
  a block the paragraph it stands in, a cell the cell before, and all that is open inside.
- A closing tag closes the nearest open element of its name and all inside it. Without one in
  reach (``WALLS``) it is a stray and nothing happens.
- What is open at the end of the page is closed there.

A tag whose quotes don't pair before the next ``<`` is text. The pass is a pandas-free
Arrow function: a page's nodes come out as rows, which a JVM fold could only give by
copying its growing list at every tag. Rows are independent, no shuffle.

Defined results: a null or empty page has no nodes; repeated pages give their nodes
again; offsets count characters; other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lintel.operators import nodes as N
from lintel.rules import RULE_SCHEMA

# Element names of the public HTML standard.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title")
BLOCKS = ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
CELLS = ("td", "th")
ROW_GROUPS = ("thead", "tbody", "tfoot")
TABLE_PARTS = ("table", "caption", "tr", *CELLS, *ROW_GROUPS)
#: Opening tag -> (elements it closes, elements beyond which it closes nothing).
ENDS = {
    **{b: (("p",), ("button", "caption", "table", *CELLS)) for b in BLOCKS},
    "li": (("li",), ("menu", "ol", "ul")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    **{c: (CELLS, ("table", "tr")) for c in CELLS},
    "tr": (("tr", *CELLS), ("table",)),
    **{g: (("tr", *CELLS, *ROW_GROUPS), ("table",)) for g in ROW_GROUPS},
    "option": (("option",), ("datalist", "optgroup", "select")),
    "optgroup": (("option", "optgroup"), ("select",)),
}
#: A closing tag doesn't reach beyond these; those of table parts reach up to the table.
WALLS = ("caption", "table", *CELLS)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^"'<>]|"[^"<]*"|'[^'<]*')*+)>""", re.S)
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}

TEXT = "#text"
SCHEMA = [StructField("seq", IntegerType()), StructField("start", LongType()), StructField("end", LongType()), StructField("node_type", StringType()),
          StructField("parent_type", StringType()), StructField("text", StringType())]

#: Rules of the cost query.
MARKUP_RULES = (
    ("div", "control", 1), ("ul", "control", 1), ("nav", "control", 1), ("article", "control", 1),
    ("div", "nesting", 1), ("ul", "nesting", 1), ("nav", "nesting", 1), ("article", "nesting", 1),
    ("li", "nesting", 1),
)
#: A user's rules: other weights, a page's body doesn't deepen, inline elements are operators and texts operands.
WEIGHTED_RULES = (
    ("p", "control", 3), ("li", "control", 1), ("div", "control", 2),
    ("body", "nesting", 1), ("ul", "nesting", 1), ("li", "nesting", 1), ("article", "nesting", 1), ("p", "nesting", 1),
    ("html", "encapsulation", 1),
    ("a", "operator", 1), ("b", "operator", 1), ("br", "operator", 1), ("#text", "operand", 1),
)


def page_nodes(html: str) -> list[list]:
    """The nodes of one page in the order in which they start: [start, end, type, parent type, text]."""
    out: list[list] = []
    open_: list[list] = []

    def text(a: int, b: int) -> None:
        if a < b and not html[a:b].isspace():
            out.append([a, b, TEXT, open_[-1][2] if open_ else None, html[a:b].strip()])

    def close_from(i: int, end: int) -> None:
        for node in open_[i:]:
            node[1] = end
        del open_[i:]

    def nearest(names: tuple, walls: tuple) -> int | None:
        """The outermost open element of these names before a wall."""
        found = None
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][2] in names:
                found = i
            elif open_[i][2] in walls:
                break
        return found

    at, m = 0, _TOKEN.search(html)
    while m:
        text(at, m.start())
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                walls = ("table",) if name in TABLE_PARTS else WALLS
                i = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][2] == name or open_[i][2] in walls), None)
                if i is not None and open_[i][2] == name:
                    close_from(i, at)
            else:
                if name in ENDS:
                    i = nearest(*ENDS[name])
                    if i is not None:
                        close_from(i, m.start())
                node = [m.start(), at, name, open_[-1][2] if open_ else None, None]
                out.append(node)
                if name in RAW:
                    end = _RAW_END[name].search(html, at)
                    open_.append(node)
                    text(at, end.start() if end else len(html))
                    at = node[1] = end.end() if end else len(html)
                    open_.pop()
                elif name not in VOID and not m[3].endswith("/"):
                    open_.append(node)
        m = _TOKEN.search(html, at)
    text(at, len(html))
    close_from(0, len(html))
    return out


def markup_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, seq, start, end, node_type, parent_type, text)``; ``seq`` numbers a page's nodes from 1 as they start."""
    schema = StructType([StructField(key, pages.schema[key].dataType), *SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).type
            for k, x in zip(*batch.columns):
                found = page_nodes(x.as_py()) if x.is_valid else []
                for i in range(0, len(found), 50_000):
                    some = found[i:i + 50_000]
                    cols = list(zip(*some))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k.as_py()] * len(some), kind), pa.array(range(i + 1, i + 1 + len(some)), pa.int32()),
                        *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())))], names=schema.names)

    return pages.select(key, html).mapInArrow(run, schema)


def markup_rules(spark: SparkSession, rules: tuple = MARKUP_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("node_type") != TEXT)


def nesting_stats(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """P8 + M4: elements, greatest and total depth of each page; 0 for pages without elements."""
    depths = N.node_depth(elements(markup_nodes(pages, key)), [key]).select(key, "depth")
    none = pages.select(key, F.lit(None).cast("long").alias("depth"))
    return depths.unionByName(none).groupBy(key).agg(
        F.count("depth").cast("int").alias("node_count"), F.coalesce(F.max("depth"), F.lit(0)).cast("int").alias("max_depth"),
        F.coalesce(F.sum("depth"), F.lit(0)).alias("total_depth"))


def nesting_cost(nodes: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """R1 + M3: control elements of each page that has any, and their weight * (1 + depth)."""
    m = N.analyze_nodes(nodes, rules, [key]).filter("complexity_score > 0")
    return m.select(key, F.col("complexity_score").cast("long").alias("control_nodes"), F.col("cognitive_complexity").alias("nesting_cost"))
