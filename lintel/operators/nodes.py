"""Depths and metrics of any syntax tree given as a flat table of nodes.

``nodes(key..., start, end, node_type, parent_type, text)`` holds one row a node
with the half-open extent of its text. Depth is an interval sweep: a node adds one
where it starts and takes it away where it ends, and a node's depth is the running
sum before its start. The running sum is cut by position and not by key, so a file
with a third of all nodes is spread over tasks like the rest.

Ties: at one position ends come before starts, and of the nodes that start there
the longer one is outside. Nodes with the same extent nest in the order of ``seq``
where the table has that column (preorder), else in the order in which their parent
types link up. A node with an empty extent lies inside the nodes around its position,
not in those that end or start there, and holds nothing.

Which node types count for what is a table of rules ``(node_type, role, weight)``:

- ``control``: counts, and costs weight * (1 + depth);
- ``nesting``: deepens what it holds, unless its parent is an ``encapsulation``;
- ``operator`` (unique by type) and ``operand`` (unique by text) for the volume.

Defined results: a null extent is left out of depths and costs, but the node is counted;
nodes of a null type or a type without a rule count as nodes only; null keys form
a group; an empty table gives no rows; repeated rules count once for each role, with
their weights added up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators.metrics import halstead_volume, maintainability_index, sqale_hours
from lintel.operators.scan import segmented_running
from lintel.session import scratch_path

#: Characters of text whose events one segment of the running sum holds.
SEGMENT = 1 << 16
ROLES = ("control", "nesting", "encapsulation", "operator", "operand")
#: Characters up to which an operand's text is its own key; longer ones are told apart by their digest.
SHORT = 64


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table in the shared folder: computed once, however often it is read, and of a size that Spark knows."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rule_columns(rules: DataFrame) -> DataFrame:
    """One row for each node type: its weight in each role (null: it hasn't that role)."""
    return rules.groupBy("node_type").agg(*[F.sum(F.when(F.col("role") == r, F.col("weight"))).alias(f"__{r}") for r in ROLES])


def with_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes with their weights by role, and whether they deepen what they hold.

    The rules are written down first: only if Spark knows their size before it plans the join does it send
    small ones to the nodes, instead of dealing all nodes out by their few types.
    """
    wide = _written(rule_columns(rules), "rules")
    of_parent = wide.filter(F.col("__encapsulation").isNotNull()).select(F.col("node_type").alias("parent_type"), F.lit(True).alias("__held"))
    x = nodes.join(wide, "node_type", "left").join(of_parent, "parent_type", "left")
    return x.withColumn("__step", F.when(F.col("__nesting").isNotNull() & F.col("__held").isNull(), 1).otherwise(0)).drop("__held", "__encapsulation", "__nesting")


def _linked(group: Column) -> Column:
    """Nodes of one extent, outermost first: each names its parent's type."""
    def uses(kind: str, name: Column) -> Column:
        return F.size(F.filter(group, lambda n: n[kind].eqNullSafe(name)))

    outer = F.filter(group, lambda n: uses("parent_type", n["parent_type"]) > uses("node_type", n["parent_type"]))
    first = F.coalesce(F.get(outer, F.lit(0)), F.get(group, F.lit(0)))["parent_type"]

    def step(a: Column, _: Column) -> Column:
        fits = F.transform(a["left"], lambda n: n["parent_type"].eqNullSafe(a["want"]))
        at = F.greatest(F.array_position(fits, F.lit(True)), F.lit(1)).cast("int")
        node = F.element_at(a["left"], at)
        rest = F.concat(F.slice(a["left"], F.lit(1), at - 1), F.slice(a["left"], at + 1, F.size(a["left"])))
        return F.struct(rest.alias("left"), F.array_append(a["out"], node).alias("out"), node["node_type"].alias("want"))

    start = F.struct(group.alias("left"), F.slice(group, 1, 0).alias("out"), first.alias("want"))
    chain = F.aggregate(group, start, step, lambda a: a["out"])
    return F.when(F.size(group) > 1, chain).otherwise(group)


def _ranked(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Nodes with ``__rank``: their order among those of the same extent."""
    if "seq" in nodes.columns:
        return nodes.withColumn("__rank", F.col("seq").cast("long"))
    rest = [c for c in nodes.columns if c not in (*key, "start", "end")]
    together = nodes.groupBy(*key, "start", "end").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("__g"))  # a chain of one-child nodes: no longer than the tree is deep
    out = together.select(*key, "start", "end", F.posexplode(_linked(F.col("__g"))).alias("__rank", "__n"))
    return out.select(*key, "start", "end", F.col("__rank").cast("long").alias("__rank"), "__n.*")


def node_depth(nodes: DataFrame, key: list[str], rules: DataFrame | None = None, step: str | None = None) -> DataFrame:
    """Nodes with ``depth``, the number of nodes around each that deepen (all of them without ``rules``)."""
    x = nodes
    if rules is not None:
        x = with_rules(x, rules).drop("__control", "__operator", "__operand")
    elif step is None:
        x = x.withColumn("__step", F.lit(1))
    step = step or "__step"
    x = _ranked(x.filter(F.col("start").isNotNull() & F.col("end").isNotNull()), key)
    cols = [c for c in x.columns if c not in (*key, "__rank")]
    empty = F.col("start") >= F.col("end")
    opens = F.struct(F.col("start").alias("pos"), F.when(empty, 1).otherwise(2).alias("kind"), (-F.col("end")).alias("far"), F.col("__rank").alias("rank"),
                     F.when(empty, 0).otherwise(F.col(step)).alias("by"), F.struct(*cols).alias("node"))
    closes = F.struct(F.col("end").alias("pos"), F.lit(0).alias("kind"), F.col("start").alias("far"), F.lit(0).cast("long").alias("rank"),
                      (-F.col(step)).alias("by"), F.lit(None).cast(x.select(F.struct(*cols)).schema[0].dataType).alias("node"))
    # a node that deepens nothing has no end event
    events = x.select(*key, F.explode(F.when(empty | (F.col(step) == 0), F.array(opens)).otherwise(F.array(opens, closes))).alias("e")).select(*key, "e.*")
    swept = segmented_running(events, key, ["pos", "kind", "far", "rank"], "by", F.floor(F.col("pos") / SEGMENT), out="depth", inclusive=False)
    return swept.filter(F.col("kind") > 0).select(*key, "node.*", "depth").drop("__step")


def _costs(x: DataFrame, key: list[str]) -> DataFrame:
    """``(key..., cost)``: weight * (1 + depth), summed over the control nodes that have an extent."""
    x = x.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    if "seq" in x.columns:  # what neither counts nor deepens has no part in the sweep; without seq it may link others
        x = x.filter(F.col("__control").isNotNull() | (F.col("__step") != 0)).select(*key, "start", "end", "seq", "__step", "__control")
    else:
        x = x.select(*key, "start", "end", "node_type", "parent_type", "__step", "__control")
    deep = node_depth(x, key, step="__step").filter(F.col("__control").isNotNull())
    return deep.groupBy(*key).agg(F.sum(F.col("__control") * (1 + F.col("depth"))).alias("cost"))


def analyze_nodes(nodes: DataFrame, rules: DataFrame, key: list[str], lines: DataFrame | None = None) -> DataFrame:
    """M2-M6 and M8 (with ``lines(key..., lines_of_code)`` also M7) from a table of nodes, one row a key.

    The nodes are made once and written without their texts. Counts come from groups of
    equal operators and operands, formed where the nodes are, costs from the sweep.
    """
    operand = F.coalesce("text", "node_type")
    operand = F.when(F.length(operand) > SHORT, F.concat(F.lit("sha2:"), F.sha2(operand, 256))).otherwise(operand)
    x = with_rules(nodes, rules)
    x = _written(x.select(*key, "start", "end", "node_type", "parent_type", *(["seq"] if "seq" in nodes.columns else []), "__step", "__control",
                          F.when(F.col("__operator").isNotNull(), F.col("node_type")).alias("__operator"),
                          F.when(F.col("__operand").isNotNull(), operand).alias("__operand")), "nodes")
    some = F.count(F.lit(1)).alias("n")
    alike = x.groupBy(*key, "__operator", "__operand").agg(some, F.count("__control").alias("controls"))
    n, one, none = F.col("n"), F.lit(1).cast("long"), F.lit(0).cast("long")

    def row(kind: str, value: Column, count: Column, controls: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), count.alias("n"), controls.alias("controls"))

    parts = F.array(row("node", F.lit(None).cast("string"), n, F.col("controls")), row("operator", F.col("__operator"), n), row("operand", F.col("__operand"), n))
    parts = alike.select(*key, F.inline(F.filter(parts, lambda p: (p["kind"] == "node") | p["value"].isNotNull())))
    parts = parts.groupBy(*key, "kind", "value").agg(F.sum("n").alias("n"), F.sum("controls").alias("controls"), F.lit(0).cast("long").alias("cost"))
    costs = _costs(x, key).select(*key, F.lit("cost").alias("kind"), F.lit(None).cast("string").alias("value"), none.alias("n"), none.alias("controls"), "cost")

    def total(kind: str, of: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, of)), none)

    out = parts.unionByName(costs).groupBy(*key).agg(
        total("node", n).alias("node_count"),
        total("node", F.col("controls")).cast("int").alias("complexity_score"),
        total("cost", F.col("cost")).cast("long").alias("cognitive_complexity"),
        total("operator", n).alias("operators_total"), total("operator", one).alias("operators_unique"),
        total("operand", n).alias("operands_total"), total("operand", one).alias("operands_unique"))
    volume = halstead_volume(F.col("operators_total") + F.col("operands_total"), F.col("operators_unique") + F.col("operands_unique"))
    out = out.withColumn("halstead_volume", F.round(volume, 2)).withColumn("sqale_debt_hours", sqale_hours(F.col("cognitive_complexity")))
    if lines is None:
        return out
    joined = out.withColumn("__volume", volume).join(lines.select(*key, "lines_of_code"), key, "left")
    index = maintainability_index(F.col("__volume"), F.col("complexity_score"), F.col("lines_of_code"))
    return joined.withColumn("maintainability_index", F.when(F.col("lines_of_code") == 0, 100.0).otherwise(index)).drop("__volume")
