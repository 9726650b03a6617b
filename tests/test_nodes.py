"""P6, P8, M2-M8 and R1 over node tables: the sweep against trees, markup against rules, sources against hand counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintel import rules as R
from lintel.operators import markup as MK
from lintel.operators import nodes as N
from lintel.operators.metrics import analyze, line_counts
from lintel.rules import default_rules
from lintel.sources import corpus as C
from lintel.sources import syntax as SX

NODES = "file_path string, start long, end long, node_type string, parent_type string, text string"


def tree(r, depth=0, start=0, parent=None, around=()):
    """A random tree: (start, end, type, parent type, types around). One-child chains share their extent; no type repeats in a chain."""
    kind = r.choice([k for k in "abcdefgh" if k not in around[-4:]])
    at, rows = start, []
    for _ in range(r.choice([0, 1, 1, 2, 3]) if depth < 7 else 0):
        at += r.choice([0, 0, 1])
        rows += (below := tree(r, depth + 1, at, kind, (*around, kind)))
        at = below[0][1]
    end = at + (r.choice([0, 0, 2]) if rows else r.choice([1, 3]))
    return [(start, end, kind, parent, around), *rows]


@pytest.mark.parametrize("segment", [4, 1 << 16])
@pytest.mark.parametrize("with_seq", [True, False])
def test_sweep_gives_the_depths_of_random_trees(spark, monkeypatch, segment, with_seq):
    monkeypatch.setattr(N, "SEGMENT", segment)
    rows, want = [], Counter()
    for k in range(60):
        for i, (a, b, kind, parent, around) in enumerate(tree(random.Random(k))):
            rows.append((f"f{k}" if k else None, a, b, kind, parent, None, i))
            want[f"f{k}" if k else None, a, b, kind, len(around)] += 1
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, NODES + ", seq int").withColumn("depth_", F.lit(1))
    got = N.node_depth(df if with_seq else df.drop("seq"), ["file_path"]).collect()
    assert Counter((r.file_path, r.start, r.end, r.node_type, r.depth) for r in got) == want


def test_empty_nodes_lie_in_what_is_around_them(spark):
    rows = [("f", 0, 9, "module", None, None), ("f", 0, 4, "a", "module", None), ("f", 4, 4, "gap", "module", None), ("f", 4, 9, "b", "module", None), ("f", 6, 6, "gap", "b", None),
            ("g", 0, 0, "module", None, None), (None, None, None, "x", None, None)]
    got = {(r.file_path, r.start, r.end, r.node_type): r.depth for r in N.node_depth(spark.createDataFrame(rows, NODES), ["file_path"]).collect()}
    assert got == {("f", 0, 9, "module"): 0, ("f", 0, 4, "a"): 1, ("f", 4, 4, "gap"): 1, ("f", 4, 9, "b"): 1, ("f", 6, 6, "gap"): 2, ("g", 0, 0, "module"): 0}


def test_rules_weigh_nest_and_shield(spark):
    rows = [("f", 0, 100, "module", None, None), ("f", 0, 90, "def", "module", None), ("f", 5, 90, "block", "def", None), ("f", 10, 80, "if", "block", None),
            ("f", 20, 80, "block", "if", None), ("f", 30, 40, "if", "block", None), ("f", 41, 42, "name", "block", "x"), ("f", 43, 44, "name", "block", "x"),
            ("f", 45, 46, "name", "block", None), ("f", 50, 60, "plus", "block", None), ("f", None, 3, "if", "block", None), (None, 0, 1, None, None, None)]
    nodes = spark.createDataFrame(rows, NODES)
    base = [("if", "control", 1), ("block", "nesting", 1), ("name", "operand", 1), ("plus", "operator", 1)]

    def run(rules):
        out = N.analyze_nodes(nodes, spark.createDataFrame(rules, R.RULE_SCHEMA), ["file_path"]).collect()
        return {r.file_path: (r.node_count, r.complexity_score, r.cognitive_complexity, r.operators_total, r.operators_unique, r.operands_total, r.operands_unique) for r in out}

    assert run(base) == {"f": (11, 3, 2 + 3, 1, 1, 3, 2), None: (1, 0, 0, 0, 0, 0, 0)}
    assert run([*base, ("def", "encapsulation", 1)])["f"][2] == 1 + 2
    assert run([*base, ("def", "encapsulation", 1), ("if", "control", 4)])["f"][1:3] == (3, 5 + 10)
    assert N.analyze_nodes(nodes.limit(0), default_rules(spark), ["file_path"]).collect() == []


def of(html):
    return [(kind, parent, text) for _, _, kind, parent, text in MK.page_nodes(html)]


@pytest.mark.parametrize("html, want", [
    ("", []), ("   ", []), ("plain", [("#text", None, "plain")]),
    ("<ul><li>a<li>b</ul>", [("ul", None, None), ("li", "ul", None), ("#text", "li", "a"), ("li", "ul", None), ("#text", "li", "b")]),
    ("<p>a<b>c<p>d", [("p", None, None), ("#text", "p", "a"), ("b", "p", None), ("#text", "b", "c"), ("p", None, None), ("#text", "p", "d")]),
    ("</x></p>t</div>", [("#text", None, "t")]),
    ("<div><table><tr><td></div>x<td>y</table>z", [("div", None, None), ("table", "div", None), ("tr", "table", None), ("td", "tr", None), ("#text", "td", "x"), ("td", "tr", None), ("#text", "td", "y"), ("#text", "div", "z")]),
    ("<BR>a<img src='x>y'/><custom-tag/>b", [("br", None, None), ("#text", None, "a"), ("img", None, None), ("custom-tag", None, None), ("#text", None, "b")]),
    ("<script>if (a<b) '</p>'</SCRIPT >t<!-- <p> -->u<style>x", [("script", None, None), ("#text", "script", "if (a<b) '</p>'"), ("#text", None, "t"), ("#text", None, "u"), ("style", None, None), ("#text", "style", "x")]),
    ("a < b <a title=\"x>y\">k</a <!-- open", [("#text", None, "a < b"), ("a", None, None), ("#text", "a", "k</a")]),
    ("<select><optgroup><option>1<option>2<optgroup><option>3", [("select", None, None), ("optgroup", "select", None), ("option", "optgroup", None), ("#text", "option", "1"), ("option", "optgroup", None), ("#text", "option", "2"), ("optgroup", "select", None), ("option", "optgroup", None), ("#text", "option", "3")]),
])
def test_implied_ends_strays_and_raw_text(html, want):
    assert of(html) == want


def test_extents_nest_whatever_the_markup():
    r = random.Random(3)
    bits = ["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<br>", "x", " ", "<script>", "</script>", "<!--", "-->", "<", ">", "\"", "<a href='", "</"]
    for _ in range(2000):
        html = "".join(r.choices(bits, k=r.choice([1, 5, 30])))
        nodes, open_ = MK.page_nodes(html), []
        for a, b, kind, parent, _ in nodes:
            assert 0 <= a < b <= len(html)
            while open_ and open_[-1][1] <= a:
                open_.pop()
            assert not open_ or b <= open_[-1][1]
            assert parent == (open_[-1][2] if open_ else None)
            open_.append((a, b, kind))


def test_depths_of_pages_agree_with_their_trees_and_edges_hold(spark):
    pages = [(1, "<div>" * 3000 + "x"), (1, "<p>a"), (2, None), (None, "<b>c</b>"), (3, "")]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("seq", F.lit(0)).withColumn("depth", F.lit("x"))
    rows = {r.page_id: tuple(r)[1:] for r in MK.nesting_stats(df.filter("page_id IS NULL OR page_id > 1 OR html LIKE '<div%'")).collect()}
    assert rows == {1: (3000, 2999, 2999 * 3000 // 2), 2: (0, 0, 0), 3: (0, 0, 0), None: (1, 0, 0)}
    assert MK.nesting_stats(df.limit(0)).collect() == []


def counts(source):
    n = Counter(x[2] for x in SX.source_nodes(source))
    return {k: n[k] for k in (*R.CONTROL_FLOW_NODES, *R.OPERATOR_NODES) if n[k]}, sorted(x[4] for x in SX.source_nodes(source) if x[2] in R.OPERAND_NODES)


@pytest.mark.parametrize("block", C.BLOCKS, ids=lambda b: b[0][:12])
def test_sources_against_hand_counts(block):
    text, _, control, _, _, operators, operands = block
    found, names = counts(text)
    assert {k: v for k, v in found.items() if k in R.OPERATOR_NODES} == operators and sum(v for k, v in found.items() if k in R.CONTROL_FLOW_NODES) == control
    assert names == sorted(operands)


def test_sources_with_clauses_strings_and_soft_keywords():
    found, names = counts('f"{a} {b.c:>{w}} {{x}} {d!r}"\n')
    assert found == {} and names == sorted(['f"{a} {b.c:>{w}} {{x}} {d!r}"', "a", "b", "c", "w", "d"])
    found, names = counts("match = case = 1\nmatch match:\n    case 1: pass\n")
    assert found == {"match_statement": 1, "assignment": 2} and names == sorted(["match", "case", "1", "match", "1"])
    found, _ = counts("for x in y:\n    pass\nelse:\n    while not (a and b or c):\n        z: int = 1.5e3\ntry:\n    pass\nexcept* E:\n    x += 0x1e\nfinally:\n    pass\n")
    assert found == {"for_statement": 1, "else_clause": 1, "while_statement": 1, "not_operator": 1, "boolean_operator": 2, "assignment": 1, "try_statement": 1, "except_clause": 1, "augmented_assignment": 1}
    assert [x[2] for x in SX.source_nodes("def f(:\n")] == ["ERROR"] and [x[2] for x in SX.source_nodes(None)] == ["module"]


def test_exact_and_text_front_end_agree(spark):
    files = C.code_corpus(spark, "/root/testdata/sf0.001")
    key = ["repo", "file_path"]
    exact = N.analyze_nodes(SX.python_nodes(files, key), default_rules(spark), key, lines=line_counts(files, key))
    text = analyze(files, keep=key)
    same = ["complexity_score", "cognitive_complexity", "halstead_volume", "sqale_debt_hours", "lines_of_code", "maintainability_index"]
    assert sorted(map(tuple, exact.select(*key, *same).collect())) == sorted(map(tuple, text.select(*key, *same).collect()))


def test_nodes_are_made_once_and_not_dealt_out_by_type(spark):
    files = C.code_corpus(spark, "/root/testdata/sf0.001")
    found = SX.python_nodes(files, ["repo", "file_path"])
    weighed = N.with_rules(found, default_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in weighed and weighed.count("BroadcastHashJoin") == 2
    plan = N.analyze_nodes(found, default_rules(spark), ["repo", "file_path"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Expand" not in plan and "collect_list" not in plan


def test_long_operands_are_told_apart(spark):
    rows = [("f", i, i + 1, "name", None, t) for i, t in enumerate(["x" * 70, "x" * 70, "x" * 70 + "y", "x" * 64, "x", ""])]
    out = N.analyze_nodes(spark.createDataFrame(rows, NODES), spark.createDataFrame([("name", "operand", 1)], R.RULE_SCHEMA), ["file_path"]).collect()
    assert [(r.operands_total, r.operands_unique) for r in out] == [(6, 5)]


def test_order_of_source_nodes_nests_equal_extents(spark):
    files = spark.createDataFrame([("a", "match x:\n    case 1:\n        if y: z\nif a: b\nfor q in r: s\n")], "file_path string, content string")
    nodes = SX.python_nodes(files, ["file_path"])
    kinds = ["file_path", "start", "end", "node_type", "depth"]
    with_seq, without = (N.node_depth(x, ["file_path"]).select(*kinds) for x in (nodes, nodes.drop("seq")))
    assert sorted(map(tuple, with_seq.collect())) == sorted(map(tuple, without.collect()))
