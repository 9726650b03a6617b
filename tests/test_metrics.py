"""Calibration values on own samples, and plans."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lintel import rules as R
from lintel.functions.tokens import FSTRING_LEVELS
from lintel.operators.metrics import analyze, structure
from lintel.sources.syntax import source_nodes

GOLDEN = '''"""Own sample."""


def total(rows):
    """Adds up what is valid."""
    out = 0
    for row in rows:
        if row.ok:
            while row.more():
                out += 1
    if out:
        with lock:
            out -= 1
    try:
        send(out)
    except OSError:
        if again:
            send(out)
    else:
        done()
    return out


def half(n):
    return n / 2
'''
# by hand: for 1, if 2, while 3, if 1, with 2, try 1, except 1, if 2, else 1

FLAT = '''
class Box:
    def area(self, w, h):
        return w * h

def twice(n):
    return n + n
'''

TWO_BRANCHES = '''
def pick(flag):
    if flag:
        out = "yes"
    else:
        out = "no"
    return out
'''

LOOP_IN_IF = '''
def drain(queue):
    if queue:
        for item in queue:
            item.close()
'''


def run(spark, rows):
    df = spark.createDataFrame(rows, "file_path string, content string")
    return {r.file_path: r for r in analyze(df, with_halstead_counts=True).collect()}


def test_golden_calibration(spark):
    r = run(spark, [("g", GOLDEN)])["g"]
    assert r.cognitive_complexity == 14
    assert r.sqale_debt_hours == Decimal("2.10")
    assert r.description == "Own sample."


def test_audit_snippets(spark):
    out = run(spark, [("simple", FLAT), ("ifelse", TWO_BRANCHES), ("nested", LOOP_IN_IF)])
    assert out["simple"].cognitive_complexity == 0
    assert out["ifelse"].cognitive_complexity == 2
    assert out["nested"].cognitive_complexity == 3


def test_parser_cases(spark):
    out = run(spark, [
        ("empty", ""),
        ("one_if", "def check(x):\n    if x > 0:\n        return True\n    return False"),
        ("if_for", "def process(items):\n    if items:\n        for item in items:\n            print(item)"),
        ("if_for_while", "if a:\n    for b in c:\n        while d:\n            pass\n"),
    ])
    assert out["empty"].complexity_score == 0
    assert out["empty"].node_count == 0 and out["empty"].maintainability_index == 100.0
    assert out["empty"].lines_of_code == 0 and out["empty"].description is None
    assert out["one_if"].complexity_score == 1
    assert out["if_for"].complexity_score == 2
    assert out["if_for_while"].complexity_score == 3
    assert out["if_for_while"].cognitive_complexity == 6


def test_operator_classes(spark):
    src = ("x = -a + b * c\ny += 1\nif a < b < c and not d:\n    z = f(k=1, *args)\n"
           "for i in r:\n    q = i in s\nw = a is not b\nv = a not in b\n")
    r = run(spark, [("ops", src)])["ops"]
    # 5 assignments, 1 unary, 2 binary, 1 augmented, 4 comparisons, 1 boolean, 1 not
    assert r.operators_total == 15
    assert r.operators_unique == 7


def test_strings_and_comments_hide_structure(spark):
    src = 's = "if x:"\n# for y in z:\nt = """\nwhile True:\n    pass\n"""\n'
    r = run(spark, [("s", src)])["s"]
    assert r.complexity_score == 0
    assert r.lines_of_code == 5


@pytest.mark.parametrize("extra", ["\n\n", "# a comment\n", "   \n# x\n\n"])
def test_blank_and_comment_lines_change_nothing(spark, extra):
    base = "if a:\n    for b in c:\n        x = 1\n"
    out = run(spark, [("a", base), ("b", extra + base + extra)])
    for f in ("complexity_score", "cognitive_complexity", "lines_of_code", "halstead_volume"):
        assert out["a"][f] == out["b"][f]


def test_wrapping(spark):
    body = "if a:\n    for b in c:\n        x = 1\nwhile d:\n    pass\n"
    in_def = "def f():\n" + "".join("    " + ln + "\n" for ln in body.splitlines())
    in_if = "if q:\n" + "".join("    " + ln + "\n" for ln in body.splitlines())
    out = run(spark, [("base", body), ("def", in_def), ("if", in_if)])
    assert out["def"].cognitive_complexity == out["base"].cognitive_complexity
    # wrapping in ``if`` adds 1 plus one per control node
    assert out["if"].cognitive_complexity == out["base"].cognitive_complexity + 1 + out["base"].complexity_score


def test_soft_keywords(spark):
    src = "match cmd:\n    case 1:\n        if x:\n            pass\nm = re.match(p, s)\n"
    r = run(spark, [("m", src)])["m"]
    assert r.complexity_score == 2          # match + if
    assert r.cognitive_complexity == 1 + 3  # match at 0, if inside case body at depth 2


def test_metric_plan_is_map_only_and_jvm_side(spark):
    df = spark.createDataFrame([("a", "if x:\n    pass\n")], "file_path string, content string")
    plan = analyze(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert plan.count("regexp_extract_all(content") == 1


@pytest.mark.parametrize("quote", ['"', "'", 'f"', "f'"])
def test_a_literal_of_many_escapes_gives_a_row(spark, quote):
    r = run(spark, [("big", f"x = {quote}" + "\\n" * 100_000 + f"{quote[-1]}\nif x:\n    y = 1\n")])["big"]
    assert r.complexity_score == 1 and r.operands_total == 5


def test_deep_brackets_keep_their_own_chains(spark):
    deep = 80
    src = "x = " + "(" * deep + "a < b < c" + ")" * deep + " < d\n"
    assert run(spark, [("deep", src)])["deep"].operators_total == 3  # one assignment, two comparisons


def test_a_filter_above_the_metrics_copies_no_fold(spark):
    from lintel.operators.rollup import triage
    df = spark.createDataFrame([("a", "if x:\n    pass\n")], "file_path string, content string")
    plan = triage(analyze(df))._jdf.queryExecution().optimizedPlan().toString()
    # the file and what stands in its f-strings are folded once each, and each level of f-strings is cut once
    assert plan.count("regexp_extract_all(content") == 1 and plan.count("aggregate(") == 2 + FSTRING_LEVELS


FSTRINGS = [
    ('f"{a} {b.c:>{w}}"\n', ["a", "b", "c", "w"]),
    ('f\'{d["k"]} it\\\'s {{q}} {e!r:{f}.{g}} {h != i}\'\n', ["d", '"k"', "e", "f", "g", "h", "i"]),
    ('f"{x["a"]}" + f"{f\'{y}\'}"\n', ["x", '"a"', "f'{y}'", "y", 'f"{f\'{y}\'}"']),
    ('rf"""{z\n + 1}""" + F\'\'\'{ {1: 2}[1] }\'\'\'\n', ["z", "1", "1", "2", "1", "F\'\'\'{ {1: 2}[1] }\'\'\'"]),
    ('f"" + f"{q=}" + "{n}" + f"{(lambda u: u)(3)} {[k for k in v if not k]}"\n',
     ['f"{q=}"', "q", '"{n}"', "u", "u", "3", "k", "k", "v", "k", 'f"{(lambda u: u)(3)} {[k for k in v if not k]}"']),
    ('print(f"{n:,} of {total:.2f}", f"")\n', ["print", "n", "total", 'f""']),
]


@pytest.mark.parametrize("source, inner", FSTRINGS, ids=range(len(FSTRINGS)))
def test_operands_and_operators_inside_fstrings(spark, source, inner):
    r = structure(spark.createDataFrame([(source,)], "content string")).first()
    names = [x[4] for x in source_nodes(source) if x[2] in R.OPERAND_NODES]
    assert sorted(r["__opd"]) == sorted(names) and set(inner) <= set(names)
    kinds = [x[2] for x in source_nodes(source)]
    of = {"nasg": "assignment", "naug": "augmented_assignment", "nbin": "binary_operator", "nun": "unary_operator", "ncmp": "comparison_operator",
          "nbool": "boolean_operator", "nnot": "not_operator"}
    assert {f: r["__s"][f] + r["__f"][f] for f in of} == {f: kinds.count(k) for f, k in of.items()}


def test_a_long_docstring_ends_at_its_quotes_and_no_lazy_loop_reads_it(spark):
    from lintel.functions import tokens as TK

    assert "*?" not in TK.TOKEN_RE
    body = 'a "quoted" and ""doubled"" word\n' * 20_000
    rows = [(0, f'"""{body}"""\nx = 1\n'), (1, f"'''{body}'''; y = 2\n"), (2, f'"""{body}""" + z\n'), (3, '"""open'), (4, '"""a""""')]
    out = {r.i: r for r in analyze(spark.createDataFrame(rows, "i int, content string"), keep=["i"]).collect()}
    assert out[0].description == out[1].description == body.strip()
    assert out[2].description is None and out[3].description is None and out[4].description == "a"  # a quote that opens nothing is no token
