"""One left fold over a file's token array (P3-P5, P7, M2-M5, M9 inputs).

The fold carries only O(nesting) state: bracket depth, the indentation stack
of open blocks, a stack of "inside a comparison chain" flags by bracket
level, and running counters. It is a single Spark ``aggregate`` expression,
evaluated in the JVM per row, so the structure pass never leaves the scan
stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel import rules as R
from lintel.functions import tokens as TK
from lintel.functions.tokens import _sql_list

CONTROL_HEADS = R.control_heads()
ENCAP_HEADS = [k for k, n in R.HEAD_NODE if n in R.ENCAPSULATION_NODES]

#: Counters that only line starts change, and those that only operators change: copied whole by all other steps.
_HEADS, _OPERATORS = ("cog", "ctl", "nst"), ("nasg", "naug", "nbin", "nun", "ncmp", "nbool", "nnot")


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


_ZERO = _struct({
    "d": "0", "ind": "0", "ls": "true", "stk": "cast(array() as array<struct<i:int,n:boolean>>)",
    "pe": "false", "pc": "-1", "ff": "false", "cs": "array(false)",
    "m": _struct(dict.fromkeys(_HEADS, "0")), "n": _struct(dict.fromkeys(_OPERATORS, "0"))})
_KEPT = {f: f"a.{f}" for f in ("d", "ind", "ls", "stk", "pe", "pc", "ff", "cs", "m", "n")}


def _step() -> str:
    """The next state; the commonest tokens (line ends, operands within a line) first, as they change little."""
    x = "x"
    k, c, t, nt, h = f"{x}.k", f"{x}.c", f"{x}.t", f"{x}.nt", f"{x}.h"
    is_async = f"({c} = {TK.C_KWB} AND {t} = 'async')"
    popped = "filter(a.stk, e -> e.i < a.ind)"
    # previous significant token: its operator category (only 'is'/'not' matter)
    prev_is = f"(a.pc = {TK.C_IS})"
    prev_not = f"(a.pc = {TK.C_NOT})"
    ntx = f"coalesce({nt}, '')"
    not_in_head = f"({c} = {TK.C_NOT} AND NOT {prev_is} AND {ntx} = 'in')"
    not_op = f"({c} = {TK.C_NOT} AND NOT {prev_is} AND {ntx} != 'in')"
    in_cmp = f"({c} = {TK.C_IN} AND NOT {prev_not} AND NOT a.ff)"
    in_for = f"({c} = {TK.C_IN} AND NOT {prev_not} AND a.ff)"
    cmp_head = f"({c} = {TK.C_CMP} OR {c} = {TK.C_IS} OR {not_in_head} OR {in_cmp})"
    boundary = (
        f"({c} IN ({TK.C_ASSIGN}, {TK.C_AUG}, {TK.C_BOOL}, {TK.C_PUNCT}, {TK.C_KWB}, {TK.C_FOR}) "
        f"OR {not_op} OR {in_for})"
    )
    in_chain = "element_at(a.cs, -1)"  # whether the innermost bracket is inside a comparison chain
    below = "slice(a.cs, 1, size(a.cs) - 1)"
    operand = f"{k} IN ({', '.join(map(str, TK.OPERAND_KINDS))})"
    b = lambda cond: f"CASE WHEN {cond} THEN 1 ELSE 0 END"
    line_end = _struct(_KEPT | {
        "ind": f"length({t}) - 1", "ls": "true", "pe": "false", "pc": c,
        "cs": f"CASE WHEN {in_chain} THEN array_append({below}, false) ELSE a.cs END"})
    # a name, literal or dot within a line
    plain = {"ls": "false", "pe": operand, "pc": c}
    operators = {
        "nasg": f"a.n.nasg + {b(f'{c} = {TK.C_ASSIGN} AND a.d = 0')}",
        "naug": f"a.n.naug + {b(f'{c} = {TK.C_AUG}')}",
        "nbin": f"a.n.nbin + {b(f'({c} = {TK.C_PLUSMINUS} OR {c} = {TK.C_BINONLY}) AND a.pe')}",
        "nun": f"a.n.nun + {b(f'({c} = {TK.C_PLUSMINUS} AND NOT a.pe) OR {c} = {TK.C_TILDE}')}",
        "ncmp": f"a.n.ncmp + {b(f'{cmp_head} AND NOT {in_chain}')}",
        "nbool": f"a.n.nbool + {b(f'{c} = {TK.C_BOOL}')}",
        "nnot": f"a.n.nnot + {b(not_op)}",
    }
    uncounted = f"{c} IN ({TK.C_OPEN}, {TK.C_CLOSE}, {TK.C_PUNCT}, {TK.C_KWB}, {TK.C_FOR})"
    operator = {
        "d": f"CASE WHEN {c} = {TK.C_OPEN} THEN a.d + 1 WHEN {c} = {TK.C_CLOSE} THEN greatest(a.d - 1, 0) ELSE a.d END",
        "ls": "false", "pe": f"{c} = {TK.C_CLOSE}", "pc": c,
        "ff": f"CASE WHEN {c} = {TK.C_FOR} THEN true WHEN {c} = {TK.C_IN} THEN false ELSE a.ff END",
        "cs": (
            f"CASE WHEN {c} = {TK.C_OPEN} THEN array_append(a.cs, false) "
            f"WHEN {c} = {TK.C_CLOSE} AND a.d = 0 THEN array(false) "
            f"WHEN {c} = {TK.C_CLOSE} THEN {below} "
            f"WHEN {cmp_head} THEN CASE WHEN {in_chain} THEN a.cs ELSE array_append({below}, true) END "
            f"WHEN {in_chain} AND {boundary} THEN array_append({below}, false) "
            "ELSE a.cs END"
        ),
        "n": f"CASE WHEN {uncounted} THEN a.n ELSE {_struct(operators)} END",
    }
    # the first token of a statement closes blocks and may open one
    is_ctl = f"coalesce({h} IN ({_sql_list(CONTROL_HEADS)}), false)"
    opens = {
        "stk": (
            f"CASE WHEN {h} IS NOT NULL THEN array_append({popped}, "
            f"named_struct('i', a.ind, 'n', {h} NOT IN ({_sql_list(ENCAP_HEADS)}))) ELSE {popped} END"
        ),
        "m": _struct({
            "cog": f"a.m.cog + CASE WHEN {is_ctl} THEN 1 + size(filter(a.stk, e -> e.i < a.ind AND e.n)) ELSE 0 END",
            "ctl": f"a.m.ctl + {b(is_ctl)}",
            "nst": "a.m.nst + 1",
        }),
    }
    return (
        f"CASE WHEN {k} = {TK.K_NL} THEN CASE WHEN a.d > 0 THEN a ELSE {line_end} END "
        f"WHEN {c} = {TK.C_OTHER} THEN CASE WHEN a.ls THEN {_struct(_KEPT | plain | opens)} ELSE {_struct(_KEPT | plain)} END "
        f"WHEN NOT a.ls THEN {_struct(_KEPT | operator)} "
        f"WHEN {is_async} THEN {_struct(_KEPT | operator | {'ls': 'true'})} "
        f"ELSE {_struct(_KEPT | operator | opens)} END"
    )


def fold_sql(tokens_col: str = "tokens") -> str:
    """SQL for the fold's final counters over ``tokens_col``."""
    counters = {**{f: f"a.m.{f}" for f in _HEADS}, **{f: f"a.n.{f}" for f in _OPERATORS}}
    return f"aggregate(`{tokens_col}`, {_ZERO}, (a, x) -> {_step()}, a -> {_struct(counters)})"


def docstring(first: Column) -> Column:
    """The string literal that is a file's whole first statement (else null), from its first token that ends no line."""
    alone = first["nt"].isNull() | first["nt"].startswith("\n") | (first["nt"] == ";")
    return F.when((first["k"] == TK.K_STR) & alone, first["t"])
