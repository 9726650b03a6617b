"""Token-level column expressions for the text front end.

A file is one row. Its text is cut into tokens with one Java-side regex
(``regexp_extract_all``) and every later step is a higher-order function over
that array, so the whole front end runs map-side inside the scan stage: no
exchange, no Python worker. The loops inside string literals are possessive: they
neither recurse nor backtrack, whatever the literal's length.

An f-string is one string token; what stands in its braces is cut out by a pushdown
over its characters (``fields_sql``) and read by the same tokens and fold again.

Known limits of the text front end (documented, tested where cheap):
f-strings inside f-strings are followed ``FSTRING_LEVELS`` deep; ``lambda x=1``
at statement level counts an assignment; a bare annotation ``x: int`` counts
none; tabs count as one column of indentation; ``except*`` counts as except.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel import rules as R

# Whitespace as Python's ``str.strip`` sees it, restricted to ASCII.
WS = r"[ \t\n\r\f\x0B]"

# A replacement field of an f-string, with strings and one more level of braces inside.
_FIELD = r"""(?:[^{}"'\n]|"[^"\n]*+"|'[^'\n]*+')*+"""
FIELD_RE = r"""\{(?:[^{}"'\n]|"[^"\n]*+"|'[^'\n]*+'|\{""" + _FIELD + r"""\})*+\}"""
_F = r"(?:[rR][fF]|[fF][rR]?)"
STRING_RE = (
    # f-strings whose fields hold their own quotes, then all strings
    _F + r'"(?!"")(?:[^"\\{\n]|\\[\s\S]|\{\{|' + FIELD_RE + r'|\{)*+"'
    r"|" + _F + r"'(?!'')(?:[^'\\{\n]|\\[\s\S]|\{\{|" + FIELD_RE + r"|\{)*+'"
    r"|(?:[rRbBuUfF]{1,2})?(?:"
    # up to the next three quotes: a lazy loop would try the end at every character
    r'"""(?:[^"]++|"(?!""))*+"""'
    r"|'''(?:[^']++|'(?!''))*+'''"
    r'|"(?:[^"\\\n]|\\[\s\S])*+"'
    r"|'(?:[^'\\\n]|\\[\s\S])*+'"
    r")"
)
COMMENT_RE = r"#[^\n]*"
CONTINUATION_RE = r"\\\r?\n"
NEWLINE_RE = r"\n[ \t]*"
NUMBER_RE = (
    r"0[xXoObB][0-9a-fA-F_]+"
    r"|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[jJ]?"
)
NAME_RE = r"[\p{L}_][\p{L}\p{N}_]*"
OP_RE = (
    r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[-+*/%@&|^]=|==|!=|<=|>=|<>|\*\*|//|<<|>>"
    r"|[-+*/%@&|^~<>=(){}\[\],:;.]"
)
TOKEN_RE = "|".join([STRING_RE, COMMENT_RE, CONTINUATION_RE, NEWLINE_RE, NUMBER_RE, NAME_RE, OP_RE])

# Token kinds.
K_SKIP, K_NL, K_STR, K_NUM, K_NAME, K_CONST, K_KW, K_OP = range(8)
OPERAND_KINDS = (K_STR, K_NUM, K_NAME, K_CONST)
OP_CHARS = "*/%@&|^~<>=(){}[],:;.-+!"

# f-strings inside f-strings are followed to this depth.
FSTRING_LEVELS = 3
_BODY_RE = r"""^[a-zA-Z]*("{3}|'{3}|"|')([\s\S]*)\1$"""
FSTRING_START_RE = r"""^(?:[rR][fF]|[fF][rR]?)["']"""
# The parts of an f-string that the pushdown tells apart.
_PART_RE = r"""[{}()\[\]:!"']|[^{}()\[\]:!"']+"""
# Modes: text of the f-string, expression, format specification, string inside an expression, conversion.
M_TEXT, M_EXPR, M_SPEC, M_STR, M_CONV = range(5)


def sql_str(v: str) -> str:
    """A Spark SQL string literal for ``v`` (backslash escapes are on)."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_list(values) -> str:
    return ", ".join(sql_str(v) for v in values)


def _kind_sql(t: str) -> str:
    c = f"substring({t}, 1, 1)"
    return (
        "CASE "
        f"WHEN {c} = '#' OR {c} = '\\\\' THEN {K_SKIP} "
        f"WHEN {c} = '\\n' THEN {K_NL} "
        f"WHEN instr({t}, '\"') > 0 OR instr({t}, '\\'') > 0 THEN {K_STR} "
        f"WHEN {c} BETWEEN '0' AND '9' OR ({c} = '.' AND length({t}) > 1 AND {t} != '...') THEN {K_NUM} "
        f"WHEN {t} IN ({_sql_list(R.PY_CONSTANTS)}) THEN {K_CONST} "
        f"WHEN {t} IN ({_sql_list(R.PY_KEYWORDS)}) THEN {K_KW} "
        f"WHEN instr('{OP_CHARS}', {c}) > 0 THEN {K_OP} "
        f"ELSE {K_NAME} END"
    )


def kept_tokens_sql(content_sql: str) -> str:
    """SQL for ``array<struct<t string, k int>>``: typed tokens, comments and
    line continuations removed."""
    pattern = TOKEN_RE.replace("\\", "\\\\").replace("'", "\\'")
    raw = f"regexp_extract_all({content_sql}, '{pattern}', 0)"
    typed = f"transform({raw}, x -> named_struct('t', x, 'k', {_kind_sql('x')}))"
    return f"filter({typed}, x -> x.k != {K_SKIP})"


# Token categories used by the structure pass (precomputed once per token).
C_OTHER, C_OPEN, C_CLOSE, C_ASSIGN, C_AUG, C_CMP, C_BOOL, C_NOT, C_IN, C_IS, C_PLUSMINUS, C_TILDE, \
    C_BINONLY, C_PUNCT, C_KWB, C_FOR = range(16)


def _category_sql(x: str) -> str:
    t, k = f"{x}.t", f"{x}.k"
    binonly = [o for o in R.BINARY_OPS if o not in ("+", "-")]
    return (
        "CASE "
        f"WHEN {k} < {K_KW} THEN {C_OTHER} "
        f"WHEN {t} IN ('(', '[', '{{') THEN {C_OPEN} "
        f"WHEN {t} IN (')', ']', '}}') THEN {C_CLOSE} "
        f"WHEN {t} = '=' THEN {C_ASSIGN} "
        f"WHEN {t} IN ({_sql_list(R.AUGMENTED_OPS)}) THEN {C_AUG} "
        f"WHEN {t} IN ({_sql_list(R.COMPARISON_OPS)}) THEN {C_CMP} "
        f"WHEN {t} IN ('and', 'or') THEN {C_BOOL} "
        f"WHEN {t} = 'not' THEN {C_NOT} "
        f"WHEN {t} = 'in' THEN {C_IN} "
        f"WHEN {t} = 'is' THEN {C_IS} "
        f"WHEN {t} IN ('+', '-') THEN {C_PLUSMINUS} "
        f"WHEN {t} = '~' THEN {C_TILDE} "
        f"WHEN {t} IN ({_sql_list(binonly)}) THEN {C_BINONLY} "
        f"WHEN {t} IN (',', ':', ';', ':=', '->') THEN {C_PUNCT} "
        f"WHEN {t} = 'for' THEN {C_FOR} "
        f"WHEN {k} = {K_KW} THEN {C_KWB} "
        f"ELSE {C_OTHER} END"
    )


def fields_sql(t: str) -> str:
    """SQL for ``array<string>``: the expressions in the braces of the f-string token ``t``.

    One fold over the token's parts with a stack of modes: ``{{`` is text,
    a field ends its expression at ``:`` or ``!`` outside brackets (``!=`` is no
    end), format specifications hold fields of their own, strings inside an
    expression hide what is in them.
    """
    body = f"regexp_extract({t}, {sql_str(_BODY_RE)}, 2)"
    parts = f"regexp_extract_all({body}, {sql_str(_PART_RE)}, 0)"
    looked = f"zip_with({parts}, concat(slice({parts}, 2, greatest(size({parts}) - 1, 0)), array('')), (c, n) -> named_struct('c', c, 'n', n))"
    mode = "named_struct('m', {m}, 'd', {d}, 'q', {q})".format
    top, below = "element_at(a.stk, -1)", "slice(a.stk, 1, size(a.stk) - 1)"
    text, expr = f"{top}.m IN ({M_TEXT}, {M_SPEC})", f"{top}.m = {M_EXPR}"
    ends = f"({expr} AND {top}.d = 0 AND (p.c IN ('}}', ':') OR (p.c = '!' AND NOT startswith(p.n, '='))))"
    inner = mode(m=M_EXPR, d=0, q="''")

    def replaced(m: int, d: str = "0") -> str:
        return f"array_append({below}, {mode(m=m, d=d, q=sql_str(''))})"

    stack = (
        "CASE WHEN a.skip THEN a.stk "
        f"WHEN {text} AND p.c = '{{' AND NOT ({top}.m = {M_TEXT} AND p.n = '{{') THEN array_append(a.stk, {inner}) "
        f"WHEN {top}.m IN ({M_SPEC}, {M_CONV}) AND p.c = '}}' THEN {below} "
        f"WHEN {top}.m = {M_CONV} AND p.c = ':' THEN {replaced(M_SPEC)} "
        f"WHEN {ends} THEN CASE p.c WHEN '}}' THEN {below} WHEN ':' THEN {replaced(M_SPEC)} ELSE {replaced(M_CONV)} END "
        f"WHEN {expr} AND p.c IN ('(', '[', '{{') THEN {replaced(M_EXPR, f'{top}.d + 1')} "
        f"WHEN {expr} AND p.c IN (')', ']', '}}') THEN {replaced(M_EXPR, f'{top}.d - 1')} "
        f"WHEN {expr} AND p.c IN ('\"', '\\'') THEN array_append(a.stk, {mode(m=M_STR, d=0, q='p.c')}) "
        f"WHEN {top}.m = {M_STR} AND p.c = {top}.q THEN {below} ELSE a.stk END"
    )
    said = f"(NOT a.skip AND {top}.m IN ({M_EXPR}, {M_STR}) AND NOT {ends})"
    step = (
        f"named_struct('stk', {stack}, "
        f"'skip', NOT a.skip AND {top}.m = {M_TEXT} AND p.c = '{{' AND p.n = '{{', "
        f"'cur', CASE WHEN {said} THEN concat(a.cur, p.c) WHEN {ends} THEN '' ELSE a.cur END, "
        f"'out', CASE WHEN {ends} THEN array_append(a.out, a.cur) ELSE a.out END)"
    )
    zero = f"named_struct('stk', array({mode(m=M_TEXT, d=0, q=sql_str(''))}), 'skip', false, 'cur', '', 'out', cast(array() as array<string>))"
    return f"aggregate({looked}, {zero}, (a, p) -> {step}, a -> a.out)"


def field_text(strings: Column, out: str) -> Column:
    """The expressions of an array of f-string tokens as lines of bracketed text, to be cut into tokens like a file."""
    own = f"flatten(transform(`{out}`, t -> {fields_sql('t')}))"
    return F.expr(f"array_join(transform({own}, e -> concat('(', e, ')\n')), '')")


HARD_HEADS = [k for k, _ in R.HEAD_NODE if k not in ("match", "case")]
SOFT_HEADS = ["match", "case"]
# A soft keyword opens a statement when it starts a line and the next token
# can start a pattern or subject: a name, number, string, bracket or minus.
SOFT_NEXT_RE = r"""^[\p{L}_0-9"'(\[{-]"""


def _head_sql(x: str, begins: str, nt: str) -> str:
    t, k = f"{x}.t", f"{x}.k"
    return (
        "CASE "
        f"WHEN {k} = {K_KW} AND {t} IN ({_sql_list(HARD_HEADS)}) THEN {t} "
        f"WHEN {k} = {K_NAME} AND {t} IN ({_sql_list(SOFT_HEADS)}) AND {begins} "
        f"AND {nt} RLIKE {sql_str(SOFT_NEXT_RE)} THEN {t} "
        "END"
    )


def with_fstring_tokens(df, tokens: str, out: str):
    """Add ``out``: the tokens that stand in the braces of the f-strings among ``tokens``, those of f-strings inside them included."""
    found, text = f"__{out}_str", f"__{out}_text"
    starts = sql_str(FSTRING_START_RE)
    df = df.withColumn(found, F.expr(f"transform(filter(`{tokens}`, x -> x.k = {K_STR} AND x.t RLIKE {starts}), x -> x.t)"))
    texts = []
    for i in range(FSTRING_LEVELS):
        texts.append(f"{text}{i}")
        df = materialize(df, field_text(F.col(found), found), texts[-1])
        df = df.withColumn(found, F.expr(f"filter(regexp_extract_all(`{texts[-1]}`, {sql_str(STRING_RE)}, 0), x -> x RLIKE {starts})"))
    df = df.withColumn(text, F.concat(*texts))
    return with_tokens(df, text, out).drop(found, text, *texts)


def materialize(df, expr, name: str):
    """Add ``expr`` as column ``name``, computed exactly once per row.

    A one-element ``inline`` generator is an optimizer barrier: projections
    and pushed-down filters above it cannot inline ``expr`` into lambdas
    (where it would be re-evaluated per array element). It adds no shuffle
    and no copy of the row.
    """
    return df.select("*", F.inline(F.array(F.struct(expr.alias(name)))))


def with_tokens(df, content: str = "content", out: str = "tokens"):
    """Add ``out`` = ``array<struct<t, k, nt, c, h>>``.

    ``nt`` is the text of the token after a ``not`` or a string (lookahead for
    ``not in`` and docstrings), ``c`` the operator category, ``h`` the statement
    head the token would open if it started a line. The regex runs once per
    row (materialised before the lookahead).
    """
    tmp = f"__{out}_kept"
    df = materialize(df, F.expr(kept_tokens_sql(f"`{content}`")), tmp)
    following = f"try_element_at(`{tmp}`, i + 2).t"
    begins = f"(i = 0 OR try_element_at(`{tmp}`, i).k = {K_NL})"
    full = (
        f"transform(`{tmp}`, (x, i) -> named_struct('t', x.t, 'k', x.k, "
        f"'nt', CASE WHEN x.k = {K_STR} OR (x.k = {K_KW} AND x.t = 'not') THEN {following} END, "
        f"'c', {_category_sql('x')}, 'h', {_head_sql('x', begins, following)}))"
    )
    return materialize(df, F.expr(full), out).drop(tmp)
