"""Per-file metrics (M1-M11) over ``source_files``.

Every metric is a column expression on the file's row, so ``analyze`` is a
narrow (map-only) transformation: at any scale it adds no exchange, and it
keeps whatever partitioning the input has (for example ``repo`` buckets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel import rules as R
from lintel.functions import structure as ST
from lintel.functions import tokens as TK

WS = TK.WS


def strip_ws(col: Column) -> Column:
    """Python-style ``str.strip()`` over ASCII whitespace."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def lines_of_code(content: Column) -> Column:
    """M1: lines that are non-blank after strip and do not start with '#'; min 1."""
    lines = F.split(content, "\n", -1)
    kept = F.filter(lines, lambda ln: ln.rlike(f"^{WS}*[^ \t\n\r\f\x0B#]"))
    return F.greatest(F.size(kept), F.lit(1)).cast("int")


def is_blank(content: Column) -> Column:
    """M10 predicate: NULL or whitespace-only source."""
    return content.isNull() | ~content.rlike(f"[^ \t\n\r\f\x0B]")


def line_counts(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """M1 alone, with M10's 0 for blank files."""
    text = F.col(content)
    return files.select(*keep, F.when(is_blank(text), 0).otherwise(lines_of_code(text)).cast("int").alias("lines_of_code"))


def unquote_docstring(raw: Column) -> Column:
    """M9: strip one pair of quotes (triple first), then whitespace."""
    n = F.length(raw)

    def inner(q: str, w: int) -> Column:
        return raw.startswith(q) & raw.endswith(q) & (n >= 2 * w)

    return (
        F.when(inner('"""', 3), strip_ws(F.expr("substring(__d, 4, length(__d) - 6)")))
        .when(inner("'''", 3), strip_ws(F.expr("substring(__d, 4, length(__d) - 6)")))
        .when(inner('"', 1), strip_ws(F.expr("substring(__d, 2, length(__d) - 2)")))
        .when(inner("'", 1), strip_ws(F.expr("substring(__d, 2, length(__d) - 2)")))
        .otherwise(strip_ws(raw))
    )


def halstead_volume(n_total: Column, vocabulary: Column) -> Column:
    """M6: (N1 + N2) * log2(n1 + n2); 0 when the vocabulary is empty."""
    return F.when(vocabulary == 0, F.lit(0.0)).otherwise(n_total * F.log2(vocabulary))


def maintainability_index(volume: Column, control: Column, loc: Column) -> Column:
    """M7: clamp 0..100 of the normalised index, 2 decimals, unrounded volume."""
    v = F.greatest(volume, F.lit(1.0))
    cc = F.greatest(control, F.lit(1))
    lc = F.greatest(loc, F.lit(1))
    raw = F.lit(171.0) - F.lit(5.2) * F.log(v) - F.lit(0.23) * cc - F.lit(16.2) * F.log(lc)
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * 100.0 / 171.0)), 2)


def sqale_hours(cognitive: Column) -> Column:
    """M8: round(0.15 * cognitive, 2) in exact decimal arithmetic."""
    return F.round(cognitive.cast("decimal(10,0)") * F.lit(R.SQALE_HOURS_PER_POINT).cast("decimal(3,2)"), 2).cast(
        "decimal(12,2)"
    )


def structure(df: DataFrame, content: str = "content", count_keywords: bool = False) -> DataFrame:
    """Add the raw structure columns of the text front end.

    Adds ``__s`` (the fold's control/cognitive/operator counters), ``__f`` (the same
    for what stands in the braces of f-strings), the docstring literal and
    operand arrays. Map-only.
    """
    df = TK.with_tokens(df, content, "__tok")
    df = TK.with_fstring_tokens(df, "__tok", "__ftok")
    df = TK.materialize(df, F.expr(ST.fold_sql("__tok")), "__s")  # filters above must not copy the fold
    df = TK.materialize(df, F.expr(ST.fold_sql("__ftok")), "__f")

    def texts(test) -> Column:
        """The texts of the tokens that pass ``test``, those of the file before those in f-strings."""
        return F.concat(*[F.transform(F.filter(c, test), lambda x: x["t"]) for c in ("__tok", "__ftok")])

    # soft keywords that open a statement are keywords, not operands
    df = df.withColumn("__opd", texts(lambda x: x["k"].isin(*TK.OPERAND_KINDS) & x["h"].isNull()))
    if count_keywords:
        df = df.withColumn("__kw", texts(lambda x: (x["k"] == TK.K_KW) & x["t"].isin(*R.OPERATOR_KEYWORDS)))
    else:
        df = df.withColumn("__kw", F.array().cast("array<string>"))
    said = F.filter("__tok", lambda x: x["k"] != TK.K_NL)
    df = df.withColumn("__ntok", F.size(said)).withColumn("__doc", F.get(F.transform(F.slice(said, 1, 1), ST.docstring), 0))
    return df.drop("__tok", "__ftok")


OP_FIELDS = ("nasg", "naug", "nbin", "nun", "ncmp", "nbool", "nnot")


def halstead_columns(s: str = "__s", inner: str = "__f", opd: str = "__opd", kw: str = "__kw") -> dict[str, Column]:
    counts = [F.col(f"{s}.{f}") + F.col(f"{inner}.{f}") for f in OP_FIELDS]
    n1_total = sum(counts, F.lit(0)) + F.size(kw)
    n1_unique = sum((F.when(n > 0, 1).otherwise(0) for n in counts), F.lit(0)) + F.size(
        F.array_distinct(kw)
    )
    n2_total = F.size(opd)
    n2_unique = F.size(F.array_distinct(opd))
    return {
        "operators_total": n1_total.cast("int"),
        "operators_unique": n1_unique.cast("int"),
        "operands_total": n2_total.cast("int"),
        "operands_unique": n2_unique.cast("int"),
    }


METRIC_COLUMNS = (
    "complexity_score", "node_count", "cognitive_complexity", "halstead_volume",
    "maintainability_index", "sqale_debt_hours", "lines_of_code", "description",
)


#: Types of ``METRIC_COLUMNS`` as ``analyze`` gives them.
METRIC_TYPES = ("int", "bigint", "int", "double", "double", "decimal(12,2)", "int", "string")


def analyze(df: DataFrame, content: str = "content", keep: list[str] | None = None,
            count_keywords: bool = False, with_halstead_counts: bool = False) -> DataFrame:
    """All per-file metrics, one output row per input row.

    ``keep`` lists input columns carried through (default: all but content).
    Blank files get the fixed default row (M10).
    """
    keep = keep if keep is not None else [c for c in df.columns if c != content]
    st = structure(df.select(*keep, content), content, count_keywords)
    hc = halstead_columns()
    vocab = hc["operators_unique"] + hc["operands_unique"]
    n_all = hc["operators_total"] + hc["operands_total"]
    blank = is_blank(F.col(content))
    volume = halstead_volume(n_all, vocab)
    control = F.col("__s.ctl")
    cognitive = F.col("__s.cog")
    loc = lines_of_code(F.col(content))
    st = st.select(
        *keep,
        F.when(blank, 0).otherwise(control).cast("int").alias("complexity_score"),
        F.when(blank, 0).otherwise(1 + F.col("__ntok") + F.col("__s.nst")).cast("long").alias("node_count"),
        F.when(blank, 0).otherwise(cognitive).cast("int").alias("cognitive_complexity"),
        F.when(blank, 0.0).otherwise(F.round(volume, 2)).alias("halstead_volume"),
        F.when(blank, 100.0).otherwise(maintainability_index(volume, control, loc)).alias("maintainability_index"),
        F.when(blank, F.lit(0).cast("decimal(12,2)")).otherwise(sqale_hours(cognitive)).alias("sqale_debt_hours"),
        F.when(blank, 0).otherwise(loc).cast("int").alias("lines_of_code"),
        F.when(blank, F.lit(None).cast("string")).otherwise(F.col("__doc")).alias("__d"),
        *([c.alias(n) for n, c in hc.items()] if with_halstead_counts else []),
    )
    return st.withColumn("description", unquote_docstring(F.col("__d"))).drop("__d")
