"""Model-answer parsing and issue ranking.

Answers arrive as a table ``responses(file_path, response)``. Parsing is
``try_parse_json`` + ``variant_get`` (JVM-side) so a malformed answer is a
NULL, never a failed task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel import rules as R
from lintel.functions import bands as B
from lintel.operators.keys import file_key

FENCE = "```"


def strip_fence(resp: Column) -> Column:
    """L2: trim; when it starts with a triple backtick take the 2nd part of
    the split on backticks and drop a leading ``json``; trim again."""
    t = F.regexp_replace(resp, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    second = F.try_element_at(F.split(t, "```", -1), F.lit(2))
    inner = F.when(t.startswith(FENCE) & (F.size(F.split(t, "```", -1)) > 1),
                   F.regexp_replace(second, "^json", "")).otherwise(t)
    return F.regexp_replace(inner, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def _field(answer: str, key: str) -> Column:
    """A key of a parsed object as a variant; NULL if missing, a variant null if null."""
    return F.try_variant_get(answer, f"$.{key}", "variant")


def _number(kind: Column) -> Column:
    return kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _truthy(answer: str, key: str) -> Column:
    """Truth of a JSON value: false for a missing key, null, false, zero and empty values."""
    kind = F.schema_of_variant(_field(answer, key))
    as_ = lambda t: F.try_variant_get(answer, f"$.{key}", t)
    return F.coalesce(
        F.when(kind == "BOOLEAN", as_("boolean")).when(kind == "STRING", as_("string") != "").when(_number(kind), as_("double") != 0)
        .when(kind == "VOID", F.lit(False)).otherwise(~F.to_json(_field(answer, key)).isin("{}", "[]")), F.lit(False))


def _text(answer: str, key: str, default: str) -> Column:
    """A string key; the default only if the key is missing; NULL for any other type."""
    kind = F.schema_of_variant(_field(answer, key))
    return F.when(kind.isNull(), F.lit(default)).when(kind == "STRING", F.try_variant_get(answer, f"$.{key}", "string"))


def severity_rank(sev: Column) -> Column:
    """O1 sort key: high 0, medium 1, low 2, anything else 1."""
    expr = F.lit(R.UNKNOWN_SEVERITY_RANK)
    for name, rank in reversed(R.SEVERITY_RANK):
        expr = F.when(sev == name, F.lit(rank)).otherwise(expr)
    return expr


def parse_diagnosis(responses: DataFrame) -> DataFrame:
    """L3 + L4: diagnosis per answer.

    Parsed object: missing keys default to false / 'Analysis complete' /
    'low' / []; a key of a wrong type (null included) makes the answer invalid,
    a failed analysis. Unparsable: healthy, 'Code analyzed - no critical issues
    found', severity 'none', first 200 characters as the only suggestion.
    """
    v = F.try_parse_json(strip_fence(F.col("response")))
    df = responses.withColumn("__v", v)
    schema = F.schema_of_variant(F.col("__v"))
    bad = F.col("__v").isNull()
    obj = ~bad & schema.startswith("OBJECT")
    # a parsed non-object makes the reference's ``.get`` raise; its handler
    # reports the Python type name
    pytype = (F.when(schema.startswith("ARRAY"), "list")
              .when(schema.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
              .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "float")
              .when(schema == "STRING", "str").when(schema == "BOOLEAN", "bool").otherwise("NoneType"))
    empty = F.array().cast("array<string>")
    hk, sk = F.schema_of_variant(_field("__v", "is_healthy")), F.schema_of_variant(_field("__v", "suggestions"))
    as_text = F.lower(F.try_variant_get("__v", "$.is_healthy", "string"))
    healthy = (F.when(hk.isNull(), F.lit(False)).when(hk == "BOOLEAN", F.try_variant_get("__v", "$.is_healthy", "boolean"))
               .when(as_text.isin("true", "1", "yes", "on", "t", "y"), F.lit(True))
               .when(as_text.isin("false", "0", "no", "off", "f", "n"), F.lit(False)))
    sugg = F.when(sk.isNull(), empty).when(sk == "ARRAY<STRING>", F.try_variant_get("__v", "$.suggestions", "array<string>")) \
        .when(sk == "ARRAY<VOID>", empty)
    issue, severity = _text("__v", "issue", "Analysis complete"), _text("__v", "severity", "low")
    valid = obj & healthy.isNotNull() & sugg.isNotNull() & issue.isNotNull() & severity.isNotNull()
    failed = F.when(obj, F.lit("Analysis failed: invalid answer")).otherwise(
        F.concat(F.lit("Analysis failed: '"), pytype, F.lit("' object has no attribute 'get'")))
    return df.select(
        "file_path",
        F.when(valid, healthy).when(bad, F.lit(True)).otherwise(F.lit(False)).alias("is_healthy"),
        F.when(valid, issue).when(bad, F.lit("Code analyzed - no critical issues found")).otherwise(failed).alias("issue"),
        F.when(valid, severity).when(bad, F.lit("none")).otherwise(F.lit("medium")).alias("severity"),
        F.when(valid, sugg)
        .when(bad, F.when(F.length("response") > 0, F.array(F.substring("response", 1, 200))).otherwise(empty))
        .otherwise(empty).alias("suggestions"),
    )


def parse_bug_scan(responses: DataFrame, metrics: DataFrame) -> DataFrame:
    """L5 + J4: bug-scan answers to issue rows with the file's metrics.

    Object with truthy ``has_bug`` -> issue (defaults 'Potential issue
    detected' / 'medium' for missing keys; no row if a key isn't text);
    unparsable but mentioning bug/error -> medium
    issue with the first 150 characters; valid non-object JSON -> no row.
    """
    v = F.try_parse_json(strip_fence(F.col("response")))
    df = responses.withColumn("__v", v)
    kind = F.when(F.col("__v").isNull(), "bad").when(
        F.schema_of_variant(F.col("__v")).startswith("OBJECT"), "obj").otherwise("other")
    has_bug = _truthy("__v", "has_bug")
    low = F.lower("response")
    mentions = low.contains("bug") | low.contains("error")
    x = df.withColumn("__kind", kind).where(
        ((F.col("__kind") == "obj") & has_bug) | ((F.col("__kind") == "bad") & mentions))
    x = x.select(
        *file_key(responses),
        F.when(F.col("__kind") == "obj",
               _text("__v", "issue", "Potential issue detected"))
        .otherwise(F.when(F.length("response") > 0, F.substring("response", 1, 150))
                   .otherwise(F.lit("Analysis inconclusive"))).alias("issue"),
        F.when(F.col("__kind") == "obj",
               _text("__v", "severity", "medium"))
        .otherwise(F.lit("medium")).alias("severity"),
    ).filter(F.col("issue").isNotNull() & F.col("severity").isNotNull())
    return attach_metrics(x, metrics)


def attach_metrics(issues: DataFrame, metrics: DataFrame) -> DataFrame:
    """Inner equi-join on the file; adds name, rank, cognitive and MI."""
    key = file_key(issues, metrics)
    m = metrics.select(*key, "cognitive_complexity", "maintainability_index")
    return issues.join(m, key, "inner").select(
        *key, B.base_name(F.col("file_path")).alias("file_name"), "issue", "severity",
        severity_rank(F.col("severity")).alias("severity_rank"),
        "cognitive_complexity", "maintainability_index",
    )


def rank_issues(issues: DataFrame, k: int | None = None, by: list[str] | None = None) -> DataFrame:
    """O1: severity rank, then MI ascending, then path (stable total order).

    With ``k`` and ``by``: top-k per group via a window after one shuffle on
    the group key; with ``k`` only: a global TakeOrderedAndProject.
    """
    order = [F.asc("severity_rank"), F.asc("maintainability_index"), F.asc("file_path"), F.asc("issue")]
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        r = issues.withColumn("issue_rank", F.row_number().over(w))
        return r.filter(F.col("issue_rank") <= k) if k else r
    if k:
        return issues.orderBy(*order).limit(k)
    return issues.orderBy(*order)


def severity_counts(issues: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A3: counts of high/medium/low and of any other severity."""
    sev = F.col("severity")
    aggs = [
        F.count_if(sev == "high").alias("high"),
        F.count_if(sev == "medium").alias("medium"),
        F.count_if(sev == "low").alias("low"),
        F.count_if(~sev.isin("high", "medium", "low") | sev.isNull()).alias("other"),
    ]
    return issues.groupBy(*by).agg(*aggs) if by else issues.agg(*aggs)


def issues_per_file(metrics: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue count per file, 0 when none (aggregate, then left join)."""
    key = file_key(issues, metrics)
    per = issues.groupBy(*key).agg(F.count(F.lit(1)).alias("issues"))
    return metrics.select(*key).join(per, key, "left").select(
        *key, F.coalesce("issues", F.lit(0).cast("long")).alias("issues"))


def diagnosis_summary(metrics: DataFrame, issues: DataFrame) -> DataFrame:
    """A4: total files (all, before triage) and number of issues found."""
    total = metrics.agg(F.count(F.lit(1)).alias("total_files"))
    found = issues.agg(F.count(F.lit(1)).alias("files_with_issues"))
    return total.select("total_files", found.select("files_with_issues").scalar().alias("files_with_issues"))


def issue_navigation(issues: DataFrame, metrics: DataFrame) -> DataFrame:
    """Only issues whose file is present (left semi join)."""
    key = file_key(issues, metrics)
    return issues.join(metrics.select(*key), key, "left_semi")
