"""Fix requests and attempts folded into outcomes.

The live agent loop is replaced by fact tables: ``fix_requests`` (one row
per request) and ``fix_attempts`` (run outputs per attempt). The fold is a
grouped aggregate with ``min``/``max_by``, so a request with many attempts
is combined map-side first and never collected into one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel import rules as R
from lintel.operators.keys import file_key


def clean_code(resp: Column) -> Column:
    """Trim; drop a leading ```python or ```, and a trailing ```; trim."""
    ws = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"
    t = F.regexp_replace(resp, ws, "")
    t = F.regexp_replace(t, r"^```(?:python)?", "")
    t = F.regexp_replace(t, r"```$", "")
    return F.regexp_replace(t, ws, "")


def issue_type(raw: Column) -> Column:
    """Trim, lower, spaces to underscores; unknown -> behavioral_bug."""
    t = F.regexp_replace(F.lower(F.regexp_replace(raw, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")), " ", "_")
    return F.when(t.isin(*R.ISSUE_TYPES), t).otherwise(F.lit("behavioral_bug"))


def is_simple(issue_t: Column) -> Column:
    """typo/docs/style skip verification."""
    return issue_t.isin(*R.SIMPLE_ISSUE_TYPES)


def run_passed(output: Column) -> Column:
    """Passed unless the output starts 'Error:' or has a traceback or
    an assertion error."""
    o = F.coalesce(output, F.lit(""))
    return ~o.startswith("Error:") & ~o.contains("Traceback") & ~o.contains("AssertionError")


def instruction(user_text: Column, diagnosed: Column) -> Column:
    """Trimmed user text, else the diagnosed issue, else a constant."""
    u = F.nullif(F.regexp_replace(user_text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", ""), F.lit(""))
    d = F.nullif(diagnosed, F.lit(""))
    return F.coalesce(u, d, F.lit("Fix any issues in this file"))


def fold_attempts(attempts: DataFrame) -> DataFrame:
    """L1: per request, the first passing attempt within the limit wins;
    otherwise the last attempt's output is the error.

    Attempt 0 is the reproduction run on the original code, 1..3 the fixes.
    """
    a = attempts.withColumn("passed", run_passed(F.col("output")))
    fix = (F.col("attempt") >= 1) & (F.col("attempt") <= R.MAX_FIX_ATTEMPTS)
    win = fix & F.col("passed")
    # one partial+final aggregate; min_by/max_by skip rows whose key is NULL
    return a.groupBy("request_id").agg(
        F.max(F.when(F.col("attempt") == 0, ~F.col("passed"))).alias("reproduced"),
        F.min(F.when(win, F.col("attempt"))).alias("winning_attempt"),
        F.min_by(F.col("fixed_code"), F.when(win, F.col("attempt"))).alias("winning_code"),
        F.min_by(F.col("fixed_code"), F.when(fix, F.col("attempt"))).alias("first_code"),
        F.max(F.when(fix, F.col("attempt"))).alias("last_attempt"),
        F.max_by(F.col("output"), F.when(fix, F.col("attempt"))).alias("last_output"),
        F.count_if(fix).alias("fix_attempts"),
        F.min_by(F.col("fixed_code"), F.when(F.col("attempt") == 0, F.lit(0))).alias("repro_script"),
        F.min_by(F.col("output"), F.when(F.col("attempt") == 0, F.lit(0))).alias("test_output"),
        F.max_by(F.col("fixed_code"), F.when(fix, F.col("attempt"))).alias("last_code"),
    )


def fix_outcomes(requests: DataFrame, attempts: DataFrame, sources: DataFrame) -> DataFrame:
    """L8 + L10: the outcome ladder per request.

    not found -> unreadable -> simple (success with the first code, verification skipped) ->
    verification unavailable -> not reproduced -> fixed -> exhausted.
    ``repro_script`` stands wherever the reproduction ran, ``test_output`` where
    it didn't fail, ``last_attempt`` (code) and ``last_error`` where all fixes failed.
    """
    folded = fold_attempts(attempts)
    src = sources.select("file_path", F.col("content").isNotNull().alias("readable"),
                         F.lit(True).alias("exists"))
    r = requests.withColumn("issue_type", issue_type(F.col("issue_type_raw")))
    x = r.join(src, "file_path", "left").join(folded, "request_id", "left")
    exists = F.coalesce(F.col("exists"), F.lit(False))
    simple = is_simple(F.col("issue_type"))
    reproduced = F.coalesce(F.col("reproduced"), F.lit(False))
    won = F.col("winning_attempt").isNotNull()
    status = (
        F.when(~exists, "failed").when(~F.col("readable"), "failed").when(simple, "success")
        .when(~F.col("verifier_available"), "failed").when(~reproduced, "failed")
        .when(won, "success").otherwise("failed")
    )
    reason = (
        F.when(~exists, F.concat(F.lit("File not found: "), F.col("file_path")))
        .when(~F.col("readable"), F.lit("Could not read file"))
        .when(simple, F.lit(None))
        .when(~F.col("verifier_available"),
              F.lit("Docker sandbox is not available (required for behavioral bug verification)"))
        .when(~reproduced, F.lit("Could not reproduce bug - test passes on original code"))
        .when(won, F.lit(None))
        .otherwise(F.lit(f"Could not fix after {R.MAX_FIX_ATTEMPTS} attempts"))
    )
    tried = exists & F.col("readable") & ~simple & F.col("verifier_available")
    ran = exists & F.col("readable") & ~simple & F.col("verifier_available") & reproduced
    return x.select(
        "request_id", "file_path", "issue_type",
        status.alias("status"), reason.cast("string").alias("reason"),
        F.when(exists & F.col("readable") & simple, F.lit(1))
        .when(ran & won, F.col("winning_attempt")).cast("int").alias("attempts"),
        F.when(exists & F.col("readable") & simple, F.lit("skipped (simple issue)"))
        .when(ran, F.lit("verified")).alias("verification"),
        F.when(ran & ~won, F.col("last_output")).alias("last_error"),
        F.when(exists & F.col("readable") & simple, F.col("first_code")).when(ran & won, F.col("winning_code")).alias("fixed_code"),
        F.when(tried, F.col("repro_script")).alias("repro_script"),
        F.when(tried & ~reproduced, F.col("test_output")).alias("test_output"),
        F.when(ran & ~won, F.col("last_code")).alias("last_attempt"),
    )


#: Kinds of requests, and what an answer to each is made of.
TASKS = {"describe": ("text",), "diagnose": ("is_healthy", "issue", "severity", "suggestions"), "bug_scan": ("has_bug", "issue", "severity")}
HEAD_CHARS = 2000


def request_table(files: DataFrame, task: str = "describe", wanted: DataFrame | None = None) -> DataFrame:
    """What a model is asked about each file, of the files ``wanted`` if given.

    A description sees the base name and the first 2000 characters, a diagnosis
    and a bug scan the whole code. Texts are joined with ``wanted`` keys alone.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    if wanted is not None:
        key = file_key(files, wanted)
        files = files.join(wanted.select(*key), key, "left_semi")
    name = F.substring_index(F.col("file_path"), "/", -1)
    head = F.substring(F.col("content"), 1, HEAD_CHARS) if task == "describe" else F.lit(None).cast("string")
    code = F.lit(None).cast("string") if task == "describe" else F.col("content")
    return files.select(
        "file_path", name.alias("file_name"), F.lit(task).alias("task"), head.alias("content_head"), code.alias("code"),
        F.length("content").alias("content_chars"), F.lit(",".join(TASKS[task])).alias("answer_keys"),
    )
