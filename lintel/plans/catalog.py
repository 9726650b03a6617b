"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or data Spark derives from them) in
full; limits appear only where a top-k is the feature.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import bands as B
from lintel.operators import describe as D
from lintel.operators import fixes as FX
from lintel.operators import issues as I
from lintel.operators import lines as LN
from lintel.operators import markup as MK
from lintel.operators import nodes as N
from lintel.operators import paths as P
from lintel.operators import quality as Q
from lintel.operators import rollup as RU
from lintel.operators.metrics import analyze, line_counts
from lintel.rules import default_rules
from lintel.session import scratch_path
from lintel.sources import corpus as C
from lintel.sources import facts as FA
from lintel.sources import files as FS
from lintel.sources import state as S
from lintel.sources import stored as ST
from lintel.sources import syntax as SX
from lintel.streaming import upsert as STR

METRIC_COLS = ["repo", "file_path", "complexity_score", "node_count", "cognitive_complexity", "halstead_volume",
               "maintainability_index", "sqale_debt_hours", "lines_of_code", "description"]


#: Files in which the events of ``stream_upsert`` arrive: more rows make larger files, not more micro-batches.
DELIVERED = 12


# ----------------------------------------------------------------- inputs
def code_metrics(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return analyze(C.code_corpus(spark, sf), keep=["repo", "snapshot_id", "file_path", "doc_id"], **kw)


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of the code corpus as dashboards read them: analysed when the documents change, then only read."""
    root = scratch_path(spark, f"metrics-{zlib.crc32(sf.encode()):08x}")
    return ST.stored_metrics(C.code_corpus(spark, sf), root, os.path.join(sf, "documents.parquet"), keep=["snapshot_id", "doc_id"])


def scanned_docs(spark: SparkSession, sf: str) -> DataFrame:
    """S1/S2 over the document corpus: ``*.py`` only, ignored folders pruned."""
    d = C.docs_corpus(spark, sf)
    return FS.prune_ignored(d.filter(F.col("file_path").endswith(".py")))


def existing_files(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the code corpus that still exist: some were deleted after the scan."""
    return C.code_corpus(spark, sf).filter(F.col("doc_id") % 37 != 0).select("repo", "file_path")


# ----------------------------------------------------------------- queries
def q_scan_prune(spark, sf):
    return scanned_docs(spark, sf).select("repo", "file_path", "doc_id")


def q_loc(spark, sf):
    from lintel.operators.metrics import lines_of_code
    d = C.docs_corpus(spark, sf)
    return d.select("file_path", lines_of_code(F.col("content")).alias("lines_of_code"))


def q_file_metrics(spark, sf):
    return code_metrics(spark, sf).select(*METRIC_COLS)


def q_halstead_code(spark, sf):
    m = code_metrics(spark, sf, with_halstead_counts=True)
    return m.select("file_path", "operators_total", "operators_unique", "operands_total", "operands_unique",
                    "halstead_volume")


def q_docstring(spark, sf):
    return code_metrics(spark, sf).select("file_path", "description")


def q_mi_bands(spark, sf):
    m = stored(spark, sf)
    mi, cc = F.col("maintainability_index"), F.col("cognitive_complexity")
    return m.select(
        "file_path",
        B.file_band(mi).alias("file_band"), B.component_status(mi).alias("status"),
        B.health_text(mi).alias("health_text"), B.mi_class(mi).alias("mi_class"),
        B.complexity_rating(cc).alias("complexity_rating"), B.cognitive_band(cc).alias("cognitive_band"),
        B.debt_band(F.col("sqale_debt_hours")).alias("debt_band"),
        B.debt_text(F.col("sqale_debt_hours")).alias("debt_text"),
        F.round(B.node_weight(F.col("complexity_score")), 4).alias("node_weight"),
        B.base_name(F.col("file_path")).alias("file_name"),
        B.padded_id(F.col("doc_id")).alias("report_id"),
    )


def q_project_health(spark, sf):
    return RU.health_dashboard(stored(spark, sf), ["repo"])


def q_scan_summary(spark, sf):
    return RU.scan_summary(stored(spark, sf), ["repo"])


def q_insight(spark, sf):
    return RU.insight(stored(spark, sf), ["repo"])


def q_top_complex(spark, sf):
    return RU.top_complex(stored(spark, sf), 10).select(
        "file_path", "complexity_score", "cognitive_complexity", "maintainability_index")


def q_list_metrics(spark, sf):
    return RU.list_metrics(stored(spark, sf)).select("file_path", "complexity_score", "node_count")


def q_triage(spark, sf):
    m = stored(spark, sf)
    return RU.triage(m, existing_files(spark, sf)).select("file_path", "maintainability_index",
                                                          "cognitive_complexity")


def q_folder_rollup(spark, sf):
    return RU.folder_rollup(stored(spark, sf))


def _issues(spark, sf):
    return I.attach_metrics(FA.label_issues(spark, sf), stored(spark, sf))


def q_rank_issues(spark, sf):
    x = _issues(spark, sf).withColumn("repo", F.split("file_path", "/").getItem(2))
    return I.rank_issues(x, k=5, by=["repo"])


def q_severity_counts(spark, sf):
    x = _issues(spark, sf).withColumn("repo", F.split("file_path", "/").getItem(2))
    return I.severity_counts(x, ["repo"])


def q_issues_per_file(spark, sf):
    return I.issues_per_file(stored(spark, sf), FA.label_issues(spark, sf))


def q_diagnosis_summary(spark, sf):
    files = stored(spark, sf)
    return I.diagnosis_summary(files, I.issue_navigation(FA.label_issues(spark, sf), files))


def q_issue_navigation(spark, sf):
    return I.issue_navigation(FA.label_issues(spark, sf), existing_files(spark, sf))


def q_parse_bug_scan(spark, sf):
    return I.parse_bug_scan(FA.responses(spark, sf), stored(spark, sf))


def q_parse_diagnosis(spark, sf):
    r = FA.responses(spark, sf)
    return I.parse_diagnosis(r).select("file_path", "is_healthy", "issue", "severity",
                                       F.size("suggestions").alias("n_suggestions"),
                                       F.try_element_at("suggestions", F.lit(1)).alias("first_suggestion"))


def q_clean_code(spark, sf):
    c = C.table(spark, sf, "conversations")
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```"))) \
        .otherwise(F.concat(F.lit("  ```\n"), F.col("text"), F.lit("  ")))
    return c.select("conv_id", "turn", FX.clean_code(fenced).alias("code"))


def q_issue_type(spark, sf):
    r = FA.fix_requests(spark, sf)
    return r.select("request_id", FX.issue_type(F.col("issue_type_raw")).alias("issue_type"),
                    FX.is_simple(FX.issue_type(F.col("issue_type_raw"))).alias("simple"))


def q_requests(spark, sf):
    """Descriptions and diagnoses of all files, bug scans of those that triage keeps."""
    files = C.code_corpus(spark, sf)
    risky = RU.triage(stored(spark, sf), existing_files(spark, sf))
    return (FX.request_table(files).unionByName(FX.request_table(files, "diagnose"))
            .unionByName(FX.request_table(files, "bug_scan", wanted=risky)))


def q_report(spark, sf):
    """A report line for every file, scanned at an hour that follows from its id."""
    at = F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(hours=F.col("doc_id").cast("int"))
    m = S.stamp(stored(spark, sf), at)
    return m.select(*B.report_columns(m))


def q_export_patched(spark, sf):
    """Patched files written under their new names and read back."""
    root = scratch_path(spark, f"patched-{uuid.uuid4().hex[:8]}")
    asked = S.export_patched(q_patch_overlay(spark, sf).filter("applied"), root)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_fixed*").load(root)
    below = F.regexp_extract("path", r"(/code/.*)$", 1)
    return asked.join(read.select(below.alias("written_as"), F.sha2("content", 256).alias("content_sha256"), "length"), "written_as", "left")


def q_instruction(spark, sf):
    c = C.table(spark, sf, "conversations")
    user = F.when(F.col("role") == "user", F.concat(F.lit("\n\t"), "text", F.lit(" \n"))).otherwise(F.lit(" \n "))
    diag = F.when(F.col("turn") % 3 == 0, F.lit("Division by zero")).otherwise(F.lit(""))
    return c.select("conv_id", "turn", FX.instruction(user, diag).alias("instruction"))


def q_run_verdict(spark, sf):
    a = FA.fix_attempts(spark, sf)
    return a.select("request_id", "attempt", FX.run_passed(F.col("output")).alias("passed"))


def q_attempt_fold(spark, sf):
    return FX.fold_attempts(FA.fix_attempts(spark, sf)).select(
        "request_id", "reproduced", "winning_attempt", "winning_code", "last_attempt", "last_output",
        "fix_attempts")


def q_fix_outcomes(spark, sf):
    return FX.fix_outcomes(FA.fix_requests(spark, sf), FA.fix_attempts(spark, sf), FA.fix_sources(spark, sf))


def _generated(spark, sf):
    """One answer a conversation: its first assistant turn. A conversation without a document has a path of its own."""
    c = C.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    g = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    d = C.table(spark, sf, "documents")
    g = g.join(d.select("doc_id", FA.code_path(d.doc_id, d.source, d.lang).alias("file_path")), g.conv_id == d.doc_id, "left")
    path = F.coalesce("file_path", F.concat(F.lit("/code/none/conv_"), F.col("conv_id").cast("string"), F.lit(".py")))
    return g.select(path.alias("file_path"), F.concat(F.lit("Handles "), "t").alias("description"))


def _previous(spark, sf):
    lab = C.table(spark, sf, "labels")
    d = C.table(spark, sf, "documents")
    x = lab.join(d.select("doc_id", FA.code_path(d.doc_id, d.source, d.lang).alias("file_path")), "doc_id")
    desc = (F.when(F.col("toxic") == 1, F.lit("Description unavailable (AI skipped)"))
            .when(F.col("quality") == 1, F.concat(F.lit("Cached summary "), F.col("doc_id").cast("string")))
            .otherwise(F.lit("")))
    return x.select("file_path", F.lit(0).cast("long").alias("snapshot_id"), desc.alias("description"))


def q_description_cache(spark, sf):
    return D.description_cache(_previous(spark, sf))


def q_describe(spark, sf):
    m = stored(spark, sf)
    cache = D.description_cache(_previous(spark, sf))
    r = D.resolve_descriptions(m, cache, _generated(spark, sf))  # blank files are those with no lines of code
    return r.select("file_path", "description", "description_source")


def q_describe_missing(spark, sf):
    m = stored(spark, sf)
    return D.files_needing_generation(m, D.description_cache(_previous(spark, sf))).select("file_path")


def _expectations(spark, sf):
    d = C.table(spark, sf, "documents")
    cog = F.lit(0)
    b0 = (d.doc_id % 10).cast("int")
    b1 = (F.floor(d.doc_id / 10) % 10).cast("int")
    blocks_cog = F.array(*[F.lit(b[3]) for b in C.BLOCKS])
    n = F.size(F.split(d.text, "\n", -1))
    cog = blocks_cog[b0] + blocks_cog[b1] + 1 + 2 * n
    cog = F.when((d.doc_id % 29 == 0) | (d.doc_id % 31 == 0), 0).otherwise(cog)
    cog = cog + F.when(d.doc_id % 43 == 0, 1).otherwise(0)  # wrong expectations, which must fail
    return d.select(FA.code_path(d.doc_id, d.source, d.lang).alias("file_path"),
                    cog.alias("cognitive_complexity"),
                    F.round(cog.cast("decimal(10,0)") * F.lit(0.15).cast("decimal(3,2)"), 2)
                    .cast("decimal(12,2)").alias("sqale_debt_hours"))


def q_calibration(spark, sf):
    checks = Q.calibration(stored(spark, sf), _expectations(spark, sf))
    return Q.calibration_summary(checks)


def q_path_uniqueness(spark, sf):
    docs = C.docs_corpus(spark, sf)
    return Q.duplicate_keys(docs.unionByName(docs.filter(F.col("doc_id") % 41 == 0)))


def q_path_nodes(spark, sf):
    return P.path_nodes(scanned_docs(spark, sf))


def q_common_prefix(spark, sf):
    return P.common_prefix(scanned_docs(spark, sf))


def q_common_dir(spark, sf):
    return P.common_dir(scanned_docs(spark, sf))


def q_root_names(spark, sf):
    return P.root_names(scanned_docs(spark, sf))


def q_path_edges(spark, sf):
    return P.path_edges(scanned_docs(spark, sf))


def q_sibling_order(spark, sf):
    return P.sibling_order(P.path_nodes(scanned_docs(spark, sf))).select("path", "parent_path", "sibling_rank")


def q_list_children(spark, sf):
    return P.list_children(P.path_nodes(C.docs_corpus(spark, sf)), "/srv/src0/en")


def q_folder_counts(spark, sf):
    return P.folder_counts(P.path_nodes(C.docs_corpus(spark, sf)))


def q_diff_lines(spark, sf):
    d = C.table(spark, sf, "documents")
    pairs = d.select(F.col("doc_id").alias("file_path"), F.col("text").alias("original"),
                     F.concat(F.regexp_replace("text", "###", "#"), F.when(F.col("doc_id") % 5 == 0, "\nend").otherwise("")).alias("fixed"))
    return LN.diff_lines(pairs).select("file_path", "line_no", "original_line", "fixed_line", "changed")


def q_lines(spark, sf):
    return LN.lines(C.docs_corpus(spark, sf))


def q_content_lookup(spark, sf):
    docs = C.docs_corpus(spark, sf).withColumn("content", F.when(F.col("doc_id") % 23 != 0, F.col("content")))  # some unreadable
    lab = C.table(spark, sf, "labels")
    d = C.table(spark, sf, "documents")
    have = lab.join(d, "doc_id").select(C.doc_path(d.doc_id, d.source, d.lang).alias("file_path"))
    bench = C.table(spark, sf, "benchmark").select(
        F.concat(F.lit("/missing/b"), F.col("item_id").cast("string"), F.lit(".py")).alias("file_path"))
    return S.content_lookup(docs, have.unionByName(bench)).select(
        "file_path", "file_name", "found", "content")


def q_patch_names(spark, sf):
    return S.patch_names(scanned_docs(spark, sf).select("file_path"))


def q_upsert_latest(spark, sf):
    ev = FA.metric_events(spark, sf)
    cur = ev.filter(F.col("event_type") == "view")
    upd = ev.filter(F.col("event_type") != "view")
    return S.upsert(cur, upd).select("file_path", "last_analyzed", "seq", "sqale_debt_hours")


def q_debt_trend(spark, sf):
    ev = FA.metric_events(spark, sf)
    return Q.debt_trend(ev).select("file_path", "seq", "sqale_debt_hours", "previous_value", "delta",
                                   "running_value")


def q_markup_nodes(spark, sf):
    return MK.markup_nodes(C.table(spark, sf, "pages")).select("page_id", "seq", "node_type", "parent_type", "text")


def q_node_depth_markup(spark, sf):
    found = MK.elements(MK.markup_nodes(C.table(spark, sf, "pages")))
    return N.node_depth(found, ["page_id"]).select("page_id", F.col("seq").alias("pos"), F.col("node_type").alias("tag"), "depth")


def q_nesting_cost_markup(spark, sf):
    return MK.nesting_cost(MK.markup_nodes(C.table(spark, sf, "pages")), MK.markup_rules(spark))


def q_markup_stats(spark, sf):
    return MK.nesting_stats(C.table(spark, sf, "pages"))


def q_node_metrics_markup(spark, sf):
    """M2-M6, M8 over the nodes of every page, by a user's rules."""
    return N.analyze_nodes(MK.markup_nodes(C.table(spark, sf, "pages")), MK.markup_rules(spark, MK.WEIGHTED_RULES), ["page_id"])


def q_node_metrics_code(spark, sf):
    """M2, M3, M5-M8 of the code corpus from its syntax nodes."""
    files = C.code_corpus(spark, sf)
    key = ["repo", "file_path"]
    found = N.analyze_nodes(SX.python_nodes(files, key), default_rules(spark), key, lines=line_counts(files, key))
    return found.drop("node_count")


def q_replace_snapshot(spark, sf):
    m = code_metrics(spark, sf).select(*METRIC_COLS, "snapshot_id")
    out = scratch_path(spark, f"snapshots-{uuid.uuid4().hex[:8]}")
    return S.replace_snapshot(m, out).select(*METRIC_COLS)


def q_patch_overlay(spark, sf):
    snap = C.code_corpus(spark, sf)
    lab = C.table(spark, sf, "labels")
    d = C.table(spark, sf, "documents")
    fixes = lab.join(d, "doc_id").select(
        F.when(F.col("toxic") == 1, F.concat(F.lit("/gone/"), F.col("doc_id").cast("string"), F.lit(".py")))
        .otherwise(FA.code_path(d.doc_id, d.source, d.lang)).alias("file_path"),
        F.concat(F.lit("# fixed\n"), F.col("text")).alias("new_code"))
    return S.patch_overlay(snap, fixes).select("file_path", "snapshot_id", "content", "message", "applied")


def q_scan_files(spark, sf):
    """S1 + S3 on files written from documents into the shared folder."""
    out = scratch_path(spark, f"tree-{uuid.uuid4().hex[:8]}")
    d = C.docs_corpus(spark, sf).select(F.col("file_path").alias("rel_path"), "content",
                                        (F.col("doc_id") % 11 == 0).alias("bad"))
    FS.write_tree(d, out, encoding_bad="bad")
    src = FS.scan_sources(spark, out, repo="docs", keep_invalid=True)
    root = re.sub(r"^file:/*", "/", out).rstrip("/")
    return src.select(F.substring("file_path", len(root) + 1, 1 << 30).alias("file_path"), F.col("content").isNotNull().alias("readable"))


def q_stream_upsert(spark, sf):
    ev = FA.metric_events(spark, sf)
    src = scratch_path(spark, f"events-src-{uuid.uuid4().hex[:8]}")
    files = min(DELIVERED, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ev.repartition(files, "seq").write.parquet(src)
    st = STR.stream_upsert(spark, src, ev.schema, ["file_path"], ["last_analyzed", "seq"],
                           max_files_per_trigger=2)
    return st.select("file_path", "last_analyzed", "seq", "sqale_debt_hours")


def q_stream_debt_window(spark, sf):
    """ST2 over arrivals: five days of events at a time, every tenth event five days late."""
    work = scratch_path(spark, f"events-win-{uuid.uuid4().hex[:8]}")
    ev = FA.arrivals(C.table(spark, sf, "events"))
    ev.write.partitionBy("arrival").parquet(f"{work}/events")
    delivered, out = spark.read.parquet(f"{work}/events"), None
    for r in delivered.select("arrival").distinct().orderBy("arrival").collect():  # one row for five days of events
        rows = delivered.filter(F.col("arrival") == r.arrival).drop("arrival")
        rows.write.mode("append").parquet(f"{work}/arrived")
        out = STR.stream_window_counts(spark, f"{work}/arrived", rows.schema, "ts", ["event_type"], "value", window="1 hour", watermark="1 hour", work=work)
    return out.withColumn("value_sum", F.round("value_sum", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
