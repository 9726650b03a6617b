"""DuckDB oracle SQL for the registered queries.

The oracles are written independently of the engine's algorithm: code
metrics come from the hand-counted block constants of the code corpus,
text rules from DuckDB list/regex functions, orderings from window
functions. Views ``region ... conversations`` are pre-registered.
"""

from __future__ import annotations

import io
import tokenize

from lintel.sources import corpus as C
from lintel.sources.facts import PRIORITY_TYPES

NL = "chr(10)"
WS = r"[ \t\n\r\f\x0B]"


def lit(s: str) -> str:
    """A DuckDB string expression for ``s`` (newlines via chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return f" || {NL} || ".join(quoted)


def _list(vals) -> str:
    return "[" + ", ".join(lit(v) for v in vals) + "]"


OPS = ("assignment", "augmented_assignment", "binary_operator", "unary_operator", "comparison_operator",
       "boolean_operator", "not_operator")


def token_count(code: str) -> int:
    """Tokens of a block by Python's own tokenizer, without layout and comments; an f-string is one token."""
    layout = (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.COMMENT, tokenize.ENDMARKER)
    count = inside = 0
    for t in tokenize.generate_tokens(io.StringIO(code).readline):
        inside -= t.type == getattr(tokenize, "FSTRING_END", -1)
        count += t.type not in layout and not inside and t.type != getattr(tokenize, "FSTRING_END", -1)
        inside += t.type == getattr(tokenize, "FSTRING_START", -1)
    return count


def _blocks_values() -> str:
    rows = []
    for i, (txt, loc, ctl, cog, nst, ops, opd) in enumerate(C.BLOCKS):
        counts = ", ".join(str(ops.get(o, 0)) for o in OPS)
        rows.append(f"({i}, {lit(txt)}, {loc}, {ctl}, {cog}, {nst}, {counts}, {_list(opd)}, {token_count(txt)})")
    return "VALUES " + ", ".join(rows)


CODE_CTE = f"""
blk(b, txt, loc, ctl, cog, nst, asg, aug, bin, un, cmp, boo, nno, opd, ntk) AS ({_blocks_values()}),
cbase AS (
  SELECT doc_id, source AS repo, lang, text, replace(text, '\"\"\"', '') AS body,
         len(string_split(text, {NL})) AS nl,
         CASE WHEN doc_id % 29 = 0 THEN 'blank' WHEN doc_id % 31 = 0 THEN 'tiny' ELSE 'full' END AS kind,
         CAST(doc_id % 10 AS INTEGER) AS b0, CAST((doc_id // 10) % 10 AS INTEGER) AS b1
  FROM documents),
cc AS (
  SELECT c.doc_id, c.repo, c.body, c.nl, c.kind, x.ntk + y.ntk + 1 + 5 + 6 * c.nl AS ntok,
    '/code/' || c.repo || '/' || c.lang || '/mod_' || CAST(c.doc_id AS VARCHAR) || '.py' AS file_path,
    CASE c.kind WHEN 'blank' THEN {NL} || '  ' || chr(9) || {NL} WHEN 'tiny' THEN 'x = 1' || {NL} ELSE
    '\"\"\"' || {NL} || c.body || {NL} || '\"\"\"' || {NL} || {NL} || {NL} || x.txt || {NL} || {NL} || y.txt
      || {NL} || {NL} || 'for row in rows:' || {NL}
      || repeat('    if flag:' || {NL} || '        total += 1' || {NL}, CAST(c.nl AS BIGINT)) END AS content,
    x.ctl + y.ctl + 1 + c.nl AS ctl,
    x.cog + y.cog + 1 + 2 * c.nl AS cog,
    1 + x.nst + y.nst + 1 + 2 * c.nl AS nst,
    x.asg + y.asg AS asg, x.aug + y.aug + c.nl AS aug, x.bin + y.bin AS bin, x.un + y.un AS un,
    x.cmp + y.cmp AS cmp, x.boo + y.boo AS boo, x.nno + y.nno AS nno,
    1 + len(x.opd) + len(y.opd) + 2 + 3 * c.nl AS n2_total,
    len(list_distinct(list_concat(['\"\"\"' || {NL} || c.body || {NL} || '\"\"\"'], x.opd, y.opd,
        ['row', 'rows', 'flag', 'total', '1']))) AS n2_unique
  FROM cbase c JOIN blk x ON x.b = c.b0 JOIN blk y ON y.b = c.b1),
ch AS (
  SELECT *, asg + aug + bin + un + cmp + boo + nno AS n1_total,
    (asg > 0)::INT + (aug > 0)::INT + (bin > 0)::INT + (un > 0)::INT + (cmp > 0)::INT + (boo > 0)::INT
      + (nno > 0)::INT AS n1_unique,
    len(list_filter(string_split(content, {NL}), lambda l: regexp_matches(l, '^{WS}*[^ \\t\\n\\r\\f\\x0B#]')))
      AS loc_raw
  FROM cc),
cv AS (
  SELECT *, CASE WHEN n1_unique + n2_unique = 0 THEN 0.0
                 ELSE (n1_total + n2_total) * log2(n1_unique + n2_unique) END AS vol,
         greatest(loc_raw, 1) AS loc
  FROM ch),
cf AS (
  SELECT repo, doc_id, file_path, content, kind,
    CAST(ctl AS INTEGER) AS complexity_score,
    CAST(1 + ntok + nst AS BIGINT) AS node_count,
    CAST(cog AS INTEGER) AS cognitive_complexity,
    round(vol, 2) AS halstead_volume,
    round(least(100.0, greatest(0.0, (171 - 5.2 * ln(greatest(vol, 1.0)) - 0.23 * greatest(ctl, 1)
      - 16.2 * ln(greatest(loc, 1))) * 100 / 171)), 2) AS maintainability_index,
    CAST(round(cog * 0.15, 2) AS DECIMAL(12,2)) AS sqale_debt_hours,
    CAST(loc AS INTEGER) AS lines_of_code,
    regexp_replace(body, '^{WS}+|{WS}+$', '', 'g') AS description,
    n1_total, n1_unique, n2_total, n2_unique
  FROM cv),
cm AS (  -- blank and one-statement files by their hand-counted constants
  SELECT repo, doc_id, file_path, content,
    CASE WHEN kind = 'full' THEN complexity_score ELSE 0 END AS complexity_score,
    CAST(CASE kind WHEN 'full' THEN node_count WHEN 'tiny' THEN 5 ELSE 0 END AS BIGINT) AS node_count,
    CASE WHEN kind = 'full' THEN cognitive_complexity ELSE 0 END AS cognitive_complexity,
    CASE kind WHEN 'full' THEN halstead_volume WHEN 'tiny' THEN 4.75 ELSE 0.0 END AS halstead_volume,
    CASE kind WHEN 'full' THEN maintainability_index WHEN 'tiny' THEN 95.12 ELSE 100.0 END AS maintainability_index,
    CAST(CASE WHEN kind = 'full' THEN sqale_debt_hours ELSE 0 END AS DECIMAL(12,2)) AS sqale_debt_hours,
    CAST(CASE kind WHEN 'full' THEN lines_of_code WHEN 'tiny' THEN 1 ELSE 0 END AS INTEGER) AS lines_of_code,
    CASE WHEN kind = 'full' THEN description END AS description,
    CASE kind WHEN 'full' THEN n1_total WHEN 'tiny' THEN 1 ELSE 0 END AS n1_total,
    CASE kind WHEN 'full' THEN n1_unique WHEN 'tiny' THEN 1 ELSE 0 END AS n1_unique,
    CASE kind WHEN 'full' THEN n2_total WHEN 'tiny' THEN 2 ELSE 0 END AS n2_total,
    CASE kind WHEN 'full' THEN n2_unique WHEN 'tiny' THEN 2 ELSE 0 END AS n2_unique
  FROM cf)
"""

DOC_PATH = (
    "'/srv/' || source || '/' || lang || '/' || "
    "CASE WHEN doc_id % 13 = 0 THEN 'venv/' WHEN doc_id % 17 = 0 THEN '.git/' "
    "WHEN doc_id % 19 = 0 THEN 'pkg/sub/' ELSE '' END || 'm' || CAST(doc_id AS VARCHAR) || "
    "CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.py' END"
)
IGNORE = "[" + ", ".join(f"'{d}'" for d in __import__("lintel.rules", fromlist=["x"]).IGNORE_DIRS) + "]"
DOCS_CTE = f"""
dc AS (SELECT source AS repo, doc_id, text AS content, {DOC_PATH} AS file_path FROM documents),
sd AS (SELECT * FROM dc WHERE file_path LIKE '%.py'
       AND NOT list_has_any(string_split(file_path, '/'), {IGNORE}))
"""

CODE_PATH = "'/code/' || source || '/' || lang || '/mod_' || CAST(doc_id AS VARCHAR) || '.py'"


def with_code(body: str) -> str:
    return f"WITH {CODE_CTE}\n{body}"


def with_docs(body: str) -> str:
    return f"WITH {DOCS_CTE}\n{body}"


def _band(col: str, cuts, default: str, op: str = ">=") -> str:
    whens = " ".join(f"WHEN {col} {op} {v} THEN '{lab}'" for v, lab in cuts)
    return f"CASE {whens} ELSE '{default}' END"


def debt_text(h: str) -> str:
    return (f"CASE WHEN {h} < 1 THEN CAST(CAST(round(CAST({h} AS DECIMAL(14,4)) * 60, 0) AS BIGINT) AS VARCHAR) || 'm' "
            f"WHEN {h} < 10 THEN printf('%.1f', round(CAST({h} AS DECIMAL(14,4)), 1)) || 'h' "
            f"ELSE CAST(CAST(round(CAST({h} AS DECIMAL(14,4)), 0) AS BIGINT) AS VARCHAR) || 'h' END")


SEV_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 1 END"
LABEL_ISSUES = f"""
li AS (SELECT {CODE_PATH} AS file_path,
         CASE WHEN toxic = 1 THEN 'Unsafe content' WHEN quality = 0 THEN 'Low quality text'
              ELSE 'Minor wording' END AS issue,
         CASE WHEN toxic = 1 AND quality = 0 THEN 'critical' WHEN toxic = 1 THEN 'high'
              WHEN quality = 0 THEN 'medium' ELSE 'low' END AS severity
       FROM labels JOIN documents USING (doc_id)),
im AS (SELECT li.file_path, regexp_extract(li.file_path, '[^/]*$') AS file_name, li.issue, li.severity,
         {SEV_RANK} AS severity_rank, cm.cognitive_complexity, cm.maintainability_index
       FROM li JOIN cm USING (file_path))
"""

RESPONSES = f"""
rs AS (SELECT CASE WHEN doc_id IS NULL THEN '/code/none/conv_' || CAST(conv_id AS VARCHAR) || '.py' ELSE {CODE_PATH} END AS file_path, conv_id, turn,
  CASE conv_id % 9
    WHEN 0 THEN {NL} || chr(9) || '```json' || {NL} || CAST(to_json({{'has_bug': true, 'issue': c.text,
         'severity': ['high', 'medium', 'low'][turn % 3 + 1]}}) AS VARCHAR) || {NL} || '```'
    WHEN 1 THEN CAST(to_json({{'has_bug': turn % 4 = 1, 'issue': c.text}}) AS VARCHAR)
    WHEN 2 THEN '{{"has_bug": true}}'
    WHEN 3 THEN '[1, 2, 3]'
    WHEN 4 THEN c.text
    WHEN 6 THEN '{{"has_bug": "false", "is_healthy": true, "suggestions": ["a", "b"]}}'
    WHEN 7 THEN '{{"has_bug": true, "issue": null, "is_healthy": null}}'
    WHEN 8 THEN '{{"has_bug": 2, "severity": "low", "is_healthy": "yes", "suggestions": null}}'
    ELSE 'Found an error: ' || c.text END AS response
  FROM conversations c LEFT JOIN documents ON c.conv_id = doc_id),
rj AS (SELECT *, trim(response, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS t0 FROM rs),
rk AS (SELECT *, trim(CASE WHEN starts_with(t0, '```') AND len(string_split(t0, '```')) > 1
                     THEN regexp_replace(string_split(t0, '```')[2], '^json', '') ELSE t0 END,
                     ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS cleaned FROM rj),
rp AS (SELECT *, try_cast(cleaned AS JSON) AS j FROM rk),
rq AS (SELECT *, CASE WHEN j IS NULL THEN 'bad' WHEN json_type(j) = 'OBJECT' THEN 'obj' ELSE 'other' END AS kind
       FROM rp)
"""

FIX = f"""
fr AS (SELECT o_orderkey AS request_id,
         CASE WHEN o_orderstatus = 'P' THEN '/fix/missing/c' ELSE '/fix/c' END || CAST(o_custkey AS VARCHAR) || '.py'
           AS file_path,
         CASE o_orderpriority {' '.join(f"WHEN '{p}' THEN '{t}'" for p, t in PRIORITY_TYPES)} ELSE 'unknown' END
           AS issue_type_raw,
         o_orderstatus <> 'F' AS verifier_available
       FROM orders),
fa AS (SELECT l_orderkey AS request_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS attempt,
         CASE WHEN l_returnflag = 'R' THEN 'Traceback (most recent call last): boom'
              WHEN l_returnflag = 'A' THEN 'Error: assertion failed'
              ELSE 'ok ' || CAST(l_linenumber AS VARCHAR) END AS output,
         'fixed_' || CAST(l_partkey AS VARCHAR) AS fixed_code
       FROM lineitem),
fp AS (SELECT *, NOT (starts_with(output, 'Error:') OR contains(output, 'Traceback')
                      OR contains(output, 'AssertionError')) AS passed,
              attempt BETWEEN 1 AND 3 AS fix FROM fa),
ff AS (SELECT request_id,
         bool_or(CASE WHEN attempt = 0 THEN NOT passed END) AS reproduced,
         min(CASE WHEN fix AND passed THEN attempt END) AS winning_attempt,
         arg_min(fixed_code, attempt) FILTER (WHERE fix AND passed) AS winning_code,
         arg_min(fixed_code, attempt) FILTER (WHERE fix) AS first_code,
         max(CASE WHEN fix THEN attempt END) AS last_attempt,
         arg_max(output, attempt) FILTER (WHERE fix) AS last_output,
         count(*) FILTER (WHERE fix) AS fix_attempts,
         arg_min(fixed_code, attempt) FILTER (WHERE attempt = 0) AS repro_script, arg_min(output, attempt) FILTER (WHERE attempt = 0) AS test_output,
         arg_max(fixed_code, attempt) FILTER (WHERE fix) AS last_code
       FROM fp GROUP BY request_id),
fs AS (SELECT '/fix/c' || CAST(c_custkey AS VARCHAR) || '.py' AS file_path, c_acctbal >= 0 AS readable FROM customer)
"""

ISSUE_TYPE = ("CASE WHEN replace(lower(trim(issue_type_raw, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || "
              "chr(11))), ' ', '_') IN ('behavioral_bug', 'typo', 'docs', 'style') THEN replace(lower(trim("
              "issue_type_raw, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), ' ', '_') "
              "ELSE 'behavioral_bug' END")

EVENTS = """
ev AS (SELECT '/events/user_' || CAST(user_id AS VARCHAR) || '.py' AS file_path, ts AS last_analyzed,
         event_id AS seq, CAST(value AS DECIMAL(12,2)) AS sqale_debt_hours, event_type FROM events)
"""

# The markup tree, token by token: texts cut at every "<", a recursive table of open elements, rules as lists.
VOID = "['area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr']"
P_ENDERS = ("['address','article','aside','blockquote','details','div','dl','fieldset','figcaption','figure','footer','form','h1','h2','h3',"
            "'h4','h5','h6','header','hr','main','menu','nav','ol','p','pre','section','table','ul']")
TREE = rf"""
tokens AS (
  SELECT page_id, unnest(t) AS raw, generate_subscripts(t, 1) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<[!?][^>]*>|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|'
      || '<textarea[^>]*>.*?</textarea\s*>|<title[^>]*>.*?</title\s*>|</?[a-z][^>]*>|[^<]+|<') AS t FROM pages)),
named AS (
  SELECT page_id, i, raw,
    CASE WHEN raw LIKE '<!%' OR raw LIKE '<?%' THEN 'skip' WHEN raw LIKE '</%' THEN 'close' WHEN raw LIKE '<%' THEN 'open' ELSE 'text' END AS op,
    lower(regexp_extract(raw, '^</?([A-Za-z][A-Za-z0-9:_-]*)', 1)) AS name FROM tokens),
ruled AS (
  SELECT *,
    CASE WHEN op <> 'open' THEN [] WHEN name = 'li' THEN ['li'] WHEN name IN ('dt', 'dd') THEN ['dt', 'dd'] WHEN name IN ('td', 'th') THEN ['td', 'th']
         WHEN name = 'tr' THEN ['tr', 'td', 'th'] WHEN name IN ('thead', 'tbody', 'tfoot') THEN ['tr', 'td', 'th', 'thead', 'tbody', 'tfoot']
         WHEN name = 'option' THEN ['option'] WHEN name = 'optgroup' THEN ['option', 'optgroup']
         WHEN list_contains({P_ENDERS}, name) THEN ['p'] ELSE [] END AS ends,
    CASE WHEN op = 'close' AND name IN ('table', 'caption', 'tr', 'td', 'th', 'thead', 'tbody', 'tfoot') THEN ['table']
         WHEN op = 'close' THEN ['caption', 'table', 'td', 'th'] WHEN name = 'li' THEN ['menu', 'ol', 'ul'] WHEN name IN ('dt', 'dd') THEN ['dl']
         WHEN name IN ('td', 'th') THEN ['table', 'tr'] WHEN name IN ('tr', 'thead', 'tbody', 'tfoot') THEN ['table']
         WHEN name = 'option' THEN ['datalist', 'optgroup', 'select'] WHEN name = 'optgroup' THEN ['select']
         ELSE ['button', 'caption', 'table', 'td', 'th'] END AS walls,
    op = 'open' AND name NOT IN ('script', 'style', 'textarea', 'title') AND NOT list_contains({VOID}, name) AND raw NOT LIKE '%/>' AS holds
  FROM named),
run AS (
  SELECT page_id, 0::BIGINT AS i, []::VARCHAR[] AS around, []::VARCHAR[] AS open FROM pages
  UNION ALL
  SELECT page_id, i, around, CASE WHEN holds THEN list_append(around, name) ELSE around END FROM (
    SELECT e.page_id, e.i, e.name, e.holds,
      CASE WHEN e.op = 'open' THEN open[:coalesce(list_min(list_filter(range(1, len(open) + 1), lambda k: list_contains(e.ends, open[k])
                  AND k > coalesce(list_max(list_filter(range(1, len(open) + 1), lambda m: list_contains(e.walls, open[m]))), 0))), len(open) + 1) - 1]
           WHEN e.op = 'close' AND open[list_max(list_filter(range(1, len(open) + 1), lambda k: open[k] = e.name OR list_contains(e.walls, open[k])))] = e.name
           THEN open[:list_max(list_filter(range(1, len(open) + 1), lambda k: open[k] = e.name)) - 1]
           ELSE open END AS around
    FROM run r JOIN ruled e ON e.page_id = r.page_id AND e.i = r.i + 1)),
nodes AS (
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i, sub))::INTEGER AS seq, node_type, around, text FROM (
    SELECT r.page_id, r.i, 0 AS sub, CASE WHEN op = 'open' THEN name ELSE '#text' END AS node_type, r.around,
      CASE WHEN op = 'text' THEN trim(raw, ' ' || chr(9) || chr(10) || chr(13)) END AS text
    FROM run r JOIN ruled USING (page_id, i) WHERE op = 'open' OR (op = 'text' AND regexp_matches(raw, '\S'))
    UNION ALL
    SELECT r.page_id, r.i, 1, '#text', list_append(r.around, name), trim(regexp_extract(raw, '(?is)^<[^>]*>(.*)<[^<]*$', 1), ' ' || chr(9) || chr(10) || chr(13))
    FROM run r JOIN ruled USING (page_id, i)
    WHERE op = 'open' AND name IN ('script', 'style', 'textarea', 'title') AND regexp_matches(regexp_extract(raw, '(?is)^<[^>]*>(.*)<[^<]*$', 1), '\S')))
"""

SQL: dict[str, str] = {}

SQL["scan_prune"] = with_docs("SELECT repo, file_path, doc_id FROM sd")

SQL["loc"] = with_docs(
    f"SELECT file_path, CAST(greatest(len(list_filter(string_split(content, {NL}), "
    f"lambda l: regexp_matches(l, '^{WS}*[^ \\t\\n\\r\\f\\x0B#]'))), 1) AS INTEGER) AS lines_of_code FROM dc")

SQL["file_metrics"] = with_code(
    "SELECT repo, file_path, complexity_score, node_count, cognitive_complexity, halstead_volume, "
    "maintainability_index, sqale_debt_hours, lines_of_code, description FROM cm")

SQL["halstead_code"] = with_code(
    "SELECT file_path, CAST(n1_total AS INTEGER) AS operators_total, CAST(n1_unique AS INTEGER) AS operators_unique, "
    "CAST(n2_total AS INTEGER) AS operands_total, CAST(n2_unique AS INTEGER) AS operands_unique, halstead_volume FROM cm")

SQL["docstring"] = with_code("SELECT file_path, description FROM cm")

SQL["mi_bands"] = with_code(f"""
SELECT file_path,
  {_band('maintainability_index', [(85, 'green'), (65, 'yellow')], 'red')} AS file_band,
  {_band('maintainability_index', [(65, 'NOMINAL'), (40, 'DEGRADED')], 'CRITICAL')} AS status,
  {_band('maintainability_index', [(85, 'Excellent'), (70, 'Good'), (50, 'Moderate'), (30, 'Poor')], 'Critical')}
    AS health_text,
  {_band('maintainability_index', [(85, 'high'), (65, 'moderate')], 'low')} AS mi_class,
  CASE WHEN cognitive_complexity < 5 THEN 'LOW' WHEN cognitive_complexity <= 15 THEN 'MODERATE'
       WHEN cognitive_complexity <= 30 THEN 'HIGH' ELSE 'VERY HIGH' END AS complexity_rating,
  CASE WHEN cognitive_complexity < 5 THEN 'green' WHEN cognitive_complexity < 15 THEN 'amber' ELSE 'red' END
    AS cognitive_band,
  CASE WHEN sqale_debt_hours <= 2 THEN 'green' WHEN sqale_debt_hours <= 8 THEN 'amber' ELSE 'red' END AS debt_band,
  {debt_text('sqale_debt_hours')} AS debt_text,
  round(greatest(35.0, least(90.0, log2(complexity_score + 1) * 12.0)), 4) AS node_weight,
  regexp_extract(file_path, '[^/]*$') AS file_name,
  CASE WHEN len(CAST(doc_id AS VARCHAR)) >= 4 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 4, '0') END
    AS report_id
FROM cm""")

HEALTH = """
h AS (SELECT repo, count(*) AS files,
        coalesce(sum(CAST(round(maintainability_index * 100) AS BIGINT)) / count(*) / 100.0, 100.0) AS avg_mi,
        CAST(coalesce(sum(sqale_debt_hours), 0) AS DECIMAL(22,2)) AS total_debt_hours,
        coalesce(sum(cognitive_complexity) / count(*), 0.0) AS avg_cognitive,
        CAST(coalesce(sum(lines_of_code), 0) AS BIGINT) AS total_loc
      FROM cm GROUP BY repo)
"""

SQL["project_health"] = with_code(f""", {HEALTH}
SELECT repo, files, avg_mi, total_debt_hours, avg_cognitive, total_loc,
  CASE WHEN avg_mi >= 80 THEN 'green' WHEN avg_mi >= 50 THEN 'amber' ELSE 'red' END AS mi_band,
  {_band('avg_mi', [(85, 'Excellent'), (70, 'Good'), (50, 'Moderate'), (30, 'Poor')], 'Critical')} AS health_text,
  CASE WHEN total_debt_hours <= 2 THEN 'green' WHEN total_debt_hours <= 8 THEN 'amber' ELSE 'red' END AS debt_band,
  CASE WHEN avg_cognitive < 5 THEN 'green' WHEN avg_cognitive < 15 THEN 'amber' ELSE 'red' END AS cognitive_band,
  {debt_text('total_debt_hours')} AS debt_text,
  least(avg_mi / 100.0 * 100.0, 100.0) AS health_pct,
  least(least(CAST(total_debt_hours AS DOUBLE), 40.0) / 40.0 * 100.0, 100.0) AS debt_pct,
  least(least(avg_cognitive, 30.0) / 30.0 * 100.0, 100.0) AS cognitive_pct
FROM h""".replace("WITH \n,", "WITH"))

SQL["scan_summary"] = with_code(
    "SELECT repo, count(*) AS files_scanned, CAST(coalesce(sum(complexity_score), 0) AS BIGINT) AS total_complexity "
    "FROM cm GROUP BY repo")

SQL["insight"] = with_code(f""", {HEALTH}
SELECT repo, CAST(round(avg_mi, 0) AS INTEGER) AS healthy_pct, {debt_text('total_debt_hours')} AS remediation
FROM h WHERE files > 0 AND total_debt_hours > 0""")

SQL["top_complex"] = with_code(
    "SELECT file_path, complexity_score, cognitive_complexity, maintainability_index FROM cm "
    "ORDER BY complexity_score DESC, file_path ASC LIMIT 10")

SQL["list_metrics"] = with_code("SELECT file_path, complexity_score, node_count FROM cm")

SQL["triage"] = with_code(
    "SELECT file_path, maintainability_index, cognitive_complexity FROM cm "
    "WHERE NOT (maintainability_index >= 85 AND cognitive_complexity < 5) AND doc_id % 37 <> 0")

SQL["folder_rollup"] = with_code("""
, fo AS (SELECT f.folder, cm.* FROM cm,
        LATERAL (SELECT array_to_string(list_slice(string_split(cm.file_path, '/'), 1, i), '/') AS folder
                 FROM range(1, len(string_split(cm.file_path, '/'))) t(i)) f)
SELECT repo, CASE WHEN folder = '' THEN '/' ELSE folder END AS folder, count(*) AS files,
  coalesce(sum(CAST(round(maintainability_index * 100) AS BIGINT)) / count(*) / 100.0, 100.0) AS avg_mi,
  CAST(coalesce(sum(sqale_debt_hours), 0) AS DECIMAL(22,2)) AS total_debt_hours,
  coalesce(sum(cognitive_complexity) / count(*), 0.0) AS avg_cognitive,
  CAST(coalesce(sum(lines_of_code), 0) AS BIGINT) AS total_loc
FROM fo GROUP BY ALL""")

SQL["rank_issues"] = with_code(f""", {LABEL_ISSUES},
ri AS (SELECT *, split_part(file_path, '/', 3) AS repo FROM im),
rr AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY severity_rank, maintainability_index, file_path, issue)
         AS issue_rank FROM ri)
SELECT * FROM rr WHERE issue_rank <= 5""")

SQL["severity_counts"] = with_code(f""", {LABEL_ISSUES}
SELECT split_part(file_path, '/', 3) AS repo,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
  count(*) FILTER (WHERE severity = 'low') AS low,
  count(*) FILTER (WHERE severity NOT IN ('high', 'medium', 'low') OR severity IS NULL) AS other
FROM im GROUP BY 1""")

SQL["issues_per_file"] = with_code(f""", {LABEL_ISSUES}
SELECT cm.file_path, CAST(count(li.file_path) AS BIGINT) AS issues FROM cm LEFT JOIN li USING (file_path)
GROUP BY cm.file_path""")

SQL["diagnosis_summary"] = with_code(f""", {LABEL_ISSUES}
SELECT (SELECT count(*) FROM documents) AS total_files, (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id)) AS files_with_issues""")

SQL["issue_navigation"] = with_code(f""", {LABEL_ISSUES}
SELECT * FROM li WHERE file_path IN (SELECT file_path FROM cm WHERE doc_id % 37 <> 0)""")

SQL["parse_bug_scan"] = with_code(f""", {RESPONSES},
iss AS (SELECT file_path,
    CASE WHEN kind = 'obj' THEN CASE WHEN json_exists(j, '$.issue') THEN j->>'issue' ELSE 'Potential issue detected' END
         ELSE CASE WHEN length(response) > 0 THEN substr(response, 1, 150) ELSE 'Analysis inconclusive' END END AS issue,
    CASE WHEN kind = 'obj' THEN CASE WHEN json_exists(j, '$.severity') THEN j->>'severity' ELSE 'medium' END ELSE 'medium' END AS severity
  FROM rq
  WHERE (kind = 'obj' AND (conv_id % 9 IN (0, 2, 6, 7, 8) OR (conv_id % 9 = 1 AND turn % 4 = 1)))  -- truth by shape
     OR (kind = 'bad' AND (contains(lower(response), 'bug') OR contains(lower(response), 'error'))))
SELECT iss.file_path, regexp_extract(iss.file_path, '[^/]*$') AS file_name, issue, severity, {SEV_RANK} AS severity_rank,
  cm.cognitive_complexity, cm.maintainability_index
FROM iss JOIN cm USING (file_path) WHERE issue IS NOT NULL AND severity IS NOT NULL""")

SQL["parse_diagnosis"] = with_code(f""", {RESPONSES}
SELECT file_path,
  CASE WHEN kind = 'bad' OR conv_id % 9 = 6 THEN true ELSE false END AS is_healthy,
  CASE WHEN kind = 'bad' THEN 'Code analyzed - no critical issues found'
       WHEN kind = 'obj' THEN CASE WHEN conv_id % 9 IN (7, 8) THEN 'Analysis failed: invalid answer'
         ELSE coalesce(j->>'issue', 'Analysis complete') END
       ELSE 'Analysis failed: ' || chr(39) || CASE json_type(j) WHEN 'ARRAY' THEN 'list' WHEN 'BIGINT' THEN 'int'
         WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool'
         ELSE 'NoneType' END || chr(39) || ' object has no attribute ' || chr(39) || 'get' || chr(39) END AS issue,
  CASE WHEN kind = 'bad' THEN 'none' WHEN kind = 'obj' AND conv_id % 9 NOT IN (7, 8) THEN coalesce(j->>'severity', 'low')
       ELSE 'medium' END AS severity,
  CAST(CASE WHEN kind = 'bad' THEN CASE WHEN length(response) > 0 THEN 1 ELSE 0 END WHEN conv_id % 9 = 6 THEN 2 ELSE 0 END AS INTEGER) AS n_suggestions,
  CASE WHEN kind = 'bad' THEN CASE WHEN length(response) > 0 THEN substr(response, 1, 200) END
       WHEN conv_id % 9 = 6 THEN 'a' END AS first_suggestion
FROM rq""")

SQL["clean_code"] = f"""
WITH f AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '```python' || {NL} || text || {NL} || '```'
                  ELSE '  ```' || {NL} || text || '  ' END AS raw FROM conversations),
s AS (SELECT *, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS t FROM f),
u AS (SELECT *, regexp_replace(regexp_replace(t, '^```(?:python)?', ''), '```$', '') AS t2 FROM s)
SELECT conv_id, turn, regexp_replace(t2, '^{WS}+|{WS}+$', '', 'g') AS code FROM u"""

SQL["issue_type"] = f"""WITH {FIX.strip()[:FIX.strip().index('fa AS')].rstrip().rstrip(',')}
SELECT request_id, {ISSUE_TYPE} AS issue_type, {ISSUE_TYPE} IN ('typo', 'docs', 'style') AS simple FROM fr"""

SQL["requests"] = with_code("""
SELECT file_path, regexp_extract(file_path, '[^/]*$') AS file_name, 'describe' AS task, substr(content, 1, 2000) AS content_head, NULL AS code,
  CAST(length(content) AS INTEGER) AS content_chars, 'text' AS answer_keys FROM cm
UNION ALL SELECT file_path, regexp_extract(file_path, '[^/]*$'), 'diagnose', NULL, content, CAST(length(content) AS INTEGER),
  'is_healthy,issue,severity,suggestions' FROM cm
UNION ALL SELECT file_path, regexp_extract(file_path, '[^/]*$'), 'bug_scan', NULL, content, CAST(length(content) AS INTEGER),
  'has_bug,issue,severity' FROM cm WHERE NOT (maintainability_index >= 85 AND cognitive_complexity < 5) AND doc_id % 37 <> 0""")

SQL["report"] = with_code(f"""
SELECT file_path, regexp_extract(file_path, '[^/]*$') AS file_name,
  CASE WHEN len(CAST(doc_id AS VARCHAR)) >= 4 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 4, '0') END AS report_id,
  CAST(TIMESTAMP '2024-01-01' + to_hours(doc_id) AS DATE) AS scan_date,
  {_band('maintainability_index', [(65, 'NOMINAL'), (40, 'DEGRADED')], 'CRITICAL')} AS status,
  CASE WHEN cognitive_complexity < 5 THEN 'LOW' WHEN cognitive_complexity <= 15 THEN 'MODERATE'
       WHEN cognitive_complexity <= 30 THEN 'HIGH' ELSE 'VERY HIGH' END AS complexity_rating,
  CAST(CAST(round(maintainability_index) AS INTEGER) AS VARCHAR) AS maintainability, cognitive_complexity,
  format('{{:,}}', lines_of_code) AS lines_of_code, CAST(CAST(round(halstead_volume) AS BIGINT) AS VARCHAR) AS volume,
  CAST(CAST(round(sqale_debt_hours, 1) AS DECIMAL(12,1)) AS VARCHAR) AS debt_hours, coalesce(description, '') AS description FROM cm""")

SQL["instruction"] = f"""
SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'user' THEN regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') ELSE '' END, ''),
  nullif(CASE WHEN turn % 3 = 0 THEN 'Division by zero' ELSE '' END, ''), 'Fix any issues in this file') AS instruction
FROM conversations"""

SQL["run_verdict"] = f"WITH {FIX.strip()}\nSELECT request_id, attempt, passed FROM fp"

SQL["attempt_fold"] = f"""WITH {FIX.strip()}
SELECT request_id, reproduced, CAST(winning_attempt AS INTEGER) AS winning_attempt, winning_code,
  CAST(last_attempt AS INTEGER) AS last_attempt, last_output, fix_attempts FROM ff"""

SQL["fix_outcomes"] = f"""WITH {FIX.strip()},
x AS (SELECT fr.request_id, fr.file_path, fr.verifier_available, {ISSUE_TYPE} AS issue_type, fs.readable,
        fs.file_path IS NOT NULL AS ex, ff.reproduced, ff.winning_attempt, ff.winning_code, ff.first_code, ff.last_output,
        ff.repro_script, ff.test_output, ff.last_code
      FROM fr LEFT JOIN fs USING (file_path) LEFT JOIN ff USING (request_id)),
y AS (SELECT *, issue_type IN ('typo', 'docs', 'style') AS simple, coalesce(reproduced, false) AS rep,
        winning_attempt IS NOT NULL AS won FROM x),
z AS (SELECT *, ex AND readable AND NOT simple AND verifier_available AND rep AS ran FROM y)
SELECT request_id, file_path, issue_type,
  CASE WHEN NOT ex THEN 'failed' WHEN NOT readable THEN 'failed' WHEN simple THEN 'success'
       WHEN NOT verifier_available THEN 'failed' WHEN NOT rep THEN 'failed' WHEN won THEN 'success'
       ELSE 'failed' END AS status,
  CASE WHEN NOT ex THEN 'File not found: ' || file_path WHEN NOT readable THEN 'Could not read file'
       WHEN simple THEN NULL
       WHEN NOT verifier_available THEN 'Docker sandbox is not available (required for behavioral bug verification)'
       WHEN NOT rep THEN 'Could not reproduce bug - test passes on original code' WHEN won THEN NULL
       ELSE 'Could not fix after 3 attempts' END AS reason,
  CAST(CASE WHEN ex AND readable AND simple THEN 1 WHEN ran AND won THEN winning_attempt END AS INTEGER) AS attempts,
  CASE WHEN ex AND readable AND simple THEN 'skipped (simple issue)' WHEN ran THEN 'verified' END AS verification,
  CASE WHEN ran AND NOT won THEN last_output END AS last_error,
  CASE WHEN ex AND readable AND simple THEN first_code WHEN ran AND won THEN winning_code END AS fixed_code,
  CASE WHEN ex AND readable AND NOT simple AND verifier_available THEN repro_script END AS repro_script,
  CASE WHEN ex AND readable AND NOT simple AND verifier_available AND NOT rep THEN test_output END AS test_output,
  CASE WHEN ran AND NOT won THEN last_code END AS last_attempt
FROM z"""

PREVIOUS = f"""
pv AS (SELECT {CODE_PATH} AS file_path, 0 AS snapshot_id,
         CASE WHEN toxic = 1 THEN 'Description unavailable (AI skipped)'
              WHEN quality = 1 THEN 'Cached summary ' || CAST(doc_id AS VARCHAR) ELSE '' END AS description
       FROM labels JOIN documents USING (doc_id)),
cache AS (SELECT file_path, arg_max(description, snapshot_id) AS cached_description FROM pv
          WHERE description IS NOT NULL AND description <> '' AND NOT starts_with(description, 'Description unavailable')
          GROUP BY file_path),
gen AS (SELECT {CODE_PATH} AS file_path, 'Handles ' || t AS description
        FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id) g
        JOIN documents ON conv_id = doc_id)
"""

SQL["description_cache"] = f"WITH {PREVIOUS.strip()}\nSELECT * FROM cache"

SQL["describe"] = with_code(f""", {PREVIOUS.strip()},
r AS (SELECT cm.file_path, cm.description AS d, cache.cached_description AS c, gen.description AS g,
        NOT regexp_matches(cm.content, '[^ \\t\\n\\r\\f\\x0B]') AS blank, length(regexp_replace(cm.description, '^{WS}+|{WS}+$', '', 'g')) > 10 AS usable
      FROM cm LEFT JOIN cache USING (file_path) LEFT JOIN gen USING (file_path))
SELECT file_path,
  CASE WHEN coalesce(usable, false) THEN d WHEN c IS NOT NULL THEN c WHEN blank THEN d WHEN g IS NOT NULL THEN g
       ELSE 'Description unavailable (AI skipped)' END AS description,
  CASE WHEN coalesce(usable, false) THEN 'docstring' WHEN c IS NOT NULL THEN 'cache' WHEN blank THEN 'blank'
       WHEN g IS NOT NULL THEN 'generated' ELSE 'unavailable' END AS description_source
FROM r""")

SQL["describe_missing"] = with_code(f""", {PREVIOUS.strip()}
SELECT file_path FROM cm WHERE NOT coalesce(length(regexp_replace(description, '^{WS}+|{WS}+$', '', 'g')) > 10, false)
  AND file_path NOT IN (SELECT file_path FROM cache)""")

SQL["calibration"] = """
SELECT count(*) AS files, count(*) FILTER (WHERE doc_id % 43 <> 0) AS passed_files, coalesce(bool_and(doc_id % 43 <> 0), true) AS all_passed
FROM documents"""

SQL["lines"] = with_docs(f"""
SELECT file_path, CAST(i AS INTEGER) AS line_no, string_split(content, {NL})[i] AS line
FROM dc, range(1, len(string_split(content, {NL})) + 1) t(i)""")

SQL["path_uniqueness"] = with_docs(
    "SELECT file_path, CAST(2 AS BIGINT) AS copies FROM dc WHERE doc_id % 41 = 0")

NODES = """
pn AS (SELECT array_to_string(list_slice(p, 1, i), '/') AS path,
         CASE WHEN i > 1 THEN array_to_string(list_slice(p, 1, i - 1), '/') END AS parent_path,
         p[i] AS name, CAST(i - 1 AS INTEGER) AS depth, CASE WHEN i = len(p) THEN 'file' ELSE 'folder' END AS type
       FROM (SELECT string_split(file_path, '/') AS p FROM SRC) s, range(1, len(p) + 1) t(i)),
nodes AS (SELECT path, any_value(parent_path) AS parent_path, any_value(name) AS name, any_value(depth) AS depth,
            min(type) AS type FROM pn GROUP BY path)
"""

SQL["path_nodes"] = with_docs("," + NODES.replace("SRC", "sd") + "SELECT * FROM nodes")

SQL["common_prefix"] = with_docs("""
, mm AS (SELECT min(file_path) AS lo, max(file_path) AS hi FROM sd),
k AS (SELECT lo, coalesce((SELECT max(i) FROM range(0, least(length(lo), length(hi)) + 1) t(i)
                  WHERE substr(lo, 1, i) = substr(hi, 1, i)), 0) AS n FROM mm),
p AS (SELECT coalesce(substr(lo, 1, n), '') AS p FROM k)
SELECT CASE WHEN ends_with(p, '/') THEN substr(p, 1, length(p) - 1) ELSE p END AS common_prefix FROM p""")

SQL["common_dir"] = with_docs("""
, mm AS (SELECT min(d) AS lo, max(d) AS hi FROM (SELECT list_slice(string_split(file_path, '/'), 1,
          len(string_split(file_path, '/')) - 1) AS d FROM sd)),
k AS (SELECT lo, coalesce((SELECT max(i) FROM range(0, least(len(lo), len(hi)) + 1) t(i)
                  WHERE list_slice(lo, 1, i) = list_slice(hi, 1, i)), 0) AS n FROM mm)
SELECT array_to_string(list_slice(lo, 1, n), '/') AS common_dir, CAST(n AS INTEGER) AS common_depth FROM k""")

ROOT_NAMES = """
, mm AS (SELECT min(file_path) AS lo, max(file_path) AS hi FROM sd),
k AS (SELECT lo, coalesce((SELECT max(i) FROM range(0, least(length(lo), length(hi)) + 1) t(i)
                  WHERE substr(lo, 1, i) = substr(hi, 1, i)), 0) AS n FROM mm),
p AS (SELECT coalesce(substr(lo, 1, n), '') AS p FROM k),
cp AS (SELECT CASE WHEN ends_with(p, '/') THEN substr(p, 1, length(p) - 1) ELSE p END AS common_prefix FROM p),
rn AS (SELECT common_prefix, coalesce(nullif(string_split(common_prefix, '/')[-1], ''), 'Project') AS scanned_name,
  coalesce(CASE WHEN len(string_split(common_prefix, '/')) >= 2 THEN nullif(string_split(common_prefix, '/')[-2], '') END,
           'Root') AS parent_name FROM cp)
"""

SQL["root_names"] = with_docs(ROOT_NAMES + "SELECT * FROM rn")

SQL["path_edges"] = with_docs(ROOT_NAMES + """,
rel AS (SELECT list_filter(string_split(substr(file_path, length((SELECT common_prefix FROM rn)) + 1), '/'),
                           lambda s: s <> '') AS r FROM sd),
e AS (SELECT array_to_string(list_slice(r, 1, i - 1), '/') AS parent_path,
             array_to_string(list_slice(r, 1, i), '/') AS child_path, r[i] AS child_name,
             CASE WHEN i = len(r) THEN 'file' ELSE 'folder' END AS child_type
      FROM rel, range(1, len(r) + 1) t(i) WHERE len(r) > 0)
SELECT parent_path, child_path, any_value(child_name) AS child_name, min(child_type) AS child_type FROM e
GROUP BY parent_path, child_path
UNION ALL SELECT '..', '', scanned_name, 'folder' FROM rn""")

SQL["sibling_order"] = with_docs("," + NODES.replace("SRC", "sd") + """
SELECT path, parent_path, CAST(row_number() OVER (PARTITION BY parent_path ORDER BY CASE WHEN type = 'folder' THEN 0
  ELSE 1 END, name COLLATE en, name) AS INTEGER) AS sibling_rank FROM nodes""")

SQL["list_children"] = with_docs("," + NODES.replace("SRC", "dc") + """
SELECT name, path, type = 'folder' AS is_dir, '/srv/src0/en' AS current_path, '/srv/src0' AS parent_path
FROM nodes WHERE parent_path = '/srv/src0/en' AND NOT starts_with(name, '.')
  AND name NOT IN ('node_modules', '__pycache__', 'venv', '.venv', 'env')""")

SQL["folder_counts"] = with_docs("," + NODES.replace("SRC", "dc") + """
SELECT parent_path, count(*) FILTER (WHERE type = 'folder') AS folder_count,
  count(*) FILTER (WHERE type = 'file') AS file_count FROM nodes WHERE parent_path IS NOT NULL AND NOT starts_with(name, '.')
  AND name NOT IN ('node_modules', '__pycache__', 'venv', '.venv', 'env') GROUP BY parent_path""")

SQL["diff_lines"] = f"""
WITH p AS (SELECT doc_id AS file_path, string_split(text, {NL}) AS o,
                  string_split(replace(text, '###', '#') || CASE WHEN doc_id % 5 = 0 THEN {NL} || 'end' ELSE '' END, {NL}) AS f FROM documents),
z AS (SELECT file_path, i, o[i] AS original_line, f[i] AS fixed_line
      FROM p, range(1, greatest(len(o), len(f)) + 1) t(i))
SELECT file_path, CAST(i AS INTEGER) AS line_no, original_line, fixed_line, original_line IS DISTINCT FROM fixed_line AS changed FROM z"""

SQL["content_lookup"] = with_docs("""
, rq AS (SELECT '/srv/' || source || '/' || lang || '/' ||
    CASE WHEN doc_id % 13 = 0 THEN 'venv/' WHEN doc_id % 17 = 0 THEN '.git/' WHEN doc_id % 19 = 0 THEN 'pkg/sub/'
    ELSE '' END || 'm' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.py' END AS file_path
    FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT '/missing/b' || CAST(item_id AS VARCHAR) || '.py' FROM benchmark)
SELECT rq.file_path, regexp_extract(rq.file_path, '[^/]*$') AS file_name, dc.doc_id IS NOT NULL AS found,
  CASE WHEN dc.doc_id IS NULL THEN '# File not found' WHEN dc.doc_id % 23 = 0 THEN '# Error reading file: unreadable' ELSE dc.content END AS content
FROM rq LEFT JOIN dc USING (file_path)""")

SQL["patch_names"] = with_docs("""
, n AS (SELECT file_path, regexp_extract(file_path, '[^/]*$') AS nm FROM sd),
s AS (SELECT *, regexp_extract(nm, '^.+(\\.[^.]+)$', 1) AS suf FROM n)
SELECT file_path, substr(nm, 1, length(nm) - length(suf)) || '_fixed' || CASE WHEN suf = '' THEN '.py' ELSE suf END
  AS fixed_name FROM s""")

SQL["upsert_latest"] = f"""WITH {EVENTS.strip()}
SELECT file_path, last_analyzed, seq, sqale_debt_hours FROM ev
QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY last_analyzed DESC, seq DESC,
  CASE WHEN event_type = 'view' THEN 0 ELSE 1 END DESC) = 1"""

SQL["debt_trend"] = f"""WITH {EVENTS.strip()}
SELECT file_path, seq, sqale_debt_hours,
  lag(sqale_debt_hours) OVER w AS previous_value,
  sqale_debt_hours - lag(sqale_debt_hours) OVER w AS delta,
  sum(sqale_debt_hours) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_value
FROM ev WINDOW w AS (PARTITION BY file_path ORDER BY last_analyzed, seq)"""

SQL["markup_nodes"] = f"""WITH RECURSIVE {TREE.strip()}
SELECT page_id, seq, node_type, around[-1] AS parent_type, text FROM nodes"""

SQL["node_depth_markup"] = f"""WITH RECURSIVE {TREE.strip()}
SELECT page_id, seq AS pos, node_type AS tag, len(around) AS depth FROM nodes WHERE node_type <> '#text'"""

SQL["nesting_cost_markup"] = f"""WITH RECURSIVE {TREE.strip()}
SELECT page_id, count(*) AS control_nodes,
  CAST(sum(1 + len(list_filter(around, lambda t: t IN ('div', 'ul', 'nav', 'article', 'li')))) AS BIGINT) AS nesting_cost
FROM nodes WHERE node_type IN ('div', 'ul', 'nav', 'article') GROUP BY page_id"""

SQL["markup_stats"] = f"""WITH RECURSIVE {TREE.strip()}
SELECT page_id, CAST(count(node_type) AS INTEGER) AS node_count, CAST(coalesce(max(len(around)), 0) AS INTEGER) AS max_depth,
  CAST(coalesce(sum(len(around)), 0) AS BIGINT) AS total_depth
FROM pages LEFT JOIN (SELECT * FROM nodes WHERE node_type <> '#text') USING (page_id) GROUP BY page_id"""

SQL["node_metrics_markup"] = f"""WITH RECURSIVE {TREE.strip()},
w AS (
  SELECT page_id, node_type, text, CASE node_type WHEN 'p' THEN 3 WHEN 'li' THEN 1 WHEN 'div' THEN 2 END AS control,
    len(list_filter(range(1, len(around) + 1), lambda k: around[k] IN ('ul', 'li', 'article', 'p', 'body') AND coalesce(around[k - 1], '') <> 'html')) AS depth
  FROM nodes),
m AS (
  SELECT page_id, count(*) AS node_count, CAST(count(control) AS INTEGER) AS complexity_score,
    CAST(coalesce(sum(control * (1 + depth)), 0) AS BIGINT) AS cognitive_complexity,
    count(*) FILTER (WHERE node_type IN ('a', 'b', 'br')) AS operators_total,
    count(DISTINCT node_type) FILTER (WHERE node_type IN ('a', 'b', 'br')) AS operators_unique,
    count(*) FILTER (WHERE node_type = '#text') AS operands_total, count(DISTINCT text) FILTER (WHERE node_type = '#text') AS operands_unique
  FROM w GROUP BY page_id)
SELECT *, CASE WHEN operators_unique + operands_unique = 0 THEN 0.0
    ELSE round((operators_total + operands_total) * log2(operators_unique + operands_unique), 2) END AS halstead_volume,
  CAST(round(cognitive_complexity * 0.15, 2) AS DECIMAL(12,2)) AS sqale_debt_hours FROM m"""

SQL["node_metrics_code"] = with_code("""
SELECT repo, file_path, complexity_score, CAST(cognitive_complexity AS BIGINT) AS cognitive_complexity, CAST(n1_total AS BIGINT) AS operators_total,
  CAST(n1_unique AS BIGINT) AS operators_unique, CAST(n2_total AS BIGINT) AS operands_total, CAST(n2_unique AS BIGINT) AS operands_unique,
  halstead_volume, sqale_debt_hours, lines_of_code, maintainability_index FROM cm""")

SQL["replace_snapshot"] = SQL["file_metrics"]

SQL["patch_overlay"] = with_code(f"""
, fx AS (SELECT CASE WHEN toxic = 1 THEN '/gone/' || CAST(doc_id AS VARCHAR) || '.py' ELSE {CODE_PATH} END AS file_path,
           '# fixed' || {NL} || text AS new_code FROM labels JOIN documents USING (doc_id)),
j AS (SELECT coalesce(cm.file_path, fx.file_path) AS file_path, cm.file_path IS NOT NULL AS known, cm.content,
        fx.new_code FROM cm FULL OUTER JOIN fx USING (file_path))
SELECT file_path, CASE WHEN known THEN CAST(2 AS BIGINT) END AS snapshot_id,
  coalesce(new_code, content) AS content,
  CASE WHEN new_code IS NULL THEN NULL WHEN NOT known THEN 'File not found: ' || file_path
       ELSE 'Successfully updated ' || regexp_extract(file_path, '[^/]*$') END AS message,
  new_code IS NOT NULL AND known AS applied
FROM j""")

SQL["export_patched"] = SQL["patch_overlay"].replace("""
SELECT file_path, CASE WHEN known THEN CAST(2 AS BIGINT) END AS snapshot_id,""", """,
o AS (SELECT file_path, CASE WHEN known THEN CAST(2 AS BIGINT) END AS snapshot_id,""") + """)
SELECT file_path, regexp_replace(file_path, '[.]py$', '_fixed.py') AS written_as, sha256(content) AS content_sha256,
  strlen(content) AS length FROM o WHERE applied"""

SQL["scan_files"] = with_docs("SELECT file_path, doc_id % 11 <> 0 AS readable FROM sd")

SQL["stream_upsert"] = f"""WITH {EVENTS.strip()}
SELECT file_path, last_analyzed, seq, sqale_debt_hours FROM ev
QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY last_analyzed DESC, seq DESC) = 1"""

# Every tenth event comes one delivery of five days late; it counts while its hour ended less than an hour
# before the newest event of the deliveries before.
SQL["stream_debt_window"] = """WITH e AS (
  SELECT *, CAST(floor(epoch(ts) / 432000) AS BIGINT) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS arrival,
    date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end FROM events),
newest AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e GROUP BY arrival)
SELECT window_start, window_end, event_type, count(*) AS events, round(sum(value), 6) AS value_sum
FROM e JOIN newest USING (arrival) WHERE seen IS NULL OR window_end > seen - INTERVAL 1 HOUR
GROUP BY ALL"""
