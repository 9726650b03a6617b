"""Fixed rule sets and the rule table.

The sets below are FIXED VALUES: they must equal the reference's lists for
metrics to agree. They are stated once here, in natural order, and every
operator reads them from this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference for equal results)
# ---------------------------------------------------------------------------

# Directory names whose files are never scanned.
IGNORE_DIRS = (
    "venv", ".venv", "env", ".env", "__pycache__", ".git", ".hg", ".svn",
    "node_modules", ".tox", ".pytest_cache", ".mypy_cache", "dist", "build",
    "egg-info",
)

# Syntax-node types that add 1 + nesting depth to cognitive complexity.
CONTROL_FLOW_NODES = (
    "if_statement", "for_statement", "while_statement", "try_statement",
    "except_clause", "with_statement", "match_statement", "else_clause",
    "elif_clause",
)

# Syntax-node types counted as Halstead operators (unique by type).
OPERATOR_NODES = (
    "binary_operator", "unary_operator", "comparison_operator",
    "boolean_operator", "augmented_assignment", "assignment", "not_operator",
)

# Keywords meant to count as operators (off by default, see README D5).
OPERATOR_KEYWORDS = (
    "if", "else", "elif", "for", "while", "try", "except", "finally", "with",
    "return", "yield", "raise", "break", "continue", "pass", "import", "from",
    "as", "def", "class", "lambda", "and", "or", "not", "in", "is", "await",
    "async", "match", "case",
)

# Syntax-node types counted as Halstead operands (unique by text).
OPERAND_NODES = ("identifier", "integer", "float", "string", "true", "false", "none")

# Bodies of these nodes do not deepen nesting.
ENCAPSULATION_NODES = ("function_definition", "class_definition", "module")

# Remediation hours per cognitive point.
SQALE_HOURS_PER_POINT = "0.15"

# Directory listing hides these names (besides dot-names).
LISTING_HIDDEN = ("node_modules", "__pycache__", "venv", ".venv", "env")

# Issue types for fix requests; the simple ones skip verification.
ISSUE_TYPES = ("behavioral_bug", "typo", "docs", "style")
SIMPLE_ISSUE_TYPES = ("typo", "docs", "style")
MAX_FIX_ATTEMPTS = 3

# Severity sort order; unknown severities sort as medium.
SEVERITY_RANK = (("high", 0), ("medium", 1), ("low", 2))
UNKNOWN_SEVERITY_RANK = 1

# Description placeholders.
DESCRIPTION_UNAVAILABLE = "Description unavailable (AI skipped)"
DESCRIPTION_UNAVAILABLE_PREFIX = "Description unavailable"
FILE_NOT_FOUND_CONTENT = "# File not found"
UNREADABLE_CONTENT = "# Error reading file: unreadable"

# ---------------------------------------------------------------------------
# Python surface syntax used by the text front end (public language facts).
# ---------------------------------------------------------------------------

# Hard keywords of Python 3; True/False/None are operands, not keywords here.
PY_KEYWORDS = (
    "and", "as", "assert", "async", "await", "break", "class", "continue",
    "def", "del", "elif", "else", "except", "finally", "for", "from",
    "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or",
    "pass", "raise", "return", "try", "while", "with", "yield",
)
PY_CONSTANTS = ("True", "False", "None")

# Statement heads opening a block, and the node each one produces.
HEAD_NODE = (
    ("if", "if_statement"),
    ("elif", "elif_clause"),
    ("else", "else_clause"),
    ("for", "for_statement"),
    ("while", "while_statement"),
    ("try", "try_statement"),
    ("except", "except_clause"),
    ("finally", "finally_clause"),
    ("with", "with_statement"),
    ("match", "match_statement"),
    ("case", "case_clause"),
    ("def", "function_definition"),
    ("class", "class_definition"),
)

BINARY_OPS = ("+", "-", "*", "/", "//", "%", "**", "@", "|", "&", "^", "<<", ">>")
COMPARISON_OPS = ("==", "!=", "<", ">", "<=", ">=", "<>")
AUGMENTED_OPS = ("+=", "-=", "*=", "/=", "//=", "%=", "**=", "@=", "&=", "|=", "^=", ">>=", "<<=")


def control_heads() -> list[str]:
    """Statement heads whose node is a control-flow node."""
    return [k for k, n in HEAD_NODE if n in CONTROL_FLOW_NODES]


RULE_SCHEMA = T.StructType([
    T.StructField("node_type", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("weight", T.IntegerType(), False),
])


def default_rules(spark: SparkSession) -> DataFrame:
    """The fixed sets as a small rule table ``(node_type, role, weight)``.

    Roles as ``operators.nodes`` reads them: a ``block`` deepens nesting unless
    it is the body of an encapsulation node. The table has 20 rows.
    """
    rows = [(n, "control", 1) for n in CONTROL_FLOW_NODES]
    rows += [(n, "operator", 1) for n in OPERATOR_NODES]
    rows += [(n, "operand", 1) for n in OPERAND_NODES]
    rows += [("block", "nesting", 1)]
    rows += [(n, "encapsulation", 1) for n in ENCAPSULATION_NODES]
    return spark.createDataFrame(rows, RULE_SCHEMA)
