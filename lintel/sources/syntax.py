"""Node tables of Python sources, for the exact form of the metrics over ``nodes``.

Python's own grammar (``ast``) gives statements, blocks and operators with their
extents, its tokenizer the operands, those inside f-string braces included. One file
is parsed at a time inside a task; no shuffle. What the text front end
(``functions.tokens``, ``functions.structure``) estimates without a parser can be
checked against these nodes.

Node types are the names of ``lintel.rules``. A ``block`` is the body of a
statement or clause. Elements that no rule names (calls, arguments, ...) have no node.

``seq`` is the order in which nodes are found. Of nodes with the same extent the outer
one is found first, so that depths need no search for how they nest.

Defined results: a blank or null file is a ``module`` node alone; a file that the
grammar of the running Python doesn't accept is one ``ERROR`` node; offsets count characters.
"""

from __future__ import annotations

import ast
import io
import keyword
import tokenize
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

_STATEMENT = {
    ast.For: "for_statement", ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.With: "with_statement", ast.AsyncWith: "with_statement",
    ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition",
}
_CONSTANT = {"True": "true", "False": "false", "None": "none"}
_FSTRING = (getattr(tokenize, "FSTRING_START", -1), getattr(tokenize, "FSTRING_END", -1))
_OPENING = (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.COMMENT, tokenize.ENCODING)


class _Tree:
    """Nodes of one file: (start, end, type, parent type, text)."""

    def __init__(self, source: str):
        self.source, self.lines, self.out = source, source.split("\n"), []
        self.begin = [0]
        for line in self.lines:
            self.begin.append(self.begin[-1] + len(line) + 1)
        self.heads: set[tuple[int, int]] = set()  # lines and columns of soft keywords, column -1 for any

    def at(self, row: int, byte: int) -> int:
        line = self.lines[row - 1]
        return self.begin[row - 1] + (byte if line.isascii() else len(line.encode()[:byte].decode()))

    def extent(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def add(self, extent: tuple[int, int], kind: str, parent: str) -> str:
        self.out.append((*extent, kind, parent, None))
        return kind

    def body(self, statements: list[ast.stmt], parent: str) -> None:
        """A block and what it holds."""
        start = min(self.extent(x)[0] for x in [statements[0], *getattr(statements[0], "decorator_list", [])])
        self.add((start, self.extent(statements[-1])[1]), "block", parent)
        for s in statements:
            self.visit(s, "block")

    def clause(self, statements: list[ast.stmt], kind: str, parent: str) -> None:
        if statements:
            self.add((self.extent(statements[0])[0], self.extent(statements[-1])[1]), kind, parent)
            self.body(statements, kind)

    def parts(self, node: ast.AST, parent: str, leave: tuple[str, ...] = ()) -> None:
        for name, value in ast.iter_fields(node):
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, ast.AST) and name not in leave:
                    self.visit(x, parent)

    def branches(self, node: ast.If, kind: str, parent: str) -> None:
        """An if with its elif and else clauses as its children."""
        own = self.add(self.extent(node), kind, parent)
        self.visit(node.test, own)
        self.body(node.body, own)
        rest = node.orelse
        while len(rest) == 1 and isinstance(rest[0], ast.If) and self.source.startswith("elif", self.extent(rest[0])[0]):
            branch = rest[0]
            self.add((self.extent(branch)[0], self.extent(branch.body[-1])[1]), "elif_clause", own)
            self.visit(branch.test, "elif_clause")
            self.body(branch.body, "elif_clause")
            rest = branch.orelse
        self.clause(rest, "else_clause", own)

    def visit(self, node: ast.AST, parent: str) -> None:
        if isinstance(node, ast.If):
            self.branches(node, "if_statement", parent)
        elif type(node) in _STATEMENT:
            own = self.add(self.extent(node), _STATEMENT[type(node)], parent)
            self.parts(node, own, ("body", "orelse"))
            self.body(node.body, own)
            self.clause(getattr(node, "orelse", []), "else_clause", own)
        elif isinstance(node, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            own = self.add(self.extent(node), "try_statement", parent)
            self.body(node.body, own)
            for h in node.handlers:
                self.add(self.extent(h), "except_clause", own)
                if h.type:
                    self.visit(h.type, "except_clause")
                self.body(h.body, "except_clause")
            self.clause(node.orelse, "else_clause", own)
            self.clause(node.finalbody, "finally_clause", own)
        elif isinstance(node, ast.Match):
            own = self.add(self.extent(node), "match_statement", parent)
            self.heads.add((node.lineno, node.col_offset))
            self.visit(node.subject, own)
            first, last = self.at(node.cases[0].pattern.lineno, node.cases[0].pattern.col_offset), self.extent(node.cases[-1].body[-1])[1]
            self.add((first, last), "block", own)
            for c in node.cases:
                self.heads.add((c.pattern.lineno, -1))
                self.add((self.at(c.pattern.lineno, c.pattern.col_offset), self.extent(c.body[-1])[1]), "case_clause", "block")
                self.parts(c, "case_clause", ("body",))
                self.body(c.body, "case_clause")
        else:
            parent = self.operator(node, parent)
            if type(node).__name__ == "TypeAlias":
                self.heads.add((node.lineno, node.col_offset))
            self.parts(node, parent)

    def operator(self, node: ast.AST, parent: str) -> str:
        if isinstance(node, ast.BinOp):
            return self.add(self.extent(node), "binary_operator", parent)
        if isinstance(node, ast.UnaryOp):
            return self.add(self.extent(node), "not_operator" if isinstance(node.op, ast.Not) else "unary_operator", parent)
        if isinstance(node, ast.Compare):
            return self.add(self.extent(node), "comparison_operator", parent)
        if isinstance(node, ast.BoolOp):  # a and b and c nests to the left
            for value in reversed(node.values[1:]):
                parent = self.add((self.extent(node)[0], self.extent(value)[1]), "boolean_operator", parent)
        if isinstance(node, ast.Assign):  # a = b = c nests to the right
            for target in node.targets:
                parent = self.add((self.extent(target)[0], self.extent(node)[1]), "assignment", parent)
        if isinstance(node, ast.AnnAssign):
            return self.add(self.extent(node), "assignment", parent)
        if isinstance(node, ast.AugAssign):
            return self.add(self.extent(node), "augmented_assignment", parent)
        return parent

    def operands(self) -> None:
        """Names, numbers, strings and constants; an f-string as a whole, and what stands in its braces."""
        before, said, strings = tokenize.NEWLINE, "", []
        for t in tokenize.generate_tokens(io.StringIO(self.source).readline):
            start, end = self.begin[t.start[0] - 1] + t.start[1], self.begin[t.end[0] - 1] + t.end[1]
            kind = None
            if t.type == tokenize.NAME:
                byte = len(t.line[:t.start[1]].encode())
                head = t.string in ("match", "type") and (t.start[0], byte) in self.heads or t.string == "case" and before in _OPENING and (t.start[0], -1) in self.heads
                named = not (keyword.iskeyword(t.string) or head or (strings and said == "!"))  # not the r of {x!r}
                kind = _CONSTANT.get(t.string) or ("identifier" if named else None)
            elif t.type == tokenize.NUMBER:
                low = t.string.lower()
                kind = "float" if not low.startswith("0x") and any(c in low for c in ".ej") else "integer"
            elif t.type == tokenize.STRING:
                kind = "string"
            elif t.type == _FSTRING[0]:
                strings.append(start)
            elif t.type == _FSTRING[1]:
                start, kind = strings.pop(), "string"
            if kind:
                self.out.append((start, end, kind, "expression", self.source[start:end]))
            before, said = t.type, t.string


def source_nodes(source: str | None) -> list[tuple]:
    source = source or ""
    tree = _Tree(source)
    tree.out.append((0, len(source), "module", None, None))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for statement in ast.parse(source).body:
                tree.visit(statement, "module")
        tree.operands()
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError):
        return [(0, len(source), "ERROR", None, None)]
    return tree.out


def python_nodes(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``(keep..., start, end, node_type, parent_type, text, seq)`` of every file."""
    schema = StructType([*(files.schema[c] for c in keep), StructField("start", LongType()), StructField("end", LongType()),
                         StructField("node_type", StringType()), StructField("parent_type", StringType()), StructField("text", StringType()), StructField("seq", LongType())])
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = source_nodes(batch.column(len(keep))[row].as_py())
                for i in range(0, len(found), 50_000):
                    some = list(zip(*found[i:i + 50_000]))
                    same = [pa.repeat(batch.column(k)[row], len(some[0])) for k in range(len(keep))]
                    rest = [*(pa.array(c, t) for c, t in zip(some, types)), pa.array(range(i, i + len(some[0])), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*same, *rest], names=schema.names)

    return files.select(*keep, content).mapInArrow(run, schema)
