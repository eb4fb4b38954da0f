"""Files -> units and captures. Python is parsed with its own grammar; files of
other languages, and Python that doesn't parse, are scanned for headers, bodies
and calls (scan.py). A file is one row's work."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import language
from .scan import scan

PARSED = "kind string, capture_name string, name string, file string, type string, line_start int, line_end int, signature string, docstring string, text string"


#: What a file may do to its parser, syntax errors apart: too deep nesting ends in
#: one of the last two.
FAULTS = (SyntaxError, ValueError, RecursionError, MemoryError)


def _warning(file: str, text: str) -> tuple:
    return "warning", None, None, file, None, None, None, None, None, text


def parse_python(file: str, content: str):
    """Rows of a Python file; one that the grammar rejects, or that is nested too
    deeply for it, is scanned instead, with a warning."""
    try:
        rows = list(_python_rows(file, content))
    except FAULTS as e:
        kind = "syntax error" if isinstance(e, (SyntaxError, ValueError)) else "nested too deeply"
        rows = [_warning(file, f"{kind}: {e.msg if isinstance(e, SyntaxError) else e}"), *scan(file, content, "python")]
    yield from rows


def callee(node: ast.expr, content: str) -> str:
    """The text of what is called: a chain of names is put together from its end."""
    names, at = [], node
    while isinstance(at, ast.Attribute):
        names.append(at.attr)
        at = at.value
    if isinstance(at, ast.Name):
        return ".".join([at.id, *reversed(names)])
    try:
        return ast.unparse(node)
    except RecursionError:
        return ast.get_source_segment(content, node) or ""


def _python_rows(file: str, content: str):
    tree = ast.parse(content)
    lines = content.split("\n")
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            has_method = is_class and any(isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) for x in ast.walk(node))
            if has_method:
                continue  # a class with methods is present through them
            sig = None if is_class else lines[node.lineno - 1].strip() or None
            yield "unit", "class.def" if is_class else "function.def", node.name, file, "class" if is_class else "function", node.lineno, node.end_lineno, sig, ast.get_docstring(node, clean=False), None
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            yield "capture", "import", None, file, None, node.lineno, node.lineno, None, None, ast.get_source_segment(content, node)
        elif isinstance(node, ast.Call):
            yield "capture", "call", None, file, None, node.lineno, node.lineno, None, None, callee(node.func, content)


def parse_file(file: str, content: str, lang: str | None):
    if lang is None:
        yield _warning(file, "no parser")
        return
    stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    yield "unit", "module", stem, file, "module", 1, content.count("\n") + 1, None, None, None
    try:
        rows = list(parse_python(file, content) if lang == "python" else scan(file, content, lang))
    except FAULTS as e:  # one file must not end a build
        rows = [_warning(file, f"not read: {type(e).__name__}")]
    yield from rows


def parse(files: DataFrame) -> DataFrame:
    """PARSED rows (units, captures, warnings) of file, content."""

    def run(batches):
        for pdf in batches:
            rows = [r for f, c, lang in zip(pdf["file"], pdf["content"], pdf["lang"]) for r in parse_file(f, c or "", lang)]
            out = pd.DataFrame(rows, columns=["kind", "capture_name", "name", "file", "type", "line_start", "line_end", "signature", "docstring", "text"])
            yield out.astype({"line_start": "Int32", "line_end": "Int32"})

    return files.select("file", "content", language(F.col("file")).alias("lang")).mapInPandas(run, PARSED)


def units_of(parsed: DataFrame) -> DataFrame:
    from ..functions.text import unit_hash, unit_id
    from ..operators.linking import dedupe_units

    u = parsed.filter("kind = 'unit'").select(unit_id("file", "name").alias("id"), "name", "file", "type", "line_start", "line_end", "signature", "docstring", unit_hash("name", "line_start", "line_end").alias("hash"))
    return dedupe_units(u)


def captures_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'capture'").select("capture_name", "text", "file", F.col("line_start").alias("line"))
