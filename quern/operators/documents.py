"""Structure of Markdown texts: sections, tables, fenced code and its symbols. Rows out, one batch of texts at a time."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Headings, fences, table rules, and the patterns of code symbols by kind.
HEADING = re.compile(r"^(#{1,6})\s+(.+)$|^([一二三四五六七八九十]+)[、．.]\s*(.+)$|^(\d+)[.)]\s+(.+)$", re.MULTILINE)
FENCE = re.compile(r"```(\w*)[^\n]*\n(.*?)```", re.DOTALL)
TABLE_RULE = re.compile(r"[|\s\-:]+")
SYMBOLS = (
    ("IMPORT", r"import\s+\{[^}]+\}\s+from\s+['\"]([^'\"]+)['\"]"), ("IMPORT", r"import\s+(\w+)\s+from\s+['\"]"), ("IMPORT", r"require\(['\"]([^'\"]+)['\"]\)"), ("IMPORT", r"from\s+(\S+)\s+import\s+"),
    ("CLASS", r"class\s+(\w+)"), ("CLASS", r"@Component\s*(?:\n|.)*?struct\s+(\w+)"), ("FUNCTION", r"(?:async\s+)?function\s+(\w+)\s*\("), ("FUNCTION", r"(?:public|private|protected|static)?\s*(\w+)\s*\([^)]*\)\s*\{"),
    ("FUNCTION", r"def\s+(\w+)\s*\("), ("INTERFACE", r"interface\s+(\w+)"), ("TYPE", r"type\s+(\w+)\s*="), ("METHOD_CALL", r"(\w+\.\w+)\s*\("), ("METHOD_CALL", r"new\s+(\w+)\s*\("),
)


def rows_of(docs: DataFrame, find: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """(chunk_id and what find returns) for each text of docs (chunk_id, content)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(k, *row) for k, text in zip(frame.chunk_id, frame.content, strict=True) for row in find(text or "")], columns=["chunk_id", *names])

    return docs.select("chunk_id", "content").mapInPandas(run, f"chunk_id {dict(docs.dtypes)['chunk_id']}, {schema}")


def find_sections(text: str) -> list[tuple[int, str, int]]:
    """(level, title, offset): Markdown headings by their level; numbered ones are of level 2."""
    found = []
    for m in HEADING.finditer(text):
        mark, title, numeral, after, number, rest = m.groups()
        found.append((len(mark), title.strip(), m.start()) if mark else (2, (f"{numeral}、{after}" if numeral else f"{number}. {rest}").strip(), m.start()))
    return found


def find_tables(text: str) -> list[tuple[int, int]]:
    """(first line, rows) of pipe tables: a line with a bar, a rule, and the lines with bars that follow."""
    lines, found, i = text.split("\n"), [], 0
    while i + 1 < len(lines):
        if "|" not in lines[i] or not TABLE_RULE.fullmatch(lines[i + 1]):
            i += 1
            continue
        end = i + 2
        while end < len(lines) and "|" in lines[end]:
            end += 1
        found.append((i, end - i - 2))
        i = end
    return found


def find_code(text: str) -> list[tuple[str, int, int, str]]:
    """(language, first line, last line, code) of fenced blocks."""
    return [(m[1].lower() or "text", text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.end()) + 1, m[2]) for m in FENCE.finditer(text)]


def python_symbols(code: str) -> list[tuple[str, str, float]]:
    found: list[tuple[str, str, float]] = []
    for node in ast.walk(ast.parse(code)):
        match node:
            case ast.Import(names=names):
                found += [(a.name, "IMPORT", 1.0) for a in names]
            case ast.ImportFrom(module=str(module)):
                found.append((module, "IMPORT", 1.0))
            case ast.ClassDef(name=name):
                found.append((name, "CLASS", 1.0))
            case ast.FunctionDef(name=name):
                found.append((name, "FUNCTION", 1.0))
            case ast.Call(func=ast.Name(id=name)):
                found.append((name, "METHOD_CALL", 0.9))
    return found


def find_symbols(text: str) -> list[tuple[str, str, float]]:
    """(name, kind, confidence) in a text's fenced code: by the parser for Python, by patterns otherwise, each once."""
    found: dict[tuple[str, str], tuple[str, str, float]] = {}
    for language, _, _, code in find_code(text):
        try:
            symbols = python_symbols(code) if language in ("python", "py") else None
        except SyntaxError:
            symbols = []
        if symbols is None:
            symbols = [(m[1].strip(), kind, 0.7) for kind, rule in SYMBOLS for m in re.finditer(rule, code, re.MULTILINE) if len(m[1].strip()) >= 2]
        for name, kind, sure in symbols:
            found.setdefault((name.lower(), kind), (name, kind, sure))
    return list(found.values())


def sections(docs: DataFrame) -> DataFrame:
    return rows_of(docs, find_sections, "level int, title string, pos int")


def pipe_tables(docs: DataFrame) -> DataFrame:
    return rows_of(docs, find_tables, "start int, n_rows int")


def code_blocks(docs: DataFrame) -> DataFrame:
    return rows_of(docs, find_code, "language string, first_line int, last_line int, code string")


def code_symbols(docs: DataFrame) -> DataFrame:
    return rows_of(docs, find_symbols, "name string, kind string, confidence double")
