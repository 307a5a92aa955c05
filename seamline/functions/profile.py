"""Functions that need Python: syntax trees and encodings that the JVM functions lack, Arrow batch by batch."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

PROFILE = "line_count int, char_count int, imports array<string>, functions array<string>, classes array<string>, long_functions array<string>, broad_excepts array<string>, print_heavy array<string>, error_line int"


def _tree(text: str) -> ast.Module | int:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except SyntaxError as e:
        return e.lineno or 1
    except (ValueError, RecursionError, MemoryError):
        return 1


def _error_line(text: str | None) -> int | None:
    t = _tree(text or "")
    return t if isinstance(t, int) else None


def python_error_line(x: str | Column) -> Column:
    """Line of the first syntax error of a Python text, null for a valid one (an empty one is valid)."""

    @F.pandas_udf("int")
    def line(s: pd.Series) -> pd.Series:
        return s.map(_error_line).astype("Int32")

    return line(x)


def _structure(text: str | None) -> dict:
    t = text or ""
    out: dict = {"line_count": len(t.splitlines()), "char_count": len(t), "error_line": None} | {k: [] for k in ("imports", "functions", "classes", "long_functions", "broad_excepts", "print_heavy")}
    tree = _tree(t)
    if isinstance(tree, int):
        return out | {"error_line": tree}

    def look_at(node: ast.AST, name: str) -> None:
        out["functions"].append(name)
        length = (node.end_lineno or node.lineno) - node.lineno + 1
        inner = list(ast.walk(node))
        handlers = [h.type for h in inner if isinstance(h, ast.ExceptHandler)]
        prints = sum(isinstance(c, ast.Call) and isinstance(c.func, ast.Name) and c.func.id == "print" for c in inner)
        if length >= fixed.LONG_FUNCTION_LINES:
            out["long_functions"].append(f"{node.name}({length} lines)")
        if any(h is None or (isinstance(h, ast.Name) and h.id == "Exception") for h in handlers):
            out["broad_excepts"].append(node.name)
        if prints >= fixed.MANY_PRINTS:
            out["print_heavy"].append(f"{node.name}({prints} prints)")

    callables = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        match node:
            case ast.Import():
                out["imports"] += [a.name for a in node.names]
            case ast.ImportFrom():
                out["imports"].append(node.module or "(relative)")
            case ast.ClassDef():
                out["classes"].append(node.name)
                for child in node.body:
                    if isinstance(child, callables):
                        look_at(child, f"{node.name}.{child.name}")
            case _ if isinstance(node, callables):
                look_at(node, node.name)
    return out


def python_structure(x: str | Column) -> Column:
    """Structure of a Python text: names at the top level and in classes, and what to look at in its functions."""

    @F.pandas_udf(PROFILE)
    def structure(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_structure(t) for t in s], columns=[c.split()[0] for c in PROFILE.split(", ")]).astype({"error_line": "Int32"})

    return structure(x)


def split_line_count(x: str | Column) -> Column:
    """Lines by every line boundary that Unicode knows, as the JVM's split by a line feed does not count them."""
    t = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    parts = F.size(F.split(t, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1))
    return F.when(t == "", 0).when(t.rlike("[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]\\z"), parts - 1).otherwise(parts)


def decoded(x: str | Column) -> Column:
    """Bytes as text: UTF-8, else GBK, else UTF-8 without what is invalid; only the last two leave the JVM."""

    @F.pandas_udf("string")
    def other(s: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str:
            try:
                return (b or b"").decode("gbk")
            except UnicodeDecodeError:
                return (b or b"").decode("utf-8", "ignore")

        return s.map(one)

    c = F.col(x) if isinstance(x, str) else x
    as_text = c.cast("string")
    return F.when(c.isNull(), "").when(F.is_valid_utf8(as_text), as_text).otherwise(other(c))
