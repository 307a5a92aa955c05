"""Problem 5: source files that are not valid in the language of their suffix.

Method: a file is parsed in the language of its suffix.  If that fails, it is parsed against all other
supported grammars, in the order of a ranking by token counts: a successful foreign parse identifies a wrong
suffix, failure everywhere identifies corruption (which is then told apart as conflict marks, a cut end, a
foreign wrapping or other damage).

Python, JSON and TOML are parsed by the parsers of the standard library, JavaScript and TypeScript by the
recogniser in ``ecmascript``.  One map over the rows; only the few columns of the verdicts are shuffled.

Defined cases: null and blank contents and suffixes without a grammar are never invalid and count in no rate.
Nesting has no limit in JSON, TOML, JavaScript and TypeScript; Python that Python's own parser gives up on because of
its depth is invalid, as no Python 3 reads it.  Redelivered rows are reported once.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import tomllib
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ecmascript
from .common import rows_by_batch

LANGUAGES = {"py": "python", "ts": "typescript", "js": "javascript", "json": "json", "toml": "toml"}


def language(path: str | None) -> str | None:
    """Language of the suffix of ``path`` in any case, None if there is no grammar for it."""
    name = re.split(r"[\\/]", path or "")[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def _python(text: str) -> int | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<file>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except SyntaxError as e:
        return e.lineno or 1
    except (ValueError, RecursionError, MemoryError):
        return 1
    return None


def deeply(parse, text: str):
    """``parse(text)`` with room for its nesting: frames of Python code lie on the heap, some for each level."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 40 * len(text) + 10_000))
    try:
        return parse(text)
    finally:
        sys.setrecursionlimit(before)


_JSON_TOKEN = re.compile(
    r"""[ \t\n\r]*(?:(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<scalar>(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![\w.+\-]))|(?P<mark>[{}\[\],:]))"""
)
_AFTER = {"{": "key or end", "[": "value or end", ":": "value"}


def _json_of_any_depth(text: str) -> int | None:
    """Line of the first fault of strict JSON, None for none; a stack of open brackets instead of calls."""
    open_: list[str] = []
    want, at = "value", 0
    while m := _JSON_TOKEN.match(text, at):
        mark = m.group("mark")
        if mark in ("{", "[") and want.startswith("value"):
            open_.append(mark)
            want = _AFTER[mark]
        elif mark in ("}", "]") and open_ and open_[-1] == "{["[mark == "]"] and (want.endswith("or end")):
            open_.pop()
            want = "comma or end" if open_ else "nothing"
        elif mark == ":" and want == "colon":
            want = "value"
        elif mark == "," and want == "comma or end" and open_:
            want = "key" if open_[-1] == "{" else "value"
        elif m.group("string") and want.startswith("key"):
            want = "colon"
        elif mark is None and want.startswith("value"):
            want = "comma or end" if open_ else "nothing"
        else:
            return text.count("\n", 0, m.end()) + 1
        at = m.end()
    return None if want == "nothing" and not text[at:].strip(" \t\n\r") else text.count("\n", 0, at) + 1


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _json(text: str) -> int | None:
    try:
        json.loads(text, parse_constant=_no_constant)
    except json.JSONDecodeError as e:
        return e.lineno
    except ValueError:
        return 1
    except RecursionError:
        return _json_of_any_depth(text)
    return None


def _toml(text: str) -> int | None:
    try:
        try:
            tomllib.loads(text)
        except RecursionError:
            deeply(tomllib.loads, text)
    except tomllib.TOMLDecodeError as e:
        m = re.search(r"at line (\d+)", str(e))
        return int(m.group(1)) if m else text.count("\n") + 1
    return None


def _script(typescript: bool):
    def check(text: str) -> int | None:
        try:
            at = ecmascript.check(text, typescript)
        except RecursionError:
            at = deeply(lambda t: ecmascript.check(t, typescript), text)
        return None if at is None else text.count("\n", 0, at) + 1

    return check


#: Parser of each language: None for a valid text, else the line of the first error.
PARSERS = {"python": _python, "typescript": _script(True), "javascript": _script(False), "json": _json, "toml": _toml}

#: Tokens that speak for a language, by weight.
_SIGNS = {
    "python": re.compile(r"(?m)^\s*(?:def |class \w+.*:$|from \S+ import|import \w+$|elif |except |with .*:$|@\w+)|\bself\b|\bNone\b|:\s*$|^#"),
    "javascript": re.compile(r"(?m)\b(?:const|let|var|function|export|await|new)\b|=>|===|;\s*$|^\s*//|\{\s*$"),
    "typescript": re.compile(r"(?m)\b(?:interface|type|enum|readonly|private|public)\b|\w\??: ?(?:string|number|boolean|void|Array<|Map<|Record<|Promise<)|=>|;\s*$|^\s*//"),
    "json": re.compile(r'(?m)^\s*"[^"\n]*"\s*:|^\s*[\[{}\]],?\s*$'),
    "toml": re.compile(r"(?m)^\[\[?[\w.\-]+\]\]?\s*$|^[\w.\-]+\s*=\s*(?:[\"'\[\d]|true|false)"),
}
_CONFLICT = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?: .*)?\r?$")
_FENCE = re.compile(r"(?m)^\s*```")


def ranking(text: str) -> list[str]:
    """The languages by how much the tokens of ``text`` speak for them."""
    return sorted(PARSERS, key=lambda k: -sum(1 for _ in _SIGNS[k].finditer(text)))


def verdict(text: str | None, path: str | None) -> tuple[str, bool, str, str | None, int | None] | None:
    """(language, valid, reason, language it parses as, line of the first error); None if there is nothing to judge."""
    lang = language(path)
    if lang is None or text is None or not text.strip():
        return None
    line = PARSERS[lang](text)
    if line is None:
        return lang, True, "valid", lang, None
    foreign = next((other for other in ranking(text) if other != lang and PARSERS[other](text) is None), None)
    if foreign:
        return lang, False, "wrong suffix", foreign, line
    if _CONFLICT.search(text):
        return lang, False, "conflict marks", None, line
    if _FENCE.search(text):
        return lang, False, "wrapped", None, line
    return lang, False, "cut or damaged", None, line


FILES = "action_id bigint, workspace_root string, language string, valid boolean, reason string, parses_as string, error_line int"


def files(actions: DataFrame) -> DataFrame:
    """The verdict on every file with a grammar and a content."""

    def run(ids: list, roots: list, paths: list, texts: list) -> Iterator[tuple]:
        for i, root, path, text in zip(ids, roots, paths, texts):
            if (v := verdict(text, path)) is not None:
                yield i, root, *v

    source = actions.select(F.col("action_id").cast("bigint").alias("action_id"), F.col("workspace_root").cast("string").alias("workspace_root"), F.col("target_file").cast("string").alias("target_file"), F.col("updated_content").cast("string").alias("updated_content"))
    return rows_by_batch(source.where("updated_content is not null and target_file is not null"), FILES, run).dropDuplicates(["action_id"])


def found(actions: DataFrame) -> DataFrame:
    """Ids of the invalid files."""
    return files(actions).where("not valid").select("action_id")


def rates(actions: DataFrame) -> DataFrame:
    """Files, invalid files and their share for each workspace_root and language."""
    invalid = F.count_if(~F.col("valid"))
    return (
        files(actions)
        .groupBy("workspace_root", "language")
        .agg(F.count("*").alias("files"), invalid.alias("invalid"), F.round(invalid / F.count("*"), 6).alias("rate"), F.count_if(F.col("reason") == "wrong suffix").alias("wrong_suffix"))
    )
