"""Problem 3: text cut off by field limits or in transfer.

Method: self-join by prefix.  Values are sorted; a value that is a strict prefix of a longer copy stands
directly before it, so one pass over the sorted values finds every such value without comparing pairs.  A
prefix alone does not tell a cut text from a short text that another one happens to begin with, and most cut
texts here have no longer copy at all.  So every value is first read to its end: by the grammar of its
language for code, by fences, tables, lists, quotation and sentence ends for prose.  The end is 'cut' (it
stands inside a word, sentence, statement or structure), 'open' (it may be complete) or complete; an open end
is a cut where the self-join finds the longer copy.  Every other value is a probe too: an end that reads as
complete, and a short open one, is a cut where the longer copy goes on inside its last word, sentence or statement.

Cost: one map over both tables for the ends, one shuffle of the texts for the sort, in which each task sends a text
once.  The sort is a sample sort of our own: boundaries come from a sample of bounded size, one part is one task, and
a text that is a probe itself is one row of the sort.

Defined cases: null, blank and placeholder texts are never cut.  Redelivered rows are reported once.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import md5
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import ecmascript
from .common import cut, rows_by_batch
from .p5_syntax import LANGUAGES, PARSERS, deeply, language

#: A mark that a transfer leaves after a cut.
MARK = re.compile(
    r"\s*(?:(?:…|\.{3})?\s*(?:\[(?:cut|snip|\+?more|truncated|cont(?:inued|\.)?|…|\.{3}|省略|截断|未完(?:待续)?|gekürzt|tronqué)\]|<(?:cut|snip|more|truncated)\s*/?>|\((?:cut|truncated|continued|未完(?:待续)?|以下省略)\))|…|\.{3})\s*\Z",
    re.I,
)
#: Answers that stand for nothing, and markup alone.
_NOTHING = re.compile(r"(?i)(?:\W*(?:n/?a|none|null|nil|nan|undefined|todo|tbd|无|（无）|暂无|没有|空|keine|aucun[e]?|ninguno|nenhum)?\W*|(?:\s*</?\w+>\s*)+)\Z")
_STOP = re.compile(r"(?:[.!?。！？;；:：~～)）\]】>》|`]|[\"”’»“」』*_])\s*\Z")
_SENTENCE = re.compile(r"[.!?。！？][\"”’»」』)）]*(?=\s|\Z|[一-鿿])")
_SUFFIXES = "py|ts|tsx|js|jsx|json|md|toml|ya?ml|txt|html?|css|sh|sql|rst|cfg|ini|csv|lock|env|log|vue|java|go|rs|cpp|c|h"
_PATH_ITEM = re.compile(rf"(?:[-*+]|\d+[.)])?\s*`?[\w.\-]*(?:/[\w.\-]+)*\.(?:{_SUFFIXES})`?\s*\Z")
#: Words that no sentence or heading ends with.
_NEVER_LAST = re.compile(
    r"(?i)(?:\b(?:the|an|of|and|or|to|into|for|with|from|its|that|which|is|are|was|were|be|if|when|der|die|das|und|oder|mit|für|von|dem|den|ein|eine|einen|im|zu|zur|zum|le|la|les|un|une|des|du|de|et|ou|pour|dans|avec|sur|el|los|las|y|en|para|por|os|da|do|em|que)|[把将在和与并从对为的])\s*\Z"
)
#: Ends that a short text does not have when it is complete: a path without a suffix or with half of one, a single
#: letter, a clause behind a comma, an object put in front of a verb that is missing.
_TORN = re.compile(rf"(?:^|\s)[\w.\-]*/(?:[\w.\-]*/)*(?![\w\-]+\.(?:{_SUFFIXES})\Z)[\w.\-]*\Z|\s[b-hj-z]\Z|[，,；;][^，,；;]*\Z|\A\s*[将把]\s*\S")
_FENCE = re.compile(r"(?m)^[ \t>]*(`{3,}|~{3,})[ \t]*([\w+#.\-]*)[^\n]*$")
_FENCE_LANGUAGE = {"python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "json": "json", "toml": "toml"}

CUT, OPEN, COMPLETE = "cut", "open", "complete"


# --- code --------------------------------------------------------------------------------------------------

_OPENERS = {"(": ")", "[": "]", "{": "}"}
_PY_TOKEN = re.compile(
    r"(?P<com>#[^\n]*)|(?P<triple>[rRbBuUfF]{0,2}(\"\"\"|'''))|(?P<str>[rRbBuUfF]{0,2}(?:\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'))|(?P<bad>[rRbBuUfF]{0,2}[\"'])|(?P<br>[()\[\]{}])"
)


def _triple_end(text: str, m: re.Match) -> int:
    """Offset of the quotes that end the string which ``m`` begins, or -1."""
    end = text.find(m.group(3), m.end())
    while end > 0 and text[end - 1] == "\\":
        end = text.find(m.group(3), end + 1)
    return end


def _python_state(text: str) -> tuple[str, list[str], str] | None:
    """Text with an unended string dropped, the brackets open at its end, and what was dropped; None if they don't match."""
    stack, pos = [], 0
    while m := _PY_TOKEN.search(text, pos):
        pos = m.end()
        if m.group("triple"):
            end = _triple_end(text, m)
            if end < 0:
                return text[: m.start()] + '""', stack, text[m.end() :]
            pos = end + 3
        elif m.group("bad"):
            if "\n" in text[m.start() :].rstrip("\r\n"):
                return None
            return text[: m.start()] + '""', stack, ""
        elif b := m.group("br"):
            if b in _OPENERS:
                stack.append(_OPENERS[b])
            elif not stack or stack.pop() != b:
                return None
    return text, stack, ""


def _parses(text: str) -> bool:
    return PARSERS["python"](text) is None


_TOP_LEVEL = re.compile(r"(?m)^(?=(?:def|class|async def|@|if|for|while|with|try|import|from)\b|[A-Za-z_]\w* *=)")
_STATEMENT = re.compile(r"(?m)^[ \t]*(?:return\b|def \w+\(|for \w+ in |if .*:\s*$|with .*:\s*$|try:\s*$|[a-z_]\w* = \w+[(.\[])")
_DANGLING = re.compile(
    r"[\s,=+\-*/%<>&|^~:.@\\]+\Z|\b(?:for|if|in|not|and|or|is|lambda|else|await|return|yield|from|import|as|with|while|def|class|except|raise|assert|del|global|nonlocal|elif)\s*\Z"
)
_FILLERS = ("", "0", "x", ": 0", "x in x", " x", " else 0")


def _stands_alone(line: str) -> bool:
    """Is the line a statement that is complete by itself?"""
    line = line.strip()
    return bool(re.match(r"return\b|[\w., ]+ = |[\w.]+\(.*\)$|raise\b|pass$|break$|continue$", line)) and _parses("def f():\n while 1:\n  " + line)


def _python_ends_open(text: str) -> bool:
    """Can ``text`` be made valid Python by what follows its end alone?

    All but the last statement of the module has to be valid already; the rest is tried with the last line
    and without it (unless that line is complete by itself), with the brackets closed, a filler for what is
    missing of an expression, and a body or a handler for a block that has none.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<file>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except IndentationError as e:
        if "unindent" in str(e) or "unexpected indent" in str(e):
            return False  # a complete line that stands wrong
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    split = _last_start(text)
    tail = text[split:]
    whole = tail.endswith("\n")
    lines = tail.rstrip("\r\n").split("\n")
    for keep in (lines,) if whole or _stands_alone(lines[-1]) else (lines, lines[:-1]):
        state = _python_state("\n".join(keep))
        if state is None:
            continue
        body, stack, dropped = state
        if dropped and _STATEMENT.search(dropped):
            continue  # code after a mark that was never ended: the damage is further up
        closers = "".join(reversed(stack))
        last = body.split("\n")[-1]
        indent = last[: len(last) - len(last.lstrip())]
        tails = ("", ":\n" + indent + " pass", "(): pass", "\n" + indent + "    pass", "\n" + indent + " pass")
        for base in dict.fromkeys((body, _DANGLING.sub("", body))):
            if any(_parses(base + filler + closers + end) for filler in _FILLERS for end in (tails if not filler else tails[:2])):
                return True
        for m in list(re.finditer(r"(?m)^([ \t]*)try:[ \t]*\r?$", body))[-2:]:
            handler = "\n" + m.group(1) + "except Exception:\n" + m.group(1) + "    pass"
            before = "\n".join(body.split("\n")[:-1])
            if any(_parses(t + handler) for t in (body + closers, body + closers + "\n" + indent + "    pass", before)):
                return True
    return False


def _last_start(text: str) -> int:
    """Where the last top-level statement that only valid ones stand before begins; 0 if that is the first.

    One pass over the tokens drops what looks like a statement inside of a string or a bracket; what is valid up
    to one statement is valid up to all before it, so the last of them is found by halving.
    """
    stop = len(text.rstrip())
    outside, depth, pos = [], 0, 0
    marks = [m.start() for m in _TOP_LEVEL.finditer(text) if m.start() < stop]
    k = 0
    while m := _PY_TOKEN.search(text, pos):
        while k < len(marks) and marks[k] <= m.start():
            if not depth:
                outside.append(marks[k])
            k += 1
        pos = m.end()
        if m.group("triple"):
            end = _triple_end(text, m)
            pos = len(text) if end < 0 else end + 3
        elif m.group("bad"):
            pos = (text.find("\n", pos) + 1) or len(text)
        elif b := m.group("br"):
            depth = depth + 1 if b in _OPENERS else max(0, depth - 1)
        while k < len(marks) and marks[k] < pos:
            k += 1  # inside of a string or a comment
    if not depth:
        outside += marks[k:]
    # a decorated definition begins at its first decorator, a continued line at the line before
    starts = [o for before, o in zip([None, *outside], outside) if o and not (before is not None and text[before] == "@") and not re.search(r"\\\r?\n\Z", text[max(0, o - 3) : o])]
    if not starts or _parses(text[: starts[-1]]):
        return starts[-1] if starts else 0
    low, high = 0, len(starts) - 1  # of the first ``low`` all are valid, ``high`` is not
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if _parses(text[: starts[mid]]) else (low, mid)
    return starts[low - 1] if low else 0


def _last_word_is_torn(text: str) -> bool:
    """Does ``text`` end in a name that it has nowhere else while it has longer names that begin so?

    A plural or a further word behind it make no torn name of a whole one.
    """
    m = re.search(r"[A-Za-z_]\w*\Z", text)
    if not m or text.endswith("\n"):
        return False
    word = re.escape(m.group())
    return not re.search(rf"\b{word}\b", text[: m.start()]) and bool(re.search(rf"\b{word}(?!s(?:\b|_|[A-Z]))[a-z0-9]", text[: m.start()]))


def _python_valid_but_cut(text: str) -> bool:
    """Valid Python that ends in the middle of a statement: a torn name, or a bare name as the last statement."""
    if text.endswith("\n"):
        return False
    last = text.split("\n")[-1]
    if _last_word_is_torn(text):
        return True
    m = re.fullmatch(r"\s+([A-Za-z_][\w.]*)", last)
    return bool(m) and m.group(1) not in ("pass", "break", "continue", "return", "raise") and not last.strip().startswith(("return ", "yield"))


_JSON_TOKEN = re.compile(r"\s*(?:(?P<str>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.+\-])|(?P<lit>true|false|null)\b|(?P<op>[{}\[\],:]))")


def _json_ends_open(text: str) -> bool:
    """Is ``text`` a proper beginning of some JSON text?"""
    stack: list[str] = []
    want, pos = "value", 0
    while True:
        m = _JSON_TOKEN.match(text, pos)
        if m is None:
            rest = text[pos:].strip()
            return bool(stack or want == "value") and (not rest or bool(re.fullmatch(r"\"(?:[^\"\\\x00-\x1f]|\\.)*\\?(?:u[0-9a-fA-F]*)?|-?\d*\.?\d*[eE]?[+-]?\d*|t|tr|tru|f|fa|fal|fals|n|nu|nul|true|false|null", rest)) and bool(rest and (rest[0] != '"' or want in ("value", "key", "key or end", "value or end")) or not rest))
        pos = m.end()
        kind = m.lastgroup
        if kind == "op":
            o = m.group("op")
            if o in "{[" and want.startswith("value"):
                stack.append(o)
                want = "key or end" if o == "{" else "value or end"
            elif o == "}" and stack and stack[-1] == "{" and want in ("key or end", "comma or end"):
                stack.pop()
                want = "comma or end"
            elif o == "]" and stack and stack[-1] == "[" and want in ("value or end", "comma or end"):
                stack.pop()
                want = "comma or end"
            elif o == ":" and want == "colon":
                want = "value"
            elif o == "," and want == "comma or end" and stack:
                want = "key" if stack[-1] == "{" else "value"
            else:
                return False
        elif want.startswith("key"):
            if kind != "str":
                return False
            want = "colon"
        elif want.startswith("value"):
            want = "comma or end"
        else:
            return False


def _toml_ends_open(text: str) -> bool:
    def ok(t: str) -> bool:
        return PARSERS["toml"](t) is None

    if not text.endswith("\n"):
        kept = text.rsplit("\n", 1)[0] + "\n" if "\n" in text else ""
        if ok(kept):
            return True
        text = kept
    return any(ok(text.rstrip().rstrip(",") + tail) for tail in ("]", '"]', '"""', "'''", "}"))


def code_end(text: str, lang: str) -> str | None:
    """How code in ``lang`` ends; None if it is not code of that language at all."""
    valid = PARSERS[lang](text) is None
    if valid:
        if lang == "python" and _python_valid_but_cut(text):
            return CUT
        if lang in ("javascript", "typescript") and not text.endswith(("\n", "}", ";", ")", "]")) and _last_word_is_torn(text):
            return CUT
        if lang == "toml" and not text.endswith("\n") and re.fullmatch(r"[\w.\-]+\s*=\s*\d+", text.rsplit("\n", 1)[-1]):
            return OPEN
        return COMPLETE
    lines = text.rstrip().split("\n")
    if text.rstrip().endswith("```"):
        return COMPLETE
    if lang == "python":
        return CUT if _python_ends_open(text) else None
    if lang == "toml":
        return CUT if _toml_ends_open(text) else None
    if re.match(r"[}\])]", lines[-1]) and (text.endswith("\n") or re.fullmatch(r"[}\])]+[;,]?\s*", lines[-1])):
        return None  # the outermost structure was ended: what is wrong stands further up
    if lang == "json":
        return CUT if _json_ends_open(text) else None
    try:
        opened = ecmascript.ends_open(text, lang == "typescript")
    except RecursionError:
        opened = deeply(lambda t: ecmascript.ends_open(t, lang == "typescript"), text)
    return CUT if opened else None


# --- prose -------------------------------------------------------------------------------------------------

_PAIRS = (("“", "”"), ("«", "»"), ("（", "）"), ("【", "】"), ("《", "》"), ("「", "」"), ("(", ")"), ("[", "]"))


def _unpaired(paragraph: str) -> bool:
    if paragraph.count("`") % 2 or paragraph.count("**") % 2:
        return True
    if "„" in paragraph:  # German quotation ends with the mark that opens an English one
        return paragraph.count("„") > paragraph.count("“") + paragraph.count("”")
    return any(paragraph.rfind(a) > paragraph.rfind(b) and paragraph.count(a) > paragraph.count(b) for a, b in _PAIRS)


def prose_end(text: str, marked: bool = False) -> str:
    """How prose, with fenced code, tables, lists and tags in it, ends."""
    if _NOTHING.match(text):
        return COMPLETE
    fences = list(_FENCE.finditer(text))
    opened = None
    for f in fences:
        if opened is None:
            opened = f
        elif f.group(1)[0] == opened.group(1)[0] and not f.group(2):
            opened = None
    if opened is not None:
        return CUT
    if re.search(r"(?:^|\n)`{1,2}\Z", text):
        return CUT
    stripped = text.rstrip()
    last = stripped.rsplit("\n", 1)[-1]
    if fences and fences[-1].end() >= len(stripped):
        return COMPLETE
    tags = re.findall(r"<(/?)([a-z_]+)>", text)
    if tags:
        level: dict[str, int] = {}
        for slash, name in tags:
            level[name] = level.get(name, 0) + (-1 if slash else 1)
        if any(v > 0 for v in level.values()) or re.search(r"<(?:/?[a-z_]*)?\Z", stripped):
            return CUT
        if stripped.endswith(">"):
            return COMPLETE
    if stripped.lstrip().startswith(("{", "[")) and '"' in stripped:
        try:
            for line in stripped.split("\n"):
                json.loads(line)
            return COMPLETE
        except ValueError:
            if _json_ends_open(last) and not re.search(r"[.。!?]\Z", last):
                return CUT
    if last.lstrip().startswith("|"):
        return COMPLETE if last.endswith("|") else CUT
    paragraph = re.split(r"\n\s*\n", stripped)[-1]
    if _unpaired(paragraph):
        return CUT
    if re.match(r"\s*#{1,6}\s+\S", last) and "\n" in stripped:
        return COMPLETE if text.endswith("\n") or not marked else OPEN
    if _PATH_ITEM.match(last.strip()):
        return COMPLETE
    if re.match(r"\s*(?:[-*+]|\d+[.)])\s*[\w.\-]*(?:/[\w.\-]*)+\Z", last):
        return CUT
    if re.search(r"(?:^|\s)(?:[\w.\-]*/)+[\w\-]*\.\Z", stripped):
        return CUT  # a path that lost its suffix, not a sentence end
    if re.search(r"/[\w\-]+\.\Z", stripped) and not re.search(rf"\.(?:{_SUFFIXES})\.\Z", stripped):
        return CUT
    if _STOP.search(stripped):
        return COMPLETE
    if re.fullmatch(r"\s*(?:[-*+]|\d+[.)])\s*", last):
        return CUT
    sentences = len(_SENTENCE.findall(stripped))
    latin, han = len(re.findall(r"[A-Za-zÀ-ÿ]{2,}", stripped)), len(re.findall(r"[一-鿿]", stripped))
    unfinished = latin >= 6 or han >= 8 or bool(_NEVER_LAST.search(stripped) or _TORN.search(stripped))
    if text != text.rstrip("\n") or text != text.lstrip():
        return OPEN
    if sentences or "\n" in stripped or unfinished:
        return CUT
    return OPEN


def end_of(text: str | None, lang: str | None = None, suffix: str | None = None) -> tuple[str, str, bool]:
    """(how ``text`` ends, the text without a mark of the cut, whether there is such a mark)."""
    if text is None or not text.strip() or _NOTHING.match(text):
        return COMPLETE, text or "", False
    m = MARK.search(text)
    base, marked = (text[: m.start()], True) if m else (text, False)
    if marked and not base.strip():
        return COMPLETE, text, False
    if lang:
        if marked and PARSERS[lang](text) is None:
            return COMPLETE, text, False
        how = code_end(base, lang)
        if how is None:  # not of this language: an answer with the file in it, or a damaged file
            how = CUT if marked else prose_end(base) if _FENCE.search(base) and not base.endswith("\n") else COMPLETE
        if marked and how != CUT:
            how = CUT
        return how, base, marked
    how = prose_end(base, marked)
    if marked:
        how = CUT if how != COMPLETE or not _STOP.search(base) or re.search(r"[\w一-鿿]\s*\Z", base) or m.group().strip()[-1:] in "])>" else COMPLETE
    return how, base, marked


# --- what a longer copy shows ------------------------------------------------------------------------------

#: The languages a value can be read in, as bits: prose first.
MODES = {None: 1, **{name: 2 << k for k, name in enumerate(PARSERS)}}
_ENDED = re.compile(r"(?:[.!?。！？…])[\"”’»“」』)）】\]*_`]*\Z")
_ITEM_MARK = re.compile(r"(?:^|\n)[ \t]*(?:[-*+]|\d+[.)])[ \t]*\Z")
#: Short answers that are whole by themselves and begin longer texts and words by chance.
_ANSWER = re.compile(r"(?i)\W*(?:[\d.,:/%+\-]+|yes|no|yep|nope|ok|okay|done|true|false|ja|nein|doch|fertig|oui|non|si|sí|fait|sim|não|hecho|是|否|对|好|不|可以|不是|不行|完成)\W*\Z")
#: A number and what it counts: whole as well, unless it goes on inside the word.
_COUNT = re.compile(r"\s*[\d.,]+\s*[^\W\d_]+\s*\Z")
_LINE_REST = re.compile(r"[ \t\r]*([^\n]?)")
_NEXT_LINE = re.compile(r"(?:[ \t\r]*(?:#[^\n]*)?\n)*([ \t]*)([^\s\w]+|\w*)")
_NEXT_TOKEN = re.compile(r"\s*([^\s\w]+|\w*)")
#: A block of Python goes on with these in its own indent; new members of a class may have been added to a whole one.
_PY_GOES_ON = {"else", "elif", "except", "finally"}
_PY_MEMBER = {"def", "class", "async", "@"}
_SCRIPT_GOES_ON = re.compile(r"(?:else|catch|finally|instanceof|as|satisfies)\Z|[.?,:=&|*%<>^)\]]|[+\-](?![+\-])")


def _word(c: str) -> bool:
    return (c.isalnum() or c == "_") and not "一" <= c <= "鿿"


def goes_on_inside(base: str, value: str, mode: int) -> bool:
    """Does ``value``, which begins with ``base``, go on inside the last word, sentence or statement of ``base``?"""
    n = len(base)
    if n >= len(value) or MARK.match(value, n):
        return False
    tail = base[-400:]
    if n <= 400 and (not tail.strip() or _NOTHING.match(tail) or _ANSWER.match(tail)):
        return False
    before, after = base[-1], value[n]
    if _word(before) and _word(after):
        return True
    if n <= 400 and _COUNT.match(tail):
        return False
    rest = _LINE_REST.match(value, n).group(1)
    if mode == MODES[None]:
        if before == "\n":
            return False
        if _ITEM_MARK.search(tail):
            return True
        shown = tail.rstrip()
        if _ENDED.search(shown):
            return before == "." and after.isascii() and _word(after) and _word(base[-2:-1])  # inside a path, name or number
        if shown.endswith(("```", "~~~")) or (shown.endswith(">") and rest == "<"):
            return False
        return bool(rest) and (len(base) >= LEAST_PROBE or _STOP.search(shown) is not None or rest not in ",;:.!?，；：。！？–—-")
    if before != "\n" and rest:
        if mode == MODES["python"]:
            return rest not in "#;" and not tail.rstrip().endswith(";")
        if mode == MODES["toml"]:
            return rest != "#"
        if mode == MODES["json"]:
            return rest not in "{["
        if value.startswith(("//", "/*"), value.index(rest, n)) or rest in ";}":
            return False
        return not tail.rstrip().endswith((";", "}")) or bool(_SCRIPT_GOES_ON.match(_NEXT_TOKEN.match(value, n).group(1)))
    if mode == MODES["python"]:
        m = _NEXT_LINE.match(value, n)
        token = m.group(2)
        if not token or token.startswith("#"):
            return False
        if token in _PY_GOES_ON:
            return True
        return bool(m.group(1)) and token not in _PY_MEMBER
    if mode in (MODES["javascript"], MODES["typescript"]):
        token = _NEXT_TOKEN.match(value, n).group(1)
        return bool(token) and not tail.rstrip().endswith(";") and bool(_SCRIPT_GOES_ON.match(token)) and not token.startswith("*/")
    return False


# --- the operator ------------------------------------------------------------------------------------------

ENDS = "record_type string, record_id bigint, source string, how string, marked boolean, base string"


def ends(responses: DataFrame, actions: DataFrame) -> DataFrame:
    """Every value with a cut or open end, or a mark behind a complete one."""

    def run(kinds: list, ids: list, sources: list, paths: list, texts: list) -> Iterator[tuple]:
        for kind, i, source, path, text in zip(kinds, ids, sources, paths, texts):
            how, base, marked = end_of(text, language(path) if kind == "action" else None)
            # a text that is complete and has a mark is a probe without it; the others are probes as they are
            if how != COMPLETE or marked:
                yield kind, i, source, how, marked, base

    # each table by itself, so that both scans keep their parts
    return rows_by_batch(_answers(responses), ENDS, run).unionAll(rows_by_batch(_files(actions), ENDS, run))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _answers(responses: DataFrame) -> DataFrame:
    return responses.select(F.lit("response").alias("record_type"), F.col("response_id").cast("bigint").alias("record_id"), _text("source").alias("source"), F.lit(None).cast("string").alias("path"), _text("content").alias("value")).where("value is not null")


def _files(actions: DataFrame) -> DataFrame:
    return actions.select(F.lit("action").alias("record_type"), F.col("action_id").cast("bigint").alias("record_id"), _text("source").alias("source"), _text("target_file").alias("path"), _text("updated_content").alias("value")).where("value is not null")


def _values(responses: DataFrame, actions: DataFrame) -> DataFrame:
    return _answers(responses).unionAll(_files(actions))


def _mode() -> Column:
    """The bit in ``MODES`` of a value's language, by ``record_type`` and ``path`` as in ``ends``."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    mode = F.lit(MODES[None])
    for name, lang in LANGUAGES.items():
        mode = F.when((F.col("record_type") == "action") & (suffix == name), MODES[lang]).otherwise(mode)
    return mode


#: Bytes of text that one part of the sort is meant to hold, and the most parts; beyond these, parts grow with the data.
PARTITION_BYTES, MOST_PARTS = 8 << 20, 32_768
#: Distinct texts sampled for each boundary, and the characters of each that are read (fewer where there are many).
SAMPLED, BOUNDARY_CHARS = 4, 2048
#: An open end shorter than this is not decided by any longer text, as short answers begin many, but by how it goes on.
LEAST_PROBE = 20


def own_key(group: Column | int, value: str, mode: Column) -> Column:
    """The key that ``prefixes`` gives a text that is a probe itself."""
    return F.format_string("%d=%s/%d", F.lit(group) if isinstance(group, int) else group, F.md5(value), mode)


def probe_key(group: Column | int, base: str, mode: Column) -> Column:
    """The key that ``prefixes`` gives a probe."""
    return F.format_string("%d~%s/%d", F.lit(group) if isinstance(group, int) else group, F.md5(base), mode)


def _boundaries(texts: DataFrame) -> list[tuple[int, str]]:
    """Boundaries of parts of about equal numbers of bytes, each no longer than it has to be to part its neighbours.

    The sample is drawn by the hash of a text, so copies count once, and only its bounded beginnings come to the driver.
    """
    sizes = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes")).first()
    n = int(max(1, min(MOST_PARTS, (sizes["bytes"] or 0) // PARTITION_BYTES)))
    if n == 1:
        return []
    every, chars = max(1, sizes["n"] // (SAMPLED * max(n, 256))), BOUNDARY_CHARS if n <= 4096 else BOUNDARY_CHARS // 4
    drawn = texts.where(F.pmod(F.xxhash64("value"), F.lit(every)) == 0).select("group", F.substring("value", 1, chars).alias("v")).distinct().limit(4 * SAMPLED * max(n, 256))
    ordered = sorted((r["group"], r["v"]) for r in drawn.collect())
    out = []
    for k in range(1, n):
        at = len(ordered) * k // n
        if 0 < at:
            (g, a), (h, b) = ordered[at - 1], ordered[at]
            common = 0
            while g == h and common < min(len(a), len(b)) and a[common] == b[common]:
                common += 1
            out.append((h, b[: common + 1]))
    return sorted(set(out))


def prefixes(probes: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``key`` of each probe (base, mode, group) that is a strict prefix of one of ``texts`` (value, mode, group).

    What follows the base there must be more than a mark of a cut.  A probe with a ``mode`` other than 0 is found
    only if a longer text goes on inside its last word, sentence or statement (``goes_on_inside``).  A text with a
    ``mode`` (bits of ``MODES``) is such a probe itself, in each of its modes.  Texts of different groups don't meet.
    Keys are those of ``own_key`` and ``probe_key``, one a distinct text.

    One shuffle: each task drops the texts it has sent before, so a text that many rows hold goes to its part once a
    task; parts are cut by boundaries from a bounded sample and each is one task.  A probe goes to all parts whose
    boundaries begin with it, so it meets all texts that do.  In a part the texts are sorted, and one pass keeps the
    probes that the text at hand begins with on a stack.
    """
    bounds = _boundaries(texts)
    n = len(bounds) + 1
    placed = _parse_datatype_string("part int, group int, value string, key boolean, mode int")
    placed_arrow = to_arrow_schema(placed)

    def place(own: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: dict[bytes, int] = {}
            for batch in batches:
                rows = []
                for value, mode, group in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    digest = md5(f"{group}\n{value}".encode("utf-8", "surrogatepass")).digest()
                    before = sent.get(digest)
                    if before is not None and (mode | before == before if own else mode == before):
                        continue
                    sent[digest] = (before or 0) | mode if own else mode
                    first = bisect_right(bounds, (group, value))
                    last = bisect_right(bounds, (group, value + "\U0010ffff")) if mode or not own else first
                    rows.append((first, group, value, None if own else False, mode))
                    # a text goes to further parts only as the probe that it is
                    rows += [(p, group, value, own, mode) for p in range(first + 1, last + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), placed_arrow)], schema=placed_arrow)

        return run

    columns = ("mode", "group")
    values = texts.select("value", *[F.col(c).cast("int").alias(c) for c in columns]).mapInArrow(place(True), placed)
    asked = probes.select(F.col("base").alias("value"), *[F.col(c).cast("int").alias(c) for c in columns]).mapInArrow(place(False), placed)
    schema = _parse_datatype_string("key string")
    out = to_arrow_schema(schema)

    def name(base: str, own: bool, group: int, mode: int) -> str:
        return f"{group}{'=' if own else '~'}{md5(base.encode('utf-8', 'surrogatepass')).hexdigest()}/{mode}"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # base, is it a text itself, modes still wanted (0: any longer text); all of one group
        open_probes: list[tuple[str, bool, int]] = []
        now, seen = None, None
        for batch in batches:
            hits: list[str] = []
            for group, value, key, mode in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if group != now:
                    now, open_probes, seen = group, [], None
                while open_probes and not value.startswith(open_probes[-1][0]):
                    open_probes.pop()
                if key is None and value != seen:
                    seen, kept = value, []
                    for base, own, wanted in open_probes:
                        if wanted:
                            for bit in (b for b in MODES.values() if wanted & b):
                                if goes_on_inside(base, value, bit):
                                    hits.append(name(base, own, group, bit))
                                    wanted &= ~bit
                            if wanted:
                                kept.append((base, own, wanted))
                        elif len(value) > len(base) and not MARK.fullmatch(value, len(base)):
                            hits.append(name(base, own, group, 0))
                        else:
                            kept.append((base, own, wanted))
                    open_probes = kept
                own = key is not False
                if mode or not own:
                    equal = takewhile(lambda p: len(p[0]) == len(value), reversed(open_probes))
                    if (value, own, mode) not in equal:
                        open_probes.append((value, own, mode))
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(hits, type=out.field(0).type)], schema=out)

    both = values.unionAll(asked).repartitionById(n, F.col("part")).sortWithinPartitions("group", "value")
    return both.mapInArrow(walk, schema).distinct()


TRUNCATED = "record_type string, record_id bigint, source string, marked boolean, evidence string"


def truncated(responses: DataFrame, actions: DataFrame) -> DataFrame:
    """One row for each cut record: whether a mark follows the cut, and what shows it."""
    seen = cut(ends(responses, actions).dropDuplicates(["record_type", "record_id"]))  # read by the probes and by the join
    # a cut or long open end with any longer text, a complete one before a mark by how the text goes on
    aimed = F.when(F.col("how") == COMPLETE, MODES[None]).otherwise(0)
    asks = (F.col("how").isin(CUT, COMPLETE)) & (F.col("base") != "") | (F.length("base") >= LEAST_PROBE)
    one = F.lit(0).alias("group")
    values = _values(responses, actions).where("value <> ''")
    originals = actions.select(F.col("original_content").cast("string").alias("value"), F.lit(0).alias("mode"), one).where("original_content is not null and original_content <> ''")
    longer = cut(prefixes(seen.where(asks).select("base", aimed.alias("mode"), one), values.select("value", _mode().alias("mode"), one).unionAll(originals)))  # few keys, read by two joins
    own = values.select("record_type", "record_id", "source", own_key(0, "value", _mode()).alias("own_key")).join(longer.where("key like '%=%'"), F.col("own_key") == F.col("key"))
    joined = seen.join(longer.where("key like '%~%'").select(F.col("key").alias("longer_key")), probe_key(0, "base", aimed) == F.col("longer_key"), "left")
    copy = F.col("longer_key").isNotNull()
    by_end = joined.where((F.col("how") == CUT) | copy).select(
        "record_type", "record_id", "source", "marked", F.when(copy & (F.col("how") == CUT), "longer copy and end").when(copy, "longer copy").otherwise("end").alias("evidence")
    )
    by_copy = own.select("record_type", "record_id", "source", F.lit(False).alias("marked"), F.lit("longer copy").alias("evidence"))
    # of a record in both, the row that knows its end is kept
    picked = F.min_by(F.struct("source", "marked", "evidence"), F.col("by")).alias("x")
    return by_end.withColumn("by", F.lit(0)).unionAll(by_copy.withColumn("by", F.lit(1))).groupBy("record_type", "record_id").agg(picked).select("record_type", "record_id", "x.source", "x.marked", "x.evidence")


def found(responses: DataFrame, actions: DataFrame) -> DataFrame:
    """The cut records."""
    return truncated(responses, actions).select("record_type", "record_id")


def rates(responses: DataFrame, actions: DataFrame) -> DataFrame:
    """For each record_type and source: records with a text, cut records and their share."""
    records = _values(responses, actions).where("trim(value) <> ''").groupBy("record_type", "source").agg(F.count_distinct("record_id").alias("records"))
    cuts = truncated(responses, actions).groupBy("record_type", "source").agg(F.count("*").alias("cut"), F.count_if("marked").alias("marked"))
    joined = records.join(cuts.withColumnsRenamed({"record_type": "t", "source": "s"}), (F.col("record_type") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")), "left")
    cut = F.coalesce("cut", F.lit(0))
    return joined.select("record_type", "source", "records", cut.alias("cut"), F.coalesce("marked", F.lit(0)).alias("marked"), F.round(cut / F.col("records"), 6).alias("rate"))
