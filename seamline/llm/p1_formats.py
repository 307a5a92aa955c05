"""Parsers of configuration formats: every value with its key path and its offsets in the text.

JSON (with comments, line by line or as a fragment), YAML, TOML, INI, dotenv, properties and XML.  The parsers
are tolerant: what is cut or damaged ends a value, never the parse, and offsets are those of the raw value, inside
of its quotes, while the value itself is decoded (escapes, folded lines, continued lines, entities).  Each is one
pass over the text with a stack of open keys.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from typing import NamedTuple


class Pair(NamedTuple):
    names: tuple[str, ...]
    value: str
    start: int
    end: int
    quoted: bool


def unescaped(raw: str) -> str:
    """A string of JSON, YAML or TOML between double quotes, decoded; as it stands if an escape is wrong."""
    if "\\" not in raw:
        return raw
    raw_json = re.sub(r"\\x([0-9A-Fa-f]{2})", r"\\u00\1", re.sub(r"\\\r?\n\s*", "", raw))
    try:
        return json.loads(f'"{raw_json}"', strict=False)
    except ValueError:
        return raw


# --- brackets: JSON, and the inline tables and lists of YAML and TOML --------------------------------------

_BRACKET_TOKEN = re.compile(
    r"""(?s)"(?P<dq>(?:[^"\\]|\\.)*)"|(?P<open>[{\[])|(?P<close>[}\]])|(?P<comma>,)|(?P<colon>:(?=[\s{\["'\d\-tfn]|$)|=)"""
    r"""|//[^\n]*|/\*.*?\*/|(?<![^\s,{\[])\#[^\n]*|'(?P<sq>[^'\n]*)'|(?P<plain>[^\s{}\[\],"':=\#][^\s{}\[\],=]*?(?=:?[\s{}\[\],=]|:?$))"""
)


def bracket_pairs(text: str, begin: int = 0, above: tuple[str, ...] = (), whole: bool = True) -> Iterator[Pair]:
    """Pairs from ``begin`` on; unless ``whole``, up to the bracket that closes the first one."""
    names: list[tuple[str, ...]] = [above]
    lists = [False]
    key: str | None = None
    held: re.Match | None = None  # a scalar that is a key if a colon follows, else an element

    def scalar(m: re.Match) -> tuple[str, int, int, bool]:
        g = m.lastgroup or "plain"
        return (unescaped(m.group(g)) if g == "dq" else m.group(g)), m.start(g), m.end(g), g != "plain"

    for m in _BRACKET_TOKEN.finditer(text, begin):
        kind = m.lastgroup
        if kind in ("dq", "sq", "plain"):
            if key is not None:
                yield Pair((*names[-1], key), *scalar(m))
                key = None
            else:
                held = m
        elif kind == "colon":
            if held is not None:
                key, held = scalar(held)[0], None
        elif kind in ("comma", "close", "open"):
            if held is not None and lists[-1] and names[-1]:
                yield Pair(names[-1], *scalar(held))
            held = None
            if kind == "open":
                names.append(names[-1] if key is None else (*names[-1], key))
                lists.append(m.group() == "[")
            elif kind == "close":
                if len(names) > 1:
                    names.pop()
                    lists.pop()
                if not whole and len(names) == 1:
                    return
            key = None


# --- YAML --------------------------------------------------------------------------------------------------

_DQ, _SQ = r'"(?:[^"\\]|\\[\s\S])*"', r"'(?:[^']|'')*'"
_YAML_LINE = re.compile(
    r"""(?P<indent>[ \t]*)(?P<dash>(?:-[ ]+)*)(?:(?P<key>"(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|[^\s#:\[\]{},"'`&*!|>%@][^\n:#"'\[\]{}]*?)[ \t]*:(?=[ \t\r\n]|\Z)[ \t]*)?"""
)
_BLOCK_MARK = re.compile(r"[|>][+\-\d]{0,2}[ \t]*(?:#[^\n]*)?\r?$", re.M)
_STRING = re.compile(f"{_DQ}|{_SQ}")
_COMMENT = re.compile(r"(?:^|[ \t])#[^\n]*$")


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _indented(text: str, at: int, column: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines from ``at`` on that are blank or stand further right than ``column``."""
    while at < len(text):
        end = _line_end(text, at)
        line = text[at:end]
        if line.strip() and len(line) - len(line.lstrip()) <= column:
            return
        yield at, end
        at = end + 1


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    return start + len(piece) - len(piece.lstrip()), end - (len(piece) - len(piece.rstrip()))


def _quoted(text: str, at: int) -> tuple[str, int, int] | None:
    """(value, start, end) of the quoted scalar at ``at``; lines of it are folded."""
    m = _STRING.match(text, at)
    if m is None:
        return None
    raw = m.group()[1:-1]
    value = unescaped(raw) if m.group()[0] == '"' else raw.replace("''", "'")
    return re.sub(r"[ \t\r]*\n\s*", " ", value).strip(), m.start() + 1, m.end() - 1


def yaml_pairs(text: str, begin: int = 0, end: int | None = None) -> Iterator[Pair]:
    """Pairs of block YAML; ``name:`` and ``value:`` of one item give a pair of their own as well."""
    stop = len(text) if end is None else end
    text = text[:stop]
    open_: list[tuple[int, str]] = []
    named: dict[int, str] = {}
    at = begin
    while at < stop:
        line_end = _line_end(text, at)
        m = _YAML_LINE.match(text, at, line_end)
        nxt = line_end + 1
        if m is None or (not m.group("key") and not m.group("dash")):
            at = nxt
            continue
        column = len(m.group("indent")) + len(m.group("dash"))
        edge = len(m.group("indent")) if m.group("dash") else column
        while open_ and (open_[-1][0] >= column or open_[-1][0] > edge):
            open_.pop()
        for c in [c for c in named if c > column or (m.group("dash") and c >= column)]:
            del named[c]
        above = tuple(k for _, k in open_)
        key = m.group("key")
        here = m.end()
        names = (*above, key.strip("\"'").rstrip()) if key else above
        rest = text[here:line_end]
        if not key and not rest.strip():
            at = nxt
            continue
        tag = re.match(r"(?:(?:!!\w+|&\S+)[ \t]+)+", rest)
        here += tag.end() if tag else 0
        rest = text[here:line_end]
        found: tuple[str, int, int, bool] | None = None
        if _BLOCK_MARK.match(rest):
            lines = list(_indented(text, nxt, edge if m.group("dash") and not key else column))
            if lines:
                s, e = _trim(text, lines[0][0], lines[-1][1])
                found = "\n".join(x.strip() for x in text[s:e].split("\n")), s, e, True
                nxt = lines[-1][1] + 1
        elif not _COMMENT.sub("", rest.rstrip("\r")).strip():
            lines = list(_indented(text, nxt, column))
            first = next(((a, b) for a, b in lines if text[a:b].strip()), None)
            if first and not text[first[0] : first[1]].lstrip().startswith(("- ", "#", "-\r")):
                s, e = _trim(text, *first)
                inner = _YAML_LINE.match(text, *first)
                if text[s] in "\"'":
                    q = _quoted(text, s)
                    after = text[q[2] + 1 : _line_end(text, q[2])].strip() if q else ":"
                    if q and not after.startswith(":"):
                        found = (*q, True)
                        nxt = _line_end(text, q[2]) + 1
                elif text[s] in "{[":
                    yield from bracket_pairs(text, s, names, whole=False)
                elif not (inner and inner.group("key")):
                    e = _trim(text, first[0], max(b for a, b in lines))[1]
                    found = "\n".join(x.strip() for x in text[s:e].split("\n")), s, e, False
                    nxt = e + 1 if text[e : e + 1] == "\n" else _line_end(text, e) + 1
            open_.append((column, names[-1])) if key else None
        elif rest[0] in "{[":
            yield from bracket_pairs(text, here, names, whole=False)
        elif rest[0] in "\"'":
            if q := _quoted(text, here):
                found = (*q, True)
                nxt = _line_end(text, q[2]) + 1
        else:
            s, e = _trim(text, here, here + len(_COMMENT.sub("", rest.rstrip("\r"))))
            found = text[s:e], s, e, False
        if found:
            if names:
                yield Pair(names, *found)
            if key and names[-1] in ("name", "key"):
                named[column] = found[0]
            elif key and names[-1] == "value" and column in named:
                yield Pair((*above, named[column]), *found)
        at = nxt


# --- TOML, INI, dotenv, properties -------------------------------------------------------------------------

_SECTION = re.compile(r"""[ \t]*\[\[?[ \t]*(?P<name>[\w.\-"' :/]+?)[ \t]*\]\]?[ \t]*(?:[#;][^\n]*)?\r?$""", re.M)
_NAME = r"""(?:"[^"\n]*"|'[^'\n]*'|[\w$\-]+)"""
_ASSIGN = re.compile(rf"""[ \t]*(?:(?:export|set|setx)[ \t]+)?(?P<key>{_NAME}(?:[ \t]*\.[ \t]*{_NAME})*)[ \t]*[=:][ \t]*""")
_TRIPLE = re.compile(r'"""(?P<a>[\s\S]*?)"""|\'\'\'(?P<b>[\s\S]*?)\'\'\'')
_AFTER_STRING = re.compile(r"[ \t]*(?:[#;,][^\n]*)?\r?(?:\n|\Z)")
_INI_COMMENT = re.compile(r"[ \t][#;][^\n]*$")


def _parts(key: str) -> tuple[str, ...]:
    return tuple(p.strip().strip("\"'") for p in re.findall(_NAME, key))


def assignment_pairs(text: str, begin: int = 0, end: int | None = None) -> Iterator[Pair]:
    """Pairs of sections with assignments: strings of several lines, inline tables and continued lines included."""
    stop = len(text) if end is None else end
    text = text[:stop]
    section: tuple[str, ...] = ()
    at = begin
    while at < stop:
        line_end = _line_end(text, at)
        nxt = line_end + 1
        if m := _SECTION.match(text, at, line_end):
            section = _parts(m.group("name")) if "." in m.group("name") or '"' in m.group("name") else (m.group("name"),)
        elif m := _ASSIGN.match(text, at, line_end):
            names, here = (*section, *_parts(m.group("key"))), m.end()
            first = text[here : here + 1]
            if t := _TRIPLE.match(text, here):
                g = "a" if t.group("a") is not None else "b"
                s, e = _trim(text, *t.span(g))
                yield Pair(names, (unescaped(text[s:e]) if g == "a" else text[s:e]).strip(), s, e, True)
                nxt = _line_end(text, t.end()) + 1
            elif first and first in "\"'" and (q := _quoted(text, here)) and _AFTER_STRING.match(text, q[2] + 1):
                yield Pair(names, *q, True)
                nxt = _line_end(text, q[2]) + 1
            elif first and first in "{[":
                yield from bracket_pairs(text, here, names, whole=False)
            else:
                last = line_end
                while text[at:last].rstrip("\r").endswith("\\") and last < stop:
                    last = _line_end(text, last + 1)
                raw = text[here:last]
                s, e = _trim(text, here, here + len(_INI_COMMENT.sub("", raw.rstrip("\r"))))
                if s < e:
                    yield Pair(names, re.sub(r"\\\r?\n\s*", "", text[s:e]), s, e, False)
                nxt = last + 1
        at = nxt


# --- XML ---------------------------------------------------------------------------------------------------

_XML = re.compile(
    r"""(?s)<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<(?P<close>/)?(?P<tag>[A-Za-z_][\w.:\-]*)(?P<attributes>(?:\s+[\w.:\-]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*(?P<empty>/)?>|(?P<text>[^<]+)|<"""
)
_ATTRIBUTE = re.compile(r"""(?P<name>[\w.:\-]+)\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)')""")


def xml_pairs(text: str, begin: int = 0, end: int | None = None) -> Iterator[Pair]:
    """Pairs of elements and attributes; what ``name`` or ``key`` calls an element is its name, as is a ``<key>`` before it."""
    open_: list[tuple[str, str]] = []
    before = ""
    for m in _XML.finditer(text, begin, len(text) if end is None else end):
        g = "cdata" if m.group("cdata") is not None else "text"
        if m.group("tag"):
            tag = m.group("tag")
            if m.group("close"):
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == tag:
                        del open_[k:]
                        break
                continue
            above = tuple(n for _, n in open_)
            held = {}
            for a in _ATTRIBUTE.finditer(text, *m.span("attributes")):
                h = "a" if a.group("a") is not None else "b"
                held[a.group("name").lower()] = (html.unescape(a.group(h)), a.start(h), a.end(h))
            called = next((held[k][0] for k in ("name", "key", "id") if k in held), "")
            for name, value in held.items():
                yield Pair((*above, tag, name), *value, True)
                if name == "value" and called:
                    yield Pair((*above, called), *value, True)
            if not m.group("empty"):
                open_.append((tag, called or tag))
        elif m.group(g) is not None and open_:
            s, e = _trim(text, *m.span(g))
            if s >= e:
                continue
            value = m.group(g).strip() if g == "cdata" else html.unescape(text[s:e])
            if open_[-1][0] == "key":
                before = value
                continue
            names = tuple(n for _, n in open_)
            yield Pair(names, value, s, e, True)
            if before:
                yield Pair((*names[:-1], before), value, s, e, True)
                before = ""


# --- which format ------------------------------------------------------------------------------------------

_PARSERS = {"json": lambda t, a, b: bracket_pairs(t[:b], a), "yaml": yaml_pairs, "assignments": assignment_pairs, "xml": xml_pairs}
_SUFFIX = {
    "json": "json", "jsonc": "json", "json5": "json", "jsonl": "json", "ipynb": "json", "yaml": "yaml", "yml": "yaml", "toml": "assignments", "ini": "assignments", "cfg": "assignments", "conf": "assignments",
    "env": "assignments", "properties": "assignments", "dotenv": "assignments", "npmrc": "assignments", "xml": "xml", "config": "xml", "plist": "xml", "csproj": "xml", "props": "xml",
}
_CODE = {"py", "ts", "tsx", "js", "jsx", "java", "go", "rs", "c", "h", "cpp", "cs", "rb", "php", "kt", "swift", "vue", "sql", "css", "scss"}
_YAML_LIKE = re.compile(r"""(?m)^[ ]*(?:- +)*(?:[\w./\-]+|"[^"\n]*"|'[^'\n]*')[ ]*:(?:[ \t]|\r?$)""")
_ASSIGN_LIKE = re.compile(r"""(?m)^[ \t]*(?:export +)?[\w.\-]+[ \t]*=(?!=)|^[ \t]*\[\[?[\w.\-"']+\]\]?[ \t]*\r?$""")
_LIST_LIKE = re.compile(r"(?m)^[ ]*- ")
_LINE = re.compile(r"(?m)^[ \t]*[^\s#;/]")
_FENCED = re.compile(r"(?m)^[ \t>]*(?P<mark>`{3,}|~{3,})[ \t]*(?P<info>[\w.+\-]*)[^\n]*\n(?P<body>[\s\S]*?)^[ \t>]*(?P=mark)")


def format_of(text: str, suffix: str | None = None) -> str | None:
    """The format of ``text`` by the suffix of its file, else by its look; None for code and prose."""
    if suffix in _SUFFIX:
        return _SUFFIX[suffix]
    if suffix in _CODE:
        return None
    head = text.lstrip("\ufeff \t\r\n")
    if head[:1] in ("{", "[") and '"' in head and not _SECTION.match(head):
        return "json"
    if head[:1] == "<" and re.match(r"<(?:\?xml|!--|[A-Za-z_])", head):
        return "xml"
    lines = len(_LINE.findall(text))
    keys, assigned = len(_YAML_LIKE.findall(text)), len(_ASSIGN_LIKE.findall(text))
    if assigned > keys and 2 * assigned >= lines:
        return "assignments"
    if keys and 2 * (keys + len(_LIST_LIKE.findall(text))) >= lines:
        return "json" if head[:1] == '"' else "yaml"
    return None


def pairs(text: str, suffix: str | None = None) -> Iterator[Pair]:
    """All pairs of a configuration text, or of the configuration in the fences of another one."""
    kind = format_of(text, suffix)
    if kind:
        yield from _PARSERS[kind](text, 0, len(text))
        return
    if "```" in text or "~~~" in text:
        for m in _FENCED.finditer(text):
            a, b = m.span("body")
            inner = format_of(text[a:b], m.group("info").lower() or None)
            if inner:
                yield from _PARSERS[inner](text, a, b)
