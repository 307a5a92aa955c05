"""Problem 1: credentials embedded in source code and configuration.

Method: configuration formats (JSON, YAML, TOML, INI, dotenv, properties, XML; also inside of fences) are parsed
into key paths with the offsets of their values (``p1_formats``); sensitive key names and the shapes of values are
tested; the accepted spans are spliced out of the original bytes.  In code the same is done for names and the
string literals assigned to them, over lines and pieces.  Values that stand outside of pairs (URLs, headers,
command options, calls, tables, prose) get parsers of their own that yield the same (key path, span) facts,
and every value passes the same tests.

One map over the rows: no shuffle of texts; every field is read, texts that equal another field of the row share
its result.  Null, empty and very long texts, ties and repeated rows have no special case; redelivered rows are
reported once.  What a cut field shows of a credential is no credential: a ``document_text`` that is not the whole
document (it has exactly ``cut_at`` characters, or the full text goes on behind it) loses spans that touch its end,
and a private key needs its END line.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import p1_formats
from .common import rows_by_batch

FIELDS = ("full_document_text", "document_text", "selected_text")
#: document_text is cut at this many characters.
CUT_AT = 4000


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    path: str
    #: What of it is masked if not all of it: the pieces of a value that is put together.
    parts: tuple[tuple[int, int], ...] = ()


# --- value shapes ------------------------------------------------------------------------------------------

#: Published formats of access tokens, with the lengths their issuers use.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}|github_pat_\w{50,}|glpat-[\w-]{20}"
    r"|sk_(?:live|test)_[A-Za-z0-9]{24,}|rk_live_[A-Za-z0-9]{24,}|sk-(?:proj-|ant-)?[\w-]{40,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-\d+-\d+-[A-Za-z0-9]{20,}"
    r"|AIza[\w-]{35}|SG\.[\w-]{20,24}\.[\w-]{40,46}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|ya29\.[\w-]{30,}"
    r"|eyJ[\w-]{10,}={0,2}\.eyJ[\w-]{10,}={0,2}\.[\w-]{30,}|pypi-[\w-]{50,}|dop_v1_[0-9a-f]{64}|AccountKey=[A-Za-z0-9+/=]{60,})"
)
_PLACEHOLDER = re.compile(
    r"(?i)^$|^[*x•.#_\-]+$|^<.*>$|^\[.*\]$|^\{.*\}$|^\$|^%.*%$|\$\{|\{\{|^(?:change|replace|your|insert|enter|todo|fixme|dummy|example|sample|none|null|true|false|undefined|redacted|masked|hidden|placeholder|secret|password|passwd|token|test|foo|bar)(?:[\W_]*(?:me|this|it|here|your|my|the|a|api|key|token|secret|password|pass|value|in|with|placeholder))*$"
    r"|^your[-_ ]|^my[-_ ]|\.{3}$|…$|^:\w+$|^@\w|^!|[请填写替换示例占位]|process\.env|os\.environ|getenv|getpass|^vault[:/]|^secret[:/]|^env[.:(]|^ssm:|^arn:|^op://|^file:|^\(|^\w+\(|xxxx|\*\*\*"
)
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_PATH = re.compile(r"^[./~]?[\w.-]*/[\w./-]*$|\.(?:py|js|ts|tsx|json|md|toml|ya?ml|txt|sql|sh|html|css|pem|key|crt)$")
_HASH = re.compile(r"(?i)^(?:sha\d+|md5)[-:]")


def placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.search(value))


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * log2(k / n) for k in map(value.count, set(value)))


def token_like(value: str) -> bool:
    """A random string of a length that cannot be guessed: hexadecimal, base 64 or the like."""
    if TOKEN.fullmatch(value):
        return True
    if len(value) < 16 or placeholder(value) or _UUID.fullmatch(value) or _HASH.match(value):
        return False
    if re.fullmatch(r"(?i)[0-9a-f]{32,}", value):
        return True
    if not re.fullmatch(r"[A-Za-z0-9+/_=.-]+", value) or not (re.search(r"\d", value) and re.search(r"[A-Za-z]", value)):
        return False
    if re.search(r"\.[a-z]{2,4}$", value):
        return False
    runs = re.findall(r"[a-z]+|[A-Z]+|\d+", value)
    return _entropy(value) >= 3.4 and len(runs) >= len(value) / 4


def password_like(value: str) -> bool:
    """A word that a person or a generator chose as a password: no plain word, name, path or sentence."""
    if len(value) < 6 or placeholder(value) or re.search(r"\s", value) or _UUID.fullmatch(value) or _HASH.match(value):
        return False
    if not value.isascii() or (_PATH.search(value) and not re.search(r"[#!^%]|\.\d+$", value)):
        return False
    letters, digit, symbol = re.search(r"[A-Za-z]", value), re.search(r"\d", value), re.search(r"[^\w.\-/:]", value)
    mixed = re.search(r"[a-z][A-Z]{2,}|[A-Z]{3,}[a-z]|[A-Z]{2,}.*[a-z].*[A-Z]|[a-z]+[A-Z][a-z][A-Z]", value)
    return bool(letters and (digit or symbol or mixed))


# --- key names ---------------------------------------------------------------------------------------------

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[一-鿿]+")
_PASSWORD_WORDS = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "passwort", "kennwort", "contrasena", "senha"}
_SECRET_WORDS = {"secret", "token", "apikey", "credential", "credentials", "creds", "cred", "bearer", "authorization", "auth"}
_KEY_OF = {"api", "access", "secret", "private", "signing", "encryption", "auth", "client", "master", "service", "account", "deploy", "ssh", "x"}
#: A name with one of these behind the word describes a secret, or something that merely carries the word.
_ABOUT = {
    "hint", "label", "field", "min", "max", "length", "len", "policy", "hash", "hashed", "count", "name", "id", "ids", "limit", "ref", "type", "header", "expires", "expiry",
    "ttl", "path", "file", "dir", "reset", "required", "placeholder", "regex", "pattern", "column", "public", "pub", "pubkey", "title", "text", "url", "index", "commit",
    "digest", "sha", "integrity", "checksum", "revision", "uuid", "size", "prompt", "message", "help", "rotation", "prefix", "fingerprint", "thumbprint", "etag",
}
_CJK_SECRET = re.compile("密码|口令|密钥|令牌|秘钥|凭据")


def sensitive(name: str) -> str | None:
    """'password' or 'secret' if a value under this name is to be kept secret, else None."""
    if m := _CJK_SECRET.search(name):
        return "password" if m.group() in ("密码", "口令") else "secret"
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words:
        return None
    held = set(words)
    last = max((k for k, w in enumerate(words) if w in _PASSWORD_WORDS or w in _SECRET_WORDS or w == "key"), default=-1)
    if held & {"public", "pub", "pubkey", "max", "min"} or _ABOUT & set(words[last + 1 :]):
        return None
    if held & _PASSWORD_WORDS:
        return "password"
    if held & _SECRET_WORDS or ("key" in held and (held & _KEY_OF or words[-1] == "key")):
        return "secret"
    return None


# --- parsers -----------------------------------------------------------------------------------------------

_QUOTED = r"""(?:"(?P<dq{0}>(?:[^"\\\n]|\\.)*)"|'(?P<sq{0}>(?:[^'\\\n]|\\.)*)'|`(?P<bq{0}>[^`\n]*)`)"""
#: A pair of any of the formats: name, separator (with a type in between in code), value.
_PAIR = re.compile(
    r"""(?P<name>["'`]?(?:[A-Za-z_$一-鿿][\w$.\-]*)(?:\[["'][\w.\-]+["']\])?["'`]?)\s*(?::\s*[A-Za-z][\w.\[\]| ]*?\s*=|[:=]=?>?|：)\s*[frbu]?"""
    r"(?:" + _QUOTED.format("") + r"|(?P<bare>[^\s\"'`,;{}()\[\]<>|][^\s\"'`,;{}()\[\]<>|]*))"
)
_DEFAULT = re.compile(r"""(?:\bget|getenv|getOrDefault|env|config)\(\s*["'](?P<name>[\w.\-]+)["']\s*,\s*["'](?P<value>[^"'\n]+)["']""")
_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.\-]*://(?P<user>[^\s:/@"'`<>{}]*):(?P<value>[^\s/@"'`<>]+)@[\w.\-]""")
_QUERY = re.compile(r"[?&](?P<name>[\w.\-]+)=(?P<value>[^&\s\"'`#<>{}]+)")
_SCHEME = re.compile(r"(?i)\b(?P<kind>bearer|basic|token|apikey)\s+(?P<value>[A-Za-z0-9+/_=.\-]{8,})")
_OPTION = re.compile(
    r"""(?x)(?:\b(?:sshpass|mysql\w*|docker\s+login|psql|redis-cli|mongo\w*|smbclient|7z|zip)\b[^\n|]*?\s-(?:p|a|P)\s*|--(?:password|passwd|pass|token|secret|api-key)[=\s]+)(?:'(?P<sq>[^'\n]+)'|"(?P<dq>[^"\n]+)"|(?P<bare>[^\s'"]+))"""
)
_USER_OPTION = re.compile(r"""(?:^|\s)(?:-u|--user)[=\s]*["']?(?P<user>[\w.\-@]+):["']?(?P<value>[^\s"'\n]+)""")
_PIPED = re.compile(r"""\becho\s+["']?(?P<value>[^\s"'|]+)["']?\s*\|\s*(?:sudo\s+-S|passwd|su\b|docker\s+login|gh\s+auth)""")
_SQL = re.compile(r"""(?i)\b(?:identified\s+by|password)\s+'(?P<value>[^'\n]+)'""")
_CALL = re.compile(r"""(?i)(?:\b(?:login|log_in|signin|sign_in|authenticate|auth|connect)\(\s*|\b\w*(?:creds?|credentials?|auth|login)\s*=\s*[\(\[]\s*)["'](?P<user>[\w.\-@]+)["']\s*,\s*["'](?P<value>[^"'\n]+)["']""")
_INSERT = re.compile(r"""(?i)\binsert\s+into\s+\w*(?:client|user|account|credential|token|secret|key|auth|login)\w*\b""")
_LITERAL = re.compile(r"""'([^'\n]+)'""")
_PROSE = re.compile(
    r"""(?i)(?:密码|口令|密钥|令牌|秘钥|(?<![A-Za-z_])(?:pass(?:word|wd|phrase|code)?|passwort|kennwort|mot\s+de\s+passe|contraseña|senha|token|api\s+key|secret)(?![A-Za-z_\d]))\s*(?:是|为|：|:|=|\bis\b|\bist\b|\best\b|\bes\b|lautet)?\s*[`"'“「]?(?P<value>[!-~]{6,})"""
)
_ACCOUNT = re.compile(r"""(?i)(?:账号|账户|帐号|用户|accounts?|login|testkonto|konto|compte|cuenta|conta|user)\s*[:：]?\s*[`"']?(?P<user>[\w.\-@]+)[`"']?\s*[/／,，:]\s*[`"']?(?P<value>[!-~]{6,})""")
_ROW = re.compile(r"(?i)密码|口令|密钥|password|passwort|kennwort|mot de passe|contraseña|senha|secret|token")
_BEGIN = re.compile(r"-----BEGIN (?P<kind>(?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")

_S = r"[^\S\n]"
#: A line without any of these holds nothing that a parser above would accept: the words of ``sensitive`` and the fixed
#: words or the form of each parser, in the order of the parsers.
_TRIGGER = re.compile(
    r"(?i:pass|pwd|secret|token|key|cred|auth|bearer|basic|identified|login|kennwort|senha|contrase|account|konto|compte"
    rf"|log_in|sign_?in|connect\(|\b(?:mysql|docker|psql|curl)|insert{_S}+into{_S}+\w*(?:client|user)|echo{_S}[^\n]*\|{_S}*su"
    rf"|(?:用户|cuenta|conta|user){_S}*[:：]?{_S}*[`\"']?[\w.\-@]+[`\"']?{_S}*[/／,，:]{_S}*[`\"']?[!-~]{{6}})"
    rf"|\b(?:redis-cli|mongo\w*|smbclient|7z|zip)\b[^\n|]*?{_S}-[paP]|(?<!\S)(?:-u|--user)(?:=|{_S})*[\"']?[\w.\-@]+:"
    r"|://[^\s/@]*:[^\s/@]+@|密码|口令|密钥|令牌|秘钥|凭据|账号|账户|帐号"
    r"|AKIA|ASIA|gh[pousr]_|github_pat|glpat|[sr]k_live|\bsk_test|sk-|xox|AIza|SG\.|npm_|hf_|ya29|eyJ|pypi-|dop_v1"
)


#: Words of which every line that ``_TRIGGER`` lets through holds one, in small letters.
_WORDS_OF_TRIGGER = (
    "pass pwd secret token key cred auth bearer basic identified login kennwort senha contrase account konto compte log_in signin sign_in connect( mysql docker psql curl insert echo 用户 cuenta conta user redis-cli mongo smbclient 7z zip"
    " -u :// 密码 口令 密钥 令牌 秘钥 凭据 账号 账户 帐号 akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat sk_live rk_live sk_test sk- xox aiza sg. npm_ hf_ ya29 eyj pypi- dop_v1"
).split()


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in _WORDS_OF_TRIGGER:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def _lines_to_read(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines with a trigger, and of those where a literal goes on behind a plus."""
    low = text.lower()
    if len(low) == len(text):
        places = [end - n + 1 for end, n in _automaton().iter(low)]
    else:  # a letter has no small form of its own length
        places = [m.start() for m in _TRIGGER.finditer(text)]
    sure = [m.start() for m in _CHAIN_START.finditer(text)] if "+" in text else []
    out, done = set(), -1
    for at in places:
        if at < done:
            continue
        start = text.rfind("\n", 0, at) + 1
        done = text.find("\n", at)
        done = len(text) if done < 0 else done
        if _TRIGGER.search(text, start, done):
            out.add((start, done))
    for at in sure:
        end = text.find("\n", at)
        out.add((text.rfind("\n", 0, at) + 1, len(text) if end < 0 else end))
    return sorted(out)


def _value(m: re.Match) -> tuple[str, int, int]:
    for g in ("dq", "sq", "bq", "bare"):
        if m.group(g) is not None:
            return m.group(g), m.start(g), m.end(g)
    return "", m.end(), m.end()


def _unquote(name: str) -> str:
    if m := re.search(r"\[[\"']([\w.\-]+)[\"']\]$", name):
        return m.group(1)
    return name.strip("\"'`")


def _accept(name: str, value: str, quoted: bool) -> bool:
    kind = sensitive(name.rsplit(".", 1)[-1])
    if kind == "password":
        return password_like(value) and (quoted or not value.startswith(("$", "%")))
    return kind == "secret" and token_like(value)


def _trimmed(value: str) -> str:
    return value.rstrip(".,;:!?)]}\"'`>。，；：！？）】」”")


def _percent(value: str) -> str:
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m.group(1), 16)), value)


def _line_spans(line: str, parents: str) -> Iterator[Span]:
    """Credentials in one line; offsets within it."""
    for m in _PAIR.finditer(line):
        value, s, e = _value(m)
        name = _unquote(m.group("name"))
        if _accept(name, value, m.group("bare") is None):
            yield Span(s, e, sensitive(name.rsplit(".", 1)[-1]) or "", f"{parents}{name}")
    # pairs inside of a quoted value: connection strings and inner objects
    for m in re.finditer(r"(?i)(?:^|[;{,\s\"'(])(?P<name>[\w-]*(?:password|passwd|pwd|pass|secret|token|key)[\w-]*)[\"']?\s*[=:]\s*[\"']?(?P<value>[^\s;\"',}&]+)", line):
        if _accept(m.group("name"), m.group("value"), False):
            yield Span(m.start("value"), m.end("value"), "pair", f"{parents}{m.group('name')}")
    for m in _DEFAULT.finditer(line):
        if _accept(m.group("name"), m.group("value"), True):
            yield Span(m.start("value"), m.end("value"), "default", f"{parents}{m.group('name')}")
    for m in _URL.finditer(line):
        value = _percent(m.group("value"))
        if not placeholder(value) and not value.startswith("{") and len(value) >= 4 and value.lower() not in _PASSWORD_WORDS:
            yield Span(m.start("value"), m.end("value"), "url", f"{parents}userinfo")
    for m in _QUERY.finditer(line):
        if _accept(m.group("name"), m.group("value"), True):
            yield Span(m.start("value"), m.end("value"), "query", f"{parents}{m.group('name')}")
    for m in _SCHEME.finditer(line):
        value = m.group("value").rstrip(".")
        if m.group("kind").lower() == "basic":
            try:
                user, colon, word = base64.b64decode(value, validate=True).decode("utf-8").partition(":")
            except (binascii.Error, UnicodeDecodeError, ValueError):
                continue
            if colon and word and not placeholder(word):
                yield Span(m.start("value"), m.start("value") + len(value), "basic", f"{parents}authorization")
        elif token_like(value):
            yield Span(m.start("value"), m.start("value") + len(value), "scheme", f"{parents}authorization")
    for m in _OPTION.finditer(line):
        g = next(g for g in ("sq", "dq", "bare") if m.group(g) is not None)
        if password_like(m.group(g)) or token_like(m.group(g)):
            yield Span(m.start(g), m.end(g), "option", f"{parents}-p")
    for m in _USER_OPTION.finditer(line):
        if not placeholder(m.group("value")) and (password_like(m.group("value")) or token_like(m.group("value"))):
            yield Span(m.start("value"), m.end("value"), "option", f"{parents}-u")
    for pattern, kind in ((_PIPED, "pipe"), (_SQL, "sql"), (_CALL, "call")):
        for m in pattern.finditer(line):
            if password_like(m.group("value")) or token_like(m.group("value")):
                yield Span(m.start("value"), m.end("value"), kind, f"{parents}{kind}")
    if _INSERT.search(line):
        for m in _LITERAL.finditer(line):
            if token_like(m.group(1)):
                yield Span(m.start(1), m.end(1), "sql", f"{parents}values")
    for pattern in (_PROSE, _ACCOUNT):
        for m in pattern.finditer(line):
            value = _trimmed(m.group("value"))
            name = _PATH.search(value) or re.fullmatch(r"[a-z]+(?:_[a-z]+)*(?:_\d+)?|[a-z]{2,}(?:[A-Z][a-z]{2,})*\d*|[A-Z]+(?:_[A-Z]+)*(?:[=(].*)?", value)
            if token_like(value) or (password_like(value) and not re.search(r"[=(){}\[\]<>,\"'`]", value) and (not name or re.fullmatch(r"[a-z]{4,}\d{3,}", value)) and re.search(r"\d|[#!^%]|[a-z][A-Z]{2}|[A-Z][a-z][A-Z]", value)):
                yield Span(m.start("value"), m.start("value") + len(value), "prose", f"{parents}prose")
    if line.lstrip().startswith("|") and _ROW.search(line):
        for m in re.finditer(r"\|\s*`?([!-{}~]{6,}?)`?\s*(?=\|)", line):
            if token_like(m.group(1)) or (password_like(m.group(1)) and not re.fullmatch(r"[\w-]+?\d{0,2}", m.group(1))) or re.fullmatch(r"[a-z]{4,}\d{3,}|(?=.*\d)(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]{9,}|[A-Z]+_[a-z]+\d", m.group(1)):
                yield Span(m.start(1), m.end(1), "table", f"{parents}cell")
    for m in TOKEN.finditer(line):
        yield Span(m.start(), m.end(), "token", f"{parents}")


_OPENS = re.compile(r"""^(?P<indent>\s*)(?:-\s+)?["']?(?P<name>[\w.\-$]+)["']?\s*[:=]\s*(?:[{\[(|>]?[-+]?)\s*$""")
_SECTION = re.compile(r"^\s*\[\[?(?P<name>[\w.\-\"' ]+)\]\]?\s*$")


class _Parents:
    """Key path of the enclosing keys of a line: those above it that open a block and stand further left, up to a section.

    Lines are asked for in order, so one pass keeps the open keys on a stack by indent.
    """

    def __init__(self, text: str) -> None:
        self.lines, self.at = text.split("\n"), 0
        self.open: list[tuple[int, str]] = []
        self.section, self.blank = "", False

    def of(self, at: int) -> str:
        for line in self.lines[self.at : at]:
            if m := _SECTION.match(line):
                self.open, self.section, self.blank = [], m.group("name"), False
            elif m := _OPENS.match(line):
                indent = len(m.group("indent"))
                while self.open and self.open[-1][0] >= indent:
                    self.open.pop()
                self.open.append((indent, m.group("name")))
            elif not line.strip():
                self.blank = True
        self.at = max(self.at, at)
        line = self.lines[at]
        indent = len(line) - len(line.lstrip())
        names = [name for i, name in self.open if i < indent]
        top = names and self.open[0][0] == 0 or not indent and self.blank
        return "".join(f"{n}." for n in ([] if top or not self.section else [self.section]) + names)


def _private_keys(text: str) -> Iterator[Span]:
    for m in _BEGIN.finditer(text):
        end = text.find(f"-----END {m.group('kind')}PRIVATE KEY", m.end())
        if end < 0 or "-----BEGIN" in text[m.end() : end]:
            continue
        body = re.sub(r"\\[nr]|[\s\"'+,\\`#/*|-]", "", text[m.end() : end])
        if len(body) >= 64 and re.fullmatch(r"[A-Za-z0-9=]+", body) and len(set(body)) > 12:
            yield Span(m.start(), end, "private key", "")


_TOKEN_PIECE = r"[rRbBuUfF]{0,2}(?:\"\"\"(?P<a>[\s\S]*?)\"\"\"|'''(?P<b>[\s\S]*?)'''|\"(?P<c>(?:[^\"\\\n]|\\.)*)\"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>[^`]*)`)"
_PIECE = re.compile(_TOKEN_PIECE)
_TARGET = re.compile(r"""(?P<name>["'`]?[A-Za-z_$一-鿿][\w$.\-]*(?:\[["'][\w.\-]+["']\])?["'`]?)\s*(?::\s*[A-Za-z][\w.\[\]| ]*?\s*=|[:=](?![=>])|：)""")
_OPENED = re.compile(r"""\s*(?P<paren>\()?\s*(?=[rRbBuUfF]{0,2}["'`])""")
_PLUS, _SPACE = re.compile(r"\s*(?:\+|\.\.?(?=\s*[\"'])|\\\r?\n)\s*"), re.compile(r"\s+")
_PLUS_BEHIND = re.compile(r"""["'`](?=\s*(?:\+|$))""")
_CHAIN_START = re.compile(r"""["'`]\s*\+\s*["'`]""")


def _chain(text: str, at: int, paren: bool) -> list[tuple[int, int]]:
    """Offsets of the contents of string literals that one expression at ``at`` puts together."""
    parts = []
    while m := _PIECE.match(text, at):
        parts.append(m.span(m.lastgroup))
        glue = _PLUS.match(text, m.end()) or (_SPACE.match(text, m.end()) if paren else None)
        if glue is None:
            break
        at = glue.end()
    return parts


def _literals(text: str, begin: int, end: int) -> Iterator[Span]:
    """Credentials in literals of several lines or pieces whose expression begins in ``text[begin:end]``."""
    for m in _TARGET.finditer(text, begin, end):
        opened = _OPENED.match(text, m.end())
        if opened is None:
            continue
        parts = _chain(text, opened.end(), opened.group("paren") is not None)
        if not parts or (len(parts) == 1 and "\n" not in text[m.start("name") : parts[0][1]]):
            continue
        name = _unquote(m.group("name"))
        parts = [(a + len(p) - len(p.lstrip()), b - len(p) + len(p.rstrip())) for a, b in parts for p in [text[a:b]]] if len(parts) == 1 else parts
        value = "".join(text[a:b] for a, b in parts)
        if TOKEN.fullmatch(value) or _accept(name, value, True):
            yield Span(parts[0][0], parts[-1][1], "joined", name, tuple(parts))
    for m in _PLUS_BEHIND.finditer(text, begin, end):  # a token in pieces under any name
        if not _CHAIN_START.match(text, m.start()):
            continue
        first = max(text.rfind(q, begin, m.start()) for q in "\"'`")
        parts = _chain(text, first, False) if first >= begin else []
        if len(parts) > 1 and TOKEN.fullmatch("".join(text[a:b] for a, b in parts)):
            yield Span(parts[0][0], parts[-1][1], "joined", "", tuple(parts))


#: Names that only say that here is the value of the name above.
_VALUE_NAMES = {"value", "val", "default", "data", "content", "raw", "text", "current", "plain", "plaintext"}


def _pair_kind(pair: p1_formats.Pair) -> str | None:
    """What kind of secret the value of a pair is, by the names of its path and its shape; None for none."""
    names = pair.names
    kind = sensitive(names[-1].rsplit(".", 1)[-1])
    if kind is None and len(names) > 1:
        if names[-1].lower() in _VALUE_NAMES:
            kind = sensitive(names[-2])
        elif names[-2].lower() in ("passwords", "secrets", "tokens"):
            kind = "password" if names[-2].lower() == "passwords" else "secret"
    if kind == "password" and password_like(pair.value) and (pair.quoted or not pair.value.startswith(("$", "%"))):
        return kind
    if kind == "secret":
        lines = pair.value.split("\n")
        if token_like(pair.value) or (len(lines) > 1 and all(len(x) >= 16 for x in lines[:-1]) and token_like("".join(lines))):
            return kind
    return None


def _from_pairs(text: str, suffix: str | None) -> Iterator[Span]:
    for pair in p1_formats.pairs(text, suffix):
        if pair.start < pair.end and (kind := _pair_kind(pair)):
            inner = tuple((m.start() + pair.start, m.end() + pair.start) for m in re.finditer(r"[^\s\\]+", text[pair.start : pair.end])) if "\n" in text[pair.start : pair.end] else ()
            yield Span(pair.start, pair.end, kind, ".".join(pair.names), inner)


#: A key may be written with escapes or entities, so that its words can't be seen.
_ESCAPED = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#")


def spans(text: str | None, suffix: str | None = None, cut: bool = False) -> list[Span]:
    """All credentials of ``text`` by offset, none inside another; ``cut`` tells that the text was cut at its end."""
    if not text:
        return []
    found: list[Span] = list(_private_keys(text)) if "PRIVATE KEY" in text else []
    keys = [(s.start, s.end) for s in found]
    above: _Parents | None = None
    lines = _lines_to_read(text)
    if lines or _ESCAPED.search(text):
        found += _from_pairs(text, suffix)
    for start, done in lines:
        line = text[start:done].rstrip("\r")
        if any(a <= start < b for a, b in keys):
            continue
        found += _literals(text, start, done)
        hits = list(_line_spans(line, ""))
        if not hits:
            continue
        above = above or _Parents(text)
        parents = above.of(text.count("\n", 0, start))
        found += [Span(start + h.start, start + h.end, h.kind, parents + h.path) for h in hits]
    kept: list[Span] = []
    for s in sorted(found, key=lambda s: (s.start, -s.end)):  # stable: of equal spans the one with the parsed path
        if (cut and s.end == len(text)) or (kept and s.start < kept[-1].end):
            continue
        kept.append(s)
    return kept


_KEY_BODY = re.compile(rb"\\[nr]|[A-Za-z0-9+/=]")


def _mask(raw: bytes, kind: str) -> bytes:
    """One star for each character; of a private key its lines, line ends and marks stay."""
    if kind == "private key":
        head = raw.index(b"-----", 5) + 5
        return raw[:head] + _KEY_BODY.sub(lambda m: m.group() if m.group()[:1] == b"\\" else b"*", raw[head:])
    return b"*" * len(raw.decode("utf-8", "surrogatepass"))


def byte_offsets(text: str, offsets: list[int]) -> list[int]:
    """Offsets in the UTF-8 bytes of ``text`` of ascending offsets of characters, in one pass."""
    if text.isascii():
        return offsets
    out, at, byte = [], 0, 0
    for o in offsets:
        byte += len(text[at:o].encode("utf-8", "surrogatepass"))
        at = o
        out.append(byte)
    return out


def masked(text: str, found: list[Span]) -> str:
    """``text`` with each span spliced out of its bytes; line ends, escapes and the marks around a value stay."""
    raw = text.encode("utf-8", "surrogatepass")
    pieces = [(a, b, s.kind) for s in found for a, b in (s.parts or ((s.start, s.end),))]
    places = byte_offsets(text, [o for a, b, _ in pieces for o in (a, b)])
    out, at = [], 0
    for k, (_, _, kind) in enumerate(pieces):
        a, b = places[2 * k], places[2 * k + 1]
        out += [raw[at:a], _mask(raw[a:b], kind)]
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


FINDINGS = "request_id bigint, field_name string, line_no int, start_byte int, end_byte int, kind string, key_path string"
REDACTED = "request_id bigint, field_name string, n_credentials int, redacted string"


def _by_field(path: str | None, full: str | None, document: str | None, selected: str | None, cut_at: int) -> Iterator[tuple[str, str, list[Span]]]:
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else None
    known: dict[str, list[Span]] = {}
    for field, text in zip(FIELDS, (full, document, selected)):
        if not text:
            continue
        if field == FIELDS[1] and text != full and (len(text) == cut_at or (full and full.startswith(text))):
            yield field, text, spans(text, suffix, cut=True)
        else:
            if text not in known:
                known[text] = spans(text, suffix)
            yield field, text, known[text]


def _source(requests: DataFrame) -> DataFrame:
    path = F.col("active_file").cast("string") if "active_file" in requests.columns else F.lit(None).cast("string")
    return requests.select(F.col("request_id").cast("bigint").alias("request_id"), path.alias("path"), *[F.col(f).cast("string").alias(f) for f in FIELDS])


def findings(requests: DataFrame, cut_at: int = CUT_AT) -> DataFrame:
    """One row for each credential: field, line, byte offsets in the UTF-8 text, kind and key path."""

    def run(ids: list, paths: list, full: list, document: list, selected: list) -> Iterator[tuple]:
        for i, *texts in zip(ids, paths, full, document, selected):
            for field, text, found in _by_field(*texts, cut_at):
                places = byte_offsets(text, [o for s in found for o in (s.start, s.end)])
                for k, s in enumerate(found):
                    yield i, field, text.count("\n", 0, s.start) + 1, places[2 * k], places[2 * k + 1], s.kind, s.path

    return rows_by_batch(_source(requests), FINDINGS, run).dropDuplicates(["request_id", "field_name", "start_byte"])


def redacted(requests: DataFrame, cut_at: int = CUT_AT) -> DataFrame:
    """Every field that holds a credential, with only the credentials masked."""

    def run(ids: list, paths: list, full: list, document: list, selected: list) -> Iterator[tuple]:
        for i, *texts in zip(ids, paths, full, document, selected):
            for field, text, found in _by_field(*texts, cut_at):
                if found:
                    yield i, field, len(found), masked(text, found)

    return rows_by_batch(_source(requests), REDACTED, run).dropDuplicates(["request_id", "field_name"])


def found(requests: DataFrame) -> DataFrame:
    """The lines on which a credential begins."""
    return findings(requests).select("request_id", "field_name", "line_no").distinct()
