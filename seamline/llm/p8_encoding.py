"""Problem 8: text decoded with the wrong character encoding.

Method: round-trip repair.  A text is split where it is suspicious, each suspicious run is re-encoded
under the legacy encodings that can hold it and strictly decoded as the encoding that was meant; this is
repeated for nested layers, however many, as long as a garbling cost drops.  What was lost on the way (U+FFFD,
its re-encoded form, unassigned characters) cannot be restored and is reported as such.

The operator is one map over the rows: no shuffle, no state, the same decision for a text whatever else
the table holds.  Null, empty and pure ASCII texts are never affected.  Repeated texts each get a row.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_by_batch

#: Encodings of one byte a character through which UTF-8 or GBK is misread.
SINGLE_BYTE = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "mac_roman", "koi8-r")
#: Encodings of several bytes a character through which UTF-8, GBK or a Latin encoding is misread.
MULTI_BYTE = ("gb18030", "cp950", "big5hkscs", "shift_jis", "euc-kr")

_LATIN = "àâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿßÀÂÄÁÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØŒÙÚÛÜÝŸ"
_TYPO = "’‘“”„‚«»‹›–—…¿¡·•€™©®°§№×→←✓"
_CJK_PUNCT = "、。，：；？！（）《》【】「」『』〈〉～￥"
_UTF8 = re.compile(
    rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
_RUN = re.compile(r"[^\x00-\x7f]+(?: ?[^\x00-\x7f]+)*")
#: A quoted garbled sequence without white space is a mention of it, not damage.
_MENTION = re.compile(r"`[^`\s]+`|“[^“”\s]+”|「[^「」\s]+」|[\"']�+[\"']")
_LOST = re.compile("�|锟斤|斤拷|[-](?=[㐀-鿿-])|(?<=[㐀-鿿])[-]|[\x80-\x84\x86-\x9f]")


@lru_cache(maxsize=1 << 16)
def char_cost(c: str) -> float:
    """Cost of a character: what ordinary prose uses is cheap, what misread bytes turn into is dear."""
    o = ord(c)
    if o < 0x80:
        return 0.0
    if o < 0xA0 or c == "�" or 0xE000 <= o <= 0xF8FF:
        return 6.0
    if c in _LATIN or c in _TYPO or c in _CJK_PUNCT:
        return 1.0
    if 0x4E00 <= o <= 0x9FFF:
        try:
            lead = c.encode("gb2312")[0]
        except UnicodeEncodeError:
            return 4.0
        return 1.0 if lead < 0xD8 else 3.0
    if 0x2500 <= o <= 0x257F:
        return 0.5
    if o >= 0x1F300 or 0xFF01 <= o <= 0xFF5E:
        return 1.5
    if 0x3040 <= o <= 0x30FF or 0xAC00 <= o <= 0xD7AF:
        return 2.0
    if o < 0x250 or c in "ˆ˜" or 0x370 <= o <= 0x52F or 0x2000 <= o <= 0x2BFF:
        return 2.0
    return 3.0 if o < 0xFFFF else 4.0


#: A symbol, a capital or a character of another script inside a word of small Latin letters.
#: The rare character is matched first and what stands before it afterwards, so plain text is passed over quickly.
_IN_WORD = re.compile(
    "(?:[^\x00-\x7f\\w’‘·\xad\u200b-\u200f…–—•、。，：；？！（）《》【】“”]|[ÀÂÄÁÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØÙÚÛÜÝΑ-Ωα-ωЀ-ӿ])(?<=[a-z].)(?=[a-zß-ÿ])"
    "|[㐀-鿿](?<=[a-z].)[㐀-鿿]?(?=[a-z\\s.,;:)]|$)|[½¼¾²³±≤≥∞∩≡\u2550-\u256c](?<!\\w.)(?=[a-zà-ÿ])",
    re.S,
)


#: Letters of one script side by side make a word, which costs no more than any other word; misread bytes seldom do.
_WORD = re.compile("(?<![a-zA-Z])(?:[Ͱ-Ͽἀ-῿]{2,}|[Ѐ-ԯ]{2,}|[぀-ヿ]{2,}|[가-힯]{2,})(?![a-zA-Z])")


def cost(text: str) -> float:
    word = sum(sum(map(char_cost, w)) - len(w) for w in _WORD.findall(text))
    return sum(map(char_cost, text)) - word + 3 * len(_IN_WORD.findall(text))


def _plain(c: str) -> bool:
    """May ``c`` be the result of a repair?"""
    return char_cost(c) <= 1.5 or c in "\xa0ªºµ½¼¾±²³¹´¨" or 0x370 <= ord(c) <= 0x52F or 0x2190 <= ord(c) <= 0x2BFF or 0x4E00 <= ord(c) <= 0x9FFF


_SCRIPTS = [(0x370, 0x3FF), (0x400, 0x52F), (0x590, 0x5FF), (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x3040, 0x30FF), (0xAC00, 0xD7AF)]


def _letter(c: str) -> bool:
    """A letter of another script that prose is written in."""
    return any(a <= ord(c) <= b for a, b in _SCRIPTS)


def _step(c: str) -> bool:
    """May ``c`` be an intermediate result, still misread once more?"""
    return c < "\xa0" or _plain(c) or char_cost(c) <= 2.0


class _Single:
    """The upper half of an encoding of one byte a character; unassigned bytes stand for themselves."""

    def __init__(self, name: str) -> None:
        high = [bytes([b]).decode(name, "replace") for b in range(0x80, 0x100)]
        chars = [chr(0x80 + i) if c == "�" else c for i, c in enumerate(high)]
        self.name, self.byte = name, {ord(c): 0x80 + i for i, c in enumerate(chars)}
        inside = "[" + "".join(re.escape(c) for c in chars) + "]"
        self.run = re.compile(f"{inside}+(?: {inside}+)*")

    def encode(self, text: str) -> bytes:
        byte = self.byte
        return bytes(byte.get(ord(c), 0x20) for c in text)


_SINGLES = [_Single(n) for n in SINGLE_BYTE]
_GAP = re.compile(rb"[\xe1-\xef][\x80-\xbf]\x20|[\xe1-\xef]\x20[\x80-\xbf]|[\xc3]\x20(?=[^\x20]|$)")


def _close_gap(m: re.Match) -> bytes:
    """A no-break space that was later turned into a space is taken back if it completes a common character."""
    whole = m.group().replace(b" ", b"\xa0")
    return whole if _UTF8.fullmatch(whole) and char_cost(whole.decode("utf-8")) <= 1.0 else m.group()


def _strict(raw: bytes) -> str | None:
    """``raw`` as UTF-8 if all of it is valid and plausible."""
    try:
        out = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if all(map(_step, out)):
        return out
    # several characters of another script don't come out as valid UTF-8 by chance
    return out if sum(map(_letter, out)) >= 2 and all(_step(c) or _letter(c) for c in out) else None


def _gbk(part: str, enc: _Single) -> str:
    """``part`` as GBK if that gives at least two characters, all of them common."""
    if len(part) < 4:
        return part
    try:
        out = enc.encode(part).decode("gbk")
    except UnicodeDecodeError:
        return part
    return out if len(out) >= 2 and all(char_cost(c) <= 1.0 for c in out) else part


def _by_single(text: str, enc: _Single) -> str:
    """``text`` with each run of ``enc``'s upper half that is misread UTF-8, or misread GBK, repaired."""

    def fix(m: re.Match) -> str:
        run = m.group()
        if len(run) < 2:
            return run
        raw = enc.encode(run)
        strict = _strict(raw)
        if strict is not None:
            return strict
        if enc.name in ("latin-1", "cp1252"):
            new = " ".join(_gbk(part, enc) for part in run.split(" "))
            if new != run:
                return new
        return _partial(run, raw) or run

    def _partial(run: str, raw: bytes) -> str | None:
        flat = _GAP.sub(_close_gap, raw) if _UTF8.search(raw) else raw
        pieces, at = [], 0
        for m in _UTF8.finditer(flat):
            c = m.group().decode("utf-8")
            if _plain(c):
                pieces += [run[at : m.start()], c]
                at = m.end()
        return "".join([*pieces, run[at:]]) if at else None

    return enc.run.sub(fix, text)


_PIECES = re.compile("(�+| )")


def _by_multi(text: str, wrong: str, right: str, lossy: list[str]) -> str:
    """``text`` with each non-ASCII run that ``wrong`` can hold strictly decoded as ``right``.

    A run that lost bytes before does not decode strictly: what decodes of it is taken, the rest becomes U+FFFD, and
    the encoding is noted in ``lossy``.
    """

    def fix(m: re.Match) -> str:
        run = m.group()
        beside = len(run) <= 2 and text[m.start() - 1 : m.start()].isalpha()
        if not beside and not _SUSPECT.search(run):
            return run
        out = []
        for part in _PIECES.split(run):
            if not part or part[0] in "� ":
                out.append(part)
                continue
            try:
                raw = part.encode(wrong)
            except UnicodeEncodeError:
                return run
            try:
                out.append(raw.decode(right))
            except UnicodeDecodeError:
                out.append(raw.decode(right, "replace"))
        new = "".join(out)
        if right == "utf-8":
            new = re.sub("�{2,}", "�", new)
        lost, kept = new.count("�"), [c for c in new if c > "\x7f" and c != "�"]
        if not kept or any(not (_plain(c) or _letter(c)) for c in kept):
            return run
        if lost > 0.4 * len(kept) + run.count("�") or sum(char_cost(c) <= 1.0 or _letter(c) for c in kept) < 0.8 * len(kept):
            return run
        in_word = beside and all(c in _LATIN for c in new if c > "\x7f")
        if not in_word and cost(new) >= cost(run):
            return run
        if lost > run.count("�"):
            lossy.append(f"{wrong}>{right}")
        return new

    return _RUN.sub(fix, text)


#: Encodings of one byte a character through which a Latin-1 text is misread: their upper half to that of cp1252.
_LATIN_MISREAD = {}
for _n in ("mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp1250"):
    _half = [(bytes([b]).decode(_n, "replace"), bytes([b]).decode("cp1252", "replace")) for b in range(0x80, 0x100)]
    _LATIN_MISREAD[_n] = {ord(w): r for w, r in _half if w != r and "�" not in (w, r)}


def _latin_by_single(text: str, wrong: str) -> str:
    """Lines of a Latin text in which symbols stand inside words, read as cp1252 instead; a line as a whole or not at all."""
    if not _IN_WORD.search(text):
        return text
    if "\n" in text:
        return "\n".join(_latin_by_single(line, wrong) for line in text.split("\n"))
    table = _LATIN_MISREAD[wrong]
    new = text.translate(table)
    if any(ord(a) in table and not (b in _LATIN or b in _TYPO or b == "\xa0") for a, b in zip(text, new)):
        return text
    return new if cost(new) < cost(text) else text


_HAN_IN_WORD = re.compile(r"(?<=[a-zA-Z])[㐀-鿿-]{1,2}(?=[a-zA-Z\s.,;:�]|$)|(?:(?<=[\s\"«(])|^)[㐀-鿿-]{1,2}(?=[a-z])")


def _latin_by_gbk(text: str) -> str:
    """Latin text misread as GBK: a Chinese character inside a word stands for two Latin letters."""

    def fix(m: re.Match) -> str:
        try:
            out = m.group().encode("gbk").decode("cp1252")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m.group()
        return out if all(c.isalpha() or c in " «»¿¡’" for c in out) and all(c < "\x80" or c in _LATIN or c in _TYPO for c in out) and any(c.isascii() or c.islower() for c in out) else m.group()

    return _HAN_IN_WORD.sub(fix, text)


_LEVEL_1 = "".join(bytes([a, b]).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF))
_SMALL = "".join(c for c in _LATIN if c.islower())
_LARGE = "".join(c for c in _LATIN if c.isupper())
#: A character outside ordinary prose and drawn trees; a capital before another character of more than one byte, as
#: the first byte of two gives; a small letter before two such, as the first of three gives; a branch without its line.
_SUSPECT = re.compile(f"[^\x00-\x7f{_LEVEL_1}│├└─{re.escape(_TYPO + _CJK_PUNCT)}{_LATIN}]|[{_LARGE}][^\x00-\x7f]|[{_SMALL}][^\x00-\x7f]{{2}}|├[^─\\s]")


def _suspect(text: str) -> bool:
    return bool(_SUSPECT.search(text) or _IN_WORD.search(text))


def _split(text: str, every: bool = False) -> tuple[list[str], list[str]]:
    """The parts of ``text`` to be repaired, and the mentions between them.

    In misread text quotation marks may be misread bytes, and what stands between backticks is as garbled as the
    rest.  So a mention is kept only on a line without damage of a text that has intended characters as well;
    ``every`` keeps all of them, to see whether there is damage at all.
    """
    mentions = [m for m in _MENTION.finditer(text) if not m.group().isascii()]
    if mentions and not every:
        bare = _MENTION.sub(lambda m: m.group() if m.group().isascii() else "\0" * len(m.group()), text)
        damaged, intended, at = [], False, 0
        for line in bare.split("\n"):
            if not line.isascii():
                if _suspect(line):
                    damaged.append((at, at + len(line)))
                else:
                    intended = True
            at += len(line) + 1
        mentions = [m for m in mentions if not any(a <= m.start() < b for a, b in damaged)] if intended else [] if damaged else mentions
    parts, at = [], 0
    for m in mentions:
        parts.append(text[at : m.start()])
        at = m.end()
    return [*parts, text[at:]], [m.group() for m in mentions]


def _joined(parts: list[str], kept: list[str]) -> str:
    return "".join(x for pair in zip(parts, [*kept, ""]) for x in pair)


def repair(text: str | None) -> tuple[str, bool, bool, int, float, float, str, str] | None:
    """Repaired text, whether it changed, whether something is lost, layers, cost before and after, encodings, evidence.

    None for a text that is not affected.
    """
    if not text or text.isascii():
        return None
    body, quoted = _split(text, every=True)
    if not any(map(_suspect, body)) and "斤拷" not in text:
        return None
    lost = any(_LOST.search(p) for p in body)
    names: list[str] = []
    lossy: list[str] = []
    layers, multi_done = 0, False
    fixed = text
    while True:  # each layer lowers the cost by 1 at least, so this ends
        now, kept = _split(fixed)
        if layers and quoted and not any(map(_suspect, _split(fixed, every=True)[0])):
            break  # what is left is quoted
        best, best_cost, name, base = None, sum(map(cost, now)), "", sum(map(cost, now))
        for enc in _SINGLES:
            new = [p if p.isascii() else _by_single(p, enc) for p in now]
            if new != now and (c := sum(map(cost, new))) < best_cost:
                best, best_cost, name = new, c, enc.name
        for wrong in _LATIN_MISREAD:
            new = [p if p.isascii() else _latin_by_single(p, wrong) for p in now]
            if new != now and (c := sum(map(cost, new))) < best_cost:
                best, best_cost, name = new, c, f"{wrong}>cp1252"
        if not multi_done and any(map(_suspect, now)):
            for wrong in MULTI_BYTE:
                for right in ("utf-8", "gbk"):
                    if right == "gbk" and wrong == "gb18030":
                        continue
                    new = [p if p.isascii() else _by_multi(p, wrong, right, lossy) for p in now]
                    if new != now and (c := sum(map(cost, new))) < best_cost:
                        best, best_cost, name = new, c, f"{wrong}>{right}"
            new = [p if p.isascii() else _latin_by_gbk(p) for p in now]
            if new != now and (c := sum(map(cost, new))) < best_cost:
                best, best_cost, name = new, c, "gbk>cp1252"
        if best is None or best_cost > base - 1.0:
            break
        fixed, layers, multi_done = _joined(best, kept), layers + 1, multi_done or name.split(">")[0] in MULTI_BYTE or name.startswith("gbk")
        names.append(name)
    if not layers and not lost:
        return None
    left, spans = _split(fixed, every=True)
    gone = any(_LOST.search(p) for p in [*left, *(m for m in spans if m not in quoted)])
    evidence = "marker" if not layers else "round trip with loss" if set(names) & set(lossy) else "round trip"
    return fixed, layers > 0, gone, layers, round(cost(text), 1), round(cost(fixed), 1), ",".join(names), evidence


#: Columns of ``repaired``.
REPAIRED = "doc_id bigint, repaired string, changed boolean, lost boolean, layers int, cost_before double, cost_after double, encodings string, evidence string"


def repaired(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each affected document: the restored text and what is known about the damage.

    ``changed`` tells whether something was restored, ``lost`` whether damage remains that no encoding undoes,
    ``evidence`` whether a strict round trip shows the damage, one of runs that had lost bytes before, or only the
    marks that a lossy decoding leaves.
    Texts without damage, null and empty texts give no row.
    """

    def run(ids: list, texts: list) -> list[tuple]:
        return [(i, *r) for i, t in zip(ids, texts) if (r := repair(t)) is not None]

    source = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows_by_batch(source.where("text is not null and octet_length(text) > char_length(text)"), REPAIRED, run)


def found(documents: DataFrame) -> DataFrame:
    """Ids of the affected documents, every repeated copy included."""
    return repaired(documents).select("doc_id")
