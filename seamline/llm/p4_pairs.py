"""Problem 4: defective answers to prompts.

Method: several noisy labelling functions vote for or against each defect of an answer, or abstain.  For each
defect an expectation-maximization label model estimates, from the agreement of the votes alone, how reliable
each function is and how frequent the defect; an answer keeps every defect whose posterior exceeds the
cutoff of that defect.  The model is fitted on the counts of the vote patterns of all answers, at most
3 to the number of functions of a defect, so what the driver sees does not grow with the data.

Texts are read once, in one map behind the join of answers and prompts; the votes are written to the shared
folder and everything after works on them.  What only a prompt decides is worked out once for its content and summary,
and a pattern is tried only where a text has the words or signs without which it cannot match.

Defined cases: a null prompt leaves only the defects that need none; a null answer is an empty answer; a
summary is judged only where action_count > 0.  Redelivered rows are reported once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from hashlib import md5
from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import p3_truncation as p3
from .common import cut, rows_by_batch

DEFECTS = ("empty_answer", "copies_question", "refusal", "truncated_answer", "wrong_language")
#: Posterior beyond which a defect is kept: chosen on one half of planted pairs and checked on the other
#: (tests/llm/test_pairs_cutoffs.py).
CUTOFFS = {"empty_answer": 0.8, "copies_question": 0.6, "refusal": 0.8, "truncated_answer": 0.5, "wrong_language": 0.8}
#: Votes of each defect, in the order of the functions below.
FUNCTIONS = {
    "empty_answer": ("blank", "nothing_but_marks", "stands_for_nothing", "has_words"),
    "copies_question": ("little_left", "same_grams", "same_length", "own_words"),
    "refusal": ("phrase", "no_other_sentence", "mostly_refusal", "tells_something"),
    "truncated_answer": ("ends_inside", "marked", "longer_copy", "last_character"),
    "wrong_language": ("by_script", "by_stopwords", "by_majority"),
}

# --- languages ---------------------------------------------------------------------------------------------

_STOPWORDS = {
    "en": "the and is are that this with for its it of to in you can when before after from which there not one so be as was has by than then into only both if on nothing first".split(),
    "de": "der die das und ist nicht mit für von den dem ein eine einen auf wird werden zu im in aus bitte zuerst denn wenn nach auch bleibt es sich noch dass habe nur vor hängt kurz müssen wir ob muss davon keine".split(),
    "fr": "le la les et est pas pour dans une un des du de que qui avec sur vers par n’ ne il elle ce cette au aux sont plus puisque car donc seulement dès lorsque toujours si étaient désormais depuis à afin".split(),
    "es": "el la los las y es no para en una un del de que con por se al lo más ya pero si antes después ahora está sus porque aún".split(),
    "pt": "o a os as e é não para em uma um do da de que com por se ao mais já mas se antes depois agora está dos das na no pois ainda também".split(),
}
#: What a function word counts for: one, shared by the languages that have it.
_WEIGHTS = {w: [(k, 1 / len(of)) for k in of] for v in _STOPWORDS.values() for w in v for of in [[k for k, u in _STOPWORDS.items() if w in u]]}
_NAMES = {
    "en": r"english|englisch|anglais|inglés|inglês|英语|英文",
    "de": r"german|deutsch|allemand|alemán|alemão|德语|德文",
    "fr": r"french|französisch|français(?:e)?|francés|francês|法语|法文",
    "zh": r"chinese|chinesisch|chinois|chino|chinês|中文|汉语|普通话",
    "es": r"spanish|spanisch|espagnol|español|espanhol|西班牙语",
    "pt": r"portuguese|portugiesisch|portugais|portugués|português|葡萄牙语",
}
_ASKS = r"(?:answer|reply|respond|write|antwort\w*|schreib\w*|répond\w*|écri\w*|respond\w*|contest\w*|回答|回复|答复|写|用)"
_REQUESTED = {k: re.compile(rf"(?i){_ASKS}[^.。!?！？\n]{{0,24}}(?:{v})|(?:用|写成|使用)\s*(?:{v})|(?:\b(?:in|auf|en|em)\s+)(?:{v})\s*,?\s*(?:please|bitte|s.il|por favor|$)") for k, v in _NAMES.items()}
#: A request for a language has one of its names.
_NAMED = {k: tuple(v.replace("(?:e)?", "").split("|")) for k, v in _NAMES.items()}
#: Code, quotations, tags, paths and names, in the order they are tried, each with a sign that it has.
_CODE = (
    ("`", r"```.*?(?:```|\Z)"), ("~", r"~~~.*?(?:~~~|\Z)"), ("`", r"`[^`\n]*`"), (">", r"^>.*?$"), ("“", r"“[^”\n]*”"), ("„", r"„[^“\n]*“"), ("«", r"«[^»\n]*»"), ("<", r"<[^>\n]*>"),
    ("/", r"(?<![\w.\-])[\w.\-]*+(?:/[\w.\-]+)+"), ("_", r"\b\w+_\w+\b"),
)
_SIGNS = tuple(dict.fromkeys(sign for sign, _ in _CODE))


@cache
def _code(signs: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(pattern for sign, pattern in _CODE if sign in signs), re.M | re.S)


def prose(text: str) -> str:
    """``text`` without code, quotations, tags, paths and names."""
    signs = tuple([sign for sign in _SIGNS if sign in text])
    return _code(signs).sub(" ", text) if signs else text


def _folded(text: str) -> str:
    """``text`` in lower case, and in it every letter that a pattern without case takes for an ASCII one as that one."""
    return text.lower() if text.isascii() else text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


#: Languages that their script tells, and a share of Chinese characters that each may stand among.
_SCRIPTS = {"ja": re.compile(r"[ぁ-ヿ]"), "ko": re.compile(r"[가-힯]"), "ru": re.compile(r"[Ѐ-ӿ]"), "el": re.compile(r"[Ͱ-Ͽ]"), "ar": re.compile(r"[؀-ۿ]"), "hi": re.compile(r"[ऀ-ॿ]"), "th": re.compile(r"[฀-๿]")}
_ANY_SCRIPT = re.compile("|".join(p.pattern for p in _SCRIPTS.values()).replace("]|[", ""))
_HAN, _LATIN = re.compile(r"[一-鿿]+"), re.compile(r"[A-Za-zÀ-ÿ’]+")
#: Letters, and beginnings and ends of words, that tell a Latin language; no two of a language share a character.
_LETTERS = {"de": "äöüß", "fr": ("é", "è", "ê", "à", "ç", "ù", "œ", "l’", "d’", "n’", "s’", "q’", "j’"), "es": "ñáíóú¿¡", "pt": "ãõ"}
_SHAPES = [(k, w, re.compile(p)) for k, w, p in (("de", "sch", r"sch(?<!\wsch)"), ("de", "ung", r"ung\b"), ("de", "lich", r"lich\b"), ("en", "ing", r"ing\b"), ("en", "th", r"th(?<!\wth)"), ("en", "’s", r"’s\b"), ("en", "’t", r"’t\b"))]


def languages(text: str) -> tuple[str | None, str | None]:
    """Language of the prose of ``text`` by script and by function words; None where there is too little."""
    return _languages(prose(text))


def _languages(words: str) -> tuple[str | None, str | None]:
    plain = words.isascii()
    if not plain and _ANY_SCRIPT.search(words):
        letters = len(re.findall(r"[A-Za-zÀ-ÿ]", words))
        for lang, pattern in _SCRIPTS.items():
            n = len(pattern.findall(words))
            if n >= 4 and n > letters and 5 * n >= len(re.findall(r"[一-鿿]", words)):
                return lang, lang
    han, latin = 0 if plain else sum(map(len, _HAN.findall(words))), _LATIN.findall(words)
    script = None
    if han + len(latin) >= 3:
        script = "zh" if han >= 2 * len(latin) and han >= 3 else "latin" if len(latin) > han and len(latin) >= 3 else None
    if script != "latin":
        return script, script
    score = dict.fromkeys(_STOPWORDS, 0.0)
    for w in " ".join(latin).lower().split(" "):
        if w in _WEIGHTS:
            for k, weight in _WEIGHTS[w]:
                score[k] += weight
    low = words.lower()
    seen = dict.fromkeys(_STOPWORDS, 0)
    if not plain:
        for k, parts in _LETTERS.items():
            seen[k] = sum(map(low.count, parts))
    for k, part, pattern in _SHAPES:
        if part in low:
            seen[k] += len(pattern.findall(low))
    first, second = sorted(((score[k] + 0.5 * n, k) for k, n in seen.items()), reverse=True)[:2]
    return script, first[1] if first[0] >= 1 and first[0] >= 1.4 * second[0] else None


@lru_cache(maxsize=2)
def expected_language(prompt: str) -> str | None:
    """The language a prompt asks for, else the one it is written in."""
    low = _folded(prompt)
    asked = [(m.end(), k) for k, p in _REQUESTED.items() if any(map(low.__contains__, _NAMED[k])) for m in p.finditer(prompt)]
    if asked:
        return max(asked)[1]
    script, lang = languages(prompt)
    return lang


# --- labelling functions: 1 for the defect, -1 against it, 0 no opinion ------------------------------------

_MARKS = re.compile(r"[\W_]*(?:<[^>]*>[\W_]*|```\w*[\W_]*)*\Z")
_VOID = re.compile(r"(?i)[\W_]*(?:n\s*/\s*a|none|null|nil|nan|undefined|todo|tbd|empty|blank|nothing|void|no (?:answer|content|response|data|summary)|无|没有|暂无|空|待补充|待定|keine?|leer|entfällt|aucune?|néant|vide|rien|ninguno|nada|vacío|nenhum|vazio)[\W_]*\Z")


#: The ASCII characters that are no letters or digits.
_ASCII_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_NO_LETTERS, _LETTER = re.compile(r"[\W_]+"), re.compile(r"[^\W_]")


def _normal(text: str) -> str:
    if text.isascii():
        return text.encode().translate(None, _ASCII_MARKS).lower().decode()
    return _NO_LETTERS.sub("", text).casefold()


_TAGS, _SHOWN = re.compile(r"<[^>]*>|```\w*"), re.compile(r"[^\s\u200b-\u200f\u2060\ufeff]")


def _empty(text: str | None) -> tuple[int, ...]:
    t = text or ""
    body = _TAGS.sub("", t) if "<" in t or "```" in t else t
    bare = not _LETTER.search(body)
    void = bool(_VOID.fullmatch(body)) or body is not t and bool(_VOID.fullmatch(t))
    blank = not _SHOWN.search(t)
    has = not bare and not void
    return (1 if blank else 0 if bare or void else -1), (1 if bare else 0 if void else -1), (1 if void or bare else -1), (-1 if has else 1)


@lru_cache(maxsize=2)
def _asked(prompt: str) -> tuple[str, frozenset[str]]:
    """What a prompt says, and the runs of five characters in that."""
    q = _normal(prompt)
    return q, frozenset([q[i : i + 5] for i in range(len(q) - 4)])


def _own(grams: frozenset[str], t: str) -> tuple[int, int]:
    """The runs of five characters of ``t`` that are not ``grams``, and all; counted as far as they can decide anything."""
    n, own = max(1, len(t) - 4), 0
    for i in range(0, n, 64):
        runs = [t[k : k + 5] for k in range(i, min(n, i + 64))]
        own += len(runs) - sum(map(grams.__contains__, runs))
        if own > 45 and own / n > 0.5:
            break
    return own, n


def _copies(prompt: str | None, text: str) -> tuple[int, ...]:
    (q, grams), t = _asked(prompt or ""), _normal(text)
    if not q or not t:
        return 0, 0, 0, 0
    if len(q) < 8:  # too short for grams: nothing but the prompt itself copies it
        same = 1 if t == q else -1
        return same, same, 1 if len(t) == len(q) else -1, same
    left = t.replace(q, "")
    lead = len(left) <= 24
    own, runs = _own(grams, t)
    strange = own / runs
    ratio = len(t) / len(q)
    return (
        1 if q in t and lead else -1 if q not in t or len(left) > 60 else 0,
        1 if strange <= 0.12 + 20 / len(t) and strange < 0.5 else -1 if strange > 0.4 else 0,
        1 if 0.7 <= ratio <= 1.5 or (ratio > 1.5 and len(left) <= 24) else -1 if ratio > 2.2 or ratio < 0.4 else 0,
        -1 if own > 45 else 1 if own <= 30 else 0,
    )


#: What declines, with words of which a text that does has one; in the languages above.
_CANNOT = [
    (words.split("|"), re.compile("(?i)" + pattern))
    for words, pattern in (
        (
            "cannot|can't|can’t|can not|won't|won’t|will not|unable|not able|not allowed|not permitted|decline|refuse|not in a position|rather not|prefer not|outside of what i|not something i can|guidelines do|policy do|policies do",
            r"\bI(?:'|’)?(?:m| am| have| must|ll| will| would)?\b[^.!?\n]{0,40}\b(?:can(?:no|'|’)t|can not|won(?:'|’)t|will not|unable|not able|not allowed|not permitted|decline|refuse|not in a position)\b"
            r"|\bI (?:can(?:no|'|’)t|can not|won(?:'|’)t|must decline|have to decline|must refuse|refuse)\b|\bI(?:(?:'|’)d| would) (?:rather|prefer) not\b|\bsomething I cannot\b|outside of what I|\bnot something I can\b|\b(?:my )?(?:guidelines|policy|policies) do(?:es)? not (?:permit|allow)",
        ),
        (
            "无法|不能|没有办法|没办法|不便|拒绝|不可以|超出",
            r"(?:抱歉|对不起|很遗憾|恕|作为(?:一[个名])?(?:助手|AI|人工智能))[^。！？\n]{0,20}(?:无法|不能|没有办法|没办法|不便|拒绝|不可以)|我[^。！？\n]{0,8}(?:无法|没有办法|不便|拒绝)[^。！？\n]{0,10}(?:帮助|协助|回答|完成|提供|请求|操作|处理)|超出[^。！？\n]{0,3}我[^。！？\n]{0,12}范围",
        ),
        (
            "nicht|ablehnen|verweigern|absagen",
            r"\b(?:kann|darf|werde|möchte)\s+(?:ich|dabei|das|dies\w*|Ihnen|dir)\b[^.!?\n]{0,50}\bnicht\b|\bich\s+(?:kann|darf|werde|muss)\b[^.!?\n]{0,60}\b(?:nicht|ablehnen|verweigern)\b|\bmuss ich\b[^.!?\n]{0,40}\b(?:ablehnen|verweigern|absagen)\b",
        ),
        (
            "je ne |refuser|décliner|est impossible",
            r"\bje ne (?:peux|puis|suis)\b[^.!?\n]{0,20}\bpas\b|\bje (?:dois|suis)\b[^.!?\n]{0,40}\b(?:refuser|décliner)\b|\bil m.est impossible\b",
        ),
        (
            "no puedo|no podemos|no me es posible",
            r"\bno (?:puedo|podemos|me es posible)\b[^.!?\n]{0,30}\b(?:ayudar|responder|realizar|hacer|completar|cumplir|atender|proporcionar|ejecutar)\w*",
        ),
        (
            "não posso|não podemos",
            r"\bnão (?:posso|podemos)\b[^.!?\n]{0,30}\b(?:ajudar|responder|realizar|fazer|concluir|atender|fornecer|executar)\w*",
        ),
    )
]
_POLITE = re.compile(
    r"(?i)\b(?:hope you understand|let me know|something else you need|(?:please )?ask (?:a|your|the)|contact|usage rules|guidelines|violate|policy|not able to do that|outside of)\b|希望你|希望您|能理解|如果有其他|请告诉我|建议联系|请联系|违反|规范|谅解"
    r"|\b(?:Verständnis|wenden Sie sich|melden Sie sich|Richtlinien|verstößt|gegen die)\b|\b(?:compréhension|adressez-vous|contactez|règles d.utilisation|n.hésitez pas|hors de mon)\b|\b(?:comprensión|contacte|compreensão)\b"
)
#: A polite sentence has one of these.
_POLITE_WORDS = (
    "hope you understand|let me know|something else you need|ask a|ask your|ask the|contact|usage rules|guidelines|violate|policy|not able to do that|outside of|希望你|希望您|能理解|如果有其他|请告诉我|建议联系|请联系|违反|规范|谅解"
    "|verständnis|wenden sie sich|melden sie sich|richtlinien|verstößt|gegen die|compréhension|adressez-vous|contactez|règles d|hésitez pas|hors de mon|comprensión|contacte|compreensão"
).split("|")
_ABOUT = re.compile(r"^\s*(?:about|regarding|re|zu|bezüglich|à propos de|concernant|关于|sobre)\s*[:：]?\s*`?[^`:：\n]{1,80}`?\s*[:：]\s*", re.I)


_SENTENCE_END, _PROSE_END = re.compile(r"[.!?]\s+|[。！？]|\n+"), re.compile(r"[.!?。！？]\s*|\n+")
_NAME = re.compile(r"`[^`\n]+`|\w+/\w+|```")


def _sentences(text: str, end: re.Pattern) -> Iterator[str]:
    """``text`` cut behind the sentence ends that ``end`` finds, and at line ends, without the white space there."""
    at = 0
    for m in end.finditer(text):
        stop = m.start()
        yield text[at : stop if text[stop] == "\n" else stop + 1]
        at = m.end()
    yield text[at:]


def _refusal(text: str) -> tuple[int, ...]:
    about = _ABOUT.match(text)
    body = text[about.end() :] if about else text
    if not _LETTER.search(body):
        return 0, 0, 0, 0
    low = _folded(body)
    patterns = [pattern for words, pattern in _CANNOT if any(map(low.__contains__, words))]
    polite = any(map(low.__contains__, _POLITE_WORDS))
    cannot: list[bool] = []
    told = other = rest = 0
    for s in _sentences(body, _SENTENCE_END):
        if n := len(_normal(s)):
            declines = any(p.search(s) for p in patterns)
            cannot.append(declines)
            if declines or polite and _POLITE.search(s):
                other += n
            else:
                told, rest = told + n, rest + 1
                if told > 40 and not patterns:
                    break  # nothing declines, and enough is told
    names = ("`" in body or "/" in body) and bool(_NAME.search(body))
    if not any(cannot):
        return -1, -1 if told > 40 else 0, -1, -1 if names and rest else 0
    share = 1 - told / max(1, told + other)
    return (
        1 if any(cannot[:2]) else 0,
        1 if not rest else -1 if told > 40 else 0,
        1 if share >= 0.5 else -1 if share < 0.2 else 0,
        -1 if names and rest else 1 if not names else 0,
    )


#: Last characters that complete answers have, what may stand behind them, and those that none has; a letter may be either.
_CLOSED, _BEHIND, _HANGING = frozenset(".!?。！？…`>|}]"), "\"”’»“」』*_)）", frozenset(",，、;；([{（„«/\\=+-")


def _truncated(text: str) -> tuple[tuple[int, ...], str]:
    """Votes by the structure of the end, by a mark behind it, by longer copies (put in later) and by the last character."""
    how, base, marked = p3.end_of(text)
    shown = text.rstrip()
    last = -1 if shown.rstrip(_BEHIND)[-1:] in _CLOSED else 1 if shown[-1:] in _HANGING else 0
    return (1 if how == p3.CUT else 0 if how == p3.OPEN else -1, 1 if marked else 0, 0, last), base if how == p3.OPEN else ""


def _language(prompt: str | None, text: str) -> tuple[int, ...]:
    want = expected_language(prompt or "")
    if want is None:
        return 0, 0, 0
    words = prose(text)
    script, lang = _languages(words)
    if script is None:
        return 0, 0, 0
    wanted_script = want if want == "zh" or want in _SCRIPTS else "latin"
    by_script = 1 if script != wanted_script else 0 if script == "latin" else -1
    by_words = 0 if lang is None else 1 if lang != want else -1
    # every sentence by itself: the majority of those with an opinion
    votes = [lg for s in _sentences(words, _PROSE_END) if (lg := languages(s)[1])]
    same = sum(v == want for v in votes)
    majority = 0 if not votes or 2 * same == len(votes) else -1 if 2 * same > len(votes) else 1
    return by_script, by_words, majority


VOTES = "response_id bigint, field_name string, digest string, probe string, " + ", ".join(f"{d} array<tinyint>" for d in DEFECTS)


def votes(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The votes on every answer; ``probe`` is its text where any longer copy tells that it was cut."""

    def run(ids: list, prompts: list, contents: list, counts: list, summaries: list) -> Iterator[tuple]:
        for i, prompt, content, count, summary in zip(ids, prompts, contents, counts, summaries):
            for field, text in (("content", content), ("proposal_summary", summary)):
                if field == "content" or (count or 0) > 0:
                    empty, t = _empty(text), text or ""
                    if empty[-1] > 0:
                        yield i, field, "", "", empty, (0, 0, 0, -1), (-1, -1, 0, 0), (-1, 0, 0, -1), (0, 0, 0)
                    else:
                        ends, probe = _truncated(t)
                        yield i, field, md5(t.encode("utf-8", "surrogatepass")).hexdigest(), probe, empty, _copies(prompt, t), _refusal(t), ends, _language(prompt, t)

    asked = requests.select(F.col("request_id").cast("bigint").alias("asked_id"), F.col("prompt").cast("string").alias("prompt")).where("asked_id is not null").groupBy("asked_id").agg(F.max("prompt").alias("prompt"))
    # answers without a request get keys of their own, which no request has, so they don't meet in one task
    key = F.coalesce(F.col("request_id").cast("bigint"), -1 - F.col("response_id").cast("bigint"))
    given = responses.select(F.col("response_id").cast("bigint").alias("response_id"), key.alias("key"), F.col("content").cast("string").alias("content"), F.col("action_count").cast("int").alias("action_count"), F.col("proposal_summary").cast("string").alias("proposal_summary"))
    joined = given.join(asked, given["key"] == asked["asked_id"], "left").select("response_id", "prompt", "content", "action_count", "proposal_summary")
    return rows_by_batch(joined, VOTES, run).dropDuplicates(["response_id", "field_name"])


#: An open end this short is not decided by any longer copy but by how that goes on.
LEAST_PROBE = {"content": 20, "proposal_summary": 6}


def with_copies(seen: DataFrame, responses: DataFrame) -> DataFrame:
    """``seen`` with the vote of the prefix self-join in place: every answer is a probe among those of its field."""
    content = F.col("field_name") == "content"
    group, least = F.when(content, 0).otherwise(1), F.when(content, LEAST_PROBE["content"]).otherwise(LEAST_PROBE["proposal_summary"])
    probes = seen.where(F.length("probe") >= least).select(F.col("probe").alias("base"), F.lit(0).alias("mode"), group.alias("group"))
    fields = F.array(*[F.struct(F.lit(k).alias("group"), F.col(f).cast("string").alias("value")) for k, f in enumerate(("content", "proposal_summary"))])
    texts = responses.select(F.inline(fields)).where("value <> ''").select("value", F.lit(p3.MODES[None]).alias("mode"), "group")
    longer = cut(p3.prefixes(probes, texts))  # few keys, read by two joins
    own = longer.where("key like '%=%'").select(F.col("key").alias("own_key"))
    other = longer.where("key like '%~%'").select(F.col("key").alias("probe_key"))
    joined = seen.join(own, F.format_string(f"%d=%s/{p3.MODES[None]}", group, "digest") == F.col("own_key"), "left").join(other, p3.probe_key(group, "probe", F.lit(0)) == F.col("probe_key"), "left")
    vote = F.when(F.col("own_key").isNotNull() | F.col("probe_key").isNotNull(), 1).when(F.col("digest") == "", 0).otherwise(-1).cast("tinyint")
    v = F.col("truncated_answer")
    return joined.withColumn("truncated_answer", F.array(v[0], v[1], vote, v[3])).drop("own_key", "probe_key", "probe", "digest")


# --- the label model ---------------------------------------------------------------------------------------


#: What a function is taken for at the start, where not for START: P(it votes for the defect | defect), P(.. | none).
#: That no longer copy exists says little; a grammar is seldom wrong about an end.
START, STARTS = (0.9, 0.04), {"longer_copy": (0.3, 0.002), "ends_inside": (0.95, 0.005)}


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, names: tuple[str, ...] = ()) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each vote pattern, by expectation-maximization over their counts.

    Each function (``names``) has a table P(vote | defect or not, it votes), started as in ``STARTS`` and smoothed by
    a pseudo-count of a share of all answers, so that a function that never fires keeps its start.
    An abstention says nothing: without any vote the posterior is the frequency of the defect.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return {}
    width = len(patterns[0][0])
    begin = [STARTS.get(names[j], START) if names else START for j in range(width)]
    starts = [{1: {1: a, -1: 1 - a}, 0: {1: b, -1: 1 - b}} for a, b in begin]
    tables = [{y: dict(start[y]) for y in (0, 1)} for start in starts]
    prior = 0.05
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes_, _n in patterns:
            odds = log(prior / (1 - prior)) + sum(log(t[1][v] / t[0][v]) for t, v in zip(tables, votes_) if v)
            post[votes_] = 1 / (1 + exp(-max(-50.0, min(50.0, odds))))
        mass = sum(post[v] * n for v, n in patterns)
        prior = min(0.4, max(1e-4, (mass + 0.5) / (total + 10)))
        for j in range(width):
            for y in (0, 1):
                weight = 0.02 * total * (prior if y else 1 - prior) + 1.0
                sums = {k: weight * starts[j][y][k] for k in (1, -1)}
                for v, n in patterns:
                    if v[j]:
                        sums[v[j]] += n * (post[v] if y else 1 - post[v])
                whole = sum(sums.values())
                tables[j][y] = {k: min(1 - 1e-4, max(1e-4, s / whole)) for k, s in sums.items()}
            # a function stays what it is: a vote for a defect is likelier under it than without it
            if tables[j][1][1] < tables[j][0][1]:
                mean = (tables[j][0][1] + tables[j][1][1]) / 2
                for y in (0, 1):
                    tables[j][y] = {1: mean, -1: 1 - mean}
    return post


LABELS = "response_id bigint, field_name string, defect string, posterior double"


def labels(requests: DataFrame, responses: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """Every defect of every answer whose posterior exceeds its cutoff."""
    spark = responses.sparkSession
    cutoffs = CUTOFFS | (cutoffs or {})
    seen = cut(votes(requests, responses))  # the texts are read for this alone; the self-join reads it twice
    seen = cut(with_copies(seen, responses))
    long = seen.select("response_id", "field_name", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in DEFECTS])).alias("x")).select("response_id", "field_name", "x.defect", "x.votes")
    counts = long.groupBy("defect", "votes").count().collect()  # at most 3 ** functions rows a defect
    rows = []
    for d in DEFECTS:
        post = fit([(tuple(r["votes"]), r["count"]) for r in counts if r["defect"] == d], names=FUNCTIONS[d])
        rows += [(d, list(v), p) for v, p in post.items() if p > cutoffs[d]]
    known = spark.createDataFrame(rows, "defect string, votes array<tinyint>, posterior double")
    return long.join(F.broadcast(known), ["defect", "votes"]).select("response_id", "field_name", "defect", "posterior")


def found(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One defect for each defective answer: the first in the order of ``DEFECTS``, which explains the others."""
    order = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    best = labels(requests, responses).groupBy("response_id", "field_name").agg(F.min_by("defect", order).alias("defect"))
    return best.select("response_id", "field_name", "defect")


def summary(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Defects by source and field, with all labels kept."""
    source = responses.select(F.col("response_id").cast("bigint").alias("id"), F.col("source").cast("string").alias("source")).groupBy("id").agg(F.min("source").alias("source"))
    kept = labels(requests, responses)
    return kept.join(source, kept["response_id"] == source["id"], "left").groupBy("source", "field_name", "defect").agg(F.count("*").alias("answers"), F.round(F.avg("posterior"), 6).alias("mean_posterior"))
