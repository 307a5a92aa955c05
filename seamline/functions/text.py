"""Column functions on text: JVM-side expressions that stay inside code generation where Spark allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

C = str | Column


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_empty(x: C) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def strip(x: C) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def canonical(x: C) -> Column:
    """Line feeds only, stripped: two texts are the same change if this is equal."""
    return strip(F.regexp_replace(blank_to_empty(x), "\r\n?", "\n"))


def holds_any(x: C, words: Sequence[str]) -> Column:
    """Does the lower-case, stripped text contain one of ``words``?  False for null."""
    low = F.lower(strip(blank_to_empty(x)))
    return _any(low, words)


def _any(low: Column, words: Sequence[str]) -> Column:
    """Does the text contain one of the words?  One pattern of quoted words, so the plan stays small."""
    return low.rlike("|".join(f"\\Q{w}\\E" for w in words))


def holds_any_as_is(x: C, words: Sequence[str]) -> Column:
    return _any(F.lower(blank_to_empty(x)), words)


def excerpt(x: C, chars: int = fixed.EXCERPT_CHARS, mark: str = fixed.EXCERPT_MARK) -> Column:
    """Stripped text, cut at ``chars`` characters with a mark behind the cut."""
    t = strip(x)
    return F.when(F.length(t) <= chars, t).otherwise(F.concat(F.substring(t, 1, chars), F.lit(mark)))


def lines(x: C) -> Column:
    """Lines of a text; none for an empty one."""
    t = F.regexp_replace(blank_to_empty(x), "\r\n?", "\n")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))


def line_count(x: C) -> Column:
    t = canonical(x)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "\n", -1)))


# --- paths -------------------------------------------------------------------------------------------------


def slashed(x: C) -> Column:
    return F.translate(_c(x), "\\", "/")


def file_name(x: C) -> Column:
    return F.element_at(F.split(slashed(x), "/"), -1)


def suffix(x: C) -> Column:
    """Lower-case suffix with its dot, empty if the name has none (a leading dot begins no suffix)."""
    return F.lower(F.regexp_extract(file_name(x), r"(?s)^.+(\.[^.]+)$", 1))


def parent(x: C) -> Column:
    return F.regexp_extract(slashed(x), r"(?s)^(.*)/[^/]*$", 1)


def relative_to(x: C, root: C) -> Column:
    """Path below ``root``, unchanged if it is not below."""
    p, r = slashed(x), F.regexp_replace(slashed(root), "/+$", "")
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, 2147483647)).otherwise(_c(x))


def normal_path(x: C) -> Column:
    """Path with '.' and '..' resolved by text alone; links are not followed.  Null where '..' leaves the root."""
    p = slashed(x)
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def last_two(x: C) -> Column:
    parts = F.filter(F.split(slashed(x), "/"), lambda s: s != "")
    return F.when(F.size(parts) <= 2, _c(x)).otherwise(F.array_join(F.slice(parts, -2, 2), "/"))


def joined_url(base: C, path: C) -> Column:
    b = F.regexp_replace(_c(base), "/+$", "")
    return F.concat(b, F.when(_c(path).startswith("/"), _c(path)).otherwise(F.concat(F.lit("/"), _c(path))))


def is_documentation(x: C) -> Column:
    """A path that documents: README, the docs folder, a text suffix."""
    p = F.lower(slashed(x))
    return (p == "readme.md") | p.startswith("docs/") | suffix(x).isin(fixed.DOCUMENTATION_SUFFIXES)


def is_documentation_file(x: C) -> Column:
    """The same question as the check of an action asks it: anywhere below a docs folder counts."""
    p = F.lower(slashed(x))
    return p.rlike(r"\.(md|txt|rst)$") | p.contains("/docs/") | p.endswith("readme.md")


# --- tokens ------------------------------------------------------------------------------------------------


def ascii_token_parts(t: Column) -> Column:
    """A token and its parts of two characters or more, distinct and sorted."""
    parts = F.filter(F.split(t, "[./_-]+"), lambda p: F.length(p) >= 2)
    return F.array_sort(F.array_distinct(F.concat(F.array(t), parts)))


def ngrams(s: Column) -> Column:
    """A run of two characters itself; all bigrams, then all trigrams, of a longer one."""
    n = F.length(s)
    grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(s, i, k))).otherwise(F.array().cast("array<string>"))
    return F.when(n <= 2, F.array(s)).otherwise(F.concat(grams(2), grams(3)))


def aliases_of(t: Column, aliases: dict[str, list[str]]) -> Column:
    """The aliases of every source that the token contains, in the order of the sources."""
    known = F.array(*[F.struct(F.lit(src).alias("s"), F.array(*map(F.lit, out)).alias("a")) for src, out in aliases.items()])
    return F.flatten(F.transform(F.filter(known, lambda e: F.contains(t, e["s"])), lambda e: e["a"]))


def tokens(x: C, aliases: dict[str, list[str]] = fixed.ALIASES, stopwords: Sequence[str] = fixed.STOPWORDS) -> Column:
    """Multiset of tokens in order: names and their parts, Chinese runs and their n-grams, then aliases of all of these."""
    low = F.lower(blank_to_empty(x))
    names = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(fixed.ASCII_TOKEN), F.lit(0)), ascii_token_parts))
    runs = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(fixed.CJK_RUN), F.lit(0)), lambda s: F.concat(F.array(s), ngrams(s))))
    keep = lambda all_: F.filter(all_, lambda t: (F.length(t) >= 2) & ~t.isin(list(stopwords)))
    if not aliases:
        return keep(F.concat(names, runs))
    # the array around it makes the tokens a variable, so they are computed once for both of their uses
    once = F.array(F.concat(names, runs))
    return F.element_at(F.transform(once, lambda base: keep(F.concat(base, F.flatten(F.transform(base, lambda t: aliases_of(t, aliases)))))), 1)


# --- tagged text -------------------------------------------------------------------------------------------


def tag(x: C, name: str) -> Column:
    """Text inside the first pair of tags, empty if there is none."""
    return F.regexp_extract(_c(x), rf"(?is)<{name}>\s*(.*?)\s*</{name}>", 1)


def blocks(x: C, name: str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(rf"(?is)<{name}>\s*(.*?)\s*</{name}>"), F.lit(1))


def unwrapped(x: C) -> Column:
    """Without a code fence around the whole text."""
    t = strip(x)
    inner = F.regexp_extract(t, fixed.WHOLE_FENCE, 1)
    return F.when(t.rlike(fixed.WHOLE_FENCE), strip(inner)).otherwise(t)


def file_body(x: C) -> Column:
    """Without line ends around, nor a code fence around the whole."""
    edge = lambda c: F.regexp_replace(c, r"^[\r\n]+|[\r\n]+\z", "")
    t = edge(_c(x))
    return F.when(t.rlike(fixed.WHOLE_FENCE), edge(F.regexp_extract(t, fixed.WHOLE_FENCE, 1))).otherwise(t)


def largest_code_block(x: C) -> Column:
    """The longest fenced block, the first of equals; empty if there is none."""
    found = F.regexp_extract_all(_c(x), F.lit(fixed.CODE_BLOCK), F.lit(1))
    best = F.aggregate(found, F.lit(""), lambda acc, b: F.when(F.length(b) > F.length(acc), b).otherwise(acc))
    return F.regexp_replace(best, r"^[\r\n]+|[\r\n]+\z", "")


def repaired_tags(x: C, strict: bool = False) -> Column:
    """Missing angle brackets put in.

    The default does it literally, also inside of longer names (so the tag pair of proposal_summary breaks);
    ``strict`` repairs only whole names.
    """
    out = _c(x)
    for name in fixed.KNOWN_TAGS:
        if strict:
            out = F.regexp_replace(out, rf"(?i)(?<![<\w/]){name}>", f"<{name}>")
        else:
            out = F.regexp_replace(out, rf"(?i)(?<!<)(?<!/){name}>", f"<{name}>")
        out = F.regexp_replace(F.regexp_replace(out, rf"(?i)\({name}>", f"<{name}>"), rf"(?i)\({name}\s*>", f"<{name}>")
    return out


def action_kind(x: C) -> Column:
    """The kind an alias stands for, null for an unknown one."""
    key = F.translate(F.lower(strip(blank_to_empty(x))), "-", "_")
    pairs = [F.lit(v) for kv in fixed.KIND_ALIASES.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def without_thoughts(x: C) -> Column:
    """Without complete think spans; the text itself if nothing else is left."""
    cut = strip(F.regexp_replace(_c(x), fixed.THOUGHT + r"\s*", ""))
    return F.when(cut == "", strip(x)).otherwise(cut)


def partial_chat(x: C) -> Column:
    """Without think spans, also one that has no end yet."""
    return F.regexp_replace(F.regexp_replace(_c(x), fixed.THOUGHT, ""), fixed.OPEN_THOUGHT, "")


def partial_file(x: C) -> Column:
    """The file content in the beginning of a model's answer."""
    out = F.regexp_replace(partial_chat(x), fixed.SUMMARY_BLOCK + r"\s*", "")
    for pattern in fixed.FILE_EDGES:
        out = F.regexp_replace(out, pattern, "")
    return strip(out)


def collapsed(x: C, fallback: C, most: int = fixed.SUMMARY_CHARS) -> Column:
    """White space collapsed; ``fallback`` for a blank or too long text."""
    t = strip(F.regexp_replace(blank_to_empty(x), r"(?U)\s+", " "))
    return F.when((t == "") | (F.length(t) > most), _c(fallback)).otherwise(t)


def grade(x: C, bounds: Sequence[tuple[float, str]] = tuple(fixed.GRADES), last: str = "D") -> Column:
    out = F.when(_c(x) >= bounds[0][0], bounds[0][1])
    for low, name in bounds[1:]:
        out = out.when(_c(x) >= low, name)
    return out.otherwise(last)


def is_busy(x: C) -> Column:
    t = blank_to_empty(x)
    return (t != "") & ~_any(t, fixed.IDLE_WORDS) & _any(F.lower(t), fixed.BUSY_WORDS)


def chunk_prefixes(x: C) -> Column:
    """Growing prefixes in which a text is written: 4 to 12 of them, the last the whole text."""
    t = blank_to_empty(x)
    n = F.greatest(F.lit(fixed.FEWEST_CHUNKS), F.least(F.lit(fixed.MOST_CHUNKS), F.ceil(F.length(t) / fixed.CHUNK_CHARS).cast("int")))
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(t, F.lit(1), F.floor(F.length(t) * i / n).cast("int")))
    return F.when(t == "", F.array(F.lit(""))).otherwise(cut)
