"""Editor context, paths and labels that an interface shows: small column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from . import text as X

CONTEXT_FIELDS = ("workspace_root", "active_file", "language_id", "selected_text", "document_text", "full_document_text")
# What marks the root of a project, what a state is called
ROOT_MARKERS = ["package.json", "pyproject.toml", "requirements.txt", "environment.yml", ".git"]
MOODS = {"thinking": "thinking", "helpful": "responded"}


def context_texts(document: str = "document") -> dict[str, Column]:
    """document_text and full_document_text of an open document: its beginning, and all of it if it is not too long."""
    d = X.blank_to_empty(document)
    return {"document_text": F.nullif(F.substring(d, 1, fixed.CONTEXT_EXCERPT_CHARS), F.lit("")), "full_document_text": F.when(F.length(d).between(1, fixed.CONTEXT_FULL_CHARS), d)}


def merged_context(live: str = "live", last: str = "last") -> Column:
    """A struct with each field of the live context, else that of the last one; a blank system prompt counts as none."""
    fields = [F.coalesce(F.col(f"{live}.{f}"), F.col(f"{last}.{f}")).alias(f) for f in CONTEXT_FIELDS]
    prompt = F.coalesce(F.nullif(F.col(f"{live}.system_prompt"), F.lit("")), F.col(f"{last}.system_prompt"), F.lit(""))
    return F.struct(*fields, prompt.alias("system_prompt"))


def project_roots(active: DataFrame, files: DataFrame, key: str, path: str, markers: list[str] | None = None) -> DataFrame:
    """key, root: the nearest folder above a file that holds one of the markers; no row without one.

    The folders above each file are exploded and joined with the folders that hold a marker.  ``files``: absolute_path.
    """
    names = markers or ROOT_MARKERS
    held = files.where(X.file_name("absolute_path").isin(names)).select(X.parent("absolute_path").alias("root")).distinct()
    parts = F.split(X.parent(path), "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return active.select(key, F.explode(above).alias("root")).join(held, "root").groupBy(key).agg(F.max_by("root", F.length("root")).alias("root"))


def display_path(path: str, root: str) -> Column:
    """Path below the root, the whole path if it is not below or there is no root."""
    return F.when(X.blank_to_empty(root) == "", F.col(path)).otherwise(X.relative_to(path, root))


def diff_class(line: str) -> Column:
    c = F.col(line)
    return F.when(c.startswith("+ "), "added").when(c.startswith("- "), "removed").when(c.startswith("@@"), "hunk").when(c.startswith("+++") | c.startswith("---"), "header").otherwise("plain")


def resource_address(resource: str, base: str) -> Column:
    """Web addresses as they are, absolute paths as file addresses, others below ``base``; null for none."""
    r = F.nullif(F.col(resource), F.lit(""))
    return F.when(r.rlike("(?i)^https?://"), r).when(r.startswith("/"), F.concat(F.lit("file://"), r)).when(r.isNotNull(), F.concat(F.regexp_replace(F.lit(base), "/+$", ""), F.lit("/"), r))


def status_of_mood(mood: str) -> Column:
    out = F.when(F.col(mood) == "thinking", MOODS["thinking"])
    return out.when(F.col(mood) == "helpful", MOODS["helpful"]).otherwise("idle")


def expression_of_status(status: str, streaming: str) -> Column:
    s = X.blank_to_empty(status)
    return F.when(F.col(streaming), "speaking").when(s.contains(fixed.THINKING_WORD), "thinking").when(X._any(s, fixed.ACTING_WORDS), "acting").otherwise("idle")


def display_status(proposal_streaming: str, local: str, status: str) -> Column:
    return F.when(F.col(proposal_streaming), "generating").otherwise(F.coalesce(F.nullif(F.col(local), F.lit("")), F.col(status)))
