"""Routing of requests by keyword rules: boolean columns over word lists, evaluated in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X


def proposes_workspace_change(prompt: str, selected: str, history: str) -> Column:
    """A strong word, or a verb with a target or a project in the history, unless text is selected."""
    no_text = X.strip(X.blank_to_empty(selected)) == ""
    history_hint = (X.strip(X.blank_to_empty(history)) != "") & X.holds_any_as_is(history, fixed.WORKSPACE_HISTORY_WORDS)
    weak = X.holds_any(prompt, fixed.WORKSPACE_VERBS) & (X.holds_any(prompt, fixed.WORKSPACE_TARGETS) | history_hint) & no_text
    return (X.strip(X.blank_to_empty(prompt)) != "") & (X.holds_any(prompt, fixed.WORKSPACE_STRONG_WORDS) | weak)


def edits_current_file(prompt: str, selected: str, history: str) -> Column:
    """Ordered rules, the first that applies decides."""
    has = lambda words: X.holds_any(prompt, words)
    inquiry, asked, verb = has(fixed.EDIT_INQUIRY_WORDS), has(fixed.EDIT_REQUEST_WORDS), has(fixed.EDIT_VERBS)
    anchored = (X.strip(X.blank_to_empty(selected)) != "") | X.holds_any_as_is(history, fixed.EDIT_HISTORY_WORDS)
    return (
        F.when(X.strip(X.blank_to_empty(prompt)) == "", False)
        .when(has(fixed.EDIT_WORKSPACE_WORDS), False)
        .when(inquiry & ~asked, False)
        .when(verb & has(fixed.EDIT_TARGETS) & ~inquiry, True)
        .when(verb & anchored & asked, True)
        .when(~inquiry & has(fixed.EDIT_CONTINUATION_WORDS) & anchored, True)
        .otherwise(False)
    )


def falls_back_to_file(prompt: str, active: str, full: str) -> Column:
    """A request without a workspace that can be answered by an edit of the open document."""
    return (X.blank_to_empty(active) != "") & (X.blank_to_empty(full) != "") & ~X.holds_any(prompt, fixed.MULTI_FILE_WORDS)


def routed(requests: DataFrame, history: str | None = None) -> DataFrame:
    """``requests`` (prompt, selected_text, active_file, full_document_text, workspace_root) with both routes.

    ``route`` is that of a single answer, ``stream_route`` that of a streamed one: there a request without a
    workspace that is no direct edit becomes an edit if a full document is open and no word speaks against it.
    Null texts count as empty.
    """
    df = requests if history else requests.withColumn("history_", F.lit(""))
    h = history or "history_"
    edit = edits_current_file("prompt", "selected_text", h)
    change = proposes_workspace_change("prompt", "selected_text", h)
    no_root = X.strip(X.blank_to_empty("workspace_root")) == ""
    out = df.withColumns(
        {
            "edits_file": edit,
            "changes_workspace": change,
            "project_scope": X.holds_any("prompt", fixed.PROJECT_SCOPE_WORDS),
            "wants_documentation": X.holds_any("prompt", fixed.DOCUMENTATION_WORDS),
            "wants_creation": X.holds_any("prompt", fixed.CREATION_WORDS),
            "wants_code": X.holds_any("prompt", fixed.CODE_CHANGE_WORDS),
            "documentation_optional": X.holds_any("prompt", fixed.OPTIONAL_DOCUMENTATION_WORDS),
            "falls_back": falls_back_to_file("prompt", "active_file", "full_document_text"),
        }
    ).withColumns(
        {
            "route": F.when(F.col("edits_file"), "edit").when(F.col("changes_workspace"), "workspace").otherwise("chat"),
            "stream_route": F.when(F.col("edits_file"), "edit").when(no_root & F.col("falls_back"), "edit").when(F.col("changes_workspace"), "workspace").otherwise("chat"),
        }
    )
    return out if history else out.drop("history_")


def least_actions(project_scope: Column, planned: Column) -> Column:
    """How many actions an answer must have: one, in project scope two to four by what was planned."""
    return F.when(~project_scope, 1).when(planned <= 0, 2).otherwise(F.greatest(F.lit(2), F.least(F.lit(4), planned)))


def needs_retry(parsed: Column, prepared: Column, least: Column) -> Column:
    return (parsed == 0) | (prepared == 0) | (prepared < least)
