"""From requests to answers: routes, retrieval, plan, completion, parsing, checks, retry, risk, answer rows.

The completion is a column that a completer adds; the default one is deterministic, so the whole pipeline runs
and is tested without a model.  Each stage is a DataFrame; a branch is a filter on the route.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import profile as P
from ..functions import text as X
from ..operators import actions as A
from ..operators import parsing as G
from ..operators import planning as L
from ..operators import rendering as N
from ..operators import requests as Q
from ..operators import retrieval as R
from ..operators import risk as K
from ..sources.shared import cut

#: (request rows with prompt and plan, attempt) -> the same rows with ``completion``; null stands for a failed call.
Completer = Callable[[DataFrame, int], DataFrame]


def echo(rows: DataFrame, attempt: int) -> DataFrame:
    """The default completer: one tagged action for each planned target, with a comment as its content."""
    block = lambda t: F.concat(F.lit("<action><kind>"), t["kind"], F.lit("</kind><target_file>"), t["target_file"], F.lit("</target_file><summary>planned</summary><updated_content># "), t["target_file"], F.lit("</updated_content></action>"))
    return rows.withColumn("completion", F.concat(F.lit("<assistant_reply>ok</assistant_reply>"), F.array_join(F.transform(F.coalesce("plan", F.array().cast("array<struct<place:int,kind:string,target_file:string>>")), block), "")))


def candidates(requests: DataFrame, files: DataFrame) -> DataFrame:
    """request_id, file_id, relative_path, score, reason, rank of the searched files of each request.

    Where a search finds nothing, the usual files of the workspace take its place.
    """
    every = files.select("workspace_root", F.col("snapshot_id").alias("file_id"), "relative_path")
    found = R.searchable(files).select("workspace_root", F.col("snapshot_id").alias("file_id"), "relative_path", "absolute_path")
    return R.with_fallback(R.search_top(R.path_scores(requests, found)), requests, every)


def rankings(requests: DataFrame, files: DataFrame, cand: DataFrame) -> DataFrame:
    """request_id, prompt_text, summary: the chosen files with a content, ranked among themselves by weighted terms."""
    contents = files.select(F.col("snapshot_id").alias("file_id"), "full_content")
    docs = cut(R.with_contents(cand, contents))
    docs = docs.select("request_id", F.concat_ws(":", F.col("request_id").cast("string"), F.col("file_id").cast("string")).alias("pair"), F.col("relative_path").alias("path"), "reason", F.concat_ws("\n", "relative_path", "reason", "excerpt").alias("text"))
    text = F.concat_ws("\n", F.nullif("prompt", F.lit("")), F.nullif("selected_text", F.lit("")))
    q = requests.select("request_id", F.col("request_id").alias("q_id"), text.alias("text"), X.holds_any("prompt", fixed.DOCUMENTATION_WORDS).alias("docs_wanted"))
    best = R.ranked(q, docs, ["request_id"], "q_id", "pair", "path").join(docs.select(F.col("pair").alias("p_"), "reason"), F.col("pair") == F.col("p_"))
    matches = cut(best.select(F.col("q_id").alias("request_id"), "path", "score", "rank", N.match_reason("keywords", "reason").alias("reason")))
    terms = R.query_terms(q, docs, ["request_id"], "q_id", "pair").withColumnRenamed("q_id", "request_id")
    return N.ranking_texts(q.select("request_id"), matches, terms)


def _single_files(rows: DataFrame, completer: Completer, attempt: int, target: str) -> DataFrame:
    """``rows`` with file_summary, file_content and error of one completion each."""
    done = completer(rows, attempt).withColumn("completion", X.without_thoughts(F.coalesce("completion", F.lit(""))))
    e = G.single_file(done, "completion", strict_tags=True)
    line = F.when(X.suffix(target) == ".py", P.python_error_line("file_content"))
    return e.withColumn("line_", line).withColumn("error", A.file_candidate_error("file_content", target, F.col("line_"))).drop("line_", "completion")


def file_by_file(rows: DataFrame, files: DataFrame, completer: Completer) -> DataFrame:
    """request_id, ordinal, kind, target_file, original_content, updated_content, summary, note: one planned file at a time.

    ``rows``: requests with a ``plan``.  Each target gets a completion of its own and one repair attempt; a target that
    gives no usable content keeps its place with a note that says why.
    """
    each = cut(rows.where("plan is not null").select("*", F.explode("plan").alias("t_")).withColumns({"plan": F.array("t_"), "goal": F.col("t_.target_file"), "place": F.col("t_.place"), "goal_kind": F.col("t_.kind")}).drop("t_"))
    first = cut(_single_files(each, completer, 3, "goal").select("request_id", "place", "file_summary", "file_content", "error"))
    again = each.join(first.where("error is not null").select(F.col("request_id").alias("f_id"), F.col("place").alias("f_place")), (F.col("request_id") == F.col("f_id")) & (F.col("place") == F.col("f_place")), "left_semi")
    second = _single_files(again, completer, 4, "goal").select(F.col("request_id").alias("s_id"), F.col("place").alias("s_place"), *[F.col(c).alias(f"s_{c}") for c in ("file_summary", "file_content", "error")])
    goals = each.select(F.col("request_id").alias("e_id"), F.col("place").alias("e_place"), "goal", "goal_kind", "workspace_root")
    j = first.join(goals, (F.col("request_id") == F.col("e_id")) & (F.col("place") == F.col("e_place"))).join(second, (F.col("request_id") == F.col("s_id")) & (F.col("place") == F.col("s_place")), "left")
    mended = F.col("error").isNotNull() & F.col("s_id").isNotNull() & F.col("s_error").isNull()
    pick = lambda c: F.when(mended, F.col(f"s_{c}")).otherwise(F.col(c))
    made = j.select("request_id", F.col("place").alias("ordinal"), F.col("goal_kind").alias("kind"), F.col("goal").alias("target_file"), "workspace_root", pick("file_content").alias("updated_content"), pick("file_summary").alias("summary"), F.when(~mended, F.coalesce("s_error", "error")).alias("wrong"))
    checked = A.checked(A.with_original(made, files))
    why = F.coalesce("wrong", "error")
    good = why.isNull()
    summary = X.collapsed("summary", A.default_summary("kind", "target_file"))
    keep = lambda c: F.when(good, c)
    return checked.select("request_id", "ordinal", keep(F.col("kind")).alias("kind"), keep(F.col("resolved")).alias("target_file"), keep(F.col("current")).alias("original_content"), keep(F.col("updated_content")).alias("updated_content"), keep(summary).alias("summary"), F.when(~good, F.concat(F.col("target_file"), F.lit(": "), why)).alias("note"))


def _attempt(rows: DataFrame, files: DataFrame, completer: Completer, attempt: int) -> DataFrame:
    """request_id, attempt, reply, parsed, actions: what one completion gives, its actions checked."""
    done = cut(completer(rows, attempt).withColumn("completion", X.without_thoughts(F.coalesce("completion", F.lit("")))))
    header = G.plan_header(done, "completion", strict_tags=True).select("request_id", F.col("assistant_reply").alias("reply"), F.col("proposal_summary").alias("stated"))
    parsed = G.plan_actions(done, "request_id", "completion", strict_tags=True).where(F.col("ordinal") < fixed.PARSED_ACTIONS)
    roots = rows.select(F.col("request_id").alias("r_id"), "workspace_root")
    checked = A.checked(A.with_original(parsed.join(roots, F.col("request_id") == F.col("r_id")).drop("r_id"), files))
    summary = F.coalesce(F.nullif("summary", F.lit("")), A.default_summary("kind", "resolved"))
    kept = F.struct("ordinal", "kind", F.col("resolved").alias("target_file"), F.col("current").alias("original_content"), "updated_content", summary.alias("summary"))
    grouped = checked.groupBy(F.col("request_id").alias("g_id")).agg(
        F.count("*").alias("parsed"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNull(), kept))).alias("actions"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("ordinal", "target_file", "error")))).alias("rejected"),
    )  # at most PARSED_ACTIONS rows a request
    return header.join(grouped, F.col("request_id") == F.col("g_id"), "left").select("request_id", "reply", "stated", F.coalesce("parsed", F.lit(0)).alias("parsed"), "actions", "rejected")


def proposals(requests: DataFrame, files: DataFrame, completer: Completer = echo) -> DataFrame:
    """request_id, ordinal, kind, target_file, original_content, updated_content, summary, reply, attempt, usable.

    ``requests`` are routed ones of the workspace branch; ``files``: snapshot_id, workspace_root, relative_path,
    absolute_path, suffix, size_bytes, full_content, one row for each path.  An answer that has no usable actions
    or fewer than the scope asks for gets one repair attempt, which counts only if it does better; if that is not
    usable either, each planned file is asked for by itself (attempt 3).
    """
    cand = candidates(requests, files)
    plan = L.planned(requests, files.select("workspace_root", "relative_path"), cut(cand))
    steps = plan.groupBy(F.col("request_id").alias("p_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "kind", "target_file"))).alias("plan"))
    # each stage is read several times below, so it is written once
    rows = cut(requests.join(steps, F.col("request_id") == F.col("p_id"), "left").drop("p_id"))
    least = rows.select(F.col("request_id").alias("l_id"), Q.least_actions(F.col("project_scope"), F.coalesce(F.size("plan"), F.lit(0))).alias("least"))
    n = F.coalesce(F.size("actions"), F.lit(0))
    judged = lambda a: a.join(least, F.col("request_id") == F.col("l_id")).drop("l_id").withColumn("usable", ~Q.needs_retry(F.col("parsed"), F.greatest(n, F.lit(0)), F.col("least")))
    first = cut(judged(_attempt(rows, files, completer, 1)))
    again = rows.join(first.where(~F.col("usable")).select("request_id"), "request_id", "left_semi")
    second = judged(_attempt(again, files, completer, 2)).select(F.col("request_id").alias("s_id"), *[F.col(c).alias(f"s_{c}") for c in ("reply", "stated", "parsed", "actions", "rejected", "usable")])
    both = first.join(second, F.col("request_id") == F.col("s_id"), "left").withColumn("better", F.coalesce("s_usable", F.lit(False)))
    pick = lambda c: F.when(F.col("better"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c)
    chosen = both.select("request_id", pick("reply"), pick("actions"), (F.col("usable") | F.col("better")).alias("usable"), F.when(F.col("better"), 2).otherwise(1).alias("attempt"))
    chosen = cut(chosen)
    # what two attempts did not give is asked for file by file
    lone = rows.join(chosen.where(~F.col("usable")).select(F.col("request_id").alias("c_id")), F.col("request_id") == F.col("c_id"), "left_semi")
    single = cut(file_by_file(lone, files, completer))
    some = single.where("note is null").select(F.col("request_id").alias("g_id")).distinct()
    kept = chosen.join(some, F.col("request_id") == F.col("g_id"), "left_anti")
    replies = chosen.select(F.col("request_id").alias("h_id"), "reply")
    instead = single.where("note is null").join(replies, F.col("request_id") == F.col("h_id")).select("request_id", F.col("ordinal").cast("int").alias("ordinal"), "kind", "target_file", "original_content", "updated_content", "summary", "reply", F.lit(3).alias("attempt"), F.lit(True).alias("usable"))
    out = kept.select("request_id", "reply", "usable", "attempt", F.explode_outer("actions").alias("a")).select("request_id", "a.ordinal", "a.kind", "a.target_file", "a.original_content", "a.updated_content", "a.summary", "reply", "attempt", "usable")
    return out.unionByName(instead)


def answers(requests: DataFrame, files: DataFrame, completer: Completer = echo, annotate: bool = True) -> DataFrame:
    """request_id, route, content, mood, action_count, requires_confirmation, proposal_summary: one row a request.

    The workspace branch proposes actions with their risk; the others answer with the completion.  A failed
    completion gives mood idle.  ``annotate=False`` leaves the risk out, as a streamed edit does.
    """
    routed = cut(Q.routed(requests))
    work = cut(proposals(routed.where("route = 'workspace'"), files, completer))
    opened = routed.select(F.col("request_id").alias("o_id"), "active_file")
    acts = work.where("usable and kind is not null").join(opened, F.col("request_id") == F.col("o_id")).drop("o_id")
    risk = K.assessed(acts, "request_id", "ordinal").select(F.col("request_id").alias("k_id"), F.col("ordinal").alias("k_ord"), "score", "level", "reason", "folder")
    batch = K.batches(risk.withColumnsRenamed({"k_id": "request_id"}), "request_id").select(F.col("request_id").alias("b_id"), F.col("level").alias("overall"))
    shown = K.decorated_summary("summary", "level", "reason") if annotate else F.col("summary")
    line = F.struct("ordinal", F.concat(X.file_name("target_file"), F.lit("："), shown).alias("t"))
    j = acts.join(risk, (F.col("request_id") == F.col("k_id")) & (F.col("ordinal") == F.col("k_ord")))
    proposal = j.groupBy("request_id").agg(F.count("*").alias("action_count"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(line)), 1, 3), lambda x: x["t"]), fixed.LABEL_SEPARATOR).alias("lines"))
    head = work.groupBy(F.col("request_id").alias("w_id")).agg(F.first("reply").alias("reply"))
    full = head.join(proposal, F.col("w_id") == F.col("request_id"), "left").drop("request_id").join(batch, F.col("w_id") == F.col("b_id"), "left")
    overall = F.when(F.lit(annotate) & F.col("overall").isNotNull(), F.concat(F.lit("; risk "), F.col("overall"), F.lit("; "))).otherwise("; ")
    proposed = full.select(F.col("w_id").alias("request_id"), F.lit("workspace").alias("route"), F.col("reply").alias("content"), F.when(F.col("action_count").isNull(), "idle").otherwise("helpful").alias("mood"), F.coalesce("action_count", F.lit(0)).alias("action_count"), F.when(F.col("action_count").isNotNull(), F.concat(F.col("action_count").cast("string"), F.lit(" changes"), overall, "lines")).otherwise("").alias("proposal_summary"))
    rest = completer(routed.where("route <> 'workspace'").withColumn("plan", F.lit(None).cast("array<struct<place:int,kind:string,target_file:string>>")), 1)
    talk = rest.select("request_id", "route", X.without_thoughts(F.coalesce("completion", F.lit(""))).alias("content"), F.when(F.col("completion").isNull(), "idle").otherwise("helpful").alias("mood"), F.lit(0).cast("bigint").alias("action_count"), F.lit("").alias("proposal_summary"))
    return proposed.unionByName(talk).withColumn("requires_confirmation", F.col("action_count") > 0)


def fallback_prompt(prompt: str, prefix: str) -> Column:
    """A workspace request without a workspace, rewritten for the open file alone."""
    return F.concat(F.lit(prefix), X.blank_to_empty(prompt))


def rewritten(requests: DataFrame) -> DataFrame:
    """``requests`` with the prompt of those rewritten that have no workspace but an open file that can answer them."""
    lone = (X.blank_to_empty("workspace_root") == "") & Q.falls_back_to_file("prompt", "active_file", "full_document_text")
    return requests.withColumn("prompt", F.when(lone, fallback_prompt("prompt", fixed.NO_WORKSPACE_PREFIX)).otherwise(F.col("prompt")))


def file_edits(requests: DataFrame, completer: Completer) -> DataFrame:
    """request_id, target_file, updated_content, summary, error, attempt: edits of the open file, each checked.

    An edit with an error gets one repair attempt, which counts if it has none.  Unchanged contents have the error
    'unchanged'; a failed completion has 'no_content'.
    """
    blank = F.lit(None).cast("array<struct<place:int,kind:string,target_file:string>>")
    work = cut(rewritten(requests).withColumn("plan", blank))
    same = X.canonical("file_content") == X.canonical("full_document_text")

    def attempt(rows: DataFrame, n: int) -> DataFrame:
        e = _single_files(rows, completer, n, "active_file").withColumn("error", F.coalesce("error", F.when(same, "unchanged")))
        return e.select("request_id", F.col("active_file").alias("target_file"), F.col("file_content").alias("updated_content"), X.collapsed("file_summary", F.lit("")).alias("summary"), "error")

    first = cut(attempt(work, 1))
    again = work.join(first.where("error is not null").select(F.col("request_id").alias("f_id")), F.col("request_id") == F.col("f_id"), "left_semi")
    second = attempt(again, 2).where("error is null").withColumn("attempt", F.lit(2))
    fine = second.select(F.col("request_id").alias("s_id"))
    return first.join(fine, F.col("request_id") == F.col("s_id"), "left_anti").withColumn("attempt", F.lit(1)).unionByName(second)
