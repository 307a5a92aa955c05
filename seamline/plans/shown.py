"""Queries of what is shown, sent and decided around the core results: texts, events, permissions, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import context as CX
from ..functions import fixed
from ..functions import profile as P
from ..functions import text as X
from ..functions.arrow import spread
from ..operators import actions as A
from ..operators import planning as L
from ..operators import rendering as N
from ..operators import requests as Q
from ..operators import retrieval as R
from ..operators import risk as K
from ..operators import tabular as T
from ..sources.shared import cut
from ..streaming import emission as E
from . import pipeline as PL
from . import queries as B
from .queries import ASKING, _t, query

#: A preset list as a configuration document holds it, with a blank address and an entry without a label.
PRESETS = [(0, "a", "One", "file:///opt/a/one.png", "file:///opt/a/one.vrm"), (1, "b", "Two", "https://x.example/two.png", "file:///opt/b/<two>.vrm"), (2, "c", "Three", "file:///opt/a/three.png", " "), (3, "d", "", "", "")]
CUSTOM_MODEL = "file:///home/me/own.vrm"


# --- retrieval ---------------------------------------------------------------------------------------------


def _asking(spark: SparkSession, d: str) -> DataFrame:
    return B._asking(spark, d)


def _top(spark: SparkSession, d: str) -> DataFrame:
    files = B._files(spark, d).select("workspace_root", F.col("snapshot_id").alias("file_id"), "relative_path")
    return R.with_fallback(R.search_top(B._scores(spark, d)), _asking(spark, d), files)


@query
def search_contents(spark: SparkSession, d: str) -> DataFrame:
    """The chosen files with their excerpts; files without content go after the choice, usual files fill an empty one."""
    contents = _t(spark, d, "file_snapshots").select(F.col("snapshot_id").alias("file_id"), "full_content")
    c = R.with_contents(_top(spark, d), contents)
    return c.select("request_id", "file_id", F.col("rank").cast("bigint").alias("rank"), F.col("score").cast("bigint").alias("score"), "mode", F.md5("excerpt").alias("digest"))


def _ranked_candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Asking requests, the files that a search chose for each, and their ranking among themselves."""
    asking = cut(_asking(spark, d).select("request_id", "prompt", "selected_text"))
    top = cut(R.search_top(B._scores(spark, d)).select("request_id", "file_id", "relative_path", "reason"))
    excerpts = _t(spark, d, "file_snapshots").select(F.col("snapshot_id").alias("s_id"), "excerpt").join(top.select(F.col("file_id").alias("k_")).distinct(), F.col("s_id") == F.col("k_"), "left_semi").dropDuplicates(["s_id"])
    docs = top.join(excerpts, F.col("file_id") == F.col("s_id")).select("request_id", "file_id", F.col("relative_path").alias("path"), F.concat(F.col("request_id").cast("string"), F.lit(":"), F.col("file_id").cast("string")).alias("pair"), F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in ("relative_path", "reason", "excerpt")]).alias("text"))
    text = F.concat_ws("\n", F.nullif("prompt", F.lit("")), F.nullif("selected_text", F.lit("")))
    q = asking.select("request_id", F.col("request_id").alias("q_id"), text.alias("text"), X.holds_any("prompt", fixed.DOCUMENTATION_WORDS).alias("docs_wanted"))
    best = R.ranked(q, docs, ["request_id"], "q_id", "pair", "path").select(F.col("q_id").alias("request_id"), F.split("pair", ":")[1].cast("bigint").alias("file_id"), "path", "score", "keywords", "rank")
    reasons = top.select(F.col("request_id").alias("r_id"), F.col("file_id").alias("r_file"), "reason")
    full = best.join(reasons, (F.col("request_id") == F.col("r_id")) & (F.col("file_id") == F.col("r_file"))).drop("r_id", "r_file")
    return q, docs, full.withColumn("reason", N.match_reason("keywords", "reason"))


@query
def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The files that the search chose for a request, ranked by weighted terms among themselves, and why."""
    m = _ranked_candidates(spark, d)[2]
    return m.select("request_id", "file_id", "path", "score", F.array_join("keywords", " ").alias("keywords"), "reason", F.col("rank").cast("bigint").alias("rank"))


@query
def ranking_texts(spark: SparkSession, d: str) -> DataFrame:
    q, docs, matches = _ranked_candidates(spark, d)
    terms = R.query_terms(q, docs, ["request_id"], "q_id", "pair").withColumnRenamed("q_id", "request_id")
    return N.ranking_texts(q.select("request_id"), cut(matches), terms)


@query
def related_files(spark: SparkSession, d: str) -> DataFrame:
    """Files for the context of an edit: the best ones besides the open file."""
    asking = _asking(spark, d)
    targets = asking.select("request_id", X.relative_to("active_file", "workspace_root").alias("path")).where("path <> ''")
    return R.related(R.search_top(B._scores(spark, d)), targets, fixed.APPLY_NOTES["related"]).select("request_id", "file_id", F.col("place").cast("bigint").alias("place"))


# --- requests ----------------------------------------------------------------------------------------------


@query
def fallback_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests without a workspace (here also every tenth) that are rewritten for the open file, with the text that goes out."""
    r = B._requests(spark, d).withColumn("workspace_root", F.when(F.col("request_id") % 10 != 3, F.col("workspace_root"))).where((X.blank_to_empty("workspace_root") == "") & Q.falls_back_to_file("prompt", "active_file", "full_document_text"))
    return r.select("request_id", F.concat(F.lit(fixed.NO_WORKSPACE_PREFIX), X.blank_to_empty("prompt")).alias("prompt"))


@query
def action_quotas(spark: SparkSession, d: str) -> DataFrame:
    """How many actions an answer must have, and whether one with half of those that were named is sent back."""
    r = B._requests(spark, d)
    named = L.explicit_paths(r).groupBy(F.col("request_id").alias("n_id")).agg(F.count("*").alias("named"))
    j = r.join(named, F.col("request_id") == F.col("n_id"), "left").withColumn("named", F.coalesce("named", F.lit(0)))
    least = Q.least_actions(X.holds_any("prompt", fixed.PROJECT_SCOPE_WORDS), F.col("named"))
    return j.select("request_id", "named", least.cast("bigint").alias("least"), Q.needs_retry(F.col("named"), F.floor(F.col("named") / 2), least).alias("retry"))


@query
def context_sources(spark: SparkSession, d: str) -> DataFrame:
    """The text that an open file is judged by, where it comes from, and whether it is Python."""
    r = _t(spark, d, "gen_requests").select("request_id", "workspace_root", "active_file", "language_id", "full_document_text", "document_text")
    disk = _t(spark, d, "file_snapshots").where("absolute_path is not null").groupBy(F.col("absolute_path").alias("d_path")).agg(F.max_by("excerpt", "snapshot_id").alias("disk"))
    # texts of the editor stay where they are; only requests without one look at the disk
    own = (F.col("full_document_text") != "") | (F.col("document_text") != "")
    text, label = N.chosen_source("full_document_text", "document_text", "disk")
    shown = lambda df: df.select("request_id", label.alias("source"), N.is_python("language_id", "active_file").alias("python"), F.length(text).cast("bigint").alias("n_chars"), F.md5(N.cut_at(text, fixed.REPORT_EXCERPT_CHARS)).alias("digest"))
    at_hand = shown(r.where(F.coalesce(own, F.lit(False))).withColumn("disk", F.lit(None).cast("string")))
    looked_up = shown(r.where(~F.coalesce(own, F.lit(False))).join(disk, F.col("active_file") == F.col("d_path"), "left"))
    return at_hand.unionAll(looked_up).dropDuplicates(["request_id"])


@query
def merged_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Each request's context, with fields that it leaves out taken from the one before in its conversation."""
    r = B.first_arrival(_t(spark, d, "gen_requests").select("request_id", "conv_id", "workspace_root", "active_file", "language_id", "selected_text", "system_prompt", "ingested_at"), "request_id")
    fields = ("workspace_root", "active_file", "language_id", "selected_text")
    # blocks by request number keep a long conversation out of one task: each looks back once over its edge
    live = F.struct(*[F.col(c) for c in (*fields, "system_prompt")])
    w = W.partitionBy("conv_id", "block_").orderBy("request_id")
    b = r.withColumn("block_", F.floor(F.col("request_id") / 100_000)).select("request_id", "conv_id", "block_", live.alias("live"), F.lag(live).over(w).alias("inside"))
    ends = b.groupBy("conv_id", "block_").agg(F.max_by("live", "request_id").alias("end_"))
    before = ends.select(F.col("conv_id").alias("c_"), F.col("block_").alias("b_"), F.lag("end_").over(W.partitionBy("conv_id").orderBy("block_")).alias("before"))
    j = b.join(before, F.col("conv_id").eqNullSafe(F.col("c_")) & F.col("block_").eqNullSafe(F.col("b_")), "left").withColumn("last", F.coalesce("inside", "before"))
    pick = [F.coalesce(F.col(f"live.{f}"), F.col(f"last.{f}")).alias(f) for f in fields]
    return j.select("request_id", *pick, F.coalesce(F.nullif(F.col("live.system_prompt"), F.lit("")), F.col("last.system_prompt"), F.lit("")).alias("system_prompt"))


@query
def context_texts(spark: SparkSession, d: str) -> DataFrame:
    """What of each file an editor would send along: its beginning, and all of it if it is not too long."""
    t = CX.context_texts("full_content")
    f = _t(spark, d, "file_snapshots").select("snapshot_id", F.length(t["document_text"]).cast("bigint").alias("excerpt_chars"), F.length(t["full_document_text"]).cast("bigint").alias("full_chars"))
    return f.dropDuplicates(["snapshot_id"])


@query
def project_roots(spark: SparkSession, d: str) -> DataFrame:
    """The nearest folder above each open file that holds what marks a project: here each workspace, and its backend."""
    r = _t(spark, d, "gen_requests").select("request_id", "active_file").where("active_file is not null").dropDuplicates(["request_id"])
    files = _t(spark, d, "file_snapshots").select("absolute_path", "workspace_root")
    marks = files.where("workspace_root is not null").select("workspace_root").distinct().select(F.explode(F.array(F.concat("workspace_root", F.lit("/package.json")), F.concat("workspace_root", F.lit("/backend/pyproject.toml")))).alias("absolute_path"))
    return CX.project_roots(r, files.select("absolute_path").unionAll(marks), "request_id", "active_file")


# --- files and actions -------------------------------------------------------------------------------------


@query
def file_reports(spark: SparkSession, d: str) -> DataFrame:
    """The report on each scanned file that is not Python."""
    f = B._snapshots(spark, d, "absolute_path", "suffix", "full_content").where("coalesce(lower(suffix), '') <> '.py'")
    text = X.blank_to_empty("full_content")
    n = P.split_line_count("full_content")
    points = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(F.lit(fixed.GENERIC_POINT)))
    source = F.when(text == "", fixed.SOURCE_LABELS["none"]).otherwise(fixed.SOURCE_LABELS["disk"])
    report = N.file_report(F.col("absolute_path"), F.lit(""), source, n, F.length(text), points, N.generic_hints(text, n), F.when(text == "", "").otherwise(X.excerpt(text, fixed.REPORT_EXCERPT_CHARS, fixed.REPORT_EXCERPT_MARK)))
    return f.select("snapshot_id", report.alias("report")).dropDuplicates(["snapshot_id"])


def _opened(spark: SparkSession, d: str) -> DataFrame:
    """Actions with what was open when their request was made: narrow columns only."""
    resp = _t(spark, d, "gen_responses").select("response_id", "request_id").dropDuplicates(["response_id"])
    req = _t(spark, d, "gen_requests").select(F.col("request_id").alias("q_id"), "active_file").dropDuplicates(["q_id"])
    active = resp.join(req, F.col("request_id") == F.col("q_id")).select(F.col("response_id").alias("r_id"), "active_file")
    a = B._actions(spark, d, "response_id", "workspace_root", "kind", "target_file", "summary", "status").dropDuplicates(["action_id"])
    return a.join(active, F.col("response_id") == F.col("r_id"), "left").drop("r_id")


@query
def action_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The summaries that an action gets where the model gave none."""
    a = _opened(spark, d)
    active = F.when(X.blank_to_empty("workspace_root") != "", X.relative_to("active_file", "workspace_root"))
    return a.withColumn("active_rel", active).select("action_id", N.planned_summary("kind", "target_file", "active_rel").alias("planned"), A.default_summary("kind", "target_file").alias("prepared"), N.short_summary("kind").alias("short"))


@query
def path_permissions(spark: SparkSession, d: str) -> DataFrame:
    """Why each target may be written, how its path is shown, and whether it is the open file on a system that ignores case."""
    a = _opened(spark, d)
    documents = _t(spark, d, "file_snapshots").where("reason is not null and score >= 100").select(F.col("absolute_path").alias("o_path")).distinct()
    whole = F.when(F.col("target_file").startswith("/"), F.col("target_file")).otherwise(F.concat(F.regexp_replace(X.blank_to_empty("workspace_root"), "/+$", ""), F.lit("/"), X.slashed("target_file")))
    j = a.withColumn("whole", whole).join(documents, F.col("whole") == F.col("o_path"), "left").withColumn("opened", F.col("o_path").isNotNull())
    return j.select("action_id", A.permission("whole", "workspace_root", "active_file", "opened").alias("permission"), N.short_path("whole", "workspace_root").alias("shown"), N.same_path("whole", "active_file", True).alias("is_open"))


@query
def outcome_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is said about each applied action."""
    a = _opened(spark, d)
    return a.select("action_id", N.outcome_text("status", N.short_path("target_file", "workspace_root"), "summary").alias("message"))


@query
def proposal_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The summary of each response's changes: number, overall risk and why, the first three."""
    batches = K.batches(B._assessed(spark, d))
    actions = B._actions(spark, d, "response_id", "target_file", "summary").dropDuplicates(["action_id"])
    return N.proposal_summaries(actions, batches)


@query
def decorated_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries with the risk of their change; of two changes of one file in a response the later one's risk counts."""
    risk = B._assessed(spark, d).groupBy(F.col("response_id").alias("k_id"), F.lower("target_file").alias("k_path")).agg(F.max_by(F.struct("level", "reason"), "action_id").alias("k"))
    a = B._actions(spark, d, "response_id", "target_file", "summary").dropDuplicates(["action_id"])
    j = a.join(risk, F.col("response_id").eqNullSafe(F.col("k_id")) & (F.lower("target_file") == F.col("k_path")), "left").select("action_id", "summary", "k.level", "k.reason")
    return j.select("action_id", F.when(F.col("level").isNull(), F.col("summary")).otherwise(K.decorated_summary("summary", "level", "reason")).alias("summary"))


@query
def demo_actions(spark: SparkSession, d: str) -> DataFrame:
    """The constant action of requests whose open file is a demonstration (here: rank_column.py)."""
    r = B._requests(spark, d)
    return A.demo_actions(r, "x = 1\n", name="rank_column.py")


@query
def pipeline_answers(spark: SparkSession, d: str) -> DataFrame:
    """The answers of the whole pipeline to all asking requests, with the completer that needs no model."""
    asking = spread(_t(spark, d, "gen_requests").where(F.col("request_id") % ASKING == 0).select("request_id", "prompt", "selected_text", "active_file", "full_document_text", "workspace_root")).dropDuplicates(["request_id"])
    files = _t(spark, d, "file_snapshots").where("workspace_root is not null and relative_path is not null")
    roots = asking.select(F.col("workspace_root").alias("a_root")).distinct()
    columns = ("snapshot_id", "absolute_path", "suffix", "size_bytes", "full_content")
    newest = files.join(roots, F.col("workspace_root") == F.col("a_root"), "left_semi").groupBy("workspace_root", "relative_path").agg(F.max_by(F.struct(*columns), "snapshot_id").alias("f"))
    a = PL.answers(asking, cut(newest.select("workspace_root", "relative_path", *[f"f.{c}" for c in columns])))
    return a.select("request_id", "route", "mood", F.col("action_count").cast("bigint").alias("action_count"), "requires_confirmation", "proposal_summary")


# --- events ------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "gen_responses").select("response_id", "request_id", "content", "mood").dropDuplicates(["response_id"])
    route = F.when(F.col("response_id") % 3 == 0, "edit").when(F.col("response_id") % 3 == 1, "workspace").otherwise("chat")
    return r.select("response_id", route.alias("route"), "content", CX.status_of_mood("mood").alias("status"))


@query
def answer_events(spark: SparkSession, d: str) -> DataFrame:
    e = E.answer_events(_answers(spark, d), "response_id")
    return e.select("response_id", F.col("seq").cast("bigint").alias("seq"), "type", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


@query
def dispatched_events(spark: SparkSession, d: str) -> DataFrame:
    """Events written as lines of JSON and read back; the last line of every second answer lost its line end."""
    lines = E.event_lines(E.answer_events(_answers(spark, d), "response_id"), "response_id")
    ended = (F.col("response_id") % 2 == 0) | F.get_json_object("line", "$.type").isin("status", "patch")
    e = E.dispatched(lines.withColumn("ended", ended), "response_id")
    return e.select("response_id", F.col("seq").cast("bigint").alias("seq"), "type", F.md5("text").alias("digest"))


@query
def interface_labels(spark: SparkSession, d: str) -> DataFrame:
    """Status, expression and label of each answer's mood."""
    r = _t(spark, d, "gen_responses").select("response_id", "mood", F.coalesce(F.col("content"), F.lit("")).alias("content")).dropDuplicates(["response_id"])
    status = F.concat_ws(" ", CX.status_of_mood("mood"), F.substring("content", 1, 20))
    j = r.select("response_id", status.alias("status"), (F.length("content") % 2 == 0).alias("streaming"), (F.length("content") % 3 == 0).alias("proposing"))
    return j.select("response_id", CX.expression_of_status("status", "streaming").alias("expression"), CX.display_status("proposing", "status", "status").alias("label"), X.is_busy("status").alias("busy"))


@query
def missing_models(spark: SparkSession, d: str) -> DataFrame:
    """Texts that name a missing model, as an error does."""
    return _t(spark, d, "documents").select("doc_id", N.names_missing_model("text").alias("missing"))


# --- settings and marks ------------------------------------------------------------------------------------


@query
def health(spark: SparkSession, d: str) -> DataFrame:
    profiles = _t(spark, d, "model_profiles")
    return N.health(N.settings(profiles, "local_default", {"OLLAMA_MODEL_PROFILE": "lora_chat", "OLLAMA_FALLBACK_MODEL": " "}), "active-model")


def _presets(spark: SparkSession) -> DataFrame:
    p = spark.createDataFrame(PRESETS, "ordinal int, id string, label string, avatar string, model string")
    return p.where("coalesce(id, '') <> '' and coalesce(label, '') <> ''")


@query
def preset_config(spark: SparkSession, d: str) -> DataFrame:
    """Presets of an interface with one's own in front, as JSON that a page may embed."""
    p = N.with_custom_preset(_presets(spark), CUSTOM_MODEL, "file:///opt/default.png")
    blank = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    shown = p.select("ordinal", "id", "label", blank("avatar"), blank("model"))
    return shown.select("ordinal", "id", N.embedded_json(F.concat(F.lit('{"id":"'), "id", F.lit('","model":"'), F.coalesce("model", F.lit("")), F.lit('"}'))).alias("config"))


@query
def preset_roots(spark: SparkSession, d: str) -> DataFrame:
    p = _presets(spark)
    resources = p.select((F.col("ordinal") * 2).alias("ordinal"), F.col("avatar").alias("path")).unionAll(p.select(F.col("ordinal") * 2 + 1, "model"))
    return N.local_roots(resources, "path", "ordinal")


def _students(spark: SparkSession, d: str) -> DataFrame:
    i = lambda c: F.floor(c).cast("int")
    line = _t(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.concat(F.lit("#"), F.col("l_linenumber").cast("string")).alias("name"), i(F.col("l_quantity") * 2).alias("math"), i(F.col("l_partkey") % 101).alias("english"), i(F.col("l_suppkey") % 101).alias("python"))


@query
def class_reports(spark: SparkSession, d: str) -> DataFrame:
    """The report of each class, one student a line: classes of orders and the five students that a demonstration adds."""
    added = spark.createDataFrame([(-1, k, n, *m) for k, (n, *m) in enumerate([("a", 91, 87, 94), ("b", 78, 83, 80), ("c", 95, 88, 93), ("d", 76, 81, 70), ("e", 66, 72, 79)])], "l_orderkey bigint, l_linenumber int, name string, math int, english int, python int")
    return N.class_reports(_students(spark, d).unionByName(added), "l_orderkey", "l_linenumber", "name", "math", "english", "python")


@query
def marks_average(spark: SparkSession, d: str) -> DataFrame:
    """The mean of all single marks, some of them missing."""
    s = _students(spark, d).withColumn("english", F.when(F.col("l_linenumber") != 3, F.col("english")))
    return N.marks_average(s, "math", "english", "python").select(F.round("marks_average", 6).alias("marks_average"))


@query
def student_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks out of records of strings with an alias and with what is no number."""
    e = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("name"), F.when(F.col("event_id") % 4 != 0, F.get_json_object("props", "$.k")).otherwise("x").alias("math"), F.lit(None).cast("string").alias("english"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 100).cast("string")).alias("python_score"))
    return T.students(e)
