"""Queries of the core operators over the tables of a project: name -> (spark, folder) -> DataFrame, whole tables each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import profile as P
from ..functions.arrow import spread
from ..functions import text as X
from ..operators import actions as A
from ..operators import conversation as C
from ..operators import diffs as D
from ..operators import parsing as G
from ..operators import planning as L
from ..operators import requests as Q
from ..operators import retrieval as R
from ..operators import risk as K
from ..operators import tabular as T
from ..operators.deliveries import first_arrival
from ..streaming import emission as E

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Searches ask for every request whose id is divisible by this, against all files.
ASKING = 20


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return first_arrival(_t(spark, d, "gen_requests").select("request_id", "conv_id", "prompt", "workspace_root", "active_file", "selected_text", "full_document_text", "ingested_at"), "request_id")


def _asking(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "gen_requests").where(F.col("request_id") % ASKING == 0)
    return first_arrival(r.select("request_id", "prompt", "workspace_root", "active_file", "selected_text", "ingested_at"), "request_id")


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    s = _t(spark, d, "file_snapshots").select("snapshot_id", "ingested_at", "workspace_root", "absolute_path", "relative_path", "suffix", "size_bytes", *columns)
    return first_arrival(s, "snapshot_id")


def _actions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Columns of the actions, redelivered rows included: results are computed where a row lies and deduplicated after."""
    return _t(spark, d, "file_actions").select("action_id", *columns)


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The same columns of the actions where their texts are worked on: over all cores, however small the scan."""
    return spread(_actions(spark, d, *columns))


def _snapshots(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(_t(spark, d, "file_snapshots").select("snapshot_id", *columns))


def _once(df: DataFrame, key: str) -> DataFrame:
    """One row for each record; all columns of redelivered rows but the time of arrival are equal."""
    return df.dropDuplicates([key])


# --- terms and ranking -------------------------------------------------------------------------------------


@query
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.token_counts(_t(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", "term", F.col("n"), F.col("n_tokens").cast("bigint").alias("n_tokens"))


@query
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return R.document_frequency(R.token_counts(_t(spark, d, "documents").select("doc_id", "text"), ["doc_id"]), [])


@query
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    counts = R.token_counts(docs, ["doc_id"])
    w = R.weights(counts, R.document_frequency(counts, []), docs.agg(F.count("*").alias("n_docs")), [])
    return w.select("doc_id", "term", F.round("w", 6).alias("w"))


def _semantic(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = _t(spark, d, "gen_requests").where(F.col("request_id") % ASKING == 0).select("workspace_root", "request_id", F.concat_ws("\n", F.nullif("prompt", F.lit("")), F.nullif("selected_text", F.lit(""))).alias("text"), X.holds_any("prompt", fixed.DOCUMENTATION_WORDS).alias("docs_wanted"))
    f = _snapshots(spark, d, "workspace_root", "relative_path", "reason", "excerpt").select("workspace_root", "snapshot_id", F.col("relative_path").alias("path"), F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in ("relative_path", "reason", "excerpt")]).alias("text"))
    return q.where("workspace_root is not null"), f.where("workspace_root is not null")


@query
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best files of its workspace for each asking request."""
    q, f = _semantic(spark, d)
    return R.ranked(q, f, ["workspace_root"], "request_id", "snapshot_id", "path").select("request_id", "snapshot_id", "path", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def semantic_query_terms(spark: SparkSession, d: str) -> DataFrame:
    q, f = _semantic(spark, d)
    return R.query_terms(q, f, ["workspace_root"], "request_id", "snapshot_id").select("request_id", F.array_join("terms", " ").alias("terms"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    files = R.searchable(_files(spark, d)).select("workspace_root", F.col("snapshot_id").alias("file_id"), "relative_path", "absolute_path")
    return R.path_scores(_asking(spark, d), files)


@query
def search_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("request_id", "file_id", F.col("score").cast("bigint").alias("score"), "reason")


@query
def search_top(spark: SparkSession, d: str) -> DataFrame:
    return R.search_top(_scores(spark, d)).select("request_id", "file_id", F.col("score").cast("bigint").alias("score"), "reason", F.col("rank").cast("bigint").alias("rank"))


@query
def search_overview(spark: SparkSession, d: str) -> DataFrame:
    return R.overview(_scores(spark, d)).select("request_id", F.col("place").cast("bigint").alias("place"), "relative_path")


@query
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("full_content", F.lit(""))
    return _once(_snapshots(spark, d, "full_content").select("snapshot_id", X.excerpt(text).alias("cut"), F.when(F.length(text) <= fixed.FULL_CONTENT_CHARS, "full").otherwise("excerpt").alias("mode")), "snapshot_id")


# --- requests ----------------------------------------------------------------------------------------------

FLAGS = ("edits_file", "changes_workspace", "project_scope", "wants_documentation", "wants_creation", "wants_code", "documentation_optional", "falls_back")


@query
def request_routes(spark: SparkSession, d: str) -> DataFrame:
    h = C.history_text(first_arrival(_t(spark, d, "turns"), "turn_id")).withColumnRenamed("conv_id", "h_conv")
    r = _requests(spark, d)
    j = r.join(h, r["conv_id"] == h["h_conv"], "left").withColumn("history", F.coalesce("history", F.lit("")))
    return Q.routed(j, "history").select("request_id", *FLAGS, "route", "stream_route")


@query
def explicit_paths(spark: SparkSession, d: str) -> DataFrame:
    return L.explicit_paths(_requests(spark, d)).select("request_id", F.col("ordinal").cast("bigint").alias("ordinal"), "path")


@query
def planned_targets(spark: SparkSession, d: str) -> DataFrame:
    asking = _asking(spark, d).withColumn("full_document_text", F.lit(None).cast("string"))
    files = _t(spark, d, "file_snapshots").select("workspace_root", "relative_path")
    chosen = R.search_top(_scores(spark, d))
    return L.planned(Q.routed(asking), files, chosen)


# --- conversations -----------------------------------------------------------------------------------------


@query
def history_text(spark: SparkSession, d: str) -> DataFrame:
    return C.history_text(first_arrival(_t(spark, d, "turns"), "turn_id"))


@query
def turn_continuations(spark: SparkSession, d: str) -> DataFrame:
    return C.continuations(first_arrival(_t(spark, d, "turns"), "turn_id"))


@query
def latest_by_role(spark: SparkSession, d: str) -> DataFrame:
    return C.latest_by_role(first_arrival(_t(spark, d, "turns"), "turn_id"))


# --- actions -----------------------------------------------------------------------------------------------


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    """The risk of each action, with the file that was open when its request was made."""
    resp = _t(spark, d, "gen_responses").select("response_id", "request_id").dropDuplicates(["response_id"])
    req = _t(spark, d, "gen_requests").select(F.col("request_id").alias("q_id"), "active_file").dropDuplicates(["q_id"])
    active = resp.join(req, F.col("request_id") == F.col("q_id")).select("response_id", "active_file")
    return K.assessed(_texts(spark, d, "response_id", "kind", "target_file", "original_content", "updated_content"), active=active)


@query
def risk_actions(spark: SparkSession, d: str) -> DataFrame:
    return _assessed(spark, d).select("action_id", F.col("score").cast("bigint").alias("score"), "level", "reason")


@query
def risk_batches(spark: SparkSession, d: str) -> DataFrame:
    b = K.batches(_assessed(spark, d))
    return b.select("response_id", "actions", "folders", F.col("score").cast("bigint").alias("score"), "level", "any_high", "any_signature")


def _checked(spark: SparkSession, d: str, syntax: bool) -> DataFrame:
    newest = _t(spark, d, "file_snapshots").where("workspace_root is not null and relative_path is not null").groupBy("workspace_root", "relative_path").agg(F.max_by("full_content", "snapshot_id").alias("full_content"))
    a = first_arrival(_actions(spark, d, "workspace_root", "kind", "target_file", "original_content", "updated_content", "ingested_at"), "action_id").drop("ingested_at")
    return A.checked(A.with_original(a, newest), syntax=syntax)


@query
def action_checks(spark: SparkSession, d: str) -> DataFrame:
    """The rule that each action breaks, the Python syntax included."""
    return _checked(spark, d, True).select("action_id", "on_disk", "error")


@query
def action_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rule that each action breaks, the Python syntax left out."""
    return _checked(spark, d, False).select("action_id", "on_disk", "error")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What applying the actions of each response in their order gives, by what the scanned files hold now."""
    newest = _t(spark, d, "file_snapshots").where("workspace_root is not null and relative_path is not null").groupBy("workspace_root", "relative_path").agg(F.max_by("full_content", "snapshot_id").alias("full_content"))
    a = _actions(spark, d, "response_id", "workspace_root", "kind", "target_file", "original_content", "updated_content").dropDuplicates(["action_id"])
    j = A.with_original(a, newest)
    folders = newest.select(F.col("workspace_root").alias("w_root"), X.parent(X.slashed("relative_path")).alias("w_dir")).distinct()
    rel = F.coalesce(X.relative_to("resolved", "workspace_root"), F.concat(F.lit("\n"), F.col("target_file")), F.lit("\n"))
    j = j.withColumns({"rel": rel, "allowed": F.col("resolved").isNotNull()})
    j = j.join(folders.withColumn("is_folder", F.lit(True)), (F.col("workspace_root") == F.col("w_root")) & (F.col("rel") == F.col("w_dir")), "left").withColumn("is_folder", F.coalesce("is_folder", F.lit(False)))
    return A.outcomes(j)


@query
def action_apply(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("action_id", "outcome")


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.status_counts(_once(_actions(spark, d, "source", "status"), "action_id"), "source")


@query
def written_lengths(spark: SparkSession, d: str) -> DataFrame:
    w = A.written_text("updated_content", "original_content")
    return _once(_texts(spark, d, "original_content", "updated_content").select("action_id", F.length(w).cast("bigint").alias("n_chars"), F.md5(w).alias("digest")), "action_id")


@query
def line_diffs(spark: SparkSession, d: str) -> DataFrame:
    return _once(D.unified(_texts(spark, d, "kind", "target_file", "original_content", "updated_content")).select("action_id", "diff"), "action_id")


@query
def diff_bounds(spark: SparkSession, d: str) -> DataFrame:
    names = ("old_lines", "new_lines", "prefix", "suffix", "removed", "added")
    return _once(D.bounds(_texts(spark, d, "original_content", "updated_content")).select("action_id", *[F.col(n).cast("bigint").alias(n) for n in names]), "action_id")


@query
def write_progress(spark: SparkSession, d: str) -> DataFrame:
    p = E.progress(_texts(spark, d, "updated_content"), "action_id", "updated_content").dropDuplicates(["action_id", "step"])
    return p.select("action_id", *[F.col(n).cast("bigint").alias(n) for n in ("step", "percent", "written")])


@query
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    t = "target_file"
    return _once(_actions(spark, d, t), "action_id").select("action_id", X.file_name(t).alias("name"), X.suffix(t).alias("suffix"), X.parent(t).alias("parent"), X.last_two(t).alias("short"), X.is_documentation(t).alias("documents"), X.is_documentation_file(t).alias("documents_file"))


@query
def first_targets(spark: SparkSession, d: str) -> DataFrame:
    """The first action on each target of a workspace, in any case and with either slash."""
    a = _once(_actions(spark, d, "workspace_root", "target_file"), "action_id")
    return L.first_wins(a, "workspace_root", "target_file", "action_id").select("action_id")


@query
def targets_on_disk(spark: SparkSession, d: str) -> DataFrame:
    """Actions by whether their target is among the scanned files."""
    f = _t(spark, d, "file_snapshots").select(F.col("workspace_root").alias("r"), X.slashed("relative_path").alias("p")).distinct()
    a = _once(_actions(spark, d, "workspace_root", "target_file"), "action_id").select("action_id", "workspace_root", X.slashed("target_file").alias("path"))
    on = (F.col("workspace_root") == F.col("r")) & (F.col("path") == F.col("p"))
    there, gone = a.join(f, on, "left_semi").select("action_id", F.lit(True).alias("on_disk")), a.join(f, on, "left_anti").select("action_id", F.lit(False).alias("on_disk"))
    return there.unionAll(gone)


# --- parsing -----------------------------------------------------------------------------------------------


@query
def tagged_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "documents").select("doc_id", F.posexplode(X.blocks(F.coalesce("text", F.lit("")), "action")).alias("ordinal", "block"))
    return b.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), X.action_kind(X.tag("block", "kind")).alias("kind"), X.tag("block", "target_file").alias("target_file"), X.tag("block", "summary").alias("summary"), F.length(X.tag("block", "updated_content")).cast("bigint").alias("n_chars"))


@query
def parsed_plans(spark: SparkSession, d: str) -> DataFrame:
    """Complete actions with repaired tags."""
    return G.plan_actions(_t(spark, d, "documents").select("doc_id", "text").where("text is not null"), "doc_id", "text", strict_tags=True)


@query
def parsed_files(spark: SparkSession, d: str) -> DataFrame:
    r = first_arrival(_t(spark, d, "gen_responses").select("response_id", "content", "ingested_at"), "response_id").where("content is not null")
    return G.single_file(r, "content", strict_tags=True).select("response_id", "file_summary", "file_content")


@query
def largest_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", X.largest_code_block("text").alias("block"))


@query
def answers_without_thoughts(spark: SparkSession, d: str) -> DataFrame:
    r = first_arrival(_t(spark, d, "gen_responses").select("response_id", "content", "ingested_at"), "response_id")
    return r.where("content is not null").select("response_id", X.without_thoughts("content").alias("answer"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return G.events(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query
def stream_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "type", "chunk", F.col("seq").cast("bigint").alias("seq"))


@query
def stream_deltas(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("type = 'message_chunk'")
    return E.deltas(e, "doc_id", "line_no").select("doc_id", F.col("step").cast("bigint").alias("step"), "delta")


@query
def stream_snapshots(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("type in ('message_chunk', 'patch')")
    return E.snapshots(e, "doc_id", "line_no").select("doc_id", "ordinal", "length")


def _interface(spark: SparkSession, d: str) -> DataFrame:
    """Events of an interface out of stream events; some lines stand for a hydrate, a cleared proposal or the user."""
    n = F.col("line_no")
    kind = F.when(F.col("type") == "message_chunk", "messageChunk").when(F.col("type") == "result", "message").when((F.col("type") == "patch") & (n % 7 == 3), "clearProposal").when(F.col("type") == "patch", "proposal").when((F.col("type") == "status") & (n % 5 == 2), "hydrate").otherwise(F.col("type"))
    role = F.when((F.col("type") == "result") & (n % 3 == 1), "user").otherwise("agent")
    return _events(spark, d).select("doc_id", n.alias("seq"), kind.alias("type"), role.alias("role"), F.col("chunk").alias("text"))


@query
def interface_state(spark: SparkSession, d: str) -> DataFrame:
    return E.interface_state(_interface(spark, d), "doc_id")


@query
def proposal_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether each stream leaves a proposal open, and one that may be applied."""
    n = F.col("line_no")
    kind = F.when(F.col("type") == "patch", "patch").when((F.col("type") == "status") & (n % 2 == 0), "proposal").when((F.col("type") == "result") & (n % 3 == 0), "apply").when((F.col("type") == "result") & (n % 3 == 1), "discard").when(n % 11 == 0, "prompt")
    return E.proposal_states(_events(spark, d).select("doc_id", n.alias("seq"), kind.alias("type")).where("type is not null"), "doc_id")


# --- profiles, marks, lookups ------------------------------------------------------------------------------


@query
def python_structure(spark: SparkSession, d: str) -> DataFrame:
    a = _texts(spark, d, "target_file", "updated_content").where((X.suffix("target_file") == ".py") & F.col("updated_content").isNotNull()).select("action_id", P.python_structure("updated_content").alias("s"))
    names = ("imports", "functions", "classes", "long_functions", "broad_excepts", "print_heavy")
    return _once(a, "action_id").select("action_id", "s.line_count", "s.char_count", "s.error_line", *[F.array_join(f"s.{n}", ",").alias(n) for n in names])


@query
def text_reports(spark: SparkSession, d: str) -> DataFrame:
    """Line count and notes of files that are not Python."""
    f = _snapshots(spark, d, "full_content", "suffix").where("full_content is not null and lower(suffix) <> '.py'")
    n = P.split_line_count("full_content")
    return _once(f.select("snapshot_id", n.cast("bigint").alias("n_lines"), (F.col("full_content").contains("TODO") | F.col("full_content").contains("FIXME")).alias("unfinished"), (n > fixed.LONG_FILE_LINES).alias("long")), "snapshot_id")


@query
def profile_settings(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with defaults for what is blank."""
    value = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default)).alias(c)
    return _t(spark, d, "model_profiles").select("profile_name", value("provider", "ollama"), value("runtime_model", "none"), value("fallback_model", "none"), *[value(c, "") for c in ("base_model", "description", "adapter_path", "modelfile_path")], value("train_data_dir", "data/lora/train"), value("eval_data_dir", "data/lora/eval"))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return T.with_level(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("a"), (100 - F.col("l_discount") * 1000).alias("b"), (100 - F.col("l_tax") * 1000).alias("c")), "a", "b", "c")


@query
def mark_levels(spark: SparkSession, d: str) -> DataFrame:
    return _marks(spark, d).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("average"), 4).alias("average"))


@query
def class_average(spark: SparkSession, d: str) -> DataFrame:
    return T.class_average(_marks(spark, d), "a", "b", "c").select(F.round("class_average", 4).alias("class_average"))


@query
def find_first(spark: SparkSession, d: str) -> DataFrame:
    return T.find_first(_t(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "error", "event_id")


@query
def newest_orders(spark: SparkSession, d: str) -> DataFrame:
    """The latest order of each customer with its status, customers without orders included."""
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("last"))
    c = _t(spark, d, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("last.o_orderkey").alias("o_orderkey"), F.col("last.o_orderstatus").alias("status"))
