"""Texts that are shown to people and models: reports, retrieval results, summaries, outcomes; column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from . import tabular as T


def cut_at(x: str | Column, chars: int, mark: str = fixed.REPORT_EXCERPT_MARK) -> Column:
    """The text as it is, cut at ``chars`` characters with a mark behind the cut; nothing is stripped."""
    t = X.blank_to_empty(x)
    return F.when(F.length(t) <= chars, t).otherwise(F.concat(F.substring(t, 1, chars), F.lit(mark)))


def fixed_point(x: str | Column, places: int) -> Column:
    """A number with that many decimals, half to even on its exact value."""
    return F.translate(F.format_number(F.col(x) if isinstance(x, str) else x, places), ",", "")


# --- retrieval ---------------------------------------------------------------------------------------------


def match_reason(keywords: str, reason: str) -> Column:
    """The keywords that a match shares, then why a search had chosen it."""
    head = F.when(F.size(keywords) > 0, F.concat(F.lit(fixed.REASON_WITH_KEYWORDS), F.array_join(keywords, fixed.KEYWORD_SEPARATOR))).otherwise(fixed.REASON_WITHOUT)
    return F.concat(head, F.lit(fixed.LABEL_SEPARATOR), F.col(reason))


def ranking_texts(requests: DataFrame, matches: DataFrame, terms: DataFrame, request_id: str = "request_id") -> DataFrame:
    """request_id, prompt_text, summary: the ranking of each request for a prompt, and its first files for a reader.

    ``matches``: request_id, rank, path, score, reason, a few rows a request; ``terms``: request_id, terms.
    """
    line = F.concat(F.lit("  - "), F.col("path"), F.lit(" (score="), fixed_point("score", 3), F.lit("): "), F.col("reason"))
    m = matches.groupBy(F.col(request_id).alias("m_id")).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "path"))).alias("m_"))
    t = terms.select(F.col(request_id).alias("t_id"), F.slice("terms", 1, fixed.QUERY_TERMS).alias("terms"))
    j = requests.select(request_id).join(m, F.col(request_id) == F.col("m_id"), "left").join(t, F.col(request_id) == F.col("t_id"), "left")
    head = F.when(F.size("terms") > 0, F.concat(F.lit(fixed.QUERY_HEAD + "\n  - "), F.array_join("terms", ", "), F.lit("\n"))).otherwise("")
    body = F.concat(head, F.lit(fixed.MATCH_HEAD + "\n"), F.array_join(F.transform("m_", lambda x: x["line"]), "\n"))
    files = F.concat(F.lit(fixed.RANKING_SUMMARY), F.array_join(F.transform(F.slice("m_", 1, fixed.SUMMARY_FILES), lambda x: x["path"]), fixed.KEYWORD_SEPARATOR))
    none = F.col("m_").isNull()
    return j.select(request_id, F.when(none, fixed.NO_RANKING).otherwise(body).alias("prompt_text"), F.when(none, "").otherwise(files).alias("summary"))


# --- reports on files --------------------------------------------------------------------------------------


def chosen_source(full: str, excerpt: str, disk: str) -> tuple[Column, Column]:
    """(text, label): the full document, else its beginning, else what is on disk."""
    f, e, d = (F.nullif(F.col(c), F.lit("")) for c in (full, excerpt, disk))
    lab = fixed.SOURCE_LABELS
    return F.coalesce(f, e, d, F.lit("")), F.when(f.isNotNull(), lab["full"]).when(e.isNotNull(), lab["excerpt"]).when(d.isNotNull(), lab["disk"]).otherwise(lab["none"])


def is_python(language: str, path: str) -> Column:
    return (F.lower(X.blank_to_empty(language)) == "python") | (X.suffix(X.blank_to_empty(path)) == ".py")


def _listed(title: str, points: Column) -> Column:
    some = F.concat(F.lit(f"- {title}:\n"), F.array_join(F.transform(points, lambda p: F.concat(F.lit("  - "), p)), "\n"))
    return F.when(F.size(points) > 0, some).otherwise(f"- {title}: none")


def file_report(path: Column, language: Column, source: Column, lines: Column, chars: Column, structure: Column, hints: Column, excerpt: Column) -> Column:
    """The report on a file as labelled lines."""
    head = [("File path", F.coalesce(F.nullif(path, F.lit("")), F.lit("(none)"))), ("Language id", F.coalesce(F.nullif(language, F.lit("")), F.lit("(unknown)"))), ("Source chosen by tool", source), ("Line count", lines.cast("string")), ("Character count", chars.cast("string"))]
    rows = [F.concat(F.lit(f"- {k}: "), v) for k, v in head] + [_listed("Structural observations", structure), _listed("Potential risks or refactor hints", hints)]
    return F.concat_ws("\n", *rows, F.when(excerpt != "", F.concat(F.lit("- Tool excerpt:\n"), excerpt)))


def generic_hints(text: Column, lines: Column) -> Column:
    """What a reader should look at in a file that is not Python."""
    some = F.array(F.when(text.contains("TODO") | text.contains("FIXME"), fixed.UNFINISHED_HINT), F.when(lines > fixed.LONG_FILE_LINES, fixed.LONG_FILE_HINT))
    return F.when(text == "", F.array(F.lit(fixed.NO_CONTENT_HINT))).otherwise(F.filter(some, lambda x: x.isNotNull()))


# --- actions -----------------------------------------------------------------------------------------------


def planned_summary(kind: str, path: str, active: str) -> Column:
    """Summary of a planned action; ``active`` is the open file below the root, blank for none."""
    s, a = fixed.PLANNED_SUMMARIES, F.lower(X.blank_to_empty(active))
    out = F.when(F.col(kind) == "create_file", s["create_file"]).when(F.col(kind) == "update_documentation", s["update_documentation"])
    return F.concat(out.when((a != "") & (a == F.lower(path)), s["active"]).otherwise(s["other"]), F.col(path))


def short_summary(kind: str) -> Column:
    s = fixed.SHORT_SUMMARIES
    return F.when(F.col(kind) == "create_file", s["create_file"]).when(F.col(kind) == "update_documentation", s["update_documentation"]).otherwise(s["other"])


def file_action(path: str, original: str, updated: str, summary: str) -> Column:
    """The one action of a direct edit."""
    return F.struct(F.lit("update_file").alias("kind"), X.normal_path(path).alias("target_file"), F.col(original).alias("original_content"), F.col(updated).alias("updated_content"), F.col(summary).alias("summary"))


def short_path(path: str | Column, root: str | Column) -> Column:
    """Path below the root; as it is where there is no root, or where it would be empty or lead out of it."""
    p, r = F.col(path) if isinstance(path, str) else path, X.blank_to_empty(root)
    below = X.relative_to(X.normal_path(p), X.normal_path(r))
    inside = F.startswith(X.normal_path(p), F.concat(F.regexp_replace(X.normal_path(r), "/+$", ""), F.lit("/")))
    return F.when((r != "") & inside & ~below.startswith("..") & (below != ""), below).otherwise(p)


def same_path(a: str, b: str, ignore_case: bool = False) -> Column:
    """Do two absolute paths name the same file?  With ``ignore_case`` slashes of either kind and case count as equal."""
    x, y = (X.normal_path(F.lower(X.slashed(c)) if ignore_case else F.col(c)) for c in (a, b))
    return F.coalesce(x == y, F.lit(False))


def outcome_text(status: str, path: Column, note: str) -> Column:
    """What is said about an action that was applied, skipped or failed."""
    h = fixed.OUTCOME_HEADS
    head = F.when(F.col(status) == "applied", h["applied"]).when(F.col(status) == "skipped", h["skipped"]).otherwise(h["failed"])
    label = F.when(F.col(status) == "applied", fixed.OUTCOME_NOTE).otherwise(fixed.OUTCOME_REASON)
    return F.concat(head, F.lit("\n" + fixed.OUTCOME_FILE), path, F.lit("\n"), label, X.blank_to_empty(note))


def overall_reason(actions: str, folders: str, any_high: str, any_signature: str) -> Column:
    """Why a batch of changes has its risk."""
    r = fixed.OVERALL_REASONS
    parts = F.array(
        F.when(F.col(actions) > 1, F.concat(F.lit(r["many"][0]), F.col(actions).cast("string"), F.lit(r["many"][1]))),
        F.when(F.col(folders) > 1, r["wide"]),
        F.when(F.col(any_high), r["high"]),
        F.when(F.col(any_signature), r["signature"]),
    )
    kept = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(kept) == 0, r["none"]).otherwise(F.array_join(F.slice(kept, 1, fixed.OVERALL_PARTS), fixed.OVERALL_SEPARATOR))


def proposal_summaries(actions: DataFrame, batches: DataFrame, batch: str = "response_id", action: str = "action_id", parts: int = 3) -> DataFrame:
    """batch, proposal: how many changes, their overall risk and why, and the first few by name and summary.

    ``actions``: batch, action, target_file, summary; ``batches``: as ``risk.batches`` gives them.  Only the first
    ``parts`` actions of a batch are brought together.
    """
    first = actions.withColumn("r_", F.row_number().over(W.partitionBy(batch).orderBy(action))).where(F.col("r_") <= parts)
    line = F.concat(X.file_name("target_file"), F.lit("："), X.blank_to_empty("summary"))
    lines = first.groupBy(F.col(batch).alias("l_")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_", line.alias("t")))), lambda x: x["t"]), fixed.LABEL_SEPARATOR).alias("lines"))
    n = fixed.RISK_NAMES
    name = F.when(F.col("level") == "high", n["high"]).when(F.col("level") == "medium", n["medium"]).otherwise(n["low"])
    lab = fixed.PROPOSAL_LABELS
    head = F.concat(F.lit(lab["planned"]), F.col("actions").cast("string"), F.lit(lab["planned_end"] + fixed.LABEL_SEPARATOR + lab["overall"]), name, F.lit("（"), overall_reason("actions", "folders", "any_high", "any_signature"), F.lit("）" + fixed.LABEL_SEPARATOR))
    return batches.join(lines, F.col(batch) == F.col("l_")).select(batch, F.concat(head, "lines").alias("proposal"))


# --- marks -------------------------------------------------------------------------------------------------


def student_line(name: str, *marks: str) -> Column:
    """One student as a line of a report."""
    average = T.row_average(*marks)
    values = [F.col(name).cast("string"), *[F.col(m).cast("string") for m in marks], fixed_point(average, 2), X.grade(average)]
    return F.concat_ws(" | ", *[F.concat(F.lit(k), v) for k, v in zip(fixed.STUDENT_LABELS, values)])


def class_reports(students: DataFrame, group: str, order: str, name: str, *marks: str) -> DataFrame:
    """group, report: the report of each class, a title, its lines in order and the average of the class.

    The average comes from the sum of all marks, so it does not depend on the order in which they are added.
    """
    total = sum((F.col(m) for m in marks[1:]), F.col(marks[0]))
    line = F.struct(F.col(order).alias("o"), F.concat(F.lit("["), student_line(name, *marks), F.lit("]")).alias("t"))
    g = students.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("body"), (F.sum(total) / (F.count("*") * len(marks))).alias("average"))
    return g.select(group, F.concat(F.lit(f"{fixed.REPORT_TITLE}\n{fixed.REPORT_RULE}\n"), "body", F.lit(f"\n{fixed.REPORT_RULE}\n{fixed.REPORT_AVERAGE}"), fixed_point("average", 2)).alias("report"))


def marks_average(students: DataFrame, *marks: str) -> DataFrame:
    """One row: the mean of all single marks, those that are missing not counted; 0 for none."""
    total, count = F.lit(0.0), F.lit(0)
    for m in marks:
        total, count = total + F.coalesce(F.sum(m), F.lit(0.0)), count + F.count(m)
    return students.agg(F.when(count == 0, 0.0).otherwise(total / count).alias("marks_average"))


# --- settings and interface --------------------------------------------------------------------------------


def settings(profiles: DataFrame, default_profile: str, environment: dict[str, str] | None = None, default_model: str = "none", default_fallback: str = "none") -> DataFrame:
    """One row: the settings in force.  The environment goes before the profile, the profile before the defaults.

    ``environment`` may hold OLLAMA_MODEL_PROFILE, OLLAMA_MODEL and OLLAMA_FALLBACK_MODEL; a blank value counts as none.  An
    unknown profile gives the default one; blank models give the default models.
    """
    env = environment or {}
    wanted = env.get("OLLAMA_MODEL_PROFILE", default_profile).strip() or default_profile
    rank = F.when(F.col("profile_name") == wanted, 0).when(F.col("profile_name") == default_profile, 1)
    chosen = profiles.withColumn("rank_", rank).where("rank_ is not null").orderBy("rank_").limit(1)
    text = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)

    def model(c: str, name: str, default: str) -> Column:
        value = F.lit(env[name]) if name in env else F.coalesce(c, F.lit(default))
        return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))

    return chosen.select(
        "profile_name", text("provider", "ollama"), model("runtime_model", "OLLAMA_MODEL", default_model).alias("configured_model"), model("fallback_model", "OLLAMA_FALLBACK_MODEL", default_fallback).alias("fallback_model"),
        *[text(c, "") for c in ("base_model", "description", "adapter_path", "modelfile_path")], text("train_data_dir", "data/lora/train"), text("eval_data_dir", "data/lora/eval"),
    )


def health(resolved: DataFrame, active_model: str | None = None) -> DataFrame:
    """The status record of a service: eleven fields of its settings."""
    active = F.lit(active_model) if active_model else F.col("configured_model")
    return resolved.select(
        F.lit("ok").alias("status"), F.lit("ollama").alias("provider"), F.col("profile_name").alias("model_profile"), "configured_model", active.alias("active_model"), "base_model", F.col("description").alias("profile_description"),
        "adapter_path", "modelfile_path", "train_data_dir", "eval_data_dir",
    )


def names_missing_model(error: str) -> Column:
    """Does the text of an error say that the model is not there, so that another one is worth a try?"""
    return X._any(F.lower(X.blank_to_empty(error)), fixed.MISSING_MODEL_WORDS)


def with_custom_preset(presets: DataFrame, path: str | None, default_avatar: str, order: str = "ordinal") -> DataFrame:
    """``presets`` (ordinal, id, label, avatar, model) with a preset of one's own in front, if there is a path for it."""
    if not path:
        return presets
    own = presets.sparkSession.range(1).select(F.lit(-1).cast("int").alias(order), F.lit(fixed.CUSTOM_PRESET).alias("id"), F.lit(fixed.CUSTOM_LABEL).alias("label"), F.lit(default_avatar).alias("avatar"), F.lit(path).alias("model"))
    return own.unionByName(presets)


def local_roots(resources: DataFrame, path: str, order: str) -> DataFrame:
    """ordinal, root: the folders of local files, each at its first place; web addresses have none."""
    local = resources.where(F.col(path).startswith("file://")).select(F.col(order).alias("ordinal"), X.parent(F.substring(F.col(path), 8, 1 << 30)).alias("root"))
    return local.groupBy("root").agg(F.min("ordinal").alias("ordinal")).select("ordinal", "root")


def embedded_json(x: Column) -> Column:
    """JSON that may stand inside a script of a page."""
    return F.replace(x, F.lit("<"), F.lit(fixed.ESCAPED_BRACKET))
