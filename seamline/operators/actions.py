"""File actions: paths kept inside their root, original contents looked up, ordered checks, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import profile as P
from ..functions import text as X


def inside_root(path: str | Column, root: str | Column) -> Column:
    """Absolute path of a target below ``root``, null for a blank or escaping one; links are not followed."""
    p, r = X.slashed(path), F.regexp_replace(X.slashed(root), "/+$", "")
    whole = X.normal_path(F.when(p.startswith("/"), p).otherwise(F.concat(r, F.lit("/"), p)))
    return F.when((X.strip(X.blank_to_empty(path)) != "") & F.startswith(whole, F.concat(r, F.lit("/"))), whole)


def looks_like_source(x: str | Column) -> Column:
    t = F.ltrim(x) if isinstance(x, Column) else F.ltrim(F.col(x))
    starts, low = F.lit(False), F.lower(t)
    for s in fixed.SOURCE_STARTS:
        starts = starts | t.startswith(s)
    for s in fixed.SOURCE_FENCES:
        starts = starts | low.contains(s)
    return starts


def with_original(actions: DataFrame, files: DataFrame, root: str = "workspace_root", target: str = "target_file") -> DataFrame:
    """``actions`` with ``resolved``, ``on_disk`` and the current content of the target: one left join on (root, path).

    ``files``: workspace_root, relative_path, full_content, one row for each path.  The text of an open
    document (``open_text``, if there is such a column) goes before the stored one.
    """
    a = actions.withColumn("resolved", inside_root(target, root)).withColumn("rel_", F.when(F.col("resolved").isNotNull(), X.relative_to("resolved", root)))
    f = files.select(F.col(root).alias("f_root_"), X.slashed("relative_path").alias("f_rel_"), F.col("full_content").alias("stored_"), F.lit(True).alias("found_"))
    j = a.join(f, (F.col(root) == F.col("f_root_")) & (F.col("rel_") == F.col("f_rel_")), "left")
    stored = F.coalesce(F.nullif(F.col("open_text"), F.lit("")), F.col("stored_"), F.lit("")) if "open_text" in actions.columns else F.coalesce("stored_", F.lit(""))
    return j.withColumns({"on_disk": F.coalesce("found_", F.lit(False)), "current": stored}).drop("f_root_", "f_rel_", "stored_", "found_", "rel_")


def checked(actions: DataFrame, kind: str = "kind", updated: str = "updated_content", original: str = "current", syntax: bool = True) -> DataFrame:
    """``actions`` (resolved, on_disk, current) with ``error``: the first rule that an action breaks, else null.

    Codes: outside_root, no_content, exists, missing, unchanged, not_documentation, looks_like_source,
    unknown_kind, and syntax_error with the line.  ``syntax=False`` leaves the Python check out.
    """
    body, same = X.strip(X.blank_to_empty(updated)), X.canonical(updated) == X.canonical(original)
    k, python = F.col(kind), X.suffix("resolved") == ".py"
    broken = F.when(python, P.python_error_line(body)) if syntax else F.lit(None).cast("int")
    code = (
        F.when(F.col("resolved").isNull(), "outside_root")
        .when(body == "", "no_content")
        .when((k == "create_file") & F.col("on_disk"), "exists")
        .when((k == "update_file") & ~F.col("on_disk"), "missing")
        .when((k == "update_file") & same, "unchanged")
        .when((k == "update_documentation") & ~X.is_documentation_file("resolved"), "not_documentation")
        .when((k == "update_documentation") & looks_like_source(body), "looks_like_source")
        .when((k == "update_documentation") & same, "unchanged")
        .when(~k.isin("create_file", "update_file", "update_documentation") | k.isNull(), "unknown_kind")
    )
    with_code = actions.withColumn("code_", code)
    if not syntax:
        return with_code.withColumnRenamed("code_", "error")
    line = with_code.withColumn("line_", F.when(F.col("code_").isNull() & k.isin("create_file", "update_file"), broken))
    return line.withColumn("error", F.coalesce("code_", F.when(F.col("line_").isNotNull(), F.concat(F.lit("syntax_error:"), F.col("line_").cast("string"))))).drop("code_", "line_")


def file_candidate_error(updated: str, target: str, syntax_line: Column | None = None) -> Column:
    """The first thing wrong with the content of a single file: empty, incomplete, tags left in, syntax."""
    body = X.strip(X.blank_to_empty(updated))
    low = F.lower(body)
    tags = F.lit(False)
    for t in fixed.LEFT_TAGS:
        tags = tags | low.contains(t)
    out = F.when(body == "", "no_content").when(X._any(low, fixed.INCOMPLETE_WORDS), "incomplete").when(tags, "tags")
    return out.when((X.suffix(target) == ".py") & syntax_line.isNotNull(), "syntax_error") if syntax_line is not None else out


def applied_status(kind: str = "kind", allowed: str = "allowed", on_disk: str = "on_disk", current: str = "current", original: str = "original_content", updated: str = "updated_content") -> Column:
    """applied or skipped, by the rules in their order: permission, existence, a change since the preview, no change."""
    k, same = F.col(kind), X.canonical(updated) == X.canonical(current)
    moved = X.canonical(current) != X.canonical(original)
    return (
        F.when(~F.col(allowed), "skipped")
        .when(k == "create_file", F.when(F.col(on_disk), "skipped").otherwise("applied"))
        .when((k == "update_file") & ~F.col(on_disk), "skipped")
        .when((k == "update_documentation") & ~F.col(on_disk), "applied")
        .when(moved | same, "skipped")
        .otherwise("applied")
    )


def written_text(updated: str, current: str, newline: str = "\r\n") -> Column:
    """Text as it is written: one kind of line end, and a last one if the file had one."""
    body = F.replace(F.regexp_replace(X.blank_to_empty(updated), "\r\n?", "\n"), F.lit("\n"), F.lit(newline))
    had = X.blank_to_empty(current).endswith("\n")
    return F.when(had & ~F.endswith(body, F.lit(newline)), F.concat(body, F.lit(newline))).otherwise(body)


def status_counts(actions: DataFrame, *by: str) -> DataFrame:
    return actions.groupBy(*by, "status").agg(F.count("*").alias("n"))


def default_summary(kind: str, target: str) -> Column:
    name = X.file_name(target)
    d = fixed.DEFAULT_SUMMARIES
    head = F.when(F.col(kind) == "create_file", d["create_file"]).when(F.col(kind) == "update_documentation", d["update_documentation"]).otherwise(d["other"])
    return F.concat(head, name)


def permission(target: str, root: str, active: str, opened: str) -> Column:
    """Why a path may be written: blank, active_file, opened, inside_root or outside.

    ``opened`` is a boolean column: the path is that of an open document or lies in a folder of the workspace, which a
    semi-join with these finds.
    """
    p, r = X.normal_path(target), F.regexp_replace(X.normal_path(X.blank_to_empty(root)), "/+$", "")
    return (
        F.when(X.strip(X.blank_to_empty(target)) == "", "blank")
        .when(F.coalesce(p == X.normal_path(F.nullif(F.col(active), F.lit(""))), F.lit(False)), "active_file")
        .when(F.coalesce(F.col(opened), F.lit(False)), "opened")
        .when((X.blank_to_empty(root) != "") & ((p == r) | F.startswith(p, F.concat(r, F.lit("/")))), "inside_root")
        .otherwise("outside")
    )


def outcomes(actions: DataFrame, batch: str = "response_id", action: str = "action_id") -> DataFrame:
    """batch, action, outcome: what applying the actions of each batch one after the other gives.

    ``actions``: batch, action, kind, allowed, on_disk, current, original_content, updated_content, and ``rel``, the
    path that is written.  An action sees what earlier ones of its batch wrote to its path: the actions of one path
    are folded in order, so only what one batch does to one path is ever in one row.  ``failed``: the path is a
    folder (``is_folder``).  Kinds that nothing applies give no row.
    """
    text = lambda c: X.canonical(c).alias(c)
    known = actions.where(F.col("kind").isin("create_file", "update_file", "update_documentation"))
    one = F.struct(action, "kind", text("original_content"), text("updated_content"), "allowed", "is_folder")
    g = known.groupBy(batch, "rel").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a[action] < b[action], -1).when(a[action] > b[action], 1).otherwise(0)).alias("all_"), F.max(F.when(F.col("on_disk"), X.canonical("current"))).alias("disk_"))
    state = f"struct<text:string,out:array<struct<id:{actions.schema[action].dataType.simpleString()},outcome:string>>>"

    def step(acc: Column, x: Column) -> Column:
        there, old, new = acc["text"].isNotNull(), x["original_content"], x["updated_content"]
        outcome = (
            F.when(~x["allowed"], "skipped")
            .when(x["is_folder"], "failed")
            .when(x["kind"] == "create_file", F.when(there, "skipped").otherwise("applied"))
            .when(~there, F.when(x["kind"] == "update_file", "skipped").otherwise("applied"))
            .when((acc["text"] != old) | (acc["text"] == new), "skipped")
            .otherwise("applied")
        )
        return F.struct(F.when(outcome == "applied", new).otherwise(acc["text"]).alias("text"), F.concat(acc["out"], F.array(F.struct(x[action].alias("id"), outcome.alias("outcome")))).alias("out")).cast(state)

    start = F.struct(F.col("disk_").alias("text"), F.array().cast(f"array<struct<id:{actions.schema[action].dataType.simpleString()},outcome:string>>").alias("out")).cast(state)
    return g.select(batch, F.explode(F.aggregate("all_", start, step)["out"]).alias("o_")).select(batch, F.col("o_.id").alias(action), "o_.outcome")


def demo_actions(requests: DataFrame, content: str, name: str = fixed.DEMO_FILE) -> DataFrame:
    """request_id, kind, target_file, summary, updated_content: one constant action where the open file has that name."""
    below = X.relative_to("active_file", "workspace_root")
    inside = (X.blank_to_empty("workspace_root") != "") & F.startswith(X.slashed("active_file"), F.concat(F.regexp_replace(X.slashed("workspace_root"), "/+$", ""), F.lit("/")))
    return requests.where(inside & (X.file_name("active_file") == name)).select("request_id", F.lit("update_file").alias("kind"), X.slashed(below).alias("target_file"), F.lit(fixed.DEMO_SUMMARY).alias("summary"), F.lit(content).alias("updated_content"))
