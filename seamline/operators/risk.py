"""Risk of file changes: a score for each change from its features, and one for each batch of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X


def level(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= fixed.RISK_HIGH, "high").when(s >= fixed.RISK_MEDIUM, "medium").otherwise("low")


def counts_differ(a: str, b: str, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(X.blank_to_empty(a), F.lit(pattern), F.lit(0))) != F.size(F.regexp_extract_all(X.blank_to_empty(b), F.lit(pattern), F.lit(0)))


def large_delta(original: str, updated: str) -> Column:
    a, b = X.line_count(original), X.line_count(updated)
    delta = F.abs(b - a)
    return F.when(a == 0, b >= fixed.LARGE_NEW_LINES).otherwise((delta >= fixed.LARGE_DELTA_LINES) | (delta / F.greatest(a, F.lit(1)) >= fixed.LARGE_DELTA_SHARE))


def features(actions: DataFrame, batch: str, action: str) -> DataFrame:
    """The features of each change; contents are read here and go no further, only flags are shuffled.

    ``actions``: batch, action, kind, target_file, original_content, updated_content, active_file.
    """
    return actions.select(
        batch,
        action,
        "kind",
        "target_file",
        F.lower(X.parent("target_file")).alias("folder_"),
        X.suffix("target_file").isin(fixed.RISK_CODE_SUFFIXES).alias("code_"),
        counts_differ("original_content", "updated_content", fixed.SIGNATURE_LINE).alias("signature_"),
        counts_differ("original_content", "updated_content", fixed.IMPORT_LINE).alias("import_"),
        large_delta("original_content", "updated_content").alias("large_"),
        *([F.col("active_file")] if "active_file" in actions.columns else []),
    )


def assessed(actions: DataFrame, batch: str = "response_id", action: str = "action_id", active: DataFrame | None = None) -> DataFrame:
    """batch, action, target_file, score, level, reason (the first three): the risk of each change within its batch.

    Redelivered changes count once.  ``active`` (batch, active_file) is joined to the features if the actions have no
    active file of their own.  Batches come from an aggregate joined back, so a batch of any size is never in one task.
    """
    f = features(actions, batch, action).dropDuplicates([batch, action])
    if active is not None:
        f = f.join(active.select(F.col(batch).alias("a_batch"), "active_file"), F.col(batch) == F.col("a_batch"), "left").drop("a_batch")
    opened = F.lower(X.strip(X.blank_to_empty("active_file")))
    f = f.withColumn("elsewhere_", (opened != "") & (opened != F.lower("target_file")))
    sizes = f.groupBy(F.col(batch).alias("b_")).agg(F.count("*").alias("n_"), F.count_distinct("folder_").alias("folders_"))
    j = f.join(sizes, F.col(batch) == F.col("b_"))
    w, lab = fixed.RISK_WEIGHTS, fixed.RISK_LABELS
    creates, documents = F.col("kind") == "create_file", F.col("kind") == "update_documentation"
    many, wide = F.col("n_") > 1, F.col("folders_") > 1
    flag = lambda c, n: F.when(c, w[n]).otherwise(0)
    raw = (
        F.when(creates, w["create"]).when(documents, w["documentation"]).otherwise(w["update"])
        + flag(F.col("code_"), "code")
        + F.when(many, F.least(F.lit(w["most_more"]), (F.col("n_") - 1) * w["each_more"])).otherwise(0)
        + flag(wide, "directories")
        + flag(F.col("signature_"), "signature")
        + flag(F.col("import_"), "import")
        + flag(F.col("large_"), "large")
        + flag(F.col("elsewhere_"), "not_active")
    )
    score = F.least(F.lit(100), F.when(documents, F.greatest(F.lit(0), raw - w["documentation_relief"])).otherwise(raw)).cast("int")
    one = lambda c, t: F.when(c, F.array(t)).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(
        F.array(F.when(creates, lab["create"]).when(documents, lab["documentation"]).otherwise(lab["update"])),
        one(F.col("code_"), F.lit(lab["code"])),
        one(many, F.concat(F.lit(fixed.RISK_MANY[0]), F.col("n_").cast("string"), F.lit(fixed.RISK_MANY[1]))),
        one(wide, F.lit(lab["directories"])),
        *[one(F.col(f"{k}_"), F.lit(lab[k])) for k in ("signature", "import", "large")],
        one(F.col("elsewhere_"), F.lit(lab["not_active"])),
    )
    return j.select(batch, action, "target_file", score.alias("score"), level(score).alias("level"), F.array_join(F.slice(reasons, 1, 3), fixed.LABEL_SEPARATOR).alias("reason"), F.col("folder_").alias("folder"))


def batches(assessments: DataFrame, batch: str = "response_id") -> DataFrame:
    """batch, actions, folders, score, level, any_high, any_signature: the risk of each batch.

    The signature flag looks at the three reasons that were kept, so one in fourth place does not count.
    """
    g = assessments.groupBy(batch).agg(
        F.max("score").alias("worst"), F.count("*").alias("actions"), F.count_distinct("folder").alias("folders"), F.bool_or(F.col("level") == "high").alias("any_high"), F.bool_or(F.col("reason").contains(fixed.SIGNATURE_WORD)).alias("any_signature")
    )
    score = F.least(F.lit(fixed.RISK_BATCH["most"]), F.col("worst") + (F.col("actions") - 1) * fixed.RISK_BATCH["each_more"] + (F.greatest(F.col("folders"), F.lit(1)) - 1) * fixed.RISK_BATCH["each_directory"]).cast("int")
    return g.select(batch, "actions", "folders", score.alias("score"), level(score).alias("level"), "any_high", "any_signature")


def decorated_summary(summary: str, lvl: str, reason: str) -> Column:
    """Summary with the label of its risk in front; one that has a label already stays."""
    t = X.strip(X.blank_to_empty(summary))
    label = F.when(F.col(lvl) == "low", fixed.RISK_TAGS["low"]).when(F.col(lvl) == "high", fixed.RISK_TAGS["high"]).otherwise(fixed.RISK_TAGS["medium"])
    with_reason = F.when(F.coalesce(F.col(reason), F.lit("")) != "", F.concat(label, F.lit(" "), t, F.lit(fixed.LABEL_SEPARATOR), F.col(reason))).otherwise(F.concat(label, F.lit(" "), t))
    return F.when(t.rlike(r"\A\[[低中高]风险\]"), t).otherwise(with_reason)
