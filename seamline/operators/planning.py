"""Target planning: explicit paths, then the active file, then documentation, then ranked candidates; first wins, capped.

The sequence of choices is a union of stages with ordinals, deduplicated by the first occurrence; the folder cap
is a window count seeded with what earlier stages took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..sources.shared import cut


def explicit_paths(requests: DataFrame, request_id: str = "request_id", prompt: str = "prompt") -> DataFrame:
    """request_id, ordinal, path: paths named in the prompt, trimmed, first of equals in any case."""
    found = F.regexp_extract_all(X.blank_to_empty(prompt), F.lit(fixed.EXPLICIT_PATH), F.lit(0))
    rows = requests.select(request_id, F.posexplode(found).alias("ordinal", "raw"))
    clean = X.slashed(F.btrim("raw", F.lit(fixed.PATH_TRIM)))
    named = rows.select(request_id, "ordinal", clean.alias("path")).where("path <> ''")
    first = W.partitionBy(request_id, F.lower("path")).orderBy("ordinal")
    return named.withColumn("r_", F.row_number().over(first)).where("r_ = 1").drop("r_")


def first_wins(rows: DataFrame, key: str, path: str, *order: str) -> DataFrame:
    """The first row of each path in any case, in the given order."""
    w = W.partitionBy(key, F.lower(X.slashed(path))).orderBy(*order)
    return rows.withColumn("first_", F.row_number().over(w)).where("first_ = 1").drop("first_")


def planned(requests: DataFrame, files: DataFrame, candidates: DataFrame, request_id: str = "request_id", root: str = "workspace_root") -> DataFrame:
    """request_id, place, kind, target_file, stage: the planned targets of each request.

    ``requests`` are routed ones (see ``requests.routed``); ``files``: workspace_root, relative_path of all
    files; ``candidates``: request_id, relative_path, rank of a search.  A path that does not exist is planned
    only as documentation or where the request asks for something new.
    """
    requests, candidates = cut(requests.select(request_id, root, "prompt", "active_file", "project_scope", "wants_documentation", "wants_code", "wants_creation", "documentation_optional")), cut(candidates)  # each is read several times
    base = requests.select(request_id, root, "project_scope", "wants_documentation", "wants_code", "wants_creation", "documentation_optional", X.relative_to("active_file", root).alias("active_rel"), X.slashed("active_file").alias("active_abs"))
    cand = candidates.select(F.col(request_id).alias("c_id"), X.slashed("relative_path").alias("c_path"), F.col("rank").alias("c_rank"))
    roots = base.select(F.col(root).alias("a_root")).distinct()
    paths = files.select(F.col(root).alias("e_root"), X.slashed("relative_path").alias("e_path"))
    exists = cut(paths.join(roots, F.col("e_root") == F.col("a_root"), "left_semi").distinct())
    # 1: explicit paths; a candidate of that path, else the last candidate of that name, else itself
    by_path = cand.groupBy("c_id", F.lower("c_path").alias("k_")).agg(F.max_by("c_path", "c_rank").alias("by_path"))
    by_name = cand.groupBy("c_id", F.lower(X.file_name("c_path")).alias("k_")).agg(F.max_by("c_path", "c_rank").alias("by_name"))
    e = explicit_paths(requests, request_id)
    e = e.join(by_path.withColumnsRenamed({"c_id": "p_id", "k_": "p_k"}), (F.col(request_id) == F.col("p_id")) & (F.lower("path") == F.col("p_k")), "left")
    e = e.join(by_name.withColumnsRenamed({"c_id": "n_id", "k_": "n_k"}), (F.col(request_id) == F.col("n_id")) & (F.lower(X.file_name("path")) == F.col("n_k")), "left")
    e = e.select(request_id, "ordinal", F.coalesce("by_path", "by_name", "path").alias("target_file")).join(base, request_id)
    e = e.join(exists, (F.col(root) == F.col("e_root")) & (F.col("target_file") == F.col("e_path")), "left").withColumn("there", F.col("e_path").isNotNull())
    doc = X.is_documentation("target_file")
    kind = F.when(doc, "update_documentation").when(F.col("there"), "update_file").when(F.col("wants_creation"), "create_file")
    stage1 = e.withColumn("kind", kind).where("kind is not null").select(request_id, F.lit(1).alias("stage"), F.col("ordinal").cast("bigint").alias("ordinal"), "kind", "target_file")
    # 2: the active file, unless only documentation is asked for or the scope is the project
    below = F.coalesce((F.col("active_rel") != "") & (F.col("active_rel") != F.col("active_abs")), F.lit(False))
    stage2 = base.where((~F.col("wants_documentation") | F.col("wants_code")) & ~F.col("project_scope") & below).select(request_id, F.lit(2).alias("stage"), F.lit(0).cast("bigint").alias("ordinal"), F.lit("update_file").alias("kind"), F.col("active_rel").alias("target_file"))
    # 3: documentation: README.md, else the first candidate that documents, else docs/README.md
    has = lambda p: exists.where(F.col("e_path") == p).select(F.col("e_root"))
    wants = base.where(F.col("wants_documentation") & ~F.col("documentation_optional")).select(request_id, root)
    first_doc = cand.where(X.is_documentation("c_path")).groupBy("c_id").agg(F.min_by("c_path", "c_rank").alias("doc_path"))
    d = wants.join(has("README.md").withColumnRenamed("e_root", "r1"), F.col(root) == F.col("r1"), "left").join(first_doc, F.col(request_id) == F.col("c_id"), "left").join(has("docs/README.md").withColumnRenamed("e_root", "r2"), F.col(root) == F.col("r2"), "left")
    target = F.when(F.col("r1").isNotNull(), "README.md").when(F.col("doc_path").isNotNull(), F.col("doc_path")).when(F.col("r2").isNotNull(), "docs/README.md")
    stage3 = d.withColumn("target_file", target).where("target_file is not null").select(request_id, F.lit(3).alias("stage"), F.lit(0).cast("bigint").alias("ordinal"), F.lit("update_documentation").alias("kind"), "target_file")
    earlier = cut(first_wins(stage1.unionAll(stage2).unionAll(stage3), request_id, "target_file", "stage", "ordinal"))
    # 4: ranked candidates that do not document, at most two of a folder with what was taken before; the root is free
    most = F.when(F.col("project_scope"), fixed.PLANNED_IN_PROJECT).otherwise(fixed.PLANNED)
    seeds = earlier.groupBy(F.col(request_id).alias("s_id"), X.parent("target_file").alias("s_dir")).agg(F.count("*").alias("taken"))
    code = cand.where(~X.is_documentation("c_path")).withColumn("dir_", X.parent("c_path"))
    code = code.withColumn("before_", F.row_number().over(W.partitionBy("c_id", "dir_").orderBy("c_rank")) - 1)
    code = code.join(seeds, (F.col("c_id") == F.col("s_id")) & (F.col("dir_") == F.col("s_dir")), "left")
    admitted = code.where((F.col("dir_") == "") | (F.coalesce("taken", F.lit(0)) + F.col("before_") < fixed.PLANNED_PER_DIRECTORY))
    stage4 = admitted.select(F.col("c_id").alias(request_id), F.lit(4).alias("stage"), F.col("c_rank").cast("bigint").alias("ordinal"), F.lit("update_file").alias("kind"), F.col("c_path").alias("target_file"))
    every = first_wins(earlier.unionAll(stage4), request_id, "target_file", "stage", "ordinal")
    placed = every.withColumn("place", F.row_number().over(W.partitionBy(request_id).orderBy("stage", "ordinal")))
    placed = placed.where(F.col("place") <= max(fixed.PLANNED, fixed.PLANNED_IN_PROJECT))  # a literal, so each task keeps no more
    return placed.join(base.select(F.col(request_id).alias("b_id"), most.alias("most")), F.col(request_id) == F.col("b_id")).where("place <= most").select(request_id, "place", "kind", "target_file", "stage")
