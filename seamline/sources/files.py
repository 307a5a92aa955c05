"""Files and JSON documents as tables.

A workspace is read in two scans: one of paths and lengths, whose filters reach the source, and one of the
contents of the few files that were chosen.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import profile as P
from ..functions import text as X
from ..operators import retrieval as R


def listing(spark: SparkSession, root: str) -> DataFrame:
    """absolute_path, relative_path, file_name, suffix, size_bytes of the files below ``root``; no content is read.

    The ``binaryFile`` source leaves out files without bytes; ``walked`` lists them too.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    path = F.regexp_replace("path", r"^file:/*", "/")
    return df.select(path.alias("absolute_path"), X.relative_to(path, F.lit(root)).alias("relative_path"), X.file_name(path).alias("file_name"), X.suffix(path).alias("suffix"), F.col("length").alias("size_bytes"))


def walked(spark: SparkSession, root: str) -> DataFrame:
    """The same columns from a walk of the driver, which also sees files without bytes; for one workspace."""
    rows = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in fixed.IGNORED_DIRECTORIES)
        for n in sorted(names):
            p = os.path.join(folder, n)
            try:
                rows.append((p, os.path.relpath(p, root), n, os.path.splitext(n)[1].lower(), os.path.getsize(p)))
            except OSError:
                continue
    return spark.createDataFrame(rows, "absolute_path string, relative_path string, file_name string, suffix string, size_bytes bigint")


def workspace_files(spark: SparkSession, root: str, most: int = fixed.MAX_SCANNED_FILES) -> DataFrame:
    """The searchable files of a workspace, the first ``most`` by path."""
    return R.searchable(listing(spark, root)).orderBy("absolute_path").limit(most)


def contents(spark: SparkSession, root: str, chosen: DataFrame) -> DataFrame:
    """absolute_path, full_content of the files of ``chosen``: UTF-8, else GBK, else what is valid of it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", r"^file:/*", "/").alias("p_"), "content")
    return chosen.select("absolute_path").join(raw, F.col("absolute_path") == F.col("p_")).select("absolute_path", P.decoded("content").alias("full_content"))


def _system(spark: SparkSession, path: str):
    """(file system, path) of an address of any store that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


STUDENT = "name string, math string, english string, python string, python_score string"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array; no rows for a missing file, nulls for what does not parse."""
    system, place = _system(spark, path)
    if not system.exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """One pretty array in one file of any store, for small tables: rows in the order of a column."""
    import json

    rows = [json.loads(r[0]) for r in df.orderBy(order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    system, place = _system(df.sparkSession, path)
    out = system.create(place, True)
    out.write(bytearray(json.dumps(rows, ensure_ascii=False, indent=2).encode()))
    out.close()


PROFILE_FIELDS = ("provider", "runtime_model", "fallback_model", "base_model", "description", "adapter_path", "modelfile_path", "train_data_dir", "eval_data_dir")


def profiles(documents: DataFrame, text: str = "value") -> DataFrame:
    """profile_name, is_default and the fields of each profile of a JSON document of profiles."""
    schema = "default_profile string, profiles map<string, struct<" + ", ".join(f"{f}: string" for f in PROFILE_FIELDS) + ">>"
    d = documents.select(F.from_json(text, schema).alias("d"))
    rows = d.select(F.col("d.default_profile").alias("default_"), F.explode("d.profiles").alias("profile_name", "p"))
    return rows.select("profile_name", (F.col("profile_name") == F.col("default_")).alias("is_default"), *[F.col(f"p.{f}").alias(f) for f in PROFILE_FIELDS])


def presets(documents: DataFrame, text: str = "value") -> DataFrame:
    """Avatar presets of a JSON array: id and label must be there; blank addresses become null."""
    rows = documents.select(F.explode(F.from_json(text, "array<struct<id: string, label: string, avatarUri: string, vrmUri: string>>")).alias("p")).select("p.*")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.where("coalesce(id, '') <> '' and coalesce(label, '') <> ''").select("id", "label", blank("avatarUri").alias("avatarUri"), blank("vrmUri").alias("vrmUri"))


def lines_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of files that appear in a folder."""
    return spark.readStream.text(folder)
