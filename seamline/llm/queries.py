"""The ``pN_`` queries: name -> (spark, folder of the tables) -> DataFrame, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import p1_credentials as p1
from . import p2_split as p2
from . import p3_truncation as p3
from . import p4_pairs as p4
from . import p5_syntax as p5
from . import p6_encoding_ids as p6
from . import p7_packing as p7
from . import p8_encoding as p8
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.found(table(spark, sf_dir, "gen_requests"))


def p1_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.findings(table(spark, sf_dir, "gen_requests"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.redacted(table(spark, sf_dir, "gen_requests"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.found(table(spark, sf_dir, "file_snapshots"), table(spark, sf_dir, "split_limits"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.pieces(table(spark, sf_dir, "file_snapshots"), table(spark, sf_dir, "split_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.found(table(spark, sf_dir, "gen_responses"), table(spark, sf_dir, "file_actions"))


def p3_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.truncated(table(spark, sf_dir, "gen_responses"), table(spark, sf_dir, "file_actions"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.rates(table(spark, sf_dir, "gen_responses"), table(spark, sf_dir, "file_actions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4.found(table(spark, sf_dir, "gen_requests"), table(spark, sf_dir, "gen_responses"))


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4.labels(table(spark, sf_dir, "gen_requests"), table(spark, sf_dir, "gen_responses"))


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4.summary(table(spark, sf_dir, "gen_requests"), table(spark, sf_dir, "gen_responses"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5.found(table(spark, sf_dir, "file_actions"))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5.files(table(spark, sf_dir, "file_actions"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5.rates(table(spark, sf_dir, "file_actions"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.token_ids(table(spark, sf_dir, "documents"))


def p6_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.word_counts(table(spark, sf_dir, "documents"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7.packing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


def p7_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7.waste(p7_packing(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.found(table(spark, sf_dir, "documents"))


def p8_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.repaired(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: fn for name, fn in globals().items() if name[:1] == "p" and name[1:2].isdigit() and "_" in name and callable(fn)}
