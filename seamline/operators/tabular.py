"""Marks of students and the like: row averages, levels, the mean of a class, a point lookup, a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def row_average(*columns: str) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / len(columns)


def students(raw: DataFrame) -> DataFrame:
    """name, math, english, python from records of strings: missing marks are 0, python has the alias python_score."""
    number = lambda *names: F.coalesce(*[F.try_to_number(F.col(n), F.lit("999999")).cast("int") for n in names if n in raw.columns], F.lit(0))
    name = F.coalesce("name", F.lit("")) if "name" in raw.columns else F.lit("")
    return raw.select(name.alias("name"), number("math").alias("math"), number("english").alias("english"), number("python", "python_score").alias("python"))


def with_level(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("average", row_average(*columns)).withColumn("level", X.grade("average"))


def class_average(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the mean of the row averages, 0.0 for no rows."""
    return df.agg(F.coalesce(F.avg(row_average(*columns)), F.lit(0.0)).alias("class_average"))


def find_first(df: DataFrame, column: str, value, order: str) -> DataFrame:
    """The first row with a value; no row if there is none."""
    return df.where(F.col(column) == value).orderBy(order).limit(1)
