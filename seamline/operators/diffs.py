"""Line diffs: common beginning and end, changed lines, a unified text; array functions inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal elements at the beginning."""
    n = F.least(F.size(a), F.size(b))
    equal = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    stop = F.array_position(equal, F.lit(False))
    return F.when(n == 0, 0).when(stop == 0, n).otherwise(stop - 1).cast("int")


def common_suffix(a: Column, b: Column, prefix: Column) -> Column:
    """Number of equal elements at the end, none of them in the common beginning."""
    rest = lambda x: F.reverse(F.slice(x, prefix + 1, F.greatest(F.size(x) - prefix, F.lit(0))))
    return common_prefix(rest(a), rest(b))


def bounds(df: DataFrame, original: str = "original_content", updated: str = "updated_content") -> DataFrame:
    """``df`` with old_lines, new_lines, prefix, suffix, removed, added."""
    d = df.withColumns({"old_": X.lines(original), "new_": X.lines(updated)})
    d = d.withColumn("prefix", common_prefix(F.col("old_"), F.col("new_")))
    d = d.withColumn("suffix", common_suffix(F.col("old_"), F.col("new_"), F.col("prefix")))
    return d.withColumns(
        {"old_lines": F.size("old_"), "new_lines": F.size("new_"), "removed": F.size("old_") - F.col("prefix") - F.col("suffix"), "added": F.size("new_") - F.col("prefix") - F.col("suffix")}
    )


def unified(df: DataFrame, kind: str = "kind", target: str = "target_file", original: str = "original_content", updated: str = "updated_content") -> DataFrame:
    """``df`` with ``diff``: header, then a hunk of a new file, a mark of no change, or the changed lines in context.

    Beyond the greatest number of lines the rest is counted in a last line.
    """
    d = bounds(df, original, updated)
    old, new, p, s = F.col("old_"), F.col("new_"), F.col("prefix"), F.col("suffix")
    lead = lambda arr, mark: F.transform(arr, lambda x: F.concat(F.lit(mark), x))
    part = lambda arr, begin, end: F.slice(arr, begin + 1, F.greatest(end - begin, F.lit(0)))
    header = F.array(F.concat(F.lit("--- "), F.when(F.col(kind) == "create_file", "(new file)").otherwise(F.col(target))), F.concat(F.lit("+++ "), F.col(target)))
    start = F.greatest(F.lit(0), p - fixed.DIFF_CONTEXT)
    end = F.least(F.size(old), F.size(old) - s + fixed.DIFF_CONTEXT)
    changed = F.concat(
        header,
        F.array(F.format_string("@@ around line %d @@", p + 1)),
        lead(part(old, start, p), "  "),
        lead(part(old, p, F.size(old) - s), "- "),
        lead(part(new, p, F.size(new) - s), "+ "),
        lead(part(old, F.size(old) - s, end), "  "),
    )
    fresh = F.concat(header, F.array(F.lit("@@ new file @@")), lead(new, "+ "))
    whole = F.when((F.size(old) == 0) & (F.size(new) > 0), fresh).when((F.col("removed") == 0) & (F.col("added") == 0), F.concat(header, F.array(F.lit("@@ no changes @@")))).otherwise(changed)
    d = d.withColumn("all_", whole)
    over = F.size("all_") - fixed.DIFF_LINES
    text = F.when(over <= 0, F.array_join("all_", "\n")).otherwise(F.array_join(F.concat(F.slice("all_", 1, fixed.DIFF_LINES), F.array(F.format_string("... (%d more diff lines omitted)", over))), "\n"))
    return d.withColumn("diff", text).drop("all_", "old_", "new_")
