"""Conversations: windows over ordered turns.

A conversation may hold a large share of all turns.  The last turns and the newest message come from aggregates
that combine on the map side (a bounded buffer each); only the comparison with the previous turn needs the order
of all turns, and takes it by joining each turn with its neighbour in blocks of turn numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X

ROLES = ("user", "agent")


def last_turns(turns: DataFrame, n: int = fixed.HISTORY_TURNS, conv: str = "conv_id", turn: str = "turn", roles: tuple[str, ...] = ROLES, salt: int = 32) -> DataFrame:
    """The last ``n`` turns of the given roles of each conversation.

    First the last ``n`` of each of ``salt`` parts of a conversation, then of those: no task sorts a whole one.
    """
    part = F.pmod(F.col(turn), F.lit(salt))
    first = W.partitionBy(conv, "part_").orderBy(F.desc(turn))
    kept = turns.where(F.col("role").isin(*roles)).withColumn("part_", part).withColumn("r_", F.row_number().over(first)).where(F.col("r_") <= n).drop("r_", "part_")
    return kept.withColumn("r_", F.row_number().over(W.partitionBy(conv).orderBy(F.desc(turn)))).where(F.col("r_") <= n).drop("r_")


def history_text(turns: DataFrame, n: int = fixed.HISTORY_TURNS, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, history: 'role: content' lines of the last turns, oldest first; null contents count as empty."""
    line = F.concat(F.col("role"), F.lit(": "), X.strip(X.blank_to_empty("content")))
    kept = last_turns(turns, n, conv, turn).select(conv, turn, line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("line").alias("l")))), lambda x: x["l"])
    return kept.groupBy(conv).agg(F.array_join(lines, "\n").alias("history"))


def continuations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", block: int = 1000) -> DataFrame:
    """conv, turn, is_continuation: does a turn have the role of the one before it?  False for the first.

    Turns are compared inside blocks of turn numbers; the first of a block is compared with the last of the
    block before that has any.
    """
    t = turns.select(conv, turn, "role", F.floor(F.col(turn) / block).alias("block_"))
    inside = F.lag("role").over(W.partitionBy(conv, "block_").orderBy(turn))
    ends = t.groupBy(conv, "block_").agg(F.max_by("role", turn).alias("last_"))
    before = ends.select(F.col(conv).alias("c_"), F.col("block_").alias("b_"), F.lag("last_").over(W.partitionBy(conv).orderBy("block_")).alias("before_"))
    first = F.row_number().over(W.partitionBy(conv, "block_").orderBy(turn)) == 1
    j = t.withColumn("prev_", inside).withColumn("first_", first).join(before, (F.col(conv) == F.col("c_")) & (F.col("block_") == F.col("b_")))
    previous = F.when(F.col("first_"), F.col("before_")).otherwise(F.col("prev_"))
    return j.select(conv, turn, F.coalesce(previous == F.col("role"), F.lit(False)).alias("is_continuation"))


def latest_by_role(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, latest_user, latest_agent: the newest message of each role, empty if there is none."""
    newest = lambda role: F.coalesce(F.max_by(F.coalesce(F.col("content"), F.lit("")), F.when(F.col("role") == role, F.col(turn))), F.lit(""))
    known = lambda role: F.count_if(F.col("role") == role) > 0
    return turns.groupBy(conv).agg(F.when(known("user"), newest("user")).otherwise("").alias("latest_user"), F.when(known("agent"), newest("agent")).otherwise("").alias("latest_agent"))
