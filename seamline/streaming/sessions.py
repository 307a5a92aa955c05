"""Sessions of an interface: their state as streams of events change it, kept by key and stored by upserts.

``interface_states`` and ``proposal_states`` are the streaming forms of the batch twins in ``emission``; the state of
one session is what its interface shows, never its whole history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import context

STATE = "n_messages bigint, status string, proposal string, buffer string, last_agent string, last_user string"
#: What an interface shows that has no stored state.
DEFAULTS = {"n_messages": 0, "status": "", "proposal": None, "buffer": "", "last_agent": "", "last_user": ""}


def _start() -> tuple:
    return tuple(DEFAULTS.values())


def reduced(state: tuple, kind: str, role: str | None, text: str | None) -> tuple:
    """The state after one event; unknown types change nothing."""
    n, status, proposal, buffer, agent, user = state
    t = text or ""
    if kind == "hydrate":
        return n, t, None, "", agent, user
    if kind == "message":
        mine = role == "agent"
        return n + 1, status, proposal, "" if mine else buffer, t if mine else agent, t if role == "user" else user
    if kind == "messageChunk" and role == "agent":
        return n, status, proposal, buffer + t, agent, user
    if kind == "status":
        return n, t, proposal, buffer, agent, user
    if kind == "proposal":
        return n, status, text, buffer, agent, user
    if kind == "clearProposal":
        return n, status, None, buffer, agent, user
    return state


def _folded(stream: DataFrame, key: str, out: str, state: str, start, step, row) -> DataFrame:
    def fold(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(held.get) if held.exists else start()
        seq = -1
        for e in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            now, seq = step(now, e), e.seq
        held.update(now)
        yield pd.DataFrame([(k[0], seq, *row(now))], columns=[c.split()[0] for c in f"{key} bigint, seq bigint, {out}".split(", ")])

    return stream.groupBy(key).applyInPandasWithState(fold, outputStructType=f"{key} bigint, seq bigint, {out}", stateStructType=state, outputMode="update", timeoutConf=GroupStateTimeout.NoTimeout)


def _none(x):
    return None if x is None or x != x else x


def interface_states(stream: DataFrame, key: str = "session_id") -> DataFrame:
    """key, seq and the state of each session that a batch of events (key, seq, type, role, text) has changed."""
    return _folded(stream, key, STATE, STATE, _start, lambda now, e: reduced(now, e.type, _none(e.role), _none(e.text)), lambda now: now)


def proposal_step(now: tuple, kind: str) -> tuple:
    """(is a proposal open, is it a final one) after one event: prompt, patch, proposal, apply or discard."""
    opened, final = now
    if kind in ("prompt", "discard") or (kind == "apply" and opened and final):
        return False, False
    return (True, kind == "proposal") if kind in ("patch", "proposal") else now


def proposal_states(stream: DataFrame, key: str = "session_id") -> DataFrame:
    """key, seq, open, appliable after each batch of events (key, seq, type)."""
    return _folded(stream, key, "open boolean, appliable boolean", "open boolean, final boolean", lambda: (False, False), lambda now, e: proposal_step(now, e.type), lambda now: (now[0], now[0] and now[1]))


def snapshots(states: DataFrame, key: str = "session_id") -> DataFrame:
    """What each changed session broadcasts: its state with the expression that goes with it."""
    streaming = F.col("buffer") != ""
    return states.withColumns({"is_streaming": streaming}).withColumn("expression", context.expression_of_status("status", "is_streaming"))


def upsert(stored: DataFrame, changed: DataFrame, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """The newest state of each session of both tables (of the same columns)."""
    both = stored.unionByName(changed)
    rest = [c for c in both.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("s_"))
    return newest.select(key, "s_.*").select(*both.columns)


def store(stream: DataFrame, folder: str, checkpoint: str, key: str = "session_id"):
    """A running query that keeps the newest state of every session in ``folder``, one version a batch.

    A batch writes version n from version n - 1 and is repeatable, so one that is run again changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest(spark, folder, batch.schema, number)
        upsert(before, batch, key).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def latest(spark: SparkSession, folder: str, schema: T.StructType, below: int | None = None) -> DataFrame:
    """The last stored version (before ``below``), no rows if there is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return spark.createDataFrame([], schema)
    names = [s.getPath().getName() for s in system.listStatus(path)]
    numbers = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    numbers = [n for n in numbers if below is None or n < below]
    return spark.read.schema(schema).parquet(f"{folder}/version={max(numbers)}") if numbers else spark.createDataFrame([], schema)


def restored(session: DataFrame, stored: DataFrame, key: str = "session_id") -> DataFrame:
    """The state each session (key) starts with: its stored one field by field, defaults where it has none."""
    s = stored.select(F.col(key).alias("s_"), *[F.col(c).alias(f"s_{c}") for c in DEFAULTS])

    def field(c: str) -> Column:
        default = F.lit(DEFAULTS[c])
        return F.coalesce(F.col(f"s_{c}"), default if DEFAULTS[c] is not None else default.cast("string")).alias(c)

    return session.select(key).join(s, F.col(key) == F.col("s_"), "left").select(key, *[field(c) for c in DEFAULTS])
