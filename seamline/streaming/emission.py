"""Streams of model output: deltas, debounced snapshots, interface state; as streaming operators and as batch twins.

A stream is the output of one request, so its state is bounded by one answer.  The streaming forms keep that
state by key; the batch twins fold the ordered chunks of a key inside one row and give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..functions import text as X


def _python(pattern: str) -> str:
    """A pattern of ``fixed`` as Python writes the end of a text."""
    return pattern.replace(r"\z", r"\Z")


def clean_chat(text: str) -> str:
    """Answer so far without think spans."""
    return re.sub(_python(fixed.OPEN_THOUGHT), "", re.sub(fixed.THOUGHT, "", text))


def clean_file(text: str) -> str:
    """File content so far."""
    out = re.sub(fixed.SUMMARY_BLOCK + r"\s*", "", clean_chat(text))
    for pattern in fixed.FILE_EDGES:
        out = re.sub(_python(pattern), "", out)
    return out.strip()


def is_due(previous: int, content: str) -> bool:
    """Is a snapshot of ``content`` due when the last one that was sent had ``previous`` characters?"""
    grown = len(content) - previous
    if previous == 0:
        return len(content) >= fixed.FIRST_SNAPSHOT
    return grown >= fixed.NEXT_SNAPSHOT or (content.endswith("\n") and grown >= fixed.LINE_SNAPSHOT)


# --- batch twins -------------------------------------------------------------------------------------------


def _ordered(events: DataFrame, key: str, seq: str, chunk: str) -> DataFrame:
    c = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce(F.col(chunk), F.lit("")).alias("c")))), lambda x: x["c"])
    return events.groupBy(key).agg(c.alias("chunks"))


def _prefixes(clean) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("chunks")), lambda i: clean(F.array_join(F.slice(F.col("chunks"), F.lit(1), i), "")))


def deltas(events: DataFrame, key: str, seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """key, step, delta: what each chunk adds to the cleaned answer; chunks that add nothing give no row."""
    p = _ordered(events, key, seq, chunk).select(key, F.posexplode(F.arrays_zip(_prefixes(X.partial_chat).alias("now"), F.concat(F.array(F.lit("")), _prefixes(X.partial_chat)).alias("before"))).alias("step", "x"))
    d = p.where("x.now is not null").select(key, "step", F.col("x.now").alias("now"), F.substring("x.now", F.length("x.before") + 1, F.lit(2147483647)).alias("delta"))
    return d.where("delta <> ''").select(key, "step", "delta")


def snapshots(events: DataFrame, key: str, seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """key, ordinal, length: lengths of the snapshots that are sent, the last unsent content included.

    The point of reference moves only when one is sent, so this is a fold, not a lag.
    """
    state = "struct<sent:int,out:array<int>,last:int>"
    contents = _ordered(events, key, seq, chunk).select(key, F.transform(_prefixes(X.partial_file), lambda c: F.struct(F.length(c).alias("n"), c.endswith("\n").alias("nl"))).alias("contents"))

    def step(acc: Column, x: Column) -> Column:
        grown = x["n"] - acc["sent"]
        due = F.when(acc["sent"] == 0, x["n"] >= fixed.FIRST_SNAPSHOT).otherwise((grown >= fixed.NEXT_SNAPSHOT) | (x["nl"] & (grown >= fixed.LINE_SNAPSHOT)))
        return F.struct(F.when(due, x["n"]).otherwise(acc["sent"]).alias("sent"), F.when(due, F.concat(acc["out"], F.array(x["n"]))).otherwise(acc["out"]).alias("out"), x["n"].alias("last")).cast(state)

    start = F.struct(F.lit(0).alias("sent"), F.array().cast("array<int>").alias("out"), F.lit(0).alias("last")).cast(state)
    folded = contents.select(key, F.aggregate("contents", start, step).alias("s"))
    flushed = F.when((F.col("s.last") > 0) & (F.col("s.last") != F.col("s.sent")), F.concat("s.out", F.array("s.last"))).otherwise(F.col("s.out"))
    return folded.select(key, F.posexplode(flushed).alias("ordinal", "length"))


def interface_state(events: DataFrame, session: str, seq: str = "seq") -> DataFrame:
    """The state an interface shows after all events of a session: session, n_messages, status, proposal, buffer.

    ``events``: session, seq, type, role, text.  Types: message, messageChunk, status, proposal, clearProposal,
    hydrate.  Fields come from map-side aggregates; only the chunks behind the last reset are put together.
    """
    newest = lambda value, cond: F.max_by(F.when(cond, value), F.when(cond, F.col(seq)))
    is_ = lambda *t: F.col("type").isin(*t)
    reset = (is_("message") & (F.col("role") == "agent")) | is_("hydrate")
    heads = events.groupBy(session).agg(
        F.max(F.when(reset, F.col(seq))).alias("reset_"),
        F.count_if(is_("message")).alias("n_messages"),
        newest(F.col("text"), is_("status", "hydrate")).alias("status"),
        newest(F.when(is_("proposal"), F.col("text")), is_("proposal", "clearProposal", "hydrate")).alias("proposal"),
    )
    h = heads.select(F.col(session).alias("h_"), "reset_")
    tail = events.where(is_("messageChunk") & (F.col("role") == "agent")).join(h, F.col(session) == F.col("h_")).where(F.col("reset_").isNull() | (F.col(seq) > F.col("reset_")))
    buffer = tail.groupBy(F.col(session).alias("t_")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("buffer"))
    return heads.join(buffer, F.col(session) == F.col("t_"), "left").select(session, "n_messages", F.coalesce("status", F.lit("")).alias("status"), "proposal", F.coalesce("buffer", F.lit("")).alias("buffer"))


def proposal_states(events: DataFrame, session: str, seq: str = "seq") -> DataFrame:
    """session, open, appliable: is a proposal pending, and may it be applied (only a final one may)?

    ``type``: prompt, patch (streaming proposal), proposal (final), apply, discard.  Applying a streaming
    proposal does nothing.
    """
    last_set = F.max_by("type", F.when(F.col("type").isin("patch", "proposal"), F.col(seq)))
    at_set = F.max(F.when(F.col("type").isin("patch", "proposal"), F.col(seq)))
    at_clear = F.max(F.when(F.col("type").isin("prompt", "discard"), F.col(seq)))
    at_apply = F.max(F.when(F.col("type") == "apply", F.col(seq)))
    g = events.groupBy(session).agg(last_set.alias("kind_"), at_set.alias("set_"), at_clear.alias("clear_"), at_apply.alias("apply_"))
    later = lambda c: F.coalesce(F.col(c) > F.col("set_"), F.lit(False))
    is_open = F.col("set_").isNotNull() & ~later("clear_") & ~((F.col("kind_") == "proposal") & later("apply_"))
    return g.select(session, is_open.alias("open"), (is_open & (F.col("kind_") == "proposal")).alias("appliable"))


def progress(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, step, percent, written: progress of a text written in growing prefixes, 95 % at most until it is done, then 100."""
    p = df.select(key, F.transform(X.chunk_prefixes(text), lambda x: F.length(x)).alias("p_"))
    done = F.concat("p_", F.array(F.element_at("p_", -1)))
    rows = p.select(key, F.size("p_").alias("n_"), F.posexplode(done).alias("step", "written"))
    percent = F.when(F.col("step") == F.col("n_"), 100).otherwise(F.least(F.lit(95), F.round((F.col("step") + 1) / F.col("n_") * 95).cast("int")))
    return rows.select(key, "step", percent.alias("percent"), "written")


def answer_events(answers: DataFrame, key: str) -> DataFrame:
    """key, seq, type, text: the events in which an answer is sent, numbered in their order.

    ``answers``: key, route, content, status.  An edit is sent as growing patches, a chat as chunks, a workspace answer
    as nothing but its result; a status comes first, then the pieces, a second status, and the result.
    """
    t = X.blank_to_empty("content")
    prefixes = F.when(t == "", F.array().cast("array<string>")).otherwise(X.chunk_prefixes(t))
    chunks = F.transform(prefixes, lambda x, i: F.when(i == 0, x).otherwise(F.substring(x, F.length(F.get(prefixes, i - 1)) + 1, F.lit(2147483647))))
    event = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    s = fixed.STREAM_STATUS
    status = F.when(F.col("route") == "edit", s["edit"]).when(F.col("route") == "workspace", s["workspace"]).otherwise(s["chat"])
    none = F.array().cast("array<struct<type:string,text:string>>")
    pieces = F.when(F.col("route") == "edit", F.transform(prefixes, lambda x: event("patch", x))).when(F.col("route") == "chat", F.transform(chunks, lambda x: event("message_chunk", x))).otherwise(none)
    second = F.when(F.col("route") == "workspace", none).otherwise(F.array(event("status", F.col("status"))))
    every = F.concat(F.array(event("status", status)), pieces, second, F.array(event("result", t)))
    return answers.select(key, F.posexplode(every).alias("seq", "e")).select(key, "seq", "e.type", "e.text")


FIELD_OF = {"status": "status", "message_chunk": "chunk", "patch": "updatedContent", "result": "response"}


def event_lines(events: DataFrame, key: str) -> DataFrame:
    """key, seq, line: each event as one line of JSON, the text under the name that its type has for it."""
    payload = F.struct(*[F.when(F.col("type") == kind, F.col("text")).alias(name) for kind, name in FIELD_OF.items()])
    return events.select(key, "seq", F.to_json(F.struct("type", payload.alias("payload"))).alias("line"))


def write_event_lines(stream: DataFrame, folder: str, checkpoint: str, key: str = "stream_id"):
    """A running query that appends the events of a stream as files of JSON lines; each batch is written once."""

    def write(batch: DataFrame, number: int) -> None:
        event_lines(batch, key).orderBy(key, "seq").select("line").write.mode("overwrite").text(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def dispatched(lines: DataFrame, key: str = "stream_id", seq: str = "seq", line: str = "line", ended: str = "ended") -> DataFrame:
    """key, seq, type, text of the lines of answers (key, seq, line, ended) that an event is taken from.

    A last line without its line end (``ended`` false) counts only if it is a result.  Lines that are no JSON object
    with a type give no row.
    """
    fields = ", ".join(f"{name} string" for name in FIELD_OF.values())
    e = F.from_json(line, f"type string, payload struct<{fields}>")
    text = F.coalesce(*[F.when(F.col("e.type") == kind, F.col(f"e.payload.{name}")) for kind, name in FIELD_OF.items()])
    parsed = lines.withColumn("e", e).where(F.col("e.type").isin(*FIELD_OF))
    return parsed.where(F.col(ended) | (F.col("e.type") == "result")).select(key, seq, F.col("e.type").alias("type"), text.alias("text"))


def final_answers(requests: DataFrame, events: DataFrame, plain: DataFrame, key: str = "stream_id") -> DataFrame:
    """key, content, streamed: the result of the stream, or where there is none that of a plain call (key, content)."""
    result = events.where("type = 'result'").groupBy(F.col(key).alias("e_")).agg(F.max_by("text", "seq").alias("result"), F.lit(True).alias("got"))
    p = plain.select(F.col(key).alias("p_"), F.col("content").alias("plain"))
    j = requests.select(key).join(result, F.col(key) == F.col("e_"), "left").join(p, F.col(key) == F.col("p_"), "left")
    return j.select(key, F.when(F.col("got"), F.col("result")).otherwise(F.col("plain")).alias("content"), F.coalesce("got", F.lit(False)).alias("streamed"))


# --- streaming forms ---------------------------------------------------------------------------------------


def _stateful(stream: DataFrame, key: str, schema: str, state: str, fold) -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(fold, outputStructType=schema, stateStructType=state, outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout)


def stream_deltas(stream: DataFrame, key: str = "stream_id") -> DataFrame:
    """key, step, delta of a streaming DataFrame (key, seq, chunk); chunks of a key arrive in order."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raw, sent, step = state.get if state.exists else ("", 0, 0)
        rows = []
        for chunk in pd.concat(list(batches)).sort_values("seq")["chunk"]:
            raw += chunk or ""
            now = clean_chat(raw)
            if len(now) > sent:
                rows.append((k[0], step, now[sent:]))
            sent, step = len(now), step + 1
        state.update((raw, sent, step))
        yield pd.DataFrame(rows, columns=[key, "step", "delta"])

    return _stateful(stream, key, f"{key} bigint, step int, delta string", "raw string, sent int, step int", fold)


def stream_snapshots(stream: DataFrame, key: str = "stream_id") -> DataFrame:
    """key, ordinal, content: debounced snapshots of a streaming DataFrame (key, seq, chunk, done); ``done`` flushes."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raw, sent, n = state.get if state.exists else ("", 0, 0)
        rows = []
        for chunk, done in pd.concat(list(batches)).sort_values("seq")[["chunk", "done"]].itertuples(index=False):
            raw += chunk or ""
            now = clean_file(raw)
            if is_due(sent, now) or (done and now and len(now) != sent):
                rows.append((k[0], n, now))
                sent, n = len(now), n + 1
        state.update((raw, sent, n))
        yield pd.DataFrame(rows, columns=[key, "ordinal", "content"])

    return _stateful(stream, key, f"{key} bigint, ordinal int, content string", "raw string, sent int, n int", fold)


def framed_lines(stream: DataFrame, key: str = "stream_id") -> DataFrame:
    """key, line: whole lines of a stream of arbitrary pieces (key, seq, piece); the rest is carried over."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (rest,) = state.get if state.exists else ("",)
        *lines, rest = (rest + "".join(p or "" for p in pd.concat(list(batches)).sort_values("seq")["piece"])).split("\n")
        state.update((rest,))
        yield pd.DataFrame([(k[0], ln) for ln in lines if ln.strip()], columns=[key, "line"])

    return _stateful(stream, key, f"{key} bigint, line string", "rest string", fold)
