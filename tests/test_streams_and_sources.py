"""Streaming forms against their batch twins and a plain loop; files, profiles, presets."""

import random

import pytest
from pyspark.sql import functions as F

from seamline.functions import profile as P
from seamline.sources import files as S
from seamline.streaming import emission as E


def loop_snapshots(chunks):
    out, raw, sent = [], "", 0
    for c in chunks:
        raw += c
        now = E.clean_file(raw)
        if E.is_due(sent, now):
            out.append(len(now))
            sent = len(now)
    if now and len(now) != sent:
        out.append(len(now))
    return out


def test_worked_snapshots():
    lengths, chunks, have = [10, 30, 60, 160, 170], [], 0
    for n in lengths:
        chunks.append("x" * (n - have))
        have = n
    assert loop_snapshots(chunks) == [30, 160, 170]


def test_batch_twins_match_loops(spark):
    rng = random.Random(2)
    pieces = ["abc ", "<think>no</think>", "\n", "x" * 50, "<think>", "</think>", "y" * 130, "<summary>s</summary>", "```py\n"]
    streams = {k: [rng.choice(pieces) for _ in range(12)] for k in range(6)}
    rows = [(k, i, c) for k, cs in streams.items() for i, c in enumerate(cs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k bigint, seq int, chunk string")
    got = {k: [] for k in streams}
    for r in E.snapshots(df, "k").orderBy("k", "ordinal").collect():
        got[r["k"]].append(r["length"])
    assert got == {k: loop_snapshots(cs) for k, cs in streams.items()}
    want = []
    for k, cs in streams.items():
        raw = before = ""
        for i, c in enumerate(cs):
            raw += c
            now = E.clean_chat(raw)
            if now[len(before) :]:
                want.append((k, i, now[len(before) :]))
            before = now
    assert sorted((r["k"], r["step"], r["delta"]) for r in E.deltas(df, "k").collect()) == sorted(want)


def run_stream(spark, tmp_path, rows, schema, fn, name):
    folder = str(tmp_path / name)
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = fn(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        q.processAllAvailable()
        return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]
    finally:
        q.stop()


def test_streaming_equals_batch(spark, tmp_path):
    chunks = ["<think>a", "</think>he", "llo ", "x" * 130, "\n" + "y" * 60 + "\n", "end"]
    rows = [(1, i, c, i == len(chunks) - 1) for i, c in enumerate(chunks)]
    schema = "stream_id bigint, seq int, chunk string, done boolean"
    parts = [rows[:2], rows[2:4], rows[4:]]
    deltas = run_stream(spark, tmp_path, parts, schema, lambda s: E.stream_deltas(s.select("stream_id", "seq", "chunk")), "deltas")
    batch = spark.createDataFrame(rows, schema)
    assert sorted(deltas) == sorted((r["stream_id"], r["step"], r["delta"]) for r in E.deltas(batch, "stream_id").collect())
    snaps = run_stream(spark, tmp_path, parts, schema, E.stream_snapshots, "snaps")
    assert [len(c) for _, _, c in sorted(snaps)] == loop_snapshots(chunks)


def test_framing_carries_over(spark, tmp_path):
    rows = [[(1, 0, '{"a"'), (1, 1, ":1}\n\n{")], [(1, 2, '"b":2}\nrest')]]
    got = run_stream(spark, tmp_path, rows, "stream_id bigint, seq int, piece string", E.framed_lines, "framed")
    assert sorted(got) == [(1, '{"a":1}'), (1, '{"b":2}')]


def test_interface_and_proposals(spark):
    ev = [("hydrate", "agent", "h"), ("messageChunk", "agent", "a"), ("status", "x", "s1"), ("message", "agent", "m"), ("proposal", "agent", "p"), ("messageChunk", "agent", "b"), ("messageChunk", "user", "no"), ("messageChunk", "agent", None), ("messageChunk", "agent", "c")]
    df = spark.createDataFrame([(1, i, *e) for i, e in enumerate(ev)], "s bigint, seq int, type string, role string, text string")
    assert tuple(E.interface_state(df, "s").first()) == (1, 1, "s1", "p", "bc")
    cases = {1: ["proposal"], 2: ["patch"], 3: ["patch", "proposal", "apply"], 4: ["patch", "apply"], 5: ["proposal", "prompt"], 6: ["prompt"], 7: ["proposal", "discard", "patch"]}
    rows = [(s, i, t) for s, ts in cases.items() for i, t in enumerate(ts)]
    got = {r["s"]: (r["open"], r["appliable"]) for r in E.proposal_states(spark.createDataFrame(rows, "s bigint, seq int, type string"), "s").collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (True, False), 5: (False, False), 6: (False, False), 7: (True, False)}


def test_progress(spark):
    df = spark.createDataFrame([(1, "a" * 1000), (2, ""), (3, None)], "k bigint, t string")
    got = [tuple(r) for r in E.progress(df, "k", "t").orderBy("k", "step").collect()]
    assert got[:5] == [(1, 0, 24, 250), (1, 1, 48, 500), (1, 2, 71, 750), (1, 3, 95, 1000), (1, 4, 100, 1000)] and got[5:] == [(2, 0, 95, 0), (2, 1, 100, 0), (3, 0, 95, 0), (3, 1, 100, 0)]


def test_workspace_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, data in (("a.py", b"x = 1"), ("b.txt", "中文".encode("gbk")), ("c.bin", b"1"), ("empty.py", b""), ("big.md", b"x" * 120_001), ("edge.md", b"x" * 120_000), ("node_modules/d.py", b"1")):
        (tmp_path / name).write_bytes(data)
    found = S.workspace_files(spark, str(tmp_path))
    assert sorted(r["relative_path"] for r in found.collect()) == ["a.py", "b.txt", "edge.md"]
    texts = {r["absolute_path"].rsplit("/", 1)[1]: r["full_content"] for r in S.contents(spark, str(tmp_path), found).collect()}
    assert texts["a.py"] == "x = 1" and texts["b.txt"] == "中文"
    assert "empty.py" in {r["relative_path"] for r in S.walked(spark, str(tmp_path)).collect()}


def test_decode_fallbacks(spark):
    rows = spark.createDataFrame([(b"a\xc3\xa9",), ("中".encode("gbk"),), (b"a\xff",), (None,)], "b binary")
    assert [r["x"] for r in rows.select(P.decoded("b").alias("x")).collect()] == ["aé", "中", "a", ""]


def test_json_round_trip_and_profiles(spark, tmp_path):
    path = str(tmp_path / "x/s.json")
    assert S.json_array(spark, path, S.STUDENT).count() == 0
    S.write_json_array(spark.createDataFrame([("b", "2"), ("a", None)], "name string, math string"), path, "name")
    assert [(r["name"], r["math"]) for r in S.json_array(spark, path, S.STUDENT).orderBy("name").collect()] == [("a", None), ("b", "2")]
    doc = spark.createDataFrame([('{"default_profile":"p","profiles":{"p":{"provider":"x"},"q":{}}}',), ("bad",)], "value string")
    assert sorted((r["profile_name"], r["is_default"], r["provider"]) for r in S.profiles(doc).collect()) == [("p", True, "x"), ("q", False, None)]
    pre = spark.createDataFrame([('[{"id":"a","label":"A","avatarUri":" "},{"id":"","label":"B"}]',)], "value string")
    assert [tuple(r) for r in S.presets(pre).collect()] == [("a", "A", None, None)]


def test_python_structure(spark):
    src = "import os, sys\nfrom . import x\nclass A:\n    def m(self):\n        try:\n            pass\n        except Exception:\n            print(1)\n            print(2)\n            print(3)\n" + "def long():\n" + "    a = 1\n" * 24
    r = spark.createDataFrame([(src,), ("def (",), (None,)], "t string").select(P.python_structure("t").alias("s")).select("s.*").collect()
    assert r[0]["imports"] == ["os", "sys", "(relative)"] and r[0]["functions"] == ["A.m", "long"] and r[0]["long_functions"] == ["long(25 lines)"] and r[0]["broad_excepts"] == ["m"] and r[0]["print_heavy"] == ["m(3 prints)"] and r[0]["error_line"] is None
    assert r[1]["error_line"] == 1 and r[2]["line_count"] == 0


@pytest.mark.parametrize("text", ["a\nb", "a\n", "", "a\r\nb\x0bc\u2028", None, "\n\n"])
def test_line_counts_like_splitlines(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(P.split_line_count("t").alias("n")).first()["n"]
    assert got == len((text or "").splitlines())


def test_no_core_module_needs_the_subpackage():
    import pathlib

    root = pathlib.Path(S.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text(encoding="utf-8"), p


def test_entry_queries_and_sql_agree_on_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert F.col("x") is not None
