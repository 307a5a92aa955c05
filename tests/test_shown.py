"""Renderings, permissions, outcomes, events and sessions: hand-worked rows, null and empty cases."""

import json

from pyspark.sql import functions as F

from seamline.functions import fixed
from seamline.operators import actions as A
from seamline.operators import parsing as G
from seamline.operators import rendering as N
from seamline.operators import requests as Q
from seamline.operators import retrieval as R
from seamline.plans import pipeline as P
from seamline.sources import files
from seamline.streaming import emission as E
from seamline.streaming import sessions as S

REQUEST = "request_id bigint, prompt string, selected_text string, active_file string, full_document_text string, workspace_root string"
FILES = "snapshot_id bigint, workspace_root string, relative_path string, absolute_path string, suffix string, size_bytes bigint, full_content string"


def test_texts_of_values(spark):
    df = spark.createDataFrame([("  ab cd", 2.675, "/w/a/../b.py", "/w"), (None, 2.5, "/v/x", "/w"), ("", 1234.125, "", None)], "t string, x double, p string, r string")
    got = [tuple(r) for r in df.select(N.cut_at("t", 4, "#"), N.fixed_point("x", 2), N.short_path("p", "r")).collect()]
    assert got == [("  ab#", f"{2.675:.2f}", "b.py"), ("", "2.50", "/v/x"), ("", f"{1234.125:.2f}", "")]


def test_permissions(spark):
    rows = [("/w/a.py", "/w", "/z/b.py", False), ("/z/b.py", "/w", "/z/./b.py", False), ("/q/c", "/w", None, True), ("/q/c", "", None, False), (" ", "/w", None, True), ("/w", "/w/", None, None), ("/wx/a", "/w", "", None)]
    df = spark.createDataFrame(rows, "t string, r string, a string, o boolean")
    assert [r[0] for r in df.select(A.permission("t", "r", "a", "o")).collect()] == ["inside_root", "active_file", "opened", "outside", "blank", "inside_root", "outside"]


def test_outcomes_follow_what_earlier_actions_wrote(spark):
    schema = "response_id bigint, action_id bigint, kind string, rel string, original_content string, updated_content string, allowed boolean, on_disk boolean, is_folder boolean, current string"
    rows = [
        (1, 1, "create_file", "a", None, "x", True, False, False, ""), (1, 2, "create_file", "a", None, "y", True, False, False, ""), (1, 3, "update_file", "a", "x\r\n", "z", True, False, False, ""), (1, 4, "update_file", "a", "x", "q", True, False, False, ""),
        (2, 5, "update_file", "b", "old", "new", True, True, False, "changed"), (2, 6, "update_file", "c", "old", "new", True, False, False, ""), (2, 7, "update_documentation", "d.md", "", "t", True, False, False, ""), (2, 8, "create_file", "e", "", "t", True, False, True, ""),
        (2, 9, "update_file", "f", "s", "s\n", True, True, False, "s"), (2, 10, "update_file", "g", "s", "t", False, True, False, "s"), (2, 11, "other", "g", "s", "t", True, True, False, "s"), (None, 12, "create_file", "h", "", "t", True, False, False, None),
    ]
    got = {r["action_id"]: r["outcome"] for r in A.outcomes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "applied", 2: "skipped", 3: "applied", 4: "skipped", 5: "skipped", 6: "skipped", 7: "applied", 8: "failed", 9: "skipped", 10: "skipped", 12: "applied"}


def test_fallback_files_and_contents_after_the_choice(spark):
    req = spark.createDataFrame([(1, "x", "/w"), (2, "x", "/none"), (3, "x", None)], "request_id bigint, prompt string, workspace_root string")
    files = spark.createDataFrame([("/none", 7, "README.md"), ("/none", 8, "src\\extension.ts"), ("/none", 9, "a.bin"), ("/w", 1, "README.md")], "workspace_root string, file_id bigint, relative_path string")
    top = spark.createDataFrame([(1, 1, "README.md", 8, "r", 1)], "request_id bigint, file_id bigint, relative_path string, score int, reason string, rank int")
    every = R.with_fallback(top, req, files)
    assert sorted((r["request_id"], r["file_id"], r["score"], r["rank"]) for r in every.collect()) == [(1, 1, 8, 1), (2, 7, fixed.FALLBACK_SCORE, 1), (2, 8, fixed.FALLBACK_SCORE, 2)]
    contents = spark.createDataFrame([(1, "text"), (1, "text"), (7, ""), (8, None)], "file_id bigint, full_content string")
    assert [(r["file_id"], r["excerpt"], r["mode"]) for r in R.with_contents(every, contents).collect()] == [(1, "text", "full")]
    assert R.with_fallback(top.limit(0), req.limit(0), files).count() == 0


def test_reports(spark):
    st = spark.createDataFrame([(1, 1, "x", 91, 87, 94), (1, 2, "y", 78, 83, 80)], "g bigint, o int, name string, a int, b int, c int")
    text = N.class_reports(st, "g", "o", "name", "a", "b", "c").first()["report"].split("\n")
    assert text[2].endswith("90.67 | 等级: A]") and text[-1].endswith("85.50") and N.class_reports(st.limit(0), "g", "o", "name", "a", "b", "c").count() == 0
    assert N.marks_average(st.limit(0), "a").first()[0] == 0.0
    prof = spark.createDataFrame([("p", None, " ", None, None, None, None, None, None, None), ("q", "x", "m", "f", "b", "d", "a", "o", "t", "e")], "profile_name string, provider string, runtime_model string, fallback_model string, base_model string, description string, adapter_path string, modelfile_path string, train_data_dir string, eval_data_dir string")
    assert tuple(N.settings(prof, "p", {"OLLAMA_MODEL_PROFILE": "gone", "OLLAMA_MODEL": "  "}, "d").first())[:4] == ("p", "ollama", "d", "none")
    assert N.settings(prof, "p", {"OLLAMA_MODEL_PROFILE": "q", "OLLAMA_MODEL": "mine"}).first()["configured_model"] == "mine" and len(N.health(N.settings(prof, "p")).first()) == 11


def test_event_protocol_round_trip(spark, tmp_path):
    rows = [(1, "edit", "x" * 1000, "s"), (2, "workspace", "plan", "s"), (3, "chat", "hello <b>\n", "s"), (4, "chat", None, None)]
    ans = spark.createDataFrame(rows, "k bigint, route string, content string, status string")
    ev = E.answer_events(ans, "k").orderBy("k", "seq").collect()
    kinds = {k: [r["type"] for r in ev if r["k"] == k] for k in (1, 2, 3, 4)}
    assert kinds == {1: ["status", *["patch"] * 4, "status", "result"], 2: ["status", "result"], 3: ["status", *["message_chunk"] * 4, "status", "result"], 4: ["status", "status", "result"]}
    assert "".join(r["text"] for r in ev if r["k"] == 3 and r["type"] == "message_chunk") == "hello <b>\n"
    lines = E.event_lines(E.answer_events(ans, "k"), "k")
    assert json.loads(lines.where("k = 2 and seq = 1").first()["line"]) == {"type": "result", "payload": {"response": "plan"}}
    back = E.dispatched(lines.withColumn("ended", F.col("k") != 3), "k").collect()
    assert {r["type"] for r in back if r["k"] == 3} == {"result"} and len([r for r in back if r["k"] == 1]) == 7
    got = E.final_answers(ans.select("k"), E.dispatched(lines.where("k <> 2").withColumn("ended", F.lit(True)), "k"), ans.select("k", F.lit("plain").alias("content")), "k")
    assert {r["k"]: (r["content"], r["streamed"]) for r in got.collect()} == {1: ("x" * 1000, True), 2: ("plain", False), 3: ("hello <b>\n", True), 4: ("", True)}
    src = str(tmp_path / "in")
    E.answer_events(ans, "k").withColumnRenamed("k", "stream_id").write.parquet(src)
    q = E.write_event_lines(spark.readStream.schema("stream_id bigint, seq int, type string, text string").parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.text(str(tmp_path / "out")).count() == len(ev)


EVENTS = [(1, 0, "status", "agent", "busy"), (1, 1, "messageChunk", "agent", "he"), (1, 2, "messageChunk", "agent", "y"), (1, 3, "messageChunk", "user", "no"), (1, 4, "proposal", "agent", "P"), (1, 5, "message", "user", "q"), (2, 0, "message", "agent", "done"), (2, 1, "proposal", None, "P"), (2, 2, "clearProposal", None, None), (2, 3, "zap", None, "?"), (3, 0, "messageChunk", "agent", "x"), (3, 1, "hydrate", None, "idle")]
WANT = {1: (1, "busy", "P", "hey"), 2: (1, "", None, ""), 3: (0, "idle", None, "")}


def test_sessions_as_streams_and_in_batch(spark, tmp_path):
    schema = "session_id bigint, seq bigint, type string, role string, text string"
    df = spark.createDataFrame(EVENTS, schema)
    batch = {r["session_id"]: (r["n_messages"], r["status"], r["proposal"], r["buffer"]) for r in E.interface_state(df, "session_id").collect()}
    assert batch == WANT
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.where("seq < 2").coalesce(1).write.parquet(src)
    stream = S.interface_states(spark.readStream.schema(schema).parquet(src))
    for k in range(2):
        q = S.store(stream, out, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        if k == 0:
            df.where("seq >= 2").coalesce(1).write.mode("append").parquet(src)
    stored = S.latest(spark, out, stream.schema)
    assert {r["session_id"]: (r["n_messages"], r["status"], r["proposal"], r["buffer"]) for r in stored.collect()} == WANT
    shown = {r["session_id"]: r["expression"] for r in S.snapshots(stored).collect()}
    assert shown == {1: "speaking", 2: "idle", 3: "idle"}
    back = {r["session_id"]: tuple(r)[1:3] for r in S.restored(spark.createDataFrame([(1,), (9,)], "session_id bigint"), stored).collect()}
    assert back == {1: (1, "busy"), 9: (0, "")}
    assert S.latest(spark, str(tmp_path / "none"), stream.schema).count() == 0


def test_proposal_steps_match_the_batch_form(spark):
    kinds = ["prompt", "patch", "proposal", "apply", "discard"]
    rows = [(k, i, kinds[(k // 5**i) % 5]) for k in range(125) for i in range(3)]
    got = {r["session_id"]: (r["open"], r["appliable"]) for r in E.proposal_states(spark.createDataFrame(rows, "session_id bigint, seq bigint, type string"), "session_id").collect()}
    for k in range(125):
        state = (False, False)
        for _, _, kind in rows[3 * k : 3 * k + 3]:
            state = S.proposal_step(state, kind)
        assert got[k] == (state[0], state[0] and state[1]), k


def test_pipeline_falls_back_to_single_files_and_repairs_edits(spark):
    req = spark.createDataFrame([(1, "create file a/new.py and update the project", "", "/w/a/x.py", "x", "/w")], REQUEST)
    files = spark.createDataFrame([(k, "/w", p, f"/w/{p}", "." + p.rsplit(".")[-1], 9, "old = 1\n") for k, p in enumerate(["a/x.py", "b/z.ts"])], FILES)

    def one_by_one(rows, attempt):
        if attempt < 3:
            return rows.withColumn("completion", F.lit("nothing"))
        broken = F.when(F.lit(attempt == 3), F.lit("def (")).otherwise(F.lit("y = 2"))
        return rows.withColumn("completion", F.concat(F.lit("<summary>s</summary><updated_content>"), broken, F.lit("</updated_content>")))

    rows = P.proposals(Q.routed(req), files, one_by_one).collect()
    assert rows and {r["attempt"] for r in rows} == {3} and all(r["updated_content"] == "y = 2" and r["usable"] for r in rows if r["target_file"].endswith(".py"))
    lone = spark.createDataFrame([(1, "fix it", "", "/w/a.py", "x = 1", None)], REQUEST)

    def second(rows, attempt):
        return rows.withColumn("completion", F.when(F.lit(attempt == 2), F.concat(F.lit("<updated_content># "), F.length("prompt").cast("string"), F.lit("</updated_content>"))).otherwise(F.lit("x = (")))

    (row,) = P.file_edits(lone, second).collect()
    assert row["attempt"] == 2 and row["error"] is None and row["updated_content"] == f"# {len(fixed.NO_WORKSPACE_PREFIX) + 6}"


def test_rankings_of_candidates(spark):
    req = spark.createDataFrame([(1, "report average", "", None, None, "/w"), (2, None, None, None, None, "/v")], REQUEST)
    files = spark.createDataFrame([(k, "/w", p, f"/w/{p}", ".py", 9, t) for k, (p, t) in enumerate([("report.py", "average of report"), ("other.py", "storage json"), ("empty.py", "")])], FILES)
    cand = P.candidates(req, files)
    got = {r["request_id"]: r for r in P.rankings(req, files, cand).collect()}
    assert got[1]["prompt_text"].startswith(fixed.QUERY_HEAD) and "report.py (score=" in got[1]["prompt_text"] and got[1]["summary"].endswith("report.py")
    assert got[2]["prompt_text"] == fixed.NO_RANKING and got[2]["summary"] == ""


def test_lines_of_a_model_as_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.ndjson").write_text('{"message":{"content":"he"}}\n\n  {"message":{"content":""}}\nnot json\n{"message":{"content":"y"}}\n')
    q = G.model_lines(files.lines_stream(spark, str(src))).writeStream.format("memory").queryName("model_lines").start()
    q.processAllAvailable()
    q.stop()
    assert [r["content"] for r in spark.table("model_lines").collect()] == ["he", "y"]


def test_streamed_proposals(spark, tmp_path):
    schema = "session_id bigint, seq bigint, type string"
    spark.createDataFrame([(1, 0, "patch"), (1, 1, "proposal"), (2, 0, "patch"), (2, 1, "apply"), (3, 0, "proposal"), (3, 1, "discard")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = S.proposal_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("proposals").start()
    q.processAllAvailable()
    q.stop()
    assert {r["session_id"]: (r["open"], r["appliable"]) for r in spark.table("proposals").collect()} == {1: (True, True), 2: (True, False), 3: (False, False)}


def test_presets_and_roots(spark):
    p = spark.createDataFrame([(0, "a", "A", "file:///o/x.png", "https://h/m")], "ordinal int, id string, label string, avatar string, model string")
    assert [r["id"] for r in N.with_custom_preset(p, "file:///m.vrm", "d").orderBy("ordinal").collect()] == [fixed.CUSTOM_PRESET, "a"] and N.with_custom_preset(p, None, "d").count() == 1
    res = spark.createDataFrame([(3, "file:///o/b"), (1, "file:///o/a"), (2, "https://h/x"), (4, "")], "o int, path string")
    assert [tuple(r) for r in N.local_roots(res, "path", "o").collect()] == [(1, "/o")]
    assert spark.range(1).select(N.embedded_json(F.lit("a</script>"))).first()[0] == "a\\u003c/script>"
