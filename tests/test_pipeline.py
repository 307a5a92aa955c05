"""The pipeline with stub completers, and the small context functions."""

from pyspark.sql import functions as F

from seamline.functions import context as C
from seamline.operators import requests as Q
from seamline.plans import pipeline as P

REQUEST = "request_id bigint, prompt string, selected_text string, active_file string, full_document_text string, workspace_root string"
FILES = "snapshot_id bigint, workspace_root string, relative_path string, absolute_path string, suffix string, size_bytes bigint, full_content string"


def tables(spark):
    req = spark.createDataFrame([(1, "create file a/new.py and update the project", "", "/w/a/x.py", "x", "/w"), (2, "what is this", "", None, None, "/w"), (3, "update documentation", "", None, None, "/v"), (4, None, None, None, None, None)], REQUEST)
    files = spark.createDataFrame([(k, "/w", p, f"/w/{p}", "." + p.rsplit(".")[-1], 9, "old = 1\n") for k, p in enumerate(["a/x.py", "a/y.py", "README.md", "b/z.ts"])], FILES)
    return req, files


def test_answers_with_the_default_completer(spark):
    req, files = tables(spark)
    got = {r["request_id"]: r for r in P.answers(req, files).collect()}
    assert set(got) == {1, 2, 3, 4} and [got[k]["route"] for k in (1, 2, 3, 4)] == ["workspace", "chat", "workspace", "chat"]
    assert got[1]["action_count"] >= 2 and got[1]["requires_confirmation"] and "risk" in got[1]["proposal_summary"] and got[1]["mood"] == "helpful"
    assert got[3]["action_count"] == 0 and got[3]["mood"] == "idle" and got[2]["content"].endswith("ok</assistant_reply>")
    assert "risk" not in {r["request_id"]: r for r in P.answers(req, files, annotate=False).collect()}[1]["proposal_summary"]


def test_one_repair_attempt(spark):
    req, files = tables(spark)
    work = Q.routed(req).where("request_id = 1")

    def second_time_lucky(rows, attempt):
        return P.echo(rows, attempt) if attempt == 2 else rows.withColumn("completion", F.lit("nothing"))

    rows = P.proposals(work, files, second_time_lucky).collect()
    assert {r["attempt"] for r in rows} == {2} and all(r["usable"] for r in rows)

    def never(rows, attempt):
        return rows.withColumn("completion", F.lit(None).cast("string"))

    (row,) = P.proposals(work, files, never).collect()
    assert not row["usable"] and row["kind"] is None
    assert P.answers(req.limit(0), files.limit(0)).count() == 0


def test_file_edits(spark):
    req, _ = tables(spark)
    work = spark.createDataFrame([(k, "p", "", "/w/a.py", "x = 1", "/w") for k in range(5)], REQUEST)
    texts = ["<summary>s</summary><updated_content>x = 2</updated_content>", "```py\nx = (\n```", "x = 1", "x = 1 # todo", None]

    def stub(rows, attempt):
        return rows.withColumn("completion", F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("request_id") + 1).cast("int")))

    assert [r["error"] for r in P.file_edits(work, stub).orderBy("request_id").collect()] == [None, "syntax_error", "unchanged", "incomplete", "no_content"]


def test_context(spark):
    df = spark.createDataFrame([("a" * 5000,), ("a" * 20_000,), ("",), (None,)], "document string")
    got = [(len(r["document_text"] or ""), len(r["full_document_text"] or "")) for r in df.select(*[c.alias(n) for n, c in C.context_texts().items()]).collect()]
    assert got == [(4000, 5000), (4000, 0), (0, 0), (0, 0)]
    fields = "workspace_root string, active_file string, language_id string, selected_text string, document_text string, full_document_text string, system_prompt string"
    both = spark.createDataFrame([((None, "a", None, "", None, None, ""), ("w", "b", "py", "s", None, "f", "p"))], f"live struct<{fields.replace(' string', ':string')}>, last struct<{fields.replace(' string', ':string')}>")
    assert tuple(both.select(C.merged_context().alias("x")).first()["x"]) == ("w", "a", "py", "", None, "f", "p")


def test_roots_paths_and_labels(spark):
    active = spark.createDataFrame([(1, "/r/p/src/a.ts"), (2, "/x/y.ts")], "k bigint, path string")
    files = spark.createDataFrame([("/r/package.json",), ("/r/p/pyproject.toml",), ("/r/p/src/other.json",)], "absolute_path string")
    assert [tuple(r) for r in C.project_roots(active, files, "k", "path").collect()] == [(1, "/r/p")]
    df = spark.createDataFrame([("+ a", "/w/a", "/w"), ("+++ a", "/v/a", "/w"), ("@@ x", "/w/a", ""), ("- b", "/w", "/w"), ("", "", None)], "line string, path string, root string")
    assert [r["x"] for r in df.select(C.diff_class("line").alias("x")).collect()] == ["added", "header", "hunk", "removed", "plain"]
    assert [r["x"] for r in df.select(C.display_path("path", "root").alias("x")).collect()] == ["a", "/v/a", "/w/a", "/w", ""]
    res = spark.createDataFrame([("HTTP://h/a",), ("/a",), ("a",), ("",), (None,)], "r string")
    assert [r["x"] for r in res.select(C.resource_address("r", "/base/").alias("x")).collect()] == ["HTTP://h/a", "file:///a", "/base/a", None, None]
    st = spark.createDataFrame([("helpful", "正在思考", False, ""), ("zap", "写回", False, "local"), (None, None, True, None)], "mood string, status string, streaming boolean, local string")
    assert [(r["m"], r["e"], r["d"]) for r in st.select(C.status_of_mood("mood").alias("m"), C.expression_of_status("status", "streaming").alias("e"), C.display_status("streaming", "local", "status").alias("d")).collect()] == [("responded", "thinking", "正在思考"), ("idle", "acting", "local"), ("idle", "speaking", "generating")]
