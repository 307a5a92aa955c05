"""Rules, conversations, diffs, actions, planning: hand-worked rows and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from seamline.functions import fixed
from seamline.operators import actions as A
from seamline.operators import conversation as C
from seamline.operators import diffs as D
from seamline.operators import parsing as G
from seamline.operators import planning as L
from seamline.operators import requests as Q
from seamline.operators import risk as K
from seamline.operators import tabular as T
from seamline.operators.deliveries import first_arrival

REQUEST = "request_id bigint, prompt string, selected_text string, active_file string, full_document_text string, workspace_root string"


@pytest.mark.parametrize(
    ("prompt", "selected", "full", "root", "route", "stream"),
    [
        ("帮我 refactor this file", "", None, "/w", "edit", "edit"),
        ("update documentation", "", None, "/w", "workspace", "workspace"),
        ("please add a module", "", None, "/w", "workspace", "workspace"),
        ("please add a module", "x = 1", None, "/w", "chat", "chat"),
        ("为什么 refactor this file", "", None, "/w", "workspace", "workspace"),
        ("what is this", "", "x", "", "chat", "edit"),
        (" ", "", "x", "/w", "chat", "chat"),
        (None, None, None, None, "chat", "chat"),
    ],
)
def test_routes(spark, prompt, selected, full, root, route, stream):
    df = spark.createDataFrame([(1, prompt, selected, "/w/a.py" if full else None, full, root)], REQUEST)
    r = Q.routed(df).first()
    assert (r["route"], r["stream_route"]) == (route, stream)


def test_least_actions(spark):
    rows = spark.createDataFrame([(p, n) for p in (True, False) for n in (0, 1, 3, 9)], "p boolean, n int").select(Q.least_actions(F.col("p"), F.col("n")).alias("x")).collect()
    assert [r["x"] for r in rows] == [2, 2, 3, 4, 1, 1, 1, 1]


ACTION = "response_id bigint, action_id bigint, kind string, target_file string, original_content string, updated_content string, active_file string"


def test_risk_rows_and_batch(spark):
    one = K.assessed(spark.createDataFrame([(1, 1, "update_file", "a/x.py", "s", "s", None)], ACTION)).first()
    assert (one["score"], one["level"]) == (18, "low")
    two = K.assessed(spark.createDataFrame([(1, 1, "update_file", "a/x.py", "s", "s", None), (1, 2, "update_file", "b/y.py", "s", "s", None)], ACTION))
    assert [(r["score"], r["level"]) for r in two.collect()] == [(32, "medium")] * 2
    b = K.batches(two).first()
    assert (b["score"], b["level"], b["actions"], b["folders"]) == (42, "medium", 2, 2)


def test_signature_in_fourth_place_does_not_count(spark):
    rows = [(1, k, "update_file", f"{k}/x.py", "", "def f():\n  pass", None) for k in (1, 2)]
    assert K.batches(K.assessed(spark.createDataFrame(rows, ACTION))).first()["any_signature"] is False


@pytest.mark.parametrize(("a", "b", "large"), [(0, 29, False), (0, 30, True), (100, 134, False), (100, 135, True), (200, 240, True)])
def test_large_delta(spark, a, b, large):
    df = spark.createDataFrame([("\n".join("x" * a), "\n".join("x" * b))], "o string, u string")
    assert df.select(K.large_delta("o", "u").alias("x")).first()["x"] is large


def test_decorated_summary_is_idempotent(spark):
    df = spark.createDataFrame([(" s ", "high", "r"), ("[低风险] s", "high", "r"), (None, "low", "")], "s string, l string, r string")
    assert [r["x"] for r in df.select(K.decorated_summary("s", "l", "r").alias("x")).collect()] == ["[高风险] s；r", "[低风险] s", "[低风险] "]


def test_first_arrival_with_ties_nulls_and_clashing_names(spark):
    rows = [(1, "a", 5), (1, "a", 3), (2, None, 1), (2, None, 1), (None, "z", 2)]
    got = first_arrival(spark.createDataFrame(rows, "id bigint, row_ string, ingested_at int"), "id").collect()
    assert sorted((r["id"] or 0, r["row_"] or "", r["ingested_at"]) for r in got) == [(0, "z", 2), (1, "a", 3), (2, "", 1)]
    assert first_arrival(spark.createDataFrame([], "id bigint, x string, ingested_at int"), "id").count() == 0


TURN = "conv_id bigint, turn bigint, role string, content string"


def test_conversation_windows_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "agent", "system", None]), rng.choice(["x", " y ", None, ""])) for c in range(4) for t in rng.sample(range(3000), 40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURN)
    by = {c: sorted((r for r in rows if r[0] == c), key=lambda r: r[1]) for c in range(4)}
    want = {c: "\n".join(f"{r[2]}: {(r[3] or '').strip()}" for r in [r for r in t if r[2] in ("user", "agent")][-6:]) for c, t in by.items()}
    assert {r["conv_id"]: r["history"] for r in C.history_text(df).collect()} == want
    flags = {(r["conv_id"], r["turn"]): r["is_continuation"] for r in C.continuations(df, block=100).collect()}
    assert flags == {(c, b[1]): bool(a and a[2] is not None and a[2] == b[2]) for c, t in by.items() for a, b in zip([None, *t], t)}
    newest = {r["conv_id"]: (r["latest_user"], r["latest_agent"]) for r in C.latest_by_role(df).collect()}
    assert newest == {c: tuple(next((r[3] or "" for r in reversed(t) if r[2] == role), "") for role in ("user", "agent")) for c, t in by.items()}
    assert C.history_text(spark.createDataFrame([], TURN)).count() == 0


def test_diff_bounds_and_text(spark):
    rows = [("update_file", "a", "1\n2\n3\n4\n5", "1\n2\nX\n4\n5"), ("create_file", "b", None, "n"), ("update_file", "c", "s", "s"), ("update_file", "d", "", ""), ("update_file", "e", "a\na", "a\na\na")]
    df = spark.createDataFrame(rows, "kind string, target_file string, original_content string, updated_content string")
    got = {r["target_file"]: r["diff"].split("\n") for r in D.unified(df).collect()}
    assert got["a"][2:] == ["@@ around line 3 @@", "  1", "  2", "- 3", "+ X", "  4", "  5"]
    assert got["b"] == ["--- (new file)", "+++ b", "@@ new file @@", "+ n"] and got["c"][2:] == ["@@ no changes @@"] and got["d"][2:] == ["@@ no changes @@"]
    assert got["e"][2:] == ["@@ around line 3 @@", "  a", "  a", "+ a"]


def test_long_diff_is_counted(spark):
    df = spark.createDataFrame([("update_file", "a", "x", "\n".join("y" * 400))], "kind string, target_file string, original_content string, updated_content string")
    lines = D.unified(df).first()["diff"].split("\n")
    assert len(lines) == fixed.DIFF_LINES + 1 and lines[-1] == f"... ({3 + 1 + 400 - fixed.DIFF_LINES} more diff lines omitted)"


def test_action_checks_in_order(spark):
    files = spark.createDataFrame([("/w", "a.py", "x = 1"), ("/w", "README.md", "old"), ("/w", "n.py", None)], "workspace_root string, relative_path string, full_content string")
    rows = [
        (1, "update_file", "a.py", "x = 2", None), (2, "update_file", "a.py", " x = 1\r\n", "unchanged"), (3, "update_file", "gone.py", "x", "missing"), (4, "create_file", "a.py", "x", "exists"),
        (5, "create_file", "b.py", "def", "syntax_error:1"), (6, "update_documentation", "a.py", "x", "not_documentation"), (7, "update_documentation", "README.md", "import os", "looks_like_source"),
        (8, "update_documentation", "README.md", "new", None), (9, "update_file", "../x.py", "x", "outside_root"), (10, "update_file", " ", "x", "outside_root"), (11, "update_file", "a.py", " ", "no_content"), (12, "drop", "a.py", "x", "unknown_kind"),
        (13, None, "a.py", "x", "unknown_kind"), (14, "update_file", None, "x", "outside_root"), (15, "update_file", "n.py", "y = 1", None),
    ]
    a = spark.createDataFrame([(i, "/w", k, t, u) for i, k, t, u, _ in rows], "action_id bigint, workspace_root string, kind string, target_file string, updated_content string")
    got = {r["action_id"]: r["error"] for r in A.checked(A.with_original(a, files)).collect()}
    assert got == {i: e for i, *_, e in rows}


def test_written_text(spark):
    df = spark.createDataFrame([("a\nb", "x\n"), ("a\r\nb\r", "x"), (None, None)], "u string, c string")
    assert [r["x"] for r in df.select(A.written_text("u", "c").alias("x")).collect()] == ["a\r\nb\r\n", "a\r\nb\r\n", ""]


def test_plan_parsing(spark):
    text = "```x\n<assistant_reply> hi </assistant_reply><action><kind>update</kind><target_file>a</target_file><summary></summary><updated_content>\n```py\ny\n```\n</updated_content></action><action><kind>zap</kind><target_file>b</target_file><updated_content>z</updated_content></action>\n```"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "no tags")], "k bigint, t string")
    assert [(r["k"], r["ordinal"], r["kind"], r["updated_content"]) for r in G.plan_actions(df, "k", "t", True).collect()] == [(1, 0, "update_file", "y")]
    assert [r["assistant_reply"] for r in G.plan_header(df, "t", True).orderBy("k").collect()] == ["hi", "", ""]
    assert [r["file_content"] for r in G.single_file(df.where("k > 1"), "t", True).orderBy("k").collect()] == ["", "no tags"]


def test_model_lines(spark):
    df = spark.createDataFrame([('{"message":{"content":"a"}}',), ("",), ('{"message":{"content":""}}',), ("{bad",), (None,)], "value string")
    assert [r["content"] for r in G.model_lines(df).collect()] == ["a"]


def loop_plan(req, exists, cand):
    """The plan as a sequence of choices."""
    import re

    most = fixed.PLANNED_IN_PROJECT if req["project_scope"] else fixed.PLANNED
    is_doc = lambda p: p.lower() == "readme.md" or p.lower().startswith("docs/") or p.lower().endswith((".md", ".rst", ".txt"))
    chosen = {}
    add = lambda p, k: chosen.setdefault(p.lower(), (k, p))
    seen = []
    for m in re.findall(fixed.EXPLICIT_PATH, req["prompt"] or ""):
        p = m.strip(fixed.PATH_TRIM).replace("\\", "/")
        if p and p.lower() not in seen:
            seen.append(p.lower())
            by_path, by_name = {c.lower(): c for c in cand}, {c.split("/")[-1].lower(): c for c in cand}
            rel = by_path.get(p.lower(), by_name.get(p.split("/")[-1].lower(), p))
            if rel in exists or is_doc(rel) or req["wants_creation"]:
                add(rel, "update_documentation" if is_doc(rel) else "update_file" if rel in exists else "create_file")
    if not (req["wants_documentation"] and not req["wants_code"]) and not req["project_scope"] and req["active"]:
        add(req["active"], "update_file")
    if req["wants_documentation"] and not req["documentation_optional"]:
        target = "README.md" if "README.md" in exists else next((c for c in cand if is_doc(c)), "docs/README.md" if "docs/README.md" in exists else None)
        if target:
            add(target, "update_documentation")
    per = {}
    for _, p in chosen.values():
        d = p.rpartition("/")[0]
        per[d] = per.get(d, 0) + 1
    for c in cand:
        if len(chosen) >= most:
            break
        d = c.rpartition("/")[0]
        if is_doc(c) or (d and per.get(d, 0) >= 2):
            continue
        add(c, "update_file")
        per[d] = per.get(d, 0) + 1
    return [(k, p) for k, p in list(chosen.values())[:most]]


@pytest.mark.parametrize("prompt", ["fix a/x.py and b\\y.py, 3.14", "update docs/readme.md 文档 if needed", "整个项目 优化", "create new/z.ts", "更新文档", "", None])
def test_planning_matches_the_loop(spark, prompt):
    cand = ["a/x.py", "a/y.py", "a/z.py", "docs/t.md", "root.py", "b/y.py", "b/q.ts"]
    exists = {*cand, "b/w.py"}
    row = (1, prompt, "", "/w/a/y.py", None, "/w")
    routed = Q.routed(spark.createDataFrame([row], REQUEST))
    files = spark.createDataFrame([("/w", p) for p in sorted(exists)], "workspace_root string, relative_path string")
    cands = spark.createDataFrame([(1, p, k + 1) for k, p in enumerate(cand)], "request_id bigint, relative_path string, rank int")
    got = [(r["kind"], r["target_file"]) for r in L.planned(routed, files, cands).orderBy("place").collect()]
    flags = routed.first().asDict() | {"active": "a/y.py"}
    assert got == loop_plan(flags, exists, cand)


def test_students(spark):
    raw = spark.createDataFrame([("a", "7", None, None, "5"), (None, "x", "80", "90", None)], "name string, math string, english string, python string, python_score string")
    assert [tuple(r) for r in T.students(raw).collect()] == [("a", 7, 0, 5), ("", 0, 80, 90)]
    marks = spark.createDataFrame([(91, 87, 94), (78, 83, 80), (95, 88, 93), (76, 81, 70), (66, 72, 79)], "m int, e int, p int")
    assert [r["level"] for r in T.with_level(marks, "m", "e", "p").collect()] == ["A", "B", "A", "C", "C"]
    assert T.class_average(marks, "m", "e", "p").first()[0] == pytest.approx(82.2) and T.class_average(marks.limit(0), "m", "e", "p").first()[0] == 0.0
