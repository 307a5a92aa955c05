"""Problem 3: cuts that only a longer copy shows."""

import random

import pytest

from seamline.llm import p3_truncation as p3

from test_ends_pairs_syntax import ACTION, RESPONSE, act

GOES_ON = [
    ("python", "def f():\n    return 1\n\nLESSON_LI", "MIT = 2512\n", True), ("python", "def f():\n    a = 1\n", "    return a\n", True), ("python", "x = 1\n", "y = 2\n", False), ("python", "class A:\n    def f(self):\n        pass\n", "\n    def g(self):\n        pass\n", False),
    ("typescript", "if (a) { b(); }", " else { c(); }", True), ("javascript", "a();", " b();", False), (None, "Done. It calls run(x)", " twice.", True), (None, "Done. The keys are:", " a and b.", True), (None, "Done. See `a`", " first.", True),
    (None, "Done. See *it*", " first.", True), (None, "Fertig; das gilt nur hier;", " dort nicht.", True), (None, "Sorry, I cannot help.", " Ask a colleague.", False), (None, "抱歉，我无法完成。", "请联系团队。", False), (None, "42", "1 rows.", False), (None, "No", "te: x.", False), (None, "3 次", "之后一致。", False), (None, "配置由 run 读取后再由", "保存。", True), (None, "Configu", "ration is read.", True),
    (None, "See src/a.", "py first.", True), (None, "Done.", "..[cut]", False), (None, "```\nx\n```", "\nMore.", False),
]


@pytest.mark.parametrize(("lang", "base", "rest", "inside"), GOES_ON)
def test_how_a_longer_copy_goes_on(lang, base, rest, inside):
    assert p3.goes_on_inside(base, base + rest, p3.MODES[lang]) is inside


def test_complete_ends_are_probes(spark, monkeypatch):
    monkeypatch.setattr(p3, "PARTITION_BYTES", 60)
    code, said = "def f():\n    return 1\n\nLESSON_LI", "All done here. The result is read by run(rows)"
    resp = spark.createDataFrame([(1, 1, "a", said, 0, "", "x", "y"), (2, 1, "a", said + " and by save.", 0, "", "x", "y"), (3, 1, "a", "Sorry, no.", 0, "", "x", "y"), (4, 1, "a", "Sorry, no. Ask again.", 0, "", "x", "y")], RESPONSE)
    acts = spark.createDataFrame([act(1, "web/A.PY", code), act(1, "web/A.PY", code), act(2, "b.py", code + "MIT = 2512\n"), act(3, "c.py", "x = 1\n", "x = 1\ny = 2\n")], ACTION)
    got = {(r["record_type"], r["record_id"]): r["evidence"] for r in p3.truncated(resp, acts).collect()}
    assert got == {("response", 1): "longer copy", ("action", 1): "longer copy"}


def test_own_probes_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = sorted({"".join(rng.choice("ab .\n") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    monkeypatch.setattr(p3, "PARTITION_BYTES", 40)
    values = spark.createDataFrame([(t, 1, 0) for t in texts + texts[:50]] + [(t + "x", 1, 1) for t in texts], "value string, mode int, group int")
    want = {t for t in texts if any(u.startswith(t) and p3.goes_on_inside(t, u, 1) for u in texts)}
    got = [r[0] for r in p3.prefixes(spark.createDataFrame([], "base string, mode int, group int"), values).collect()]
    assert sorted(k for k in got if k[0] == "0") == sorted(f"0={p3.md5(t.encode()).hexdigest()}/1" for t in want)
    asked = [t[: len(t) // 2] for t in texts if len(t) > 2]
    probes = spark.createDataFrame([(t, 0, 1) for t in asked + asked], "base string, mode int, group int")
    got = {r[0] for r in p3.prefixes(probes, values).collect() if "~" in r[0]}
    assert got == {f"1~{p3.md5(t.encode()).hexdigest()}/0" for t in set(asked) if any((u + "x").startswith(t) and len(u) + 1 > len(t) and not p3.MARK.fullmatch(u + "x", len(t)) for u in texts)}


def test_common_beginnings_are_parted(spark, monkeypatch):
    monkeypatch.setattr(p3, "PARTITION_BYTES", 4000)
    head = "/* licence */ " * 40
    texts = [head + f"x{k:03d} = {k}" for k in range(200)]
    values = spark.createDataFrame([(t, 1, 0) for t in texts], "value string, mode int, group int")
    assert len(p3._boundaries(values)) > 10
    probes = spark.createDataFrame([(head, 0, 0), (head + "x19", 0, 0), (head + "x7", 0, 0)], "base string, mode int, group int")
    got = {r[0] for r in p3.prefixes(probes, values).collect() if "~" in r[0]}
    assert got == {f"0~{p3.md5(t.encode()).hexdigest()}/0" for t in (head, head + "x19")}


LONG_LIST = "TABLE = [\n" + "    ('a', 1),\n" * 900
LONG_TEXT = 'import os\n\nQUERY = """\n' + "from one table\nx = 1\nif so, more of it\n" * 900


@pytest.mark.parametrize(
    "text",
    ['"""Doc\nfor x', '"""About this.\n\nIt is read\nwith care and\nfrom the start', LONG_TEXT, "import os\n\n" + LONG_TEXT[11:] + '"""\nrun(a,', "import os\n\n" + LONG_LIST + "    ('b',", "f(\n" + "'a',\n" * 500 + "'b", "import os\n\n@a\n@b\n@c\ndef f(x,"],
)
def test_python_cut_far_from_the_start_of_its_statement(text):
    assert p3.code_end(text, "python") == p3.CUT


def test_python_damage_further_up_is_no_cut():
    assert p3.code_end("import os\nx = = 1\n" + "y = 1\n" * 3000 + "z = (", "python") is None
