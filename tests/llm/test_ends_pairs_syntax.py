"""Problems 3, 4 and 5."""

import random

import pytest

from seamline.llm import ecmascript
from seamline.llm import p3_truncation as p3
from seamline.llm import p4_pairs as p4
from seamline.llm import p5_syntax as p5

# --- problem 5 ---------------------------------------------------------------------------------------------

TS_VALID = [
    "import type { A } from './a'; export type B<T> = A[T] extends infer U ? U : never;",
    "export abstract class X<T extends object = {}> extends Y<T> implements Z, W { private readonly a?: number = 1; constructor(public b: string, protected c = 2) { super(); } get d(): T | null { return null } static #p = 3; [key: string]: unknown; abstract f(): void }",
    "enum Color { Red = 1, Green = 'g' } declare module 'm' { export const x: number; } namespace N.M { let a = <any>b; }",
    "const f = async <T,>(a: T, ...rest: number[]): Promise<T> => { for await (const x of y) { z?.[0]?.(x!); } return a as unknown as T; };",
    "function isA(x: unknown): x is A { return typeof x === 'object' && x !== null } type M = { readonly [K in keyof T]?: T[K] }; type F = new (...a: any[]) => void;",
    "const t: [a: string, b?: number] = ['x']; let g = f<string>(`a${b + `n${1}`}c`); label: for (;;) { break label } x = a ? (b) : (c) => d;",
    "export default interface Q { (a: number): string; new (b: string): Q; m?(): void }",
    "@dec() class A { @prop() x!: string; async *gen() { yield* other() } }",
]
JS_VALID = [
    "const a = b / c / d, r = /[/\\]]+x/gi.test(s), { x, y: [z = 1, ...w], ...v } = o; if (a) /re/.test(b)\nelse c++\n",
    "export { a as default, b } from './m'; export * as ns from 'x'; import d, * as e from 'y'; import('z').then(({ q }) => q);",
    "class A extends (b, c) { static { this.x = 1 } static async *[Symbol.iterator]() {} get = 1; set = 2; #priv() { return #priv in this } }",
    "label: while (1) { switch (a) { case 1: continue label; default: break } } do x(); while (0) var o = { get a() { return 1 }, async b() {}, *c() {}, [d]: 1, 'e': 2, 3: 4, f, ...g };",
    "a ??= b ||= c &&= d ** e; new Foo.Bar(1)(2); new.target; x = async y => await y; let async = 1; async\nfoo()",
    "#!/usr/bin/env node\n'use strict'; `a${`b${c}`}` ; var \\u0061b = 0x1F + 0b1 + 1_000n; a >>>= 2 >> 1 >>> 0; if (a >= b > c) {}",
]
JS_INVALID = ["const x: number = 1;", "interface A { b: string }", "function f( { return 1 }", "let a = ;", "return 1", "break;", "const a;", "1 = 2", "a b", "x = {a b}", "for (;;", "'abc\n'", "`abc", "if (a { }", "<<<<<<< HEAD\na\n", "class A { x: number }", "private x() {}", "enum A {}", "a => { }}", "let x = y as z;"]


@pytest.mark.parametrize("text", TS_VALID)
def test_typescript_valid(text):
    assert ecmascript.check(text, True) is None


@pytest.mark.parametrize("text", JS_VALID)
def test_javascript_valid(text):
    assert ecmascript.check(text, False) is None and ecmascript.check(text, True) is None


@pytest.mark.parametrize("text", JS_INVALID)
def test_javascript_invalid(text):
    assert ecmascript.check(text, False) is not None


def test_recognised_blocks_are_not_mixed_up():
    ok = "function f() { return 1 }"
    assert ecmascript.check(ok, False) is None and ecmascript.check("{ return 1 }", False) is not None and ecmascript.check("while (1) { break }", False) is None and ecmascript.check("if (1) { break }", False) is not None


ACTION = "action_id bigint, response_id bigint, workspace_root string, target_file string, updated_content string, original_content string, source string, path string, value string"


def act(i, path, text, original=None, source="s"):
    return (i, 1, "/w", path, text, original, source, "clash", "clash")


def test_syntax_operator_edges(spark):
    rows = [
        act(1, "a.PY", "def f(:\n"), act(1, "a.PY", "def f(:\n"), act(2, "b.json", "{'a': 1}"), act(3, "c.json", '{"a": NaN}'), act(4, "d.toml", "a = 1\n[b]\nc = 'x'"), act(5, "e.md", "def ("), act(6, "f.py", " \n"), act(7, "g.py", None), act(8, None, "x"),
        act(9, "h\\i.ts", "let a: string = 'x'"), act(10, "j.js", "let a: string = 'x'"), act(11, "k.toml", "import os\n"), act(12, "l.py", "x = '''\n<<<<<<< HEAD\n=======\n>>>>>>> b\n'''\n"), act(13, "m.py", "x = 1\n<<<<<<< HEAD\n"), act(14, "n.json", "[" * 5000 + "]" * 5000),
        act(15, "noext", "("), act(16, "o.js", "x = 1;\n" * 20_000),
    ]
    df = spark.createDataFrame(rows, ACTION)
    assert sorted(r[0] for r in p5.found(df).collect()) == [1, 2, 3, 10, 11, 13]
    why = {r["action_id"]: (r["reason"], r["parses_as"]) for r in p5.files(df).collect()}
    assert why[10] == ("wrong suffix", "typescript") and why[11] == ("wrong suffix", "python") and why[13] == ("conflict marks", None) and 5 not in why
    rate = {r["language"]: (r["files"], r["invalid"]) for r in p5.rates(df).collect()}
    assert rate["python"] == (3, 2) and rate["javascript"] == (2, 1) and p5.found(df.limit(0)).count() == 0


# --- problem 3 ---------------------------------------------------------------------------------------------

SOURCES = {
    "python": "import os\n\nclass A:\n    \"\"\"Doc of it.\"\"\"\n\n    def load_rows(self, rows_list):\n        try:\n            table = {\"a\": [1, 2], 'b': (3, rows_list)}\n        except (OSError, ValueError) as exc:\n            log.warning(\"x %s\", exc)\n        return table\n",
    "javascript": "import { a } from './b';\n\nexport class C {\n  run(rows) {\n    const t = `x ${rows.length} / ${a(rows)}`;\n    rows.on('e', (p) => { a(p); });\n    return t;\n  }\n}\n",
    "json": '{\n  "name": "x",\n  "list": [1, 2.5, true, null],\n  "inner": {\n    "k": "v"\n  }\n}\n',
}


@pytest.mark.parametrize("lang", list(SOURCES))
def test_code_cut_inside_brackets_and_strings(lang):
    text = SOURCES[lang]
    assert p3.code_end(text, lang) == p3.COMPLETE
    hits = sum(p3.code_end(text[:k], lang) == p3.CUT for k in range(30, len(text.rstrip()) - 2))
    assert hits >= 0.75 * (len(text.rstrip()) - 32)


def test_damaged_code_is_no_cut():
    assert p3.code_end("def f(:\n    return 1\n", "python") is None
    assert p3.code_end("def f():\n    x = g(1\n    y = 2\n    return y\n", "python") is None
    assert p3.code_end("def f():\n    if x:\n        y = 1\n  return y", "python") is None
    assert p3.code_end('{\n  "a": 1\n},\n}', "json") is None and p3.code_end("function f() {\n  if (a) {\n    b();\n  return 1;\n}\n", "javascript") is None


@pytest.mark.parametrize(
    ("text", "how"),
    [
        ("All done. The cost of the fi", "cut"), ("All done.", "complete"), ("完成了。针对 `check_b", "cut"), ("完成了。", "complete"), ("Done. See:\n- src/a/b.py", "complete"), ("Done. See:\n- src/a/b", "cut"), ("Ok.\n```python\nx = 1", "cut"),
        ("Ok.\n```python\nx = 1\n```", "complete"), ("| a | b |\n| --- | --- |\n| c ", "cut"), ("Der „Teil“ ist „fertig“.", "complete"), ("N/A", "complete"), ("", "complete"), (None, "complete"), ("42", "open"), ("Cleanup of the diff view", "open"),
        ("Text. It depends on src/core/file.", "cut"), ("A note. More […", "cut"), ("Half a sent [+more]", "cut"), ("Der Text hängt von der", "cut"), ("<a>x</a>", "complete"), ("<assistant_reply>x", "cut"),
    ],
)
def test_prose_ends(text, how):
    assert p3.end_of(text)[0] == how


def test_prefix_join_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(120)] + ["same"] * 50
    bases = sorted({t[:3] for t in texts} | {"zz", "same"})
    monkeypatch.setattr(p3, "PARTITION_BYTES", 40)
    probes = spark.createDataFrame([(b, 0, 0) for b in bases], "base string, mode int, group int")
    values = spark.createDataFrame([(t, 0, 0) for t in texts], "value string, mode int, group int")
    key = {f"0~{p3.md5(b.encode()).hexdigest()}/0": b for b in bases}
    want = sorted(b for b in bases if any(t.startswith(b) and len(t) > len(b) for t in texts))
    assert sorted(key[r[0]] for r in p3.prefixes(probes, values).collect()) == want
    assert p3.prefixes(probes, values.limit(0)).count() == 0 and p3.prefixes(probes.limit(0), values).count() == 0


RESPONSE = "response_id bigint, request_id bigint, source string, content string, action_count int, proposal_summary string, prompt string, key string"


def test_truncation_operator_edges(spark):
    full = "  A short title without a stop and then much more of it follows here \n"
    resp = spark.createDataFrame([(1, 1, "a", "Done. The cost of the fi", 0, "", "x", "y"), (1, 1, "a", "Done. The cost of the fi", 0, "", "x", "y"), (2, 2, "a", "Done.", 0, "", "x", "y"), (3, 3, None, None, 0, "", "x", "y"), (4, 4, "b", full, 0, "", "x", "y")], RESPONSE)
    acts = spark.createDataFrame([act(1, "a.py", "def f(a, b"), act(2, "a.py", "def f():\n    return 1\n", full + "and on"), act(3, "x.md", None)], ACTION)
    got = {(r["record_type"], r["record_id"]): r["evidence"] for r in p3.truncated(resp, acts).collect()}
    assert got == {("response", 1): "end", ("action", 1): "end", ("response", 4): "longer copy"}
    rates = {(r["record_type"], r["source"]): (r["records"], r["cut"]) for r in p3.rates(resp, acts).collect()}
    assert rates == {("response", "a"): (2, 1), ("response", "b"): (1, 1), ("action", "s"): (2, 1)}
    assert p3.found(resp.limit(0), acts.limit(0)).count() == 0


# --- problem 4 ---------------------------------------------------------------------------------------------

PROMPTS = {"en": "Why does `load_rows` fail when the list is empty?", "de": "Warum schlägt `load_rows` fehl, wenn die Liste leer ist?", "fr": "Pourquoi `load_rows` échoue-t-il quand la liste est vide ?", "zh": "为什么列表为空的时候 `load_rows` 会报错？"}
ANSWERS = {
    "en": "The list is read before it is filled, so `load_rows` returns early and the caller sees nothing.",
    "de": "Die Liste wird gelesen, bevor sie gefüllt ist, und `load_rows` kehrt deshalb zu früh zurück.",
    "fr": "La liste est lue avant d’être remplie, donc `load_rows` revient trop tôt et la suite est vide.",
    "zh": "列表在填充之前就被读取了，所以 `load_rows` 会提前返回，调用方看不到任何数据。",
}
REFUSALS = {"en": "I'm sorry, but I can't help with this. I hope you understand.", "de": "Das darf ich nicht bearbeiten. Bitte wenden Sie sich an Ihr Team.", "fr": "Désolé, je ne peux pas répondre à cette demande.", "zh": "抱歉，我无法完成这个请求。希望你能理解。"}


def planted():
    """(prompt, answer, defect or None): defects planted into clean pairs; the cutoffs were chosen on these."""
    rows = []
    for lang, prompt in PROMPTS.items():
        good = ANSWERS[lang]
        rows += [(prompt, good, None), (prompt, f"{prompt}\n\n{good}", None), (prompt, "```python\nx = 1\n```", None), (prompt, "42", None)] * 6
        rows += [(prompt, t, "empty_answer") for t in ("", " \n", "N/A", "（无）", "<think></think>", "```\n```", None)]
        rows += [(prompt, t, "copies_question") for t in (prompt, prompt.upper(), f"“{prompt}”", prompt.replace("`", ""))]
        rows += [(prompt, REFUSALS[lang], "refusal"), (prompt, good[: len(good) // 2] + ("..[cut]" if lang == "en" else ""), "truncated_answer")]
        rows += [(prompt, ANSWERS[o], "wrong_language") for o in PROMPTS if o != lang]
    rows += [("Explain it. Reply in German, please.", ANSWERS["de"], None), ("解释一下。请用法语回答。", ANSWERS["fr"], None), (PROMPTS["en"], "Sorry for the mix-up, here is it. " + ANSWERS["en"], None)]
    return rows


def test_pairs_on_planted_defects(spark):
    rows = planted()
    req = spark.createDataFrame([(k, p) for k, (p, *_) in enumerate(rows)] + [(0, rows[0][0])], "request_id bigint, prompt string")
    resp = spark.createDataFrame([(k, k, "s", a, 0, None, "clash", "clash") for k, (_, a, _) in enumerate(rows)] + [(900, None, "s", "", 2, "ok then.", "", ""), (901, 777, "s", "fine.", 1, None, "", "")], RESPONSE)
    got = {(r["response_id"], r["field_name"]): r["defect"] for r in p4.found(req, resp).collect()}
    wrong = [(rows[k][1], d, got.get((k, "content"))) for k, (*_, d) in enumerate(rows) if got.get((k, "content")) != d]
    assert len(wrong) <= 0.04 * len(rows), wrong
    assert got[(900, "content")] == "empty_answer" and got[(901, "proposal_summary")] == "empty_answer" and (900, "proposal_summary") not in got
    assert p4.found(req.limit(0), resp.limit(0)).count() == 0


def test_label_model_learns_from_agreement():
    post = p4.fit([((1, 1, 1), 30), ((-1, -1, -1), 900), ((1, 0, 1), 10), ((0, 0, 0), 40), ((1, -1, -1), 20)])
    assert post[(1, 1, 1)] > 0.95 and post[(1, 0, 1)] > 0.8 and post[(-1, -1, -1)] < 0.01 and post[(1, -1, -1)] < 0.5 and p4.fit([]) == {}
