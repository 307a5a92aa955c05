"""Text functions: golden values worked out by hand, and edge cases."""

from pyspark.sql import functions as F

from seamline.functions import text as X
from seamline.functions.arrow import tokenizer


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


def test_ascii_tokens_and_parts(spark):
    assert one(spark, X.tokens("x", {}), "report.py") == ["py", "report", "report.py"]
    assert one(spark, X.tokens("x", {}), "end. of") == ["end", "end.", "of"]


def test_runs_and_ngrams(spark):
    assert one(spark, X.tokens("x", {}, []), "报表") == ["报表", "报表"]
    assert one(spark, X.tokens("x", {}, []), "平均分") == ["平均分", "平均", "均分", "平均分"]
    assert one(spark, X.tokens("x", {}, []), "学生名单") == ["学生名单", "学生", "生名", "名单", "学生名", "生名单"]


def test_aliases_stopwords_and_empty(spark):
    got = one(spark, X.tokens("x"), "平均分 the code")
    assert got.count("average") == 2 and "the" not in got and "code" not in got
    assert one(spark, X.tokens("x"), None) == [] and one(spark, X.tokens("x"), "") == []


def test_tokens_agree_with_the_batch_tokenizer(spark):
    texts = ["Fix load_students in backend/tools/a-b.py: 加载学生成绩, 报告和统计!", "a.b.c _x9/y 项目 文件夹", "ÄÖ naïve İstanbul", "  "]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(X.tokens("x").alias("y")).collect()
    make = tokenizer()
    assert [r["y"] for r in rows] == [make(t) for t in texts]


def test_strip_and_canonical(spark):
    assert one(spark, X.strip("x"), "\u3000 a b\xa0\r\n") == "a b"
    assert one(spark, X.canonical("x"), "a\r\nb\rc\n\n") == "a\nb\nc"
    assert one(spark, X.canonical("x"), None) == ""


def test_excerpt_keeps_or_marks(spark):
    assert one(spark, X.excerpt("x", 3, "..."), "  abc ") == "abc"
    assert one(spark, X.excerpt("x", 3, "..."), "abcd") == "abc..."


def test_paths(spark):
    p = "src\\core/A.Test.TS"
    assert one(spark, X.suffix("x"), p) == ".ts" and one(spark, X.file_name("x"), p) == "A.Test.TS" and one(spark, X.parent("x"), p) == "src/core"
    assert one(spark, X.suffix("x"), ".env") == "" and one(spark, X.suffix("x"), "") == ""
    assert one(spark, X.normal_path("x"), "/a/./b/../c//d") == "/a/c/d"
    assert one(spark, X.last_two("x"), "a/b/c") == "b/c" and one(spark, X.last_two("x"), "b/c") == "b/c"
    assert one(spark, X.relative_to("x", F.lit("/w/")), "/w/a/b") == "a/b" and one(spark, X.relative_to("x", F.lit("/w")), "/v/a") == "/v/a"
    assert one(spark, X.joined_url("x", F.lit("api")), "http://h//") == "http://h/api"


def test_tags_and_fences(spark):
    assert one(spark, X.tag("x", "kind"), "<KIND>\n a </kind><kind>b</kind>") == "a"
    assert one(spark, X.tag("x", "kind"), "none") == ""
    assert one(spark, X.largest_code_block("x"), "```a\n1\n```\n```\n22\n```\n```\n33\n```") == "22"
    assert one(spark, X.unwrapped("x"), " ```py\nx\n``` ") == "x"
    assert one(spark, X.file_body("x"), "\r\n```py\n  x\n```\n") == "  x"
    assert one(spark, X.action_kind("x"), " Update-Docs ") == "update_documentation" and one(spark, X.action_kind("x"), "drop") is None


def test_literal_repair_breaks_the_longer_name_and_strict_does_not(spark):
    text = "<proposal_summary>x</proposal_summary>"
    assert one(spark, X.tag(X.repaired_tags("x"), "proposal_summary"), text) == ""
    assert one(spark, X.tag(X.repaired_tags("x", strict=True), "proposal_summary"), text) == "x"
    assert one(spark, X.tag(X.repaired_tags("x", strict=True), "kind"), "kind>create</kind>") == "create"


def test_thoughts(spark):
    assert one(spark, X.without_thoughts("x"), "<think>a</think> b") == "b"
    assert one(spark, X.without_thoughts("x"), "<think>a</think>") == "<think>a</think>"
    assert one(spark, X.partial_chat("x"), "a<think>b</think>c<think>d") == "ac"
    assert one(spark, X.partial_file("x"), "<summary>s</summary>\n<updated_content>\nx = 1\n</updated_content>") == "x = 1"


def test_lines_and_counts(spark):
    assert one(spark, X.lines("x"), "a\r\nb\n") == ["a", "b", ""] and one(spark, X.lines("x"), "") == [] and one(spark, X.lines("x"), None) == []
    assert one(spark, X.line_count("x"), "\n a \n b \n") == 2 and one(spark, X.line_count("x"), " ") == 0


def test_chunks(spark):
    assert [len(p) for p in one(spark, X.chunk_prefixes("x"), "a" * 1000)] == [250, 500, 750, 1000]
    assert one(spark, X.chunk_prefixes("x"), "") == [""] and len(one(spark, X.chunk_prefixes("x"), "a" * 50_000)) == 12


def test_busy_and_grades(spark):
    assert one(spark, X.is_busy("x"), "正在思考") and not one(spark, X.is_busy("x"), "待命") and not one(spark, X.is_busy("x"), None)
    assert [one(spark, X.grade("x"), v, "double") for v in (90.0, 89.9, 70.0, 10.0)] == ["A", "B", "C", "D"]
