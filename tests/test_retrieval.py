"""Ranking and search against hand-worked values and a loop written from the description."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seamline.functions import fixed
from seamline.operators import retrieval as R


def ranked(spark, queries, docs):
    q = spark.createDataFrame(queries, "g string, qid bigint, text string, docs_wanted boolean")
    d = spark.createDataFrame(docs, "g string, did bigint, path string, text string")
    return [tuple(r) for r in R.ranked(q, d, ["g"], "qid", "did", "path").select("qid", "did", "score", "keywords").orderBy("qid", "rank").collect()]


def test_worked_cosine(spark):
    got = ranked(spark, [("w", 1, "report average", False)], [("w", 1, "a", "report.py"), ("w", 2, "b", "storage json")])
    assert [(q, d) for q, d, *_ in got] == [(1, 1)] and got[0][2] == pytest.approx(0.321267, abs=2e-6) and got[0][3] == ["report"]


def test_markdown_loses_unless_wanted(spark):
    docs = [("w", 1, "x.MD", "report"), ("w", 2, "y.py", "other")]
    plain, wanted = (ranked(spark, [("w", 1, "report", flag)], docs)[0][2] for flag in (False, True))
    assert plain == pytest.approx(wanted * fixed.MARKDOWN_PENALTY, abs=2e-6)


def test_groups_ties_empty_and_nulls(spark):
    docs = [("w", k, f"p{9 - k}", "report") for k in range(6)] + [("v", 9, "q", "report"), ("w", 10, "e", ""), ("w", 11, "n", None)]
    got = ranked(spark, [("w", 1, "report", False), ("w", 2, "", False), ("w", 3, None, False), ("u", 4, "report", False)], docs)
    assert [d for q, d, *_ in got] == [5, 4, 3, 2] and {q for q, *_ in got} == {1}
    assert ranked(spark, [("w", 1, "x", False)], []) == []


def test_random_cosines_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(12)]
    docs = [("w", k, f"p{k}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for k in range(20)]
    query = " ".join(rng.choices([*words, "unseen"], k=5))
    n = len(docs)
    df = {w: sum(w in t.split() for *_, t in docs) for w in [*words, "unseen"]}

    def weigh(t):
        toks = t.split()
        return {w: toks.count(w) / len(toks) * (math.log((n + 1) / (df[w] + 1)) + 1) for w in set(toks)}

    q = weigh(query)
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = sorted(((round(sum(q[w] * x for w, x in v.items() if w in q) / (norm(q) * norm(v)), 6), p, k) for _, k, p, t in docs if (v := weigh(t))), key=lambda x: (-x[0], x[1]))
    want = [(k, s) for s, p, k in want if s > 0][:4]
    got = [(d, s) for _, d, s, _ in ranked(spark, [("w", 1, query, False)], docs)]
    assert [k for k, _ in got] == [k for k, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


FILES = ["README.md", "docs/a.md", "backend/service.py", "backend/b.py", "backend/c.py", "src/panel.ts", "src/x/y.ts", "package.json", "notes/z.txt", "m.py", "n.py"]


def loop_top(scored, active, project):
    """The choice as a loop: (file, score, folder) in sorted order."""
    most = fixed.SEARCH_FILES_IN_PROJECT if project else fixed.SEARCH_FILES
    chosen, late, per = [], [], {}
    if active and not project:
        for f, s, d in scored:
            if f == active:
                chosen.append(f)
                per[d] = 1
    for f, s, d in scored:
        if f in chosen:
            continue
        if len(chosen) >= most:
            break
        if s <= 0 and chosen:
            continue
        if project and per.get(d, 0) >= 2:
            late.append(f)
            continue
        chosen.append(f)
        per[d] = per.get(d, 0) + 1
    return chosen + late[: most - len(chosen)]


@pytest.mark.parametrize("prompt", ["update docs for the python service", "整个项目 refactor backend", "zzz", "panel ui config package", None])
@pytest.mark.parametrize("active", [None, "/w/backend/b.py", "/w/gone.py"])
def test_search_matches_the_loop(spark, prompt, active):
    req = spark.createDataFrame([(1, "/w", prompt, active)], "request_id bigint, workspace_root string, prompt string, active_file string")
    files = spark.createDataFrame([("/w", k, p, f"/w/{p}") for k, p in enumerate(FILES)], "workspace_root string, file_id bigint, relative_path string, absolute_path string")
    scores = R.path_scores(req, files)
    placed = R.search_order(scores).orderBy("place").collect()
    project = placed[0]["project_scope"]
    want = loop_top([(r["abs_"], r["score"], r["dir_"]) for r in placed], active, project)
    got = [f"/w/{r['relative_path']}" for r in R.search_top(scores).orderBy("rank").collect()]
    assert got == want


def test_searchable(spark):
    rows = [("/w/a.py", 1, ".py"), ("/w/node_modules/a.py", 1, ".py"), ("/w/big.py", 120_001, ".py"), ("/w/edge.PY", 120_000, ".PY"), ("/w/a.bin", 1, ".bin")]
    df = spark.createDataFrame(rows, "absolute_path string, size_bytes bigint, suffix string")
    assert {r["absolute_path"] for r in R.searchable(df).collect()} == {"/w/a.py", "/w/edge.PY"}


def test_extra_columns_and_repeats_do_not_matter(spark):
    d = spark.createDataFrame([(1, "a b a", "x"), (1, "a b a", "x")], "doc_id bigint, text string, term string").distinct()
    got = {(r["term"], r["n"], r["n_tokens"]) for r in R.token_counts(d.select("doc_id", F.lit("alpha beta alpha").alias("text")), ["doc_id"]).collect()}
    assert got == {("alpha", 2, 3), ("beta", 1, 3)}
