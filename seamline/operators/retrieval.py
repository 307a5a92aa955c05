"""Search by path rules and ranking by weighted terms (TF-IDF, cosine), both as joins and aggregates.

Ranking never compares a query with every document: terms meet by an equi-join on (group, term), only term
counts are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.arrow import spread, term_counts
from ..sources.shared import cut


# --- term statistics ---------------------------------------------------------------------------------------


def token_counts(docs: DataFrame, keys: list[str], text: str = "text", aliases: dict | None = None) -> DataFrame:
    """keys, term, n, first (ordinal of its first token), n_tokens: one row for each term of a document.

    ``keys`` identify a row.  Terms are counted where the text is read, so neither texts nor single tokens are
    shuffled; Python does it, as array functions with lambdas are interpreted and take several times as long.
    """
    return term_counts(spread(docs), keys, text, fixed.ALIASES if aliases is None else aliases)


def document_frequency(counts: DataFrame, group: list[str]) -> DataFrame:
    """group, term, df: exact number of documents with the term; ``counts`` has one row for each document and term."""
    return counts.groupBy(*group, "term").agg(F.count("*").alias("df"))


def weights(counts: DataFrame, frequency: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """``counts`` with w = n / n_tokens * (ln((N + 1) / (df + 1)) + 1); a term no document has counts with df 0."""
    f = frequency.select(*[F.col(g).alias(f"g_{g}") for g in group], F.col("term").alias("t_"), "df")
    on_f = counts["term"] == F.col("t_")
    for g in group:
        on_f = on_f & counts[g].eqNullSafe(F.col(f"g_{g}"))
    with_df = counts.join(f, on_f, "left").drop("t_", *[f"g_{g}" for g in group])
    s = sizes.select(*[F.col(g).alias(f"g_{g}") for g in group], F.col("n_docs").alias("n_docs"))
    on_s = F.lit(True)
    for g in group:
        on_s = on_s & with_df[g].eqNullSafe(F.col(f"g_{g}"))
    joined = with_df.join(s, on_s) if group else with_df.crossJoin(F.broadcast(s))  # one row without groups
    idf = F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1.0
    return joined.drop(*[f"g_{g}" for g in group]).withColumn("w", F.col("n") / F.col("n_tokens") * idf)


#: Parts that the documents of one group are split into where they meet queries, so a hot group is no single key.
SALTS = 16


def _once(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Term counts with one row for each key and term, written once: they are read by several steps below."""
    return cut(counts.groupBy(*keys, "term").agg(F.max("n").alias("n"), F.min("first").alias("first"), F.max("n_tokens").alias("n_tokens")))


def ranked(queries: DataFrame, docs: DataFrame, group: list[str], query_id: str, doc_id: str, path: str, most: int = fixed.SEMANTIC_MATCHES) -> DataFrame:
    """query_id, doc_id, path, score, keywords, rank: the best matches of each query among the documents of its group.

    ``queries``: group, query_id, text, docs_wanted.  ``docs``: group, doc_id, path, text; both may repeat rows.  A
    path with the suffix .md loses part of its score unless the query wants documentation.  Ties: path, then id.
    Queries and documents without terms have no match; so has a query with none in common.  Only groups that have a
    query are read.  Each text is tokenised once, where it is read; terms meet in ``SALTS`` parts of a group.
    """
    if group:
        asked = queries.select(*[F.col(g).alias(f"a_{g}") for g in group]).distinct()
        on = F.lit(True)
        for g in group:
            on = on & docs[g].eqNullSafe(asked[f"a_{g}"])
        docs = docs.join(asked, on, "left_semi")
    dc, qc = _once(token_counts(docs, [*group, doc_id]), [*group, doc_id]), _once(token_counts(queries, [*group, query_id]), [*group, query_id])
    df = document_frequency(dc, group)
    sizes = docs.groupBy(*group).agg(F.count_distinct(doc_id).alias("n_docs")) if group else docs.agg(F.count_distinct(doc_id).alias("n_docs"))
    dw, qw = cut(weights(dc, df, sizes, group).select(*group, doc_id, "term", "w")), weights(qc, df, sizes, group).select(*group, query_id, "term", "w")
    norm = lambda w, key, name: w.groupBy(F.col(key).alias(f"{name}_id")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))
    q = qw.select(*[F.col(g).alias(f"q_{g}") for g in group], query_id, F.col("term").alias("q_term"), F.col("w").alias("q_w"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("q_salt"))
    salted = dw.withColumn("salt", F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int"))
    on = (salted["term"] == q["q_term"]) & (salted["salt"] == q["q_salt"])
    for g in group:
        on = on & salted[g].eqNullSafe(q[f"q_{g}"])
    both = salted.join(q, on).withColumn("p_", F.col("w") * F.col("q_w"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("p_", 9)).alias("o"), F.col("term").alias("t")))), 1, fixed.MATCH_KEYWORDS)
    dots = both.groupBy(query_id, doc_id).agg(F.sum("p_").alias("dot"), F.transform(top, lambda x: x["t"]).alias("keywords"))
    wanted = queries.groupBy(F.col(query_id).alias("w_id")).agg(F.max("docs_wanted").alias("docs_wanted"))
    about_query = norm(qw, query_id, "qn").join(wanted, F.col("qn_id") == F.col("w_id")).drop("w_id")
    paths = docs.groupBy(F.col(doc_id).alias("p_id")).agg(F.max(path).alias("path"))
    about_doc = norm(dw, doc_id, "dn").join(paths, F.col("dn_id") == F.col("p_id")).drop("p_id")
    full = dots.join(about_doc, F.col(doc_id) == F.col("dn_id")).join(about_query, F.col(query_id) == F.col("qn_id"))
    factor = F.when(~F.col("docs_wanted") & F.lower("path").endswith(".md"), fixed.MARKDOWN_PENALTY).otherwise(1.0)
    out = full.withColumn("score", F.round(F.col("dot") / (F.col("dn") * F.col("qn")) * factor, 6)).where("score > 0")
    order = W.partitionBy(query_id).orderBy(F.desc("score"), "path", doc_id)
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.select(query_id, doc_id, "path", "score", "keywords", "rank")


def query_terms(queries: DataFrame, docs: DataFrame, group: list[str], query_id: str, doc_id: str) -> DataFrame:
    """query_id, terms: the heaviest terms of each query, ties in the order of their first appearance."""
    dc = token_counts(docs, [*group, doc_id]).dropDuplicates([*group, doc_id, "term"])
    sizes = docs.groupBy(*group).agg(F.count_distinct(doc_id).alias("n_docs")) if group else docs.agg(F.count_distinct(doc_id).alias("n_docs"))
    qw = weights(token_counts(queries, [*group, query_id]).dropDuplicates([query_id, "term"]), document_frequency(dc, group), sizes, group).withColumn("r_", F.round("w", 6))
    top = qw.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("r_"), "first"))).where(F.col("rank") <= fixed.QUERY_TERMS)
    return top.groupBy(query_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


# --- search by path ----------------------------------------------------------------------------------------


def searchable(files: DataFrame, path: str = "absolute_path", size: str = "size_bytes", suffix: str = "suffix", relative: str | None = None) -> DataFrame:
    """Files with a text suffix, not too large, with no ignored name among the parts of the path.

    The parts are those of the absolute path, so a root below a folder of such a name yields nothing;
    ``relative`` names a column to test instead.
    """
    parts = F.split(X.slashed(relative or path), "/")
    ignored = F.arrays_overlap(parts, F.array(*map(F.lit, fixed.IGNORED_DIRECTORIES)))
    return files.where(F.lower(suffix).isin(fixed.TEXT_SUFFIXES) & (F.col(size) <= fixed.MAX_FILE_BYTES) & ~ignored)


def _sum(terms: list[tuple[Column, int]]) -> Column:
    out = F.lit(0)
    for cond, w in terms:
        out = out + F.when(cond, w).otherwise(0)
    return out


def path_scores(requests: DataFrame, files: DataFrame, request_id: str = "request_id", root: str = "workspace_root") -> DataFrame:
    """Every request with every file of its workspace: score and reason.

    ``requests``: request_id, workspace_root, prompt, active_file; ``files``: workspace_root, file_id,
    relative_path, absolute_path.  What depends on the prompt alone is computed once for each request, before
    the join; prompts and contents do not travel with it.
    """
    low = F.lower(X.blank_to_empty("prompt"))
    L, S = fixed.SEARCH_LABELS, fixed.SEARCH_WEIGHTS
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(fixed.PATH_TERM), F.lit(0))))
    per_request = requests.select(
        request_id,
        F.col(root).alias("r_root"),
        F.nullif(X.slashed("active_file"), F.lit("")).alias("active_"),
        X.holds_any("prompt", fixed.PROJECT_SCOPE_WORDS).alias("project_"),
        X.holds_any("prompt", fixed.DOCUMENTATION_WORDS).alias("docs_"),
        *[X.holds_any_as_is("prompt", w).alias(n) for n, w in (("backend_", fixed.BACKEND_WORDS), ("ui_", fixed.INTERFACE_WORDS), ("config_", fixed.CONFIG_WORDS))],
        terms.alias("terms_"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("r_salt"),
    )
    rel = F.lower(X.slashed("relative_path"))
    per_file = files.select(
        F.col(root).alias("f_root"), "file_id", "relative_path", X.slashed("absolute_path").alias("abs_"), X.parent("absolute_path").alias("dir_"), rel.alias("rel_"), F.lower(X.file_name("relative_path")).alias("name_"), X.suffix("relative_path").alias("suf_"), F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int").alias("f_salt")
    )
    j = per_request.join(per_file, (F.col("r_root") == F.col("f_root")) & (F.col("r_salt") == F.col("f_salt")))
    active = F.coalesce(F.col("abs_") == F.col("active_"), F.lit(False))
    sibling = ~active & F.coalesce(F.col("dir_") == X.parent("active_"), F.lit(False))
    hits = F.filter("terms_", lambda t: F.col("rel_").contains(t))
    documentation = F.col("docs_") & ((F.col("rel_") == "readme.md") | F.col("rel_").startswith("docs/") | F.col("suf_").isin(".md", ".txt"))
    backend = F.col("backend_") & F.col("rel_").startswith("backend/")
    ui = F.col("ui_") & (F.col("rel_").startswith("src/") | F.col("rel_").startswith("media/") | F.col("rel_").startswith("webview-src/"))
    config = F.col("config_") & F.col("name_").isin(fixed.CONFIG_FILES)
    project = F.col("project_") & F.col("suf_").isin(fixed.PROJECT_SUFFIXES)
    readme, docs = F.col("rel_") == "readme.md", F.col("rel_").startswith("docs/")
    inp = F.col("project_")
    score = _sum([(active & inp, S["active_in_project"]), (active & ~inp, S["active"]), (sibling & inp, S["sibling_in_project"]), (sibling & ~inp, S["sibling"]), (documentation, S["documentation"]), (backend, S["area"]), (ui, S["area"]), (config, S["area"]), (project, S["project_suffix"]), (readme, S["readme"]), (docs, S["docs"])]) + F.size(hits) * S["term"]
    one = lambda cond, label: F.when(cond, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(one(active, L["active"]), one(sibling, L["sibling"]), F.transform(hits, lambda t: F.concat(F.lit(L["term"]), t)), one(documentation, L["documentation"]), one(backend, L["backend"]), one(ui, L["interface"]), one(config, L["config"]), one(project, L["project"]), one(readme, L["readme"]), one(docs, L["docs"]))
    reason = F.when(F.size(reasons) == 0, L["none"]).otherwise(F.array_join(F.slice(reasons, 1, 3), fixed.LABEL_SEPARATOR))
    return j.select(request_id, "file_id", "relative_path", "abs_", "dir_", active.alias("is_active"), F.col("project_").alias("project_scope"), score.cast("int").alias("score"), reason.alias("reason"))


def search_order(scores: DataFrame, request_id: str = "request_id") -> DataFrame:
    """With ``place``: by score, then shorter path, then path (in place of the listing order) and id."""
    return scores.withColumn("place", F.row_number().over(W.partitionBy(request_id).orderBy(F.desc("score"), F.length("abs_"), "abs_", "file_id")))


def search_top(scores: DataFrame, request_id: str = "request_id") -> DataFrame:
    """The candidate files of each request, in order of choice.

    The active file first unless the scope is the project; rows without a score only if nothing else was
    chosen; in project scope at most two of a folder, the others filling up at the end.  Rank, cap and fill
    are windows: a row is held back if two rows of its folder stand before it.
    """
    placed = search_order(scores, request_id)
    by = W.partitionBy(request_id)
    forced = F.col("is_active") & ~F.col("project_scope")
    # a row without a score is chosen only if it stands first and nothing was forced
    flagged = placed.withColumn("forced", forced).withColumn("has_forced_", F.max(forced.cast("int")).over(by) == 1)
    eligible = flagged.where(F.col("forced") | (F.col("score") > 0) | (~F.col("has_forced_") & (F.col("place") == 1)))
    in_folder = F.row_number().over(W.partitionBy(request_id, "dir_").orderBy("place"))
    late = F.col("project_scope") & (in_folder > fixed.SEARCH_PER_DIRECTORY)
    order = W.partitionBy(request_id).orderBy(F.desc("forced"), "late", "place")
    ranked_ = eligible.withColumn("late", late).withColumn("rank", F.row_number().over(order))
    most = F.when(F.col("project_scope"), fixed.SEARCH_FILES_IN_PROJECT).otherwise(fixed.SEARCH_FILES)
    score = F.when(F.col("forced"), F.greatest("score", F.lit(fixed.SEARCH_WEIGHTS["active"]))).otherwise(F.col("score"))
    reason = F.when(F.col("forced"), fixed.SEARCH_LABELS["active"]).otherwise(F.col("reason"))
    limited = ranked_.where(F.col("rank") <= max(fixed.SEARCH_FILES, fixed.SEARCH_FILES_IN_PROJECT))  # a literal, so each task keeps no more
    return limited.where(F.col("rank") <= most).select(request_id, "file_id", "relative_path", score.alias("score"), reason.alias("reason"), "rank")


def overview(scores: DataFrame, request_id: str = "request_id") -> DataFrame:
    """The first files of the sorted list, scored or not."""
    return search_order(scores, request_id).where(F.col("place") <= fixed.OVERVIEW_FILES).select(request_id, "place", "relative_path")


def with_fallback(top: DataFrame, requests: DataFrame, files: DataFrame, request_id: str = "request_id", root: str = "workspace_root") -> DataFrame:
    """``top``, and for requests that found nothing the usual files of their workspace that exist.

    ``files``: workspace_root, file_id, relative_path of all files, searchable or not.
    """
    lone = requests.select(request_id, F.col(root).alias("r_root")).join(top.select(F.col(request_id).alias("t_id")).distinct(), F.col(request_id) == F.col("t_id"), "left_anti")
    place = F.array_position(F.array(*map(F.lit, fixed.FALLBACK_FILES)), X.slashed("relative_path"))
    usual = files.where(X.slashed("relative_path").isin(fixed.FALLBACK_FILES)).select(F.col(root).alias("f_root"), "file_id", "relative_path", place.alias("place_"))
    found = lone.join(usual, F.col("r_root") == F.col("f_root")).withColumn("rank", F.row_number().over(W.partitionBy(request_id).orderBy("place_", "file_id")))
    rows = found.select(request_id, "file_id", "relative_path", F.lit(fixed.FALLBACK_SCORE).alias("score"), F.lit(fixed.FALLBACK_REASON).alias("reason"), "rank")
    return top.unionByName(rows)


def with_contents(top: DataFrame, contents: DataFrame) -> DataFrame:
    """``top`` with excerpt and mode; files without content are dropped now, after the best were chosen.

    ``contents``: file_id, full_content, one row a file; only the chosen files meet it.
    """
    chosen = contents.join(top.select(F.col("file_id").alias("k_")).distinct(), F.col("file_id") == F.col("k_"), "left_semi").where("full_content <> ''")
    texts = chosen.groupBy(F.col("file_id").alias("c_id")).agg(F.max(X.excerpt("full_content")).alias("excerpt"), F.max(F.when(F.length("full_content") <= fixed.FULL_CONTENT_CHARS, "full").otherwise("excerpt")).alias("mode"))
    return top.join(texts, F.col("file_id") == F.col("c_id")).drop("c_id")


def related(top: DataFrame, targets: DataFrame, most: int, request_id: str = "request_id") -> DataFrame:
    """The first ``most`` files of each request that are none of its targets (request_id, path)."""
    t = targets.select(F.col(request_id).alias("t_id"), F.lower(X.slashed("path")).alias("t_path"))
    rest = top.join(t, (F.col(request_id) == F.col("t_id")) & (F.lower(X.slashed("relative_path")) == F.col("t_path")), "left_anti")
    return rest.withColumn("place", F.row_number().over(W.partitionBy(request_id).orderBy("rank"))).where(F.col("place") <= most)
