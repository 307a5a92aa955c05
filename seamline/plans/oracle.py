"""SQL that gives the same rows as the queries of ``queries.py``, for an independent engine (DuckDB dialect).

Where a key is missing the operator needs Python or a fold; its tests compare it with brute force instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import fixed
from .queries import ASKING

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items: Sequence[str]) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def canonical(x: str) -> str:
    return strip(f"regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g')")


def _any(low: str, words: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({low}, {_q(w)})" for w in words) + ")"


def or_empty(x: str) -> str:
    return f"coalesce({x}, '')"


def holds(x: str, words: Sequence[str]) -> str:
    return _any(f"lower({strip(or_empty(x))})", words)


def holds_as_is(x: str, words: Sequence[str]) -> str:
    return _any(f"lower(coalesce({x}, ''))", words)


def first(table: str, key: str) -> str:
    return f"(select * from {table} qualify row_number() over (partition by {key} order by ingested_at) = 1)"


def slashed(x: str) -> str:
    return f"replace({x}, '\\', '/')"


def name(x: str) -> str:
    return f"list_last(string_split({slashed(x)}, '/'))"


def suffix(x: str) -> str:
    return f"lower(regexp_extract({name(x)}, '(?s)^.+(\\.[^.]+)$', 1))"


def parent(x: str) -> str:
    return f"regexp_extract({slashed(x)}, '(?s)^(.*)/[^/]*$', 1)"


def documents_path(x: str) -> str:
    return f"(lower({slashed(x)}) = 'readme.md' or starts_with(lower({slashed(x)}), 'docs/') or list_contains({_list(fixed.DOCUMENTATION_SUFFIXES)}, {suffix(x)}))"


def tokens(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    names = f"flatten(list_transform(regexp_extract_all({low}, '{fixed.ASCII_TOKEN}'), lambda t: list_sort(list_distinct(list_concat([t], list_filter(regexp_split_to_array(t, '[./_-]+'), lambda p: length(p) >= 2))))))"
    grams = lambda k: f"list_transform(range(1, length(s) - {k - 2}), lambda i: substring(s, i::int, {k}))"
    runs = f"flatten(list_transform(regexp_extract_all({low}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda s: list_concat([s], case when length(s) <= 2 then [s] else list_concat({grams(2)}, {grams(3)}) end)))"
    base = f"list_concat({names}, {runs})"
    alias = "list_concat(" + ", ".join(f"case when contains(t, {_q(k)}) then {_list(v)} else []::varchar[] end" for k, v in fixed.ALIASES.items()) + ")"
    return f"list_filter(list_concat({base}, flatten(list_transform({base}, lambda t: {alias}))), lambda t: length(t) >= 2 and not list_contains({_list(fixed.STOPWORDS)}, t))"


def counts(source: str, keys: str) -> str:
    """SQL of term counts of ``source`` (keys, text)."""
    return (
        f"select {keys}, term, count(*) as n, min(pos) as first, max(n_tokens) as n_tokens from (select {keys}, len(toks) as n_tokens, unnest(toks) as term, generate_subscripts(toks, 1) - 1 as pos "
        f"from (select {keys}, {tokens('text')} as toks from {source})) group by {keys}, term"
    )


_WEIGHT = "n / n_tokens * (ln((n_docs + 1) / (coalesce(df, 0) + 1)) + 1.0)"
_TEXT_OF_FILE = "concat_ws(chr(10), nullif(relative_path, ''), nullif(reason, ''), nullif(excerpt, ''))"

_SEMANTIC = f"""
with q as (select workspace_root, request_id, concat_ws(chr(10), nullif(prompt, ''), nullif(selected_text, '')) as text, {holds('prompt', fixed.DOCUMENTATION_WORDS)} as wanted
           from {first('gen_requests', 'request_id')} where request_id % {ASKING} = 0 and workspace_root is not null),
f as (select workspace_root, snapshot_id, relative_path as path, {_TEXT_OF_FILE} as text from {first('file_snapshots', 'snapshot_id')} where workspace_root is not null),
dc as ({counts('f', 'workspace_root, snapshot_id')}),
df as (select workspace_root, term, count(*) as df from dc group by all),
nd as (select workspace_root, count(distinct snapshot_id) as n_docs from f group by all),
dw as (select dc.workspace_root, snapshot_id, dc.term, {_WEIGHT} as w from dc join df on dc.workspace_root = df.workspace_root and dc.term = df.term join nd on nd.workspace_root = dc.workspace_root),
qc as ({counts('q', 'workspace_root, request_id')}),
qw as (select qc.workspace_root, request_id, qc.term, first, {_WEIGHT} as w from qc left join df on qc.workspace_root = df.workspace_root and qc.term = df.term join nd on nd.workspace_root = qc.workspace_root)
"""

_SEARCHABLE = f"list_contains({_list(fixed.TEXT_SUFFIXES)}, lower(suffix)) and size_bytes <= {fixed.MAX_FILE_BYTES} and not list_has_any(string_split({slashed('absolute_path')}, '/'), {_list(fixed.IGNORED_DIRECTORIES)})"


def _search() -> str:
    s, lab = fixed.SEARCH_WEIGHTS, fixed.SEARCH_LABELS
    hits = "list_filter(terms, lambda t: contains(rel, t))"
    flags = {
        "documentation": "(docs and (rel = 'readme.md' or starts_with(rel, 'docs/') or suf in ('.md', '.txt')))",
        "backend": "(backend and starts_with(rel, 'backend/'))",
        "interface": "(ui and (starts_with(rel, 'src/') or starts_with(rel, 'media/') or starts_with(rel, 'webview-src/')))",
        "config": f"(config and list_contains({_list(fixed.CONFIG_FILES)}, nam))",
        "project": f"(project and list_contains({_list(fixed.PROJECT_SUFFIXES)}, suf))",
        "readme": "(rel = 'readme.md')",
        "docs": "starts_with(rel, 'docs/')",
    }
    weight = {"documentation": s["documentation"], "backend": s["area"], "interface": s["area"], "config": s["area"], "project": s["project_suffix"], "readme": s["readme"], "docs": s["docs"]}
    score = f"case when active and project then {s['active_in_project']} when active then {s['active']} else 0 end + case when sibling and project then {s['sibling_in_project']} when sibling then {s['sibling']} else 0 end + len(hits) * {s['term']}"
    score += "".join(f" + case when {c} then {weight[k]} else 0 end" for k, c in flags.items())
    parts = [f"case when active then [{_q(lab['active'])}] else [] end", f"case when sibling then [{_q(lab['sibling'])}] else [] end", f"list_transform(hits, lambda t: {_q(lab['term'])} || t)"]
    parts += [f"case when {c} then [{_q(lab[k])}] else [] end" for k, c in flags.items()]
    reason = "list_concat(" + ", ".join(parts) + ")"
    return f"""
with r as (select request_id, workspace_root, nullif({slashed('active_file')}, '') as act, {holds('prompt', fixed.PROJECT_SCOPE_WORDS)} as project, {holds('prompt', fixed.DOCUMENTATION_WORDS)} as docs,
    {holds_as_is('prompt', fixed.BACKEND_WORDS)} as backend, {holds_as_is('prompt', fixed.INTERFACE_WORDS)} as ui, {holds_as_is('prompt', fixed.CONFIG_WORDS)} as config,
    list_sort(list_distinct(regexp_extract_all(lower(coalesce(prompt, '')), '{fixed.PATH_TERM}'))) as terms from {first('gen_requests', 'request_id')} where request_id % {ASKING} = 0),
f as (select workspace_root, snapshot_id as file_id, relative_path, {slashed('absolute_path')} as abs_, {parent('absolute_path')} as dir_, lower({slashed('relative_path')}) as rel, lower({name('relative_path')}) as nam, {suffix('relative_path')} as suf
    from {first('file_snapshots', 'snapshot_id')} where {_SEARCHABLE}),
j as (select *, coalesce(abs_ = act, false) as active, not coalesce(abs_ = act, false) and coalesce(dir_ = {parent('act')}, false) as sibling, {hits} as hits from r join f using (workspace_root)),
s as (select request_id, file_id, relative_path, abs_, dir_, active, project, {score} as score, {reason} as reasons from j),
scored as (select request_id, file_id, relative_path, abs_, dir_, active, project, score, case when len(reasons) = 0 then {_q(lab['none'])} else array_to_string(reasons[1:3], {_q(fixed.LABEL_SEPARATOR)}) end as reason,
    row_number() over (partition by request_id order by score desc, length(abs_), abs_, file_id) as place from s)
"""


_TOP = f"""
, e as (select *, active and not project as forced, max((active and not project)::int) over (partition by request_id) = 1 as has_forced from scored),
k as (select *, project and row_number() over (partition by request_id, dir_ order by place) > {fixed.SEARCH_PER_DIRECTORY} as late from e where forced or score > 0 or (not has_forced and place = 1)),
o as (select *, row_number() over (partition by request_id order by forced desc, late, place) as rank from k)
select request_id, file_id, case when forced then greatest(score, {fixed.SEARCH_WEIGHTS['active']}) else score end as score, case when forced then {_q(fixed.SEARCH_LABELS['active'])} else reason end as reason, rank
from o where rank <= case when project then {fixed.SEARCH_FILES_IN_PROJECT} else {fixed.SEARCH_FILES} end
"""

_HISTORY = f"""
select conv_id, string_agg(role || ': ' || {strip("coalesce(content, '')")}, chr(10) order by turn) as history from
(select * from {first('turns', 'turn_id')} where role in ('user', 'agent') qualify row_number() over (partition by conv_id order by turn desc) <= {fixed.HISTORY_TURNS}) group by conv_id
"""


def _routes() -> str:
    has = lambda w: holds("prompt", w)
    blank = f"({strip(or_empty('prompt'))} = '')"
    no_sel = f"({strip(or_empty('selected_text'))} = '')"
    no_root = f"({strip(or_empty('workspace_root'))} = '')"
    hist = f"({strip('history')} <> '' and {holds_as_is('history', fixed.WORKSPACE_HISTORY_WORDS)})"
    anchored = f"(not {no_sel} or {holds_as_is('history', fixed.EDIT_HISTORY_WORDS)})"
    edit = f"""case when {blank} then false when {has(fixed.EDIT_WORKSPACE_WORDS)} then false when {has(fixed.EDIT_INQUIRY_WORDS)} and not {has(fixed.EDIT_REQUEST_WORDS)} then false
        when {has(fixed.EDIT_VERBS)} and {has(fixed.EDIT_TARGETS)} and not {has(fixed.EDIT_INQUIRY_WORDS)} then true when {has(fixed.EDIT_VERBS)} and {anchored} and {has(fixed.EDIT_REQUEST_WORDS)} then true
        when not {has(fixed.EDIT_INQUIRY_WORDS)} and {has(fixed.EDIT_CONTINUATION_WORDS)} and {anchored} then true else false end"""
    change = f"(not {blank} and ({has(fixed.WORKSPACE_STRONG_WORDS)} or ({has(fixed.WORKSPACE_VERBS)} and ({has(fixed.WORKSPACE_TARGETS)} or {hist}) and {no_sel})))"
    return f"""
with h as ({_HISTORY}), r as (select g.*, coalesce(h.history, '') as history from {first('gen_requests', 'request_id')} g left join h on g.conv_id = h.conv_id),
x as (select request_id, {edit} as edits_file, {change} as changes_workspace, {has(fixed.PROJECT_SCOPE_WORDS)} as project_scope, {has(fixed.DOCUMENTATION_WORDS)} as wants_documentation, {has(fixed.CREATION_WORDS)} as wants_creation,
  {has(fixed.CODE_CHANGE_WORDS)} as wants_code, {has(fixed.OPTIONAL_DOCUMENTATION_WORDS)} as documentation_optional,
  (coalesce(active_file, '') <> '' and coalesce(full_document_text, '') <> '' and not {has(fixed.MULTI_FILE_WORDS)}) as falls_back, {no_root} as no_root from r)
select * exclude (no_root), case when edits_file then 'edit' when changes_workspace then 'workspace' else 'chat' end as route,
  case when edits_file then 'edit' when no_root and falls_back then 'edit' when changes_workspace then 'workspace' else 'chat' end as stream_route from x
"""


def _line_count(x: str) -> str:
    c = canonical(x)
    return f"case when {c} = '' then 0 else len(string_split({c}, chr(10))) end"


def _risk() -> str:
    w, lab = fixed.RISK_WEIGHTS, fixed.RISK_LABELS
    differ = lambda p: f"(len(regexp_extract_all(coalesce(original_content, ''), '{p}')) <> len(regexp_extract_all(coalesce(updated_content, ''), '{p}')))"
    act = f"lower({strip(or_empty('active_file'))})"
    f = lambda c, k: f" + case when {c} then {w[k]} else 0 end"
    raw = f"case when kind = 'create_file' then {w['create']} when kind = 'update_documentation' then {w['documentation']} else {w['update']} end"
    raw += f("code", "code") + f" + case when n > 1 then least({w['most_more']}, (n - 1) * {w['each_more']}) else 0 end" + f("folders > 1", "directories")
    raw += f("sig", "signature") + f("imp", "import") + f("large", "large") + f("elsewhere", "not_active")
    one = lambda c, k: f"case when {c} then [{_q(lab[k])}] else [] end"
    reasons = "list_concat([case when kind = 'create_file' then " + _q(lab["create"]) + " when kind = 'update_documentation' then " + _q(lab["documentation"]) + " else " + _q(lab["update"]) + " end], "
    reasons += ", ".join([one("code", "code"), "case when n > 1 then ['本次方案涉及 ' || n || ' 个文件'] else [] end", one("folders > 1", "directories"), one("sig", "signature"), one("imp", "import"), one("large", "large"), one("elsewhere", "not_active")]) + ")"
    lev = f"case when score >= {fixed.RISK_HIGH} then 'high' when score >= {fixed.RISK_MEDIUM} then 'medium' else 'low' end"
    return f"""
with a as (select f.*, g.active_file from {first('file_actions', 'action_id')} f left join {first('gen_responses', 'response_id')} r on f.response_id = r.response_id left join {first('gen_requests', 'request_id')} g on r.request_id = g.request_id),
c as (select response_id, action_id, kind, lower({parent('target_file')}) as folder, list_contains({_list(fixed.RISK_CODE_SUFFIXES)}, {suffix('target_file')}) as code, {differ(fixed.SIGNATURE_LINE)} as sig, {differ(fixed.IMPORT_LINE)} as imp,
   {_line_count('original_content')} as l0, {_line_count('updated_content')} as l1, {act} <> '' and {act} <> lower(target_file) as elsewhere from a),
b as (select *, case when l0 = 0 then l1 >= {fixed.LARGE_NEW_LINES} else abs(l1 - l0) >= {fixed.LARGE_DELTA_LINES} or abs(l1 - l0) / greatest(l0, 1) >= {fixed.LARGE_DELTA_SHARE} end as large from c),
m as (select response_id, count(*) as n, count(distinct folder) as folders from b group by 1),
s as (select b.response_id, action_id, folder, least(100, case when kind = 'update_documentation' then greatest(0, {raw} - {w['documentation_relief']}) else {raw} end) as score, array_to_string({reasons}[1:3], {_q(fixed.LABEL_SEPARATOR)}) as reason from b join m using (response_id)),
l as (select *, {lev} as level from s)
"""


_BATCH = f"""
, g as (select response_id, max(score) as worst, count(*) as actions, count(distinct folder) as folders, bool_or(level = 'high') as any_high, bool_or(contains(reason, '签名变化')) as any_signature from l group by 1),
t as (select *, least({fixed.RISK_BATCH['most']}, worst + (actions - 1) * {fixed.RISK_BATCH['each_more']} + (greatest(folders, 1) - 1) * {fixed.RISK_BATCH['each_directory']}) as score from g)
select response_id, actions, folders, score, case when score >= {fixed.RISK_HIGH} then 'high' when score >= {fixed.RISK_MEDIUM} then 'medium' else 'low' end as level, any_high, any_signature from t
"""


def _lines(x: str) -> str:
    return f"case when coalesce({x}, '') = '' then []::varchar[] else string_split(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(10)) end"


_DIFF = f"""
with a as (select *, {_lines('original_content')} as o, {_lines('updated_content')} as u from {first('file_actions', 'action_id')}),
b as (select *, len(o) as old_lines, len(u) as new_lines, coalesce(list_min(list_filter(range(1, least(len(o), len(u)) + 1), lambda i: o[i] <> u[i])) - 1, least(len(o), len(u))) as prefix from a),
c as (select *, least(len(o), len(u)) - prefix as room from b),
d as (select *, coalesce(list_min(list_filter(range(1, room + 1), lambda i: o[len(o) + 1 - i] <> u[len(u) + 1 - i])) - 1, room) as suffix from c),
e as (select *, old_lines - prefix - suffix as removed, new_lines - prefix - suffix as added from d)
"""


def _diff_text() -> str:
    lead = lambda arr, m: f"list_transform({arr}, lambda x: {_q(m)} || x)"
    head = "['--- ' || case when kind = 'create_file' then '(new file)' else target_file end, '+++ ' || target_file]"
    c, m = fixed.DIFF_CONTEXT, fixed.DIFF_LINES
    changed = f"list_concat({head}, ['@@ around line ' || (prefix + 1) || ' @@'], {lead(f'o[greatest(0, prefix - {c}) + 1:prefix]', '  ')}, {lead('o[prefix + 1:old_lines - suffix]', '- ')}, {lead('u[prefix + 1:new_lines - suffix]', '+ ')}, {lead(f'o[old_lines - suffix + 1:least(old_lines, old_lines - suffix + {c})]', '  ')})"
    whole = f"case when old_lines = 0 and new_lines > 0 then list_concat({head}, ['@@ new file @@'], {lead('u', '+ ')}) when removed = 0 and added = 0 then list_concat({head}, ['@@ no changes @@']) else {changed} end"
    return f"{_DIFF}, f as (select action_id, {whole} as w from e) select action_id, case when len(w) <= {m} then array_to_string(w, chr(10)) else array_to_string(list_concat(w[1:{m}], ['... (' || (len(w) - {m}) || ' more diff lines omitted)']), chr(10)) end as diff from f"


_EVENTS = """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null),
v as (select * from l where starts_with(line, '{') and json_valid(line)),
e as (select doc_id, line_no, line->>'$.type' as type, line->>'$.payload.chunk' as chunk, (line->>'$.payload.seq')::bigint as seq from v where line->>'$.type' is not null)
"""

_MARKS = "select l_orderkey, (l_quantity * 2 + (100 - l_discount * 1000) + (100 - l_tax * 1000)) / 3 as average from lineitem"


def _written() -> str:
    body = "replace(regexp_replace(coalesce(updated_content, ''), '\\r\\n?', chr(10), 'g'), chr(10), chr(13) || chr(10))"
    return f"select action_id, length(w) as n_chars, md5(w) as digest from (select action_id, case when ends_with(coalesce(original_content, ''), chr(10)) and not ends_with({body}, chr(13) || chr(10)) then {body} || chr(13) || chr(10) else {body} end as w from {first('file_actions', 'action_id')})"


def _apply() -> str:
    same, moved = f"{canonical('updated_content')} = {canonical('original_content')}", "false"
    below = f"(starts_with({slashed('target_file')}, regexp_replace({slashed('workspace_root')}, '/+$', '') || '/') or not starts_with({slashed('target_file')}, '/'))"
    return f"""select kind, outcome, count(*) as n from (select kind, case when not coalesce({below} and {strip('target_file')} <> '' and not contains('/' || {slashed('target_file')} || '/', '/../'), false) then 'skipped'
      when kind = 'create_file' then 'applied' when {moved} or {same} then 'skipped' else 'applied' end as outcome from {first('file_actions', 'action_id')}) group by all"""


def oracle_sql() -> dict[str, str]:
    tag = lambda x, t: f"regexp_extract({x}, '(?is)<{t}>\\s*(.*?)\\s*</{t}>', 1)"
    kinds = "case " + " ".join(f"when k = {_q(a)} then {_q(b)}" for a, b in fixed.KIND_ALIASES.items()) + " end"
    edge = lambda x: f"regexp_replace({x}, '^[\\r\\n]+|[\\r\\n]+$', '', 'g')"
    fence = "(?s)```[^\\n]*\\n(.*?)\\n```"
    mark = f"'{fixed.EXCERPT_MARK[1:]}'"
    short = f"list_filter(string_split({slashed('target_file')}, '/'), lambda s: s <> '')"
    think = strip("regexp_replace(content, '(?s)<think>.*?</think>\\s*', '', 'g')")
    n_lines = "len(regexp_split_to_array(full_content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')) - case when regexp_matches(full_content, '[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]\\z') then 1 else 0 end"
    setting = lambda c, d: f"coalesce(nullif(trim({c}), ''), {_q(d)}) as {c}"
    chunks = f"greatest({fixed.FEWEST_CHUNKS}, least({fixed.MOST_CHUNKS}, ceil(length(t) / {fixed.CHUNK_CHARS})::int))"
    docs = "(select doc_id, text from documents)"
    return {
        "token_counts": f"select doc_id, term, n, n_tokens from ({counts(docs, 'doc_id')})",
        "document_frequency": f"select term, count(*) as df from ({counts(docs, 'doc_id')}) group by term",
        "tfidf_weights": f"with c as ({counts(docs, 'doc_id')}), d as (select term, count(*) as df from c group by term), k as (select count(*) as n_docs from documents) select doc_id, c.term, round({_WEIGHT}, 6) as w from c join d on c.term = d.term, k",
        "semantic_topk": f"""{_SEMANTIC}, dot as (select request_id, snapshot_id, sum(qw.w * dw.w) as dot from qw join dw on qw.workspace_root = dw.workspace_root and qw.term = dw.term group by 1, 2),
            dn as (select snapshot_id, sqrt(sum(w * w)) as n from dw group by 1), qn as (select request_id, sqrt(sum(w * w)) as n from qw group by 1),
            s as (select request_id, snapshot_id, path, round(dot / (dn.n * qn.n) * case when not wanted and ends_with(lower(path), '.md') then {fixed.MARKDOWN_PENALTY} else 1.0 end, 6) as score from dot join dn using (snapshot_id) join qn using (request_id) join (select request_id, wanted from q) using (request_id) join (select snapshot_id, path from f) using (snapshot_id))
            select request_id, snapshot_id, path, score, row_number() over (partition by request_id order by score desc, path, snapshot_id) as rank from s where score > 0 qualify rank <= {fixed.SEMANTIC_MATCHES}""",
        "semantic_query_terms": f"{_SEMANTIC} select request_id, string_agg(term, ' ' order by rank) as terms from (select request_id, term, row_number() over (partition by request_id order by round(w, 6) desc, first) as rank from qw) where rank <= {fixed.QUERY_TERMS} group by 1",
        "search_scores": f"{_search()} select request_id, file_id, score, reason from scored",
        "search_top": _search() + _TOP,
        "search_overview": f"{_search()} select request_id, place, relative_path from scored where place <= {fixed.OVERVIEW_FILES}",
        "excerpts": f"select snapshot_id, case when length(c) <= {fixed.EXCERPT_CHARS} then c else substring(c, 1, {fixed.EXCERPT_CHARS}) || chr(10) || {mark} end as cut, mode from (select snapshot_id, {strip('coalesce(full_content, ' + _q('') + ')')} as c, case when length(coalesce(full_content, '')) <= {fixed.FULL_CONTENT_CHARS} then 'full' else 'excerpt' end as mode from {first('file_snapshots', 'snapshot_id')})",
        "request_routes": _routes(),
        "explicit_paths": f"select request_id, ordinal, path from (select request_id, ordinal, replace(trim(raw, {_q(fixed.PATH_TRIM)}), '\\', '/') as path from (select request_id, unnest(m) as raw, generate_subscripts(m, 1) - 1 as ordinal from (select request_id, regexp_extract_all(coalesce(prompt, ''), '{fixed.EXPLICIT_PATH}') as m from {first('gen_requests', 'request_id')}))) where path <> '' qualify row_number() over (partition by request_id, lower(path) order by ordinal) = 1",
        "history_text": _HISTORY,
        "turn_continuations": f"select conv_id, turn, coalesce(lag(role) over (partition by conv_id order by turn) = role, false) as is_continuation from {first('turns', 'turn_id')}",
        "latest_by_role": f"select conv_id, coalesce(arg_max(coalesce(content, ''), turn) filter (role = 'user'), '') as latest_user, coalesce(arg_max(coalesce(content, ''), turn) filter (role = 'agent'), '') as latest_agent from {first('turns', 'turn_id')} group by 1",
        "risk_actions": f"{_risk()} select action_id, score, level, reason from l",
        "risk_batches": _risk() + _BATCH,
        "action_apply": _apply(),
        "status_counts": f"select source, status, count(*) as n from {first('file_actions', 'action_id')} group by all",
        "written_lengths": _written(),
        "line_diffs": _diff_text(),
        "diff_bounds": f"{_DIFF} select action_id, old_lines, new_lines, prefix, suffix, removed, added from e",
        "write_progress": f"select action_id, i - 1 as step, least(95, round(i / n * 95))::bigint as percent, case when t = '' then 0 else floor(length(t) * i / n)::bigint end as written from (select action_id, t, n, unnest(range(1, n + 1)) as i from (select action_id, coalesce(updated_content, '') as t, case when coalesce(updated_content, '') = '' then 1 else {chunks.replace('length(t)', 'length(coalesce(updated_content, ' + _q('') + '))')} end as n from {first('file_actions', 'action_id')}))",
        "path_parts": f"select action_id, {name('target_file')} as name, {suffix('target_file')} as suffix, {parent('target_file')} as parent, case when len({short}) <= 2 then target_file else array_to_string({short}[-2:], '/') end as short, {documents_path('target_file')} as documents, (regexp_matches(lower({slashed('target_file')}), '\\.(md|txt|rst)$') or contains(lower({slashed('target_file')}), '/docs/') or ends_with(lower({slashed('target_file')}), 'readme.md')) as documents_file from {first('file_actions', 'action_id')}",
        "first_targets": f"select action_id from {first('file_actions', 'action_id')} qualify row_number() over (partition by workspace_root, lower({slashed('target_file')}) order by action_id) = 1",
        "targets_on_disk": f"select action_id, coalesce(exists (select 1 from file_snapshots s where s.workspace_root = a.workspace_root and {slashed('s.relative_path')} = {slashed('a.target_file')}), false) as on_disk from {first('file_actions', 'action_id')} a",
        "tagged_blocks": f"select doc_id, ordinal, {kinds} as kind, target_file, summary, n_chars from (select doc_id, ordinal, replace(lower({strip(tag('b', 'kind'))}), '-', '_') as k, {tag('b', 'target_file')} as target_file, {tag('b', 'summary')} as summary, length({tag('b', 'updated_content')}) as n_chars from (select doc_id, unnest(m) as b, generate_subscripts(m, 1) - 1 as ordinal from (select doc_id, regexp_extract_all(coalesce(text, ''), '(?is)<action>\\s*(.*?)\\s*</action>', 1) as m from documents)))",
        "largest_blocks": f"select doc_id, coalesce({edge('m[list_position(list_transform(m, lambda x: length(x)), list_max(list_transform(m, lambda x: length(x))))]')}, '') as block from (select doc_id, regexp_extract_all(text, '{fence}', 1) as m from documents where text is not null)",
        "answers_without_thoughts": f"select response_id, case when {think} = '' then {strip('content')} else {think} end as answer from {first('gen_responses', 'response_id')} where content is not null",
        "stream_events": f"{_EVENTS} select doc_id, line_no, type, chunk, seq from e",
        "stream_deltas": f"{_EVENTS} select doc_id, step, chunk as delta from (select doc_id, row_number() over (partition by doc_id order by line_no) - 1 as step, chunk from e where type = 'message_chunk') where coalesce(chunk, '') <> ''",
        "interface_state": f"{_EVENTS}, r as (select doc_id, max(line_no) filter (type = 'result') as reset, count(*) filter (type = 'result') as n_messages, coalesce(arg_max(chunk, line_no) filter (type = 'status'), '') as status, arg_max(chunk, line_no) filter (type = 'patch') as proposal from e group by 1), b as (select e.doc_id, string_agg(coalesce(chunk, ''), '' order by line_no) as buffer from e join r on e.doc_id = r.doc_id where type = 'message_chunk' and (reset is null or line_no > reset) group by 1) select r.doc_id, n_messages, status, proposal, coalesce(buffer, '') as buffer from r left join b on r.doc_id = b.doc_id",
        "text_reports": f"select snapshot_id, case when full_content = '' then 0 else {n_lines} end as n_lines, (contains(full_content, 'TODO') or contains(full_content, 'FIXME')) as unfinished, case when full_content = '' then 0 else {n_lines} end > {fixed.LONG_FILE_LINES} as long from {first('file_snapshots', 'snapshot_id')} where full_content is not null and lower(suffix) <> '.py'",
        "profile_settings": f"select profile_name, {setting('provider', 'ollama')}, {setting('runtime_model', 'none')}, {setting('fallback_model', 'none')}, {', '.join(setting(c, '') for c in ('base_model', 'description', 'adapter_path', 'modelfile_path'))}, {setting('train_data_dir', 'data/lora/train')}, {setting('eval_data_dir', 'data/lora/eval')} from model_profiles",
        "mark_levels": f"select case when average >= 90 then 'A' when average >= 80 then 'B' when average >= 70 then 'C' else 'D' end as level, count(*) as n, round(avg(average), 4) as average from ({_MARKS}) m group by 1",
        "class_average": f"select round(avg(average), 4) as class_average from ({_MARKS})",
        "find_first": "select event_id, event_type, value from events where event_type = 'error' order by event_id limit 1",
        "newest_orders": "select c_custkey, o.o_orderkey, o.o_orderstatus as status from customer c left join (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) o on c.c_custkey = o.o_custkey",
    }
