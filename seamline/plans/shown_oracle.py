"""SQL that gives the same rows as the queries of ``shown.py`` and the new ones of ``queries.py`` (DuckDB dialect)."""

from __future__ import annotations

from ..functions import context as CX
from ..functions import fixed
from . import oracle as O
from .oracle import _any, _list, _q, canonical, first, holds, name, or_empty, parent, slashed, strip, suffix
from .queries import ASKING
from .shown import CUSTOM_MODEL, PRESETS


def _one(table: str, key: str, columns: str = "*") -> str:
    return f"(select {columns} from {table} qualify row_number() over (partition by {key} order by ingested_at) = 1)"


def _norm(x: str) -> str:
    """A path without empty parts and dots; these tables have no '..' in paths that are shown."""
    return f"(case when starts_with({slashed(x)}, '/') then '/' else '' end || array_to_string(list_filter(string_split({slashed(x)}, '/'), lambda s: s not in ('', '.')), '/'))"


def _below(path: str, root: str) -> str:
    r = f"(regexp_replace({slashed(root)}, '/+$', '') || '/')"
    return f"case when starts_with({slashed(path)}, {r}) then substring({slashed(path)}, length({r}) + 1) else {path} end"


_CTES, _CHOSEN = O._TOP.split("\nselect ", 1)
_TOP = f"{O._search()}{_CTES}, top as (select {_CHOSEN.strip()}), named as (select top.*, f.relative_path from top join f using (file_id))"
_MAX = max(fixed.SEARCH_FILES, fixed.SEARCH_FILES_IN_PROJECT)


def _search_contents() -> str:
    m, c = fixed.EXCERPT_CHARS, strip("full_content")
    cut = f"case when length({c}) <= {m} then {c} else substring({c}, 1, {m}) || chr(10) || {_q(fixed.EXCERPT_MARK[1:])} end"
    usual = _list(fixed.FALLBACK_FILES)
    return f"""{_TOP}, lone as (select request_id, workspace_root from r where request_id not in (select request_id from top)),
fb as (select request_id, s.snapshot_id as file_id, {fixed.FALLBACK_SCORE} as score, row_number() over (partition by request_id order by list_position({usual}, {slashed('relative_path')}), s.snapshot_id) as rank
  from lone join {first('file_snapshots', 'snapshot_id')} s on lone.workspace_root = s.workspace_root where list_contains({usual}, {slashed('relative_path')})),
a as (select request_id, file_id, score, rank from top union all select request_id, file_id, score, rank from fb)
select request_id, file_id, rank, a.score, case when length(full_content) <= {fixed.FULL_CONTENT_CHARS} then 'full' else 'excerpt' end as mode, md5({cut}) as digest
from a join {first('file_snapshots', 'snapshot_id')} s on s.snapshot_id = a.file_id where full_content <> ''"""


def _ranked() -> str:
    """CTEs up to ``m``: the ranked candidates of each request with keywords and reason."""
    return f"""{_TOP}, sn as (select snapshot_id, excerpt from {first('file_snapshots', 'snapshot_id')}),
dx as (select request_id, file_id, relative_path as path, reason, concat_ws(chr(10), nullif(relative_path, ''), nullif(reason, ''), nullif(excerpt, '')) as text from named join sn on sn.snapshot_id = named.file_id),
qx as (select request_id, concat_ws(chr(10), nullif(prompt, ''), nullif(selected_text, '')) as text, {holds('prompt', fixed.DOCUMENTATION_WORDS)} as wanted from {first('gen_requests', 'request_id')} where request_id % {ASKING} = 0),
dc as ({O.counts('dx', 'request_id, file_id')}), df as (select request_id, term, count(*) as df from dc group by all), nd as (select request_id, count(*) as n_docs from dx group by all),
dw as (select dc.request_id, file_id, dc.term, {O._WEIGHT} as w from dc join df on dc.request_id = df.request_id and dc.term = df.term join nd on nd.request_id = dc.request_id),
qc as ({O.counts('qx', 'request_id')}),
qw as (select qc.request_id, qc.term, first, {O._WEIGHT} as w from qc left join df on qc.request_id = df.request_id and qc.term = df.term join nd on nd.request_id = qc.request_id),
pr as (select dw.request_id, file_id, dw.term, dw.w * qw.w as p from dw join qw on dw.request_id = qw.request_id and dw.term = qw.term),
dn as (select request_id, file_id, sqrt(sum(w * w)) as n from dw group by 1, 2), qn as (select request_id, sqrt(sum(w * w)) as n from qw group by 1),
dt as (select request_id, file_id, sum(p) as dot, list_transform(list_sort(list({{'o': -round(p, 9), 't': term}})), lambda x: x.t)[1:{fixed.MATCH_KEYWORDS}] as keywords from pr group by 1, 2),
sc as (select dt.request_id, dt.file_id, path, reason, keywords, round(dot / (dn.n * qn.n) * case when not wanted and ends_with(lower(path), '.md') then {fixed.MARKDOWN_PENALTY} else 1.0 end, 6) as score
  from dt join dn on dt.request_id = dn.request_id and dt.file_id = dn.file_id join qn on qn.request_id = dt.request_id join qx on qx.request_id = dt.request_id join dx on dx.request_id = dt.request_id and dx.file_id = dt.file_id),
m as (select request_id, file_id, path, score, keywords, case when len(keywords) > 0 then {_q(fixed.REASON_WITH_KEYWORDS)} || array_to_string(keywords, {_q(fixed.KEYWORD_SEPARATOR)}) else {_q(fixed.REASON_WITHOUT)} end || {_q(fixed.LABEL_SEPARATOR)} || reason as reason,
  row_number() over (partition by request_id order by score desc, path, request_id::varchar || ':' || file_id::varchar) as rank from sc where score > 0 qualify rank <= {fixed.SEMANTIC_MATCHES})"""


def _ranking_texts() -> str:
    head = f"case when len(terms) > 0 then {_q(fixed.QUERY_HEAD)} || chr(10) || '  - ' || array_to_string(terms, ', ') || chr(10) else '' end"
    return f"""{_ranked()}, tm as (select request_id, list(term order by rank) as terms from (select request_id, term, row_number() over (partition by request_id order by round(w, 6) desc, first) as rank from qw) where rank <= {fixed.QUERY_TERMS} group by 1),
g as (select request_id, string_agg('  - ' || path || ' (score=' || printf('%.3f', score) || '): ' || reason, chr(10) order by rank) as lines, string_agg(path, {_q(fixed.KEYWORD_SEPARATOR)} order by rank) filter (rank <= {fixed.SUMMARY_FILES}) as files from m group by 1)
select qx.request_id, case when lines is null then {_q(fixed.NO_RANKING)} else {head} || {_q(fixed.MATCH_HEAD)} || chr(10) || lines end as prompt_text, case when lines is null then '' else {_q(fixed.RANKING_SUMMARY)} || files end as summary
from qx left join g using (request_id) left join tm using (request_id)"""


_OPENED = f"""(select a.*, g.active_file from {first('file_actions', 'action_id')} a left join {first('gen_responses', 'response_id')} r on a.response_id = r.response_id left join {first('gen_requests', 'request_id')} g on r.request_id = g.request_id)"""


def _rules() -> str:
    """CTEs up to ``j``: actions with their resolved path and what the newest scan holds of it."""
    root = f"regexp_replace({slashed('workspace_root')}, '/+$', '')"
    whole = f"case when starts_with({slashed('target_file')}, '/') then {slashed('target_file')} else {root} || '/' || {slashed('target_file')} end"
    return f"""
with newest as (select workspace_root, relative_path, arg_max_null(full_content, snapshot_id) as full_content from file_snapshots where workspace_root is not null and relative_path is not null group by 1, 2),
a as (select *, {_norm('(' + whole + ')')} as w, {root} || '/' as rt from {first('file_actions', 'action_id')}),
b as (select *, case when {strip(or_empty('target_file'))} <> '' and starts_with(w, rt) then w end as resolved from a),
j as (select b.*, n.relative_path is not null as on_disk, coalesce(n.full_content, '') as current, substring(resolved, length(rt) + 1) as rel from b left join newest n on b.workspace_root = n.workspace_root and substring(resolved, length(rt) + 1) = {slashed('n.relative_path')})
"""


def _action_rules() -> str:
    body = strip(or_empty("updated_content"))
    same = f"({canonical('updated_content')} = {canonical('current')})"
    low = f"lower(ltrim({body}))"
    source = "(" + " or ".join([f"starts_with({body}, {_q(x)})" for x in fixed.SOURCE_STARTS] + [f"contains({low}, {_q(x)})" for x in fixed.SOURCE_FENCES]) + ")"
    docs = f"(regexp_matches(lower(resolved), '\\.(md|txt|rst)$') or contains(lower(resolved), '/docs/') or ends_with(lower(resolved), 'readme.md'))"
    return f"""{_rules()} select action_id, on_disk, case when resolved is null then 'outside_root' when {body} = '' then 'no_content' when kind = 'create_file' and on_disk then 'exists'
 when kind = 'update_file' and not on_disk then 'missing' when kind = 'update_file' and {same} then 'unchanged' when kind = 'update_documentation' and not {docs} then 'not_documentation'
 when kind = 'update_documentation' and {source} then 'looks_like_source' when kind = 'update_documentation' and {same} then 'unchanged' when kind is null or kind not in ('create_file', 'update_file', 'update_documentation') then 'unknown_kind' end as error from j"""


def _apply() -> str:
    """A recursive fold over the actions of one path in one response."""
    folder = f"exists (select 1 from newest n where n.workspace_root = j.workspace_root and {parent(slashed('n.relative_path'))} = coalesce(j.rel, chr(10) || j.target_file, chr(10)))"
    return f"""{_rules().replace('with newest', 'with recursive newest', 1)},
k as (select response_id, action_id, kind, {canonical('original_content')} as old, {canonical('updated_content')} as new, resolved is not null as allowed, {folder} as is_folder, coalesce(rel, chr(10) || target_file, chr(10)) as path, case when on_disk then {canonical('current')} end as disk,
  row_number() over (partition by response_id, coalesce(rel, chr(10) || target_file, chr(10)) order by action_id) as i from j where kind in ('create_file', 'update_file', 'update_documentation')),
s as (select response_id, path, 0::bigint as i, max(disk) as held, 0::bigint as action_id, '' as outcome from k group by 1, 2
 union all select response_id, path, i, case when outcome = 'applied' then new else held end, action_id, outcome from (
  select k.response_id, k.path, k.i, k.new, s.held, k.action_id, case when not allowed then 'skipped' when is_folder then 'failed' when kind = 'create_file' then case when held is not null then 'skipped' else 'applied' end
   when held is null then case when kind = 'update_file' then 'skipped' else 'applied' end when held <> old or held = new then 'skipped' else 'applied' end as outcome
  from s join k on k.i = s.i + 1 and k.path = s.path and k.response_id is not distinct from s.response_id))
select action_id, outcome from s where i > 0"""


def _planned() -> str:
    has = lambda w: holds("prompt", w)
    docs = lambda x: O.documents_path(x)
    return f"""{_TOP}, base as (select request_id, workspace_root, prompt, {has(fixed.PROJECT_SCOPE_WORDS)} as ps, {has(fixed.DOCUMENTATION_WORDS)} as wd, {has(fixed.CODE_CHANGE_WORDS)} as wc, {has(fixed.CREATION_WORDS)} as wn, {has(fixed.OPTIONAL_DOCUMENTATION_WORDS)} as dopt,
  {_below('active_file', 'workspace_root')} as active_rel, {slashed('active_file')} as active_abs from {first('gen_requests', 'request_id')} where request_id % {ASKING} = 0),
cand as (select request_id, {slashed('relative_path')} as c_path, rank as c_rank from named),
ex as (select distinct workspace_root as e_root, {slashed('relative_path')} as e_path from file_snapshots),
raw as (select request_id, unnest(m) as raw, generate_subscripts(m, 1) - 1 as ordinal from (select request_id, regexp_extract_all(coalesce(prompt, ''), '{fixed.EXPLICIT_PATH}') as m from base)),
ep as (select request_id, ordinal, replace(trim(raw, {_q(fixed.PATH_TRIM)}), '\\', '/') as path from raw),
ep1 as (select * from ep where path <> '' qualify row_number() over (partition by request_id, lower(path) order by ordinal) = 1),
byp as (select request_id, lower(c_path) as k, arg_max(c_path, c_rank) as p from cand group by 1, 2), byn as (select request_id, lower({name('c_path')}) as k, arg_max(c_path, c_rank) as p from cand group by 1, 2),
e2 as (select ep1.request_id, ordinal, coalesce(byp.p, byn.p, path) as target_file from ep1 left join byp on byp.request_id = ep1.request_id and byp.k = lower(path) left join byn on byn.request_id = ep1.request_id and byn.k = lower({name('path')})),
s1 as (select e2.request_id, 1 as stage, ordinal, case when {docs('target_file')} then 'update_documentation' when ex.e_path is not null then 'update_file' when wn then 'create_file' end as kind, target_file from e2 join base using (request_id) left join ex on ex.e_root = workspace_root and ex.e_path = target_file),
s2 as (select request_id, 2 as stage, 0 as ordinal, 'update_file' as kind, active_rel as target_file from base where (not wd or wc) and not ps and coalesce(active_rel <> '' and active_rel <> active_abs, false)),
fd as (select request_id, arg_min(c_path, c_rank) as p from cand where {docs('c_path')} group by 1),
s3 as (select base.request_id, 3 as stage, 0 as ordinal, 'update_documentation' as kind, case when exists (select 1 from ex where e_root = workspace_root and e_path = 'README.md') then 'README.md' when fd.p is not null then fd.p
  when exists (select 1 from ex where e_root = workspace_root and e_path = 'docs/README.md') then 'docs/README.md' end as target_file from base left join fd on fd.request_id = base.request_id where wd and not dopt),
u as (select * from s1 where kind is not null union all select * from s2 union all select * from s3 where target_file is not null),
early as (select * from u qualify row_number() over (partition by request_id, lower({slashed('target_file')}) order by stage, ordinal) = 1),
seed as (select request_id, {parent('target_file')} as dir_, count(*) as taken from early group by 1, 2),
code as (select request_id, c_path, c_rank, {parent('c_path')} as dir_, row_number() over (partition by request_id, {parent('c_path')} order by c_rank) - 1 as before_ from cand where not {docs('c_path')}),
s4 as (select code.request_id, 4 as stage, c_rank as ordinal, 'update_file' as kind, c_path as target_file from code left join seed on seed.request_id = code.request_id and seed.dir_ = code.dir_ where code.dir_ = '' or coalesce(taken, 0) + before_ < {fixed.PLANNED_PER_DIRECTORY}),
al as (select * from (select * from early union all select * from s4) qualify row_number() over (partition by request_id, lower({slashed('target_file')}) order by stage, ordinal) = 1),
pl as (select *, row_number() over (partition by request_id order by stage, ordinal) as place from al)
select pl.request_id, place, kind, target_file, stage from pl join base using (request_id) where place <= case when ps then {fixed.PLANNED_IN_PROJECT} else {fixed.PLANNED} end"""


def _contexts() -> str:
    fields = ("workspace_root", "active_file", "language_id", "selected_text")
    live = ", ".join([f"coalesce({f}, lag({f}) over w) as {f}" for f in fields] + ["coalesce(nullif(system_prompt, ''), lag(system_prompt) over w, '') as system_prompt"])
    return f"select request_id, {live} from {first('gen_requests', 'request_id')} window w as (partition by conv_id order by request_id)"


def _file_reports() -> str:
    t, m, c = "coalesce(full_content, '')", fixed.REPORT_EXCERPT_CHARS, strip("coalesce(full_content, '')")
    ends = "[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
    n = f"case when {t} = '' then 0 else len(regexp_split_to_array({t}, '\\r\\n|{ends}')) - case when regexp_matches({t}, '{ends}\\z') then 1 else 0 end end"
    hints = f"case when {t} = '' then [{_q(fixed.NO_CONTENT_HINT)}] else list_filter([case when contains({t}, 'TODO') or contains({t}, 'FIXME') then {_q(fixed.UNFINISHED_HINT)} end, case when n > {fixed.LONG_FILE_LINES} then {_q(fixed.LONG_FILE_HINT)} end], lambda x: x is not null) end"
    listed = lambda title, x: f"case when len({x}) > 0 then '- {title}:' || chr(10) || array_to_string(list_transform({x}, lambda p: '  - ' || p), chr(10)) else '- {title}: none' end"
    excerpt = f"case when {t} = '' then null else '- Tool excerpt:' || chr(10) || case when length({c}) <= {m} then {c} else substring({c}, 1, {m}) || chr(10) || {_q(fixed.REPORT_EXCERPT_MARK[1:])} end end"
    return f"""select snapshot_id, concat_ws(chr(10), '- File path: ' || coalesce(nullif(absolute_path, ''), '(none)'), '- Language id: (unknown)', '- Source chosen by tool: ' || case when {t} = '' then {_q(fixed.SOURCE_LABELS['none'])} else {_q(fixed.SOURCE_LABELS['disk'])} end,
 '- Line count: ' || n, '- Character count: ' || length({t}), {listed('Structural observations', f"(case when {t} = '' then []::varchar[] else [{_q(fixed.GENERIC_POINT)}] end)")}, {listed('Potential risks or refactor hints', '(' + hints + ')')},
 case when {strip('coalesce(full_content, ' + _q('') + ')')} = '' then null else {excerpt} end) as report from (select *, {n} as n from {first('file_snapshots', 'snapshot_id')} where coalesce(lower(suffix), '') <> '.py')"""


def _proposals() -> str:
    r, lab, n = fixed.OVERALL_REASONS, fixed.PROPOSAL_LABELS, fixed.RISK_NAMES
    parts = f"list_filter([case when actions > 1 then {_q(r['many'][0])} || actions || {_q(r['many'][1])} end, case when folders > 1 then {_q(r['wide'])} end, case when any_high then {_q(r['high'])} end, case when any_signature then {_q(r['signature'])} end], lambda x: x is not null)"
    why = f"case when len({parts}) = 0 then {_q(r['none'])} else array_to_string(({parts})[1:{fixed.OVERALL_PARTS}], {_q(fixed.OVERALL_SEPARATOR)}) end"
    risk = O._risk() + O._BATCH.replace("\nselect response_id", ", bt as (select response_id", 1).rstrip() + ")"
    return f"""{risk}, ln as (select response_id, string_agg({name('target_file')} || '：' || coalesce(summary, ''), {_q(fixed.LABEL_SEPARATOR)} order by action_id) as lines from (select * from {first('file_actions', 'action_id')} qualify row_number() over (partition by response_id order by action_id) <= 3) group by 1)
select bt.response_id, {_q(lab['planned'])} || actions || {_q(lab['planned_end'] + fixed.LABEL_SEPARATOR + lab['overall'])} || case level when 'high' then {_q(n['high'])} when 'medium' then {_q(n['medium'])} else {_q(n['low'])} end || '（' || {why} || '）' || {_q(fixed.LABEL_SEPARATOR)} || lines as proposal from bt join ln using (response_id)"""


def _events(inner: str) -> str:
    s, st = fixed.STREAM_STATUS, CX.MOODS
    n = f"greatest({fixed.FEWEST_CHUNKS}, least({fixed.MOST_CHUNKS}, ceil(length(t) / {fixed.CHUNK_CHARS})::int))"
    return f"""
with a as (select response_id, case response_id % 3 when 0 then 'edit' when 1 then 'workspace' else 'chat' end as route, coalesce(content, '') as t, case mood when 'thinking' then {_q(st['thinking'])} when 'helpful' then {_q(st['helpful'])} else 'idle' end as status from {first('gen_responses', 'response_id')}),
b as (select *, case when t = '' then [] else list_transform(range(1, {n} + 1), lambda i: substring(t, 1, floor(length(t) * i / {n})::int)) end as p from a),
c as (select response_id, list_concat([{{'type': 'status', 'text': case route when 'edit' then {_q(s['edit'])} when 'workspace' then {_q(s['workspace'])} else {_q(s['chat'])} end}}],
  case route when 'edit' then list_transform(p, lambda x: {{'type': 'patch', 'text': x}}) when 'chat' then list_transform(p, lambda x, i: {{'type': 'message_chunk', 'text': substring(x, length(coalesce(p[i - 1], '')) + 1)}}) else [] end,
  case when route = 'workspace' then [] else [{{'type': 'status', 'text': status}}] end, [{{'type': 'result', 'text': t}}]) as e from b),
x as (select response_id, unnest(e) as e, generate_subscripts(e, 1) - 1 as seq from c)
{inner}"""


def _students() -> str:
    return """(select l_orderkey, l_linenumber, '#' || l_linenumber as name, floor(l_quantity * 2)::int as math, (l_partkey % 101)::int as english, (l_suppkey % 101)::int as python from lineitem
 union all select -1, k, n, a, b, c from (values (0, 'a', 91, 87, 94), (1, 'b', 78, 83, 80), (2, 'c', 95, 88, 93), (3, 'd', 76, 81, 70), (4, 'e', 66, 72, 79)) v(k, n, a, b, c))"""


def _reports() -> str:
    k = fixed.STUDENT_LABELS
    avg = "((math + english + python) / 3)"
    grade = f"case when {avg} >= 90 then 'A' when {avg} >= 80 then 'B' when {avg} >= 70 then 'C' else 'D' end"
    line = f"'[' || {_q(k[0])} || name || ' | ' || {_q(k[1])} || math || ' | ' || {_q(k[2])} || english || ' | ' || {_q(k[3])} || python || ' | ' || {_q(k[4])} || printf('%.2f', {avg}) || ' | ' || {_q(k[5])} || {grade} || ']'"
    return f"select l_orderkey, {_q(fixed.REPORT_TITLE)} || chr(10) || {_q(fixed.REPORT_RULE)} || chr(10) || string_agg({line}, chr(10) order by l_linenumber, {line}) || chr(10) || {_q(fixed.REPORT_RULE)} || chr(10) || {_q(fixed.REPORT_AVERAGE)} || printf('%.2f', sum(math + english + python) / (count(*) * 3)) as report from {_students()} group by 1"


def _presets() -> str:
    rows = ", ".join(f"({o}, {_q(i)}, {_q(lab)}, {_q(a)}, {_q(m)})" for o, i, lab, a, m in PRESETS)
    return f"(select * from (values {rows}) p(ordinal, id, label, avatar, model) where id <> '' and label <> '')"


def _snapshots() -> str:
    """Debounced lengths by a recursive walk over the growing, cleaned contents of each stream."""
    t = "coalesce(updated, '')"
    clean = f"regexp_replace(regexp_replace({t}, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*\\z', '', 'g')"
    clean = f"regexp_replace({clean}, '(?is)<summary>.*?</summary>\\s*', '', 'g')"
    for pattern in (r"(?i)\A\s*<(?:updated_content|updated_file)>\s*", r"(?i)\s*</(?:updated_content|updated_file)>\s*\z", r"\A\s*```[^\n]*\n", r"\n```?\s*\z"):
        clean = f"regexp_replace({clean}, '{pattern}', '')"
    f = fixed
    return f"""with recursive{O._EVENTS.replace('with l as', ' l as', 1)},
w as (select doc_id, row_number() over (partition by doc_id order by line_no) as i, string_agg(coalesce(chunk, ''), '' order by line_no) over (partition by doc_id order by line_no rows unbounded preceding) as updated from e where type in ('message_chunk', 'patch')),
c as (select doc_id, i, length(x) as n, ends_with(x, chr(10)) as nl from (select doc_id, i, {strip(clean)} as x from w)),
s as (select doc_id, 0::bigint as i, 0::bigint as sent, false as due, 0::bigint as n from (select distinct doc_id from c)
 union all select c.doc_id, c.i, case when d then c.n else s.sent end, d, c.n from (select s.doc_id, s.i, s.sent, case when s.sent = 0 then c.n >= {f.FIRST_SNAPSHOT} else c.n - s.sent >= {f.NEXT_SNAPSHOT} or (c.nl and c.n - s.sent >= {f.LINE_SNAPSHOT}) end as d from s join c on c.doc_id = s.doc_id and c.i = s.i + 1) s join c on c.doc_id = s.doc_id and c.i = s.i + 1),
o as (select doc_id, i, n from s where due union all select doc_id, i + 1, n from (select doc_id, i, n, sent from s qualify row_number() over (partition by doc_id order by i desc) = 1) where n > 0 and n <> sent)
select doc_id, row_number() over (partition by doc_id order by i) - 1 as ordinal, n as length from o"""


def oracle_sql() -> dict[str, str]:
    act = first("file_actions", "action_id")
    falls = f"(coalesce(active_file, '') <> '' and coalesce(full_document_text, '') <> '' and not {holds('prompt', fixed.MULTI_FILE_WORDS)})"
    named = f"(select request_id, count(*) as named from (select request_id, lower(replace(trim(raw, {_q(fixed.PATH_TRIM)}), '\\', '/')) as p from (select request_id, unnest(regexp_extract_all(coalesce(prompt, ''), '{fixed.EXPLICIT_PATH}')) as raw from {first('gen_requests', 'request_id')}) group by 1, 2 having p <> '') group by 1)"
    least = f"case when not {holds('prompt', fixed.PROJECT_SCOPE_WORDS)} then 1 when coalesce(named, 0) <= 0 then 2 else greatest(2, least(4, named)) end"
    src = "case when coalesce(full_document_text, '') <> '' then {0} when coalesce(document_text, '') <> '' then {1} when coalesce(disk, '') <> '' then {2} else {3} end"
    text = src.format("full_document_text", "document_text", "disk", "''")
    lab = fixed.SOURCE_LABELS
    label = src.format(*(_q(lab[k]) for k in ("full", "excerpt", "disk", "none")))
    cut = f"case when length(t) <= {fixed.REPORT_EXCERPT_CHARS} then t else substring(t, 1, {fixed.REPORT_EXCERPT_CHARS}) || chr(10) || {_q(fixed.REPORT_EXCERPT_MARK[1:])} end"
    whole = f"case when starts_with(target_file, '/') then target_file else regexp_replace(coalesce(workspace_root, ''), '/+$', '') || '/' || {slashed('target_file')} end"
    root = f"regexp_replace({_norm(or_empty('workspace_root'))}, '/+$', '')"
    shown = lambda x: f"case when coalesce(workspace_root, '') <> '' and starts_with({_norm(x)}, {root} || '/') and {_norm(x)} <> {root} || '/' then substring({_norm(x)}, length({root}) + 2) else {x} end"
    p, sh, df = fixed.PLANNED_SUMMARIES, fixed.SHORT_SUMMARIES, fixed.DEFAULT_SUMMARIES
    kinds = lambda d, other: f"case when kind = 'create_file' then {_q(d['create_file'])} when kind = 'update_documentation' then {_q(d['update_documentation'])} {other} end"
    below_active = f"case when coalesce(workspace_root, '') <> '' then {_below('active_file', 'workspace_root')} end"
    active = f"coalesce({below_active}, '')"
    planned = kinds(p, f"when {active} <> '' and lower({active}) = lower(target_file) then {_q(p['active'])} else {_q(p['other'])}")
    oh = fixed.OUTCOME_HEADS
    tags, low = fixed.RISK_TAGS, "lower(coalesce(text, ''))"
    n = "line_no"
    ui = f"case when type = 'message_chunk' then 'messageChunk' when type = 'result' then 'message' when type = 'patch' and {n} % 7 = 3 then 'clearProposal' when type = 'patch' then 'proposal' when type = 'status' and {n} % 5 = 2 then 'hydrate' else type end"
    steps = f"case when type = 'patch' then 'patch' when type = 'status' and {n} % 2 = 0 then 'proposal' when type = 'result' and {n} % 3 = 0 then 'apply' when type = 'result' and {n} % 3 = 1 then 'discard' when {n} % 11 = 0 then 'prompt' end"
    status = f"case mood when 'thinking' then {_q(CX.MOODS['thinking'])} when 'helpful' then {_q(CX.MOODS['helpful'])} else 'idle' end || ' ' || substring(coalesce(content, ''), 1, 20)"
    above = f"list_transform(range(1, len(string_split({parent('active_file')}, '/')) + 1), lambda n: array_to_string(string_split({parent('active_file')}, '/')[1:n], '/'))"
    setting = lambda c, d: f"coalesce({c}, {_q(d)}) as {c}"
    return {
        "search_contents": _search_contents(),
        "ranked_candidates": f"{_ranked()} select request_id, file_id, path, score, array_to_string(keywords, ' ') as keywords, reason, rank from m",
        "ranking_texts": _ranking_texts(),
        "related_files": f"{_TOP}, tg as (select request_id, lower({slashed(_below('active_file', 'workspace_root'))}) as p from {first('gen_requests', 'request_id')} where request_id % {ASKING} = 0) select request_id, file_id, row_number() over (partition by request_id order by rank) as place from named where not exists (select 1 from tg where tg.request_id = named.request_id and tg.p = lower({slashed('relative_path')})) qualify place <= {fixed.APPLY_NOTES['related']}",
        "planned_targets": _planned(),
        "fallback_requests": f"select request_id, {_q(fixed.NO_WORKSPACE_PREFIX)} || coalesce(prompt, '') as prompt from {first('gen_requests', 'request_id')} where (coalesce(workspace_root, '') = '' or request_id % 10 = 3) and {falls}",
        "action_quotas": f"select request_id, coalesce(named, 0) as named, {least} as least, (coalesce(named, 0) = 0 or floor(coalesce(named, 0) / 2) = 0 or floor(coalesce(named, 0) / 2) < {least}) as retry from {first('gen_requests', 'request_id')} left join {named} using (request_id)",
        "context_sources": f"select request_id, source, python, length(t) as n_chars, md5({cut}) as digest from (select request_id, {label} as source, (lower(coalesce(language_id, '')) = 'python' or {suffix(or_empty('active_file'))} = '.py') as python, {text} as t from {first('gen_requests', 'request_id')} left join (select absolute_path as d_path, arg_max_null(excerpt, snapshot_id) as disk from file_snapshots where absolute_path is not null group by 1) on active_file = d_path)",
        "merged_contexts": _contexts(),
        "context_texts": f"select snapshot_id, length(nullif(substring(coalesce(full_content, ''), 1, {fixed.CONTEXT_EXCERPT_CHARS}), '')) as excerpt_chars, case when length(coalesce(full_content, '')) between 1 and {fixed.CONTEXT_FULL_CHARS} then length(full_content) end as full_chars from {first('file_snapshots', 'snapshot_id')}",
        "project_roots": f"with h as (select distinct {parent('absolute_path')} as root from (select absolute_path from file_snapshots union all select workspace_root || '/package.json' from file_snapshots union all select workspace_root || '/backend/pyproject.toml' from file_snapshots) where list_contains({_list(CX.ROOT_MARKERS)}, {name('absolute_path')})), a as (select request_id, unnest({above}) as root from {first('gen_requests', 'request_id')} where active_file is not null) select request_id, arg_max(root, length(root)) as root from a join h using (root) group by 1",
        "file_reports": _file_reports(),
        "action_summaries": f"select action_id, {planned} || target_file as planned, {kinds(df, 'else ' + _q(df['other']))} || {name('target_file')} as prepared, {kinds(sh, 'else ' + _q(sh['other']))} as short from {_OPENED}",
        "path_permissions": f"""select action_id, case when {strip(or_empty('w'))} = '' then 'blank' when coalesce({_norm('w')} = {_norm("nullif(active_file, '')")}, false) then 'active_file' when w in (select absolute_path from file_snapshots where reason is not null and score >= 100 and absolute_path is not null) then 'opened'
            when coalesce(workspace_root, '') <> '' and ({_norm('w')} = {root} or starts_with({_norm('w')}, {root} || '/')) then 'inside_root' else 'outside' end as permission, {shown('w')} as shown, coalesce(lower({_norm('w')}) = lower({_norm('active_file')}), false) as is_open from (select *, {whole} as w from {_OPENED})""",
        "outcome_texts": f"select action_id, case status when 'applied' then {_q(oh['applied'])} when 'skipped' then {_q(oh['skipped'])} else {_q(oh['failed'])} end || chr(10) || {_q(fixed.OUTCOME_FILE)} || ({shown('target_file')}) || chr(10) || case when status = 'applied' then {_q(fixed.OUTCOME_NOTE)} else {_q(fixed.OUTCOME_REASON)} end || coalesce(summary, '') as message from {act}",
        "proposal_summaries": _proposals(),
        "decorated_summaries": f"""{O._risk()}, kr as (select f.response_id, lower(f.target_file) as k, arg_max(l.level, l.action_id) as level, arg_max(l.reason, l.action_id) as reason from l join {act} f using (action_id) group by 1, 2),
            d as (select f.action_id, f.summary, kr.level, kr.reason, {strip(or_empty('f.summary'))} as t from {act} f left join kr on kr.response_id is not distinct from f.response_id and kr.k = lower(f.target_file))
            select action_id, case when level is null then summary when regexp_matches(t, '^\\[[低中高]风险\\]') then t else case level when 'low' then {_q(tags['low'])} when 'high' then {_q(tags['high'])} else {_q(tags['medium'])} end || ' ' || t || case when coalesce(reason, '') <> '' then {_q(fixed.LABEL_SEPARATOR)} || reason else '' end end as summary from d""",
        "demo_actions": f"select request_id, 'update_file' as kind, {slashed(_below('active_file', 'workspace_root'))} as target_file, {_q(fixed.DEMO_SUMMARY)} as summary, 'x = 1' || chr(10) as updated_content from {first('gen_requests', 'request_id')} where coalesce(workspace_root, '') <> '' and starts_with({slashed('active_file')}, regexp_replace({slashed('workspace_root')}, '/+$', '') || '/') and {name('active_file')} = 'rank_column.py'",
        "answer_events": _events("select response_id, seq, e.type as type, md5(e.text) as digest, length(e.text) as n_chars from x"),
        "dispatched_events": _events("select response_id, seq, e.type as type, md5(e.text) as digest from x where response_id % 2 = 0 or e.type <> 'message_chunk'"),
        "interface_labels": f"select response_id, case when length(c) % 2 = 0 then 'speaking' when contains(s, '思考') then 'thinking' when {_any('s', ['应用', '写回', '执行'])} then 'acting' else 'idle' end as expression, case when length(c) % 3 = 0 then 'generating' else coalesce(nullif(s, ''), s) end as label, (s <> '' and not {_any('s', fixed.IDLE_WORDS)} and {_any('lower(s)', fixed.BUSY_WORDS)}) as busy from (select response_id, coalesce(content, '') as c, {status} as s from {first('gen_responses', 'response_id')})",
        "missing_models": f"select doc_id, {_any(low, fixed.MISSING_MODEL_WORDS)} as missing from documents",
        "health": f"select 'ok' as status, 'ollama' as provider, profile_name as model_profile, coalesce(nullif(trim(coalesce(runtime_model, 'none')), ''), 'none') as configured_model, 'active-model' as active_model, {setting('base_model', '')}, coalesce(description, '') as profile_description, {setting('adapter_path', '')}, {setting('modelfile_path', '')}, {setting('train_data_dir', 'data/lora/train')}, {setting('eval_data_dir', 'data/lora/eval')} from model_profiles where profile_name in ('lora_chat', 'local_default') order by profile_name = 'lora_chat' desc limit 1",
        "preset_config": f"""select ordinal, id, replace('{{"id":"' || id || '","model":"' || coalesce(nullif(trim(model), ''), '') || '"}}', '<', {_q(fixed.ESCAPED_BRACKET)}) as config from (select -1 as ordinal, {_q(fixed.CUSTOM_PRESET)} as id, {_q(CUSTOM_MODEL)} as model union all select ordinal, id, model from {_presets()})""",
        "preset_roots": f"select min(o) as ordinal, {parent('substring(path, 8)')} as root from (select ordinal * 2 as o, avatar as path from {_presets()} union all select ordinal * 2 + 1, model from {_presets()}) where starts_with(path, 'file://') group by 2",
        "class_reports": _reports(),
        "marks_average": f"select round((sum(math) + sum(case when l_linenumber <> 3 then english end) + sum(python)) / (count(math) + count(case when l_linenumber <> 3 then english end) + count(python)), 6) as marks_average from {_students()} where l_orderkey <> -1",
        "student_marks": "select event_id::varchar as name, case when event_id % 4 <> 0 then coalesce(try_cast(props->>'$.k' as int), 0) else 0 end as math, 0 as english, case when event_id % 3 = 0 then (event_id % 100)::int else 0 end as python from events",
        "action_rules": _action_rules(),
        "action_apply": _apply(),
        "write_progress": f"with t as (select action_id, coalesce(updated_content, '') as t from {act}), n as (select *, case when t = '' then 1 else greatest({fixed.FEWEST_CHUNKS}, least({fixed.MOST_CHUNKS}, ceil(length(t) / {fixed.CHUNK_CHARS})::int)) end as n from t) select action_id, i - 1 as step, case when i > n then 100 else least(95, round(i / n * 95))::bigint end as percent, case when t = '' then 0 else floor(length(t) * least(i, n) / n)::bigint end as written from (select *, unnest(range(1, n + 2)) as i from n)",
        "interface_state": f"{O._EVENTS}, vv as (select doc_id, line_no as seq, {ui} as kind, case when type = 'result' and {n} % 3 = 1 then 'user' else 'agent' end as role, chunk as text from e), r as (select doc_id, max(seq) filter ((kind = 'message' and role = 'agent') or kind = 'hydrate') as reset, count(*) filter (kind = 'message') as n_messages, coalesce(arg_max_null(text, seq) filter (kind in ('status', 'hydrate')), '') as status, arg_max_null(case when kind = 'proposal' then text end, seq) filter (kind in ('proposal', 'clearProposal', 'hydrate')) as proposal from vv group by 1), b as (select vv.doc_id, string_agg(coalesce(text, ''), '' order by seq) as buffer from vv join r using (doc_id) where kind = 'messageChunk' and role = 'agent' and (reset is null or seq > reset) group by 1) select r.doc_id, n_messages, status, proposal, coalesce(buffer, '') as buffer from r left join b using (doc_id)",
        "proposal_states": f"{O._EVENTS}, vv as (select doc_id, line_no as seq, {steps} as kind from e), g as (select doc_id, arg_max(kind, seq) filter (kind in ('patch', 'proposal')) as k, max(seq) filter (kind in ('patch', 'proposal')) as st, max(seq) filter (kind in ('prompt', 'discard')) as cl, max(seq) filter (kind = 'apply') as ap from vv where kind is not null group by 1), o as (select *, (st is not null and not coalesce(cl > st, false) and not (k = 'proposal' and coalesce(ap > st, false))) as open from g) select doc_id, open, (open and k = 'proposal') as appliable from o",
        "stream_snapshots": _snapshots(),
        "parsed_files": _parsed_files(),
    }


def _parsed_files() -> str:
    """Strict tag repair without a look behind: the character before a bare name is kept."""
    t = strip("content")
    fence = "(?s)\\A```[^\\n]*\\n(.*?)\\n```\\z"
    edge = lambda x: f"regexp_replace({x}, '^[\\r\\n]+|[\\r\\n]+$', '', 'g')"
    body = f"case when regexp_matches({t}, '{fence}') then {strip(f'regexp_extract({t}, {_q(fence)}, 1)')} else {t} end"
    for tag in fixed.KNOWN_TAGS:
        body = f"regexp_replace({body}, '(?i)(^|[^<\\w/]){tag}>', '\\1<{tag}>', 'g')"
        body = f"regexp_replace(regexp_replace({body}, '(?i)\\({tag}>', '<{tag}>', 'g'), '(?i)\\({tag}\\s*>', '<{tag}>', 'g')"
    inner = lambda x, k: f"regexp_extract({x}, '(?is)<{k}>\\s*(.*?)\\s*</{k}>', 1)"
    file_body = lambda x: f"case when regexp_matches({edge(x)}, '{fence}') then {edge(f'regexp_extract({edge(x)}, {_q(fence)}, 1)')} else {edge(x)} end"
    blocks = "regexp_extract_all(b, '(?s)```[^\\n]*\\n(.*?)\\n```', 1)"
    largest = edge(f"({blocks})[list_position(list_transform({blocks}, lambda x: length(x)), list_max(list_transform({blocks}, lambda x: length(x))))]")
    rest = strip("regexp_replace(b, '(?is)<summary>.*?</summary>', '', 'g')")
    tagged = file_body(f"coalesce(nullif({inner('b', 'updated_content')}, ''), {inner('b', 'updated_file')})")
    return f"select response_id, {strip(inner('b', 'summary'))} as file_summary, {strip(f'coalesce(nullif({tagged}, {_q(str())}), nullif({largest}, {_q(str())}), {rest})')} as file_content from (select response_id, {body} as b from {first('gen_responses', 'response_id')} where content is not null)"
