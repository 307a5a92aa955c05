"""SQL for those ``pN_`` queries that SQL can express; the others have tests against brute force."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    limits = "(select field_name, min(max_chars) as max_chars from split_limits where field_name in ('full_content', 'excerpt') group by field_name)"
    values = "(select snapshot_id, 'full_content' as field_name, full_content as value from file_snapshots union all select snapshot_id, 'excerpt', excerpt from file_snapshots)"
    return {"p2_found": f"select distinct snapshot_id, v.field_name from {values} v join {limits} l on v.field_name = l.field_name where max_chars > 0 and length(value) > max_chars"}
