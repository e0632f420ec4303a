"""Queries on snapshots and nested records (problems 1 and 2)."""

from __future__ import annotations

from tidewatch.operators import nested_tables, snapshot_diff
from tidewatch.session import table


def p1_found(spark, sf):
    return snapshot_diff.found(table(spark, sf, "scans"), table(spark, sf, "findings"))


def p1_change_summary(spark, sf):
    return snapshot_diff.change_summary(table(spark, sf, "scans"), table(spark, sf, "findings"))


def p2_found(spark, sf):
    return nested_tables.found(table(spark, sf, "osv_results"))


def p2_affected_events(spark, sf):
    return nested_tables.affected_events(table(spark, sf, "osv_results"))


_P1 = r"""
WITH last AS (
  SELECT scan_id, arg_max(struct_pack(st := status, ta := target, br := branch, cr := created_at),
                          struct_pack(u := updated_at, s := status)) AS x
  FROM scans WHERE scan_id IS NOT NULL GROUP BY scan_id),
done AS (SELECT scan_id, x.ta AS target, x.br AS branch, x.cr AS created_at FROM last WHERE lower(trim(x.st)) = 'completed'),
ordered AS (SELECT *, lag(scan_id) OVER (PARTITION BY target, branch ORDER BY created_at, scan_id) AS prev_scan_id FROM done),
pairs AS (SELECT * FROM ordered WHERE prev_scan_id IS NOT NULL),
f AS (
  SELECT scan_id, db_id, trim(rule_id) AS rule_id,
         regexp_replace(regexp_replace(replace(trim(file_path), chr(92), '/'), '/(\.?/)+', '/', 'g'), '^(\./)*/?', '') AS file_path,
         coalesce(try_cast(regexp_extract(line_number, '^\s*(\d+)', 1) AS INT), 0) AS start_line,
         concat_ws('|', coalesce(lower(trim(severity)), ''),
                   CASE WHEN coalesce(lower(trim(status)), '') = 'open' THEN '' ELSE coalesce(lower(trim(status)), '') END,
                   coalesce(lower(trim(ai_validated)), ''), coalesce(lower(trim(remediation)), '')) AS content
  FROM findings WHERE lower(trim(phase)) = 'final'),
one AS (SELECT scan_id, rule_id, file_path, start_line, arg_max(content, db_id) AS content
        FROM f WHERE rule_id <> '' AND file_path <> '' GROUP BY ALL),
cur AS (SELECT p.prev_scan_id, p.scan_id, o.rule_id, o.file_path, o.start_line, o.content FROM one o JOIN pairs p ON o.scan_id = p.scan_id),
prev AS (SELECT p.prev_scan_id, p.scan_id, o.rule_id, o.file_path, o.start_line, o.content FROM one o JOIN pairs p ON o.scan_id = p.prev_scan_id),
changes AS (
SELECT coalesce(c.prev_scan_id, p.prev_scan_id) AS prev_scan_id, coalesce(c.scan_id, p.scan_id) AS scan_id,
       coalesce(c.rule_id, p.rule_id) AS rule_id, coalesce(c.file_path, p.file_path) AS file_path,
       coalesce(c.start_line, p.start_line) AS start_line,
       CASE WHEN p.scan_id IS NULL THEN 'new' WHEN c.scan_id IS NULL THEN 'fixed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN prev p ON c.scan_id = p.scan_id AND c.rule_id = p.rule_id AND c.file_path = p.file_path AND c.start_line = p.start_line
WHERE c.content IS DISTINCT FROM p.content)
"""

QUERIES = {"p1_found": p1_found, "p1_change_summary": p1_change_summary, "p2_found": p2_found, "p2_affected_events": p2_affected_events}
ORACLE = {
    "p1_found": _P1 + "SELECT * FROM changes",
    "p1_change_summary": _P1
    + """SELECT p.target, p.branch, p.prev_scan_id, p.scan_id,
       count(*) FILTER (change_kind = 'new') AS new_findings, count(*) FILTER (change_kind = 'fixed') AS fixed_findings,
       count(*) FILTER (change_kind = 'changed') AS changed_findings
FROM pairs p LEFT JOIN changes c ON c.scan_id = p.scan_id GROUP BY ALL""",
}
