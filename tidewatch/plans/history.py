"""Queries on scan history, triage, validations and call graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import findings, graph, history
from tidewatch.operators import rules as r
from tidewatch.plans.analytics import FINDINGS_SQL
from tidewatch.plans.code import LINES_SQL, _files, _lines, _scan_sql
from tidewatch.plans.code import ORACLE as CODE_SQL
from tidewatch.session import table


def _rec(spark, sf):
    return findings.records(table(spark, sf, "findings"))


def scan_history_latest(spark, sf):
    return history.latest_scans(table(spark, sf, "scans"))


def trend_last10(spark, sf):
    return history.trend(table(spark, sf, "scans"))


def triage_latest_status(spark, sf):
    return history.latest_status(table(spark, sf, "finding_reports"))


def scan_diff_keyed(spark, sf):
    return history.diff_keyed(table(spark, sf, "scans"), _rec(spark, sf))


def scan_diff_fingerprint(spark, sf):
    return history.diff_fingerprint(table(spark, sf, "scans"), _rec(spark, sf))


def fp_history_filter(spark, sf):
    return history.fp_filter(_rec(spark, sf))


def accuracy_stats(spark, sf):
    return history.accuracy(_rec(spark, sf), table(spark, sf, "validations"))


def confidence_calibration(spark, sf):
    return history.calibrated(_rec(spark, sf), table(spark, sf, "validations"))


def validation_applied(spark, sf):
    return history.validated(_rec(spark, sf), table(spark, sf, "validations"))


def _places(spark, sf):
    return r.scan(_lines(spark, sf)).select("file_path", "line_no").distinct()


def enclosing_function_asof(spark, sf):
    return graph.functions_at(_files(spark, sf), _places(spark, sf))


def call_graph_edges(spark, sf):
    return graph.edges(graph.marks(_files(spark, sf)))


def reachable_functions(spark, sf):
    return graph.reachable(_files(spark, sf))


def annotate_unreachable(spark, sf):
    """Rule findings after the reachability pass and after files that serve the web took the mark off again."""
    f = _files(spark, sf)
    found = r.findings(f)
    low = graph.annotated(found, graph.unreachable_places(f, found.select("file_path", "line_no").distinct()))
    return findings.web_reachable(low, f).select("file_path", "line_no", "rule_id", "severity", "description", F.round("confidence", 6).alias("confidence"))


def taint_closure(spark, sf):
    return graph.tainted(_files(spark, sf))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LATEST = """l AS (SELECT scan_id, x.*, n_events FROM (SELECT scan_id, arg_max(struct_pack(status := status, target := target, branch := branch, created_at := created_at, completed_at := completed_at,
  total_findings := total_findings, critical_count := critical_count, high_count := high_count), struct_pack(u := updated_at, s := status)) AS x, count(DISTINCT (status, updated_at)) AS n_events FROM scans WHERE scan_id IS NOT NULL GROUP BY 1))"""
_PAIRS = _LATEST + """, done AS (SELECT *, lag(scan_id) OVER (PARTITION BY target, branch ORDER BY created_at, scan_id) AS a FROM l WHERE lower(trim(status)) = 'completed'),
pairs AS (SELECT a, scan_id AS b FROM done WHERE a IS NOT NULL)"""


def _sides(key: str) -> str:
    return f"""k0 AS (SELECT scan_id, {key} AS key FROM f), k AS (SELECT a, b, key, sum(p) AS prev, sum(c) AS cur FROM (
  SELECT a, b, key, 0 AS p, 1 AS c FROM pairs JOIN k0 ON k0.scan_id = b UNION ALL SELECT a, b, key, 1, 0 FROM pairs JOIN k0 ON k0.scan_id = a) GROUP BY ALL)"""


_EXT = r"lower(regexp_extract(file_path, '(\.[^./]+)$', 1))"
_VAL = "v AS (SELECT finding_id, x.* FROM (SELECT finding_id, max(struct_pack(created_at := created_at, validation_id := validation_id, is_true_positive := is_true_positive, v_confidence := confidence, adj := lower(trim(coalesce(severity_adjustment, ''))))) AS x FROM validations WHERE finding_id IS NOT NULL GROUP BY 1))"
_ACC = "acc AS (SELECT severity, count(*) AS assessed, count(*) FILTER (is_true_positive) AS true_positives FROM f JOIN v ON db_id = finding_id WHERE is_true_positive IS NOT NULL GROUP BY 1)"
_DEF = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, {_q(d)}, 1), '')" for d in reversed(graph.DEFINITIONS)) + ")"
_FN = f"""d AS (SELECT *, {_DEF} AS defines FROM lines),
fnl AS (SELECT *, last_value(defines IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fn FROM d)"""
_EDGES = f"""e AS (SELECT DISTINCT fn AS caller, callee FROM (SELECT fn, unnest(regexp_extract_all(line, {_q(graph.CALL)}, 1)) AS callee FROM fnl WHERE fn IS NOT NULL)
  WHERE fn <> callee AND callee NOT IN ({", ".join(map(_q, graph.KEYWORDS))}))"""
_ENTRY = f"""ep AS (SELECT DISTINCT defines AS name FROM (SELECT *, concat(coalesce(lag(line) OVER (PARTITION BY file_path ORDER BY line_no), ''), chr(10), line) AS bl FROM fnl)
  WHERE defines IS NOT NULL AND ({" OR ".join(f"contains(bl, {_q(m)})" for m in graph.ENTRY_MARKERS)}))"""
_REACH = f"WITH RECURSIVE {LINES_SQL}, {_FN}, {_EDGES}, {_ENTRY}, rch AS (SELECT name FROM ep UNION SELECT e.callee FROM rch JOIN e ON e.caller = rch.name)"

QUERIES = {
    f.__name__: f
    for f in (
        scan_history_latest, trend_last10, triage_latest_status, scan_diff_keyed, scan_diff_fingerprint, fp_history_filter, accuracy_stats, confidence_calibration, validation_applied,
        enclosing_function_asof, call_graph_edges, reachable_functions, annotate_unreachable, taint_closure,
    )
}
ORACLE = {
    "scan_history_latest": f"WITH {_LATEST} SELECT * FROM l",
    "trend_last10": f"WITH {_LATEST} SELECT scan_id, created_at, coalesce(total_findings, 0) AS total, coalesce(critical_count, 0) + coalesce(high_count, 0) AS severe FROM l WHERE lower(trim(status)) = 'completed' ORDER BY created_at DESC, scan_id LIMIT 10",
    "triage_latest_status": "SELECT fingerprint, arg_max(lower(trim(status)), struct_pack(r := reported_at, i := report_id)) AS status, max(reported_at) AS since FROM finding_reports WHERE fingerprint IS NOT NULL AND trim(coalesce(status, '')) <> '' GROUP BY 1",
    "scan_diff_keyed": f"""WITH {FINDINGS_SQL}, {_PAIRS}, {_sides("concat_ws('|', rule_id, file_path, line)")}
SELECT a, b, count(*) FILTER (prev = 0) AS new_keys, count(*) FILTER (cur = 0) AS fixed_keys, count(*) FILTER (cur > 0 AND prev > 0) AS persisting_keys, sum(prev) AS total_a, sum(cur) AS total_b, sum(cur) - sum(prev) AS delta FROM k GROUP BY ALL""",
    "scan_diff_fingerprint": f"""WITH {FINDINGS_SQL}, {_PAIRS}, {_sides("concat_ws('|', lower(file_path), lower(issue_name))")}, g AS (
SELECT a, b, coalesce(sum(cur) FILTER (prev = 0), 0) AS new_rows, coalesce(sum(prev) FILTER (cur = 0), 0) AS fixed_rows, coalesce(sum(cur) FILTER (prev > 0), 0) AS persisting_rows FROM k GROUP BY ALL) SELECT *, new_rows - fixed_rows AS delta FROM g""",
    "fp_history_filter": f"""WITH {FINDINGS_SQL}, h AS (SELECT rule_id, severity, {_EXT} AS ext, count(*) AS n, avg((status = 'false_positive')::INT) AS rate FROM f WHERE status IN ('false_positive', 'resolved') GROUP BY ALL HAVING count(*) >= 3)
SELECT db_id, round(coalesce(rate, 0.0), 6) AS fp_rate, coalesce(rate, 0) >= 0.8 AS dropped FROM (SELECT *, {_EXT} AS ext FROM f WHERE status = 'open') o LEFT JOIN h USING (rule_id, severity, ext)""",
    "accuracy_stats": f"WITH {FINDINGS_SQL}, {_VAL}, {_ACC} SELECT *, assessed - true_positives AS false_positives, round(true_positives / assessed::DOUBLE, 6) AS rate FROM acc",
    "confidence_calibration": f"""WITH {FINDINGS_SQL}, {_VAL}, {_ACC}
SELECT db_id, round(CASE WHEN assessed IS NULL THEN confidence ELSE greatest(0.1, least(0.99, 0.7 * confidence + 0.3 * (true_positives / assessed::DOUBLE))) END, 6) AS calibrated
FROM f LEFT JOIN (SELECT * FROM acc WHERE assessed >= 5) acc USING (severity) WHERE confidence > 0 AND (source = 'ai-discovery' OR ai_validated = 'Yes')""",
    "validation_applied": f"""WITH {FINDINGS_SQL}, {_VAL} SELECT db_id, CASE WHEN is_true_positive AND adj NOT IN ('same', '') THEN adj ELSE severity END AS severity,
  CASE WHEN is_true_positive THEN 'Yes' WHEN NOT is_true_positive THEN 'No (False Positive)' ELSE ai_validated END AS ai_validated,
  round(CASE WHEN is_true_positive AND v_confidence > 0 AND NOT isnan(v_confidence) THEN v_confidence ELSE confidence END, 6) AS confidence
FROM f LEFT JOIN v ON db_id = finding_id WHERE severity NOT IN ('low', 'info')""",
    "enclosing_function_asof": f"WITH {LINES_SQL}, {_FN}, p AS (SELECT DISTINCT file_path, line_no FROM ({_scan_sql(r.RULES)})) SELECT file_path, line_no, fn FROM fnl SEMI JOIN p USING (file_path, line_no) WHERE fn IS NOT NULL",
    "call_graph_edges": f"WITH {LINES_SQL}, {_FN}, {_EDGES} SELECT * FROM e",
    "reachable_functions": f"{_REACH} SELECT name FROM rch",
    "annotate_unreachable": f"""{_REACH}, m AS ({CODE_SQL["rule_findings"]}), meta(rule_id, description) AS (VALUES {", ".join(f"({_q(x.rule_id)}, {_q(x.description)})" for x in r.RULES)}),
web AS (SELECT file_path FROM files WHERE {" OR ".join(f"contains(lower(content), {_q(k)})" for k in findings.WEB_MARKERS)}),
x AS (SELECT m.*, description, fn, fn IS NOT NULL AND fn NOT IN (SELECT name FROM rch) AS dead, file_path IN (SELECT file_path FROM web) AS web FROM m JOIN meta USING (rule_id) JOIN fnl USING (file_path, line_no))
SELECT file_path, line_no, rule_id, CASE WHEN dead AND web THEN 'high' WHEN dead THEN 'info' ELSE severity END AS severity,
  CASE WHEN dead THEN CASE WHEN web THEN '' ELSE '[UNREACHABLE] ' END || description || ' (function ' || chr(39) || fn || chr(39) || ' is not called from any entry point)' ELSE description END AS description, round(CASE WHEN dead THEN confidence * 0.3 ELSE confidence END, 6) AS confidence FROM x""",
    "taint_closure": f"WITH RECURSIVE {LINES_SQL}, {_FN}, {_EDGES}, t AS (SELECT DISTINCT fn AS name FROM fnl WHERE fn IS NOT NULL AND regexp_matches(line, {_q(graph.SOURCE)}) UNION SELECT e.caller FROM t JOIN e ON e.callee = t.name) SELECT name FROM t",
}
