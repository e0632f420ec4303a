"""Queries on finding records (findings, scans)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import findings as o
from tidewatch.session import table


def _f(spark, sf):
    return o.records(table(spark, sf, "findings"))


def exact_line_dedup(spark, sf):
    return o.exact_line_dedup(_f(spark, sf))


def proximity_clusters(spark, sf):
    return o.proximity_clusters(o.exact_line_dedup(_f(spark, sf)))


def findings_pipeline(spark, sf):
    """All engines' rows of each scan (the phases) in one, merged by line and by nearness, recalibrated, scored and numbered."""
    f = table(spark, sf, "findings")
    every = o.records(f, "static").unionByName(o.records(f, "ai")).unionByName(o.records(f, "final"))
    return o.pipeline(every.dropDuplicates(["db_id"])).select("db_id", "scan_id", "severity", "n_merged", "from_line", "to_line", "trust_score", "sr_no")


def family_key(spark, sf):
    f = _f(spark, sf)
    return f.groupBy(o.family(f).alias("family")).agg(F.count("*").alias("n_findings"))


def recalibrate(spark, sf):
    return o.recalibrated(_f(spark, sf)).filter(F.col("severity") != F.col("old_severity")).select("db_id", "old_severity", "severity")


def trust_score(spark, sf):
    f = _f(spark, sf)
    return f.select("db_id", o.trust_score(f).alias("trust_score"))


def three_way_split(spark, sf):
    f = _f(spark, sf)
    return f.groupBy("scan_id", o.bucket(f).alias("bucket")).agg(F.count("*").alias("n_findings"))


def priority_matrix(spark, sf):
    return o.priority(_f(spark, sf)).groupBy("scan_id", "priority").agg(F.count("*").alias("n_findings"))


def risk_score(spark, sf):
    return o.risk_score(_f(spark, sf))


def policy_violations(spark, sf):
    return o.policy_violations(_f(spark, sf))


def cwe_top15(spark, sf):
    return o.top_cwes(_f(spark, sf))


def owasp_counts(spark, sf):
    return _f(spark, sf).groupBy(o.owasp_control(F.col("owasp")).alias("control_id")).agg(F.count("*").alias("n_findings")).filter("control_id <> ''")


def compliance_owasp(spark, sf):
    return o.compliance_owasp(_f(spark, sf))


def compliance_pci(spark, sf):
    return o.compliance_cwe(_f(spark, sf), o.PCI)


def compliance_nist(spark, sf):
    return o.compliance_cwe(_f(spark, sf), o.NIST)


def mitre_enrich(spark, sf):
    f = o.with_technique(_f(spark, sf))
    return f.filter(F.col("technique").isNotNull()).select("db_id", "technique", F.length("description").alias("n_chars"))


def batch_numbering(spark, sf):
    return o.batches(_f(spark, sf), 30).select("db_id", "sr_no", "batch_no")


_BL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(160)"


def _bl() -> str:
    return _BL


def _tx(c: str) -> str:
    return f"coalesce(trim({c}, {_BL}), '')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FINDINGS_SQL = rf"""f AS (SELECT DISTINCT db_id, coalesce(scan_id, '') AS scan_id, {_tx("issue_name")} AS issue_name,
  coalesce(regexp_replace(regexp_replace(replace(trim(file_path, {_BL}), chr(92), '/'), '/(?:\.?/)+', '/', 'g'), '^(?:\./)*/?', ''), '') AS file_path,
  {_tx("description")} AS description, lower({_tx("severity")}) AS severity, coalesce(try_cast(regexp_extract(line_number, '^\s*(\d+)', 1) AS INT), 0) AS line,
  {_tx("ai_validated")} AS ai_validated, {_tx("remediation")} AS remediation, {_tx("rule_id")} AS rule_id, {_tx("source")} AS source, upper({_tx("cwe")}) AS cwe, upper({_tx("owasp")}) AS owasp,
  CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE confidence END AS confidence, CASE WHEN lower({_tx("status")}) = '' THEN 'open' ELSE lower({_tx("status")}) END AS status
  FROM findings WHERE lower({_tx("phase")}) = 'final')"""
RANK = "CASE severity WHEN 'info' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 WHEN 'critical' THEN 5 ELSE 0 END"
_CWE = r"CASE WHEN cwe LIKE 'CWE-%' THEN cwe WHEN regexp_matches(cwe, '^(CWE )?\d+$') THEN 'CWE-' || regexp_extract(cwe, '(\d+)', 1) ELSE '' END"
_WORDS = "translate(lower(concat_ws(' ', rule_id, issue_name, description)), '-_', '  ')"
FAMILY_SQL = (
    f"CASE {_CWE} "
    + " ".join(f"WHEN {_q(c)} THEN {_q(n)}" for c, n in o.CWE_FAMILIES.items())
    + f" ELSE CASE WHEN ({_CWE}) <> '' THEN {_CWE} "
    + " ".join("WHEN " + " OR ".join(f"contains({_WORDS}, {_q(k)})" for k in ks) + f" THEN {_q(n)}" for n, ks in o.WORD_FAMILIES)
    + " WHEN rule_id <> '' THEN 'RULE:' || rule_id ELSE 'GENERIC:' || lower(issue_name) END END"
)


def _merge(position: tuple[str, ...] = ("db_id",)) -> str:
    before = ", ".join(f"p{i} := -{p}" for i, p in enumerate(position))
    pos = "struct_pack(" + ", ".join(f"p{i} := {p}" for i, p in enumerate(position)) + ")"
    rank = f"r := {RANK}"
    return f"""count(*) AS n_merged, min(db_id) AS db_id,
  arg_max(severity, struct_pack({rank}, {before})) AS severity, arg_max(cwe, struct_pack({rank}, {before})) AS cwe, arg_max(owasp, struct_pack({rank}, {before})) AS owasp,
  arg_max(issue_name, struct_pack({rank}, n := length(description), {before})) AS issue_name, arg_max(description, struct_pack({rank}, n := length(description), {before})) AS description,
  arg_max(remediation, struct_pack({rank}, h := (remediation <> '')::INT, n := length(description), {before})) AS remediation,
  coalesce(arg_min(rule_id, {pos}) FILTER (rule_id <> ''), '') AS rule_id, max(confidence) AS confidence,
  CASE WHEN bool_or(ai_validated = 'Yes') THEN 'Yes' ELSE arg_min(ai_validated, {pos}) END AS ai_validated"""


_ENGINES = "SELECT {k}, string_agg(DISTINCT e, ', ' ORDER BY e) AS source FROM (SELECT {k}, trim(unnest(string_split(source, ','))) AS e FROM {t}) WHERE e <> '' GROUP BY ALL"
_RISK = "least(100.0, 10.0 * critical_count + 5.0 * high_count + 2.0 * medium_count + 0.5 * low_count)"
_TRUST = "least(100.0, round(100 * confidence + 15 * (len(string_split(source, ', ')) - 1) + CASE WHEN ai_validated = 'Yes' THEN 10 ELSE 0 END, 6))"
_DEDUP = f"""x1 AS (SELECT *, CASE WHEN line <= 0 THEN db_id ELSE 0 END AS alone FROM f),
m1 AS (SELECT scan_id, file_path, line, alone, {_merge()} FROM x1 GROUP BY ALL), s1 AS ({_ENGINES.format(k="scan_id, file_path, line, alone", t="x1")}),
f1 AS (SELECT m1.* EXCLUDE (alone), coalesce(s1.source, '') AS source FROM m1 LEFT JOIN s1 USING (scan_id, file_path, line, alone))"""
_CLUSTERS = f"""{_DEDUP}, x2 AS (SELECT *, {FAMILY_SQL} AS family FROM f1),
d2 AS (SELECT DISTINCT scan_id, file_path, family, line FROM x2),
n2 AS (SELECT *, CASE WHEN line - lag(line) OVER w > CASE WHEN regexp_matches(upper(family), 'SECRET|CREDENTIAL|HARDCODED') THEN 0 ELSE 15 END THEN 1 ELSE 0 END AS new FROM d2 WINDOW w AS (PARTITION BY scan_id, file_path, family ORDER BY line)),
k2 AS (SELECT *, sum(new) OVER (PARTITION BY scan_id, file_path, family ORDER BY line) AS cluster_no FROM n2),
y2 AS (SELECT x2.*, k2.cluster_no FROM x2 JOIN k2 USING (scan_id, file_path, family, line)),
m2 AS (SELECT scan_id, file_path, family, cluster_no, min(line) AS from_line, max(line) AS to_line, {_merge(("line", "db_id"))} FROM y2 GROUP BY ALL), s2 AS ({_ENGINES.format(k="scan_id, file_path, family, cluster_no", t="y2")}),
f2 AS (SELECT m2.*, coalesce(s2.source, '') AS source FROM m2 LEFT JOIN s2 USING (scan_id, file_path, family, cluster_no))"""
_ACTIVE = "a AS (SELECT * FROM f WHERE status NOT IN ('false_positive', 'ignored'))"
_LOW = "lower(concat_ws(' ', issue_name, description, rule_id))"


def _recal(source: str = "f") -> str:
    steps = (
        (f"(cwe IN ('CWE-338', 'CWE-330', 'CWE-331') OR contains({_LOW}, 'math.random') OR contains({_LOW}, 'predictable random'))", "'critical'", "high"),
        (f"cwe = 'CWE-79' AND NOT contains({_LOW}, 'stored')", "'critical'", "high"),
        ("cwe = 'CWE-770'", "'medium', 'high'", "low"),
        ("cwe = 'CWE-20'", "'critical'", "medium"),
        (f"(cwe = 'CWE-943' OR contains({_LOW}, 'nosql')) AND contains({_LOW}, 'req.body')", "'high'", "critical"),
        (f"(cwe IN ('CWE-1336', 'CWE-94') OR contains({_LOW}, 'template injection') OR contains({_LOW}, 'ssti'))", "'medium', 'high'", "critical"),
        (f"(cwe = 'CWE-98' OR contains({_LOW}, 'file inclusion') OR contains({_LOW}, 'lfi'))", "'info', 'low'", "high"),
    )
    sql = f"SELECT *, severity AS old_severity FROM {source}"
    for cond, frm, to in steps:
        sql = f"SELECT * REPLACE (CASE WHEN ({cond}) AND severity IN ({frm}) THEN '{to}' ELSE severity END AS severity) FROM ({sql})"
    return sql


def _controls(framework) -> str:
    rows = ", ".join(f"({_q(i)})" for i, _ in framework)
    hits = " UNION ALL ".join(f"SELECT {_q(i)} AS control_id, severity FROM a WHERE " + " OR ".join(f"contains(cwe, {_q(c)})" for c in cs) for i, cs in framework)
    return _rolled(rows, hits)


def _rolled(rows: str, hits: str) -> str:
    return f"""WITH {FINDINGS_SQL}, {_ACTIVE}, c(control_id) AS (VALUES {rows}), h AS ({hits}),
g AS (SELECT control_id, count(*) AS n, arg_max(severity, {RANK}) FILTER ({RANK} > 0) AS s FROM h GROUP BY 1)
SELECT c.control_id, coalesce(n, 0) AS n_findings, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, coalesce(s, '') AS severity FROM c LEFT JOIN g USING (control_id)"""


QUERIES = {
    f.__name__: f
    for f in (
        exact_line_dedup, proximity_clusters, findings_pipeline, family_key, recalibrate, trust_score, three_way_split, priority_matrix, risk_score, policy_violations, cwe_top15, owasp_counts,
        compliance_owasp, compliance_pci, compliance_nist, mitre_enrich, batch_numbering,
    )
}
ORACLE = {
    "exact_line_dedup": f"WITH {FINDINGS_SQL}, {_DEDUP} SELECT * FROM f1",
    "proximity_clusters": f"WITH {FINDINGS_SQL}, {_CLUSTERS} SELECT * FROM f2",
    "findings_pipeline": f"""WITH {FINDINGS_SQL.replace("= 'final'", "IN ('static', 'ai', 'final')")}, {_CLUSTERS}, r AS (SELECT *, {_TRUST} AS trust_score FROM ({_recal("(SELECT *, from_line AS line FROM f2)")}))
SELECT db_id, scan_id, severity, n_merged, from_line, to_line, trust_score, row_number() OVER (PARTITION BY scan_id ORDER BY {RANK} DESC, file_path, line, db_id) AS sr_no FROM r""",
    "family_key": f"WITH {FINDINGS_SQL} SELECT {FAMILY_SQL} AS family, count(*) AS n_findings FROM f GROUP BY 1",
    "recalibrate": f"WITH {FINDINGS_SQL} SELECT db_id, old_severity, severity FROM ({_recal()}) WHERE severity <> old_severity",
    "trust_score": f"WITH {FINDINGS_SQL} SELECT db_id, {_TRUST} AS trust_score FROM f",
    "three_way_split": f"""WITH {FINDINGS_SQL}, t AS (SELECT *, {_TRUST} AS trust FROM f) SELECT scan_id, CASE WHEN contains(lower(ai_validated), 'false positive') THEN 'false_positive'
  WHEN regexp_matches(replace(lower(file_path), chr(92), '/'), {_q(o.TEST_PATH)}) OR (trust > 0 AND trust < 20) THEN 'unreachable' ELSE 'reachable' END AS bucket, count(*) AS n_findings FROM t GROUP BY ALL""",
    "priority_matrix": f"""WITH {FINDINGS_SQL} SELECT scan_id, CASE severity WHEN 'critical' THEN CASE WHEN ai_validated = 'Yes' THEN 'P0' ELSE 'P1' END WHEN 'high' THEN CASE WHEN ai_validated = 'Yes' THEN 'P1' ELSE 'P2' END
  WHEN 'medium' THEN CASE WHEN ai_validated = 'Yes' THEN 'P2' ELSE 'P3' END ELSE 'P3' END AS priority, count(*) AS n_findings FROM f WHERE ai_validated <> 'No (False Positive)' GROUP BY ALL""",
    "risk_score": f"""WITH {FINDINGS_SQL}, a AS (SELECT scan_id, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_count" for s in ("critical", "high", "medium", "low"))}, count(*) FILTER (ai_validated = 'Yes') AS ai_validated_count, count(*) AS total_findings FROM f GROUP BY 1)
SELECT *, total_findings - critical_count - high_count - medium_count - low_count AS info_count, trunc({_RISK})::INT AS score,
  CASE WHEN {_RISK} >= 75 THEN 'Critical Risk' WHEN {_RISK} >= 50 THEN 'High Risk' WHEN {_RISK} >= 25 THEN 'Medium Risk' ELSE 'Low Risk' END AS level FROM a""",
    "policy_violations": f"""WITH {FINDINGS_SQL}, {_ACTIVE}, b AS (SELECT scan_id, severity, count(*) AS actual FROM a GROUP BY ALL), c AS (SELECT * FROM b UNION ALL SELECT scan_id, 'total', sum(actual) FROM b GROUP BY 1),
l(severity, limit_value) AS (VALUES ('critical', 0), ('high', 5), ('total', 40))
SELECT scan_id, 'fail-on high' AS gate, severity, actual, 0 AS limit_value FROM c WHERE severity IN ('high', 'critical')
UNION ALL SELECT scan_id, 'max-' || severity, severity, actual, limit_value FROM c JOIN l USING (severity) WHERE actual > limit_value""",
    "cwe_top15": rf"WITH {FINDINGS_SQL} SELECT regexp_extract(cwe, '(CWE-\d+)', 1) AS cwe, count(*) AS n_findings FROM f WHERE regexp_matches(cwe, 'CWE-\d+') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "owasp_counts": f"WITH {FINDINGS_SQL} SELECT regexp_extract(owasp, '(A(?:0[1-9]|10):2021)', 1) AS control_id, count(*) AS n_findings FROM f WHERE regexp_matches(owasp, 'A(0[1-9]|10):2021') GROUP BY 1",
    "compliance_owasp": _rolled(", ".join(f"({_q(i)})" for i, _ in o.OWASP), "SELECT regexp_extract(owasp, '(A(?:0[1-9]|10):2021)', 1) AS control_id, severity FROM a WHERE regexp_matches(owasp, 'A(0[1-9]|10):2021')"),
    "compliance_pci": _controls(o.PCI),
    "compliance_nist": _controls(o.NIST),
    "mitre_enrich": f"""WITH {FINDINGS_SQL}, t AS (SELECT *, lower(issue_name) AS t FROM f), k AS (SELECT *, CASE
  WHEN contains(t, 'sql injection') THEN 'T1190' WHEN regexp_matches(t, 'command injection|os command|exec\\(|shell') THEN 'T1059' WHEN regexp_matches(t, 'xss|cross-site scripting') THEN 'T1189'
  WHEN regexp_matches(t, 'hardcoded|secret|credential|password|api key|token') THEN 'T1078' WHEN regexp_matches(t, 'path traversal|directory traversal|lfi|rfi') THEN 'T1083'
  WHEN regexp_matches(t, 'ssrf|deserialization|unserialize|xxe|xml external|ldap injection') THEN 'T1190' WHEN contains(t, 'open redirect') THEN 'T1189' WHEN regexp_matches(t, 'insecure random|weak random') THEN 'T1552' END AS technique FROM t)
SELECT db_id, technique, length(description) + length(chr(10) || chr(10) || 'MITRE ATT&CK: ' || technique || ' - ') + CASE technique WHEN 'T1190' THEN 33 WHEN 'T1059' THEN 33 WHEN 'T1189' THEN 19 WHEN 'T1078' THEN 14 WHEN 'T1083' THEN 28 ELSE 21 END AS n_chars
FROM k WHERE technique IS NOT NULL""",
    "batch_numbering": f"WITH {FINDINGS_SQL} SELECT db_id, row_number() OVER w AS sr_no, (row_number() OVER w - 1) // 30 AS batch_no FROM f WINDOW w AS (PARTITION BY scan_id ORDER BY {RANK} DESC, file_path, line, db_id)",
}
