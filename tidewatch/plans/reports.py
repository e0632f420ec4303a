"""Queries on reports, answers and the texts of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars as fn
from tidewatch.operators import answers, exports, history
from tidewatch.operators import findings as o
from tidewatch.plans.analytics import _ACTIVE, FINDINGS_SQL, RANK, _bl, _q, _tx
from tidewatch.session import table


def _raw(spark, sf):
    return exports.report_rows(table(spark, sf, "findings"))


def _rec(spark, sf):
    return o.records(table(spark, sf, "findings"))


def csv_rows(spark, sf):
    return exports.csv_rows(_raw(spark, sf))


def csv_lines(spark, sf):
    return exports.csv_lines(_raw(spark, sf))


def sarif_document(spark, sf):
    return exports.sarif_parts(_raw(spark, sf))


def sbom_of_findings(spark, sf):
    return exports.sbom(_raw(spark, sf))[0]


def sbom_vulnerabilities(spark, sf):
    return exports.sbom(_raw(spark, sf))[1].select("scan_id", "db_id", "id", "severity")


def compliance_report(spark, sf):
    """OWASP summary of each scan."""
    f = o.active(_rec(spark, sf))
    hits = f.select("scan_id", o.owasp_control(F.col("owasp")).alias("control_id"), "severity").filter("control_id <> ''")
    return exports.compliance(_rec(spark, sf), hits, spark.createDataFrame([(i,) for i, _ in o.OWASP], "control_id string"))


def inline_comments(spark, sf):
    return exports.inline_comments(_rec(spark, sf))


def notice_counts(spark, sf):
    return exports.notice_counts(_rec(spark, sf))


def dashboard_totals(spark, sf):
    s = history.latest_scans(table(spark, sf, "scans"))
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return s.agg(F.count("*").alias("scans"), F.count_if(F.lower(F.trim("status")) == "completed").alias("completed"), total("total_findings").alias("findings"), total("critical_count").alias("critical"), total("high_count").alias("high"))


def finding_search(spark, sf):
    """Open findings of a severity whose name, text, path or CWE holds a text in any case."""
    f = _rec(spark, sf)
    hit = reduce(lambda a, b: a | b, [F.lower(c).contains("token") for c in ("issue_name", "file_path", "description", "cwe")])
    return f.filter((F.col("severity") == "high") & (F.col("status") == "open") & hit).select("db_id", "scan_id", "file_path", "line")


def severity_histogram(spark, sf):
    return _rec(spark, sf).groupBy("scan_id", "severity").agg(F.count("*").alias("n_findings"))


def queue_size(spark, sf):
    """Findings of each scan that wait for a check: all that are neither low nor info."""
    return _rec(spark, sf).groupBy("scan_id").agg(F.count_if(~F.col("severity").isin("low", "info")).alias("n_waiting"))


def bucket_severities(spark, sf):
    f = _rec(spark, sf)
    return f.filter(o.bucket(f) == "reachable").groupBy("scan_id", "severity").agg(F.count("*").alias("n_findings"))


def rule_catalogue(spark, sf):
    """Rules as the findings know them: rows, names a rule goes by, and rows without CWE or advice."""
    f = _rec(spark, sf).filter("rule_id <> ''")
    return f.groupBy("rule_id").agg(F.count("*").alias("n_rows"), F.count_distinct("issue_name").alias("n_names"), F.count_if(F.col("cwe") == "").alias("without_cwe"), F.count_if(F.col("remediation") == "").alias("without_advice"))


def finding_rows(spark, sf):
    """Findings of a scan as a reader gets them: the final phase, or all phases of a scan that has no final row and does not run; rows lacking rule or path drop out."""
    f = table(spark, sf, "findings").filter(F.col("rule_id").isNotNull() & (F.trim("rule_id") != "") & F.col("file_path").isNotNull() & (F.trim("file_path") != "")).select("db_id", "scan_id", F.lower(F.trim("phase")).alias("phase")).dropDuplicates(["db_id"])
    running = history.latest_scans(table(spark, sf, "scans")).filter(F.lower(F.trim("status")) == "running").select("scan_id", F.lit(True).alias("runs"))
    finals = f.filter("phase = 'final'").select("scan_id").distinct().withColumn("has_final", F.lit(True))
    x = f.join(finals, "scan_id", "left").join(running, "scan_id", "left")
    return x.filter((F.col("phase") == "final") | (F.col("has_final").isNull() & F.col("runs").isNull())).select("db_id", "scan_id", "phase")


def text_forms(spark, sf):
    """Scalar forms of each finding's fields."""
    f = _raw(spark, sf)
    return f.select(
        "db_id",
        fn.truncated(F.col("description"), 40).alias("short_text"),
        fn.cwe_id(F.col("cwe")).alias("cwe_id"),
        fn.owasp_label(F.col("owasp")).alias("owasp_label"),
        fn.has_user_input(F.col("code_snippet")).alias("user_input"),
        fn.has_formatting(F.col("code_snippet")).alias("formatting"),
        fn.is_secret_name(F.col("issue_name")).alias("secret_name"),
        fn.is_literal(F.col("code_snippet")).alias("literal"),
        fn.path_cell(F.col("exploit_path")).alias("path_cell"),
        fn.package_of(F.col("source"), F.col("vulnerable_pattern"), F.col("issue_name")).alias("package"),
        fn.version_of(F.col("vulnerable_pattern")).alias("version"),
        fn.encoded_path(F.col("file_path")).alias("encoded_path"),
    )


def scanner_ingest(spark, sf):
    """Raw rows of the pattern scanner written as its report and read back: names, severities, line references."""
    e = table(spark, sf, "engine_findings").filter((F.lower(F.trim("source")) == "semgrep") & F.col("db_id").isNotNull()).dropDuplicates(["db_id"])
    at = F.regexp_extract(F.coalesce("line_number", F.lit("")), r"^(\d+)", 1).try_cast("int")
    end = F.coalesce(F.regexp_extract(F.coalesce("line_number", F.lit("")), r"^\d+-(\d+)$", 1).try_cast("int"), at)
    check = F.concat(F.coalesce(F.nullif(F.regexp_extract("file_path", r"\.([a-z]+)$", 1), F.lit("")), F.lit("generic")), F.lit(".audit."), "issue_name")
    result = F.struct(check.alias("check_id"), F.col("file_path").alias("path"), F.struct(at.alias("line")).alias("start"), F.struct(end.alias("line")).alias("end"), F.struct(F.col("description").alias("message")).alias("extra"), F.col("severity").alias("severity"))
    reports = e.select("db_id", F.to_json(F.struct(F.array(result).alias("results"))).alias("report"))
    return answers.scanner_findings(reports).select("db_id", "issue_name", "file_path", "severity", "line_number", "rule_id")


def discovery_mapping(spark, sf):
    return answers.discovered(table(spark, sf, "discoveries"))


def related_files(spark, sf):
    """Files of the same scan that a finding's text or path of steps names, two at most."""
    f = _raw(spark, sf)
    files = f.select("file_path").filter("file_path <> ''").distinct()
    return answers.related_files(f.select("db_id", "file_path", "description", "exploit_path"), files)


def _verdicts(spark, sf) -> DataFrame:
    """Verdicts of validations as a judge would give them: a rejected finding is dropped; a confirmed one keeps its scan's rows of the same line."""
    v = history.latest_validations(table(spark, sf, "validations")).filter(F.col("is_true_positive").isNotNull())
    f = _rec(spark, sf).select("db_id", "scan_id", "file_path", "line")
    m = v.join(f, F.col("finding_id") == F.col("db_id"))
    other = f.select(F.col("db_id").alias("other"), "scan_id", "file_path", "line")
    d = m.filter("line > 0").join(other, ["scan_id", "file_path", "line"]).filter(F.col("other") > F.col("db_id")).groupBy("db_id").agg(F.array_sort(F.collect_set("other")).alias("duplicate_ids"))
    x = m.join(d, "db_id", "left")
    row = F.struct(F.col("db_id").alias("master_id"), "duplicate_ids", F.when(F.col("is_true_positive"), "keep").otherwise("drop").alias("verdict"), F.lit("seen").alias("reason"), F.when(F.lower("severity_adjustment").isin(*o.SEVERITY_ORDER), F.lower("severity_adjustment")).alias("final_severity"))
    return x.select(F.concat(F.lit("Here is the answer:\n```json\n"), F.to_json(F.struct(F.array(row).alias("findings"))), F.lit("\n```")).alias("answer"))


def judge_merge(spark, sf):
    """The judge's answers taken out of their text and applied: drops, merges, and all others kept."""
    v = answers.verdicts_of(answers.with_json(_verdicts(spark, sf), "answer").drop("answer"))
    found = _rec(spark, sf).withColumn("ai_reasoning", F.lit(""))
    return answers.judged(found, v)


def json_repair(spark, sf):
    """Well-formed JSON in model answers: validations as answers, cut and cluttered in five ways by their id."""
    v = table(spark, sf, "validations").filter(F.col("validation_id").isNotNull()).dropDuplicates(["validation_id"])
    body = F.to_json(F.struct(F.col("validation_id").alias("id"), "is_true_positive", F.array(F.lit(1), F.lit(2)).alias("steps"), "severity_adjustment"))
    i = F.pmod("validation_id", F.lit(5))
    text = F.when(i == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i == 1, F.concat(F.lit("<think>{}</think> so: "), body, F.lit(" done"))).when(i == 2, F.regexp_replace(body, r"\}$", ",}")).when(i == 3, F.regexp_replace(body, r"\}$", "")).otherwise(body)
    x = answers.with_json(v.select("validation_id", text.alias("answer")), "answer")
    return x.select("validation_id", fn.flex_int(F.col("json"), "$.id").alias("id"), fn.flex_int(F.col("json"), "$.steps").alias("first_step"), F.get_json_object("json", "$.severity_adjustment").alias("severity_adjustment"))


def circuit_breaker(spark, sf):
    """Validations of each provider in order of time: which would not have run after three in a row that gave no verdict."""
    v = table(spark, sf, "validations").filter(F.col("validation_id").isNotNull()).dropDuplicates(["validation_id"])
    v = v.select("validation_id", F.coalesce("provider", F.lit("")).alias("provider"), F.struct("created_at", "validation_id").alias("at"), F.col("confidence").isNull().alias("failed"), F.date_trunc("month", "created_at").cast("string").alias("month"))
    x = answers.breaker(v.withColumn("run", F.concat_ws("|", "provider", "month")), "run", "at", "failed")
    return x.select("validation_id", "skipped")


def target_addresses(spark, sf):
    """Targets as repository addresses: which may be cloned, and how they are shown."""
    t = table(spark, sf, "scans").filter(F.col("target").isNotNull()).select("target").distinct()
    forms = F.array(F.concat(F.lit("https://host.example/"), "target"), F.concat(F.lit("https://me:pw@host.example/"), "target"), F.concat(F.lit("git@host.example:"), "target"), F.concat(F.lit("-"), "target"), F.concat(F.lit("ftp://host.example/"), "target"))
    x = t.select(F.explode(forms).alias("address"))
    return x.select("address", fn.is_git_url(F.col("address")).alias("valid"), fn.masked_urls(F.col("address")).alias("shown"))


def scan_durations(spark, sf):
    s = history.latest_scans(table(spark, sf, "scans")).filter(F.col("completed_at").isNotNull() & (F.col("completed_at") >= F.col("created_at")))
    seconds = F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return s.select("scan_id", fn.duration(seconds).alias("took"))


def fenced_code(spark, sf):
    v = table(spark, sf, "validations").filter(F.col("validation_id").isNotNull() & F.col("suggested_fix").isNotNull()).dropDuplicates(["validation_id"])
    return v.select("validation_id", F.sha2(fn.without_fences(F.col("suggested_fix")), 256).alias("code_hash"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_rows, csv_lines, sarif_document, sbom_of_findings, sbom_vulnerabilities, compliance_report, inline_comments, notice_counts, dashboard_totals, finding_search, severity_histogram, queue_size, bucket_severities, rule_catalogue,
        finding_rows, text_forms, scanner_ingest, discovery_mapping, related_files, judge_merge, json_repair, circuit_breaker, target_addresses, scan_durations, fenced_code,
    )
}

_TEXTS = ("issue_name", "file_path", "description", "severity", "line_number", "cwe", "owasp", "source", "ai_validated", "ai_reasoning", "remediation", "code_snippet", "fixed_code", "exploit_poc", "rule_id", "vulnerable_pattern", "status")
_RAW = f"""f AS (SELECT DISTINCT ON (db_id) db_id, coalesce(scan_id, '') AS scan_id, coalesce(sr_no, 0) AS sr_no, {", ".join(f"coalesce({c}, '') AS {c}" for c in _TEXTS)},
  {", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0 ELSE {c} END AS {c}" for c in ("confidence", "trust_score"))}, coalesce(exploit_path, []) AS exploit_path FROM findings WHERE lower({_tx("phase")}) = 'final')"""
_TEST_FILE = f"regexp_matches(replace(lower(file_path), chr(92), '/'), {_q(o.TEST_PATH)})"
_SECTION = f"CASE WHEN contains(lower(ai_validated), 'false positive') THEN 3 WHEN {_TEST_FILE} OR (trust_score > 0 AND trust_score < 20) THEN 2 ELSE 1 END"
_RULE = "CASE WHEN rule_id <> '' THEN rule_id ELSE replace(lower(issue_name), ' ', '-') END"
_DEP = "regexp_matches(source, 'dependency|osv|supply')"
_PKG = rf"CASE WHEN {_DEP} THEN CASE WHEN regexp_extract(vulnerable_pattern, '^\s*(\S+)', 1) <> '' THEN regexp_extract(vulnerable_pattern, '^\s*(\S+)', 1) ELSE issue_name END ELSE '' END"
_VER = r"CASE WHEN contains(vulnerable_pattern, '@') THEN substr(vulnerable_pattern, instr(vulnerable_pattern, '@') + 1) ELSE regexp_extract(vulnerable_pattern, '^\s*\S+\s+(\S+)', 1) END"
_SBOM = f"d AS (SELECT *, {_PKG} AS package FROM f WHERE lower(trim(status, {_bl()})) NOT IN ('false_positive', 'ignored'))"
_LATEST_SCANS = "l AS (SELECT scan_id, x.* FROM (SELECT scan_id, arg_max(struct_pack(status := status, created_at := created_at, completed_at := completed_at, total_findings := total_findings, critical_count := critical_count, high_count := high_count), struct_pack(u := updated_at, s := status)) AS x FROM scans WHERE scan_id IS NOT NULL GROUP BY 1))"


def _cwe(c: str) -> str:
    t = f"trim({c}, {_bl()})"
    return f"CASE WHEN {t} IS NULL OR {t} = '' OR upper({t}) = 'N/A' THEN {t} WHEN regexp_matches({t}, 'CWE-\\d+') THEN regexp_extract({t}, 'CWE-\\d+') ELSE 'N/A' END"


def _owasp(c: str) -> str:
    t, p = f"trim({c}, {_bl()})", r"'(A\d{2}:\d{4})([-\s]+[A-Za-z][A-Za-z\s/()]{0,50})?'"
    name = f"rtrim(regexp_replace(regexp_replace(trim(regexp_extract({t}, {p}, 2), {_bl()}), '^[- ]+', ''), '[ .,;:?!*]+$', ''))"
    return f"CASE WHEN {t} = '' OR upper({t}) = 'N/A' THEN {t} WHEN regexp_extract({t}, {p}, 1) = '' THEN 'N/A' WHEN {name} <> '' THEN regexp_extract({t}, {p}, 1) || '-' || {name} ELSE regexp_extract({t}, {p}, 1) END"


_CELL = {"sr_no": "sr_no::VARCHAR", "confidence": "CASE WHEN confidence > 0 THEN printf('%.0f%%', confidence * 100) ELSE 'N/A' END", "trust_score": "printf('%.0f', trust_score)", "secure_fix": "fixed_code", "taint_flow": "array_to_string(exploit_path, ' → ')"}
_CSV = f"c AS (SELECT scan_id, db_id, {_SECTION} AS section, {', '.join(f'{_CELL.get(n, n)} AS {n}' for n in exports.CSV_COLUMNS)} FROM f)"
_QUOTED = ", ".join(f"""CASE WHEN regexp_matches({c}, '[",\\n\\r]|^\\s') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END""" for c in exports.CSV_COLUMNS)
_COMMAS = "," * (len(exports.CSV_HEADER) - 1)
ORACLE = {
    "csv_rows": f"WITH {_RAW}, {_CSV} SELECT * FROM c",
    "csv_lines": f"""WITH {_RAW}, {_CSV}, u AS (SELECT scan_id, section FROM c UNION SELECT scan_id, 1 FROM c)
SELECT scan_id, section, 3 AS place, db_id, concat_ws(',', {_QUOTED}) AS line FROM c UNION ALL SELECT scan_id, section, 2, 0, {_q(",".join(exports.CSV_HEADER))} FROM u
UNION ALL SELECT scan_id, section, 0, 0, '{_COMMAS}' FROM u WHERE section > 1 UNION ALL SELECT scan_id, section, 1, 0, CASE section WHEN 2 THEN {_q(exports.CSV_SECTIONS[1])} ELSE {_q(exports.CSV_SECTIONS[2])} END || '{_COMMAS}' FROM u WHERE section > 1""",
    "sbom_of_findings": f"WITH {_RAW}, {_SBOM} SELECT scan_id, 'library' AS type, package AS name, arg_min({_VER}, db_id) AS version FROM d WHERE package <> '' GROUP BY ALL",
    "sbom_vulnerabilities": f"WITH {_RAW}, {_SBOM} SELECT scan_id, db_id, CASE WHEN rule_id <> '' THEN rule_id ELSE cwe END AS id, severity FROM d WHERE package <> '' AND (cwe <> '' OR contains(upper(issue_name), 'CVE')) AND (rule_id <> '' OR cwe <> '')",
    "compliance_report": f"""WITH {FINDINGS_SQL}, {_ACTIVE}, h AS (SELECT scan_id, regexp_extract(owasp, '(A(?:0[1-9]|10):2021)', 1) AS control_id, severity FROM a WHERE regexp_matches(owasp, 'A(0[1-9]|10):2021')),
p AS (SELECT scan_id, control_id, count(*) AS n, bool_or(severity IN ('critical', 'high')) AS severe FROM h GROUP BY ALL), g AS (SELECT scan_id, count(*) AS failing, sum(n) AS n, bool_or(severe) AS severe FROM p GROUP BY 1)
SELECT s.scan_id, 10 AS total_controls, 10 - coalesce(failing, 0) AS passing_controls, coalesce(failing, 0) AS failing_controls, coalesce(n, 0) AS total_findings, CASE WHEN severe THEN 'non-compliant' ELSE 'compliant' END AS overall_status FROM (SELECT DISTINCT scan_id FROM f) s LEFT JOIN g USING (scan_id)""",
    "inline_comments": f"""WITH {FINDINGS_SQL}, {_ACTIVE}, o AS (SELECT * FROM a WHERE severity IN ('critical', 'high') AND line > 0 QUALIFY row_number() OVER (PARTITION BY scan_id, file_path, line ORDER BY db_id) = 1)
SELECT scan_id, file_path, line, '**' || upper(severity) || ': ' || issue_name || '**' || chr(10) || chr(10) || description || chr(10) || chr(10) || '**Remediation:** ' || remediation || chr(10) || chr(10) || '_Rule: `' || rule_id || '` | ' || cwe || '_' AS body
FROM o QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY db_id) <= 20""",
    "notice_counts": f"WITH {FINDINGS_SQL}, {_ACTIVE} SELECT scan_id, {', '.join(f'''count(*) FILTER (severity = '{s}') AS {s}''' for s in ('critical', 'high', 'medium', 'low'))}, count(*) AS total, count(*) FILTER (severity NOT IN ('critical', 'high', 'medium', 'low')) AS info FROM a GROUP BY 1",
    "dashboard_totals": f"WITH {_LATEST_SCANS} SELECT count(*) AS scans, count(*) FILTER (lower(trim(status)) = 'completed') AS completed, sum(coalesce(total_findings, 0)) AS findings, sum(coalesce(critical_count, 0)) AS critical, sum(coalesce(high_count, 0)) AS high FROM l",
    "finding_search": f"WITH {FINDINGS_SQL} SELECT db_id, scan_id, file_path, line FROM f WHERE severity = 'high' AND status = 'open' AND (contains(lower(issue_name), 'token') OR contains(lower(file_path), 'token') OR contains(lower(description), 'token') OR contains(lower(cwe), 'token'))",
    "severity_histogram": f"WITH {FINDINGS_SQL} SELECT scan_id, severity, count(*) AS n_findings FROM f GROUP BY ALL",
    "queue_size": f"WITH {FINDINGS_SQL} SELECT scan_id, count(*) FILTER (severity NOT IN ('low', 'info')) AS n_waiting FROM f GROUP BY 1",
    "bucket_severities": f"""WITH {FINDINGS_SQL}, t AS (SELECT *, least(100.0, round(100 * confidence + 15 * (len(string_split(source, ', ')) - 1) + CASE WHEN ai_validated = 'Yes' THEN 10 ELSE 0 END, 6)) AS trust FROM f)
SELECT scan_id, severity, count(*) AS n_findings FROM t WHERE NOT contains(lower(ai_validated), 'false positive') AND NOT {_TEST_FILE} AND NOT (trust > 0 AND trust < 20) GROUP BY ALL""",
    "rule_catalogue": f"WITH {FINDINGS_SQL} SELECT rule_id, count(*) AS n_rows, count(DISTINCT issue_name) AS n_names, count(*) FILTER (cwe = '') AS without_cwe, count(*) FILTER (remediation = '') AS without_advice FROM f WHERE rule_id <> '' GROUP BY 1",
    "finding_rows": f"""WITH {_LATEST_SCANS}, g AS (SELECT DISTINCT ON (db_id) db_id, scan_id, lower(trim(phase)) AS phase FROM findings WHERE trim(rule_id) <> '' AND trim(file_path) <> '')
SELECT db_id, scan_id, phase FROM g WHERE phase = 'final' OR (scan_id NOT IN (SELECT scan_id FROM g WHERE phase = 'final' AND scan_id IS NOT NULL) AND scan_id NOT IN (SELECT scan_id FROM l WHERE lower(trim(status)) = 'running'))""",
    "text_forms": f"""WITH {_RAW} SELECT db_id, CASE WHEN length(description) > 40 THEN left(description, 40) || '...' ELSE description END AS short_text, {_cwe("cwe")} AS cwe_id, {_owasp("owasp")} AS owasp_label,
  regexp_matches(lower(code_snippet), {_q("|".join(p for p in fn.USER_INPUT if p.lower() == p))}) AS user_input, (contains(code_snippet, '%') OR contains(code_snippet, '.format') OR contains(code_snippet, 'f"') OR contains(code_snippet, 'f''') OR contains(code_snippet, '+')) AS formatting,
  regexp_matches(lower(issue_name), 'password|secret|api_key|apikey|token|credential') AS secret_name, (code_snippet <> '' AND left(code_snippet, 1) IN ('"', '''', '`')) AS literal, array_to_string(exploit_path, ' → ') AS path_cell, {_PKG} AS package, {_VER} AS version, replace(file_path, '/', '%2F') AS encoded_path FROM f""",
    "scanner_ingest": rf"""WITH e AS (SELECT DISTINCT ON (db_id) db_id, issue_name, file_path, severity, line_number FROM engine_findings WHERE lower(trim(source)) = 'semgrep' AND db_id IS NOT NULL),
n AS (SELECT *, CASE WHEN coalesce(regexp_extract(file_path, '\.([a-z]+)$', 1), '') = '' THEN 'generic' ELSE regexp_extract(file_path, '\.([a-z]+)$', 1) END AS lang, try_cast(nullif(regexp_extract(coalesce(line_number, ''), '^(\d+)', 1), '') AS INT) AS a,
  try_cast(nullif(regexp_extract(coalesce(line_number, ''), '^\d+-(\d+)$', 1), '') AS INT) AS b FROM e),
m AS (SELECT *, lang || '.audit.' || issue_name AS rule_id, coalesce(a, 0) AS first, coalesce(b, a, 0) AS last, replace(lang || '.audit.' || issue_name, '.', ' ') AS w, string_split(lang || '.audit.' || issue_name, '.')[-1] AS tail FROM n)
SELECT db_id, CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fn.LANGUAGE_NAMES.items())} ELSE upper(lang[1]) || lang[2:] END || ' ' || CASE {" ".join("WHEN " + " OR ".join("(" + " AND ".join(f"contains(w, {_q(x)})" for x in k.split("&")) + ")" for k in ks) + f" THEN {_q(t)}" for t, ks in fn.ISSUE_TYPES)}
  ELSE array_to_string(list_transform(string_split(replace(tail, '-', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS issue_name, file_path,
  CASE WHEN lower(severity) IN ('error', 'critical') THEN 'critical' WHEN lower(severity) IN ('warning', 'high') THEN 'high' WHEN lower(severity) = 'low' THEN 'low' ELSE 'medium' END AS severity, CASE WHEN first = last THEN first::VARCHAR ELSE first || '-' || last END AS line_number, rule_id FROM m""",
    "fenced_code": rf"""WITH v AS (SELECT DISTINCT ON (validation_id) validation_id, trim(suggested_fix, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM validations WHERE validation_id IS NOT NULL AND suggested_fix IS NOT NULL)
SELECT validation_id, sha256(trim(regexp_replace(regexp_replace(t, '^```[A-Za-z0-9_+-]*[ \t]*\r?\n?', ''), '\r?\n?```$', ''), ' ' || chr(9) || chr(10) || chr(13))) AS code_hash FROM v""",
    "discovery_mapping": f"""WITH d AS (SELECT DISTINCT ON (discovery_id) * FROM discoveries WHERE discovery_id IS NOT NULL) SELECT discovery_id, scan_id, coalesce(issue_name, '') AS issue_name, coalesce(file_path, '') AS file_path, coalesce(description, '') AS description, lower({_tx("severity")}) AS severity,
  coalesce(line_number, 0)::VARCHAR AS line_number, coalesce(remediation, '') AS remediation, coalesce(exploit_poc, '') AS exploit_poc, coalesce({_cwe("cwe")}, '') AS cwe, coalesce({_owasp("owasp")}, '') AS owasp, coalesce(confidence, 0.0) AS confidence,
  coalesce(fixed_code_snippet, '') AS fixed_code, trim(coalesce(vulnerable_code, ''), {_bl()}) AS vulnerable_pattern, 'ai-discovery' AS source, 'Discovered by AI' AS ai_validated FROM d""",
    "related_files": rf"""WITH {_RAW}, t AS (SELECT DISTINCT db_id, file_path, unnest(regexp_extract_all(concat_ws(' ', description, array_to_string(exploit_path, ' ')), '[\w.+-]+\.\w+')) AS base FROM f),
b AS (SELECT DISTINCT file_path AS related_path, split_part(file_path, '/', -1) AS base FROM f WHERE file_path <> ''), x AS (SELECT DISTINCT db_id, related_path FROM t JOIN b USING (base) WHERE related_path <> file_path)
SELECT db_id, related_path, row_number() OVER (PARTITION BY db_id ORDER BY related_path) AS nth FROM x QUALIFY nth <= 2""",
    "judge_merge": f"""WITH {FINDINGS_SQL}, v AS (SELECT finding_id, x.* FROM (SELECT finding_id, max(struct_pack(created_at := created_at, validation_id := validation_id, tp := is_true_positive, conf := confidence, adj := severity_adjustment)) AS x FROM validations WHERE finding_id IS NOT NULL GROUP BY 1)),
m AS (SELECT f.*, tp, lower(adj) AS adj FROM f JOIN v ON db_id = finding_id WHERE tp IS NOT NULL), k AS (SELECT m.db_id, tp, f.db_id AS dup, f.source AS dup_source, f.ai_validated AS dup_ai FROM m JOIN f ON f.scan_id = m.scan_id AND f.file_path = m.file_path AND f.line = m.line AND f.db_id > m.db_id WHERE m.line > 0),
gone AS (SELECT dup AS db_id FROM k UNION SELECT db_id FROM m WHERE NOT tp EXCEPT SELECT db_id FROM m WHERE tp), g AS (SELECT db_id, list_sort(list_distinct(list(dup_source))) AS more, bool_or(dup_ai = 'Yes') AS yes FROM k WHERE tp GROUP BY 1),
x AS (SELECT f.*, m.db_id IS NOT NULL AS judged, m.adj, g.more, g.yes FROM f LEFT JOIN (SELECT * FROM m WHERE tp) m ON m.db_id = f.db_id LEFT JOIN g ON g.db_id = f.db_id WHERE f.db_id NOT IN (SELECT db_id FROM gone))
SELECT db_id, issue_name, CASE WHEN judged AND adj IN ('info', 'low', 'medium', 'high', 'critical') THEN adj ELSE severity END AS severity, array_to_string(list_concat([source], list_filter(coalesce(more, []), lambda s: NOT contains(source, s))), ', ') AS source,
  CASE WHEN judged AND (coalesce(yes, false) OR NOT contains(ai_validated, 'Discovered')) THEN 'Yes' ELSE ai_validated END AS ai_validated, CASE WHEN judged THEN 'AI Judge: seen' ELSE '' END AS ai_reasoning, judged FROM x""",
    "json_repair": "SELECT DISTINCT validation_id, validation_id::INT AS id, 1 AS first_step, severity_adjustment FROM validations WHERE validation_id IS NOT NULL",
    "target_addresses": r"""WITH t AS (SELECT DISTINCT target FROM scans WHERE target IS NOT NULL), a AS (SELECT unnest(['https://host.example/' || target, 'https://me:pw@host.example/' || target, 'git@host.example:' || target, '-' || target, 'ftp://host.example/' || target]) AS address FROM t)
SELECT address, starts_with(address, 'https://host') OR starts_with(address, 'git@') AS valid, replace(address, 'me:pw@', '***:***@') AS shown FROM a""",
    "circuit_breaker": """WITH v AS (SELECT DISTINCT ON (validation_id) validation_id, concat_ws('|', coalesce(provider, ''), strftime(date_trunc('month', created_at), '%Y-%m-%d')) AS run, created_at, (confidence IS NULL)::INT AS failed FROM validations WHERE validation_id IS NOT NULL),
s AS (SELECT *, sum(failed) OVER (PARTITION BY run ORDER BY created_at, validation_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS streak FROM v)
SELECT validation_id, coalesce(max(streak::INT) OVER (PARTITION BY run ORDER BY created_at, validation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped FROM s""",
    "scan_durations": f"""WITH {_LATEST_SCANS}, s AS (SELECT scan_id, epoch(completed_at)::BIGINT - epoch(created_at)::BIGINT AS n FROM l WHERE completed_at >= created_at)
SELECT scan_id, CASE WHEN n < 60 THEN printf('%ds', n) WHEN n < 3600 THEN printf('%dm%02ds', n // 60, n % 60) ELSE printf('%dh%02dm', n // 3600, n % 3600 // 60) END AS took FROM s""",
}
