"""Queries on dependencies, containers, suppression and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import code_model, context, exports, findings, rules, supply, suppression
from tidewatch.plans.analytics import FINDINGS_SQL, RANK
from tidewatch.plans.code import LINES_SQL, ORACLE as CODE_SQL, _files, _lines
from tidewatch.session import table
from tidewatch.sources import manifests
from tidewatch.streaming import events

#: Pinned packages named anywhere in the documents, read as requirement lines.
PINNED = r"[A-Za-z][A-Za-z0-9_.-]*(?:==|>=|<=)v?[0-9][A-Za-z0-9.]*"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _requirement_lines(spark, sf):
    return _lines(spark, sf).select("file_path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(PINNED), 0)).alias("line"))


def dependency_parse(spark, sf):
    return manifests.requirements(_requirement_lines(spark, sf))


def typosquat(spark, sf):
    return supply.typosquats(manifests.requirements(_requirement_lines(spark, sf)))


def typosquat_packages(spark, sf):
    """typosquat over every package name of the advisory answers."""
    return supply.typosquats(supply.packages(table(spark, sf, "osv_results")))


def library_use(spark, sf):
    """Packages of the advisory answers with whether the code names them."""
    deps = supply.packages(table(spark, sf, "osv_results")).select("name").distinct()
    return code_model.used_packages(deps, code_model.identifiers(_files(spark, sf)))


def base_images(spark, sf):
    return supply.base_images(_lines(spark, sf).filter("syntax = 'dockerfile'"))


def advisory_join(spark, sf):
    r = table(spark, sf, "osv_results")
    return supply.advisories_of(supply.packages(r), r)


def cvss_severity(spark, sf):
    return supply.advisory_severity(table(spark, sf, "osv_results"))


def fixed_version(spark, sf):
    return supply.fixed_versions(table(spark, sf, "osv_results"))


def sbom_components(spark, sf):
    return exports.sbom_components(supply.packages(table(spark, sf, "osv_results")))


def dockerfile_rules(spark, sf):
    return supply.dockerfile_rules(_lines(spark, sf).filter("syntax = 'dockerfile'"))


def k8s_rules(spark, sf):
    return supply.k8s_rules(_files(spark, sf))


def _rule_findings(spark, sf):
    f = rules.findings(_files(spark, sf))
    return f.select("file_path", "line_no", "rule_id", F.col("rule_id").alias("issue_name"), "description", "severity", "cwe", F.lit("No").alias("ai_validated"))


def fp_suppression(spark, sf):
    return suppression.suppressed(_files(spark, sf), _rule_findings(spark, sf)).drop("issue_name")


def suppression_family(spark, sf):
    f = findings.records(table(spark, sf, "findings"))
    return f.groupBy(suppression.family(F.col("cwe"), F.concat_ws(" ", "issue_name", "rule_id", "description")).alias("family")).agg(F.count("*").alias("n_findings"))


def sarif_rules(spark, sf):
    return exports.sarif_rules(findings.records(table(spark, sf, "findings")))


def sarif_results(spark, sf):
    return exports.sarif_results(findings.records(table(spark, sf, "findings")))


def top_findings(spark, sf):
    return exports.top_per_scan(findings.records(table(spark, sf, "findings")), 10)


def ast_checks(spark, sf):
    return code_model.checks(code_model.calls(_files(spark, sf)))


def taint_flow(spark, sf):
    return code_model.taint_flows(_files(spark, sf))


def taint_functions(spark, sf):
    return code_model.tainted_functions(code_model.function_facts(_files(spark, sf)))


def taint_sinks(spark, sf):
    """Lines that use a sink of their language, by kind of injection: every line against the sinks of its own language only."""
    x = _lines(spark, sf)
    each = F.array_compact(F.array(*[F.when((F.col("syntax") == lang) & F.col("line").rlike(p), F.struct(F.lit(lang).alias("language"), F.lit(kind).alias("kind"), F.lit(cwe).alias("cwe"))) for lang, p, kind, cwe, _ in code_model.sink_table()]))
    return x.select(F.inline(each)).groupBy("language", "kind", "cwe").agg(F.count("*").alias("n_uses"))


def stream_event_windows(spark, sf):
    return events.windowed_once(spark, f"{sf}/events.parquet")


def _any(text: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(t)})" for t in tokens) + ")"


_PINNED = f"""r AS (SELECT file_path, line_no, unnest(regexp_extract_all(line, {_q(PINNED)})) AS l FROM lines),
p AS (SELECT file_path, line_no, regexp_extract(l, '^(.*?)(==|>=|<=)', 1) AS name, regexp_replace(regexp_extract(l, '(?:==|>=|<=)(.*)$', 1), '^v', '') AS version FROM r)"""
_S = suppression
_SAFE = {f: [_any("ctx", _S.NEAR[f])] if f in _S.NEAR else [] for f in sorted(_S.NEAR.keys() | _S.ON_LINE.keys())}
for _f, _t in _S.ON_LINE.items():
    _SAFE[_f].append(_any("own", _t))
_SAFE["XSS"].append("(regexp_matches(own, 'textcontent|innertext') AND NOT contains(own, 'innerhtml'))")
_SAFE["PATH_TRAVERSAL"].append(f"({_any('ctx', _S.CANONICAL)} AND {_any('ctx', _S.BOUNDED)})")
_SAFE["HARDCODED_SECRET"].append(_any("CASE WHEN contains(own, '=') THEN substr(own, instr(own, '=') + 1) ELSE '' END", _S.ENVIRONMENT))
_FAMILY = "CASE upper(trim(cwe)) " + " ".join(f"WHEN '{c}' THEN '{f}'" for c, f in _S.CWE_FAMILY.items()) + " ELSE CASE " + " ".join(f"WHEN contains(words, {_q(w)}) THEN '{f}'" for w, f in _S.WORD_FAMILY) + " ELSE '' END END"

QUERIES = {
    f.__name__: f
    for f in (
        dependency_parse, typosquat, typosquat_packages, advisory_join, cvss_severity, fixed_version, sbom_components, library_use, base_images, dockerfile_rules, k8s_rules, fp_suppression, suppression_family, sarif_rules, sarif_results, top_findings,
        ast_checks, taint_flow, taint_functions, taint_sinks, stream_event_windows,
    )
}
_SARIF_ID = "CASE WHEN rule_id <> '' THEN rule_id ELSE replace(lower(issue_name), ' ', '-') END"
_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
ORACLE = {
    "dependency_parse": f"WITH {LINES_SQL}, {_PINNED} SELECT file_path, name, version, 'PyPI' AS ecosystem, line_no FROM p",
    "typosquat": f"""WITH {LINES_SQL}, {_PINNED}, t(lookalike) AS (VALUES ('requests'), ('numpy'), ('pandas'), ('lodash'), ('express'), ('react'), ('axios'), ('moment'), ('webpack'), ('babel'), ('django'), ('flask'), ('spring'), ('urllib3'),
  ('beautifulsoup4'), ('boto3'), ('cors'), ('body-parser'), ('async'), ('chalk'), ('react-dom'), ('mongoose'), ('typescript'), ('eslint'), ('prettier'), ('jest'))
SELECT DISTINCT name, lookalike FROM p JOIN t ON lower(name) <> lookalike AND abs(length(name) - length(lookalike)) <= 2 AND NOT starts_with(lower(name), lookalike || '-') AND NOT starts_with(lookalike, lower(name) || '-')
  AND (levenshtein(lower(name), lookalike) = 1 OR (levenshtein(lower(name), lookalike) = 2 AND length(lookalike) > 6))""",
    "base_images": rf"""WITH {LINES_SQL}, f AS (SELECT file_path, line_no, trim(line, ' ' || chr(9) || chr(13)) AS t FROM lines WHERE syntax = 'dockerfile'),
i AS (SELECT file_path, arg_max(string_split_regex(t, '\s+')[2], line_no) AS image FROM f WHERE starts_with(upper(t), 'FROM ') GROUP BY 1) SELECT DISTINCT image FROM i WHERE image <> '' AND image <> 'scratch' AND NOT starts_with(image, 'builder')""",
    "dockerfile_rules": rf"""WITH {LINES_SQL}, l AS (SELECT file_path, line_no, trim(line, ' ' || chr(9) || chr(13)) AS t FROM lines WHERE syntax = 'dockerfile'), v AS (SELECT *, upper(t) AS u FROM l WHERE t <> '' AND NOT starts_with(t, '#')),
h AS (SELECT file_path, line_no, 'CONTAINER-LATEST-TAG' AS rule_id, 'medium' AS severity, 'CWE-1104' AS cwe FROM v WHERE starts_with(u, 'FROM ') AND (contains(lower(t), ':latest') OR NOT contains(t, ':'))
UNION ALL SELECT file_path, line_no, 'CONTAINER-ROOT-USER', 'high', 'CWE-250' FROM v WHERE starts_with(u, 'USER ') AND (contains(lower(t), 'root') OR trim(substr(t, 6), ' ') = '0')
UNION ALL SELECT file_path, line_no, 'CONTAINER-ENV-SECRET', 'critical', 'CWE-312' FROM v WHERE (starts_with(u, 'ENV ') OR starts_with(u, 'ARG ')) AND regexp_matches(t, '(?i)(password|secret|key|token|credentials)')
UNION ALL SELECT file_path, line_no, 'CONTAINER-EXPOSE-SENSITIVE-PORT', 'high', 'CWE-200' FROM v WHERE starts_with(u, 'EXPOSE ') AND regexp_matches(t, '\b(22|3389|23)\b')
UNION ALL SELECT file_path, 0, 'CONTAINER-MISSING-USER', 'high', 'CWE-250' FROM l WHERE file_path NOT IN (SELECT file_path FROM v WHERE starts_with(u, 'USER ')) GROUP BY 1
UNION ALL SELECT file_path, 0, 'CONTAINER-MISSING-HEALTHCHECK', 'low', 'CWE-754' FROM l WHERE file_path NOT IN (SELECT file_path FROM v WHERE starts_with(u, 'HEALTHCHECK')) GROUP BY 1)
SELECT *, CASE severity WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence FROM h""",
    "k8s_rules": f"""WITH {LINES_SQL}, b AS (SELECT file_path FROM files WHERE contains(content, 'apiVersion:') AND contains(content, 'kind:')), l AS (SELECT file_path, line_no, lower(line) AS t FROM lines SEMI JOIN b USING (file_path))
SELECT file_path, line_no, 'K8S-PRIVILEGED-CONTAINER' AS rule_id, 'critical' AS severity, 'CWE-250' AS cwe, 0.95::DOUBLE AS confidence FROM l WHERE contains(t, 'privileged: ') AND contains(t, 'true')
UNION ALL SELECT file_path, line_no, 'K8S-PRIVILEGE-ESCALATION', 'high', 'CWE-250', 0.85::DOUBLE FROM l WHERE contains(t, 'allowprivilegeescalation: ') AND contains(t, 'true')""",
    "fp_suppression": f"""WITH fnd AS ({CODE_SQL["rule_findings"]}), {LINES_SQL}, meta(rule_id, description) AS (VALUES {", ".join(f"({_q(x.rule_id)}, {_q(x.description)})" for x in rules.RULES)}),
j AS (SELECT *, regexp_matches(trim(line, ' ' || chr(9) || chr(13)), {_q(context.JUNK)}) AS junk FROM lines),
w AS (SELECT file_path, line_no, junk, {", ".join(f"lag(junk, {d}) OVER f AS u{d}, lead(junk, {d}) OVER f AS d{d}" for d in (1, 2, 3))} FROM j WINDOW f AS (PARTITION BY file_path ORDER BY line_no)),
m AS (SELECT file_path, line_no, CASE WHEN NOT junk THEN line_no {" ".join(f"WHEN NOT u{d} THEN line_no - {d} WHEN NOT d{d} THEN line_no + {d}" for d in (1, 2, 3))} ELSE line_no END AS moved FROM w),
c AS (SELECT file_path, line_no, lower(line) AS own, lower(array_to_string(list(line) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), chr(10))) AS ctx FROM lines),
x AS (SELECT fnd.file_path, moved AS line_no, fnd.rule_id, description, severity, cwe, own, ctx, lower(concat_ws(' ', fnd.rule_id, fnd.rule_id, description)) AS words FROM fnd JOIN meta USING (rule_id) JOIN m USING (file_path, line_no) JOIN c ON c.file_path = fnd.file_path AND c.line_no = moved),
y AS (SELECT *, {_FAMILY} AS family FROM x),
z AS (SELECT *, CASE family {" ".join(f"WHEN '{f}' THEN {' OR '.join(c)}" for f, c in _SAFE.items())} ELSE false END AS suppressed FROM y)
SELECT file_path, line_no, rule_id, CASE WHEN suppressed THEN '[SUPPRESSED] ' ELSE '' END || description AS description, CASE WHEN suppressed THEN 'info' ELSE severity END AS severity, cwe,
  CASE WHEN suppressed THEN 'No (False Positive - Safe Pattern)' ELSE 'No' END AS ai_validated, family, suppressed FROM z""",
    "suppression_family": f"WITH {FINDINGS_SQL}, y AS (SELECT *, lower(concat_ws(' ', issue_name, rule_id, description)) AS words FROM f) SELECT {_FAMILY} AS family, count(*) AS n_findings FROM y GROUP BY 1",
    "taint_sinks": f"WITH {LINES_SQL} SELECT language, kind, cwe, count(*) AS n_uses FROM (" + " UNION ALL ".join(f"SELECT '{lang}' AS language, '{kind}' AS kind, '{cwe}' AS cwe FROM lines WHERE syntax = '{lang}' AND regexp_matches(line, {_q(p)})" for lang, p, kind, cwe, _ in code_model.sink_table()) + ") GROUP BY ALL",
    "sarif_rules": f"""WITH {FINDINGS_SQL}, x AS (SELECT *, {_SARIF_ID} AS id FROM f) SELECT id AS rule_id, arg_min(issue_name, db_id) AS name, arg_min({_LEVEL}, db_id) AS level, count(*) AS n_results FROM x GROUP BY 1""",
    "sarif_results": f"""WITH {FINDINGS_SQL} SELECT scan_id, db_id, json_object('ruleId', {_SARIF_ID}, 'level', {_LEVEL}, 'message', json_object('text', description), 'locations',
  json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', file_path), 'region', json_object('startLine', greatest(line, 1))))))::VARCHAR AS result FROM f""",
    "top_findings": f"WITH {FINDINGS_SQL} SELECT scan_id, db_id, severity FROM f QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY {RANK} DESC, db_id) <= 10",
    "stream_event_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
