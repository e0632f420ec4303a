"""Export shapes: SARIF, CycloneDX, CSV, compliance, comments, top lists.

Documents come as ordered pieces, one row a rule, result or line: nothing of a scan's size is one value or comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.scalars import package_of, path_cell, version_of
from tidewatch.functions.text import folded, start_line
from tidewatch.operators.findings import is_test_file, severity_rank


def level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def rule_key() -> Column:
    return F.when(F.col("rule_id") != "", F.col("rule_id")).otherwise(F.replace(F.lower("issue_name"), F.lit(" "), F.lit("-")))


def sarif_rules(f: DataFrame) -> DataFrame:
    """Rule catalogue: each id once with name and level of its first finding."""
    x = f.withColumn("id", rule_key())
    first = F.min_by(F.struct(F.col("issue_name").alias("name"), level(F.col("severity")).alias("level")), "db_id")
    return x.groupBy("id").agg(first.alias("s"), F.count("*").alias("n_results")).select(F.col("id").alias("rule_id"), "s.name", "s.level", "n_results")


def sarif_results(f: DataFrame) -> DataFrame:
    """One SARIF result object (JSON) a finding."""
    loc = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    obj = F.struct(rule_key().alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(loc).alias("locations"))
    return f.select("scan_id", "db_id", F.to_json(obj).alias("result"))


def sbom_components(packages: DataFrame) -> DataFrame:
    """CycloneDX component objects (JSON), each name and version once."""
    kind = {"npm": "npm", "PyPI": "pypi", "Go": "golang", "Maven": "maven", "RubyGems": "gem", "Packagist": "composer", "crates.io": "cargo"}
    p = packages.groupBy("name", "version").agg(F.min("ecosystem").alias("ecosystem"))
    purl = F.concat(F.lit("pkg:"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kind.items() for x in kv]), F.col("ecosystem")), F.lit("generic")), F.lit("/"), F.col("name"), F.when(F.col("version") != "", F.concat(F.lit("@"), F.col("version"))).otherwise(""))
    return p.select("name", "version", F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", purl.alias("purl"))).alias("component"))


# The columns of the CSV report, and the titles of its second and third section.
CSV_HEADER = (
    "Sr. No.", "Issue name", "File name / file path", "Description of the issue", "Severity", "Line number", "CWE", "OWASP", "Confidence", "Trust Score", "Source",
    "AI validated (yes/no)", "AI Reasoning", "Remediation", "Code Snippet", "Secure Fix", "Exploit PoC", "Taint Flow",
)
CSV_SECTIONS = ("", "=== POTENTIALLY UNREACHABLE (TEST FILES / LOW CONFIDENCE) ===", "=== MANUAL REVIEW — POTENTIAL FALSE POSITIVES ===")


def report_rows(findings: DataFrame, phase: str = "final") -> DataFrame:
    """Finding rows with all that reports show, as delivered: each db_id once, no nulls in text."""
    f = findings.filter(folded(F.col("phase")) == phase).dropDuplicates(["db_id"])
    text = ("issue_name", "file_path", "description", "severity", "line_number", "cwe", "owasp", "source", "ai_validated", "ai_reasoning", "remediation", "code_snippet", "fixed_code", "exploit_poc", "rule_id", "vulnerable_pattern", "status")
    none = F.lit(0.0)
    return f.select(
        "db_id", F.coalesce("scan_id", F.lit("")).alias("scan_id"), F.coalesce("sr_no", F.lit(0)).alias("sr_no"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in text],
        *[F.when(F.isnan(c), none).otherwise(F.coalesce(F.col(c), none)).alias(c) for c in ("confidence", "trust_score")], F.coalesce("exploit_path", F.array().cast("array<string>")).alias("exploit_path"),
    )


def percent(c: Column) -> Column:
    """Whole per cent (half to even), N/A where there is none."""
    return F.when(c > 0, F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))).otherwise("N/A")


def csv_rows(f: DataFrame) -> DataFrame:
    """The 18 cells of each finding of ``report_rows`` with its section (1 reachable, 2 unreachable, 3 false positive)."""
    low_trust = (F.col("trust_score") > 0) & (F.col("trust_score") < 20)
    section = F.when(F.lower("ai_validated").contains("false positive"), 3).when(is_test_file(F.col("file_path")) | low_trust, 2).otherwise(1)
    cells = (
        F.col("sr_no").cast("string"), "issue_name", "file_path", "description", "severity", "line_number", "cwe", "owasp", percent(F.col("confidence")), F.bround("trust_score", 0).cast("int").cast("string"), "source",
        "ai_validated", "ai_reasoning", "remediation", "code_snippet", "fixed_code", "exploit_poc", path_cell(F.col("exploit_path")),
    )
    return f.select("scan_id", "db_id", section.alias("section"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(cells, CSV_COLUMNS)])


CSV_COLUMNS = ("sr_no", "issue_name", "file_path", "description", "severity", "line_number", "cwe", "owasp", "confidence", "trust_score", "source", "ai_validated", "ai_reasoning", "remediation", "code_snippet", "secure_fix", "exploit_poc", "taint_flow")


def csv_lines(f: DataFrame) -> DataFrame:
    """scan_id, section, place, line: the lines of each scan's CSV report; sorted by section, place and db_id they are the file.

    A section after the first starts with a blank line, its title and the header again. Lines are
    rows: a scan of any size is never one value.
    """
    rows = csv_rows(f)
    quoted = [F.when(F.col(c).rlike(r'[",\n\r]|^\s'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c)) for c in CSV_COLUMNS]
    body = rows.select("scan_id", "section", F.lit(3).alias("place"), "db_id", F.concat_ws(",", *quoted).alias("line"))
    header = ",".join(CSV_HEADER)
    blank = "," * (len(CSV_HEADER) - 1)
    used = rows.select("scan_id", "section").unionByName(rows.select("scan_id", F.lit(1).alias("section"))).distinct()
    title = F.element_at(F.array(*map(F.lit, CSV_SECTIONS)), F.col("section"))
    heads = F.array_compact(F.array(
        F.when(F.col("section") > 1, F.struct(F.lit(0).alias("place"), F.lit(blank).alias("line"))), F.when(F.col("section") > 1, F.struct(F.lit(1).alias("place"), F.concat(title, F.lit(blank)).alias("line"))), F.struct(F.lit(2).alias("place"), F.lit(header).alias("line")),
    ))
    top = used.select("scan_id", "section", F.inline(heads)).select("scan_id", "section", "place", F.lit(0).cast("long").alias("db_id"), "line")
    return top.unionByName(body)


def _help(cwe: Column) -> Column:
    return F.when(cwe != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.regexp_replace(cwe, "^CWE-", ""), F.lit(".html"))).otherwise("")


def sarif_parts(f: DataFrame, tool: str = "tidewatch") -> DataFrame:
    """scan_id, section, part, text: a SARIF 2.1.0 log of each scan in pieces; in the order of section and part they are the document.

    Sections: 0 head, 1 rules (each id once, by its first finding), 2 between, 3 results, 4 tail.
    Each rule and each result is a piece of its own, so a scan of any size is never one value.
    """
    x = f.withColumn("rule", rule_key())
    first = F.min_by(F.struct("issue_name", "description", "cwe", "owasp", F.lower("severity").alias("severity")), "db_id")
    r = x.groupBy("scan_id", "rule").agg(first.alias("s"), F.min("db_id").alias("part"))
    tags = F.filter(F.array("s.cwe", "s.owasp"), lambda t: t != "")
    rule = F.struct(
        F.col("rule").alias("id"), F.col("s.issue_name").alias("name"), F.struct(F.col("s.issue_name").alias("text")).alias("shortDescription"), F.struct(F.col("s.description").alias("text")).alias("fullDescription"),
        _help(F.col("s.cwe")).alias("helpUri"), F.struct(F.col("s.severity").alias("severity"), tags.alias("tags")).alias("properties"),
    )
    uri = F.regexp_replace(F.translate("file_path", "\\", "/"), "^/", "")
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(F.greatest(start_line(F.col("line_number")), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    message = F.concat("description", F.when(F.col("remediation") != "", F.concat(F.lit(" Remediation: "), "remediation")).otherwise(""))
    more = F.struct(F.col("ai_validated").alias("aiValidated"), F.col("trust_score").alias("trustScore"), "source", "owasp", F.col("exploit_poc").alias("exploitPoC"), F.col("fixed_code").alias("fixedCode"))
    result = F.struct(F.col("rule").alias("ruleId"), level(F.lower("severity")).alias("level"), F.struct(message.alias("text")).alias("message"), F.array(place).alias("locations"), more.alias("properties"))
    pieces = r.select("scan_id", F.lit(1).alias("section"), "part", F.to_json(rule).alias("text")).unionByName(x.select("scan_id", F.lit(3).alias("section"), F.col("db_id").alias("part"), F.to_json(result).alias("text")))
    lowest = x.groupBy("scan_id").agg(F.min("db_id").alias("lowest"))
    pieces = pieces.join(lowest, "scan_id").select("scan_id", "section", "part", F.when(F.col("part") > F.col("lowest"), F.concat(F.lit(","), "text")).otherwise(F.col("text")).alias("text"))
    head = '{"version":"2.1.0","$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json","runs":[{"tool":{"driver":{"name":"' + tool + '","rules":['
    frame = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(0).cast("long").alias("part"), F.lit(t).alias("text")) for n, t in ((0, head), (2, ']}},"results":['), (4, "]}]}"))])
    return lowest.select("scan_id", F.inline(frame)).unionByName(pieces)


def sbom(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, vulnerabilities) of each scan's dependency findings, without those triaged away.

    A component stands once a scan and name, by its first finding; vulnerabilities are not merged.
    """
    live = f.filter(~folded(F.col("status")).isin("false_positive", "ignored")).withColumn("package", package_of(F.col("source"), F.col("vulnerable_pattern"), F.col("issue_name"))).filter("package <> ''")
    components = live.groupBy("scan_id", F.col("package").alias("name")).agg(F.min_by(version_of(F.col("vulnerable_pattern")), "db_id").alias("version"))
    vuln = live.filter((F.col("cwe") != "") | F.upper("issue_name").contains("CVE")).withColumn("id", F.when(F.col("rule_id") != "", F.col("rule_id")).otherwise(F.col("cwe")))
    return components.select("scan_id", F.lit("library").alias("type"), "name", "version"), vuln.filter("id <> ''").select("scan_id", "db_id", "id", "description", "severity")


def compliance(f: DataFrame, hits: DataFrame, controls: DataFrame) -> DataFrame:
    """scan_id and a framework's summary for each scan: controls passing and failing, findings (once a control), overall status.

    ``hits`` are (scan_id, control_id, severity) of active findings, ``controls`` the framework's
    control_id. A scan is non-compliant if a failing control has a critical or high finding.
    """
    n = controls.count()
    per = hits.groupBy("scan_id", "control_id").agg(F.count("*").alias("n"), F.max(F.col("severity").isin("critical", "high").cast("int")).alias("severe"))
    g = per.groupBy("scan_id").agg(F.count("*").alias("failing"), F.sum("n").alias("n"), F.max("severe").alias("severe"))
    x = f.select("scan_id").distinct().join(g, "scan_id", "left")
    failing = F.coalesce("failing", F.lit(0))
    return x.select("scan_id", F.lit(n).cast("long").alias("total_controls"), (F.lit(n) - failing).cast("long").alias("passing_controls"), failing.cast("long").alias("failing_controls"), F.coalesce("n", F.lit(0)).cast("long").alias("total_findings"), F.when(F.coalesce("severe", F.lit(0)) == 1, "non-compliant").otherwise("compliant").alias("overall_status"))


def inline_comments(f: DataFrame, most: int = 20) -> DataFrame:
    """scan_id, file_path, line, body: comments on the first ``most`` places with a critical or high finding (a top-k report); one a place, its first finding."""
    live = f.filter(F.col("severity").isin("critical", "high") & ~F.col("status").isin("false_positive", "ignored") & (F.col("line") > 0))
    one = live.groupBy("scan_id", "file_path", "line").agg(F.min_by(F.struct("severity", "issue_name", "description", "remediation", "rule_id", "cwe"), "db_id").alias("s"), F.min("db_id").alias("db_id"))
    w = W.partitionBy("scan_id").orderBy("db_id")
    body = F.concat(F.lit("**"), F.upper("s.severity"), F.lit(": "), "s.issue_name", F.lit("**\n\n"), "s.description", F.lit("\n\n**Remediation:** "), "s.remediation", F.lit("\n\n_Rule: `"), "s.rule_id", F.lit("` | "), "s.cwe", F.lit("_"))
    return one.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select("scan_id", "file_path", "line", body.alias("body"))


def notice_counts(f: DataFrame) -> DataFrame:
    """Counts of a scan's active findings for a notice: critical, high, medium, low, and the rest as info."""
    a = f.filter(~F.col("status").isin("false_positive", "ignored")).groupBy("scan_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")], F.count("*").alias("total"))
    return a.withColumn("info", F.col("total") - F.col("critical") - F.col("high") - F.col("medium") - F.col("low"))


def top_per_scan(f: DataFrame, n: int) -> DataFrame:
    """The n most severe findings of each scan, ties by id (a group limit: Spark keeps n rows a task before the exchange)."""
    w = W.partitionBy("scan_id").orderBy(severity_rank(F.col("severity")).desc(), "db_id")
    return f.select("scan_id", "db_id", "severity", F.row_number().over(w).alias("rn")).filter(F.col("rn") <= n).drop("rn")


def write_pieces(pieces: DataFrame, path: str, order: Sequence[str], text: str = "text") -> None:
    """Write a document's pieces as text files below ``path``, a folder a scan; a scan's files, in the order of their names, are the document."""
    keys = ["scan_id", *order]
    ordered = pieces.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("scan_id", F.col(text).alias("value")).write.mode("overwrite").partitionBy("scan_id").text(path)
