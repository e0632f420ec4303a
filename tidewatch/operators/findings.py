"""The relational tail over finding records: families, deduplication, recalibration, scores, roll-ups, gates.

Groups are keyed by file and line or family, aggregates are partial before any exchange. Ordered
folds become structural maxima (a winner by severity, description length and position), never a
collected list; the only windows run over the distinct lines of one file and family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import folded, root_path, start_line, trimmed
from tidewatch.operators.prefix import sorted_rank

SEVERITY_ORDER = ("info", "low", "medium", "high", "critical")

# Weakness family of a CWE, and of words in rule, name and description (first hit in this order).
CWE_FAMILIES = {
    "CWE-89": "SQLI", "CWE-564": "SQLI", "CWE-78": "CMDI", "CWE-77": "CMDI", "CWE-79": "XSS", "CWE-22": "PATH_TRAVERSAL", "CWE-23": "PATH_TRAVERSAL", "CWE-36": "PATH_TRAVERSAL",
    "CWE-502": "DESERIALIZATION", "CWE-798": "HARDCODED_SECRET", "CWE-259": "HARDCODED_SECRET", "CWE-321": "HARDCODED_SECRET", "CWE-330": "WEAK_RANDOM", "CWE-331": "WEAK_RANDOM", "CWE-338": "WEAK_RANDOM",
    "CWE-918": "SSRF", "CWE-1336": "TEMPLATE_INJECTION", "CWE-94": "TEMPLATE_INJECTION", "CWE-95": "TEMPLATE_INJECTION", "CWE-943": "NOSQL_INJECTION", "CWE-915": "MASS_ASSIGNMENT", "CWE-611": "XXE",
    "CWE-352": "CSRF", "CWE-98": "FILE_INCLUSION", "CWE-770": "RESOURCE_LIMIT", "CWE-1321": "PROTOTYPE_POLLUTION", "CWE-20": "INPUT_VALIDATION",
}
WORD_FAMILIES = (
    ("NOSQL_INJECTION", ("nosql injection", "nosql")),
    ("SQLI", ("sql injection", "sqli", "sql query")),
    ("CMDI", ("command injection", "cmdi", "os.system", "runtime.exec", "subprocess")),
    ("TEMPLATE_INJECTION", ("ssti", "server side template", "template injection")),
    ("XSS", ("xss", "cross site scripting", "reflected xss", "stored xss")),
    ("PATH_TRAVERSAL", ("path traversal", "directory traversal", "sendfile", "path join")),
    ("SSRF", ("ssrf", "server side request")),
    ("DESERIALIZATION", ("deserialization", "pickle", "unserialize", "readobject", "objectinputstream")),
    ("HARDCODED_SECRET", ("hardcoded secret", "hardcoded password", "hardcoded credential", "secret detected", "api key detected")),
    ("WEAK_RANDOM", ("weak random", "math.random", "predictable random", "insufficient entropy", "token generation")),
    ("PROTOTYPE_POLLUTION", ("prototype pollution",)),
    ("FILE_INCLUSION", ("file inclusion", "lfi", "rfi")),
    ("XXE", ("xxe", "xml external")),
    ("CSRF", ("csrf", "cross site request")),
    ("IDOR", ("idor", "insecure direct object")),
    ("MASS_ASSIGNMENT", ("mass assignment",)),
    ("COOKIE_SECURITY", ("cookie", "samesite", "httponly", "secure flag")),
    ("CORS_MISCONFIG", ("cors", "cross origin")),
    ("CACHE_MISCONFIG", ("cache", "pragma")),
    ("INSECURE_HEADER", ("header", "hsts", "security header")),
)
PROXIMITY = 15

# Controls of three frameworks with the CWEs that belong to them.
OWASP = (
    ("A01:2021", "Broken Access Control"), ("A02:2021", "Cryptographic Failures"), ("A03:2021", "Injection"), ("A04:2021", "Insecure Design"), ("A05:2021", "Security Misconfiguration"),
    ("A06:2021", "Vulnerable and Outdated Components"), ("A07:2021", "Identification and Authentication Failures"), ("A08:2021", "Software and Data Integrity Failures"),
    ("A09:2021", "Security Logging and Monitoring Failures"), ("A10:2021", "Server-Side Request Forgery"),
)
PCI = (("6.2", ("CWE-89", "CWE-78", "CWE-79", "CWE-94")), ("6.3", ("CWE-798", "CWE-327", "CWE-330")), ("6.4", ("CWE-79", "CWE-89", "CWE-352")), ("8.2", ("CWE-287", "CWE-307", "CWE-798")), ("8.6", ("CWE-778", "CWE-223")), ("4.2", ("CWE-326", "CWE-327", "CWE-311")))
NIST = (("AC-3", ("CWE-284", "CWE-285", "CWE-639")), ("AU-9", ("CWE-778", "CWE-223")), ("CM-6", ("CWE-16", "CWE-732")), ("IA-5", ("CWE-798", "CWE-257", "CWE-307")), ("SC-8", ("CWE-311", "CWE-319")), ("SC-28", ("CWE-312", "CWE-326")), ("SI-10", ("CWE-89", "CWE-78", "CWE-79", "CWE-20")))
# Attack technique by words of the issue name (first hit in this order), and its name.
MITRE = (
    ("T1190", ("sql injection",)), ("T1059", ("command injection", "os command", "exec(", "shell")), ("T1189", ("xss", "cross-site scripting")), ("T1078", ("hardcoded", "secret", "credential", "password", "api key", "token")),
    ("T1083", ("path traversal", "directory traversal", "lfi", "rfi")), ("T1190", ("ssrf",)), ("T1190", ("deserialization", "unserialize")), ("T1190", ("xxe", "xml external")), ("T1190", ("ldap injection",)),
    ("T1189", ("open redirect",)), ("T1552", ("insecure random", "weak random")),
)
TECHNIQUES = {'T1190': 'Exploit Public-Facing Application', 'T1059': 'Command and Scripting Interpreter', 'T1189': 'Drive-by Compromise', 'T1078': 'Valid Accounts', 'T1083': 'File and Directory Discovery', 'T1552': 'Unsecured Credentials'}


def _text(c: str) -> Column:
    return F.coalesce(trimmed(F.col(c)), F.lit(""))


def records(findings: DataFrame, phase: str = "final") -> DataFrame:
    """Finding rows in one spelling: each db_id once, no nulls in text, lower-case severity and status, start line, root path."""
    f = findings.filter(folded(F.col("phase")) == phase).dropDuplicates(["db_id"])
    status = folded(F.col("status"))
    return f.select(
        "db_id",
        F.coalesce("scan_id", F.lit("")).alias("scan_id"),
        _text("issue_name").alias("issue_name"),
        F.coalesce(root_path(F.col("file_path")), F.lit("")).alias("file_path"),
        _text("description").alias("description"),
        folded(F.col("severity")).alias("severity"),
        start_line(F.col("line_number")).alias("line"),
        _text("ai_validated").alias("ai_validated"),
        _text("remediation").alias("remediation"),
        _text("rule_id").alias("rule_id"),
        _text("source").alias("source"),
        F.upper(_text("cwe")).alias("cwe"),
        F.upper(_text("owasp")).alias("owasp"),
        F.when(F.isnan("confidence"), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.when(status == "", "open").otherwise(status).alias("status"),
    )


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), c).cast("int"), F.lit(0))


def family(f: DataFrame) -> Column:
    """Weakness family: by CWE, an unknown CWE itself, by words, else by rule or name."""
    cwe = F.when(F.col("cwe").startswith("CWE-"), F.col("cwe")).when(F.col("cwe").rlike(r"^(CWE )?\d+$"), F.concat(F.lit("CWE-"), F.regexp_extract("cwe", r"(\d+)", 1))).otherwise("")
    by_cwe = F.element_at(F.create_map(*[F.lit(x) for kv in CWE_FAMILIES.items() for x in kv]), cwe)
    words = F.translate(F.lower(F.concat_ws(" ", "rule_id", "issue_name", "description")), "-_", "  ")
    out = F.when(F.col("rule_id") != "", F.concat(F.lit("RULE:"), F.col("rule_id"))).otherwise(F.concat(F.lit("GENERIC:"), F.lower("issue_name")))
    for name, keys in reversed(WORD_FAMILIES):
        hit = F.lit(False)
        for k in keys:
            hit = hit | words.contains(k)
        out = F.when(hit, name).otherwise(out)
    return F.coalesce(by_cwe, F.when(cwe != "", cwe), out)


def engines(source: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(source, ","), lambda s: F.trim(s)), lambda s: s != "")))


def _fold(g, *extra: Column, position: tuple[str, ...] = ("db_id",)) -> DataFrame:
    """The ordered fold of merged findings as aggregates; earlier positions win ties.

    Severity, CWE and OWASP come from the first most severe row; name and description from the
    most severe row with the longest description; remediation from the one among them that has
    one; the rule id from the first row that has one.
    """
    rank = severity_rank(F.col("severity"))
    pos = F.struct(*position)
    before = [(-F.col(p)).alias(f"p{i}") for i, p in enumerate(position)]
    first_severe = F.max_by(F.struct("severity", "cwe", "owasp"), F.struct(rank.alias("r"), *before))
    longest = F.max_by(F.struct("issue_name", "description"), F.struct(rank.alias("r"), F.length("description").alias("n"), *before))
    advice = F.max_by("remediation", F.struct(rank.alias("r"), (F.col("remediation") != "").cast("int").alias("has"), F.length("description").alias("n"), *before))
    rule = F.min_by("rule_id", F.when(F.col("rule_id") != "", pos))
    return g.agg(
        F.count("*").alias("n_merged"),
        F.min("db_id").alias("db_id"),
        first_severe.alias("s"),
        longest.alias("l"),
        advice.alias("remediation"),
        F.coalesce(rule, F.lit("")).alias("rule_id"),
        F.max("confidence").alias("confidence"),
        F.when(F.max((F.col("ai_validated") == "Yes").cast("int")) == 1, "Yes").otherwise(F.min_by("ai_validated", pos)).alias("ai_validated"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(engines(F.col("source")))))), ", ").alias("source"),
        *extra,
    )


def _unfold(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n_merged", "db_id", F.col("s.severity").alias("severity"), F.col("s.cwe").alias("cwe"), F.col("s.owasp").alias("owasp"), F.col("l.issue_name").alias("issue_name"), F.col("l.description").alias("description"), "remediation", "rule_id", "confidence", "ai_validated", "source")


def exact_line_dedup(f: DataFrame) -> DataFrame:
    """Findings of one scan, file and line merged; rows without a line stay alone (key: their db_id)."""
    alone = F.when(F.col("line") <= 0, F.col("db_id")).otherwise(0)
    g = f.withColumn("alone", alone).groupBy("scan_id", "file_path", "line", "alone")
    return _unfold(_fold(g), "scan_id", "file_path", "line")


def proximity_clusters(f: DataFrame, proximity: int = PROXIMITY) -> DataFrame:
    """Gaps and islands over the rows ``exact_line_dedup`` left: those of one scan, file and family, a new cluster where the next line is more than ``proximity`` away (0 for secrets)."""
    x = f.withColumn("family", family(f))
    keys = ("scan_id", "file_path", "family")
    w = W.partitionBy(*keys).orderBy("line")
    gap = F.when(F.upper("family").rlike("SECRET|CREDENTIAL|HARDCODED"), 0).otherwise(proximity)
    lines = x.select(*keys, "line").distinct()
    lines = lines.withColumn("new", (F.col("line") - F.lag("line").over(w) > gap).cast("int")).withColumn("cluster", F.sum(F.coalesce("new", F.lit(0))).over(w)).drop("new")
    g = x.join(lines, [*keys, "line"]).groupBy(*keys, "cluster")
    folded_rows = _fold(g, F.min("line").alias("from_line"), F.max("line").alias("to_line"), position=("line", "db_id"))
    return _unfold(folded_rows.withColumnRenamed("cluster", "cluster_no"), *keys, "cluster_no", "from_line", "to_line")


def pipeline(raw: DataFrame) -> DataFrame:
    """The findings of all engines of a scan, merged, recalibrated, scored and numbered.

    ``raw`` is the union of the engines' records: rows of one line are merged, then near lines
    of one family; severities are corrected, trust scores given, and rows numbered per scan by
    severity, path, line and id.
    """
    merged = proximity_clusters(exact_line_dedup(raw)).withColumn("line", F.col("from_line"))
    r = recalibrated(merged)
    return numbered(r.withColumn("trust_score", trust_score(r)))


def recalibrated(f: DataFrame) -> DataFrame:
    """Ordered severity corrections by CWE and text; ``severity`` is replaced, ``old_severity`` kept."""
    low = F.lower(F.concat_ws(" ", "issue_name", "description", "rule_id"))
    steps = (
        ((F.col("cwe").isin("CWE-338", "CWE-330", "CWE-331") | low.contains("math.random") | low.contains("predictable random")), ("critical",), "high"),
        (((F.col("cwe") == "CWE-79") & ~low.contains("stored")), ("critical",), "high"),
        ((F.col("cwe") == "CWE-770"), ("medium", "high"), "low"),
        ((F.col("cwe") == "CWE-20"), ("critical",), "medium"),
        (((F.col("cwe") == "CWE-943") | low.contains("nosql")) & low.contains("req.body"), ("high",), "critical"),
        ((F.col("cwe").isin("CWE-1336", "CWE-94") | low.contains("template injection") | low.contains("ssti")), ("medium", "high"), "critical"),
        (((F.col("cwe") == "CWE-98") | low.contains("file inclusion") | low.contains("lfi")), ("info", "low"), "high"),
    )
    # A fold over the steps: nested when() columns would double in size with each step.
    rows = F.array(*[F.struct(cond.alias("hit"), F.array(*map(F.lit, frm)).alias("old"), F.lit(to).alias("new")) for cond, frm, to in steps])
    new = F.aggregate(rows, F.col("severity"), lambda acc, s: F.when(s["hit"] & F.array_contains(s["old"], acc), s["new"]).otherwise(acc))
    return f.withColumn("old_severity", F.col("severity")).withColumn("severity", new)


# Parts of a file (lower case) that show it serves the web.
WEB_MARKERS = (
    "$_get", "$_post", "$_request", "$_cookie", "$_server", "@app.route", "flask", "def index", "@app.get", "@app.post", "app.get(", "app.post(", "express()", "router.",
    "@requestmapping", "@getmapping", "@postmapping", "httpservlet",
)


def web_reachable(found: DataFrame, files: DataFrame) -> DataFrame:
    """Findings marked unreachable whose file serves the web: the mark goes (once), info and low become high; confidence stays."""
    low = F.lower("content")
    web = files.filter(F.exists(F.array(*map(F.lit, WEB_MARKERS)), lambda m: low.contains(m))).select("file_path").distinct().withColumn("web", F.lit(True))
    x = found.join(web, "file_path", "left")
    hit = F.coalesce("web", F.lit(False)) & F.col("description").contains("[UNREACHABLE]")
    at = F.instr("description", "[UNREACHABLE] ")
    text = F.when(at > 0, F.concat(F.substring(F.col("description"), F.lit(1), at - 1), F.substring(F.col("description"), at + F.lit(14), F.length("description")))).otherwise(F.col("description"))
    return x.withColumn("severity", F.when(hit & F.col("severity").isin("info", "low"), "high").otherwise(F.col("severity"))).withColumn("description", F.when(hit, text).otherwise(F.col("description"))).drop("web")


def trust_score(f: DataFrame) -> Column:
    """100 x confidence + 15 for each further engine (split at comma and blank) + 10 if confirmed, at most 100."""
    n = F.size(F.split("source", ", "))
    return F.least(F.lit(100.0), F.round(100 * F.col("confidence") + 15 * (n - 1) + F.when(F.col("ai_validated") == "Yes", 10).otherwise(0), 6))


# Parts of the paths of test files.
TEST_PATH = r"_test\.go|test\.js|test\.ts|spec\.js|spec\.ts|/test/|/tests/|/testdata/|/mock/|/mocks/|/fixture/|/__tests__/|/__mocks__/|/node_modules/|/__test__/|_test\.py|/test_|/spec/|/specs/|/fixtures/"


def is_test_file(path: Column) -> Column:
    return F.translate(F.lower(path), "\\", "/").rlike(TEST_PATH)


def bucket(f: DataFrame) -> Column:
    """false_positive, unreachable or reachable."""
    low_trust = (trust_score(f) > 0) & (trust_score(f) < 20)
    return F.when(F.lower("ai_validated").contains("false positive"), "false_positive").when(is_test_file(F.col("file_path")) | low_trust, "unreachable").otherwise("reachable")


def priority(f: DataFrame) -> DataFrame:
    """P0 to P3 by severity and confirmation; rejected findings drop out."""
    yes = F.col("ai_validated") == "Yes"
    p = F.when(F.col("severity") == "critical", F.when(yes, "P0").otherwise("P1")).when(F.col("severity") == "high", F.when(yes, "P1").otherwise("P2")).when((F.col("severity") == "medium") & yes, "P2").otherwise("P3")
    return f.filter(F.col("ai_validated") != "No (False Positive)").withColumn("priority", p)


def risk_score(f: DataFrame) -> DataFrame:
    """One row a scan: counts by severity, score (10, 5, 2 and 0.5 a finding, at most 100, cut to a whole number) and level."""
    known = [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "high", "medium", "low")]
    a = f.groupBy("scan_id").agg(*known, F.count_if(F.col("ai_validated") == "Yes").alias("ai_validated_count"), F.count("*").alias("total_findings"))
    a = a.withColumn("info_count", F.col("total_findings") - F.col("critical_count") - F.col("high_count") - F.col("medium_count") - F.col("low_count"))
    raw = F.least(F.lit(100.0), 10.0 * F.col("critical_count") + 5.0 * F.col("high_count") + 2.0 * F.col("medium_count") + 0.5 * F.col("low_count"))
    level = F.when(raw >= 75, "Critical Risk").when(raw >= 50, "High Risk").when(raw >= 25, "Medium Risk").otherwise("Low Risk")
    return a.withColumn("score", raw.cast("int")).withColumn("level", level)


def active(f: DataFrame) -> DataFrame:
    """Without findings triaged as false positive or ignored."""
    return f.filter(~F.col("status").isin("false_positive", "ignored"))


def policy_violations(f: DataFrame, fail_on: str = "high", limits: dict[str, int] | None = None) -> DataFrame:
    """scan_id, gate, severity, actual, limit_value: severities at or above ``fail_on`` and counts above their limits (-1: none)."""
    limits = {"critical": 0, "high": 5, "medium": -1, "low": -1, "total": 40} if limits is None else limits
    a = active(f)
    by = a.groupBy("scan_id", "severity").agg(F.count("*").alias("actual"))
    total = by.groupBy("scan_id").agg(F.lit("total").alias("severity"), F.sum("actual").alias("actual"))
    counts = by.unionByName(total)
    least = SEVERITY_ORDER.index(fail_on) if fail_on in SEVERITY_ORDER else 0
    order = F.greatest(severity_rank(F.col("severity")) - 1, F.lit(0))
    failed = counts.filter(order >= least).select("scan_id", F.lit(f"fail-on {fail_on}").alias("gate"), "severity", "actual", F.lit(0).alias("limit_value"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("severity"))
    over = counts.withColumn("limit_value", limit).filter((F.col("limit_value") >= 0) & (F.col("actual") > F.col("limit_value")))
    return failed.unionByName(over.select("scan_id", F.concat(F.lit("max-"), F.col("severity")).alias("gate"), "severity", "actual", "limit_value"))


def normal_cwe(c: Column) -> Column:
    x = F.regexp_extract(c, r"(CWE-\d+)", 1)
    return F.when(x == "", "N/A").otherwise(x)


def top_cwes(f: DataFrame, n: int = 15) -> DataFrame:
    x = f.groupBy(normal_cwe(F.col("cwe")).alias("cwe")).agg(F.count("*").alias("n_findings")).filter(F.col("cwe") != "N/A")
    return x.orderBy(F.desc("n_findings"), "cwe").limit(n)


def owasp_control(c: Column) -> Column:
    return F.regexp_extract(F.upper(c), r"(A(?:0[1-9]|10):2021)", 1)


def _roll_up(hits: DataFrame, controls: DataFrame) -> DataFrame:
    """hits: control_id, severity of each finding, pre-aggregated; controls without findings stay and pass."""
    a = hits.groupBy("control_id").agg(F.count("*").alias("n_findings"), F.max(F.when(severity_rank(F.col("severity")) > 0, F.struct(severity_rank(F.col("severity")).alias("r"), "severity"))).alias("m"))
    out = controls.join(a, "control_id", "left")
    return out.select("control_id", F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"), F.when(F.col("n_findings") > 0, "fail").otherwise("pass").alias("status"), F.coalesce("m.severity", F.lit("")).alias("severity"))


def compliance_owasp(f: DataFrame) -> DataFrame:
    spark = f.sparkSession
    controls = spark.createDataFrame([(i,) for i, _ in OWASP], "control_id string")
    return _roll_up(active(f).select(owasp_control(F.col("owasp")).alias("control_id"), "severity").filter("control_id <> ''"), controls)


def compliance_cwe(f: DataFrame, framework) -> DataFrame:
    """Controls by CWE substrings (``CWE-79`` also takes ``CWE-798``), a finding once a control."""
    spark = f.sparkSession
    controls = spark.createDataFrame([(i,) for i, _ in framework], "control_id string")
    ids = []
    for i, cwes in framework:
        hit = F.lit(False)
        for c in cwes:
            hit = hit | F.col("cwe").contains(c)
        ids.append(F.when(hit, i))
    return _roll_up(active(f).select(F.explode(F.array_compact(F.array(*ids))).alias("control_id"), "severity"), controls)


def technique(name: Column) -> Column:
    """First matching attack technique by words of the lower-case issue name; null if none."""
    out = F.lit(None).cast("string")
    for t, words in reversed(MITRE):
        hit = F.lit(False)
        for w in words:
            hit = hit | name.contains(w)
        out = F.when(hit, t).otherwise(out)
    return out


def with_technique(f: DataFrame) -> DataFrame:
    """``technique`` and, where there is one, the description with its id and name appended."""
    names = F.create_map(*[F.lit(x) for kv in TECHNIQUES.items() for x in kv])
    f = f.withColumn("technique", technique(F.lower("issue_name")))
    text = F.concat("description", F.lit("\n\nMITRE ATT&CK: "), "technique", F.lit(" - "), names[F.col("technique")])
    return f.withColumn("description", F.coalesce(text, "description"))


def numbered(f: DataFrame) -> DataFrame:
    """Sequential number inside the scan after the sort by severity, path, line, id."""
    return sorted_rank(f, ["scan_id"], [severity_rank(F.col("severity")).desc(), F.col("file_path"), F.col("line"), F.col("db_id")], "sr_no")


def batches(f: DataFrame, size: int) -> DataFrame:
    return numbered(f).withColumn("batch_no", F.floor((F.col("sr_no") - 1) / size))
