"""Declarative pattern rules over the line relation.

Rules are unrolled into literal predicates (one compiled pattern each, kept by Catalyst for
the whole scan) and a line yields its matching rules by one explode: no join of lines with
rules, no shuffle. A file is one row, so what stands around a match is a slice of the row's own
array of lines: contexts, scopes and negations need no exchange and no window either. Large rule
sets are data instead: see ``pattern_engine``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    languages: tuple[str, ...]
    patterns: tuple[str, ...]
    severity: str
    cwe: str = ""
    description: str = ""
    negatives: tuple[str, ...] = ()
    confidence: float = 0.0
    framework: str = ""


# Our own rules, written for the corpus languages (patterns in the subset that RE2 and Java read alike).
RULES = (
    Rule("tw-py-request-value", ("python",), (r"request\.args\.get\(",), "medium", "CWE-20", "possible injection of a request value"),
    Rule("tw-js-query-value", ("javascript", "typescript"), (r"(req|ctx)\.query\.[a-z_]+",), "medium", "CWE-79", "query value used", (r"throw new Error",)),
    Rule("tw-php-get-value", ("php",), (r"\$_GET\[",), "high", "CWE-89", "request value reaches the code", (r"empty\(",)),
    Rule("tw-java-parameter", ("java",), (r"getParameter\(",), "medium", "CWE-352", "parameter read", (r"== null",)),
    Rule("tw-go-form-value", ("go",), (r"\.FormValue\(",), "low", "CWE-918", "form value read"),
    Rule("tw-rb-params", ("ruby",), (r"params\[:[a-z_]+\]",), "low", "", "bypass of typed parameters"),
    Rule("tw-load-call", ("php", "java", "ruby", "python"), (r"(db|dao|Store)(->|\.)(load|fetch)\(",), "info", "", "data access", (r"limit",)),
    Rule("tw-log-call", ("java", "go", "python", "ruby", "javascript"), (r"(LOG|logger|log|console)\.(info|Printf|log)\(",), "", "CWE-532", "logs a value"),
    Rule("tw-docker-user", ("dockerfile",), (r"^USER root",), "high", "", "root user"),
    Rule("tw-secret-word", (), (r"(?i)(password|secret|api_key|token)\s*[:=]",), "critical", "CWE-798", "credential word assigned"),
)
# Ids of rules that are never run.
BLOCKED = (
    "js-json-escape", "js-redos-html-tag-regex", "js-redos-long-regex", "js-redos-alternation-overlap", "js-browser-clipboard-read", "gql-perf-unbatched-resolvers", "dart-environment-config", "js-type-coercion-equals",
    "supplychain-typosquatting-npm", "supplychain-typosquatting-pip", "supplychain-typosquatting-general", "supplychain-known-vulnerable-deps", "supplychain-missing-lockfile", "js-type-coercion-boolean", "js-type-coercion-plus",
    "generic-missing-security-headers", "ts-api-key-security", "ts-secrets-management", "lambda-high-timeout", "js-crypto-constant-time", "ts-timeout", "py-ssrf-timeout-missing", "java-servlet-http-servlet", "js-timing-attack-index-of",
    "gql-auth-jwt-weak-secret", "gql-auth-jwt-no-expiry", "js-error-file-path", "js-prototype-pollution-deep-freeze", "js-prototype-pollution-map-set", "js-prototype-pollution-immutable",
    "supplychain-pip-internal-public", "supplychain-gem-internal-public", "supplychain-nuget-internal-public", "race-token-generation-concurrent", "race-singleton-not-thread-safe", "race-coupon-redeem-concurrent", "race-lazy-init-without-sync",
    "race-db-increment-without-lock", "race-double-checked-locking-unsafe", "race-db-read-modify-write", "race-payment-concurrent-transaction", "race-auth-check-then-act",
    "express-missing-helmet", "express-no-rate-limiting", "supplychain-http-url", "supplychain-version-wildcard", "tw-log-call",
)
DEFAULT_CONFIDENCE = {"critical": 0.95, "high": 0.85, "medium": 0.70, "low": 0.50, "info": 0.40}
CRITICAL_CWES = ("CWE-78", "CWE-89", "CWE-94", "CWE-502", "CWE-287", "CWE-918", "CWE-798")
HIGH_CWES = ("CWE-79", "CWE-22", "CWE-352", "CWE-611", "CWE-942")
#: Lines before and after a match that a negative pattern is looked for in.
NEGATIVE_BEFORE, NEGATIVE_AFTER = 11, 9


def to_java(pattern: str) -> str:
    """An RE2 pattern for Java: POSIX classes, named groups, a bare bracket in a class, end anchor."""
    p = pattern.replace("[[:space:]]", r"\s").replace("(?P<", "(?<")
    p = re.sub(r"(?<!\\)\[((?:[^\]\\\[]|\\.)*)\[((?:[^\]\\]|\\.)*)\]", r"[\1\\[\2]", p)
    return re.sub(r"(?<!\\)\$$", r"\\z", p)


def without_blocked(rules: Sequence[Rule], blocked: Sequence[str] = BLOCKED) -> list[Rule]:
    return [r for r in rules if r.rule_id not in blocked]


def _applies(rule: Rule) -> Column:
    hit = F.lit(False)
    for p in rule.patterns:
        hit = hit | F.col("line").rlike(to_java(p))
    return F.col("syntax").isin(*rule.languages) & hit if rule.languages else hit


def scan(lines: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """file_path, line_no, line, rule_id: each matching rule of each line once."""
    ids = F.array_compact(F.array(*[F.when(_applies(r), F.lit(r.rule_id)) for r in rules]))
    return lines.select("file_path", "line_no", "line", F.explode(ids).alias("rule_id"))


def scan_matches(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """file_path, rule_id, n_matches: matches of all of a rule's patterns on the whole text, several a line count each."""
    counts = F.array_compact(F.array(*[
        F.when(F.col("syntax").isin(*r.languages) if r.languages else F.lit(True), F.struct(F.lit(r.rule_id).alias("rule_id"), sum((F.size(F.regexp_extract_all("content", F.lit(to_java(p)), 0)) for p in r.patterns), F.lit(0)).alias("n_matches")))
        for r in rules
    ]))
    return files.select("file_path", F.inline(counts)).filter("n_matches > 0")


def lines_of(content: Column | str) -> Column:
    return F.split(content, "\n")


def around(lines: Column, at: Column, before: int, after: int) -> Column:
    """The lines (array) from ``before`` above line ``at`` to ``after`` below it, as far as there are any."""
    first = F.greatest(at - before, F.lit(1))
    return F.slice(lines, first, at + after - first + 1)


def context_hits(lines: Column, at: Column, before: int, after: int, pattern: str) -> Column:
    """Whether a pattern matches the text around a line, line ends included."""
    return F.array_join(around(lines, at, before, after), "\n").rlike(to_java(pattern))


def _line_ids(rules: Sequence[Rule], line: Column) -> Column:
    ids = []
    for r in rules:
        hit = F.lit(False)
        for p in r.patterns:
            hit = hit | line.rlike(to_java(p))
        ids.append(F.when(F.col("syntax").isin(*r.languages) & hit if r.languages else hit, F.lit(r.rule_id)))
    return F.array_compact(F.array(*ids))


def scan_with_negation(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``scan`` of files (file_path, syntax, content) without matches around which one of the rule's negative patterns hits."""
    x = files.select("file_path", "syntax", lines_of("content").alias("lines"))
    found = F.flatten(F.transform("lines", lambda line, i: F.transform(_line_ids(rules, line), lambda r: F.struct((i + 1).alias("line_no"), line.alias("line"), r.alias("rule_id")))))
    x = x.select("file_path", "lines", found.alias("found"))

    def kept(h: Column) -> Column:
        bad = F.lit(False)
        for r in rules:
            for p in r.negatives:
                bad = bad | ((h["rule_id"] == r.rule_id) & context_hits(F.col("lines"), h["line_no"], NEGATIVE_BEFORE, NEGATIVE_AFTER, p))
        return ~bad

    return x.select("file_path", F.inline(F.filter("found", kept)))


def severity_of(cwe: Column, text: Column, severity: Column) -> Column:
    """Severity by CWE class, else by words of the text (substring tests), else as given (medium if empty)."""
    c, t = F.upper(F.coalesce(cwe, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    strong = t.contains("rce") | t.contains("injection") | t.contains("bypass")
    hedged = t.contains("potential") | t.contains("possible")
    s = F.lower(F.coalesce(severity, F.lit("")))
    return F.when(c.isin(*CRITICAL_CWES), "critical").when(c.isin(*HIGH_CWES), "high").when(strong & ~hedged, "critical").when(strong, "high").when(s == "", "medium").otherwise(s)


def default_confidence(severity: Column) -> Column:
    out = F.lit(0.60)
    for s, v in DEFAULT_CONFIDENCE.items():
        out = F.when(severity == s, v).otherwise(out)
    return out


def findings(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rule matches of files as findings: severity by CWE and text, default confidence by the rule's own severity, below 0.3 info."""
    spark = files.sparkSession
    rows = [(r.rule_id, r.severity, r.cwe, r.description, r.confidence) for r in without_blocked(rules)]
    meta = spark.createDataFrame(rows, "rule_id string, rule_severity string, cwe string, description string, given double")
    m = scan_with_negation(files, without_blocked(rules)).join(F.broadcast(meta), "rule_id")  # one row a rule
    conf = F.when(F.col("given") > 0, F.col("given")).otherwise(default_confidence(F.col("rule_severity")))
    sev = severity_of(F.col("cwe"), F.concat_ws(" ", "description", "rule_id"), F.col("rule_severity"))
    return m.select("file_path", "line_no", "rule_id", "description", "cwe", conf.alias("confidence"), F.when(conf < 0.3, "info").otherwise(sev).alias("severity"))


@dataclass
class Find:
    """A parsed FIND query."""

    find: str
    scope: str = "source"
    where: str | None = None
    unless: str | None = None
    raw: str = field(default="", compare=False)


def parse_find(query: str) -> Find:
    """FIND re [IN source|function|class|import] [WHERE re] [AND NOT re]; words in any case.

    Clauses are cut off from the end by their first occurrence: AND NOT, then WHERE, then IN.
    Raises ValueError for an empty query, a query without FIND and a pattern that does not compile.
    """
    rest = query.replace("\n", " ").strip()
    if not rest:
        raise ValueError("empty query")
    if not rest.upper().startswith("FIND "):
        raise ValueError(f"a query starts with FIND: {query!r}")
    rest = rest[5:]
    parts: dict[str, str] = {}
    for word in (" AND NOT ", " WHERE ", " IN "):
        at = rest.upper().find(word)
        if at >= 0:
            parts[word.strip()] = rest[at + len(word) :].strip()
            rest = rest[:at].strip()
    rest = rest.strip()
    if not rest:
        raise ValueError("no FIND pattern")
    for p in (rest, parts.get("WHERE"), parts.get("AND NOT")):
        if p is not None:
            try:
                re.compile(p)
            except re.error as e:
                raise ValueError(f"invalid pattern {p!r}: {e}") from None
    return Find(rest, parts.get("IN", "source").lower(), parts.get("WHERE"), parts.get("AND NOT"), query)


SCOPES = {
    "function": (r"(?i)(func |def |function |public |private |protected )", 29),
    "class": (r"(?i)(class |struct |interface )", 49),
}
IMPORT = r"(?i)^(import |require\(|from |use |#include)"
CONTEXT = 5


def find_lines(files: DataFrame, query: str) -> DataFrame:
    """file_path, line_no of the lines a FIND query hits; WHERE and AND NOT look at the text from five lines above to five below."""
    q = parse_find(query)
    x = files.select("file_path", lines_of("content").alias("lines"))
    numbered = F.transform("lines", lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    x = x.select("file_path", "lines", F.filter(numbered, lambda h: h["line"].rlike("(?i)" + to_java(q.find))).alias("found"))

    def bare(line: Column) -> Column:
        return F.btrim(line, F.lit(" \t\r"))

    def kept(h: Column) -> Column:
        ok = F.lit(True)
        if q.scope in SCOPES:
            pattern, above = SCOPES[q.scope]
            ok = F.exists(around(F.col("lines"), h["line_no"], above, 0), lambda line: bare(line).rlike(pattern))
        elif q.scope == "import":
            ok = bare(h["line"]).rlike(IMPORT)
        for text, wanted in ((q.where, True), (q.unless, False)):
            if text is not None:
                hit = context_hits(F.col("lines"), h["line_no"], CONTEXT, CONTEXT, "(?i)" + text)
                ok = ok & (hit if wanted else ~hit)
        return ok

    return x.select("file_path", F.explode(F.filter("found", kept)).alias("h")).select("file_path", "h.line_no")
