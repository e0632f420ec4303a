"""Answers of models and tools: JSON taken out of text and repaired, mapped to findings, applied to findings.

Getting JSON out of damaged text needs a parser with state, so that part runs in Arrow batches;
everything after it is expressions and joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import scalars as fn
from tidewatch.functions.text import folded, trimmed
from tidewatch.operators.context import at_places

_FENCED_JSON = re.compile(r"```(?:json|JSON)\s*\n?([\s\S]*?)```")
_FENCED = re.compile(r"```[A-Za-z0-9]*\s*\n?([\s\S]*?)```")
_THINK = re.compile(r"<think>[\s\S]*?</think>")
_CLOSES = {"{": "}", "[": "]"}


def _bracketed(text: str) -> str:
    """From the first bracket to where it closes; to the end if it never does; empty without one."""
    start = next((i for i, ch in enumerate(text) if ch in _CLOSES), -1)
    if start < 0:
        return ""
    depth, quoted, i = 0, False, start
    while i < len(text):
        ch = text[i]
        if quoted:
            if ch == "\\":
                i += 1
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
        i += 1
    return text[start:]


def extract(text: str) -> str:
    """The JSON in a model's answer: a json fence, else the last fence with a bracket in it, else what the brackets hold; thoughts left out."""
    t = _THINK.sub("", text)
    if m := _FENCED_JSON.search(t):
        return m[1].strip()
    for m in reversed(list(_FENCED.finditer(t))):
        if m[1].lstrip()[:1] in ("{", "["):
            return m[1].strip()
    return _bracketed(t).strip()


def repair(text: str) -> str:
    """Well-formed text where it can be told: raw line ends and bad escapes in strings, quotes inside them, commas before a closing bracket, open strings and brackets."""
    out: list[str] = []
    open_: list[str] = []
    quoted, i, n = False, 0, len(text)
    while i < n:
        ch = text[i]
        if quoted:
            if ch == "\\":
                nxt = text[i + 1 : i + 2]
                if nxt and nxt in '"\\/bfnrt':
                    out.append(ch + nxt)
                    i += 2
                    continue
                if nxt == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                    out.append(text[i : i + 6])
                    i += 6
                    continue
                out.append("\\\\" if nxt else "")
            elif ch == '"':
                # A string ends where what follows it may follow a string.
                k = i + 1
                while k < n and text[k].isspace():
                    k += 1
                if k >= n or text[k] in ",:}]":
                    quoted = False
                    out.append(ch)
                else:
                    out.append('\\"')
            elif ch in "\n\r\t":
                out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[ch])
            else:
                out.append(ch)
            i += 1
            continue
        if ch == '"':
            quoted = True
        elif ch in "{[":
            open_.append(ch)
        elif ch in "}]":
            k = len(out) - 1
            while k >= 0 and out[k].isspace():
                k -= 1
            if k >= 0 and out[k] == ",":
                del out[k]
            if open_ and _CLOSES[open_[-1]] == ch:
                open_.pop()
        out.append(ch)
        i += 1
    if quoted:
        out.append('"')
    tail = "".join(out).rstrip()
    while open_:
        tail = tail.rstrip().rstrip(",")
        if tail.endswith(":"):
            tail += "null"
        tail += _CLOSES[open_.pop()]
    return tail


def parsed(text: str | None) -> str | None:
    """The JSON of an answer as well-formed text; None if there is none even after repair."""
    if not text:
        return None
    found = extract(text)
    for t in (found, repair(found)):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False)
        except (ValueError, RecursionError):
            continue
    return None


def _with(df: DataFrame, *texts: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(c, T.StringType()) for c in texts]])


def with_json(df: DataFrame, column: str, out: str = "json") -> DataFrame:
    """``out``: the JSON found in ``column`` (null if none). Other columns stay."""
    schema = _with(df, out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [parsed(t) if isinstance(t, str) else None for t in b[column]]})

    return df.mapInPandas(run, schema)


def generated(prompts: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """``answer`` of a model to each row's ``prompt`` in Arrow batches; a failing call gives a null answer and its error. The callable is the caller's: a client, or a table of recorded answers."""
    schema = _with(prompts, "answer", "error")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got, errors = [], []
            for p in b["prompt"]:
                try:
                    got.append(answer(p))
                    errors.append(None)
                except Exception as e:  # a client's failure is a row, not the job's end
                    got.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(answer=got, error=errors)

    return prompts.mapInPandas(run, schema)


# --- tool reports -------------------------------------------------------------------------------

SCANNER_REPORT = "struct<results: array<struct<check_id: string, path: string, start: struct<line: int>, end: struct<line: int>, extra: struct<message: string>, severity: string>>>"
IMAGE_REPORT = "struct<Results: array<struct<Vulnerabilities: array<struct<VulnerabilityID: string, Title: string, Description: string, Severity: string, PkgName: string, InstalledVersion: string, FixedVersion: string>>>>>"


def scanner_findings(reports: DataFrame, blocked: tuple[str, ...] = ()) -> DataFrame:
    """Findings of a pattern scanner's JSON ``report`` (results with check_id, path, lines, message, severity); other columns stay. Damaged reports give none."""
    keep = [c for c in reports.columns if c != "report"]
    r = reports.select(*keep, F.explode(F.from_json("report", SCANNER_REPORT)["results"]).alias("r"))
    r = r.filter(~F.coalesce("r.check_id", F.lit("")).isin(*blocked)) if blocked else r
    first, last = F.coalesce("r.start.line", F.lit(0)), F.coalesce("r.end.line", F.lit(0))
    return r.select(
        *keep,
        fn.rule_path_name(F.col("r.check_id")).alias("issue_name"),
        F.col("r.path").alias("file_path"),
        F.col("r.extra.message").alias("description"),
        fn.tool_severity(F.col("r.severity")).alias("severity"),
        F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string"))).alias("line_number"),
        F.col("r.check_id").alias("rule_id"),
        F.lit("No").alias("ai_validated"),
    )


def image_findings(reports: DataFrame) -> DataFrame:
    """Critical and high vulnerabilities of an image scanner's JSON ``report`` with its ``image``; other columns stay."""
    keep = [c for c in reports.columns if c != "report"]
    results = reports.select(*keep, F.explode(F.from_json("report", IMAGE_REPORT)["Results"]).alias("x"))
    v = results.select(*keep, F.explode("x.Vulnerabilities").alias("v"))
    sev = F.lower("v.Severity")
    return v.filter(sev.isin("critical", "high")).select(
        *keep,
        F.concat(F.lit("FROM "), F.col("image")).alias("file_path"),
        F.col("v.VulnerabilityID").alias("rule_id"),
        F.concat(F.lit("[TRIVY] "), F.col("v.VulnerabilityID"), F.lit(" in "), F.col("v.PkgName")).alias("issue_name"),
        sev.alias("severity"),
        F.lit("CWE-1104").alias("cwe"),
        F.when(sev == "critical", 0.95).otherwise(0.85).alias("confidence"),
        F.col("v.PkgName").alias("package_name"),
        F.col("v.InstalledVersion").alias("installed_version"),
        F.col("v.FixedVersion").alias("fixed_version"),
    )


def discovered(discoveries: DataFrame) -> DataFrame:
    """Discovery answers as findings: severity folded, CWE and OWASP in one form, source ``ai-discovery``; each id once."""
    d = discoveries.filter(F.col("discovery_id").isNotNull()).dropDuplicates(["discovery_id"])
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("issue_name", "file_path", "description", "remediation", "exploit_poc", "fixed_code_snippet", "vulnerable_code")}
    return d.select(
        "discovery_id", "scan_id", text["issue_name"].alias("issue_name"), text["file_path"].alias("file_path"), text["description"].alias("description"), folded(F.col("severity")).alias("severity"),
        F.coalesce("line_number", F.lit(0)).cast("string").alias("line_number"), text["remediation"].alias("remediation"), text["exploit_poc"].alias("exploit_poc"),
        F.coalesce(fn.cwe_id(F.col("cwe")), F.lit("")).alias("cwe"), F.coalesce(fn.owasp_label(F.col("owasp")), F.lit("")).alias("owasp"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        text["fixed_code_snippet"].alias("fixed_code"), trimmed(text["vulnerable_code"]).alias("vulnerable_pattern"), F.lit("ai-discovery").alias("source"), F.lit("Discovered by AI").alias("ai_validated"),
    )


# --- verdicts -----------------------------------------------------------------------------------

VERDICTS = "struct<findings: array<struct<master_id: long, duplicate_ids: array<long>, verdict: string, reason: string, final_severity: string, simplified_name: string>>>"


def verdicts_of(answers: DataFrame) -> DataFrame:
    """One row a verdict of judge answers (``json`` as ``with_json`` gives it; other columns stay). ``nth``: place in the answer."""
    keep = [c for c in answers.columns if c != "json"]
    return answers.select(*keep, F.posexplode(F.from_json("json", VERDICTS)["findings"]).alias("nth", "v")).select(*keep, "nth", "v.*")


def judged(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings (db_id, issue_name, severity, source, ai_validated, ai_reasoning) after the judge's verdicts.

    A dropped master goes with its duplicates, unless another verdict keeps it; duplicates of a
    kept master go, their sources and confirmation pass to it; the master takes the verdict's
    severity and name and counts as confirmed. Findings no verdict speaks of stay as they are.
    Of several verdicts on one master the last one kept counts.
    """
    found = found.select("db_id", "issue_name", "severity", "source", "ai_validated", "ai_reasoning")
    v = verdicts.filter(F.col("master_id").isNotNull()).withColumn("drop", F.coalesce(F.col("verdict"), F.lit("")) == "drop")
    v = v.groupBy("master_id", "drop").agg(F.max_by(F.struct("reason", "final_severity", "simplified_name"), "nth").alias("x"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("duplicate_ids", F.array().cast("array<long>"))))).alias("duplicate_ids"))
    kept = v.filter(~F.col("drop"))
    dups = kept.select("master_id", F.explode("duplicate_ids").alias("db_id"))
    gone = dups.select("db_id").unionByName(v.filter("drop").select(F.explode(F.concat(F.array("master_id"), "duplicate_ids")).alias("db_id"))).distinct()
    gone = gone.join(kept.select(F.col("master_id").alias("db_id")), "db_id", "left_anti")
    of_dups = dups.join(found.select("db_id", "source", "ai_validated"), "db_id").groupBy("master_id").agg(F.array_sort(F.collect_set("source")).alias("more"), F.max((F.col("ai_validated") == "Yes").cast("int")).alias("yes"))
    m = kept.select(F.col("master_id").alias("db_id"), "x.*").join(of_dups.withColumnRenamed("master_id", "db_id"), "db_id", "left").withColumn("kept", F.lit(True))
    x = found.join(gone, "db_id", "left_anti").join(m, "db_id", "left")
    k = F.coalesce("kept", F.lit(False))
    new_sources = F.filter(F.coalesce("more", F.array().cast("array<string>")), lambda s: ~F.col("source").contains(s))
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    confirmed = k & ((F.coalesce("yes", F.lit(0)) == 1) | ~F.col("ai_validated").contains("Discovered"))
    return x.select(
        "db_id",
        F.when(k & given("simplified_name"), F.col("simplified_name")).otherwise(F.col("issue_name")).alias("issue_name"),
        F.when(k & given("final_severity"), F.col("final_severity")).otherwise(F.col("severity")).alias("severity"),
        F.array_join(F.concat(F.array("source"), new_sources), ", ").alias("source"),
        F.when(confirmed, "Yes").otherwise(F.col("ai_validated")).alias("ai_validated"),
        F.when(k & ~given("ai_reasoning") & given("reason"), F.concat(F.lit("AI Judge: "), "reason")).otherwise(F.col("ai_reasoning")).alias("ai_reasoning"),
        k.alias("judged"),
    )


def related_files(found: DataFrame, files: DataFrame, most: int = 2) -> DataFrame:
    """db_id, related_path, nth: up to ``most`` other files whose base name the description or a step of the path names.

    Names are met by equality: every token of the texts that looks like a file name, against base
    names; files of one name are ranked by path. No comparison of all findings with all files.
    """
    named = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "description", F.array_join(F.coalesce("exploit_path", F.array().cast("array<string>")), " ")), F.lit(r"[\w.+-]+\.\w+"), 0))
    tokens = found.select("db_id", "file_path", F.explode(named).alias("base"))
    base = files.select(F.col("file_path").alias("related_path"), F.element_at(F.split("file_path", "/"), -1).alias("base")).distinct()
    # Only the first few files of a name can be chosen: one more than asked for, as the finding's own file does not count.
    base = base.withColumn("r", F.row_number().over(W.partitionBy("base").orderBy("related_path"))).filter(F.col("r") <= most + 1).drop("r")
    x = tokens.join(base, "base").filter(F.col("related_path") != F.col("file_path")).select("db_id", "related_path").distinct()
    return x.withColumn("nth", F.row_number().over(W.partitionBy("db_id").orderBy("related_path"))).filter(F.col("nth") <= most)


def breaker(outcomes: DataFrame, group: str, order: str, failed: str, after: int = 3) -> DataFrame:
    """``skipped``: whether ``after`` failures in a row stood before this row in its group (nothing runs after that)."""
    w = W.partitionBy(group).orderBy(order)
    last = w.rowsBetween(-(after - 1), 0)
    streak = (F.sum(F.col(failed).cast("int")).over(last) == after) & (F.count("*").over(last) == after)
    tripped = F.coalesce(F.max(F.col("__streak").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    return outcomes.withColumn("__streak", streak).withColumn("skipped", tripped).drop("__streak")


def code_window(files: DataFrame, places: DataFrame, whole: int = 500, reach: int = 150, first: int = 300) -> DataFrame:
    """file_path, line_no, from_line, to_line, window: what of a file is shown with a finding: all of a short one, else the lines around its line, else the first ones."""
    x = at_places(files, places.select("file_path", "line_no")).withColumn("n", F.size("lines"))

    def span(p: Column) -> Column:
        short = F.col("n") <= whole
        lo = F.when(short | (p["line_no"] <= 0), 1).otherwise(F.greatest(p["line_no"] - reach, F.lit(1)))
        hi = F.when(short, F.col("n")).when(p["line_no"] <= 0, F.least("n", F.lit(first))).otherwise(F.least("n", p["line_no"] + reach))
        return F.struct(p["line_no"].alias("line_no"), F.least(lo, F.col("n")).alias("from_line"), hi.alias("to_line"))

    s = x.select("file_path", "lines", F.explode(F.transform("places", span)).alias("s"))
    return s.select("file_path", "s.*", F.array_join(F.slice("lines", F.col("s.from_line"), F.greatest(F.col("s.to_line") - F.col("s.from_line") + 1, F.lit(0))), "\n").alias("window"))


# What a model is shown (extensions and base names), and sizes in bytes between which a file is.
SHOWN_EXTENSIONS = (".py", ".js", ".ts", ".go", ".java", ".rb", ".php", ".cs", ".c", ".cpp", ".h", ".sh", ".bash", ".sql", ".dockerfile", ".tf", ".hcl", ".env", ".config", ".properties")
SHOWN_NAMES = ("dockerfile", "makefile", "vagrantfile", "gemfile", "rakefile")


def shown_files(files: DataFrame) -> DataFrame:
    """Files (file_path, content) worth a model's look: by extension or name, more than 50 and fewer than 10,000,000 bytes, 150 characters at least when trimmed."""
    base = F.lower(F.element_at(F.split("file_path", "/"), -1))
    ext = F.regexp_extract(base, r"(\.[^.]+)$", 1)
    size = F.octet_length("content")
    return files.filter((ext.isin(*SHOWN_EXTENSIONS) | base.isin(*SHOWN_NAMES)) & (size > 50) & (size < 10_000_000) & (F.length(F.trim("content")) >= 150))
