"""Large rule sets over whole files: one finding for each match, with its first and last line.

Rules are data. Each worker compiles the rules of a language once and finds, in one pass of an
Aho-Corasick automaton, which of the literals that a pattern cannot match without stand in a
file; only those patterns are run. Work grows with the text and its matches, not with files x
rules, and several-line patterns match as they are written. No exchange: a file is one row.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.context import strip_comments
from tidewatch.operators.findings import is_test_file
from tidewatch.operators.rules import BLOCKED, NEGATIVE_AFTER, NEGATIVE_BEFORE, Rule, default_confidence, severity_of

# What tells a framework in a manifest, and in a single file (by extensions; an empty pattern takes all of them).
IN_MANIFEST = {
    "django": r'(?i)"django"\s*[:=]|django-admin', "flask": r'(?i)"flask"\s*[:=]|from\s+flask', "fastapi": r'(?i)"fastapi"\s*[:=]|from\s+fastapi', "express": r"""(?i)"express"\s*[:=]|require\(['"]express['"]\)""",
    "spring": r"(?i)org\.springframework|spring-boot", "laravel": r'(?i)"laravel/framework"\s*[:=]|php\s+artisan', "rails": r"""(?i)gem\s+['"]rails['"]|rails/all""", "angular": r'(?i)"@angular/core"\s*[:=]|angular\.module',
    "react": r"""(?i)"react"\s*[:=]|from\s+['"]react['"]""", "vue": r"""(?i)"vue"\s*[:=]|from\s+['"]vue['"]""", "next_js": r'(?i)"next"\s*[:=]|next\.config', "nuxt_js": r'(?i)"nuxt"\s*[:=]|nuxt\.config',
    "svelte": r'(?i)"svelte"\s*[:=]|\.svelte', "go_web": r'(?i)"github\.com/gin-gonic/gin"|"github\.com/labstack/echo"|"github\.com/gofiber/fiber"',
}
MANIFESTS = ("package.json", "requirements.txt", "pom.xml", "go.mod", "gemfile", "composer.json")
JS = (".js", ".ts", ".jsx", ".tsx")
IN_FILE = {
    "svelte": (((".svelte",), ""),), "react": (((".jsx", ".tsx"), ""), (JS, r"(?i)import.*react|useState|useEffect|JSX")), "angular": ((JS, r"(?i)import.*@angular|@Component|@Injectable"),),
    "vue": (((".vue",), ""), (JS, r"(?i)import.*vue|defineComponent|<template")), "next_js": ((JS, r"(?i)import.*next/|getServerSideProps|getStaticProps"),), "nuxt_js": (((".vue", *JS), r"(?i)import.*nuxt|useNuxtApp"),),
    "laravel": (((".php",), ""),), "rails": (((".rb", ".erb"), ""),), "django": (((".py",), r"(?i)import.*django|from\s+django"),), "flask": (((".py",), r"(?i)from\s+flask|Flask\("),), "fastapi": (((".py",), r"(?i)from\s+fastapi|FastAPI\("),),
    "express": ((JS, r"""(?i)require\(['"]express['"]\)|import.*express"""),), "spring": (((".java", ".xml"), ""),),
}
#: Larger files are not scanned (bytes).
LARGEST = 5 * 1024 * 1024


def frameworks(files: DataFrame) -> DataFrame:
    """Distinct frameworks that the manifests (file_path, content) among the files name."""
    base = F.lower(F.element_at(F.split("file_path", "/"), -1))
    each = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(f)) for f, p in IN_MANIFEST.items()]))
    return files.filter(base.isin(*MANIFESTS)).select(F.explode(each).alias("framework")).distinct()


def frameworks_of(ext: Column, content: Column) -> Column:
    """Frameworks whose rules apply to a file, by its extension and text."""
    ok = []
    for f, ways in IN_FILE.items():
        hit = F.lit(False)
        for exts, pattern in ways:
            hit = hit | (ext.isin(*exts) & (content.rlike(pattern) if pattern else F.lit(True)))
        ok.append(F.when(hit, F.lit(f)))
    return F.array_compact(F.array(*ok))


def _parser():
    import re._parser as parser

    return parser


def _runs(parsed) -> Iterator[str]:
    """Literal runs that every match of a parsed pattern holds."""
    run = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if run:
            yield run
            run = ""
        if name == "SUBPATTERN":
            yield from _runs(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            yield from _runs(arg[2])
    if run:
        yield run


def needed_literal(pattern: str) -> str:
    """The longest lower-case ASCII run a match cannot be without; empty if there is none of three characters."""
    best = max((r.lower() for r in _runs(_parser().parse(pattern)) if r.isascii()), key=len, default="")
    return best if len(best) >= 3 else ""


@lru_cache(maxsize=64)
def _compiled(rules: tuple[Rule, ...]):
    """(automaton of needed literals, patterns by literal, patterns to run always): each pattern as (rule, regex)."""
    import ahocorasick

    by_literal: dict[str, list] = {}
    for r in rules:
        for p in r.patterns:
            try:
                by_literal.setdefault(needed_literal(p), []).append((r, re.compile(p)))
            except (re.error, RecursionError):
                continue  # a pattern that does not compile is dropped, the rule keeps its others
    always = by_literal.pop("", [])
    automaton = ahocorasick.Automaton()
    for k in by_literal:
        automaton.add_word(k, k)
    if by_literal:
        automaton.make_automaton()
    return automaton if by_literal else None, by_literal, always


@lru_cache(maxsize=100_000)
def _regex(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _lower(text: str) -> str:
    """Lower case in which every character is the one that patterns without case take it for."""
    low = text.lower()
    return low if text.isascii() else low.replace("ſ", "s").replace("ı", "i").replace("\u0307", "")


def line_of(starts: Sequence[int], offset: int) -> int:
    """Line (from 1) of an offset, given the offsets of the line ends: a line end belongs to the line it ends."""
    return bisect.bisect_left(starts, offset) + 1


def matches_of(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(rule id, first line, last line) of every match of every pattern that no negative pattern of its rule hits around it."""
    automaton, by_literal, always = _compiled(rules)
    live = list(always)
    if automaton is not None:
        for k in {k for _, k in automaton.iter(_lower(text))}:
            live += by_literal[k]
    if not live:
        return []
    ends = [m.start() for m in re.finditer("\n", text)]
    rows: list[str] | None = None
    out = []
    for rule, regex in live:
        for m in regex.finditer(text):
            first = line_of(ends, m.start())
            if rule.negatives:
                rows = text.split("\n") if rows is None else rows
                around = "\n".join(rows[max(first - 1 - NEGATIVE_BEFORE, 0) : first + NEGATIVE_AFTER])
                if any(_regex(n).search(around) for n in rule.negatives):
                    continue
            out.append((rule.rule_id, first, line_of(ends, m.end())))
    return out


def line_ref(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def scan_files(files: DataFrame, rules: Sequence[Rule], blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """file_path, rule_id, first_line, last_line, line_number, cwe, confidence, severity, source: one row a match.

    ``files`` has file_path, ext, syntax (language) and content. Test files and files over
    LARGEST bytes are left out, comments blanked; rules apply by language (none: to all), rules
    tied to a framework only where the file shows it. Low confidence makes a finding info.
    """
    spark = files.sparkSession
    live = [r for r in rules if r.rule_id not in set(blocked)]
    by_language: dict[str, list[Rule]] = {}
    for r in live:
        for lang in r.languages or ("",):
            by_language.setdefault(lang, []).append(r)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[tuple, tuple[Rule, ...]] = {}
        for b in batches:
            rows = []
            for path, lang, has, text in zip(b["file_path"], b["syntax"], b["frameworks"], b["content"]):
                key = (lang or "", tuple(sorted(has)))
                if key not in sets:
                    mine = by_language.get("", []) + (by_language.get(lang, []) if lang else [])
                    sets[key] = tuple(r for r in mine if not r.framework or r.framework in key[1] or r.framework not in IN_FILE)
                rows += [(path, *m) for m in matches_of(text, sets[key])]
            yield pd.DataFrame(rows, columns=["file_path", "rule_id", "first_line", "last_line"])

    clean = files.filter(~is_test_file(F.col("file_path")) & (F.octet_length("content") <= LARGEST)).select("file_path", "ext", "syntax", strip_comments(F.col("content"), F.col("ext")).alias("content"))
    clean = clean.withColumn("frameworks", frameworks_of(F.lower("ext"), F.col("content")))
    found = clean.mapInPandas(run, "file_path string, rule_id string, first_line int, last_line int")
    meta = spark.createDataFrame([(r.rule_id, r.severity, r.cwe, r.description, r.confidence) for r in live], "rule_id string, rule_severity string, cwe string, description string, given double").dropDuplicates(["rule_id"])
    x = found.join(meta, "rule_id")
    conf = F.when(F.col("given") > 0, F.col("given")).otherwise(default_confidence(F.col("rule_severity")))
    sev = severity_of(F.col("cwe"), F.concat_ws(" ", "description", "rule_id"), F.col("rule_severity"))
    return x.select("file_path", "rule_id", "first_line", "last_line", line_ref(F.col("first_line"), F.col("last_line")).alias("line_number"), "cwe", conf.alias("confidence"), F.when(conf < 0.3, "info").otherwise(sev).alias("severity"), F.lit("pattern-engine").alias("source"))


def scan_queries(files: DataFrame, queries: Sequence[tuple[str, str, str, str, str]]) -> DataFrame:
    """Findings of FIND queries (rule_id, query, severity, cwe, description) in the shape of ``scan_files``; neither negatives nor the low-confidence cap apply."""
    from functools import reduce

    from tidewatch.operators.rules import find_lines

    parts = []
    for rule_id, query, severity, cwe, description in queries:
        conf = default_confidence(F.lit(severity))
        sev = severity_of(F.lit(cwe), F.lit(f"{description} {rule_id}"), F.lit(severity))
        n = F.col("line_no")
        parts.append(find_lines(files, query).select("file_path", F.lit(rule_id).alias("rule_id"), n.alias("first_line"), n.alias("last_line"), n.cast("string").alias("line_number"), F.lit(cwe).alias("cwe"), conf.alias("confidence"), sev.alias("severity"), F.lit("pattern-engine,find").alias("source")))
    return reduce(DataFrame.unionByName, parts)


def first_matches(files: DataFrame, pattern: str, longest: int = 2048) -> DataFrame:
    """An ad-hoc pattern tried on every line: file_path, line_no, match (the first of each line). A longer pattern than ``longest`` or one that does not compile is refused."""
    from tidewatch.operators.rules import lines_of, to_java

    if len(pattern) > longest:
        raise ValueError("pattern too long")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern: {e}") from None
    x = files.select("file_path", F.posexplode(lines_of("content")).alias("p", "line")).filter(F.col("line").rlike(to_java(pattern)))
    return x.select("file_path", (F.col("p") + 1).alias("line_no"), F.regexp_extract("line", to_java(pattern), 0).alias("match"))
