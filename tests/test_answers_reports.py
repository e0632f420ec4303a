import json

from pyspark.sql import functions as F

from tidewatch.functions import scalars as fn
from tidewatch.operators import answers, exports, prefix
from tidewatch.operators import pattern_engine as engine
from tidewatch.operators.rules import Rule
from tidewatch.sources import corpus


def col(spark, f, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v")).alias("x")).collect()]


def test_scalar_forms(spark):
    assert col(spark, fn.tool_severity, ["ERROR", "critical", "warning", "High", "info", "low", "odd", None]) == ["critical", "critical", "high", "high", "medium", "low", "medium", "medium"]
    assert col(spark, fn.rule_path_name, ["python.lang.sqli-format", "go.net.open-socket", "javascript.http.plaintext-link", "one", "kotlin.audit.weak-md5"]) == ["Python SQL Injection", "Go Open Socket", "JavaScript Insecure HTTP Link", "one", "Kotlin Weak Cryptography"]
    assert col(spark, fn.cwe_id, ["CWE-89: SQL", "x CWE-7", "odd", "", "n/a", None]) == ["CWE-89", "CWE-7", "N/A", "", "n/a", None]
    assert col(spark, fn.owasp_label, ["A03:2021 - Injection.", "A03:2021", "A10:2021-SSRF (x)", "odd", "N/A"]) == ["A03:2021-Injection", "A03:2021", "A10:2021-SSRF (x)", "N/A", "N/A"]
    urls = {"https://h/x": True, "http://h": True, "ssh://git@h/x": True, "git@h:u/r.git": True, "-x": False, "git@h:a b": False, "git@h:a:b": False, "ftp://h/x": False, "https://u:p@h/x": False, "https:///x": False, "": False}
    assert col(spark, fn.is_git_url, list(urls)) == list(urls.values())
    assert col(spark, fn.masked_urls, ["clone https://u:p@h/x and ssh://a:b@c", "git@h:x"]) == ["clone https://***:***@h/x and ssh://***:***@c", "git@h:x"]
    assert col(spark, lambda c: fn.duration(c.cast("double")), ["42", "185", "7640"]) == ["42s", "3m05s", "2h07m"]
    assert col(spark, fn.without_fences, ["```go\nx := 1\n```", "x", " ```\na\n```\n"]) == ["x := 1", "x", "a"]
    assert col(spark, lambda c: fn.truncated(c, 3), ["abcd", "abc", None]) == ["abc...", "abc", None]
    assert col(spark, lambda c: fn.flex_int(c, "$.n"), ['{"n": 3}', '{"n": [7, 8]}', '{"n": "x"}', "{}", "odd"]) == [3, 7, 0, 0, 0]
    assert col(spark, fn.version_of, ["pkg@1.2", "pkg 3.4", "pkg", ""]) == ["1.2", "3.4", "", ""]
    assert col(spark, fn.has_user_input, ["x = req.body", "$_GET['a']", "plain"]) == [True, False, False]  # forms with capitals never hit lower-cased text
    assert col(spark, fn.printable, ["a\x07“b”…", "ok"]) == ['a"b"...', "ok"]


def test_json_out_of_answers():
    p = answers.parsed
    assert json.loads(p('text ```json\n{"a": [1, 2,],}\n``` more')) == {"a": [1, 2]}
    assert json.loads(p('first ```\nnot it\n``` then ```\n[{"b": 1}]\n```')) == [{"b": 1}]
    assert json.loads(p('<think>{"x": 1}</think> so {"y": "a "quoted" word"} end')) == {"y": 'a "quoted" word'}
    assert json.loads(p('{"a": {"b": "open')) == {"a": {"b": "open"}}
    assert json.loads(p('{"a": "C:\\dir", "b": "line\nend"}')) == {"a": "C:\\dir", "b": "line\nend"}
    assert json.loads(p('[1, {"a":')) == [1, {"a": None}]
    assert p("no brackets") is None and p("") is None and p(None) is None


def test_judge(spark):
    rows = [(i, f"n{i}", "low", s, a, "", "clash") for i, s, a in ((1, "static", "No"), (2, "ai-discovery", "Yes"), (3, "x", "No"), (4, "y", "No"), (5, "z", "Discovered by AI"), (6, "q", "No"))]
    found = spark.createDataFrame(rows, "db_id long, issue_name string, severity string, source string, ai_validated string, ai_reasoning string, kept string")
    verdicts = {"findings": [{"master_id": 1, "duplicate_ids": [2], "verdict": "keep", "reason": "same", "final_severity": "high", "simplified_name": "Name"}, {"master_id": 3, "duplicate_ids": [4], "verdict": "drop"}, {"master_id": 5, "verdict": "keep"}, {"master_id": 99, "verdict": "keep"}]}
    a = spark.createDataFrame([("```json\n" + json.dumps(verdicts) + "\n```",), (None,), ("nonsense",)], "answer string")
    out = {r.db_id: tuple(r)[1:] for r in answers.judged(found, answers.verdicts_of(answers.with_json(a, "answer").drop("answer"))).collect()}
    assert out == {1: ("Name", "high", "static, ai-discovery", "Yes", "AI Judge: same", True), 5: ("n5", "low", "z", "Discovered by AI", "", True), 6: ("n6", "low", "q", "No", "", False)}
    none = answers.verdicts_of(answers.with_json(a.limit(0), "answer").drop("answer"))
    assert answers.judged(found, none).count() == 6


def test_generated_answers_and_breaker(spark):
    def model(p):
        if p == "b":
            raise ValueError("no")
        return p.upper()

    got = answers.generated(spark.createDataFrame([("a",), ("b",)], "prompt string"), model).collect()
    assert [(r.answer, r.error) for r in got] == [("A", None), (None, "ValueError: no")]
    rows = [("g", i, f) for i, f in enumerate([True, True, False, True, True, True, False, True])] + [("h", 1, True)]
    b = answers.breaker(spark.createDataFrame(rows, "g string, i int, failed boolean"), "g", "i", "failed")
    assert sorted(r.i for r in b.filter("skipped").collect()) == [6, 7]


def test_tool_reports(spark):
    report = {"results": [{"check_id": "go.audit.sqli", "path": "a.go", "start": {"line": 3}, "end": {"line": 5}, "extra": {"message": "m"}, "severity": "ERROR"}, {"check_id": "blocked.rule", "path": "b"}]}
    r = spark.createDataFrame([(json.dumps(report), 1), ("{damaged", 2), (None, 3)], "report string, severity int").withColumnRenamed("severity", "run")
    assert [tuple(x) for x in answers.scanner_findings(r, ("blocked.rule",)).collect()] == [(1, "Go SQL Injection", "a.go", "m", "critical", "3-5", "go.audit.sqli", "No")]
    image = {"Results": [{"Vulnerabilities": [{"VulnerabilityID": "V1", "Severity": "HIGH", "PkgName": "p"}, {"VulnerabilityID": "V2", "Severity": "LOW", "PkgName": "p"}]}, {"Vulnerabilities": None}]}
    i = spark.createDataFrame([(json.dumps(image), "node:1")], "report string, image string")
    assert [(x.file_path, x.issue_name, x.severity, x.confidence) for x in answers.image_findings(i).collect()] == [("FROM node:1", "[TRIVY] V1 in p", "high", 0.85)]


def test_related_files_and_windows(spark):
    f = spark.createDataFrame([(1, "x/a.go", "see b.go and a.go", ["lib/c.py:4 y"]), (2, "x/a.go", None, None)], "db_id long, file_path string, description string, exploit_path array<string>")
    files = spark.createDataFrame([("x/a.go",), ("x/b.go",), ("y/b.go",), ("lib/c.py",)], "file_path string")
    assert sorted(tuple(r) for r in answers.related_files(f, files).collect()) == [(1, "lib/c.py", 1), (1, "x/b.go", 2)]
    text = "\n".join(map(str, range(1, 601)))
    src = spark.createDataFrame([("long", text), ("short", "a\nb"), ("none", "")], "file_path string, content string")
    places = spark.createDataFrame([("long", 300), ("long", 0), ("long", 590), ("short", 2), ("none", 1)], "file_path string, line_no int")
    got = {(r.file_path, r.line_no): (r.from_line, r.to_line) for r in answers.code_window(src, places).collect()}
    assert got == {("long", 300): (150, 450), ("long", 0): (1, 300), ("long", 590): (440, 600), ("short", 2): (1, 2), ("none", 1): (1, 1)}


RAW = "db_id long, scan_id string, phase string, sr_no int, issue_name string, file_path string, description string, severity string, line_number string, ai_validated string, remediation string, rule_id string, source string, cwe string, owasp string, confidence double, code_snippet string, ai_reasoning string, exploit_path array<string>, trust_score double, exploit_poc string, fixed_code string, vulnerable_pattern string, status string, section int"


def raw(spark, rows):
    names = [c.split()[0] for c in RAW.split(", ")]
    base = dict(scan_id="s", phase="final", issue_name="N", file_path="/a/b.go", severity="High", line_number="7-9", ai_validated="No", confidence=0.5, source="x", section=1)
    return exports.report_rows(spark.createDataFrame([tuple({**base, "db_id": i, **r}.get(c) for c in names) for i, r in enumerate(rows, 1)], RAW))


def test_documents(spark):
    f = raw(spark, [dict(rule_id="r1", cwe="CWE-1", description='say "hi"\nnow'), dict(rule_id="r1", issue_name="other"), dict(issue_name="Open Port", file_path="t/test/x.go", remediation="close it"), dict(scan_id=None, ai_validated="No (False Positive)")])
    pieces = sorted((r.section, r.part, r.text) for r in exports.sarif_parts(f).collect() if r.scan_id == "s")
    doc = json.loads("".join(t for _, _, t in pieces))
    run = doc["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r1", "open-port"] and len(run["results"]) == 3
    assert run["results"][0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a/b.go"}, "region": {"startLine": 7}}
    assert run["results"][2]["message"]["text"] == " Remediation: close it" and run["results"][0]["level"] == "error"
    lines = [r.line for r in sorted(exports.csv_lines(f).filter("scan_id = 's'").collect(), key=lambda r: (r.section, r.place, r.db_id))]
    assert lines[0].startswith("Sr. No.,") and lines[3] == "," * 17 and lines[4].startswith("=== POTENTIALLY") and lines[5] == lines[0] and len(lines) == 7
    assert '"say ""hi""\nnow"' in lines[1]


def test_sbom(spark):
    f = raw(spark, [dict(source="osv", vulnerable_pattern="lib@1.2", cwe="CWE-1", rule_id="R"), dict(source="osv", vulnerable_pattern="lib 9"), dict(source="osv", vulnerable_pattern="z 1", status="Ignored "), dict(source="dependency", issue_name="CVE-1 in q")])
    c, v = exports.sbom(f)
    assert sorted((r.name, r.version) for r in c.collect()) == [("CVE-1 in q", ""), ("lib", "9"), ("lib@1.2", "1.2")]
    assert sorted(r.id for r in v.collect()) == ["R"]


def test_pattern_engine(spark):
    rules = [
        Rule("multi", ("python",), (r"open\(\n\s*name",), "high", "CWE-22"), Rule("neg", (), (r"(?i)PASSWORD",), "low", negatives=(r"safe\nway",)), Rule("low", (), ("zeta",), "medium", "CWE-89", confidence=0.2),
        Rule("bad", (), ("(", "omega"), "info"), Rule("rails-only", (), ("zeta",), "high", framework="rails"), Rule("flask-only", (), ("zeta",), "high", framework="flask"), Rule("js-json-escape", (), ("zeta",), "high"), Rule("any", (), (r"\d{5}",), ""),
    ]
    text = "from flask import Flask\nopen(\n  name)\npassword # zeta in a comment\nx = 'password'\n" + "\n" * 12 + "safe\nway\npassword\nzeta zeta omega 12345\n"
    df = spark.createDataFrame([("a.py", "python", text), ("src/test/b.py", "python", text), ("c.md", "", ""), ("d.txt", "", "ZETA ſ")], "file_path string, syntax string, content string")
    got = sorted((r.file_path, r.rule_id, r.line_number, r.severity) for r in engine.scan_files(corpus.with_language(df), rules).collect())
    assert got == [
        ("a.py", "any", "21", "medium"), ("a.py", "bad", "21", "info"), ("a.py", "flask-only", "21", "high"), ("a.py", "flask-only", "21", "high"), ("a.py", "low", "21", "info"), ("a.py", "low", "21", "info"),
        ("a.py", "multi", "2-3", "high"), ("a.py", "neg", "4", "low"), ("a.py", "neg", "5", "low"),
    ]
    assert [engine.needed_literal(p) for p in (r"(?i)Eval\(\s*req", "(foo|bar)bazz+", "a|b", r"(abcd){0,2}x", r"(?:select)+ from")] == ["eval(", "baz", "", "", "select"]
    ends = [2, 5]
    assert [engine.line_of(ends, o) for o in (0, 2, 3, 5, 6)] == [1, 1, 2, 2, 3]
    m = spark.createDataFrame([("x/package.json", '"express": "1"'), ("y.txt", '"vue": "1"')], "file_path string, content string")
    assert [r.framework for r in engine.frameworks(m).collect()] == ["express"]


def test_thousands_of_rules(spark):
    rules = tuple(Rule(f"r{i}", ("go",), (rf"call_{i}_\w+\(",), "low") for i in range(5000))
    text = "\n".join(f"x call_{i}_a(b)" for i in range(0, 5000, 100))
    assert len(engine.matches_of(text, rules)) == 50


def test_sorted_rank(spark):
    rows = [("a" if i % 3 else "b", i * 7 % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = prefix.sorted_rank(df, ["g"], [F.col("v").desc(), F.col("id")], "n").collect()
    for g in "ab":
        want = sorted(((v, i) for x, v, i in rows if x == g), key=lambda t: (-t[0], t[1]))
        assert [(r.v, r.id) for r in sorted((r for r in got if r.g == g), key=lambda r: r.n)] == want


def test_walk_counts(spark):
    df = spark.createDataFrame([("a/b/x.py", ""), ("a/b/y.odd", ""), ("a/Makefile", ""), ("a/node_modules/z.js", ""), ("LICENSE", ""), ("q/.threat-intel-cache.json", "")], "file_path string, content string")
    got = {(r.kind, r.name): r.n_files for r in corpus.walk_counts(corpus.scannable(df)).collect()}
    assert got == {("language", "python"): 1, ("language", "other"): 2, ("language", "makefile"): 1, ("skipped_ext", ".odd"): 1, ("skipped_ext", "LICENSE"): 1, ("folder", "a/b"): 2, ("folder", "a"): 1, ("folder", ""): 1}
