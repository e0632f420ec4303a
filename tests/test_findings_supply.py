import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tidewatch.operators import code_model, findings, history, supply, suppression
from tidewatch.plans import registry
from tidewatch.sources import manifests

RAW = "db_id long, scan_id string, phase string, issue_name string, file_path string, description string, severity string, line_number string, ai_validated string, remediation string, rule_id string, source string, cwe string, owasp string, confidence double, status string, family string, line int"


def rec(spark, rows):
    base = dict(scan_id="s", phase="final", issue_name="n", file_path="a.go", description="", severity="high", line_number="1", ai_validated="No", remediation="", rule_id="r", source="x", cwe=None, owasp=None, confidence=0.5, status=None)
    cols = [c.split()[0] for c in RAW.split(", ")]
    full = [tuple({**base, "db_id": i, **r}.get(c) for c in cols) for i, r in enumerate(rows, 1)]
    return findings.records(spark.createDataFrame(full, RAW))


def test_report_fixture(spark):
    f = rec(spark, [
        dict(rule_id="sqli-001", issue_name="SQL Injection", file_path="app/db.go", line_number="42", severity="critical", cwe="CWE-89", owasp="A03:2021"),
        dict(rule_id="xss-001", issue_name="XSS", severity="high", cwe="CWE-79", owasp="A03:2021", status="false_positive"),
        dict(rule_id="secret-001", issue_name="Hardcoded Secret", severity="medium", cwe="CWE-798", owasp="A07:2021"),
    ])
    (r,) = findings.risk_score(f).collect()
    assert (r.score, r.level) == (17, "Low Risk")
    g = f.withColumn("status", F.lit("open"))
    pci = {r.control_id: r.n_findings for r in findings.compliance_cwe(g, findings.PCI).collect()}
    assert pci == {"6.2": 3, "6.3": 1, "6.4": 3, "8.2": 1, "8.6": 0, "4.2": 0}  # CWE-79 also takes CWE-798
    owasp = {r.control_id: (r.n_findings, r.status) for r in findings.compliance_owasp(f).collect()}
    assert len(owasp) == 10 and owasp["A03:2021"] == (1, "fail") and owasp["A01:2021"] == (0, "pass")


def test_clusters(spark):
    f = rec(spark, [dict(line_number=str(n), cwe="CWE-79") for n in (1, 10, 24, 40, 60)] + [dict(line_number=str(n), cwe="CWE-798") for n in (5, 6)])
    got = sorted((r.family, r.from_line, r.to_line) for r in findings.proximity_clusters(f).collect())
    assert got == [("HARDCODED_SECRET", 5, 5), ("HARDCODED_SECRET", 6, 6), ("XSS", 1, 24), ("XSS", 40, 40), ("XSS", 60, 60)]


def test_fold(spark):
    f = rec(spark, [
        dict(severity="high", description="aaaaa", rule_id="R1", source="x", remediation="1", cwe="C1"),
        dict(severity="critical", description="bbb", rule_id="R2", source="y, x", cwe="C2", confidence=0.9),
        dict(severity="critical", description="ccccccccc", rule_id="R3", source="z", cwe="C3", ai_validated="Yes", remediation="3"),
    ])
    (r,) = findings.exact_line_dedup(f).collect()
    assert (r.severity, r.description, r.cwe, r.rule_id, r.source, r.confidence, r.ai_validated, r.n_merged) == ("critical", "ccccccccc", "C2", "R1", "x, y, z", 0.9, "Yes", 3)
    assert r.remediation == "3"
    assert findings.exact_line_dedup(rec(spark, [dict(line_number="N/A"), dict(line_number="0")])).count() == 2


def test_trust_and_recalibration(spark):
    f = rec(spark, [dict(confidence=0.9, source="a, b", ai_validated="Yes"), dict(confidence=0.8, source="pattern-engine,query"), dict(confidence=None, source="ast"), dict(cwe="CWE-79", severity="critical"), dict(cwe="CWE-770"), dict(cwe="CWE-94", severity="medium")])
    got = {r.db_id: (r.t, r.severity) for r in findings.recalibrated(f).withColumn("t", findings.trust_score(f)).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == [100.0, 80.0, 0.0]
    assert [got[i][1] for i in (4, 5, 6)] == ["high", "low", "critical"]


def test_policy(spark):
    f = rec(spark, [dict(severity=s) for s in ("critical", "high", "high", "high", "low", "low")])
    got = sorted((r.gate, r.severity) for r in findings.policy_violations(f, "high", {"critical": 0, "total": 5}).collect())
    assert got == [("fail-on high", "critical"), ("fail-on high", "high"), ("max-critical", "critical"), ("max-total", "total")]


def test_empty(spark):
    f = rec(spark, [dict()]).limit(0)
    for x in (findings.exact_line_dedup(f), findings.proximity_clusters(f), findings.risk_score(f), findings.policy_violations(f), history.fp_filter(f)):
        assert x.count() == 0


def test_calibration(spark):
    f = rec(spark, [dict(confidence=0.7, ai_validated="Yes") for _ in range(5)] + [dict(confidence=0.7)])
    v = spark.createDataFrame([(i, i, True, 0.9, "same", dt.datetime(2024, 1, 1)) for i in range(1, 6)], "validation_id long, finding_id long, is_true_positive boolean, confidence double, severity_adjustment string, created_at timestamp")
    assert {r.calibrated for r in history.calibrated(f, v).collect()} == {0.79}


def test_requirements_and_typosquats(spark):
    rows = ["a==1", "b>=2", "c", "# x", "-r y", "reacct", "react-dom", "lodahs", "requets"]
    ln = spark.createDataFrame([("r.txt", i, x) for i, x in enumerate(rows, 1)], "file_path string, line_no int, line string")
    deps = manifests.requirements(ln)
    assert {(r.name, r.version) for r in deps.filter("line_no < 6").collect()} == {("a", "1"), ("b", "2"), ("c", "latest")}
    assert {(r.name, r.lookalike) for r in supply.typosquats(deps).collect()} == {("reacct", "react"), ("requets", "requests")}


def test_manifest_kinds(spark):
    def files(text):
        return spark.createDataFrame([("f", text)], "file_path string, content string")

    def lines(text):
        return spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"), 1)], "file_path string, line_no int, line string")

    got = lambda d: sorted((r.name, r.version) for r in d.collect())
    assert got(manifests.package_json(files('{"dependencies": {"a": "^1.2"}, "devDependencies": {"b": "~2"}}'))) == [("a", "1.2"), ("b", "2")]
    assert got(manifests.package_json(files("{broken"))) == []
    assert got(manifests.composer_json(files('{"require": {"php": "8", "x/y": "1"}}'))) == [("x/y", "1")]
    assert got(manifests.go_mod(lines("module m\nrequire (\n\tx/y v1.2 // indirect\n)\nrequire z/w v0.1"))) == [("x/y", "1.2"), ("z/w", "0.1")]
    assert got(manifests.pom_xml(files("<dependency><groupId>g</groupId>\n<artifactId>a</artifactId></dependency>"))) == [("g:a", "latest")]
    assert got(manifests.gradle(lines("implementation 'g:a:1.0'\napi(\"h:b:2\")"))) == [("g:a", "1.0"), ("h:b", "2")]
    assert got(manifests.yarn_lock(lines('left-pad@^1.0:\n  version "1.3"\n"@s/p@1":\n  version "2"'))) == [("left-pad", "1.3")]
    assert got(manifests.pnpm_lock(lines("  /foo/1.2.3:"))) == [("foo", "1.2.3")]
    assert [r.rule_id for r in manifests.load_rules("rules:\n- id: a\n  languages: [go]\n  patterns: ['x', {regex: 'y'}]\n- id: b\n  pattern: '('\n")] == ["a"]


def test_container_rules(spark):
    docker = ["# FROM x:latest", "FROM node", "ENV API_KEY=x", "ARG credentials", "EXPOSE 8080 22", "  user 0", "FROM a:1 AS b", "USER rooted"]
    ln = spark.createDataFrame([("D", i, x) for i, x in enumerate(docker, 1)] + [("E", 1, "FROM x:LATEST")], "file_path string, line_no int, line string")
    got = {(r.file_path, r.line_no, r.rule_id, r.severity, r.cwe, r.confidence) for r in supply.dockerfile_rules(ln).collect()}
    assert got == {
        ("D", 2, "CONTAINER-LATEST-TAG", "medium", "CWE-1104", 0.8), ("D", 3, "CONTAINER-ENV-SECRET", "critical", "CWE-312", 0.95), ("D", 4, "CONTAINER-ENV-SECRET", "critical", "CWE-312", 0.95), ("D", 5, "CONTAINER-EXPOSE-SENSITIVE-PORT", "high", "CWE-200", 0.85),
        ("D", 6, "CONTAINER-ROOT-USER", "high", "CWE-250", 0.85), ("D", 8, "CONTAINER-ROOT-USER", "high", "CWE-250", 0.85), ("D", 0, "CONTAINER-MISSING-HEALTHCHECK", "low", "CWE-754", 0.8),
        ("E", 1, "CONTAINER-LATEST-TAG", "medium", "CWE-1104", 0.8), ("E", 0, "CONTAINER-MISSING-USER", "high", "CWE-250", 0.85), ("E", 0, "CONTAINER-MISSING-HEALTHCHECK", "low", "CWE-754", 0.8),
    }
    assert {r.image for r in supply.base_images(ln).collect()} == {"a:1", "x:LATEST"}
    text = "apiVersion: v1\nkind: Pod\n  privileged: true\n  allowPrivilegeEscalation: 'true'\n  privileged: false"
    k = spark.createDataFrame([("K", text), ("L", text.replace("kind:", ""))], "file_path string, content string")
    assert {(r.file_path, r.line_no, r.rule_id) for r in supply.k8s_rules(k).collect()} == {("K", 3, "K8S-PRIVILEGED-CONTAINER"), ("K", 4, "K8S-PRIVILEGE-ESCALATION")}
    s = spark.createDataFrame([(9.8,), (7.0,), (3.9,)], "s double")
    assert [r[0] for r in s.select(supply.cvss_severity(F.col("s").cast("string"))).collect()] == ["critical", "high", "low"]


def test_techniques(spark):
    want = {"Command injection": "T1059", "Shell use": "T1059", "SQL Injection": "T1190", "Reflected XSS": "T1189", "Hardcoded secret": "T1078", "Path traversal": "T1083", "SSRF": "T1190", "Weak random": "T1552", "Open redirect": "T1189", "Data in log": None}
    f = rec(spark, [dict(issue_name=n, description="sql injection") for n in want])
    got = {r.issue_name: r.technique for r in findings.with_technique(f).collect()}
    assert got == want
    (r,) = findings.with_technique(f).filter("issue_name = 'SSRF'").collect()
    assert r.description == "sql injection\n\nMITRE ATT&CK: T1190 - Exploit Public-Facing Application"


def test_suppression(spark):
    cases = [
        ("SQL text", "CWE-89", "db.prepare(q)\n" + "x\n" * 14 + "bad", 16, True), ("SQL too far", "CWE-89", "db.prepare(q)\n" + "x\n" * 15 + "bad", 17, False), ("canonical alone", "CWE-22", "os.path.realpath(p)\nopen(p)", 2, False),
        ("canonical and bounded", "CWE-22", "os.path.realpath(p)\np.startswith(x)\nopen(p)", 3, True), ("environment", "CWE-798", "key = os.environ['K']", 1, True), ("environment left", "CWE-798", "os.environ['K'] = 'abc'", 1, False), ("placeholder", "CWE-798", "key = 'CHANGEME'", 1, True),
        ("text content", "CWE-79", "el.textContent = v", 1, True), ("with html", "CWE-79", "el.textContent += a.innerHTML", 1, False), ("own line only", "CWE-20", "x = process.env.A", 1, True), ("not near", "CWE-20", "process.env.A\nx", 2, False), ("by words", "", "yaml.safe_load(x)", 1, True), ("no family", "", "yaml.safe_load(x)", 1, False),
    ]
    files = spark.createDataFrame([(n, t, "clash") for n, _, t, _, _ in cases] + [("empty", "", "")], "file_path string, content string, lines string")
    rows = [(n, at, "r", "unsafe deserialization" if n == "by words" else "n", "d", "high", c, "No", 7) for n, c, _, at, _ in cases] + [("gone", 1, "r", "n", "d", "high", "CWE-89", "No", 7), ("empty", 1, "r", "n", "d", "high", "CWE-89", "No", 7), ("empty", 1, "r", None, None, None, None, None, 7)]
    found = spark.createDataFrame(rows, "file_path string, line_no int, rule_id string, issue_name string, description string, severity string, cwe string, ai_validated string, places int")
    out = suppression.suppressed(files, found).collect()
    assert len(out) == len(rows)
    got = {r.file_path: r.suppressed for r in out}
    assert got == {n: w for n, _, _, _, w in cases} | {"gone": False, "empty": False}
    hit = next(r for r in out if r.file_path == "environment")
    assert (hit.severity, hit.description, hit.ai_validated, hit.places) == ("info", "[SUPPRESSED] d", "No (False Positive - Safe Pattern)", 7)


def test_pipeline_numbers_and_merges(spark):
    f = rec(spark, [dict(line_number="1", cwe="CWE-79", source="a", confidence=0.5), dict(line_number="9", cwe="CWE-79", source="b", severity="critical"), dict(line_number="60", cwe="CWE-79"), dict(scan_id=None, line_number="N/A")])
    got = {(r.scan_id, r.from_line, r.to_line): (r.severity, r.n_merged, r.trust_score, r.sr_no) for r in findings.pipeline(f).collect()}
    assert got == {("s", 1, 9): ("high", 2, 65.0, 1), ("s", 60, 60): ("high", 1, 50.0, 2), ("", 0, 0): ("high", 1, 50.0, 1)}


def test_taint_flows(spark):
    assert (code_model.confidence(10, 0), code_model.confidence(60, 2), code_model.confidence(150, 5), code_model.confidence(10, 0, True)) == (0.95, 0.8, 0.7, 0.9)
    code = "def f():\n  a = request.args.get('x')\n  b = a + '1'\n  cur.execute(b)\n  c = escape(a)\n  cur.execute(c)\n"
    assert [f[:3] + f[4:7] for f in code_model.flows(code, "python")] == [("b", 2, 4, "SQL", "CWE-89", 1)]
    guarded = code.replace("  cur.execute(b)", "  if b not in seen: raise X\n  cur.execute(b)")
    assert [f[7:] for f in code_model.flows(guarded, "python")] == [(True, 0.25)]
    assert code_model.flows(code.replace("execute(b)", "execute('a = ?', [b])"), "python") == []
    assert code_model.flows(code, "go") == []
    kinds = {(p, k) for _, p, k, _, _ in code_model.sink_table()}
    assert {(r"\.execSQL\s*\(", "Command"), (r"db\.Query\s*\(", "Injection"), (r"eval\s*\(", "Code"), (r"fetch\s*\(", "SSRF"), (r"unserialize\s*\(", "Deserialization")} <= kinds
    schema = "file_path string, syntax string, content string"
    two = spark.createDataFrame([("in.py", "python", "def read_it():\n  q = request.args['z']\n  return q\n"), ("run.py", "python", "def go_on():\n  a = read_it()\n  os.system(a)\n"), ("x.txt", "", code), ("e.py", "python", "")], schema)
    got = [(r.file_path, r.source_line, r.sink_line, r.kind, r.confidence) for r in code_model.taint_flows(two).collect()]
    assert got == [("run.py", 2, 3, "Command", 0.9)]
    assert code_model.taint_flows(two, across=False).count() == 0
    assert {r.name for r in code_model.tainted_functions(code_model.function_facts(two)).collect()} == {"read_it", "go_on"}


CHECKS = [
    ("python", "eval(x)", "ast-python-dangerous-eval"), ("python", "execute('a %s' % x)", "ast-python-sql-injection"), ("python", "system(request.args)", "ast-python-command-injection"), ("go", "log.Printf(user.Email)", "ast-privacy-pii-logging"),
    ("python", "api_key = 'aK9x2LmQ7zR4tY8w'", "ast-python-hardcoded-secret"), ("python", "render_template_string(x)", "ast-python-ssti"), ("javascript", "new Function(x)", None), ("javascript", "Function(x)", "ast-js-dangerous-eval"),
    ("javascript", "a.innerHTML.replace(x)", "ast-js-xss-innerhtml"), ("typescript", "const token = 'aK9x2LmQ7zR4tY8w'", "ast-js-hardcoded-secret"), ("java", 's.executeQuery("a" + b)', "ast-java-sql-injection"), ("java", "Runtime.getRuntime().exec(c)", "ast-java-command-injection"),
    ("java", "in.readObject()", "ast-java-insecure-deserialization"), ("java", "res.getWriter().print(req.getParameter(x))", "ast-java-xss-response"), ("java", 'String password = "x"', "ast-java-hardcoded-secret"), ("java", 'new CipherBox("DES")', "ast-java-weak-cipher"),
    ("kotlin", "settings.javaScriptEnabled = true", None), ("kotlin", "javaScriptEnabled = true", "ast-kotlin-insecure-webview"), ("kotlin", 'db.rawQuery("a $b")', "ast-kotlin-sql-injection"), ("kotlin", "Log.d(token)", "ast-kotlin-sensitive-logging"), ("kotlin", "startActivity(Intent(x))", "ast-kotlin-implicit-intent"),
    ("kotlin", "getSharedPreferences(MODE_WORLD_READABLE)", "ast-kotlin-insecure-sharedprefs"), ("kotlin", 'val apiKey = "x"', None), ("kotlin", 'apiKey = "x"', "ast-kotlin-hardcoded-secret"), ("go", 'db.Query(fmt.Sprintf("a"))', "ast-go-sqli-db-dynamic"), ("go", "exec.Command(fmt.Sprintf(a))", "ast-go-cmdi-exec-sprintf"),
    ("go", "os.Open(r.FormValue(a))", "ast-go-path-traversal"), ("go", "template.New(a).Parse(r.FormValue(a))", "ast-go-ssti-template-parse"), ("go", 'q := "select a" + r.FormValue(b)', "ast-go-sqli-concat-assignment"), ("ruby", 'system("a #{params[:b]}")', "ast-ruby-cmdi-params"),
    ("ruby", 'User.where("a #{params[:b]}")', "ast-ruby-sqli-where"), ("ruby", "eval(params[:a])", "ast-ruby-code-injection-eval"), ("rust", 'Command::new("ls")', "ast-rust-cmdi-command-new"), ("rust", 'format!("select {}", a)', "ast-rust-sqli-format-macro"),
]


def test_every_check_has_its_case(spark):
    files = spark.createDataFrame([(str(i), lang, code) for i, (lang, code, _) in enumerate(CHECKS)], "file_path string, syntax string, content string")
    got = {}
    for r in code_model.checks(code_model.calls(files)).collect():
        got.setdefault(int(r.file_path), set()).add(r.check_id)
    for i, (_, code, want) in enumerate(CHECKS):
        assert want is None or want in got.get(i, set()), (code, want, got.get(i))
    assert {c for _, _, c in CHECKS if c} == {c[0] for c in code_model._checks()}


def test_packages_the_code_names(spark):
    words = code_model.identifiers(spark.createDataFrame([("a", "python", "import MyLodashUtil\nx = 1"), ("b", "", "react")], "file_path string, syntax string, content string"))
    deps = spark.createDataFrame([("lodash", 1), ("react", 2), (None, 3), ("", 4)], "name string, word int")
    assert {(r.name, r.word): r.used for r in code_model.used_packages(deps, words).collect()} == {("lodash", 1): True, ("react", 2): False, (None, 3): False, ("", 4): False}


def test_fixed_versions_of_the_own_package(spark):
    def affected(name, eco, *fixed):
        return {"package": {"name": name, "ecosystem": eco}, "ranges": [{"events": [{"introduced": "0"}, *({"fixed": f} for f in fixed)]}]}

    several = [affected("other", "npm", "1"), affected("twin", "PyPI", "2"), affected("p", "PyPI", "3", "4"), affected("p", "npm", "5")]
    foreign = [affected("other", "npm", "6")]
    cli = {"results": [{"packages": [{"package": {"name": "p", "ecosystem": "PyPI"}, "vulnerabilities": [{"id": "a", "affected": several}, {"id": "b", "affected": foreign}]}]}]}
    rows = [(1, json.dumps(cli)), (2, json.dumps({"vulns": [{"id": "a", "affected": several}]}))]
    got = {(r.result_id, r.node_path): (r.first_fixed, r.last_fixed) for r in supply.fixed_versions(spark.createDataFrame(rows, "result_id long, payload string")).collect()}
    above = "results[0].packages[0].vulnerabilities"
    assert got == {(1, f"{above}[0]"): ("2", "4"), (1, f"{above}[1]"): ("unknown", "latest"), (2, "vulns[0]"): ("1", "5")}


def test_long_arguments_are_kept_whole(spark):
    long = "cur.execute('''SELECT a\n" + "  , column_of_a_long_statement\n" * 300 + "''' % name)\n"
    files = spark.createDataFrame([("a.py", "python", long.replace("cur.", ""))], "file_path string, syntax string, content string")
    assert [(r.check_id, r.line_no) for r in code_model.checks(code_model.calls(files)).collect()] == [("ast-python-sql-injection", 1)]


def test_ends_of_brackets_as_read_from_each_start():
    def end(text, at):
        depth, quote = 0, ""
        for i in range(at, len(text)):
            ch = text[i]
            if quote:
                quote = "" if (ch == quote and text[i - 1] != "\\") or (ch == "\n" and quote != "`") else quote
            elif ch in "'\"`":
                quote = ch
            elif ch in "([{":
                depth += 1
            elif ch in ")]}":
                depth -= 1
                if depth == 0:
                    return i + 1
        return len(text)

    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("a((()))[]{}'\"`\\\n") for _ in range(r.randint(0, 60)))
        starts = [i for i, ch in enumerate(text) if ch == "(" and r.random() < 0.7]
        assert code_model._ends(text, starts) == {i: end(text, i) for i in starts}, text


def test_typosquat_packages_reads_the_table(spark, tmp_path):
    def payload(*names):
        return json.dumps({"results": [{"packages": [{"package": {"name": x, "ecosystem": "npm", "version": "1"}} for x in names]}]})

    rows = [(1, payload("expresss", "react", "left-pad")), (2, "log\n" + payload("webpak", "expresss"))]
    spark.createDataFrame(rows, "result_id long, payload string").write.parquet(str(tmp_path / "osv_results.parquet"))
    got = registry.queries()["typosquat_packages"](spark, str(tmp_path)).collect()
    assert sorted((r.name, r.lookalike) for r in got) == [("expresss", "express"), ("webpak", "webpack")]
