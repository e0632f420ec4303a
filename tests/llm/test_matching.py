from tidewatch.llm import matching as m

SCHEMA = "db_id long, target string, source string, issue_name string, file_path string, line_number string, severity string, cwe string, confidence double, description string, reported_at timestamp, kind string, path string"


def df(spark, rows):
    return spark.createDataFrame([(i, t, s, n, p, ln, None, c, None, None, None, "clash", "clash") for i, t, s, n, p, ln, c in rows], SCHEMA)


LABELLED = [
    (900, "z/z", "semgrep", "SQL Injection", "q/w/e/a.py", "1", "CWE-89"), (901, "z/z", "semgrep", "Cross-Site Scripting", "q/w/e/b.py", "1", "CWE-79"),
    (902, "z/z", "semgrep", "Command Injection", "q/w/e/c.py", "1", "CWE-78"), (903, "z/z", "semgrep", "Weak Hash Algorithm", "q/w/e/d.py", "1", "CWE-328"),
]


def pairs(spark, rows):
    return {(r.db_id_a, r.db_id_b) for r in m.found(df(spark, rows + LABELLED)).collect()}


def test_same_place_and_kind_in_many_spellings(spark):
    rows = [
        (1, "a/b", "semgrep", "SQL Injection", "src/core/db/user_store.py", "40", "CWE-89"),
        (2, "A/B.git", "AST analyzer", "sql injection in load_user", "./src//core/db/user_store.py", "L42", None),
        (3, "a/b", "Taint_Analyzer", "AST: SQL Injectoin", "C:\\agent\\src\\core\\db\\user_store.py", "38-44", None),
        (4, "a/b", "pattern-engine", "Query built from input", "src/core/db/user_store.py:41", None, "cwe 564"),
        (5, "a/b", "ai-discovery", "SQL Injection", "user_store.py", "line 45", "CWE-943"),
        (6, "a/b", "semgrep", "SQL Injection", "src.core.db.user_store", "41:7", "CWE-89"),
    ]
    want = {(a, b) for a in range(1, 7) for b in range(a + 1, 7)} - {(1, 6)}
    assert pairs(spark, rows) == want


def test_different_things(spark):
    rows = [
        (1, "a/b", "semgrep", "SQL Injection", "src/core/main.py", "40", "CWE-89"),
        (2, "a/b", "ast-analyzer", "Cross-Site Scripting", "src/core/main.py", "40", "CWE-79"),
        (3, "a/b", "ast-analyzer", "SQL Injection", "src/core/main.py", "140", "CWE-89"),
        (4, "a/b", "ast-analyzer", "SQL Injection", "src/edge/main.py", "40", "CWE-89"),
        (5, "a/c", "ast-analyzer", "SQL Injection", "src/core/main.py", "40", "CWE-89"),
        (6, "a/b", "Semgrep", "SQL Injection", "src/core/main.py", "41", "CWE-89"),
    ]
    assert pairs(spark, rows) == set()


def test_missing_line_and_short_path(spark):
    rows = [
        (1, "a/b", "semgrep", "SQL Injection", "src/core/x1/main.py", "40", "CWE-89"),
        (2, "a/b", "ast-analyzer", "SQL Injection", "src/core/x1/main.py", "N/A", "CWE-89"),
        (3, "a/b", "ai-discovery", "SQL Injection", "x1/main.py", "0", "CWE-89"),
        (4, "a/b", "semgrep", "SQL Injection", "src/core/x2/main.py", "400", "CWE-89"),
        (5, "a/b", "semgrep", "SQL Injection", "src/core/x2/main.py", "10", "CWE-89"),
        (6, "a/b", "ast-analyzer", "SQL Injection", "src/core/x2/main.py", None, "CWE-89"),
    ]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (2, 3)}


def test_repeats_nulls_and_empty(spark):
    row = (1, "a/b", "semgrep", "SQL Injection", "src/core/x1/main.py", "40", "CWE-89")
    other = (2, "a/b", "ast-analyzer", "SQL Injection", "src/core/x1/main.py", "40", "CWE-89")
    assert pairs(spark, [row, row, other, other, (None, *row[1:]), (7, None, None, None, None, None, None), (8, "", "", "", "", "", "")]) == {(1, 2)}
    assert m.found(df(spark, LABELLED).limit(0)).count() == 0


def test_confidence(spark):
    rows = [(i, "a/b", e, "SQL Injection", "src/core/x1/main.py", str(40 + i), "CWE-89") for i, e in enumerate(("semgrep", "ast-analyzer", "taint-analyzer"), 1)]
    got = m.matches(df(spark, rows + LABELLED)).collect()
    assert len(got) == 3 and all(0 < r.confidence <= 1 and (r.pass_a, r.pass_b) == (1, 1) for r in got)


def test_every_labelled_record_rates_the_passes(spark):
    # Three records carry the name of another kind than their CWE's; without the CWE every pass takes them for the others'.
    n = 120_000
    right = spark.range(n).selectExpr("id db_id", "'a/b' target", "'semgrep' source", "'SQL Injection' issue_name", "'q/w/e/a.py' file_path", "string(1 + id % 40) line_number", "'CWE-89' cwe")
    wrong = df(spark, [(n + i, "a/b", "semgrep", "SQL Injection", "q/w/e/a.py", "5", "CWE-79") for i in range(3)]).select(right.columns)
    got = m.pass_precision(*m.assigned(right.unionByName(wrong))).collect()
    assert {r["pass"]: (r.labelled, r.right, r.precision) for r in got} == {k: (n + 3, n, (n + 1) / (n + 5)) for k in range(1, 6)}


def test_few_jobs(spark):
    # Every exchange costs the driver a job, threads and another plan of the whole query: too many took more memory than it has.
    sc = spark.sparkContext
    rows = [
        (1, "a/b", "semgrep", "SQL Injection", "src/core/x1/main.py", "40", "CWE-89"), (2, "a/b", "ast-analyzer", "SQL Injectoin", "x1/main.py", "41", None),
        (3, "a/b", "taint-analyzer", "SQL Injection", "src/core/x1/main.py", None, "CWE-89"), (4, "a/b", "ai-discovery", "SQL Injection", "x1/main.py", None, "CWE-89"),
        (5, "a/b", "pattern-engine", "SQL Injection", "/home/ci/b/src/core/x1/main.py", "42", "CWE-89"), (6, "a/b", "semgrep", "SQL Injection", "x1/main.py", "400", "CWE-89"),
        (7, "a/b", "ast-analyzer", "SQL Injection", "x1/main.py", "405", "CWE-89"), (8, "a/b", "ast-analyzer", "Open Redirect", "src/core/x1/main.py", "0", "CWE-601"),
        (9, "a/b", "semgrep", "Open Redirect", "src/core/x1/main.py", "0", "CWE-601"),
    ]
    sc.setJobGroup("few jobs", "")
    try:
        got = pairs(spark, rows)
        jobs = len(sc.statusTracker().getJobIdsForGroup("few jobs"))
    finally:
        sc._jsc.clearJobGroup()
    assert got == {(a, b) for a in range(1, 6) for b in range(a + 1, 6)} | {(6, 7), (8, 9)}
    assert 10 < jobs < 60, jobs
