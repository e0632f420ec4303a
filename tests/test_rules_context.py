import pytest
from pyspark.sql import functions as F

from tidewatch.operators import context, findings, graph, rules
from tidewatch.sources import corpus


def files(spark, text, path="a.py", syntax="python"):
    return spark.createDataFrame([(path, syntax, text, "clash")], "file_path string, syntax string, content string, lines string")


def lines(spark, text, path="a.py", syntax="python"):
    return corpus.lines(files(spark, text, path, syntax).drop("lines"))


def test_find_grammar():
    q = rules.parse_find("find eval\\( in Function where req and not sanitize")
    assert (q.find, q.scope, q.where, q.unless) == ("eval\\(", "function", "req", "sanitize")
    assert rules.parse_find("FIND x").scope == "source"
    for bad in ("", "SELECT x", "FIND ( "):
        with pytest.raises(ValueError):
            rules.parse_find(bad)


def test_find_execution(spark):
    q = r"FIND eval\( IN function WHERE req AND NOT sanitize"
    text = "def f():\nx = req.a\neval(x)"
    assert [r.line_no for r in rules.find_lines(files(spark, text), q).collect()] == [3]
    assert rules.find_lines(files(spark, text + "\nsanitize(x)"), q).count() == 0
    assert rules.find_lines(files(spark, text), q.replace("function", "import")).count() == 0


@pytest.mark.parametrize(("gap", "hit"), [(29, True), (30, False)])
def test_function_scope_reaches_29_lines_up(spark, gap, hit):
    text = "def f():\n" + "\n" * (gap - 1) + "target"
    assert (rules.find_lines(files(spark, text), "FIND target IN function").count() == 1) is hit


@pytest.mark.parametrize(("at", "kept"), [(8, True), (9, False), (29, False), (30, True)])
def test_negative_context_bounds(spark, at, kept):
    rows = ["x"] * 40
    rows[19] = "ctx.query.name"
    rows[at - 1] = "throw new Error"
    got = rules.scan_with_negation(files(spark, "\n".join(rows), "a.js", "javascript")).filter("rule_id = 'tw-js-query-value'")
    assert (got.count() == 1) is kept


def test_severity(spark):
    rows = [("CWE-89", "", "low", "critical"), ("", "resource leak", "medium", "critical"), ("", "potential injection", "low", "high"), ("", "x", "", "medium"), ("cwe-79", "", "info", "high")]
    df = spark.createDataFrame(rows, "c string, t string, s string, want string")
    assert df.select((rules.severity_of(F.col("c"), F.col("t"), F.col("s")) == F.col("want")).alias("ok")).filter("not ok").count() == 0


def test_comments_keep_offsets(spark):
    text = "a = 1 // x\n/* y\nz */ b\n# c"
    df = spark.createDataFrame([(text, ".js"), (text, ".py"), ("<!-- a\nb --> c", ".html"), (text, ".md"), ("", ".js"), (None, ".js")], "t string, e string")
    got = [r[0] for r in df.select(context.strip_comments(F.col("t"), F.col("e"))).collect()]
    assert got == ["a = 1     \n    \n     b\n# c", "a = 1 // x\n/* y\nz */ b\n   ", "      \n      c", text, "", None]


def test_pointer_snippet_anchor(spark):
    ln = files(spark, "a\n}\n\nb\n{\n// c\n\n\n};\nreturn x")
    adj = {r.line_no: r.adjusted for r in context.adjusted_pointers(ln).collect()}
    assert (adj[2], adj[3], adj[5], adj[7], adj[9]) == (1, 4, 4, 4, 10)
    place = spark.createDataFrame([("a.py", 1), ("a.py", 99)], "file_path string, line_no int")
    assert [r.snippet for r in context.snippets(ln, place).collect()] == ["→    1 | a\n     2 | }\n     3 | "]
    got = context.anchors(ln, place.withColumn("fragment", F.lit("RETURN")), 30).collect()
    assert {r.line_no: r.anchored for r in got} == {1: 10, 99: 99}
    # Nothing holds the fragment: a trivial line moves down before up.
    place = spark.createDataFrame([("a.py", 3), ("a.py", 5), ("gone.py", 2)], "file_path string, line_no int")
    got = context.anchors(ln, place.withColumn("fragment", F.lit("zzz")), 30).collect()
    assert {(r.file_path, r.line_no): r.anchored for r in got} == {("a.py", 3): 4, ("a.py", 5): 4, ("gone.py", 2): 2}
    got = context.anchors(files(spark, "x\nexecuteQuery(sql)\ny"), place.limit(1).withColumn("fragment", F.lit("executeQuery( other"))).collect()
    assert [r.anchored for r in got] == [2]


def test_chunks_cover_all_lines(spark):
    ln = lines(spark, "\n".join(map(str, range(1, 101))))
    c = sorted((r.from_line, r.to_line) for r in context.chunks(ln, 40, 5).collect())
    assert c[0][0] == 1 and c[-1][1] == 100 and all(b[0] == a[1] - 4 for a, b in zip(c, c[1:]))
    assert [(r.from_line, r.to_line) for r in context.chunks(lines(spark, "x"), 40, 5).collect()] == [(1, 1)]


def test_graph(spark):
    edge = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {r.node for r in graph.closure(edge, seed).collect()} == set("abcd")
    assert {r.node for r in graph.closure(edge, seed.limit(0)).collect()} == set()
    places = spark.createDataFrame([("a.py", n) for n in (2, 3, 8, 9)], "file_path string, line_no int")
    fn = graph.functions_at(files(spark, "x\ny\ndef f3():\n a\n b\n c\n d\n e\ndef f9():"), places)
    assert {r.line_no: r.fn for r in fn.collect()} == {3: "f3", 8: "f3", 9: "f9"}


def test_long_chains_and_no_entry_point(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(25)], "src string, dst string")
    assert graph.closure(chain, spark.createDataFrame([("n000",)], "node string")).count() == 26
    quiet = files(spark, "def alpha():\n  beta(1)\ndef gamma():\n  delta(2)")
    assert {r.name for r in graph.reachable(quiet).collect()} == {"alpha", "beta", "gamma", "delta"}
    entered = files(spark, "def main():\n  beta(1)\ndef gamma():\n  delta(2)")
    assert {r.name for r in graph.reachable(entered).collect()} == {"main", "beta"}


def test_unreachable_findings_and_web_files(spark):
    rows = [("a.py", 4, "r", "high", "text", 0.9), ("a.py", 2, "r", "high", "text", 0.9)]
    found = spark.createDataFrame(rows, "file_path string, line_no int, rule_id string, severity string, description string, confidence double")
    f = files(spark, "def main():\n  beta(1)\ndef gamma():\n  delta(2)")
    low = graph.annotated(found, graph.unreachable_places(f, found.select("file_path", "line_no")))
    got = {r.line_no: (r.severity, r.description, round(r.confidence, 2)) for r in low.collect()}
    assert got == {2: ("high", "text", 0.9), 4: ("info", "[UNREACHABLE] text (function 'gamma' is not called from any entry point)", 0.27)}
    web = files(spark, "router.get('/x')")
    got = {r.line_no: (r.severity, r.description) for r in findings.web_reachable(low, web).collect()}
    assert got == {2: ("high", "text"), 4: ("high", "text (function 'gamma' is not called from any entry point)")}


def test_class_scope_and_context_over_lines(spark):
    text = "class A {\n" + "x\n" * 48 + "target\ntarget"
    assert [r.line_no for r in rules.find_lines(files(spark, text), "FIND target IN class").collect()] == [50]
    q = r"FIND eval WHERE a\nb"
    assert rules.find_lines(files(spark, "a\nb\neval"), q).count() == 1
    assert rules.find_lines(files(spark, "a b\neval"), q).count() == 0


def test_one_exchange_at_most_for_contexts(spark):
    f = files(spark, "x").drop("lines")
    for df in (rules.scan_with_negation(f), rules.find_lines(f, r"FIND eval IN function WHERE req AND NOT sanitize"), context.adjusted_pointers(f)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_entropy_and_empty_files(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("abcd",), ("aab",), (None,)], "t string")
    got = [r[0] if r[0] is None else round(r[0], 4) for r in df.select(context.entropy(F.col("t"))).collect()]
    assert got == [None, 0.0, 2.0, 0.9183, None]
    empty = files(spark, "x").limit(0)
    places = spark.createDataFrame([], "file_path string, line_no int")
    for x in (rules.scan_with_negation(empty), rules.find_lines(empty, "FIND x"), context.snippets(empty, places), context.adjusted_pointers(empty), graph.marks(empty), graph.functions_at(empty, places)):
        assert x.count() == 0
