import datetime as dt

from tidewatch.operators import snapshot_diff as d

SCANS = "scan_id string, target string, branch string, status string, created_at timestamp, updated_at timestamp, scan_id2 string"
FIND = "db_id long, scan_id string, phase string, rule_id string, file_path string, line_number string, severity string, status string, ai_validated string, remediation string, side string"


def at(n):
    return dt.datetime(2024, 1 + n, 1)


def tables(spark, finds, scans=None):
    scans = scans or [(s, "t", "b", "completed", at(i), at(i), "x") for i, s in enumerate("ABC")]
    return spark.createDataFrame(scans, SCANS), spark.createDataFrame(finds, FIND)


def row(i, scan, rule="r", path="a/b.py", line="5", sev="high", status=None, ai=None, rem=None, phase="final"):
    return (i, scan, phase, rule, path, line, sev, status, ai, rem, "clash")


def kinds(spark, finds, scans=None):
    return sorted((r.prev_scan_id, r.scan_id, r.change_kind, r.file_path, r.start_line) for r in d.found(*tables(spark, finds, scans)).collect())


def test_new_fixed_changed_and_unchanged(spark):
    finds = [
        row(1, "A"), row(2, "B", path=".\\a//b.py", line="5-9", sev=" HIGH ", status="Open"),
        row(3, "A", line="7"), row(4, "B", line="8"),
        row(5, "A", line="9"), row(6, "B", line="9", sev="low"),
    ]
    assert [k for k in kinds(spark, finds) if k[1] == "B"] == [("A", "B", "changed", "a/b.py", 9), ("A", "B", "fixed", "a/b.py", 7), ("A", "B", "new", "a/b.py", 8)]


def test_scan_without_findings_and_gap(spark):
    assert kinds(spark, [row(1, "A"), row(2, "C")]) == [("A", "B", "fixed", "a/b.py", 5), ("B", "C", "new", "a/b.py", 5)]


def test_last_status_counts_and_failed_scans_are_skipped(spark):
    scans = [("A", "t", "b", "completed", at(0), at(0), None), ("B", "t", "b", "completed", at(1), at(1), None), ("B", "t", "b", "failed", at(1), at(2), None), ("C", "t", "b", "Completed ", at(3), at(3), None)]
    assert kinds(spark, [row(1, "A"), row(2, "B", line="1"), row(3, "C")], scans) == []


def test_repeats_nulls_and_missing_identity(spark):
    finds = [row(1, "A"), row(1, "A"), row(2, "A"), row(3, "B"), row(4, "B", rule=None), row(5, "B", path=" "), row(6, "B", line=None), row(7, "B", line="N/A"), row(8, None), row(9, "gone"), row(10, "B", phase="ai", line="77")]
    assert [k for k in kinds(spark, finds) if k[1] == "B"] == [("A", "B", "new", "a/b.py", 0)]


def test_empty_tables(spark):
    s, f = tables(spark, [row(1, "A")])
    assert d.found(s.limit(0), f).count() == 0
    assert d.found(s, f.limit(0)).count() == 0


def test_same_month_and_tie_in_order(spark):
    t = dt.datetime(2024, 5, 5)
    scans = [(s, "t", "b", "completed", t, t, None) for s in "ABC"] + [("D", "t", "b", "completed", None, t, None)]
    df = spark.createDataFrame(scans, SCANS)
    assert sorted((r.scan_id, r.prev_scan_id) for r in d.counting_scans(df).collect()) == [("A", "D"), ("B", "A"), ("C", "B"), ("D", None)]


def test_summary_counts_every_compared_scan(spark):
    r = {x.scan_id: (x.new_findings, x.fixed_findings, x.changed_findings) for x in d.change_summary(*tables(spark, [row(1, "A")])).collect()}
    assert r == {"B": (0, 1, 0), "C": (0, 0, 0)}
