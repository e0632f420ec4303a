import datetime as dt
import random

from tidewatch.llm import survivors as s

REPORTS = "report_id long, fingerprint string, source string, severity string, confidence double, ai_validated string, remediation string, reported_at timestamp, rank int"
TRUST = [("low", 1), ("Mid ", 2), ("high", 3)]


def at(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def run(spark, rows, f=s.found):
    r = spark.createDataFrame([(*x[:7], at(x[7]), None) for x in rows], REPORTS)
    return f(r, spark.createDataFrame(TRUST, "source string, trust_rank int")).collect()


def brute(rows):
    rank = {"low": 1, "mid": 2, "high": 3}
    out = set()
    groups = {}
    for r in rows:
        if r[1] is not None:
            groups.setdefault(r[1], {})[(r[0], r[7])] = r
    for fp, g in groups.items():
        if len({r[0] for r in g.values()}) < 2:
            continue
        for i, name in enumerate(s.FIELDS, 3):
            ok = []
            for r in g.values():
                v = r[i]
                good = v is not None and 0 < v <= 1 if name == "confidence" else (v or "").strip().lower() not in ("", "n/a", "none", "error", "tbd")
                if good:
                    ok.append((r[7] if r[7] is not None else -1, max((rank.get(p.strip().lower(), -1) for p in (r[2] or "").split(",")), default=-1), r[0]))
            out |= {(fp, name, a[2]) for a in ok if not any(b[0] > a[0] or b[1] > a[1] for b in ok)}
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        row = (i, r.choice([None, *"abcdefghijkl"]), r.choice(["low", " HIGH", "mid, high", "low,mid", "other", None]), r.choice(["High", "low", "N/A", None, ""]), r.choice([0.5, 0.0, -1.0, 1.5, float("nan"), None, 1.0]), r.choice(["Yes", "no", "Error", None]), r.choice(["Do it.", "TBD", None, " "]), r.choice([None, *range(12)]))
        rows += [row] * r.choice((1, 1, 2))
    got = [tuple(x) for x in run(spark, rows)]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_single_report_empty_table_and_ties(spark):
    one = (1, "a", "low", "high", 0.5, "Yes", "Fix it", 1)
    assert run(spark, [one, one]) == []
    assert spark.createDataFrame([], REPORTS).count() == 0 and run(spark, [one, (2, None, *one[2:])]) == []
    two = run(spark, [one, (2, *one[1:])])
    assert sorted((x.field_name, x.report_id) for x in two) == sorted((f, i) for f in s.FIELDS for i in (1, 2))


def test_notes_are_no_values():
    import re

    for v in ("n/a", "none", "tbd", "see above.", "—", "...", "?", "", "unknown", "not available"):
        assert re.match(s.NO_VALUE.replace(r"\p{P}\p{S}", r"\W_"), v), v
    for v in ("patch.", "escape it.", "no action needed beyond the upgrade.", "yes", "no", "none of the callers needs it; remove the call"):
        assert not re.match(s.NO_VALUE.replace(r"\p{P}\p{S}", r"\W_"), v), v
    for v in ("skipped (cancelled)", "error", "pending", "validation failed", "could not be checked"):
        assert re.match(s.NOT_CHECKED, v), v
    for v in ("yes", "no", "no (false positive)", "discovered by ai"):
        assert not re.match(s.NOT_CHECKED, v), v


def test_survivor_fills_from_next_layer(spark):
    rows = [(1, "a", "high", "high", None, None, None, 9), (2, "a", "low", None, 0.4, "Yes", "old advice", 1), (3, "a", "low", "low", 0.6, None, "new advice", 5)]
    (x,) = run(spark, rows, s.survivors)
    assert (x.severity, x.severity_report_id) == ("high", 1)
    assert (x.confidence, x.remediation, x.remediation_report_id) == (0.6, "new advice", 3)
    assert (x.ai_validated, x.ai_validated_report_id) == ("Yes", 2)


def test_layers_match_definition(spark):
    r = random.Random(8)
    rows = [(i, "a", r.choice(["low", "mid", "high"]), r.choice(["high", None]), r.choice([0.5, None]), r.choice(["Yes", None]), r.choice(["Fix", None]), r.randrange(6)) for i in range(40)]
    df = spark.createDataFrame([(*x[:7], at(x[7]), None) for x in rows], REPORTS)
    cells = [c for x in s.layered(s.cells(s.rated(df, spark.createDataFrame(TRUST, "source string, trust_rank int")))).collect() for c in x.cells]
    pts = [((c.c.complete, c.c.at, c.c["rank"]), c.layer) for c in cells]

    def layer(p):
        above = [q for q, _ in pts if all(a >= b for a, b in zip(q, p)) and q != p]
        return 1 + max(map(layer, above), default=0)

    assert all(layer(p) == n for p, n in pts)
