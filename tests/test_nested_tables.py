import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.operators import nested_tables as n

DOC = {
    "results": [
        None,
        {"source": {"path": "/w/go.mod"}, "packages": [{"package": {"name": "p"}, "vulnerabilities": {"id": "V", "severity": [{"type": "CVSS_V3", "score": 9.8}], "affected": [{"package": {"name": "p"}, "ranges": [{"events": [{"introduced": "0"}, 3, {"fixed": "2"}]}]}]}}]},
    ],
    "other": {"packages": [{"vulnerabilities": [{}]}]},
}
PATHS = [
    "results[1]", "results[1].packages[0]", "results[1].packages[0].vulnerabilities[0]", "results[1].packages[0].vulnerabilities[0].severity[0]",
    "results[1].packages[0].vulnerabilities[0].affected[0]", "results[1].packages[0].vulnerabilities[0].affected[0].ranges[0]",
    "results[1].packages[0].vulnerabilities[0].affected[0].ranges[0].events[0]", "results[1].packages[0].vulnerabilities[0].affected[0].ranges[0].events[2]",
]


def paths(payload):
    d = n.find_document(payload)
    return sorted(p for _, p, _ in n.label(d)) if d else []


def test_positions_and_single_objects():
    assert paths(json.dumps(DOC)) == sorted(PATHS)


def test_wrappings():
    for text in (json.dumps(DOC), json.dumps(DOC, indent=2), "﻿" + json.dumps(DOC), f"WARN: {{stale}}\n{json.dumps(DOC)}\ndone", json.dumps(json.dumps(DOC)), json.dumps({"data": DOC}), json.dumps([DOC]), f"```json\n{json.dumps(DOC)}\n```", "out: " + json.dumps(json.dumps(DOC))):
        assert paths(text) == sorted(PATHS), text[:40]


def test_damage_gives_nothing():
    whole = json.dumps(DOC)
    for cut in range(1, len(whole)):
        assert paths(whole[:cut]) == []
        assert paths("log\n" + whole[:cut] + "\nended") == []
    for bad in ("", "null", "{}", "Error: reset", "[]", '"x"', "{" * 5000, "[" * 100_000):
        assert paths(bad) == []


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["results", "vulns", "packages", "severity", "affected", "events", "ranges", "vulnerabilities"]), x, max_size=3), max_leaves=20))
def test_paths_lead_to_their_objects(value):
    d = n.find_document(json.dumps(value))
    for _, path, obj in n.label(d) if d else []:
        at = d
        for step in path.split("."):
            name, i = step[:-1].split("[")
            at = at[name]
            at = at[int(i)] if isinstance(at, list) else at
        assert at is obj


def test_tables_link_to_parents_and_repeats_count_once(spark):
    rows = [(1, json.dumps(DOC), "x"), (1, json.dumps(DOC), "y"), (2, None, "z"), (3, "", "z"), (None, json.dumps({"vulns": [{"id": "A"}]}), "z")]
    df = spark.createDataFrame(rows, "result_id long, payload string, node_path string")
    got = n.nodes(df).collect()
    assert sorted(r.node_path for r in got if r.result_id == 1) == sorted(PATHS)
    assert [r.node_path for r in got if r.result_id is None] == ["vulns[0]"]
    have = {(r.result_id, r.node_path) for r in got} | {(1, ""), (None, "")}
    assert all((r.result_id, r.parent_path) in have for r in got)
    sev = n.flat_tables(df)["severity"].collect()
    assert [(r.score, r.parent_path) for r in sev] == [("9.8", PATHS[2])]
    assert [(r.package_name, r.introduced, r.fixed) for r in n.affected_events(df).orderBy("node_path").collect()] == [("p", "0", None), ("p", None, "2")]


def test_empty_table(spark):
    assert n.nodes(spark.createDataFrame([], "result_id long, payload string")).count() == 0
