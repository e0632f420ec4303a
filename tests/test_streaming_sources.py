import datetime as dt

import pytest

from tidewatch import session
from tidewatch.sources import corpus, manifests, store
from tidewatch.streaming import events


def test_latest_status_stream(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, "fingerprint string, status string, reported_at timestamp").write.parquet(str(tmp_path / "in" / str(n)))

    t = lambda d: dt.datetime(2024, 1, d)
    put(1, [("a", "open", t(1)), ("a", "resolved", t(3)), ("b", "open", t(1))])

    def run():
        s = spark.readStream.schema("fingerprint string, status string, reported_at timestamp").parquet(str(tmp_path / "in" / "*"))
        events.keep_latest(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {r.fingerprint: r.status for r in events.latest(spark, str(tmp_path / "out")).collect()}

    assert run() == {"a": "resolved", "b": "open"}
    put(2, [("a", "open", t(2)), ("b", "ignored", t(9))])
    assert run() == {"a": "resolved", "b": "ignored"}


def test_walk_and_language(spark, tmp_path):
    for p in ("src/a.go", "src/Dockerfile", "node_modules/x.js", "src/b.xyz"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    got = {r.base_name: r.lang for r in corpus.walk(spark, str(tmp_path)).collect()}
    assert got == {"a.go": "go", "Dockerfile": "dockerfile", "b.xyz": "unknown"}


def test_stored_scans(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", "final", 1, "x"), ("b", "final", 2, "x"), ("c", "ai", 3, "x")], "scan_id string, phase string, db_id long, extra string")
    store.replace_scans(old, path)
    store.replace_scans(spark.createDataFrame([("a", "final", 4, "high")], "scan_id string, phase string, db_id long, severity string"), path)
    store.delete_scans(spark, path, ["c", "none"])
    got = store.read_scans(spark, path)
    assert {(r.scan_id, r.db_id, r.severity) for r in got.collect()} == {("a", 4, "high"), ("b", 2, None)}
    assert {"status", "exploit_path", "extra"} <= set(got.columns)


def test_all_manifests_of_the_top_folder(spark):
    files = [
        ("package.json", '{"dependencies": {"a": "^1"}}'), ("sub/package.json", '{"dependencies": {"no": "1"}}'), ("requirements.txt", "b==2"), ("go.mod", "require x/c v3"), ("pom.xml", "<dependency><groupId>g</groupId><artifactId>d</artifactId></dependency>"),
        ("build.gradle", "api 'g:e:5'"), ("composer.json", '{"require": {"f/f": "6"}}'), ("Gemfile.lock", "specs:\n  g (7)"), ("yarn.lock", 'h@1:\n  version "8"'), ("pnpm-lock.yaml", "  /i/9:"), ("other.txt", "z==1"),
    ]
    got = {(r.name, r.version, r.ecosystem) for r in manifests.collect(spark.createDataFrame(files, "file_path string, content string")).collect()}
    assert got == {("a", "1", "npm"), ("b", "2", "PyPI"), ("x/c", "3", "Go"), ("g:d", "latest", "Maven"), ("g:e", "5", "Maven"), ("f/f", "6", "Packagist"), ("g", "7", "RubyGems"), ("h", "8", "npm"), ("i", "9", "npm")}


def test_rule_folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.yaml").write_text("- id: one\n  patterns: ['x']\n  framework: flask\n- id: two\n  pattern: \"a\\d+\"\n  severity: HIGH\n")
    (tmp_path / "sub" / "b.yml").write_text("rules:\n- id: one\n  patterns: ['y']\n- id: three\n  patterns: [{regex: 'z'}]\n")
    got = {r.rule_id: r for r in manifests.load_rule_folder(str(tmp_path))}
    assert {k: r.patterns for k, r in got.items()} == {"one": ("x",), "two": (r"a\d+",), "three": ("z",)}
    assert got["one"].framework == "flask" and got["two"].severity == "high"


def test_windows_are_those_of_the_last_batch(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 5), 1, "a", 2.0, "{}"), (2, dt.datetime(2024, 1, 1, 6), 1, "a", 3.0, "{}"), (3, dt.datetime(2024, 1, 2, 6), 1, "b", None, "{}")]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(path)
    got = {(r.window_start.day, r.event_type, r.n_events, r.total) for r in events.windowed_once(spark, path).collect()}
    assert got == {(1, "a", 2, 5.0), (2, "b", 1, None)}


def test_a_cluster_must_name_its_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
