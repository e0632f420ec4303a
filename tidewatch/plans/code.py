"""Queries on files and lines: scans, FIND, contexts (documents as the corpus)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import answers, context, rules
from tidewatch.operators import pattern_engine as engine
from tidewatch.session import table
from tidewatch.sources import corpus

FIND_PLAIN = r"FIND db\.fetch|repo\.load|dao\.load WHERE request|req|param AND NOT throw"
FIND_FUNCTION = r"FIND return IN function WHERE limit|load"
FIND_CLASS = r"FIND [a-z]+ IN class"
FIND_IMPORT = r"FIND \w+ IN import"

FIND_RULES = (("tw-find-load", FIND_PLAIN, "high", "CWE-89", "unchecked load"), ("tw-find-return", FIND_FUNCTION, "low", "", "possible bypass in a function"))


def _files(spark, sf):
    return corpus.files(table(spark, sf, "documents"))


def _lines(spark, sf):
    return corpus.lines(_files(spark, sf))


def lines_relation(spark, sf):
    return _lines(spark, sf).groupBy("file_path").agg(F.max("line_no").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def lang_counts(spark, sf):
    f = corpus.with_language(_files(spark, sf))
    return f.groupBy("ext", "lang").agg(F.count("*").alias("n_files"), F.sum(F.length("content")).alias("n_chars"))


def pattern_scan_lines(spark, sf):
    return rules.scan(_lines(spark, sf)).select("file_path", "line_no", "rule_id")


def pattern_scan_matches(spark, sf):
    return rules.scan_matches(_files(spark, sf))


def negative_context(spark, sf):
    return rules.scan_with_negation(_files(spark, sf)).select("file_path", "line_no", "rule_id")


def rule_findings(spark, sf):
    return rules.findings(_files(spark, sf)).drop("description")


def pattern_engine(spark, sf):
    """One finding a match, comments blanked, over whole files, and the findings of FIND queries."""
    f = corpus.with_language(_files(spark, sf))
    return engine.scan_files(f, rules.RULES).unionByName(engine.scan_queries(_files(spark, sf), FIND_RULES))


def file_frameworks(spark, sf):
    f = corpus.with_language(_files(spark, sf))
    return f.select(F.explode(engine.frameworks_of(F.lower("ext"), F.col("content"))).alias("framework")).groupBy("framework").agg(F.count("*").alias("n_files"))


def regex_test(spark, sf):
    return engine.first_matches(_files(spark, sf), r"[a-z]+_[a-z]+\(")


def walk_counts(spark, sf):
    return corpus.walk_counts(corpus.scannable(_files(spark, sf)))


def directory_summary(spark, sf):
    """Files and imports of each folder, the largest 80 folders (a top-k report)."""
    f = _files(spark, sf)
    imports = F.size(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:import|from|require|use|#include)\b.*$"), 0))
    g = f.groupBy(F.regexp_replace("file_path", r"/?[^/]*$", "").alias("folder")).agg(F.count("*").alias("n_files"), F.sum(imports).alias("n_imports"))
    return g.orderBy(F.desc("n_files"), "folder").limit(80)


def discovery_files(spark, sf):
    return answers.shown_files(_files(spark, sf)).select("file_path", F.octet_length("content").alias("n_bytes"))


def changed_files(spark, sf):
    """Findings of the last change only: rule findings semi-joined with the files changed since a date."""
    docs = table(spark, sf, "documents").filter(F.col("text").isNotNull() & (F.col("created_at") >= F.lit("2025-01-01").cast("timestamp")))
    return rules.scan(_lines(spark, sf)).select("file_path", "line_no", "rule_id").join(corpus.files(docs).select("file_path").distinct(), "file_path", "left_semi")


def code_window(spark, sf):
    w = answers.code_window(_files(spark, sf), _places(spark, sf), 60, 20, 40)
    return w.select("file_path", "line_no", "from_line", "to_line", F.length("window").alias("n_chars"))


def find_where_not(spark, sf):
    return rules.find_lines(_files(spark, sf), FIND_PLAIN)


def find_function_scope(spark, sf):
    return rules.find_lines(_files(spark, sf), FIND_FUNCTION)


def find_class_scope(spark, sf):
    return rules.find_lines(_files(spark, sf), FIND_CLASS)


def find_import_scope(spark, sf):
    return rules.find_lines(_files(spark, sf), FIND_IMPORT)


def strip_comments(spark, sf):
    f = corpus.with_language(_files(spark, sf))
    t = context.strip_comments(F.col("content"), F.col("ext"))
    return f.select("file_path", F.sha2(t, 256).alias("stripped_hash"), F.length(t).alias("n_chars"))


def line_pointer_adjust(spark, sf):
    return context.adjusted_pointers(_files(spark, sf)).filter(F.col("line_no") != F.col("adjusted"))


def _places(spark, sf):
    return rules.scan(_lines(spark, sf)).select("file_path", "line_no").distinct()


def code_snippets(spark, sf):
    return context.snippets(_files(spark, sf), _places(spark, sf))


def anchor_fragment(spark, sf):
    return context.anchors(_files(spark, sf), rules.scan(_lines(spark, sf)).select("file_path", "line_no", F.trim("line").alias("fragment")).withColumn("line_no", F.greatest(F.col("line_no") - 4, F.lit(1))).distinct())


def chunk_overlap(spark, sf):
    return context.chunks(_lines(spark, sf), 40, 5)


def entropy_tokens(spark, sf):
    words = _files(spark, sf).select(F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9+/_-]{20,}"), 0)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return words.select("token", "n", F.round(context.entropy(F.col("token")), 6).alias("entropy")).filter("entropy > 4.0")


EXT_CASE = "CASE coalesce(syntax, '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in corpus.EXTENSIONS.items()) + " ELSE '.txt' END"
FILES_SQL = rf"""files AS (
  SELECT concat(coalesce(source, 'none'), '/', doc_id, {EXT_CASE}) AS file_path, coalesce(syntax, '') AS syntax,
         {EXT_CASE} AS ext, regexp_replace(text, '\r\n?', chr(10), 'g') AS content
  FROM documents WHERE text IS NOT NULL)"""
LINES_SQL = (
    FILES_SQL
    + r""",
lines AS (SELECT file_path, syntax, ext, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line
          FROM (SELECT *, string_split(content, chr(10)) AS a FROM files))"""
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _langs(r: rules.Rule) -> str:
    return "syntax IN (" + ", ".join(map(_q, r.languages)) + ")" if r.languages else "true"


def _scan_sql(rs, negated: bool = False) -> str:
    parts = []
    for r in rs:
        hit = " OR ".join(f"regexp_matches(line, {_q(p)})" for p in r.patterns)
        keep = ""
        if negated and r.negatives:
            neg = " OR ".join(f"regexp_matches(near, {_q(p)})" for p in r.negatives)
            keep = f" AND NOT ({neg})"
            src = f"(SELECT *, array_to_string(list(line) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN {rules.NEGATIVE_BEFORE} PRECEDING AND {rules.NEGATIVE_AFTER} FOLLOWING), chr(10)) AS near FROM lines)"
        else:
            src = "lines"
        parts.append(f"SELECT file_path, line_no, {_q(r.rule_id)} AS rule_id FROM {src} WHERE {_langs(r)} AND ({hit}){keep}")
    return " UNION ALL ".join(parts)


def _find_sql(q: str) -> str:
    f = rules.parse_find(q)
    over = "OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"
    cols, keep = [], [f"regexp_matches(line, {_q('(?i)' + f.find)})"]
    trimmed = "trim(line, ' ' || chr(9) || chr(13))"
    if f.scope in rules.SCOPES:
        p, above = rules.SCOPES[f.scope]
        cols.append(f"max(regexp_matches({trimmed}, {_q(p)})::INT) {over.format(above, 0)} = 1 AS in_scope")
        keep.append("in_scope")
    elif f.scope == "import":
        keep.append(f"regexp_matches({trimmed}, {_q(rules.IMPORT)})")
    if f.where:
        cols.append(f"regexp_matches(array_to_string(list(line) {over.format(5, 5)}, chr(10)), {_q('(?i)' + f.where)}) AS has")
        keep.append("has")
    if f.unless:
        cols.append(f"regexp_matches(array_to_string(list(line) {over.format(5, 5)}, chr(10)), {_q('(?i)' + f.unless)}) AS un")
        keep.append("NOT un")
    return f"WITH {LINES_SQL} SELECT file_path, line_no FROM (SELECT *{''.join(', ' + c for c in cols)} FROM lines) WHERE {' AND '.join(keep)}"


_OPEN = rules.without_blocked(rules.RULES)
_META = ", ".join(f"({_q(r.rule_id)}, {_q(r.severity)}, {_q(r.cwe)}, {_q((r.description + ' ' + r.rule_id).lower())})" for r in _OPEN)
_LIST = lambda xs: "(" + ", ".join(map(_q, xs)) + ")"
_JUNK = f"regexp_matches(trim(line, ' ' || chr(9) || chr(13)), {_q(context.JUNK)})"



def _blanked(name: str, source: str, column: str, pattern: str) -> str:
    """A table (file_path, t) of texts with a pattern's matches as blanks, line ends kept."""
    blank = "regexp_replace(hits[i], '[^\\r\\n]', ' ', 'g')"
    return f"""{name} AS (SELECT file_path, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce({blank}, '')), '') AS t
  FROM (SELECT file_path, string_split_regex({column}, {_q(pattern)}) AS pieces, regexp_extract_all({column}, {_q(pattern)}) AS hits FROM {source}))"""


QUERIES = {
    f.__name__: f
    for f in (
        lines_relation, lang_counts, pattern_scan_lines, pattern_scan_matches, negative_context, rule_findings, find_where_not, find_function_scope, find_class_scope,
        find_import_scope, pattern_engine, file_frameworks, regex_test, walk_counts, directory_summary, discovery_files, changed_files, code_window, strip_comments, line_pointer_adjust, code_snippets, anchor_fragment, chunk_overlap, entropy_tokens,
    )
}
ORACLE = {
    "lines_relation": f"WITH {LINES_SQL} SELECT file_path, max(line_no) AS n_lines, sum(length(line)) AS n_chars FROM lines GROUP BY 1",
    "lang_counts": f"WITH {FILES_SQL} SELECT ext, CASE ext " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in corpus.LANGUAGES.items()) + " ELSE 'unknown' END AS lang, count(*) AS n_files, sum(length(content)) AS n_chars FROM files GROUP BY 1, 2",
    "pattern_scan_lines": f"WITH {LINES_SQL} {_scan_sql(rules.RULES)}",
    "pattern_scan_matches": f"WITH {FILES_SQL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT file_path, {_q(r.rule_id)} AS rule_id, " + " + ".join(f"len(regexp_extract_all(content, {_q(p)}))" for p in r.patterns) + f" AS n_matches FROM files WHERE {_langs(r)}" for r in rules.RULES) + ") WHERE n_matches > 0",
    "negative_context": f"WITH {LINES_SQL} {_scan_sql(rules.RULES, True)}",
    "rule_findings": f"""WITH {LINES_SQL}, m AS ({_scan_sql(_OPEN, True)}), meta(rule_id, rs, cwe, t) AS (VALUES {_META}),
x AS (SELECT m.*, cwe, t, rs, CASE rs WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.70 WHEN 'low' THEN 0.50 WHEN 'info' THEN 0.40 ELSE 0.60 END::DOUBLE AS confidence FROM m JOIN meta USING (rule_id))
SELECT file_path, line_no, rule_id, cwe, confidence,
  CASE WHEN confidence < 0.3 THEN 'info' WHEN cwe IN {_LIST(rules.CRITICAL_CWES)} THEN 'critical' WHEN cwe IN {_LIST(rules.HIGH_CWES)} THEN 'high'
       WHEN (contains(t, 'rce') OR contains(t, 'injection') OR contains(t, 'bypass')) THEN CASE WHEN contains(t, 'potential') OR contains(t, 'possible') THEN 'high' ELSE 'critical' END
       WHEN rs = '' THEN 'medium' ELSE rs END AS severity FROM x""",
    "find_where_not": _find_sql(FIND_PLAIN),
    "find_function_scope": _find_sql(FIND_FUNCTION),
    "find_class_scope": _find_sql(FIND_CLASS),
    "find_import_scope": _find_sql(FIND_IMPORT),
    "strip_comments": f"""WITH {FILES_SQL}, {_blanked("b", "files", "content", "(?s)/\\*.*?\\*/")}, {_blanked("c", "b", "t", "//[^\\n]*")}, {_blanked("h", "files", "content", "#[^\\n]*")}
SELECT file_path, sha256(t) AS stripped_hash, length(t) AS n_chars FROM (SELECT file_path, CASE WHEN ext IN {_LIST(context.C_FAMILY)} THEN c.t WHEN ext IN {_LIST(context.HASH_FAMILY)} THEN h.t ELSE content END AS t FROM files JOIN c USING (file_path) JOIN h USING (file_path))""",
    "line_pointer_adjust": f"""WITH {LINES_SQL}, j AS (SELECT file_path, line_no, {_JUNK} AS junk FROM lines),
w AS (SELECT *, {", ".join(f"lag(junk, {d}) OVER f AS u{d}, lead(junk, {d}) OVER f AS d{d}" for d in (1, 2, 3))} FROM j WINDOW f AS (PARTITION BY file_path ORDER BY line_no))
SELECT * FROM (SELECT file_path, line_no, CASE WHEN NOT junk THEN line_no {" ".join(f"WHEN NOT u{d} THEN line_no - {d} WHEN NOT d{d} THEN line_no + {d}" for d in (1, 2, 3))} ELSE line_no END AS adjusted FROM w) WHERE adjusted <> line_no""",
    "code_snippets": f"""WITH {LINES_SQL}, p AS (SELECT DISTINCT file_path, line_no AS pos FROM ({_scan_sql(rules.RULES)}))
SELECT p.file_path, p.pos AS line_no, string_agg(CASE WHEN l.line_no = p.pos THEN '→ ' ELSE '  ' END || CASE WHEN l.line_no < 10000 THEN lpad(l.line_no::VARCHAR, 4, ' ') ELSE substr(l.line_no::VARCHAR, 1, 4) END || ' | ' || l.line, chr(10) ORDER BY l.line_no) AS snippet
FROM p JOIN lines l ON l.file_path = p.file_path AND l.line_no BETWEEN p.pos - 2 AND p.pos + 2 GROUP BY 1, 2""",
    "anchor_fragment": f"""WITH {LINES_SQL}, p AS (SELECT DISTINCT file_path, greatest(line_no - 4, 1) AS line_no, trim(line, ' ') AS fragment FROM (SELECT l.file_path, l.line_no, l.line FROM lines l SEMI JOIN ({_scan_sql(rules.RULES)}) s USING (file_path, line_no))),
q AS (SELECT *, lower(fragment) AS low, CASE WHEN length(regexp_extract(lower(fragment), '^([^ \\t(=;]*)[ \\t(=;]', 1)) > 6 THEN regexp_extract(lower(fragment), '^([^ \\t(=;]*)[ \\t(=;]', 1) ELSE lower(fragment) END AS short FROM p),
c AS (SELECT q.file_path, q.line_no, q.fragment, arg_min(l.line_no, abs(l.line_no - q.line_no) * 100000000 + l.line_no) FILTER (contains(lower(l.line), low) OR contains(lower(l.line), short)) AS pos
      FROM q JOIN lines l ON l.file_path = q.file_path AND l.line_no BETWEEN q.line_no - 30 AND q.line_no + 30 GROUP BY ALL),
k AS (SELECT file_path, line_no, fragment, coalesce(pos, line_no) AS pos FROM c),
t AS (SELECT file_path, line_no AS at, regexp_matches(trim(line, ' ' || chr(9) || chr(13)), {_q(context.TRIVIAL)}) AS trivial FROM lines),
w AS (SELECT k.file_path, k.line_no, k.fragment, k.pos, coalesce(arg_min(t.at, CASE t.at - k.pos WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN -1 THEN 2 WHEN 2 THEN 3 ELSE 4 END) FILTER (NOT t.trivial), k.pos) AS anchored
      FROM k JOIN t ON t.file_path = k.file_path AND t.at BETWEEN k.pos - 2 AND k.pos + 2 GROUP BY k.file_path, k.line_no, k.fragment, k.pos)
SELECT file_path, line_no, fragment, anchored FROM w""",
    "chunk_overlap": f"""WITH {LINES_SQL}, n AS (SELECT file_path, max(line_no) AS n FROM lines GROUP BY 1),
s AS (SELECT file_path, n, unnest(range(0, greatest(ceil((n - 5) / 35.0)::BIGINT - 1, 0) + 1)) AS chunk_no FROM n)
SELECT s.file_path, s.chunk_no, s.chunk_no * 35 + 1 AS from_line, least(s.chunk_no * 35 + 40, s.n) AS to_line, sum(length(line) + 1) AS n_chars
FROM s JOIN lines l ON l.file_path = s.file_path AND l.line_no BETWEEN s.chunk_no * 35 + 1 AND least(s.chunk_no * 35 + 40, s.n) GROUP BY ALL""",
    "entropy_tokens": f"""WITH {FILES_SQL}, t AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '[A-Za-z0-9+/_-]{{20,}}')) AS token FROM files) GROUP BY 1),
c AS (SELECT token, n, ch, count(*) AS k FROM (SELECT token, n, unnest(string_split(token, '')) AS ch FROM t) GROUP BY ALL),
e AS (SELECT token, n, round(-sum(k / length(token)::DOUBLE * log2(k / length(token)::DOUBLE)), 6) AS entropy FROM c GROUP BY ALL)
SELECT token, n, entropy FROM e WHERE entropy > 4.0""",
    "file_frameworks": f"WITH {FILES_SQL} SELECT framework, count(*) AS n_files FROM (" + " UNION ALL ".join(
        f"SELECT '{k}' AS framework FROM files WHERE " + " OR ".join(f"(ext IN ({', '.join(map(_q, e))}) AND {'regexp_matches(content, ' + _q(p) + ')' if p else 'true'})" for e, p in ways) for k, ways in engine.IN_FILE.items()) + ") GROUP BY 1",
    "regex_test": rf"WITH {LINES_SQL} SELECT file_path, line_no, regexp_extract(line, '[a-z]+_[a-z]+\(') AS match FROM lines WHERE regexp_matches(line, '[a-z]+_[a-z]+\(')",
    "walk_counts": f"""WITH {FILES_SQL}, l AS (SELECT file_path, ext, CASE ext {" ".join(f"WHEN '{e}' THEN '{n}'" for e, n in corpus.LANGUAGES.items())} ELSE 'unknown' END AS lang FROM files)
SELECT kind, name, count(*) AS n_files FROM (SELECT 'language' AS kind, CASE lang WHEN 'unknown' THEN 'other' ELSE lang END AS name FROM l UNION ALL SELECT 'skipped_ext', ext FROM l WHERE lang = 'unknown'
UNION ALL SELECT 'folder', regexp_replace(file_path, '/?[^/]*$', '') FROM l) GROUP BY ALL""",
    "directory_summary": rf"""WITH {FILES_SQL} SELECT regexp_replace(file_path, '/?[^/]*$', '') AS folder, count(*) AS n_files, sum(len(regexp_extract_all(content, '(?m)^\s*(?:import|from|require|use|#include)\b.*$'))) AS n_imports
FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 80""",
    "discovery_files": f"""WITH {FILES_SQL} SELECT file_path, octet_length(encode(content)) AS n_bytes FROM files WHERE ext IN ({", ".join(map(_q, answers.SHOWN_EXTENSIONS))})
AND octet_length(encode(content)) > 50 AND octet_length(encode(content)) < 10000000 AND length(trim(content, ' ')) >= 150""",
    "changed_files": f"""WITH {LINES_SQL}, c AS (SELECT DISTINCT concat(coalesce(source, 'none'), '/', doc_id, {EXT_CASE}) AS file_path FROM documents WHERE text IS NOT NULL AND created_at >= TIMESTAMP '2025-01-01')
SELECT * FROM ({_scan_sql(rules.RULES)}) SEMI JOIN c USING (file_path)""",
    "code_window": f"""WITH {LINES_SQL}, p AS (SELECT DISTINCT file_path, line_no FROM ({_scan_sql(rules.RULES)})), n AS (SELECT file_path, max(line_no) AS n FROM lines GROUP BY 1),
s AS (SELECT p.*, CASE WHEN n <= 60 THEN 1 ELSE greatest(line_no - 20, 1) END AS from_line, CASE WHEN n <= 60 THEN n ELSE least(n, line_no + 20) END AS to_line FROM p JOIN n USING (file_path))
SELECT s.file_path, s.line_no, from_line, to_line, sum(length(line) + 1) - 1 AS n_chars FROM s JOIN lines l ON l.file_path = s.file_path AND l.line_no BETWEEN from_line AND to_line GROUP BY ALL""",
}
