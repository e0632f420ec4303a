"""Calls and assignments of source files as rows, checks on them, and the ordered taint pass.

Files are scanned whole in Arrow batches (one pass, no exchange); checks are plain filters.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars as fn
from tidewatch.operators.context import entropy
from tidewatch.operators.graph import closure
from tidewatch.session import cut

_CALL = re.compile(r"((?:new\s+)?[A-Za-z_$][\w$.\->:]*)\s*(!?)\(")
_ASSIGN = re.compile(r"^\s*(?:(?:const|let|var|final|private|public|static|String|int|auto|my)\s+)*\$?([A-Za-z_]\w*)\s*(?::\s*\w+\s*)?(?::=|=)(?!=)\s*(.+)$")
_NOT_CALLS = frozenset("if for while switch catch return function func def and or not in elif foreach".split())
_MARK = re.compile(r"[\n'\"`()\[\]{}]")
#: Characters of arguments in one frame handed to Spark.
_FRAME = 32_000_000


def _ends(text: str, starts: list[int]) -> dict[int, int]:
    """End of the bracketed part that opens at each start, read from there outside of quotes; the text's end if it never closes.

    One pass over all starts. Readings that are in the same quote go on alike, so there are at most four: each has its depth and
    a heap of its open starts by the depth at which they close, and where two meet, the smaller heap joins the larger.
    """
    out: dict[int, int] = {}
    at = set(starts)
    live: dict[str, tuple[int, list]] = {}
    for m in _MARK.finditer(text):
        i, ch = m.start(), m[0]
        if i in at:
            depth, heap = live.setdefault("", (0, []))
            heapq.heappush(heap, (-depth, i))
        after: dict[str, tuple[int, list]] = {}
        for quote, (depth, heap) in live.items():
            if quote:
                if (ch == quote and text[i - 1] != "\\") or (ch == "\n" and quote != "`"):
                    quote = ""
            elif ch in "'\"`":
                quote = ch
            elif ch in "([{":
                depth += 1
            elif ch in ")]}":
                depth -= 1
                while heap and -heap[0][0] == depth:
                    out[heapq.heappop(heap)[1]] = i + 1
            if not heap:
                continue
            if quote in after:
                (depth, heap), (d, small) = sorted((after[quote], (depth, heap)), key=lambda x: -len(x[1]))
                for x, k in small:
                    heapq.heappush(heap, (x + d - depth, k))
            after[quote] = (depth, heap)
        live = after
    return {k: out.get(k, len(text)) for k in starts}


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file_path", "syntax", "node", "line_no", "fn", "args", "value"]
    for b in batches:
        rows, size = [], 0
        for path, syntax, text in zip(b["file_path"], b["syntax"], b["content"]):
            line, seen = 1, 0
            found = [m for m in _CALL.finditer(text) if m[1] not in _NOT_CALLS]
            ends = _ends(text, [m.end() - 1 for m in found])
            roots: dict[int, str] = {}
            for m in found:
                line += text.count("\n", seen, m.start())
                seen = m.start()
                end = ends[m.end() - 1]
                args = text[m.end() - 1 : end]
                # A call on another call's value is named after the first call of the chain, too.
                before = len(text[max(m.start() - 80, 0) : m.start() - 1].rstrip()) + max(m.start() - 80, 0) if text[m.start() - 1 : m.start()] == "." else -1
                root = roots.get(before, "")
                roots[end] = root or m[1]
                rows.append((path, syntax, "call", line, f"{root}().{m[1]}" if root else m[1], args, ""))
                size += len(args)
                if size > _FRAME:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            for n, row in enumerate(text.split("\n"), 1):
                if a := _ASSIGN.match(row):
                    rows.append((path, syntax, "assign", n, "", a[1], a[2].strip()))
        yield pd.DataFrame(rows, columns=names)


def calls(files: DataFrame) -> DataFrame:
    """file_path, syntax, node (call or assign), line_no, fn, args (of an assignment: the name), value. Nested and chained calls each give a row."""
    return files.filter("syntax <> ''").mapInPandas(_extract, "file_path string, syntax string, node string, line_no int, fn string, args string, value string")



#: Entropy (bits a character) above which a literal counts as random.
RANDOM_ENTROPY = 3.5
# Words of personal data, of SQL statements, and forms of request parameters.
PERSONAL = ("password", "ssn", "credit_card", "creditcard", "email", "phone", "address", "dob", "token", "secret")
SQL_VERB = r"(?i)\b(select|insert|update|delete)\b"
REQUEST = r"(?i)\br\.(url\.query|formvalue|postformvalue|header\.get)|req\.|request\.|params\[|mux\.vars|c\.(query|param)"


def _has(c: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _checks() -> tuple:
    """(check id, languages, node, severity, CWE, confidence, condition). Without a confidence of its own a check has 0."""
    name, args, text = F.col("fn"), F.col("args"), F.concat("fn", "args")
    low = F.lower(text)
    value = F.col("value")
    random = (entropy(F.btrim(value, F.lit("\"'`;, "))) > RANDOM_ENTROPY)
    secret = fn.is_secret_name(args) & fn.is_literal(value) & random
    quoted = value.rlike("[\"']")
    word = F.lower(args).rlike("password|secret|apikey|api_key")
    verb = low.rlike(SQL_VERB)
    from_request = text.rlike(REQUEST)
    inside = low.rlike(r"#\{\s*(params|request)")
    return (
        ("ast-python-dangerous-eval", ("python",), "call", "high", "CWE-94", 0.90, name.isin("eval", "exec", "compile")),
        ("ast-python-sql-injection", ("python",), "call", "critical", "CWE-89", 0.0, name.isin("execute", "executemany") & fn.has_formatting(args)),
        ("ast-python-command-injection", ("python",), "call", "critical", "CWE-78", 0.0, name.isin("system", "popen", "call") & fn.has_user_input(args)),
        ("ast-privacy-pii-logging", (), "call", "medium", "CWE-532", 0.85, _has(F.lower(name), "print", "log", "fmt.pr", "console.", "write") & _has(F.lower(args), *PERSONAL)),
        ("ast-python-hardcoded-secret", ("python",), "assign", "high", "CWE-798", 0.0, secret),
        ("ast-python-ssti", ("python",), "call", "critical", "CWE-1336", 0.0, _has(text, "render_template_string")),
        ("ast-js-dangerous-eval", ("javascript", "typescript"), "call", "high", "CWE-94", 0.0, name.isin("eval", "Function")),
        ("ast-js-xss-innerhtml", ("javascript", "typescript"), "call", "medium", "CWE-79", 0.0, _has(text, ".innerHTML")),
        ("ast-js-hardcoded-secret", ("javascript", "typescript"), "assign", "high", "CWE-798", 0.0, secret),
        ("ast-java-sql-injection", ("java",), "call", "critical", "CWE-89", 0.0, _has(text, "executeQuery", "executeUpdate", "execute") & text.contains("+")),
        ("ast-java-command-injection", ("java",), "call", "high", "CWE-78", 0.0, text.contains("Runtime") & text.contains("exec")),
        ("ast-java-insecure-deserialization", ("java",), "call", "high", "CWE-502", 0.0, text.contains("readObject")),
        ("ast-java-xss-response", ("java",), "call", "high", "CWE-79", 0.0, _has(text, "getWriter", "getOutputStream") & text.contains("getParameter")),
        ("ast-java-hardcoded-secret", ("java",), "assign", "high", "CWE-798", 0.0, word & quoted),
        ("ast-java-weak-cipher", ("java",), "call", "high", "CWE-327", 0.0, name.startswith("new ") & text.contains("Cipher") & _has(text, "ECB", "DES")),
        ("ast-kotlin-insecure-webview", ("kotlin",), "assign", "high", "CWE-79", 0.0, _has(F.concat(args, value), "javaScriptEnabled") & value.contains("true")),
        ("ast-kotlin-sql-injection", ("kotlin",), "call", "critical", "CWE-89", 0.0, _has(text, "rawQuery", "execSQL") & _has(args, "$", "+")),
        ("ast-kotlin-sensitive-logging", ("kotlin",), "call", "medium", "CWE-532", 0.0, text.contains("Log.") & _has(low, "password", "token", "secret")),
        ("ast-kotlin-implicit-intent", ("kotlin",), "call", "medium", "CWE-927", 0.0, name.contains("startActivity") & args.contains("Intent(") & ~args.contains("::class")),
        ("ast-kotlin-insecure-sharedprefs", ("kotlin",), "call", "high", "CWE-276", 0.0, text.contains("getSharedPreferences") & text.contains("MODE_WORLD")),
        ("ast-kotlin-hardcoded-secret", ("kotlin",), "assign", "high", "CWE-798", 0.0, word & quoted),
        ("ast-go-sqli-db-dynamic", ("go",), "call", "critical", "CWE-89", 0.90, F.lower(name).rlike(r"\b(db|tx)\.(query|exec)") & (low.contains("sprintf") | (verb & args.contains("+")))),
        ("ast-go-cmdi-exec-sprintf", ("go",), "call", "critical", "CWE-78", 0.92, F.lower(name).contains("exec.command") & low.contains("fmt.sprintf")),
        ("ast-go-path-traversal", ("go",), "call", "high", "CWE-22", 0.90, F.lower(name).rlike(r"os\.(open|readfile|create)") & from_request),
        ("ast-go-ssti-template-parse", ("go",), "call", "critical", "CWE-1336", 0.95, low.contains(".parse(") & _has(low, "template.new", "template.must") & from_request),
        ("ast-go-sqli-concat-assignment", ("go",), "assign", "critical", "CWE-89", 0.88, value.rlike(SQL_VERB) & value.contains("+") & value.rlike(REQUEST)),
        ("ast-ruby-cmdi-params", ("ruby",), "call", "critical", "CWE-78", 0.93, F.lower(name).rlike(r"(^|[.\s])(system|exec|io\.popen)$") & inside),
        ("ast-ruby-sqli-where", ("ruby",), "call", "critical", "CWE-89", 0.92, F.lower(name).rlike(r"\.where$|find_by_sql$|exec_query$") & inside),
        ("ast-ruby-code-injection-eval", ("ruby",), "call", "critical", "CWE-94", 0.95, F.lower(name).rlike(r"(eval|instance_eval|class_eval|module_eval)$") & _has(low, "params", "request")),
        ("ast-rust-cmdi-command-new", ("rust",), "call", "high", "CWE-78", 0.0, low.contains("command::new(")),
        ("ast-rust-sqli-format-macro", ("rust",), "call", "critical", "CWE-89", 0.88, name.startswith("format") & verb),
    )


def checks(nodes: DataFrame) -> DataFrame:
    """check_id, severity, cwe, confidence, file_path, line_no, fn of each node a check hits; nested calls each count."""
    ids = []
    for cid, langs, node, sev, cwe, conf, cond in _checks():
        c = (F.col("node") == node) & cond
        c = F.col("syntax").isin(*langs) & c if langs else c
        ids.append(F.when(c, F.struct(F.lit(cid).alias("check_id"), F.lit(sev).alias("severity"), F.lit(cwe).alias("cwe"), F.lit(conf).alias("confidence"))))
    return nodes.select("file_path", "line_no", "fn", F.inline(F.array_compact(F.array(*ids)))).select("check_id", "severity", "cwe", "confidence", "file_path", "line_no", "fn")


def identifiers(files: DataFrame) -> DataFrame:
    """Distinct lower-case identifiers of all source files."""
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"[a-z_$][\w$-]*"), 0)
    return files.filter("syntax <> ''").select(F.explode(F.array_distinct(words)).alias("word")).distinct()


def used_packages(deps: DataFrame, words: DataFrame) -> DataFrame:
    """Dependencies (name) with ``used``: whether any identifier of the code holds the name.

    The name is met by equality: each identifier states its parts of the lengths that names have,
    no comparison of all names with all identifiers.
    """
    names = deps.select(F.lower("name").alias("low")).filter(F.col("low") != "").distinct()
    lengths = names.agg(F.collect_set(F.length("low")).alias("lengths"))  # as many as names have lengths
    sized = words.withColumn("all", F.lit(0)).join(lengths.withColumn("all", F.lit(0)), "all")
    parts = sized.select("word", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("word"))
    parts = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1), lambda i: F.substring(F.col("word"), i, F.col("n")))).alias("low")).distinct()
    hit = names.join(parts, "low", "left_semi").withColumn("used", F.lit(True))
    return deps.withColumn("low", F.lower("name")).join(hit, "low", "left").withColumn("used", F.coalesce("used", F.lit(False))).drop("low")


# Sources, sinks by language, sanitizers and guards of the taint pass.
SOURCES = (
    r"request\.(args|form|json|values|GET|POST)|req\.(query|body|params)|input\s*\(|sys\.argv|os\.environ",
    r"\$_GET|\$_POST|\$_REQUEST|\$_COOKIE|\$_SERVER|\$HTTP_(GET|POST)_VARS",
    r"req\.params|req\.query|req\.body|req\.cookies|req\.headers|window\.location|document\.(cookie|URL|documentURI|referrer|name)|process\.argv|process\.env",
    r"request\.getParameter|request\.getHeader|request\.getCookies|System\.getenv|System\.getProperty|Scanner\(System\.in\)",
    r"Request\.(QueryString|Form|Cookies|Headers)|Console\.ReadLine|Environment\.GetCommandLineArgs|Environment\.GetEnvironmentVariable",
    r"r\.URL\.Query|r\.FormValue|r\.PostFormValue|r\.Header\.Get|r\.Cookie|os\.Args|os\.Getenv|chi\.URLParam|mux\.Vars",
    r"params\[|request\.(env|cookies|headers)|ENV\[",
    r"URLComponents|URLQueryItem|request\.url|UserDefaults\.standard",
    r"request\.uri|request\.headers|Platform\.environment|stdin\.readLineSync",
)
_WEB_SINKS = (r"eval\s*\(", r"Function\s*\(", r"innerHTML\s*=", r"document\.write\s*\(", r"exec\s*\(", r"child_process\.(exec|spawn|execSync)\s*\(", r"\.query\s*\(", r"\.execute\s*\(", r"vm\.runInContext\s*\(", r"axios\s*\(", r"fetch\s*\(")
SINKS = {
    "python": (r"execute\s*\(", r"executemany\s*\(", r"exec\s*\(", r"eval\s*\(", r"os\.system\s*\(", r"subprocess\.(call|run|Popen|check_output)\s*\(", r"cursor\.execute\s*\(", r"\.raw\s*\(", r"render_template_string\s*\(", r"yaml\.load\s*\(", r"pickle\.loads\s*\(", r"requests\.(get|post|put|delete)\s*\("),
    "javascript": _WEB_SINKS,
    "typescript": _WEB_SINKS,
    "php": (r"eval\s*\(", r"exec\s*\(", r"system\s*\(", r"passthru\s*\(", r"shell_exec\s*\(", r"mysql_query\s*\(", r"mysqli_query\s*\(", r"PDO::query\s*\(", r"include\s*\(", r"require\s*\(", r"unserialize\s*\(", r"curl_init\s*\("),
    "java": (r"\.executeQuery\s*\(", r"\.executeUpdate\s*\(", r"Runtime\.getRuntime\(\)\.exec\s*\(", r"ProcessBuilder\s*\(", r"\.readObject\s*\(", r"\.(getOutputStream|getWriter)\(\)\.print"),
    "kotlin": (r"\.rawQuery\s*\(", r"\.execSQL\s*\(", r"Runtime\.getRuntime\(\)\.exec\s*\(", r"ProcessBuilder\s*\(", r"\.readObject\s*\("),
    "csharp": (r"SqlCommand\s*\(", r"\.ExecuteReader\s*\(", r"\.ExecuteNonQuery\s*\(", r"Process\.Start\s*\(", r"BinaryFormatter\(\)\.Deserialize\s*\(", r"\.InnerHtml\s*=", r"Response\.Write\s*\("),
    "go": (r"db\.Query\s*\(", r"db\.Exec\s*\(", r"exec\.Command\s*\(", r"http\.Get\s*\(", r"http\.NewRequest\s*\(", r"html/template", r"text/template"),
    "ruby": (r"eval\s*\(", r"system\s*\(", r"exec\s*\(", r"%\(", r"%\w\(", r"User\.find_by_sql\s*\(", r"ActiveRecord::Base\.connection\.execute\s*\(", r"URI\.open\s*\(", r"Net::HTTP\.get\s*\(", r"Marshal\.load\s*\("),
    "swift": (r"NSTask\s*\(", r"Process\s*\(", r"evaluateJavaScript\s*\(", r"NSPredicate\s*\(", r"FileManager.*contentsOfDirectory"),
    "dart": (r"Process\.run\s*\(", r"Process\.start\s*\(", r"HttpClient.*get\s*\(", r"dart:io.*File\s*\("),
}
SANITIZERS = (
    r"escape|sanitize|htmlspecialchars|htmlentities|quote|escape_string|urlencode|encodeURIComponent|encodeURI",
    r"DOMPurify\.sanitize|sanitizeHtml|validator\.escape|xss\(|bleach\.clean",
    r"Bind|Prepare|param|\?\.placeholder|setParameter|bindParam|bindValue|addBindValue",
    r"parseInt|parseFloat|Number\(|int\(|float\(|Integer\.parseInt|Integer\.valueOf|strconv\.Atoi|strconv\.ParseInt",
    r"\.where\(.*\?|\.filter\(|\.exclude\(|\.get\(pk=|\.objects\.|\.findOne\(|\.findById\(|\.findByPk\(",
    r"html/template|template\.HTML|markupsafe\.escape|Markup\(|SafeString",
    r"JSON\.stringify|JSON\.parse|jsonify|json\.dumps|json\.loads|urlparse|url\.parse|path\.resolve|path\.join",
    r"startsWith|endsWith|includes|indexOf|match|test|validate|isValid|whitelist|allowlist|ALLOWED",
)
GUARDS = ("not in ", "not_in", "!= ", "!== ", "startswith", "endswith", "includes(", "indexof(", "match(", ".test(", "validate", "isvalid", "whitelist", "allowlist", "allowed_hosts", "return 403", "return 401", "return 400", "raise ", "throw ", "abort(", "path.sep", "filepath.clean")
SAFE_OUTPUT = ("jsonify", "json.dumps", "json_encode", "json.stringify", "urlparse", "url.parse", "path.resolve", "path.join", "textcontent", "createtextnode")
# Kind of injection by words of the sink's pattern (first hit in this order), with its CWE and category.
SINK_KINDS = (
    ("SQL", "CWE-89", "A03:2021", ("execute", "query", "mysql", "ExecuteReader", "find_by_sql", "db.Query", "db.Exec", "ExecuteNonQuery")),
    ("Code", "CWE-94", "A03:2021", ("eval", "Function", "vm.runInContext")),
    ("Command", "CWE-78", "A03:2021", ("system", "exec", "subprocess", "Process", "Runtime", "popen", "passthru", "shell_exec")),
    ("XSS", "CWE-79", "A03:2021", ("innerHTML", "document.write", "InnerHtml", "Response.Write", "Writer", "print")),
    ("File", "CWE-22", "A03:2021", ("include", "require")),
    ("Deserialization", "CWE-502", "A08:2021", ("unserialize", "readObject", "Deserialize", "yaml.load", "pickle.loads", "Marshal.load")),
    ("SSRF", "CWE-918", "A03:2021", ("curl_init", "requests.", "axios", "fetch", "http.Get", "http.NewRequest", "URI.open", "Net::HTTP")),
)
MAX_HOPS = 10


def sink_kind(pattern: str) -> tuple[str, str, str]:
    """(kind, CWE, category) of a sink, by the text of its pattern as written."""
    return next(((k, c, o) for k, c, o, words in SINK_KINDS if any(w in pattern for w in words)), ("Injection", "CWE-20", "A03:2021"))


def sink_table() -> list[tuple[str, str, str, str, str]]:
    """(language, pattern, kind, CWE, category) of every sink."""
    return [(lang, p, *sink_kind(p)) for lang, ps in SINKS.items() for p in ps]


_SRC = re.compile("(?i)" + "|".join(SOURCES))
_SAFE = re.compile("(?i)" + "|".join(SANITIZERS))
_SINK = {lang: [(p, re.compile(p), sink_kind(p)) for p in dict.fromkeys(ps)] for lang, ps in SINKS.items()}
_DEF = re.compile(r"\s*(?:async\s+)?(?:def|func|function|fun|fn|sub|public|private|protected)\b")
_DEF_NAME = re.compile(r"(?:def|func|function|fun|fn|sub)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)|(?:public|private|protected)\s+(?:static\s+)?\w+\s+([A-Za-z_]\w*)\s*\(")
_RETURN = re.compile(r"\s*(?:return|yield)\b(.*)")
_NAME = re.compile(r"(?<![\w.])\$?([A-Za-z_]\w*)")
_CALLEE = re.compile(r"([A-Za-z_]\w*)\s*\(")


def confidence(distance: int, hops: int, indirect: bool = False) -> float:
    c = 0.95 - (0.15 if distance > 100 else 0.10 if distance > 50 else 0.05 if distance > 20 else 0.0) - (0.10 if hops > 3 else 0.05 if hops > 1 else 0.0)
    return round(max(c, 0.60) - (0.05 if indirect else 0.0), 4)


def is_safe_sink(line: str, kind: str) -> bool:
    """Uses of a sink that are safe as they stand: bound parameters, no shell, text content, checked hosts, encoded output."""
    low = line.lower()
    if kind == "SQL" and (("?" in line and ("[" in line or "," in line)) or "$1" in line or "$2" in line):
        return True
    if kind == "Command" and ("execfile" in low or "spawn" in low or ("subprocess" in low and "[" in line)):
        return True
    if kind == "SSRF" and any(w in low for w in ("allowlist", "whitelist", "allowed_hosts")):
        return True
    return any(w in low for w in SAFE_OUTPUT)


def is_guarded(lines: list[str], source_line: int, sink_line: int) -> bool:
    """Whether a line after the source, up to the sink's own, shows a check."""
    return any(g in low for low in (x.strip().lower() for x in lines[source_line:sink_line]) for g in GUARDS)


def _names(text: str, live: dict) -> list[str]:
    return [v for v in dict.fromkeys(_NAME.findall(text)) if v in live]


def facts(text: str, lang: str) -> list[tuple[str, bool, bool, list[str]]]:
    """(function, returns tainted, sink in body, callees) of each function of a file.

    A function returns tainted if a returned variable is, or a source stands on a return line. A
    sink in its body counts where the line names a variable that was assigned and is not tainted.
    """
    out: list[list] = []
    tainted: dict[str, bool] = {}
    local: set[str] = set()
    for line in text.split("\n"):
        if _DEF.match(line) and (m := _DEF_NAME.search(line)):
            out.append([m[1] or m[2], False, False, []])
            tainted, local = {}, set()
        if not out:
            continue
        f = out[-1]
        f[3] += _CALLEE.findall(line)
        if a := _ASSIGN.match(line):
            local.add(a[1])
            if (_SRC.search(a[2]) or _names(a[2], tainted)) and not _SAFE.search(a[2]):
                tainted[a[1]] = True
            else:
                tainted.pop(a[1], None)
        if r := _RETURN.match(line):
            f[1] = f[1] or bool(_SRC.search(r[1])) or bool(_names(r[1], tainted))
        if any(rx.search(line) for _, rx, _ in _SINK.get(lang, ())):
            f[2] = f[2] or any(v in local and v not in tainted for v in _NAME.findall(line))
    return [(n, a, b, sorted(set(c) - {n})) for n, a, b, c in out]


def flows(text: str, lang: str, sources: frozenset[str] = frozenset(), wrappers: frozenset[str] = frozenset()) -> list[tuple]:
    """(variable, source line, sink line, sink, kind, CWE, hops, guarded, confidence); one report a source and sink pattern.

    State is kept in order of lines and cleared where a function starts or braces close; where
    several variables reach a sink, they are taken by source line, then name. ``sources`` are
    functions whose value is tainted, ``wrappers`` functions with a sink in their body. A pair is
    used up by its first report, guarded or not.
    """
    live: dict[str, tuple[int, int, bool]] = {}
    out, depth, seen = [], 0, set()
    lines = text.split("\n")
    sinks = _SINK.get(lang, ())
    for n, line in enumerate(lines, 1):
        if _DEF.match(line):
            live = {}
        opened = depth
        depth = max(depth + line.count("{") - line.count("}"), 0)
        a = _ASSIGN.match(line)
        if a:
            name, value = a[1], a[2]
            used = sorted((live[v], v) for v in _names(value, live))
            wrapped = sources and any(c in sources for c in _CALLEE.findall(value))
            if _SAFE.search(value):
                live.pop(name, None)
            elif _SRC.search(value):
                live[name] = (n, 0, False)
            elif wrapped:
                live[name] = (n, 1, True)
            elif used and used[0][0][1] < MAX_HOPS:
                live[name] = (used[0][0][0], used[0][0][1] + 1, used[0][0][2])
            else:
                live.pop(name, None)
        if live:
            hits = [(p, m.end(), kind) for p, rx, kind in sinks if (m := rx.search(line))]
            if wrappers:
                hits += [(f"{m[1]}()", m.end(), ("Injection", "CWE-20", "A03:2021")) for m in _CALLEE.finditer(line) if m[1] in wrappers]
            for pattern, end, (kind, cwe, _) in hits:
                if is_safe_sink(line, kind):
                    continue
                for (src, hops, indirect), v in sorted((live[v], v) for v in _names(line[max(end - 1, 0) :], live)):
                    if src < n and (v, src, pattern) not in seen:
                        seen.add((v, src, pattern))
                        guarded = is_guarded(lines, src, n)
                        out.append((v, src, n, pattern, kind, cwe, hops, guarded, 0.25 if guarded else confidence(n - src, hops, indirect or pattern.endswith("()"))))
        if opened > 0 and depth == 0:
            live = {}
    return out


def function_facts(files: DataFrame) -> DataFrame:
    """file_path, module (base name), name, returns_tainted, sink_in_body, callees of each function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, p.rsplit("/", 1)[-1].rsplit(".", 1)[0], *f) for p, s, t in zip(b["file_path"], b["syntax"], b["content"]) for f in facts(t, s)]
            yield pd.DataFrame(rows, columns=["file_path", "module", "name", "returns_tainted", "sink_in_body", "callees"])

    return files.filter("syntax <> ''").mapInPandas(run, "file_path string, module string, name string, returns_tainted boolean, sink_in_body boolean, callees array<string>")


def tainted_functions(found: DataFrame) -> DataFrame:
    """name, module: functions whose value is tainted, and all that call one, transitively (names are those of the whole corpus)."""
    edge = found.select(F.explode("callees").alias("src"), F.col("name").alias("dst")).distinct()
    reached = closure(cut(edge), found.filter("returns_tainted").select(F.col("name").alias("node")))
    return found.select("module", "name").distinct().join(reached.withColumnRenamed("node", "name"), "name", "left_semi")


def taint_flows(files: DataFrame, least: float = 0.30, across: bool = True) -> DataFrame:
    """Flows from user input to a sink; guarded ones fall below ``least`` and drop out.

    ``across``: values of functions that return tainted data and calls of functions with a sink in
    their body count, wherever they are defined: each file is joined with the names it calls.
    """
    src = files.filter("syntax <> ''")
    empty = F.array().cast("array<string>")
    if across:
        known = cut(function_facts(files))
        sources = known.filter("returns_tainted").select("name").distinct()
        wrappers = known.filter("sink_in_body").select("name").distinct()
        called = known.select("file_path", F.explode("callees").alias("name")).distinct()
        own = [called.join(x, "name", "left_semi").groupBy("file_path").agg(F.collect_set("name").alias(c)) for x, c in ((sources, "sources"), (wrappers, "wrappers"))]
        src = src.join(own[0], "file_path", "left").join(own[1], "file_path", "left")
        src = src.select("file_path", "syntax", "content", F.coalesce("sources", empty).alias("sources"), F.coalesce("wrappers", empty).alias("wrappers"))
    else:
        src = src.select("file_path", "syntax", "content", empty.alias("sources"), empty.alias("wrappers"))
    names = ["file_path", "variable", "source_line", "sink_line", "sink", "kind", "cwe", "hops", "guarded", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *f) for p, s, t, x, y in zip(b["file_path"], b["syntax"], b["content"], b["sources"], b["wrappers"]) for f in flows(t, s, frozenset(x), frozenset(y))]
            yield pd.DataFrame(rows, columns=names)

    f = src.mapInPandas(run, "file_path string, variable string, source_line int, sink_line int, sink string, kind string, cwe string, hops int, guarded boolean, confidence double")
    return f.filter(F.col("confidence") >= least)
