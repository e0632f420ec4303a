"""Dependency manifests of nine kinds to dependency rows, and rule files to rules.

Line formats work on the line relation of manifest files (file_path, line_no, line) with running
flags by window; document formats on their text with JSON and regular-expression columns.
Result: file_path, name, version, ecosystem, line_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.rules import Rule


def clean_version(v: Column) -> Column:
    """Without one leading v, ^ and ~ (in that order) and a trailing comma."""
    for p in (r"^v", r"^\^", r"^~", r",$"):
        v = F.regexp_replace(v, p, "")
    return v


def _out(df: DataFrame, name: Column, version: Column, ecosystem: str, line: Column | None = None) -> DataFrame:
    d = df.select("file_path", F.trim(name).alias("name"), clean_version(F.trim(version)).alias("version"), F.lit(ecosystem).alias("ecosystem"), (line if line is not None else F.lit(1)).cast("int").alias("line_no"))
    return d.filter((F.col("name") != "") & F.col("name").isNotNull())


def requirements(lines: DataFrame) -> DataFrame:
    """requirements.txt: blank lines, comments and options are skipped; version after ==, >= or <=, else latest."""
    x = lines.withColumn("l", F.trim("line")).filter((F.col("l") != "") & ~F.col("l").startswith("#") & ~F.col("l").startswith("-"))
    name, version = F.col("l"), F.lit("latest")
    for op in ("<=", ">=", "=="):
        has = F.col("l").contains(op)
        name = F.when(has, F.substring_index("l", op, 1)).otherwise(name)
        version = F.when(has, F.expr(f"substring(l, instr(l, '{op}') + 2)")).otherwise(version)
    return _out(x, name, version, "PyPI", F.col("line_no"))


def _json_maps(files: DataFrame, ecosystem: str, *fields: str) -> DataFrame:
    maps = F.from_json("content", ", ".join(f"`{f}` map<string,string>" for f in fields))
    each = F.concat(*[F.coalesce(F.map_entries(maps[f]), F.array().cast("array<struct<key:string,value:string>>")) for f in fields])
    x = files.select("file_path", F.explode(each).alias("e"))
    return _out(x, F.col("e.key"), F.col("e.value"), ecosystem)


def package_json(files: DataFrame) -> DataFrame:
    return _json_maps(files, "npm", "dependencies", "devDependencies")


def composer_json(files: DataFrame) -> DataFrame:
    return _json_maps(files, "Packagist", "require", "require-dev").filter("name <> 'php'")


def go_mod(lines: DataFrame) -> DataFrame:
    """go.mod: single require lines and require blocks (running flag), indirect ones too."""
    w = W.partitionBy("file_path").orderBy("line_no")
    t = F.btrim(F.col("line"), F.lit(" \t\r"))
    x = lines.withColumn("t", t).withColumn("mark", F.when(t.startswith("require ("), 1).when(t == ")", 0))
    x = x.withColumn("inside", F.last("mark", ignorenulls=True).over(w))
    body = F.when(F.col("t").startswith("require ") & ~F.col("t").startswith("require ("), F.substring_index("t", "require ", -1)).when((F.col("inside") == 1) & F.col("mark").isNull(), F.col("t"))
    x = x.withColumn("parts", F.split(body, r"\s+")).filter((F.size("parts") >= 2) & ~F.col("t").startswith("//"))
    return _out(x, F.col("parts")[0], F.col("parts")[1], "Go", F.col("line_no"))


def pom_xml(files: DataFrame) -> DataFrame:
    x = files.select("file_path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("d"))

    def tag(n: str) -> Column:
        return F.regexp_extract("d", rf"<{n}>\s*([^<]*?)\s*</{n}>", 1)

    x = x.filter((tag("groupId") != "") & (tag("artifactId") != ""))
    return _out(x, F.concat_ws(":", tag("groupId"), tag("artifactId")), F.when(tag("version") == "", "latest").otherwise(tag("version")), "Maven")


def gradle(lines: DataFrame) -> DataFrame:
    p = r"(?:implementation|runtimeOnly|compileOnly|api|testImplementation)\s*\(?\s*['\"]([^:'\"]+):([^:'\"]+):([^'\"]+)['\"]"
    x = lines.filter(F.col("line").rlike(p))
    return _out(x, F.concat_ws(":", F.regexp_extract("line", p, 1), F.regexp_extract("line", p, 2)), F.regexp_extract("line", p, 3), "Maven", F.col("line_no"))


def yarn_lock(lines: DataFrame) -> DataFrame:
    """Header line up to the first @ (scoped names come out empty and are skipped), then its version line."""
    w = W.partitionBy("file_path").orderBy("line_no")
    head = F.when(~F.col("line").rlike(r"^[\s#]") & F.col("line").contains("@"), F.substring_index(F.regexp_replace("line", '"', ""), "@", 1))
    x = lines.withColumn("head", F.last(head, ignorenulls=True).over(w)).filter(F.trim("line").rlike(r'^version "'))
    return _out(x, F.col("head"), F.regexp_extract("line", r'version "([^"]*)"', 1), "npm", F.col("line_no"))


def pnpm_lock(lines: DataFrame) -> DataFrame:
    p = r"^\s+/([^/]+)/([^:]+):"
    return _out(lines.filter(F.col("line").rlike(p)), F.regexp_extract("line", p, 1), F.regexp_extract("line", p, 2), "npm", F.col("line_no"))


def gemfile_lock(lines: DataFrame) -> DataFrame:
    """Lines of two or three leading blanks after ``specs:``: name and the text in or after the blank."""
    w = W.partitionBy("file_path").orderBy("line_no")
    x = lines.withColumn("on", F.max(F.trim("line").startswith("specs:").cast("int")).over(w)).filter((F.col("on") == 1) & F.col("line").rlike(r"^ {2,3}\S+ \S"))
    parts = F.split(F.trim("line"), " ")
    return _out(x, parts[0], F.translate(parts[1], "()", ""), "RubyGems", F.col("line_no"))


def _requoted(text: str) -> str:
    """Double-quoted values, in which backslashes are escapes, as single-quoted ones."""
    import re

    return re.sub(r'(?m)^(\s*(?:- )?(?:[\w-]+:\s*)?)"(.*)"\s*$', lambda m: m[1] + "'" + m[2].replace('\\"', '"').replace("'", "''") + "'", text)


def load_rule_folder(root: str) -> list[Rule]:
    """Rules of all YAML files below a folder of the driver, in the order of their names; the first rule of an id counts. Rule files are few and small: they are read here and sent to the workers as data."""
    from pathlib import Path

    found: dict[str, Rule] = {}
    for p in sorted(x for x in Path(root).rglob("*") if x.suffix in (".yaml", ".yml")):
        for r in load_rules(p.read_text(encoding="utf-8", errors="replace")):
            found.setdefault(r.rule_id, r)
    return list(found.values())


MANIFEST_NAMES = ("package.json", "requirements.txt", "go.mod", "pom.xml", "build.gradle", "composer.json", "Gemfile.lock", "yarn.lock", "pnpm-lock.yaml")


def collect(files: DataFrame) -> DataFrame:
    """Dependencies of all nine kinds of manifests (by base name) in the top folder of files (file_path, content)."""
    from functools import reduce

    from tidewatch.sources.corpus import lines

    top = files.select("file_path", "content").filter(~F.regexp_replace("file_path", r"^(?:\./)+", "").contains("/"))

    def of(name: str) -> DataFrame:
        return top.filter(F.element_at(F.split("file_path", "/"), -1) == name)

    whole = {"package.json": package_json, "pom.xml": pom_xml, "composer.json": composer_json}
    by_line = {"requirements.txt": requirements, "go.mod": go_mod, "build.gradle": gradle, "Gemfile.lock": gemfile_lock, "yarn.lock": yarn_lock, "pnpm-lock.yaml": pnpm_lock}
    parts = [f(of(n)) for n, f in whole.items()] + [f(lines(of(n))) for n, f in by_line.items()]
    return reduce(DataFrame.unionByName, parts)


def load_rules(text: str) -> list[Rule]:
    """Rules of a YAML text: a list or a map with ``rules``; patterns as list of texts or of {regex}, or one ``pattern``.

    Where the whole does not parse, each ``- id:`` part is tried alone, then with its open double
    quotes doubled as single ones. Rules without an id or without a pattern that compiles are dropped.
    """
    import re

    try:
        import yaml
    except ImportError as e:  # the reader is optional
        raise RuntimeError("reading rule files needs PyYAML") from e

    def rules_of(doc: object) -> list[dict]:
        doc = doc.get("rules", []) if isinstance(doc, dict) and "id" not in doc else doc
        return [d for d in (doc if isinstance(doc, list) else [doc]) if isinstance(d, dict)]

    try:
        raw = rules_of(yaml.safe_load(text))
    except yaml.YAMLError:
        raw = []
        for part in re.split(r"(?m)^(?=\s*- id:)", text):
            for attempt in (part, _requoted(part)):
                try:
                    raw += rules_of(yaml.safe_load(attempt))
                    break
                except yaml.YAMLError:
                    continue

    def texts(d: dict, *names: str) -> tuple[str, ...]:
        v = next((d[n] for n in names if d.get(n)), [])
        v = v if isinstance(v, list) else [v]
        flat = [x.get("regex") if isinstance(x, dict) else x for x in v]
        ok = []
        for x in flat:
            try:
                re.compile(str(x))
                ok.append(str(x))
            except re.error:
                continue
        return tuple(ok)

    out = []
    for d in raw:
        langs = d.get("languages") or d.get("language") or ()
        patterns = texts(d, "patterns", "pattern")
        if d.get("id") and patterns:
            out.append(Rule(str(d["id"]), tuple(map(str, langs if isinstance(langs, list | tuple) else [langs])), patterns, str(d.get("severity") or "").lower(), str(d.get("cwe") or ""), str(d.get("description") or ""), texts(d, "negative_patterns"), float(d.get("confidence") or 0), str(d.get("framework") or "")))
    return out
