"""Supply chain and container checks: advisories, look-alike package names, Dockerfile and manifest rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import nested_tables as n
from tidewatch.session import cut

# Well-known packages a misspelled name is compared with.
POPULAR = "requests numpy pandas lodash express react axios moment webpack babel django flask spring urllib3 beautifulsoup4 boto3 cors body-parser async chalk react-dom mongoose typescript eslint prettier jest".split()


def typosquats(deps: DataFrame, popular: tuple[str, ...] = tuple(POPULAR)) -> DataFrame:
    """name, lookalike: names one edit (two from a popular one longer than six) away, length within two.

    A popular name itself is compared with the others. Neither may be the other with a dash and
    more behind it. Popular names are an array in the row: no join of names with names.
    """
    name = F.lower("name")

    def close(t: Column) -> Column:
        d = F.levenshtein(name, t)
        size = F.abs(F.length(name) - F.length(t)) <= 2
        longer = name.startswith(F.concat(t, F.lit("-"))) | t.startswith(F.concat(name, F.lit("-")))
        return size & (name != t) & ~longer & ((d == 1) | ((d == 2) & (F.length(t) > 6)))

    names = F.array(*map(F.lit, popular))
    x = deps.select("name").filter(F.col("name").isNotNull()).distinct()
    return x.select("name", F.explode(F.filter(names, close)).alias("lookalike"))


def cvss_severity(score: Column) -> Column:
    s = score.try_cast("double")
    return F.when(s.isNull(), "medium").when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium").otherwise("low")


def advisory_severity(results: DataFrame) -> DataFrame:
    """result_id, node_path of each vulnerability with the severity of its first CVSS_V3 entry that is a number (medium without one)."""
    nodes = cut(n.nodes(results))
    sev = n.flat_table(nodes, "severity").filter((F.col("severity_type") == "CVSS_V3") & F.col("score").try_cast("double").isNotNull())
    first = sev.groupBy("result_id", F.col("parent_path").alias("node_path")).agg(F.min_by("score", "ordinal").alias("score"))
    v = n.flat_table(nodes, "vulnerability").select("result_id", "node_path", "advisory_id")
    return v.join(first, ["result_id", "node_path"], "left").select("result_id", "node_path", "advisory_id", cvss_severity(F.col("score")).alias("severity"))


def fixed_versions(results: DataFrame) -> DataFrame:
    """result_id, node_path, first_fixed, last_fixed of each vulnerability by position; unknown and latest without one.

    Only affected entries of the package above the vulnerability count: those of its ecosystem for the first,
    those of its ecosystem and name for the last; an absent name or ecosystem is an empty one. Top-level
    ``vulns`` have no package above and the payload doesn't name their dependency: all their entries count.
    """
    nodes = cut(n.nodes(results))
    ev = n.flat_table(nodes, "event").filter(F.coalesce("fixed", F.lit("")) != "")
    place = F.transform(F.regexp_extract_all("node_path", F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))
    ev = ev.select("result_id", n.parent_path(F.col("parent_path")).alias("affected_path"), F.struct(place.alias("at"), "fixed").alias("e"))

    def named(kind: str, prefix: str, *more: str) -> DataFrame:
        return n.flat_table(nodes, kind).select("result_id", F.col("node_path").alias(f"{prefix}_path"), *more, *[F.coalesce(c, F.lit("")).alias(f"{prefix}_{c}") for c in ("package_name", "ecosystem")])

    affected = named("affected", "affected", F.col("parent_path").alias("node_path"))
    v = n.flat_table(nodes, "vulnerability").select("result_id", "node_path", F.col("parent_path").alias("own_path"))
    x = ev.join(affected, ["result_id", "affected_path"]).join(v, ["result_id", "node_path"]).join(named("package", "own"), ["result_id", "own_path"], "left")
    alone = F.col("own_path") == ""
    eco = alone | (F.col("affected_ecosystem") == F.col("own_ecosystem"))
    both = alone | (eco & (F.col("affected_package_name") == F.col("own_package_name")))
    g = x.groupBy("result_id", "node_path").agg(F.min(F.when(eco, F.col("e"))).alias("lo"), F.max(F.when(both, F.col("e"))).alias("hi"))
    return v.join(g, ["result_id", "node_path"], "left").select("result_id", "node_path", F.coalesce("lo.fixed", F.lit("unknown")).alias("first_fixed"), F.coalesce("hi.fixed", F.lit("latest")).alias("last_fixed"))


def advisories_of(deps: DataFrame, results: DataFrame) -> DataFrame:
    """Dependencies with the advisories that affect a package of their name and ecosystem."""
    nodes = cut(n.nodes(results))
    aff = n.flat_table(nodes, "affected").select("result_id", F.col("parent_path").alias("node_path"), F.col("package_name").alias("name"), "ecosystem")
    v = n.flat_table(nodes, "vulnerability").select("result_id", "node_path", "advisory_id")
    a = aff.join(v, ["result_id", "node_path"]).filter(F.col("advisory_id").isNotNull()).select("name", "ecosystem", "advisory_id").distinct()
    return deps.join(a, ["name", "ecosystem"])


def packages(results: DataFrame) -> DataFrame:
    """Distinct (name, ecosystem, version) of all delivered packages."""
    p = n.flat_table(n.nodes(results), "package")
    return p.select(F.col("package_name").alias("name"), "ecosystem", F.coalesce("version", F.lit("")).alias("version")).filter(F.col("name").isNotNull()).distinct()


# Container rules with severity and CWE; words of secrets and ports that should not be open.
CONTAINER_RULES = {
    "CONTAINER-LATEST-TAG": ("medium", "CWE-1104"), "CONTAINER-ROOT-USER": ("high", "CWE-250"), "CONTAINER-ENV-SECRET": ("critical", "CWE-312"), "CONTAINER-EXPOSE-SENSITIVE-PORT": ("high", "CWE-200"),
    "CONTAINER-MISSING-USER": ("high", "CWE-250"), "CONTAINER-MISSING-HEALTHCHECK": ("low", "CWE-754"), "K8S-PRIVILEGED-CONTAINER": ("critical", "CWE-250"), "K8S-PRIVILEGE-ESCALATION": ("high", "CWE-250"),
}
SECRET_WORD = r"(?i)(password|secret|key|token|credentials)"
SENSITIVE_PORT = r"\b(22|3389|23)\b"


def _rule_rows(df: DataFrame) -> DataFrame:
    """file_path, line_no, rule_id with the rule's severity, CWE and confidence."""
    rule = F.create_map(*[x for k, (s, c) in CONTAINER_RULES.items() for x in (F.lit(k), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("cwe")))])[F.col("rule_id")]
    conf = F.when(rule["severity"] == "critical", 0.95).when(rule["severity"] == "high", 0.85).otherwise(0.8)
    return df.select("file_path", "line_no", "rule_id", rule["severity"].alias("severity"), rule["cwe"].alias("cwe"), conf.alias("confidence"))


def dockerfile_rules(lines: DataFrame) -> DataFrame:
    """file_path, line_no, rule_id, severity, cwe, confidence: line rules, and line 0 for a file without USER or HEALTHCHECK. Blank lines and comments do not count."""
    x = lines.withColumn("t", F.btrim(F.col("line"), F.lit(" \t\r"))).withColumn("u", F.upper("t"))
    live = (F.col("t") != "") & ~F.col("t").startswith("#")
    user = F.col("u").startswith("USER ")
    checks = (
        ("CONTAINER-LATEST-TAG", F.col("u").startswith("FROM ") & (F.lower("t").contains(":latest") | ~F.col("t").contains(":"))),
        ("CONTAINER-ROOT-USER", user & (F.lower("t").contains("root") | (F.trim(F.expr("substring(t, 6)")) == "0"))),
        ("CONTAINER-ENV-SECRET", F.col("u").rlike(r"^(ENV|ARG) ") & F.col("t").rlike(SECRET_WORD)),
        ("CONTAINER-EXPOSE-SENSITIVE-PORT", F.col("u").startswith("EXPOSE ") & F.col("t").rlike(SENSITIVE_PORT)),
    )
    hits = x.select("file_path", "line_no", F.explode(F.array_compact(F.array(*[F.when(live & c, r) for r, c in checks]))).alias("rule_id"))
    g = x.groupBy("file_path").agg(F.max((live & user).cast("int")).alias("u"), F.max((live & F.col("u").startswith("HEALTHCHECK")).cast("int")).alias("h"))
    missing = F.explode(F.array_compact(F.array(F.when(F.col("u") == 0, "CONTAINER-MISSING-USER"), F.when(F.col("h") == 0, "CONTAINER-MISSING-HEALTHCHECK"))))
    return _rule_rows(hits.unionByName(g.select("file_path", F.lit(0).alias("line_no"), missing.alias("rule_id"))))


def base_images(lines: DataFrame) -> DataFrame:
    """Distinct base images: the last FROM of each file, without ``scratch`` and names that start with ``builder``."""
    t = F.btrim(F.col("line"), F.lit(" \t\r"))
    f = lines.filter(F.upper(t).startswith("FROM ")).groupBy("file_path").agg(F.max_by(F.get(F.split(t, r"\s+"), F.lit(1)), "line_no").alias("image"))
    return f.select("image").filter((F.col("image") != "") & (F.col("image") != "scratch") & ~F.col("image").startswith("builder")).distinct()


def k8s_rules(files: DataFrame) -> DataFrame:
    """file_path, line_no, rule_id, severity, cwe, confidence in files that hold both ``apiVersion:`` and ``kind:``. No exchange: a file is one row."""
    both = files.filter(F.col("content").contains("apiVersion:") & F.col("content").contains("kind:"))
    x = both.select("file_path", F.posexplode(F.split("content", "\n")).alias("p", "line"))
    low = F.lower("line")
    rules = F.array_compact(F.array(
        F.when(low.contains("privileged: ") & low.contains("true"), "K8S-PRIVILEGED-CONTAINER"),
        F.when(low.contains("allowprivilegeescalation: ") & low.contains("true"), "K8S-PRIVILEGE-ESCALATION"),
    ))
    return _rule_rows(x.select("file_path", (F.col("p") + 1).alias("line_no"), F.explode(rules).alias("rule_id")))
