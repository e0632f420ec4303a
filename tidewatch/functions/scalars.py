"""Scalar functions on findings, their texts and addresses, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import trimmed

# Display names of languages, and issue types by words of a rule path (first hit in this order; words of one hit all or any).
LANGUAGE_NAMES = {"go": "Go", "java": "Java", "javascript": "JavaScript", "typescript": "TypeScript", "python": "Python", "php": "PHP", "csharp": "C#", "ruby": "Ruby", "html": "HTML", "generic": "Generic"}
ISSUE_TYPES = (
    ("SQL Injection", ("sql", "sqli")), ("XSS Vulnerability", ("xss",)), ("Command Injection", ("command", "exec")), ("Hardcoded Secret", ("secret", "api-key")), ("Weak Cryptography", ("md5", "sha1")),
    ("Insecure Deserialization", ("deserial", "pickle")), ("Dangerous Eval Usage", ("eval",)), ("Insecure HTTP Link", ("http&plaintext",)), ("XXE Vulnerability", ("xxe", "doctype")), ("Debug Mode Enabled", ("debug",)), ("Template Vulnerability", ("template",)),
)
# Forms of user input, tried on lower-case text; words of names that hold secrets.
USER_INPUT = (
    r"\breq\.", r"\brequest\.", r"\bhttp\.Request\b", r"\.form\[", r"\.query\[", r"\.params\[", r"\.postForm\[", r"\.Body\b", r"\.Form\[", r"\.PostForm\b", r"request\.form", r"request\.args", r"request\.values", r"flask\.request", r"django\.request",
    r"sys\.argv", r"os\.environ", r"os\.getenv", r"\binput\(", r"\breadline\(", r"req\.body", r"req\.query", r"req\.params", r"req\.cookies", r"express\.request", r"\.getQuery\(", r"\.getParam\(", r"\.getParameter\(", r"\.getQueryString\(",
    r"servletRequest\.", r"HttpServletRequest\.", r"\$_GET", r"\$_POST", r"\$_REQUEST", r"\$_COOKIE", r"\$_SERVER", r"params\[", r"request\[", r"env\[", r"r\.Form\[", r"r\.Body", r"r\.PostForm\[",
)
SECRET_NAME = r"password|secret|api_key|apikey|token|credential"


def tool_severity(c: Column) -> Column:
    """Severity words of scanners in one scale; medium for any other."""
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(s.isin("error", "critical"), "critical").when(s.isin("warning", "high"), "high").when(s == "low", "low").otherwise("medium")


def rule_path_name(check_id: Column) -> Column:
    """A readable issue name of a dotted rule path: language, then the type its words tell, else its last part in title case. A path of one part stays."""
    parts = F.split(check_id, r"\.")
    words = F.array_join(parts, " ")
    first = F.get(parts, F.lit(0))
    lang = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])[first], F.initcap(first))
    kind = F.initcap(F.replace(F.element_at(parts, -1), F.lit("-"), F.lit(" ")))
    for name, keys in reversed(ISSUE_TYPES):
        hit = F.lit(False)
        for k in keys:
            every = F.lit(True)
            for w in k.split("&"):
                every = every & words.contains(w)
            hit = hit | every
        kind = F.when(hit, name).otherwise(kind)
    return F.when(F.size(parts) < 2, check_id).otherwise(F.concat(lang, F.lit(" "), kind))


def has_user_input(text: Column) -> Column:
    """Whether lower-cased text shows a form of user input (forms spelled with capitals can never hit)."""
    low = F.lower(text)
    return low.rlike("|".join(p for p in USER_INPUT if p.lower() == p))


def has_formatting(text: Column) -> Column:
    return text.contains("%") | text.contains(".format") | text.contains('f"') | text.contains("f'") | text.contains("+")


def is_secret_name(name: Column) -> Column:
    return F.lower(name).rlike(SECRET_NAME)


def is_literal(value: Column) -> Column:
    return value.rlike("^[\"'`]")


def truncated(c: Column, n: int) -> Column:
    """At most n characters, ``...`` behind what was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def cwe_id(c: Column) -> Column:
    """The first CWE-NNN; N/A if there is none; blank and N/A stay."""
    t = trimmed(c)
    x = F.regexp_extract(t, r"CWE-\d+", 0)
    return F.when(t.isNull() | (t == "") | (F.upper(t) == "N/A"), t).when(x != "", x).otherwise("N/A")


def owasp_label(c: Column) -> Column:
    """Category with its name behind a dash (``A03:2021-Injection``); N/A without one; blank and N/A stay."""
    t = trimmed(c)
    p = r"(A\d{2}:\d{4})([-\s]+[A-Za-z][A-Za-z\s/()]{0,50})?"
    code, name = F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)
    name = F.rtrim(F.regexp_replace(F.regexp_replace(F.btrim(name, F.lit(" \t\r\n")), r"^[- ]+", ""), r"[ .,;:?!*]+$", ""))
    return F.when((t == "") | (F.upper(t) == "N/A"), t).when(code == "", "N/A").when(name != "", F.concat(code, F.lit("-"), name)).otherwise(code)


def is_git_url(c: Column) -> Column:
    """Whether an address may be cloned: http, https or ssh with a host and without a password, or ``git@host:path``; never one that starts with a dash."""
    t = trimmed(c)
    scp = t.startswith("git@") & (F.length(F.regexp_replace(t, "[^:]", "")) == 1) & ~t.contains(" ")
    url = t.rlike(r"^(?i:https?|ssh)://(?:[^/@:\s]*@)?[^/@:\s]+(?::\d*)?(?:[/?#]\S*)?$")
    return F.coalesce((t != "") & ~t.startswith("-") & F.when(t.startswith("git@"), scp).otherwise(url), F.lit(False))


def masked_urls(c: Column) -> Column:
    """User and password in addresses as ``***:***``."""
    return F.regexp_replace(c, r"([a-zA-Z][a-zA-Z0-9+\-.]*://)[^:@\s]+:[^@\s]+@", "$1***:***@")


def duration(seconds: Column) -> Column:
    """``42s``, ``3m05s`` or ``2h07m``."""
    s = seconds.cast("long")
    return F.when(seconds < 60, F.format_string("%.0fs", seconds.cast("double"))).when(seconds < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def without_fences(c: Column) -> Column:
    """Code without its opening and closing markdown fence, trimmed."""
    t = F.btrim(c, F.lit(" \t\r\n"))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z0-9_+-]*[ \t]*\r?\n?", ""), r"\r?\n?```$", ""), F.lit(" \t\r\n"))


def printable(c: Column) -> Column:
    """Without control characters, typographic signs as plain ones."""
    t = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.translate(t, "‘’“”–—• ", "''\"\"--* ")
    return F.regexp_replace(t, "…", "...")


def flex_int(json: Column, path: str) -> Column:
    """A number, or the first one of a list, at a path of a JSON text; 0 for anything else."""
    one = F.get_json_object(json, path)
    first = F.get_json_object(json, f"{path}[0]")
    return F.coalesce(one.try_cast("int"), first.try_cast("int"), F.lit(0))


def encoded_path(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("%2F"))


def package_of(source: Column, pattern: Column, issue_name: Column) -> Column:
    """Package a dependency finding speaks of: first word of its pattern, else its name; empty for other engines."""
    dep = source.contains("dependency") | source.contains("osv") | source.contains("supply")
    first = F.regexp_extract(pattern, r"^\s*(\S+)", 1)
    return F.when(dep, F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(issue_name)).otherwise("")


def version_of(pattern: Column) -> Column:
    """Text after the first @, else the second word."""
    return F.when(pattern.contains("@"), F.regexp_extract(pattern, r"(?s)@(.*)$", 1)).otherwise(F.regexp_extract(pattern, r"^\s*\S+\s+(\S+)", 1))


def path_cell(steps: Column) -> Column:
    return F.array_join(steps, " → ")
