"""Files and lines of a code corpus, from the documents table or a directory of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import normalize_newlines

# Extension that stands for each syntax of the documents table.
EXTENSIONS = {"java": ".java", "ruby": ".rb", "javascript": ".js", "python": ".py", "typescript": ".ts", "php": ".php", "go": ".go", "dockerfile": ".dockerfile", "ini": ".ini", "json": ".json", "yaml": ".yaml"}
# Language of each extension (case matters; others are unknown), of base names without one, folders and files left out.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".html": "html", ".htm": "html", ".css": "css", ".scss": "sass", ".sass": "sass",
    ".less": "less", ".vue": "vue", ".svelte": "svelte", ".py": "python", ".pyw": "python", ".ipynb": "python", ".java": "java", ".class": "java", ".jsp": "java", ".php": "php", ".php3": "php",
    ".php4": "php", ".php5": "php", ".phtml": "php", ".go": "go", ".golang": "go", ".rs": "rust", ".rb": "ruby", ".erb": "ruby", ".rake": "ruby", ".gemspec": "ruby", ".cs": "csharp",
    ".cshtml": "csharp", ".razor": "csharp", ".vb": "vb", ".vbnet": "vb", ".vbs": "vbscript", ".asp": "asp", ".aspx": "csharp", ".ascx": "csharp", ".ashx": "csharp", ".asmx": "csharp",
    ".config": "xml", ".webconfig": "xml", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h++": "cpp",
    ".swift": "swift", ".m": "objective-c", ".mm": "objective-cpp", ".kt": "kotlin", ".kts": "kotlin", ".dart": "dart", ".flutter": "dart", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".fish": "bash", ".pl": "perl", ".pm": "perl", ".t": "perl", ".pod": "perl", ".lua": "lua", ".r": "r", ".R": "r", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml",
    ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".conf": "ini", ".env": "env", ".dockerfile": "dockerfile", ".dockerignore": "dockerfile", ".sql": "sql", ".plsql": "plsql", ".tsql": "tsql",
    ".axml": "xml", ".storyboard": "xml", ".xib": "xml", ".gradle": "groovy", ".groovy": "groovy", ".build": "swift", ".tf": "terraform", ".tfvars": "terraform", ".hcl": "terraform",
    ".pulumi": "typescript", ".bicep": "bicep", ".arm": "json", ".md": "markdown", ".mdx": "markdown", ".rst": "markdown", ".txt": "text", ".scala": "scala", ".sc": "scala", ".clj": "clojure",
    ".cljs": "clojure", ".edn": "clojure", ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hs": "haskell", ".lhs": "haskell", ".ml": "ocaml", ".mli": "ocaml", ".fs": "fsharp",
    ".fsi": "fsharp", ".fsx": "fsharp", ".rkt": "racket", ".scm": "scheme", ".lisp": "lisp", ".lsp": "lisp", ".jl": "julia", ".nb": "mathematica", ".d": "d", ".nim": "nim", ".nimble": "nim",
    ".zig": "zig", ".v": "v", ".hx": "haxe", ".cr": "crystal", ".sol": "solidity", ".move": "move", ".apex": "apex", ".abap": "abap", ".cob": "cobol", ".cbl": "cobol", ".f": "fortran",
    ".f90": "fortran", ".f95": "fortran", ".pas": "delphi", ".dpr": "delphi", ".pro": "prolog", ".asm": "assembly", ".s": "assembly", ".S": "assembly", ".vhd": "vhdl", ".sv": "systemverilog",
    ".wasm": "webassembly", ".wat": "webassembly", ".ps1": "powershell", ".psm1": "powershell", ".ejs": "javascript", ".hbs": "html", ".pug": "html", ".twig": "php", ".jinja2": "python",
    ".j2": "python", ".graphql": "graphql", ".gql": "graphql",
}
BASE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "vagrantfile": "ruby", "gemfile": "ruby", "rakefile": "ruby", "jenkinsfile": "groovy", "procfile": "yaml"}
PRUNED_DIRS = (".git", "node_modules", "vendor", "__pycache__", ".venv", "venv", ".idea", ".vscode", ".svn", "dist", "build", ".next")
SKIPPED_FILES = (".scanner-ai-stats.json", ".threat-intel-cache.json")


def files(documents: DataFrame) -> DataFrame:
    """file_path, syntax, content of every document with a text; line ends are made one form."""
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    ext = F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce("syntax", F.lit(""))), F.lit(".txt"))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), ext)
    return documents.filter(F.col("text").isNotNull()).select(path.alias("file_path"), F.coalesce("syntax", F.lit("")).alias("syntax"), normalize_newlines(F.col("text")).alias("content"))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """A directory tree as files: pruned folders (any case) and metadata files are left out, language by extension or base name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return with_language(scannable(raw.select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"))))


def scannable(f: DataFrame) -> DataFrame:
    """Files outside of pruned folders (any case) and not among the skipped names."""
    pruned = F.lower("file_path").rlike(r"(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in PRUNED_DIRS) + r")/")
    return f.filter(~pruned & ~F.lower(F.element_at(F.split("file_path", "/"), -1)).isin(*SKIPPED_FILES))


def walk_counts(f: DataFrame) -> DataFrame:
    """kind (language, skipped_ext, folder), name, n_files. Unknown languages count as other; their extension (or name without one) is listed too. Folders count once each, the root included."""
    x = with_language(f)
    other = F.col("lang") == "unknown"
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    each = F.array_compact(F.array(
        F.struct(F.lit("language").alias("kind"), F.when(other, "other").otherwise(F.col("lang")).alias("name")),
        F.when(other, F.struct(F.lit("skipped_ext").alias("kind"), F.when(F.col("ext") != "", F.col("ext")).otherwise(F.col("base_name")).alias("name"))),
        F.struct(F.lit("folder").alias("kind"), folder.alias("name")),
    ))
    return x.select(F.inline(each)).groupBy("kind", "name").agg(F.count("*").alias("n_files"))


def with_language(f: DataFrame) -> DataFrame:
    """Add base_name, ext, lang: extension first (case matters), then known base names, else unknown."""
    base = F.element_at(F.split("file_path", "/"), -1)
    f = f.withColumn("base_name", base).withColumn("ext", F.regexp_extract("base_name", r"(\.[^.]+)$", 1))
    by_ext = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.col("ext"))
    by_name = F.element_at(F.create_map(*[F.lit(x) for kv in BASE_NAMES.items() for x in kv]), F.lower("base_name"))
    return f.withColumn("lang", F.coalesce(by_ext, by_name, F.lit("unknown")))


def lines(f: DataFrame) -> DataFrame:
    """One row a line: the other columns, line_no from 1, line."""
    keep = [c for c in f.columns if c != "content"]
    return f.select(*keep, F.posexplode(F.split("content", "\n")).alias("p", "line")).select(*keep, (F.col("p") + 1).alias("line_no"), "line")
