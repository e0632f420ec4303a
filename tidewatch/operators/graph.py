"""Call graphs over files: edges, enclosing function, reachability, taint closure.

Closures are semi-naive: each round joins only the frontier with the edges by key, drops what is
known by an anti join and cuts the lineage at the checkpoint folder, so a lost executor costs one
round. Only a row's existence comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.rules import lines_of
from tidewatch.session import cut

# Words that look like calls, and markers of entry points.
KEYWORDS = (
    "if for while switch case return break continue else try catch finally throw new delete typeof instanceof import from as class true false null nil None print println fmt log len cap make append range defer go select var let const type"
).split()
ENTRY_MARKERS = (
    "main", "init", "Main", "Init", "HandleFunc", "HandleRequest", "ServeHTTP", "handle", "handler", "Controller", "Action", "onCreate", "onStart", "viewdidload", "componentdidmount",
    "app.get", "app.post", "app.put", "app.delete", "app.use", "router.", "mux.", "http.Handle", "route.", "@app.route", "@admin_bp.route", "@bp.route", ".route(",
    "endpoint", "service", "api", "rpc", "public func", "export func", "export default",
)
# Function definitions (the last one that matches a line names its function) and calls.
DEFINITIONS = (
    r"^(?:func|def|function)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
    r"(?:public|private|protected)\s+\w+\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
    r"(?:fun)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
)
CALL = r"([A-Za-z_]\w*)\s*\("
SOURCE = r"request\.|req\.|\$_GET|\$_POST|getParameter|FormValue|params\[|ctx\.query"


def _defines(line: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(line, d, 1), F.lit("")) for d in reversed(DEFINITIONS)])


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def marks(files: DataFrame) -> DataFrame:
    """file_path, line_no, defines, calls, entry, source, fn of the lines that define, call or read a source.

    ``fn`` is the last function defined at or before the line. Lines are read inside the file's row,
    so only these few fields are exchanged, once, for the window that carries ``fn``.
    """
    x = files.select("file_path", lines_of("content").alias("lines"))

    def mark(line: Column, i: Column) -> Column:
        both = F.concat(F.coalesce(F.when(i > 0, F.get("lines", i - 1)), F.lit("")), F.lit("\n"), line)
        d = _defines(line)
        return F.struct((i + 1).alias("line_no"), d.alias("defines"), F.regexp_extract_all(line, F.lit(CALL), 1).alias("calls"), F.when(d.isNotNull(), _any(both, ENTRY_MARKERS)).otherwise(False).alias("entry"), line.rlike(SOURCE).alias("source"))

    m = x.select("file_path", F.inline(F.filter(F.transform("lines", mark), lambda s: s["defines"].isNotNull() | (F.size(s["calls"]) > 0) | s["source"])))
    w = W.partitionBy("file_path").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return m.withColumn("fn", F.last("defines", ignorenulls=True).over(w))


def functions_at(files: DataFrame, places: DataFrame) -> DataFrame:
    """file_path, line_no, fn of the places (file_path, line_no) that lie in a function: as-of the last definition at or above them."""
    defined = F.filter(F.transform(lines_of("content"), lambda line, i: F.struct((i + 1).alias("line_no"), _defines(line).alias("d"))), lambda s: s["d"].isNotNull())
    d = files.select("file_path", F.inline(defined)).select("file_path", "line_no", "d", F.lit(0).alias("asked"))
    p = places.select("file_path", "line_no").distinct().select("file_path", "line_no", F.lit(None).cast("string").alias("d"), F.lit(1).alias("asked"))
    w = W.partitionBy("file_path").orderBy("line_no", "asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = d.unionByName(p).withColumn("fn", F.last("d", ignorenulls=True).over(w))
    return x.filter((F.col("asked") == 1) & F.col("fn").isNotNull()).select("file_path", "line_no", "fn")


def edges(marked: DataFrame) -> DataFrame:
    """Distinct (caller, callee) of ``marks``; no self calls, no keywords."""
    x = marked.filter(F.col("fn").isNotNull()).select(F.col("fn").alias("caller"), F.explode("calls").alias("callee"))
    return x.filter((F.col("caller") != F.col("callee")) & ~F.col("callee").isin(*KEYWORDS)).distinct()


def entry_points(marked: DataFrame) -> DataFrame:
    """Functions whose line or the line before holds an entry marker."""
    return marked.filter("entry").select(F.col("defines").alias("name")).distinct()


#: Frontiers kept apart before they are written together.
PARTS = 8


def closure(edge: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): the seeds and all nodes reached from them along (src, dst), cycles included, however long the chains.

    A round writes its frontier only; what is known is the union of the frontiers, written
    together once PARTS of them stand side by side.
    """
    parts = [cut(seeds.select("node").distinct())]
    while True:
        known = reduce(DataFrame.unionByName, parts)
        frontier = parts[-1]
        step = frontier.join(edge, frontier["node"] == edge["src"]).select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti")
        frontier = cut(step)
        if frontier.isEmpty():
            return known
        if len(parts) >= PARTS:
            parts = [cut(known)]
        parts.append(frontier)


def reachable(files: DataFrame) -> DataFrame:
    """name: functions reachable from any entry point; all functions where there is no entry point."""
    m = cut(marks(files))
    e = edges(m).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    entries = entry_points(m)
    if entries.isEmpty():
        return m.filter(F.col("defines").isNotNull()).select(F.col("defines").alias("name")).unionByName(e.select(F.col("dst").alias("name"))).distinct()
    return closure(cut(e), entries.select(F.col("name").alias("node"))).select(F.col("node").alias("name"))


def unreachable_places(files: DataFrame, places: DataFrame) -> DataFrame:
    """Places (file_path, line_no) inside a function that no entry point reaches, with the function."""
    x = functions_at(files, places)
    return x.join(reachable(files), x["fn"] == F.col("name"), "left_anti")


def annotated(found: DataFrame, unreachable: DataFrame) -> DataFrame:
    """Findings with those at unreachable places brought down: severity info, a third of the confidence (0.3), text marked."""
    x = found.join(unreachable.select("file_path", "line_no", "fn"), ["file_path", "line_no"], "left")
    dead = F.col("fn").isNotNull()
    text = F.concat(F.lit("[UNREACHABLE] "), F.col("description"), F.lit(" (function '"), F.col("fn"), F.lit("' is not called from any entry point)"))
    return (
        x.withColumn("severity", F.when(dead, "info").otherwise(F.col("severity")))
        .withColumn("description", F.when(dead, text).otherwise(F.col("description")))
        .withColumn("confidence", F.when(dead, F.col("confidence") * 0.3).otherwise(F.col("confidence")))
        .drop("fn")
    )


def tainted(files: DataFrame) -> DataFrame:
    """name: functions that read a source, and all their callers, transitively."""
    m = cut(marks(files))
    e = cut(edges(m).select(F.col("callee").alias("src"), F.col("caller").alias("dst")))
    seeds = m.filter(F.col("fn").isNotNull() & F.col("source")).select(F.col("fn").alias("node"))
    return closure(e, seeds).select(F.col("node").alias("name"))
