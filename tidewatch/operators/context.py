"""Operators on lines around a place: snippets, anchors, chunks, pointers, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.rules import around, lines_of

# Extensions by kind of comment; lines that say nothing.
C_FAMILY = (".go", ".js", ".ts", ".java", ".c", ".cpp", ".cs", ".php", ".swift", ".kt", ".dart", ".scala", ".rs")
HASH_FAMILY = (".py", ".rb", ".sh", ".bash", ".yaml", ".yml", ".dockerfile", ".tf", ".pl")
MARKUP = (".html", ".xml", ".vue")
JUNK = r"^(\}|\{|\];|\};|\);|//.*|/\*.*|\*.*|#.*|<!--.*)?$"
TRIVIAL = r"^([\]\})(\[{]|\];|\};|\);|\}\)|\}\);|//.*|/\*.*|\*.*|#.*|<!--.*|--.*)?$"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def is_junk(line: Column) -> Column:
    return stripped(line).rlike(JUNK)


def blank_out(text: Column, pattern: str) -> Column:
    """Every match with each character but line ends as a blank: offsets and line numbers stay."""
    pieces = F.split(text, pattern, -1)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.regexp_replace(m, r"[^\r\n]", " "))
    joined = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(hits, i), F.lit(""))))
    return F.array_join(joined, "")


def strip_comments(text: Column, ext: Column) -> Column:
    """Comments by the family of the extension, blanked out; other extensions stay. Strings are not told apart."""
    e = F.lower(ext)
    c = blank_out(blank_out(text, r"(?s)/\*.*?\*/"), r"//[^\n]*")
    return F.when(e.isin(*C_FAMILY), c).when(e.isin(*HASH_FAMILY), blank_out(text, r"#[^\n]*")).when(e.isin(*MARKUP), blank_out(text, r"(?s)<!--.*?-->")).otherwise(text)


def at_places(files: DataFrame, places: DataFrame) -> DataFrame:
    """file_path, lines (array), places (array of the other columns): the places of a file beside its lines.

    The places, of which a file has few, are gathered by file and meet it in one join; files without
    any drop out. What stands around a place is then a slice of the row.
    """
    own = [c for c in places.columns if c != "file_path"]
    p = places.groupBy("file_path").agg(F.collect_set(F.struct(*own)).alias("places"))
    return files.select("file_path", lines_of("content").alias("lines")).join(p, "file_path")


def snippets(files: DataFrame, places: DataFrame, reach: int = 2) -> DataFrame:
    """file_path, line_no, snippet: numbered lines around each place (file_path, line_no), the place marked; places beyond the file drop out."""
    x = at_places(files, places.select("file_path", "line_no"))

    def numbered(p: Column) -> Column:
        first = F.greatest(p["line_no"] - reach, F.lit(1))

        def row(line: Column, i: Column) -> Column:
            n = first + i
            return F.concat(F.when(n == p["line_no"], "→ ").otherwise("  "), F.lpad(n.cast("string"), 4, " "), F.lit(" | "), line)

        return F.array_join(F.transform(around(F.col("lines"), p["line_no"], reach, reach), row), "\n")

    inside = F.filter("places", lambda p: p["line_no"] <= F.size("lines"))
    return x.select("file_path", F.inline(F.transform(inside, lambda p: F.struct(p["line_no"].alias("line_no"), numbered(p).alias("snippet")))))


def is_trivial(line: Column) -> Column:
    return stripped(line).rlike(TRIVIAL)


def anchors(files: DataFrame, fragments: DataFrame, reach: int = 30) -> DataFrame:
    """file_path, line_no, fragment, anchored: the line a code fragment (file_path, line_no, fragment) belongs to.

    The nearest line within ``reach`` that holds the fragment, or its first token if that has more
    than six characters (any case, the upper line on a tie), else the line itself; from a trivial
    line it moves to the next better one within two, down before up. Places of files that are
    not there stay as they are.
    """
    own = fragments.select("file_path", "line_no", "fragment").distinct()
    x = at_places(files, own)
    lines = F.col("lines")

    def nearest(p: Column) -> Column:
        low = F.lower(F.trim(p["fragment"]))
        token = F.regexp_extract(low, r"^([^ \t(=;]*)[ \t(=;]", 1)
        short = F.when(F.length(token) > 6, token).otherwise(low)
        first = F.greatest(p["line_no"] - reach, F.lit(1))
        hit = F.transform(around(lines, p["line_no"], reach, reach), lambda line, i: F.when(F.lower(line).contains(low) | F.lower(line).contains(short), F.struct(F.abs(first + i - p["line_no"]).alias("d"), (first + i).alias("n"))))
        return F.when(low != "", F.array_min(F.array_compact(hit))["n"])

    def better(n: Column) -> Column:
        steps = [F.when(~F.coalesce(is_trivial(F.get(lines, n - 1 + d)), F.lit(True)), n + d) for d in (0, 1, -1, 2, -2)]
        return F.when(F.get(lines, n - 1).isNull(), n).otherwise(F.coalesce(*steps, n))

    hit = x.select("file_path", F.inline(F.transform("places", lambda p: F.struct(p["line_no"].alias("line_no"), p["fragment"].alias("fragment"), better(F.coalesce(nearest(p), p["line_no"])).alias("at")))))
    return own.join(hit, ["file_path", "line_no", "fragment"], "left").select("file_path", "line_no", "fragment", F.coalesce("at", "line_no").alias("anchored"))


def adjusted_line(lines: Column, at: Column, reach: int = 3) -> Column:
    """``at``, or for a junk line the nearest line that is none within ``reach``, up before down."""
    steps = [F.when(~is_junk(F.get(lines, at - 1 + d)), at + d) for k in range(1, reach + 1) for d in (-k, k)]
    return F.when(is_junk(F.get(lines, at - 1)), F.coalesce(*steps, at)).otherwise(at)


def adjusted_pointers(files: DataFrame, reach: int = 3) -> DataFrame:
    """file_path, line_no, adjusted for every line."""
    x = files.select("file_path", lines_of("content").alias("lines"))
    each = F.transform("lines", lambda _, i: F.struct((i + 1).alias("line_no"), adjusted_line(F.col("lines"), i + 1, reach).alias("adjusted")))
    return x.select("file_path", F.inline(each))


def chunks(lines: DataFrame, size: int = 2000, overlap: int = 50) -> DataFrame:
    """file_path, chunk_no, from_line, to_line, n_chars: sliding chunks with overlap; the last one ends with the file.

    A line belongs to at most ceil(size / step) chunks, which it names itself: no range join.
    """
    step = size - overlap
    last = lines.groupBy("file_path").agg(F.max("line_no").alias("n"))
    starts = last.select("file_path", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("n") - overlap) / step) - 1, F.lit(0)))).alias("chunk_no"))
    spans = starts.select("file_path", "chunk_no", (F.col("chunk_no") * step + 1).alias("from_line"), F.least(F.col("chunk_no") * step + size, F.col("n")).alias("to_line"))
    hi = F.floor((F.col("line_no") - 1) / step)
    lo = F.greatest(F.ceil((F.col("line_no") - size) / step), F.lit(0))
    own = lines.select("file_path", "line_no", F.length("line").alias("len"), F.explode(F.sequence(lo, hi)).alias("chunk_no"))
    sums = own.groupBy("file_path", "chunk_no").agg(F.sum(F.col("len") + 1).alias("n_chars"))
    return spans.join(sums, ["file_path", "chunk_no"])


def entropy(c: Column) -> Column:
    """Shannon entropy of a text's characters in bits; null for an empty text. Counts are run lengths of the sorted characters."""
    sorted_chars = F.array_join(F.array_sort(F.split(c, "")), "")
    runs = F.regexp_extract_all(sorted_chars, F.lit(r"(?s)((.)\2*)"), 1)
    n = F.length(c).cast("double")
    return F.when(F.length(c) > 0, F.aggregate(runs, F.lit(0.0), lambda a, r: a - F.length(r) / n * F.log2(F.length(r) / n)))
