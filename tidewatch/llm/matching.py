"""Matching findings of several engines that share no id.

A deterministic rule cascade assigns each record to an entity (one kind of weakness at one
place of one file of one target). Each pass is an exact join on a weaker combination of
attributes. Passes 1 to 4 take the four kinds of places (path whole or shortened, line or none), pass 5 what they left over:

1. whole path, kind, line: records of one file and kind whose lines lie within LINE_GAP of
   the next one found the entities;
2. shortened path, kind, line: the path is a proper suffix of the entity's path;
3. whole path, kind, no line: the file's only entity of the kind, or the only one the
   engine does not report yet;
4. shortened path, kind, no line: likewise;
5. the rest, by whole path as it stands and near lines among themselves.

Records of one place (file, kind, line) are gathered first, in one exchange; the passes look places up and
carry their records along, so nothing is joined back to single records.

Near lines and path suffixes become exact keys: an entity states the line buckets it touches
and the suffixes of its path (as many as the path has parts), a place states its bucket and the two beside it. No
join compares all records of a file name, kind or target: lines are looked up once for each distinct
place asked for (a bucket has LINE_GAP lines at most), and places without a line meet one
summary row a key, extension and engine. The summary counts the entities and XORs the halves of their keys, so that the
only entity, or the only one an engine does not report, is left over.

The kind comes from the CWE where there is one, else from the issue name: the class that names
spelled alike carry in the corpus, else naive Bayes over character trigrams (misspellings).

A record's confidence is the precision of its pass, measured on labelled cases with add-one
smoothing. Labelled are records of whole path and line whose CWE is given: the CWE, not the
cascade, says which entity is theirs. The CWE is withheld (the kind comes from the name), they are
stripped of what the pass does without, and it is counted how often the pass brings them to the
entity of their CWE. All of them are rated: those alike in all that a pass reads are tried once and
count as often as they occur. A pair's confidence is the product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import folded, trimmed
from tidewatch.session import cut

#: Lines of one weakness lie at most this far from the next report of it; other weaknesses are dozens of lines away.
LINE_GAP = 20

# CWE numbers of one kind of weakness (from the public CWE hierarchy).
CWE_KINDS = {
    "command_injection": (77, 78, 88),
    "cross_site_scripting": (79, 80, 83, 87),
    "path_traversal": (22, 23, 36, 73),
    "sql_injection": (89, 564, 943),
    "hardcoded_credential": (259, 321, 798),
    "weak_cryptography": (326, 327, 328, 916),
    "weak_random": (330, 331, 335, 338, 340),
    "missing_authorization": (284, 285, 639, 862, 863),
    "deserialization": (502,),
    "open_redirect": (601,),
    "xml_external_entity": (611, 776, 827),
    "request_forgery_server": (918,),
    "request_forgery_cross_site": (352,),
    "sensitive_log": (117, 532),
    "code_injection": (94, 95, 1336),
}


def engine_of(source: Column) -> Column:
    return F.regexp_replace(folded(source), r"[\s_-]+", "-")


def target_of(target: Column) -> Column:
    t = F.regexp_replace(folded(target), r"^(?:[a-z+]+://[^/]+/|[\w.-]+@[\w.-]+:)", "")
    return F.regexp_replace(t, r"(?:\.git)?/*$", "")


def kind_of_cwe(cwe: Column) -> Column:
    n = F.regexp_extract(F.coalesce(cwe, F.lit("")), r"(\d+)", 1)
    pairs = [x for kind, ns in CWE_KINDS.items() for k in ns for x in (F.lit(str(k)), F.lit(kind))]
    known = F.element_at(F.create_map(*pairs), n)
    return F.when(n != "", F.coalesce(known, F.concat(F.lit("cwe-"), n)))


def name_key(issue_name: Column) -> Column:
    """Issue name without case, joining signs and words that are code (with an underscore or digit)."""
    n = F.regexp_replace(folded(issue_name), r"\S*(?:_|\d)\S*", " ")
    n = F.regexp_replace(n, r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(F.trim(n), r"\s+in$", ""))


def _path_columns(df: DataFrame) -> DataFrame:
    """path (parts joined by /, no extension), ext, absolute, path_line from file_path, which stays."""
    p = F.translate(F.coalesce(trimmed(F.col("file_path")), F.lit("")), "\\", "/")
    at = r":(\d+)(?::\d+)?$"
    df = df.withColumn("__p", F.regexp_replace(p, r"^file://", "")).withColumn("path_line", F.regexp_extract("__p", at, 1).try_cast("int"))
    p = F.regexp_replace(F.regexp_replace("__p", at, ""), r"/(?:\.?/)+", "/")
    p = F.regexp_replace(p, r"^(?:\./)+", "")
    df = df.withColumn("__p", p).withColumn("absolute", F.col("__p").rlike(r"^(?:/|[A-Za-z]:/)"))
    p = F.regexp_replace("__p", r"^(?:[A-Za-z]:)?/+", "")
    # Module form: dots for slashes, no extension.
    df = df.withColumn("__p", p).withColumn("__module", ~F.col("__p").contains("/") & F.col("__p").rlike(r"^[^.]+(?:\.[^.]+){2,}$"))
    ext = F.when(F.col("__module"), "").otherwise(F.lower(F.regexp_extract("__p", r"[^/]\.([A-Za-z0-9]+)$", 1)))
    df = df.withColumn("ext", ext)
    path = F.when(F.col("__module"), F.translate("__p", ".", "/")).otherwise(F.regexp_replace("__p", r"(?<=[^/])\.[A-Za-z0-9]+$", ""))
    return df.withColumn("path", path).drop("__p", "__module")


def _suffixes(path: Column) -> Column:
    """Proper suffixes of a path, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _grams(name: str) -> Column:
    padded = F.concat(F.lit(" "), F.col(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


def _name_kinds(r: DataFrame) -> DataFrame:
    """name, name_kind: the kind an issue name stands for, learnt from all rows that have a CWE; no row where nothing tells."""
    has = F.col("cwe_kind").isNotNull()
    named = r.filter(F.col("name") != "").groupBy("name", "cwe_kind").agg(F.count("*").alias("n")).groupBy("name")
    named = cut(named.agg(F.max(F.when(has, F.struct("n", "cwe_kind"))).alias("x"), F.collect_list(F.when(has, F.struct("cwe_kind", "n"))).alias("kinds")))
    exact = named.filter(F.col("x").isNotNull()).select("name", F.col("x.cwe_kind").alias("name_kind"))

    learnt = named.select(_grams("name").alias("grams"), F.inline("kinds"))
    model = learnt.select("cwe_kind", "n", F.explode("grams").alias("gram")).groupBy("gram", "cwe_kind").agg(F.sum("n").alias("n"))
    totals = learnt.groupBy("cwe_kind").agg(F.sum(F.col("n") * F.size("grams")).alias("all"))
    small, vocabulary = 0.5, 1000  # add-half smoothing over about so many trigrams
    unknown = named.filter(F.col("x").isNull()).select("name", F.explode(_grams("name")).alias("gram"))
    hits = unknown.join(model, "gram").groupBy("name", "cwe_kind").agg(F.sum(F.ln(F.col("n") + small) - F.ln(F.lit(small))).alias("gain"))
    scored = hits.join(totals, "cwe_kind").withColumn("score", F.col("gain") - F.length("name") * F.ln(F.col("all") + small * vocabulary))
    guessed = scored.groupBy("name").agg(F.max(F.struct("score", "cwe_kind")).alias("x")).select("name", F.col("x.cwe_kind").alias("name_kind"))
    return exact.unionByName(guessed)


def records(engine_findings: DataFrame) -> DataFrame:
    """db_id, engine, target, path, ext, line (null if none), kind, name_kind, cwe_kind, short.

    Rows without db_id are left out, a row delivered twice counts once. Absolute paths are cut
    to the longest suffix that the target's relative paths hold; ``short`` tells paths that are
    a proper suffix of another path of the target; a missing extension is taken from the file's
    only one.
    """
    # Only columns used below: other columns of the input cannot clash.
    r = engine_findings.select("db_id", "target", "source", "issue_name", "file_path", "line_number", "cwe").filter(F.col("db_id").isNotNull()).dropDuplicates(["db_id"])
    own_line = F.regexp_extract(F.coalesce("line_number", F.lit("")), r"(\d+)", 1).try_cast("int")
    r = r.select(
        "db_id", engine_of(F.col("source")).alias("engine"), target_of(F.col("target")).alias("target"), name_key(F.col("issue_name")).alias("name"), F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.when(own_line > 0, own_line).alias("own_line"), kind_of_cwe(F.col("cwe")).alias("cwe_kind"),
    )
    # Read three times below: for its files, its names and its rows.
    r = cut(r)
    names = _name_kinds(r.select("name", "cwe_kind"))
    r = r.join(_files(r.select("target", "file_path").distinct()), ["target", "file_path"]).withColumn("line", F.coalesce("own_line", F.when(F.col("path_line") > 0, F.col("path_line"))))
    r = r.drop("own_line", "path_line", "file_path").join(names, "name", "left").withColumn("name_kind", F.coalesce("name_kind", F.concat(F.lit("name:"), F.coalesce("name", F.lit("")))))
    return r.withColumn("kind", F.coalesce("cwe_kind", "name_kind")).drop("name")


def _files(spelled: DataFrame) -> DataFrame:
    """target, file_path (as spelled), path_line, path, ext, short: all that is known of a path, on distinct ones only."""
    f = cut(_path_columns(spelled))
    own = [c for c in f.columns if c not in ("target", "file_path")]
    relative = f.filter(~F.col("absolute") & F.col("path").contains("/")).select("target", F.col("path").alias("tail"), F.lit(True).alias("held")).distinct()
    tails = f.filter("absolute").select("*", F.posexplode(_suffixes(F.col("path"))).alias("drop", "tail")).join(relative, ["target", "tail"], "left")
    rooted = tails.groupBy("target", "file_path").agg(*(F.first(c).alias(c) for c in own), F.min(F.when(F.col("held"), F.struct("drop", "tail"))).alias("x")).select("target", "file_path", *own, F.col("x.tail").alias("rooted"))
    # No relative twin: cut through the part named like the target's repository.
    repo = F.element_at(F.split("target", "/"), -1)
    at = F.instr(F.concat(F.lit("/"), F.col("path"), F.lit("/")), F.concat(F.lit("/"), repo, F.lit("/")))
    by_repo = F.when(F.col("absolute") & (at > 0), F.substring(F.col("path"), at + F.length(repo) + 1, F.length("path")))
    f = f.filter(~F.col("absolute")).withColumn("rooted", F.lit(None).cast("string")).unionByName(rooted)
    f = f.withColumn("path", F.coalesce("rooted", by_repo, "path")).drop("rooted", "absolute")
    # What other paths of the target say of one: its only extension, and whether it is the end of a longer one.
    here = F.struct(F.col("path"), F.when(F.col("ext") != "", F.col("ext")).alias("e"), F.lit(False).alias("s"))
    ends = F.transform(F.filter(_suffixes(F.col("path")), lambda p: p != ""), lambda p: F.struct(p.alias("path"), F.lit(None).cast("string").alias("e"), F.lit(True).alias("s")))
    said = f.select("target", F.inline(F.concat(F.array(here), ends))).groupBy("target", "path").agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.max("s").alias("short"))
    f = f.join(said, ["target", "path"])
    return f.select("target", "file_path", "path_line", "path", F.when(F.col("ext") != "", F.col("ext")).otherwise(F.coalesce(F.when(F.col("lo") == F.col("hi"), F.col("lo")), F.lit(""))).alias("ext"), "short")


FILE_KIND = ("target", "path", "ext", "kind")


def _key(*columns: Column | str) -> Column:
    """A digest of 16 bytes that stands for several columns in exchanges and joins."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *columns)))


def _islands(places: DataFrame) -> DataFrame:
    """Places (file, kind, line) with the first line and the key of their island."""
    w = W.partitionBy(*FILE_KIND).orderBy("line")
    p = places.withColumn("first", F.coalesce(F.col("line") - F.lag("line").over(w) > LINE_GAP, F.lit(True)))
    p = p.withColumn("lo", F.last(F.when(F.col("first"), F.col("line")), ignorenulls=True).over(w)).drop("first")
    return p.withColumn("entity", _key(*FILE_KIND, F.col("lo").cast("string")))


def _places(r: DataFrame) -> DataFrame:
    """Distinct places with their records (members: engine, db_id). One exchange, by file and kind, serves the islands too."""
    return r.repartition(*FILE_KIND).groupBy(*FILE_KIND, "line", "short").agg(F.collect_list(F.struct("engine", "db_id")).alias("members"))


def _buckets(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo / LINE_GAP), F.floor(hi / LINE_GAP))


#: Stands for every engine: no engine's name holds a blank.
ANY = "\n"


def _stated(ent: DataFrame, suffixed: bool, *columns: Column | str) -> DataFrame:
    """The paths under which an entity is found, with its kind and extension (e_ext)."""
    path = F.explode(_suffixes(F.col("path"))).alias("path") if suffixed else F.col("path")
    return ent.select("target", path, "kind", F.col("ext").alias("e_ext"), "entity", *columns)


def _ext_fits() -> Column:
    return (F.col("ext") == "") | (F.col("e_ext") == "") | (F.col("ext") == F.col("e_ext"))


LINE_PLACE = ("target", "path", "kind", "ext", "line")
FREE_PLACE = ("target", "path", "kind", "ext", "engine")


def _nearest(places: DataFrame, ent: DataFrame, suffixed: bool) -> DataFrame:
    """Distinct LINE_PLACEs, with their other columns, -> nearest entity with a fitting path, kind and line, or null."""
    own = [c for c in places.columns if c not in LINE_PLACE]
    bucket = F.floor(F.col("line") / LINE_GAP)
    asked = places.select("*", F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"))
    e = _stated(ent, suffixed, "lo", "hi")
    e = e.select("*", F.explode(_buckets(F.col("lo"), F.col("hi"))).alias("bucket"))
    x = asked.join(e, ["target", "path", "kind", "bucket"], "left")
    away = F.greatest(F.col("lo") - F.col("line"), F.col("line") - F.col("hi"), F.lit(0))
    best = F.min(F.when(F.col("lo").isNotNull() & (away <= LINE_GAP) & _ext_fits(), F.struct(away.alias("away"), "entity")))
    return x.groupBy(*LINE_PLACE).agg(*(F.first(c).alias(c) for c in own), best.alias("x")).select(*LINE_PLACE, *own, F.col("x.entity").alias("entity"))


def _half(entity: Column | str, k: int) -> Column:
    return F.conv(F.hex(F.substring(entity, 1 + 8 * k, 8)), 16, -10).cast("long")


def _lone(places: DataFrame, ent: DataFrame, suffixed: bool) -> DataFrame:
    """Distinct FREE_PLACEs, with their other columns, -> the only entity with a fitting path and kind, or the only one without a record of the engine, or null.

    ent: entities with the engines that report them.
    """
    own = [c for c in places.columns if c not in FREE_PLACE]
    key = ["target", "path", "kind", "e_engine"]
    e = _stated(ent, suffixed, _half("entity", 0).alias("x0"), _half("entity", 1).alias("x1"), F.explode(F.concat(F.array(F.lit(ANY)), "engines")).alias("e_engine"))
    e = e.groupBy(*key, "e_ext").agg(F.count("*").alias("n"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"))
    x = places.select("*", F.explode(F.array(F.lit(ANY), "engine")).alias("e_engine")).join(e, key, "left")
    every = F.coalesce((F.col("e_engine") == ANY) & _ext_fits(), F.lit(False))
    has = F.coalesce((F.col("e_engine") != ANY) & _ext_fits(), F.lit(False))
    total = (F.sum(F.when(every, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_has"))
    xors = (F.bit_xor(F.when(c, F.col(f"x{k}")).otherwise(0)).alias(f"{name}{k}") for name, c in (("every", every), ("has", has)) for k in (0, 1))
    g = x.groupBy(*FREE_PLACE).agg(*(F.first(c).alias(c) for c in own), *total, *xors)

    def entity(*halves: Column) -> Column:
        return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))

    left = [F.col(f"every{k}").bitwiseXOR(F.col(f"has{k}")) for k in (0, 1)]
    only = F.when(F.col("n") == 1, entity(F.col("every0"), F.col("every1"))).when(F.col("n") - F.col("n_has") == 1, entity(*left))
    return g.select(*FREE_PLACE, *own, only.alias("entity"))


def _reported(ent: DataFrame, *more: DataFrame) -> DataFrame:
    """Entities with the engines of the records that found them so far (more: places with entity and members)."""
    for m in more:
        m = m.filter(F.col("entity").isNotNull()).select("entity", F.array_sort(F.array_distinct("members.engine")).alias("engines"))
        ent = ent.unionByName(m, allowMissingColumns=True)
    return ent.groupBy("entity").agg(*(F.max(c).alias(c) for c in FILE_KIND), F.array_distinct(F.flatten(F.collect_set("engines"))).alias("engines"))


def _by_engine(places: DataFrame) -> DataFrame:
    """Distinct FREE_PLACEs with the members of their engine."""
    p = places.select(*FILE_KIND, "members", F.explode(F.array_distinct("members.engine")).alias("engine"))
    return p.withColumn("members", F.filter("members", lambda m: m["engine"] == F.col("engine")))


def assigned(engine_findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records with entity and pass, records, entities of pass 1).

    Each pass takes other places: with or without a line, of a whole or a shortened path. What it leaves over has no entity.
    """
    r = cut(records(engine_findings))
    has_line = F.col("line").isNotNull()
    p = cut(_islands(_places(r)))
    first = p.filter(~F.col("short") & has_line)
    engines = F.array_sort(F.array_distinct(F.flatten(F.collect_set("members.engine"))))
    ent = cut(first.groupBy(*FILE_KIND, "lo", "entity").agg(F.max("line").alias("hi"), engines.alias("engines")))
    second = cut(_nearest(p.filter(F.col("short") & has_line).select(*LINE_PLACE, "members"), ent, True))
    third = cut(_lone(_by_engine(p.filter(~F.col("short") & ~has_line)), _reported(ent, second), False))
    fourth = cut(_lone(_by_engine(p.filter(F.col("short") & ~has_line)), _reported(ent, second, third), True))

    hit = F.col("entity").isNotNull()
    near = _islands(second.filter(~hit)).withColumn("entity", _key(F.hex("entity"), F.lit("rest")))
    alone = third.unionByName(fourth).filter(~hit).withColumn("entity", _key(F.lit("rest"), *FILE_KIND))
    parts = ((first, 1), (second.filter(hit), 2), (third.filter(hit), 3), (fourth.filter(hit), 4), (near, 5), (alone, 5))
    done = reduce(DataFrame.unionByName, (x.select("entity", F.lit(n).alias("pass"), F.inline("members")) for x, n in parts))
    return done.select("db_id", "engine", "entity", "pass"), r, ent


def pass_precision(done: DataFrame, r: DataFrame, ent: DataFrame) -> DataFrame:
    """pass, labelled, right, precision = (right + 1) / (labelled + 2)."""
    truth = done.filter(F.col("pass") == 1).select("db_id", F.col("entity").alias("true_entity"))
    known = r.filter(F.col("cwe_kind").isNotNull() & F.col("line").isNotNull() & ~F.col("short")).join(truth, "db_id")
    # Without a line a record must find its entity although its own engine is already there: its place counts as free, and engines do not matter.
    known = known.withColumn("kind", F.col("name_kind")).withColumn("engine", F.lit(""))
    known = cut(known.groupBy(*LINE_PLACE, "engine", "cwe_kind", "true_entity").agg(F.count("*").alias("n")))
    parts = F.split("path", "/")
    cut_short = known.filter(F.size(parts) > 1).withColumn("path", F.element_at(parts, -1))
    nobody = ent.withColumn("engines", F.array().cast("array<string>"))

    def rate(n: int, x: DataFrame, right: Column) -> DataFrame:
        labelled, hits = (F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("n"), F.when(right, F.col("n"))))
        return x.agg(F.lit(n).alias("pass"), labelled.alias("labelled"), hits.alias("right"))

    # The rest is grouped by the kind alone: right where the name's kind is the CWE's.
    out = rate(5, known, F.col("cwe_kind") == F.col("kind"))
    for n, rows, suffixed in ((1, known, False), (2, cut_short, True)):
        for k, place, hits in ((n, LINE_PLACE, _nearest(rows.select(*LINE_PLACE).distinct(), ent, suffixed)), (n + 2, FREE_PLACE, _lone(rows.select(*FREE_PLACE).distinct(), nobody, suffixed))):
            out = out.unionByName(rate(k, rows.join(hits.filter(F.col("entity").isNotNull()), [*place]), F.col("entity") == F.col("true_entity")))
    return out.withColumn("precision", (F.col("right") + 1) / (F.col("labelled") + 2))


def _pairs(done: DataFrame) -> DataFrame:
    """Pairs of records of one entity by different engines; entities of one engine are dropped first."""
    w = W.partitionBy("entity")
    m = done.withColumn("lo", F.min("engine").over(w)).withColumn("hi", F.max("engine").over(w)).filter(F.col("lo") != F.col("hi"))
    a = m.select(F.col("db_id").alias("db_id_a"), F.col("engine").alias("engine_a"), "entity", F.col("pass").alias("pass_a"))
    b = m.select(F.col("db_id").alias("db_id_b"), F.col("engine").alias("engine_b"), "entity", F.col("pass").alias("pass_b"))
    return a.join(b, "entity").filter((F.col("db_id_a") < F.col("db_id_b")) & (F.col("engine_a") != F.col("engine_b")))


def found(engine_findings: DataFrame) -> DataFrame:
    """The rows of TESTDATA.md's p4_found."""
    return _pairs(assigned(engine_findings)[0]).select("db_id_a", "db_id_b")


def matches(engine_findings: DataFrame) -> DataFrame:
    """Matched pairs with the passes of both records and the confidence.

    Rows without target, path, name, CWE or line take part with what they have; rows without
    db_id do not. An empty table gives no pairs.
    """
    done, r, ent = assigned(engine_findings)
    p = cut(pass_precision(done, r, ent).select("pass", "precision"))
    x = _pairs(done)
    for s in ("a", "b"):
        x = x.join(p.select(F.col("pass").alias(f"pass_{s}"), F.col("precision").alias(f"precision_{s}")), f"pass_{s}")
    return x.select("db_id_a", "db_id_b", "engine_a", "engine_b", "pass_a", "pass_b", (F.col("precision_a") * F.col("precision_b")).alias("confidence"))
