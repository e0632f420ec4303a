"""Best representative of each duplicate group.

Skyline selection: of all reports of a fingerprint the Pareto-undominated ones across
completeness, recency and trust are found, a lexicographic policy (trust, recency,
completeness, lowest id) resolves them, and fields without a usable value are filled from
the successive dominance layers.

A group of any size is reduced before it meets a single task: of the reports with the same
set of usable fields and the same rank only the latest can be undominated or fill anything,
so ``cells`` keeps one row for each (fingerprint, usable set, rank), a partial aggregation.
That is at most 2**4 x (number of ranks + 1) cells a fingerprint, whatever its reports.
Layers are then computed inside the row with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import folded

FIELDS = ("severity", "confidence", "ai_validated", "remediation")

SEVERITIES = ("critical", "high", "medium", "low", "info", "informational", "moderate")
#: Stand-ins for "no value", after folding and without a final stop.
NO_VALUE = (
    r"^(?:n\s*[/.]?\s*a\.?|none|null|nil|nan|undefined|undef|unset|unknown|unspecified|blank|empty|missing|default|"
    r"not (?:set|available|applicable|known|given|provided|specified|assigned)|no (?:value|data|remediation|advice|fix|answer)(?: (?:given|available|provided))?|"
    r"tb[dac]|t\.b\.d|to ?do|to be (?:done|determined|defined|decided|announced|completed|added)|fix ?me|x{2,}|placeholder|"
    r"see (?:above|below|there|description|details|previous)|same as (?:above|before)|as above|ditto|[\p{P}\p{S}\s]*)[.!]?$"
)
#: Notes that the check did not take place or failed.
NOT_CHECKED = (
    r"^(?:skip|error|err\b|fail|time[d ]*\s?out|cancel|abort|pending|queued|waiting|in progress|running|unavailable|unavail|unvalidated|unverified|unchecked|"
    r"not (?:yet )?(?:checked|validated|verified|run|executed|performed|started|tested|reviewed|assessed|processed|done)|"
    r"(?:could|can|was|did) ?no?t|unable|no (?:result|response|reply|verdict|check)|(?:check|validation|model|ai|request|service|provider)\b.{0,30}\b(?:failed|error|unavailable|offline|timed out|skipped|cancell?ed|not run))"
)


def usable(field: str) -> Column:
    """Whether a field holds a real value."""
    c = F.col(field)
    if field == "confidence":
        return F.coalesce((c > 0) & (c <= 1), F.lit(False))  # NaN is above 1
    v = folded(c)
    if field == "severity":
        return v.isin(*SEVERITIES)
    real = ~v.rlike(NO_VALUE)
    return real & ~v.rlike(NOT_CHECKED) if field == "ai_validated" else real


def with_rank(reports: DataFrame, trust: DataFrame) -> DataFrame:
    """``rank``: highest trust_rank of the engines named in source; -1 if none is known.

    The engine list of a row is matched as a set in one equi join a part; ``source`` has few
    distinct spellings, so the join runs over the distinct ones.
    """
    t = trust.select(folded(F.col("source")).alias("engine"), "trust_rank").filter(F.col("trust_rank").isNotNull())
    spell = reports.select("source").filter(F.col("source").isNotNull()).distinct()
    parts = spell.select("source", F.explode(F.split("source", r"[,;|+&/]")).alias("engine")).withColumn("engine", folded(F.col("engine")))
    ranks = parts.join(t, "engine").groupBy("source").agg(F.max("trust_rank").alias("rank"))
    return reports.join(ranks, "source", "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))


def rated(reports: DataFrame, trust: DataFrame) -> DataFrame:
    """Reports with a fingerprint, each with its rank and the bit set ``mask`` of its usable fields."""
    mask = sum((F.when(usable(f), 1 << i).otherwise(0) for i, f in enumerate(FIELDS)), F.lit(0))
    r = reports.select("report_id", "fingerprint", "source", *FIELDS, "reported_at").filter(F.col("fingerprint").isNotNull() & F.col("report_id").isNotNull())
    return with_rank(r.withColumn("mask", mask), trust)


def cells(rated_reports: DataFrame) -> DataFrame:
    """fingerprint, mask, rank, latest report of that kind, and the smallest and largest report_id."""
    latest = F.max(F.struct("reported_at", (-F.col("report_id")).alias("neg_id"), *FIELDS))
    return rated_reports.groupBy("fingerprint", "mask", "rank").agg(latest.alias("top"), F.min("report_id").alias("lo"), F.max("report_id").alias("hi"))


def _as_array(cell_rows: DataFrame) -> DataFrame:
    """One row a fingerprint with its (bounded) cells, in an order in which dominators come first."""
    one = F.struct(
        F.bit_count("mask").alias("complete"),
        F.coalesce("top.reported_at", F.timestamp_seconds(F.lit(-62_135_596_800))).alias("at"),
        "rank",
        F.col("top.neg_id").alias("neg_id"),
        "mask",
        *[F.col(f"top.{f}").alias(f) for f in FIELDS],
    )
    g = cell_rows.groupBy("fingerprint").agg(F.collect_list(one).alias("cells"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return g.withColumn("cells", F.sort_array("cells", asc=False))


def _dominates(a: Column, b: Column) -> Column:
    no_worse = (a["complete"] >= b["complete"]) & (a["at"] >= b["at"]) & (a["rank"] >= b["rank"])
    better = (a["complete"] > b["complete"]) | (a["at"] > b["at"]) | (a["rank"] > b["rank"])
    return no_worse & better


def _layers(cells: Column | str) -> Column:
    """The cells, each with its dominance layer (1 = undominated).

    A cell's layer is one more than the highest layer among the cells that dominate it;
    those precede it in the array, so one pass over the array finds all layers.
    """
    first = F.transform(cells, lambda c: F.struct(c.alias("c"), F.lit(0).alias("layer")))
    empty = F.slice(first, 1, 0)

    def step(acc: Column, c: Column) -> Column:
        above = F.array_max(F.transform(F.filter(acc, lambda d: _dominates(d["c"], c)), lambda d: d["layer"]))
        return F.concat(acc, F.array(F.struct(c.alias("c"), (F.coalesce(above, F.lit(0)) + 1).alias("layer"))))

    return F.aggregate(cells, empty, step)


def layered(cell_rows: DataFrame) -> DataFrame:
    """fingerprint, lo, hi, cells with their dominance layer across completeness, recency and trust."""
    return _as_array(cell_rows).withColumn("cells", _layers("cells"))


def field_layers(cell_rows: DataFrame) -> DataFrame:
    """fingerprint, lo, hi and for each field the cells with a usable value, in layers across recency and trust."""
    g = _as_array(cell_rows)
    same = [F.col(c) for c in ("fingerprint", "lo", "hi")]

    def alone(bit: int) -> Column:
        # With one field asked for, all its cells are equally complete.
        own = F.transform(F.filter("cells", _has(bit)), lambda x: F.struct(F.lit(1).alias("complete"), x["at"].alias("at"), x["rank"].alias("rank"), x["neg_id"].alias("neg_id")))
        return _layers(F.sort_array(own, asc=False))

    return g.select(*same, *[alone(i).alias(f) for i, f in enumerate(FIELDS)])


def _has(bit: int, inside: str | None = None):
    return lambda x: F.getbit((x[inside] if inside else x)["mask"], F.lit(bit)) == 1


def _at(at: Column, rank: Column):
    return lambda x: (x["c"]["at"] == at) & (x["c"]["rank"] == rank)


def _by_policy(field: str | None = None):
    """Sort key of the lexicographic policy, highest first, with the field's value at its end."""
    return lambda x: F.struct((-x["layer"]).alias("l"), x["c"]["rank"].alias("r"), x["c"]["at"].alias("a"), x["c"]["complete"].alias("n"), x["c"]["neg_id"].alias("i"), *([x["c"][field].alias("v")] if field else []))


def survivors(reports: DataFrame, trust: DataFrame) -> DataFrame:
    """One surviving record a fingerprint, each field with the report and layer it comes from.

    Each field takes the usable value of the lowest layer that has one, there by policy:
    higher rank, later reported_at, more complete, lower report_id. Without any usable value
    the field and its report are null. Reports without fingerprint or report_id do not take
    part; null reported_at counts as earliest; a row delivered twice changes nothing.
    """
    out = layered(cells(rated(reports, trust)))
    cols = [F.col("fingerprint")]
    for i, f in enumerate(FIELDS):
        best = F.array_max(F.transform(F.filter("cells", _has(i, "c")), _by_policy(f)))
        cols += [best["v"].alias(f), (-best["i"]).alias(f"{f}_report_id"), (-best["l"]).alias(f"{f}_layer")]
    return out.select(*cols)


def found(reports: DataFrame, trust: DataFrame) -> DataFrame:
    """The rows of TESTDATA.md's p6_found.

    For each field, the reports with a usable value are put into dominance layers over recency
    and trust. The policy's choice from the first layer is a case if the whole layer lies at its
    point: then no report is later and none ranks above. Reports that tie with it in both are
    cases too. The layers come from the cells; the exact check joins back to the reports at the
    chosen point (the join key holds the point, so no large group meets one task).
    """
    r = rated(reports, trust)
    g = field_layers(cells(r)).filter(F.col("lo") != F.col("hi"))
    points = []
    for i, f in enumerate(FIELDS):
        top = F.filter(f, lambda x: x["layer"] == 1)
        best = F.array_max(F.transform(top, _by_policy()))
        alone = F.forall(top, _at(best["a"], best["r"]))
        points.append(F.when((F.size(top) > 0) & alone, F.struct(F.lit(f).alias("field_name"), F.lit(i).alias("bit"), best["a"].alias("at"), best["r"].alias("rank"))))
    p = g.select("fingerprint", F.explode(F.array_compact(F.array(*points))).alias("p")).select("fingerprint", "p.*")
    at = F.coalesce("reported_at", F.timestamp_seconds(F.lit(-62_135_596_800)))
    rows = r.select("fingerprint", "report_id", "rank", "mask", at.alias("at"))
    return rows.join(p, ["fingerprint", "at", "rank"]).filter(F.expr("getbit(mask, bit) = 1")).select("fingerprint", "field_name", "report_id").distinct()
