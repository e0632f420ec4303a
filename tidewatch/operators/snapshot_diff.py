"""What changed between full snapshots.

Snapshots are compared pairwise (a snapshot with the one before it in its series).
The plan is EXCEPT ALL both ways followed by a full join of the residues by key:

* ``bag_difference`` gives both EXCEPT ALL directions in one aggregation: every row
  counts +1 on the current and -1 on the previous side, rows whose sum is 0 vanish.
  (Catalyst rewrites one EXCEPT ALL into the same signed count; doing both directions
  at once halves the shuffles.)
* the two residues, now only the differing rows, are full-joined by key: a key with
  both sides is a change, one with one side an addition or removal.

All exchanges are on the record key inside a pair, never on the snapshot alone, so one
snapshot or series that holds a third of all rows spreads over all tasks; the rows reach
their pair by an equi join on the snapshot id that the planner may broadcast only below
its own size threshold and that AQE splits when one snapshot is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import folded, root_path, start_line, trimmed


def previous_in_series(df: DataFrame, series: Sequence[str], order: str, item: str, out: str = "prev") -> DataFrame:
    """Add the item before each row in its series (by ``order``, then ``item``).

    Two levels, so that a series with a third of all rows is no single task: lag inside
    (series, month), and for the first row of a month the last row of the latest earlier
    month, found over one pre-aggregated row per month. Null ``order`` sorts first.
    """
    month = "__month"
    df = df.withColumn(month, F.date_trunc("month", order))
    key = F.struct(F.col(order).alias("o"), F.col(item).alias("i"))
    within = W.partitionBy(*series, month).orderBy(F.col(order), F.col(item))
    months = df.groupBy(*series, month).agg(F.max(key).alias("__last"))
    months = months.withColumn("__carry", F.lag("__last.i").over(W.partitionBy(*series).orderBy(month))).drop("__last")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*series, month)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return (
        df.withColumn("__lag", F.lag(item).over(within))
        .withColumn("__first", F.row_number().over(within) == 1)
        .alias("a")
        .join(months.alias("b"), cond, "left")
        .select("a.*", F.when(F.col("a.__first"), F.col("b.__carry")).otherwise(F.col("a.__lag")).alias(out))
        .drop("__lag", "__first", month)
    )


def bag_difference(rows: DataFrame, columns: Sequence[str], side: str, out: str = "copies") -> DataFrame:
    """EXCEPT ALL both ways. ``side`` holds +1 (current) or -1 (previous).

    Result: one row for each distinct row of ``columns`` whose count differs, with the
    signed surplus in ``out`` (> 0: current EXCEPT ALL previous). Nulls are equal.
    """
    return rows.groupBy(*columns).agg(F.sum(side).alias(out)).filter(F.col(out) != 0)


def label_changes(residue: DataFrame, key: Sequence[str], content: Sequence[str], copies: str = "copies", null_keys: bool = True) -> DataFrame:
    """Full join of the two residues by ``key``: kind is new, fixed or changed.

    Null keys are equal; where the key has none, ``null_keys=False`` lets the join keep the
    residue's partitioning.

    ``content`` of either side comes out as ``new_*`` and ``old_*``.
    """
    cur = residue.filter(F.col(copies) > 0).select(*key, *[F.col(c).alias(f"new_{c}") for c in content], F.lit(True).alias("__cur"))
    prev = residue.filter(F.col(copies) < 0).select(*[F.col(k).alias(f"__{k}") for k in key], *[F.col(c).alias(f"old_{c}") for c in content], F.lit(True).alias("__prev"))
    same = [cur[k].eqNullSafe(prev[f"__{k}"]) if null_keys else cur[k] == prev[f"__{k}"] for k in key]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    kind = F.when(F.col("__prev").isNull(), "new").when(F.col("__cur").isNull(), "fixed").otherwise("changed")
    return cur.join(prev, cond, "full").select(
        *[F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in key],
        kind.alias("change_kind"),
        *[F.col(f"new_{c}") for c in content],
        *[F.col(f"old_{c}") for c in content],
    )


CONTENT = ("severity", "status", "ai_validated", "remediation")


def counting_scans(scans: DataFrame) -> DataFrame:
    """Scans whose last row by ``updated_at`` is completed, each with the counting scan before it.

    Columns: scan_id, target, branch, created_at, prev_scan_id. Repeated rows collapse;
    a null ``updated_at`` loses against any other; scans without id are left out.
    """
    last = F.max_by(F.struct("status", "target", "branch", "created_at"), F.struct(F.col("updated_at"), F.col("status")))
    latest = scans.filter(F.col("scan_id").isNotNull()).groupBy("scan_id").agg(last.alias("s")).select("scan_id", "s.*")
    done = latest.filter(folded(F.col("status")) == "completed").drop("status")
    return previous_in_series(done, ["target", "branch"], "created_at", "scan_id", "prev_scan_id")


def finding_changes(scans: DataFrame, findings: DataFrame, phase: str = "final") -> DataFrame:
    """New, fixed and changed findings of each counting scan against the one before it.

    A finding is (rule_id, path, start line); rows without rule_id or file_path (null or
    blank) do not take part; rows of one identity in a scan are one finding, of which the
    row with the highest db_id gives the content. Content is compared without case and
    outer blanks, null equals empty, status open equals empty. Persisting findings without
    a difference do not come out. Empty tables give an
    empty result; extra columns are ignored.
    """
    return _labelled(_bag(scans, findings, phase))


def _pairs(scans: DataFrame) -> DataFrame:
    """scan_id -> the scan before and after it, and a number of its series."""
    s = counting_scans(scans)
    after = s.filter(F.col("prev_scan_id").isNotNull()).select(F.col("prev_scan_id").alias("scan_id"), F.col("scan_id").alias("next_scan_id"))
    return s.select("scan_id", "prev_scan_id", F.xxhash64("target", "branch").alias("series")).join(after, "scan_id", "left")


def _content(c: str) -> Column:
    v = folded(F.col(c))
    return (F.when(v == "open", "").otherwise(v) if c == "status" else v).alias(c)


KEY = ("series", "rule_id", "path", "line", "pair_prev", "pair_scan")


def _bag(scans: DataFrame, findings: DataFrame, phase: str) -> DataFrame:
    f = findings.filter((folded(F.col("phase")) == phase) & F.col("scan_id").isNotNull()).select(
        "scan_id",
        "db_id",
        trimmed(F.col("rule_id")).alias("rule_id"),
        root_path(F.col("file_path")).alias("path"),
        start_line(F.col("line_number")).alias("line"),
        F.struct(*[_content(c) for c in CONTENT]).alias("content"),
    )
    f = f.filter((F.col("rule_id") != "") & (F.col("path") != ""))
    # Exchanged once, by identity inside the series; everything below keeps that partitioning: the
    # split into pairs, one finding for each identity, the bag difference and the full join.
    placed = f.join(_pairs(scans), "scan_id").repartition("series", "rule_id", "path", "line")

    def side(sign: int, prev: str, cur: str) -> Column:
        return F.when(F.col("prev_scan_id" if sign > 0 else "next_scan_id").isNotNull(), F.struct(F.lit(sign).alias("side"), F.col(prev).alias("pair_prev"), F.col(cur).alias("pair_scan")))

    sides = F.array_compact(F.array(side(1, "prev_scan_id", "scan_id"), side(-1, "scan_id", "next_scan_id")))
    rows = placed.select("series", "rule_id", "path", "line", "db_id", "content", F.inline(sides))
    one = rows.groupBy(*KEY, "side").agg(F.max(F.struct("db_id", "content")).alias("x"))
    return bag_difference(one.select(*KEY, "side", F.col("x.content").alias("content")), [*KEY, "content"], "side")


def _labelled(residue: DataFrame) -> DataFrame:
    return label_changes(residue, KEY, ["content"], null_keys=False)


def found(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """The rows of TESTDATA.md's p1_found."""
    return finding_changes(scans, findings).select(
        F.col("pair_prev").alias("prev_scan_id"),
        F.col("pair_scan").alias("scan_id"),
        "rule_id",
        F.col("path").alias("file_path"),
        F.col("line").alias("start_line"),
        "change_kind",
    )


def change_summary(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Number of new, fixed and changed findings of each compared scan (0 where nothing changed)."""
    kinds = ("new", "fixed", "changed")
    n = found(scans, findings).groupBy("scan_id").agg(*[F.count_if(F.col("change_kind") == k).alias(k) for k in kinds])
    base = counting_scans(scans).filter(F.col("prev_scan_id").isNotNull()).select("scan_id", "prev_scan_id", "target", "branch")
    return base.join(n, "scan_id", "left").select("target", "branch", "prev_scan_id", "scan_id", *[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(f"{k}_findings") for k in kinds])
