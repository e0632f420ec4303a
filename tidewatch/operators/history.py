"""Scan history, triage and learned filters: latest-wins views, two kinds of scan diff, accuracy and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import folded
from tidewatch.operators.snapshot_diff import counting_scans

MIN_SIMILAR = 3
FP_THRESHOLD = 0.8
MIN_ASSESSED = 5


def latest_scans(scans: DataFrame) -> DataFrame:
    """One row a scan: its last row by updated_at (then status), with the number of status events."""
    last = F.max_by(F.struct("status", "target", "branch", "created_at", "completed_at", "total_findings", "critical_count", "high_count"), F.struct("updated_at", "status"))
    return scans.filter(F.col("scan_id").isNotNull()).groupBy("scan_id").agg(last.alias("s"), F.count_distinct("status", "updated_at").alias("n_events")).select("scan_id", "s.*", "n_events")


def trend(scans: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` completed scans by created_at: total and critical + high."""
    x = latest_scans(scans).filter(folded(F.col("status")) == "completed").orderBy(F.desc("created_at"), "scan_id").limit(n)
    return x.select("scan_id", "created_at", F.coalesce("total_findings", F.lit(0)).alias("total"), (F.coalesce("critical_count", F.lit(0)) + F.coalesce("high_count", F.lit(0))).alias("severe"))


def latest_status(reports: DataFrame) -> DataFrame:
    """Triage state of a fingerprint: the status of its latest report that states one."""
    s = folded(F.col("status"))
    r = reports.filter(F.col("fingerprint").isNotNull() & (s != "")).withColumn("s", s)
    return r.groupBy("fingerprint").agg(F.max_by("s", F.struct("reported_at", "report_id")).alias("status"), F.max("reported_at").alias("since"))


def _sides(scans: DataFrame, records: DataFrame, key: Column) -> DataFrame:
    """(pair, key, rows on the previous side, rows on the current side): one exchange by pair and key."""
    s = counting_scans(scans).filter(F.col("prev_scan_id").isNotNull()).select(F.col("prev_scan_id").alias("a"), F.col("scan_id").alias("b"))
    both = F.inline(F.array(F.struct(F.col("b").alias("scan_id"), F.lit(1).alias("cur"), F.lit(0).alias("prev")), F.struct(F.col("a").alias("scan_id"), F.lit(0).alias("cur"), F.lit(1).alias("prev"))))
    x = records.withColumn("key", key).select("scan_id", "key").join(s.select("a", "b", both), "scan_id")
    return x.groupBy("a", "b", "key").agg(F.sum("prev").alias("prev"), F.sum("cur").alias("cur"))


def diff_keyed(scans: DataFrame, records: DataFrame) -> DataFrame:
    """Consecutive scans by rule, path and line: distinct keys new, fixed, persisting; totals count all rows."""
    k = _sides(scans, records, F.concat_ws("|", "rule_id", "file_path", F.col("line").cast("string")))
    g = k.groupBy("a", "b").agg(
        F.count_if((F.col("prev") == 0)).alias("new_keys"), F.count_if(F.col("cur") == 0).alias("fixed_keys"), F.count_if((F.col("cur") > 0) & (F.col("prev") > 0)).alias("persisting_keys"),
        F.sum("prev").alias("total_a"), F.sum("cur").alias("total_b"),
    )
    return g.withColumn("delta", F.col("total_b") - F.col("total_a"))


def diff_fingerprint(scans: DataFrame, records: DataFrame) -> DataFrame:
    """Consecutive scans by lower-case path and name, as bags: every row counts."""
    k = _sides(scans, records, F.concat_ws("|", F.lower("file_path"), F.lower("issue_name")))
    g = k.groupBy("a", "b").agg(
        F.sum(F.when(F.col("prev") == 0, F.col("cur")).otherwise(0)).alias("new_rows"), F.sum(F.when(F.col("cur") == 0, F.col("prev")).otherwise(0)).alias("fixed_rows"), F.sum(F.when(F.col("prev") > 0, F.col("cur")).otherwise(0)).alias("persisting_rows")
    )
    return g.withColumn("delta", F.col("new_rows") - F.col("fixed_rows"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def fp_history(records: DataFrame) -> DataFrame:
    """rule_id, severity, ext, similar, fp_rate of triaged findings. A similarity above 0.8 holds exactly if these three agree."""
    t = records.filter(F.col("status").isin("false_positive", "resolved"))
    return t.groupBy("rule_id", "severity", extension(F.col("file_path")).alias("ext")).agg(F.count("*").alias("similar"), F.avg((F.col("status") == "false_positive").cast("double")).alias("fp_rate"))


def fp_filter(records: DataFrame, threshold: float = FP_THRESHOLD) -> DataFrame:
    """Open findings with their false-positive rate among at least three similar triaged ones, and whether they are dropped."""
    h = fp_history(records).filter(F.col("similar") >= MIN_SIMILAR)
    x = records.filter(F.col("status") == "open").withColumn("ext", extension(F.col("file_path"))).join(h, ["rule_id", "severity", "ext"], "left")
    rate = F.coalesce("fp_rate", F.lit(0.0))
    return x.select("db_id", F.round(rate, 6).alias("fp_rate"), (rate >= threshold).alias("dropped"))


def latest_validations(validations: DataFrame) -> DataFrame:
    """The last validation of each finding by created_at, then id."""
    v = validations.filter(F.col("finding_id").isNotNull())
    return v.groupBy("finding_id").agg(F.max(F.struct("created_at", "validation_id", "is_true_positive", "confidence", "severity_adjustment")).alias("v")).select("finding_id", "v.*")


def accuracy(records: DataFrame, validations: DataFrame) -> DataFrame:
    """severity, assessed, true_positives, false_positives, rate."""
    x = records.select("db_id", "severity").join(latest_validations(validations), F.col("db_id") == F.col("finding_id")).filter(F.col("is_true_positive").isNotNull())
    g = x.groupBy("severity").agg(F.count("*").alias("assessed"), F.count_if("is_true_positive").alias("true_positives"))
    return g.withColumn("false_positives", F.col("assessed") - F.col("true_positives")).withColumn("rate", F.round(F.col("true_positives") / F.col("assessed"), 6))


def calibrated(records: DataFrame, validations: DataFrame) -> DataFrame:
    """Confidence of AI-sourced or confirmed findings moved towards the accuracy of their severity (0.7 to 0.3, in 0.1..0.99)."""
    a = accuracy(records, validations).filter(F.col("assessed") >= MIN_ASSESSED).select("severity", (F.col("true_positives") / F.col("assessed")).alias("acc"))
    x = records.filter((F.col("confidence") > 0) & ((F.col("source") == "ai-discovery") | (F.col("ai_validated") == "Yes"))).join(a, "severity", "left")
    new = F.when(F.col("acc").isNull(), F.col("confidence")).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(0.99), 0.7 * F.col("confidence") + 0.3 * F.col("acc"))))
    return x.select("db_id", F.round(new, 6).alias("calibrated"))


def validated(records: DataFrame, validations: DataFrame) -> DataFrame:
    """Findings above low with their verdict applied: severity unless ``same``, confidence, marker; unanswered ones stay."""
    x = records.filter(~F.col("severity").isin("low", "info")).join(latest_validations(validations).withColumnRenamed("confidence", "v_confidence"), F.col("db_id") == F.col("finding_id"), "left")
    tp, adj = F.col("is_true_positive"), folded(F.col("severity_adjustment"))
    sev = F.when(tp & ~adj.isin("same", ""), adj).otherwise(F.col("severity"))
    mark = F.when(tp, "Yes").when(~tp, "No (False Positive)").otherwise(F.col("ai_validated"))
    conf = F.when(F.coalesce(tp, F.lit(False)) & (F.coalesce("v_confidence", F.lit(0.0)) > 0) & ~F.isnan(F.coalesce("v_confidence", F.lit(0.0))), F.col("v_confidence")).otherwise(F.col("confidence"))
    return x.select("db_id", sev.alias("severity"), mark.alias("ai_validated"), F.round(conf, 6).alias("confidence"))
