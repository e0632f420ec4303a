"""Stored findings: schema versions, and scans kept as partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that each version of the stored table added, with their types; version 1 is the table as first written.
VERSIONS = (
    (1, "scan_id string, phase string, db_id long, issue_name string, file_path string, description string, severity string, line_number string"),
    (2, "ai_validated string, remediation string, rule_id string, source string, cwe string, owasp string, confidence double"),
    (3, "code_snippet string, ai_reasoning string, exploit_path array<string>, trust_score double, exploit_poc string, fixed_code string, vulnerable_pattern string, status string"),
)


def upgraded(rows: DataFrame) -> DataFrame:
    """Rows of any version with all columns of the newest one: missing ones are null, others stay behind them."""
    columns = [c.strip().split(" ", 1) for _, cols in VERSIONS for c in cols.split(",")]
    own = set(rows.columns)
    known = [(F.col(n) if n in own else F.lit(None)).cast(t).alias(n) for n, t in columns]
    return rows.select(*known, *[c for c in rows.columns if c not in {n for n, _ in columns}])


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, partitions of different versions side by side."""
    return upgraded(spark.read.option("mergeSchema", True).parquet(path))


def replace_scans(rows: DataFrame, path: str) -> None:
    """Replace the (scan_id, phase) partitions present in ``rows``, others stay (dynamic overwrite)."""
    upgraded(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id", "phase").parquet(path)


def delete_scans(spark: SparkSession, path: str, scan_ids: list[str]) -> None:
    """Remove the partitions of scans; ids without a partition are passed over."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i in scan_ids:
        fs.delete(hadoop.Path(root, f"scan_id={i}"), True)
