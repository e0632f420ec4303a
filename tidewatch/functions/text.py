"""Scalar text functions as Columns (JVM side, inside whole-stage code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that do not matter at the outside of a value.
OUTER_BLANKS = " \t\n\r\f "


def trimmed(c: Column) -> Column:
    """``c`` without outer blanks; null stays null."""
    return F.btrim(c, F.lit(OUTER_BLANKS))


def folded(c: Column) -> Column:
    """Lower case without outer blanks, null as empty: for comparisons."""
    return F.coalesce(F.lower(trimmed(c)), F.lit(""))


def start_line(c: Column) -> Column:
    """Leading number of ``"42"``, ``"42-50"``, else 0; also 0 if it does not fit an int."""
    return F.coalesce(F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0))


def root_path(c: Column) -> Column:
    """Path as seen from the scan root: single forward slashes, no leading ``./`` or ``/``."""
    p = F.translate(trimmed(c), "\\", "/")
    p = F.regexp_replace(p, r"/(?:\.?/)+", "/")
    return F.regexp_replace(p, r"^(?:\./)*/?", "")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")
