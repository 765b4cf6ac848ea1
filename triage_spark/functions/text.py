"""Text and number formatting expressions (SCL-8..11, SCL-22, SCL-24, SCL-30).

Money and confidence stay decimals end to end, so ``%.2f`` / ``%.3f`` print
the exact stored digits (no binary-float half-even surprises).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .rules import col


def fixed(c: str | Column, digits: int) -> Column:
    """Python ``:.Nf`` on a decimal: round half up to N places, plain digits."""
    return col(c).cast(f"decimal(38,{digits})").cast("string")


def grouped(c: str | Column, digits: int = 2) -> Column:
    """Python ``:,.Nf``: thousands separators, N decimals."""
    return F.format_number(col(c), digits)


def percent_text(fraction: str | Column) -> Column:
    """SCL-24: ``(x*100).toFixed(1) + '%'`` on a 0..1 decimal."""
    return F.concat(fixed(col(fraction) * 100, 1), F.lit("%"))


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970-01-01 of a wall-clock (NTZ) time, independent of the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts).cast("timestamp_ntz"))


def epoch_micros(ts: str | Column) -> Column:
    return F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts).cast("timestamp_ntz")
    )


def confirmation_id(ts: str | Column) -> Column:
    """SCL-22: ``TIER-CHG-<epoch seconds>`` from the ticket's own event time."""
    return F.concat(F.lit("TIER-CHG-"), epoch_seconds(ts).cast("string"))


def effective_date(ts: str | Column) -> Column:
    """SCL-22: ``%Y-%m-%d`` of the ticket's event time."""
    return F.date_format(col(ts), "yyyy-MM-dd")


def gate_message(confidence: str | Column, threshold: Column) -> Column:
    """SCL-8: the decision text, with ``.3f`` confidence and ``.2f`` threshold."""
    c = col(confidence)
    return F.when(c < threshold, F.format_string(C.TPL_GATE_ESCALATE, fixed(c, 3), fixed(threshold, 2))).otherwise(
        F.format_string(C.TPL_GATE_RESOLVE, fixed(c, 3), fixed(threshold, 2))
    )
