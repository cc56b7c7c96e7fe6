"""Text formatting of numbers for insights and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlight.functions.numeric import round_half_up


def money_whole(x: Column) -> Column:
    """``$12,345`` (thousands separators, no decimals)."""
    return F.concat(F.lit("$"), F.format_number(round_half_up(x, 0), 0))


def money_short(x: Column) -> Column:
    """Short money label: ``$1.23M`` at or above a million, ``$4.5k`` at or
    above a thousand, else ``$12``."""
    v = x.cast("double")
    return (F.when(v >= 1_000_000, F.format_string("$%.2fM", round_half_up(v / 1_000_000, 2)))
             .when(v >= 1_000, F.format_string("$%.1fk", round_half_up(v / 1_000, 1)))
             .otherwise(F.format_string("$%.0f", round_half_up(v, 0))))
