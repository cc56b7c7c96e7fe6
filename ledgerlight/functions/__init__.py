"""Column expressions built only from ``pyspark.sql.functions`` (JVM side, codegen)."""

from ledgerlight.functions.numeric import clip, round_half_up, safe_ratio, sample_std_or_zero
from ledgerlight.functions.ids import pseudonym, padded_id
from ledgerlight.functions.calendar import calendar_columns, days_to_quarter_end

__all__ = [
    "clip", "round_half_up", "safe_ratio", "sample_std_or_zero",
    "pseudonym", "padded_id", "calendar_columns", "days_to_quarter_end",
]
