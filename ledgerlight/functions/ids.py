"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonym(raw_id, prefix: str = "CUST_", salt: str | None = None) -> Column:
    """``prefix`` + first 10 hex digits of SHA-256 of the id, upper case.

    This is a pseudonym, not anonymisation: without a salt the mapping can be
    rebuilt from the id space.  Pass ``salt`` to make it keyed.
    """
    src = F.col(raw_id) if isinstance(raw_id, str) else raw_id
    src = src.cast("string")
    if salt:
        src = F.concat(F.lit(salt), src)
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(src, 256), 1, 10)))


def padded_id(row_id, prefix: str = "TXN_SS_", width: int = 6) -> Column:
    """Zero-padded id; wider numbers are kept whole (``lpad`` would cut them)."""
    src = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.concat(F.lit(prefix), F.format_string(f"%0{width}d", src.cast("long")))
