"""Subscriber and session identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def imsi15(imsi: Column) -> Column:
    """The 15 digits of an identity that may carry blanks, a NUL or a realm; null where there are none."""
    return F.nullif(F.regexp_extract(imsi, r"([0-9]{15})", 1), F.lit(""))


def canonical_imsi(imsi: Column) -> Column:
    """Trim NUL and blanks, cut the realm, keep digits; null unless 14 to 16 digits remain."""
    trimmed = F.regexp_replace(imsi, r"^[\x00\s]+|[\x00\s]+$", "")
    at = F.instr(trimmed, "@")
    bare = F.when(at > 1, F.substring_index(trimmed, "@", 1)).otherwise(trimmed)
    digits = F.regexp_replace(bare, "[^0-9]", "")
    return F.when(F.length(digits).between(14, 16), digits)


def same_sid(sid: Column) -> Column:
    """Session id for comparison: blanks and case ignored; null, empty and ``-`` are one value."""
    bare = F.lower(F.regexp_replace(F.coalesce(sid, F.lit("")), r"[\s\x00]+", ""))
    return F.when(bare == "", F.lit("-")).otherwise(bare)
