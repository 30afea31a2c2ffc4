"""Evidence bits, the labels made of them, and the ranks of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence bits in label order.
DNS, SNI, ACTIVE, CSV, CONN, OBSERVED = 1, 2, 4, 8, 16, 32
TOKENS = ((DNS, "dns"), (SNI, "sni"), (ACTIVE, "active"), (CSV, "csv"), (CONN, "conn"), (OBSERVED, "synack"))
STRONG = DNS | SNI | ACTIVE | CSV
# Ranks of source labels when rows are folded, and when recorded names are searched again.
SOURCE_RANK = {30: ("dns+synack", "dns+conn+synack", "sni+synack", "sni+conn+synack", "active+synack", "active+conn+synack"), 20: ("csv+conn", "csv+mid"), 10: ("mid-session",), 0: ("",)}
OTHER_RANK = 15
RECOVERY_RANK = {"dns+synack": 100, "dns+conn+synack": 90, "sni+synack": 80, "sni+conn+synack": 70, "active+synack": 60, "active+conn+synack": 50, "csv+conn": 40, "csv+mid": 30, "mid-session": 20, "": 0}
OTHER_RECOVERY_RANK = 10


def has(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask)) == mask


def label(bits: Column) -> Column:
    """Tokens of the bits that are set, joined by ``+``; empty for none."""
    return F.concat_ws("+", *[F.when(bits.bitwiseAND(F.lit(bit)) != 0, token) for bit, token in TOKENS])


def normalised(bits: Column) -> Column:
    """Without the inferred bit where something stronger is known."""
    return F.when(bits.bitwiseAND(F.lit(STRONG)) != 0, bits.bitwiseAND(F.lit(~CONN))).otherwise(bits)


def source_rank(source: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    rank = F.lit(OTHER_RANK)
    for value, labels in SOURCE_RANK.items():
        rank = F.when(s.isin(*labels), value).otherwise(rank)
    return rank


def recovery_rank(source: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    rank = F.lit(OTHER_RECOVERY_RANK)
    for labelled, value in RECOVERY_RANK.items():
        rank = F.when(s == labelled, value).otherwise(rank)
    return rank
