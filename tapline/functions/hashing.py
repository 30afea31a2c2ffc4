"""FNV-1a with 64 bits in plain SQL expressions, so that no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a 64: offset basis 14695981039346656037, prime 1099511628211 = 2**40 + 435.
BASIS_HIGH, BASIS_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
MASK = 0xFFFFFFFF


def fnv64(text: Column) -> Column:
    """The hash of the text's UTF-8 bytes as a signed BIGINT.

    The state is kept as two halves of 32 bits: products of a half and 435 stay far below 2**63, and the prime's
    upper part only moves the lower half up by 40 bits, so nothing overflows under ANSI rules.
    """
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint"))
    start = F.struct(F.lit(BASIS_HIGH).cast("bigint").alias("h"), F.lit(BASIS_LOW).cast("bigint").alias("l"))

    def step(s: Column, byte: Column) -> Column:
        low = s["l"].bitwiseXOR(byte)
        product = low * PRIME_LOW
        high = s["h"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("h"), product.bitwiseAND(F.lit(MASK)).alias("l"))

    def signed(s: Column) -> Column:
        return F.shiftleft(s["h"], 32).bitwiseOR(s["l"])

    return F.aggregate(codes, start, step, signed)
