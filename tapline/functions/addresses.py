"""IPv4 text: canonical forms, integer values and the three private/public predicates, which differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that surrounds fields, and the IPv4 pattern (no leading zeros).
BLANKS = " \t\r\n\x0b\x0c"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def plain_address(ip: Column) -> Column:
    """The address without blanks around it and without an IPv4-mapped prefix; null stays null."""
    bare = F.btrim(ip, F.lit(BLANKS))
    # Few addresses have the prefix, and the pattern costs more than a look at the first two characters.
    return F.when(F.startswith(bare, F.lit("::")), F.regexp_replace(bare, r"(?i)^::ffff:", "")).otherwise(bare)


def is_ipv4(ip: Column) -> Column:
    """True for four decimal numbers 0 to 255 without leading zeros, nothing around them."""
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def canonical_ipv4(ip: Column) -> Column:
    """IPv4 text without blanks and IPv4-mapped prefix, or null when it is not one (other IPv6 included)."""
    plain = plain_address(ip)
    return F.when(is_ipv4(plain), plain)


def ipv4_value(ip: Column) -> Column:
    """The address as BIGINT; null for anything but IPv4."""
    ok = canonical_ipv4(ip)
    part = [F.split_part(ok, F.lit("."), F.lit(i)).cast("bigint") for i in (1, 2, 3, 4)]
    return F.when(ok.isNotNull(), ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3])


# Address blocks (first three octets, prefix length), and the same as the beginnings of addresses.
RFC1918 = [(10, 0, 0, 8), (172, 16, 0, 12), (192, 168, 0, 16)]
SHARED = [(100, 64, 0, 10)]
SPECIAL = [(0, 0, 0, 8), (127, 0, 0, 8), (169, 254, 0, 16), (192, 0, 2, 24), (198, 51, 100, 24), (203, 0, 113, 24), (224, 0, 0, 4)]
RFC1918_START = r"10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\."
SHARED_START = r"100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."
SPECIAL_START = r"0\.|127\.|169\.254\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|2(?:2[4-9]|3[0-9])\."


def _starts(ip: Column, starts: str) -> Column:
    """Whether the text is an IPv4 address that begins so; one pattern, to keep generated code small."""
    return F.coalesce(plain_address(ip).rlike(rf"^(?={starts}){IPV4[1:]}"), F.lit(False))


def is_rfc1918(ip: Column) -> Column:
    """10/8, 172.16/12 and 192.168/16; the shared block 100.64/10 is not in it."""
    return _starts(ip, RFC1918_START)


def is_local(ip: Column) -> Column:
    """RFC 1918 or the carriers' shared block: the side of a flow that belongs to a subscriber."""
    return _starts(ip, f"{RFC1918_START}|{SHARED_START}")


def is_public(ip: Column) -> Column:
    """An IPv4 address outside every private, shared, special, documentation and multicast block."""
    return _starts(ip, f"(?!{RFC1918_START}|{SHARED_START}|{SPECIAL_START})")
