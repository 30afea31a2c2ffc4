"""FTP control lines: the port a passive reply announces, as a Column and for single payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapline.functions.addresses import BLANKS

CONTROL_PORTS = (21, 990)  # fixed values: ports of control sessions


def is_passive_command(line: Column) -> Column:
    return F.coalesce(F.upper(F.btrim(line, F.lit(BLANKS))).rlike("^(PASV|EPSV)"), F.lit(False))


# A 227 reply ends in the port's two bytes after at least four more fields; of a 229 reply the last number counts.
REPLY_227 = r"^227[^(]*\((?:[^,)]*,){4,}\s*\+?([0-9]{1,3})\s*,\s*\+?([0-9]{1,3})\s*(?:\)|$)"
REPLY_229 = r"^229[^(]*\((?:[^)]*[^0-9)])?([0-9]{1,9})[^0-9)]*(?:\)|$)"


def passive_port(line: Column) -> Column:
    """Port of a 227 or 229 reply, null for any other line or a port outside 1 to 65535."""
    text = F.btrim(line, F.lit(BLANKS))
    byte = lambda k: F.nullif(F.regexp_extract(text, REPLY_227, k), F.lit("")).cast("int")
    brief = F.transform(F.array(F.struct(byte(1).alias("h"), byte(2).alias("l"))), lambda x: F.when((x["h"] <= 255) & (x["l"] <= 255), x["h"] * 256 + x["l"]))[0]
    extended = F.nullif(F.regexp_extract(text, REPLY_229, 1), F.lit("")).cast("int")
    return F.try_element_at(F.filter(F.array(brief, extended), lambda x: x.between(1, 65535)), F.lit(1))
