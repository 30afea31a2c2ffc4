"""Host names: canonical forms and the tests by which names are judged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapline.functions.addresses import BLANKS

# Labels of time servers, and the prefixes that may carry a number or a suffix.
TIME_LABELS = ("ntp", "time", "timesync", "sntp", "ntpd", "chrony", "chronyd")
TIME_PREFIXES = ("ntp", "time", "timesync")
TIME_LABEL_PATTERN = f"^(?:{'|'.join(TIME_LABELS)}|(?:{'|'.join(TIME_PREFIXES)})(?:-.+|[0-9]+))$"
# Fixed value: a name that can be asked for: 1 to 63 characters a label, no dash at either end.
ASKABLE = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"


def _trim(name: Column) -> Column:
    return F.btrim(name, F.lit(BLANKS))


def canonical_name(name: Column) -> Column:
    """One closing dot off, then blanks, then lower case; so a dot before blanks stays."""
    return F.lower(_trim(F.regexp_replace(name, r"\.$", "")))


def canonical_name_trim_first(name: Column) -> Column:
    """Blanks off, then one closing dot, then lower case."""
    return F.lower(F.regexp_replace(_trim(name), r"\.$", ""))


def looks_resolvable(name: Column) -> Column:
    """Has a dot, no underscore, and is not a name of the local network."""
    n = canonical_name(name)
    return F.coalesce((n != "") & (n != "localhost") & ~n.rlike(r"\.(lan|local)$") & F.contains(n, F.lit(".")) & ~F.contains(n, F.lit("_")), F.lit(False))


def is_resolvable(name: Column) -> Column:
    """Strictly well-formed: letters, digits and inner dashes in two or more labels, at most 253 characters."""
    n = canonical_name(name)
    return F.coalesce((F.length(n) <= 253) & n.rlike(ASKABLE), F.lit(False))


def looks_like_time_server(name: Column) -> Column:
    """Names of time servers, by labels, indexed prefixes and telling words."""
    n = canonical_name(name)
    label = F.exists(F.split(n, r"\."), lambda x: x.rlike(TIME_LABEL_PATTERN))
    return F.coalesce((n != "") & (label | F.contains(n, F.lit("timesync")) | F.contains(n, F.lit("chrony"))), F.lit(False))


def name_suffix(name: Column) -> Column:
    """The last two labels in lower case, empty where there are fewer."""
    parts = F.split(F.lower(F.regexp_replace(name, r"\.$", "")), r"\.")
    return F.when(F.size(parts) < 2, "").otherwise(F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1)))
