"""Rows that fail to parse: load the valid lines, keep the others apart with the first reason that applies.

Lines are read permissively under an explicit two-column schema, the raw text of rows that do not fit kept in a
corrupt column; those rows, and the rows that fit by luck, are then classified by quoting, count and cast checks.
Separators are counted beforehand, so that a line of very many fields is not parsed at all.
All of it is one pass of built-in expressions: no shuffle, nothing sent to Python, so a hot source file costs
nothing more than its own lines.

Edge cases: a null line counts as empty (neither loaded nor failed); a line of any length is handled in linear
time; repeated lines give repeated rows; an empty table gives an empty one; further columns of the input pass
through untouched unless their name is one of the columns this module adds, which are then replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.functions.addresses import is_ipv4

# The separator put between fields, and what a name has to look like.
SEP = "\x01"
NAME = r"^(?=.{1,254}$)(?:[A-Za-z0-9_](?:[A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?\.)+(?![0-9]+\.?$)[A-Za-z0-9_](?:[A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?\.?$"
SCHEMA = "left_field STRING, right_field STRING, corrupt STRING"
REASONS = ("quoting", "columns", "ip", "dns")
PARSED_FIELDS = 16  # lines with more fields have the wrong number of them; the parser, which has a buffer a field, is spared those


def is_name(name: Column) -> Column:
    """At least two labels, at most 253 characters besides one closing dot, the last label not all digits."""
    bare = F.regexp_replace(name, r"\.$", "")
    return F.coalesce(name.rlike(NAME) & (F.length(bare) <= 253), F.lit(False))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row. A filter on a plain column would be pushed below the steps it is
    made of and repeat them all; nothing is pushed below a generator."""
    return rows.withColumn(name, F.explode(F.array(value)))


def _separated(line: Column) -> Column:
    """The line with every field separator outside double quotes replaced by SEP."""
    parts = F.split(line, '"')
    outside = F.filter(parts, lambda x, i: i % 2 == 0)
    commas = F.exists(outside, lambda x: F.contains(x, F.lit(",")))
    by_comma = F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, ",", SEP)).otherwise(x))
    by_blank = F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, r"[ \t]+", SEP)).otherwise(x))
    return F.array_join(F.when(commas, by_comma).otherwise(by_blank), '"')


def read_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``ip``, ``dns`` and ``reason`` to every line that is neither empty nor a comment.

    ``reason`` is null for a valid line, which then has both fields; otherwise it is one of REASONS, ``ip`` and
    ``dns`` are null, and the raw text stays in the line column.
    """
    rows = lines.drop("ip", "dns", "reason")
    rows = _once(rows, "_bare", F.btrim(F.col(line), F.lit(" \t"))).filter((F.col("_bare") != "") & ~F.startswith(F.col("_bare"), F.lit("#")))
    even = F.length(F.regexp_replace("_bare", '[^"]', "")) % 2 == 0
    # A control character of the separator's value inside a line cannot be part of a valid field.
    rows = _once(rows, "_line", F.struct(even.alias("even"), F.regexp_replace("_bare", "[\x01\r\n]", "\x02").alias("safe")))
    rows = _once(rows, "_text", F.when(F.col("_line.even"), _separated(F.col("_line.safe"))).otherwise(F.col("_line.safe")))
    options = {"sep": SEP, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "quote": "", "maxCharsPerColumn": "-1", "maxColumns": str(PARSED_FIELDS), "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": "\x03"}
    # Quoting is judged on the raw fields: a corrupt row may have any number of them.
    rows = _once(rows, "_fields", F.transform(F.split("_text", SEP), lambda x: F.btrim(x, F.lit(" \t"))))
    rows = _once(rows, "_read", F.from_csv(F.when(F.size("_fields") <= PARSED_FIELDS, F.col("_text")), F.lit(SCHEMA), options))

    quoting = ~F.col("_line.even") | F.exists("_fields", lambda x: F.contains(x, F.lit('"')) & ~x.rlike(r'(?s)^"[^"]*"$'))
    columns = F.col("_read.corrupt").isNotNull() | (F.size("_fields") != 2)

    def value(name: str) -> Column:
        field = F.btrim(F.coalesce(F.col(f"_read.{name}"), F.lit("")), F.lit(" \t"))
        return F.btrim(F.regexp_replace(field, r'(?s)^"([^"]*)"$', "$1"), F.lit(" \t"))

    rows = _once(rows, "_pair", F.struct(value("left_field").alias("left"), value("right_field").alias("right")))
    rows = _once(rows, "_ips", F.struct(is_ipv4(F.col("_pair.left")).alias("left"), is_ipv4(F.col("_pair.right")).alias("right")))
    name = F.when(F.col("_ips.left"), F.col("_pair.right")).otherwise(F.col("_pair.left"))
    why = F.when(quoting, "quoting").when(columns, "columns").when(~F.col("_ips.left") & ~F.col("_ips.right"), "ip").when(~is_name(name), "dns")
    rows = _once(rows, "reason", why)
    good = F.col("reason").isNull()
    ip = F.when(F.col("_ips.left"), F.col("_pair.left")).otherwise(F.col("_pair.right"))
    return rows.withColumns({"ip": F.when(good, ip), "dns": F.when(good, name)}).drop("_bare", "_line", "_text", "_read", "_fields", "_pair", "_ips")


def valid_pairs(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines that load, with ``ip`` and ``dns``."""
    return read_lines(lines, line).filter(F.col("reason").isNull()).drop("reason")


def failed_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines that fail, raw text kept, with the first ``reason`` that applies."""
    return read_lines(lines, line).filter(F.col("reason").isNotNull()).drop("ip", "dns")
