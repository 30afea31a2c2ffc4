"""Reading what earlier runs left behind: the main table, unresolved addresses, and map files.

Edge cases: lines that are no table rows are skipped; stacked addresses belong to the name above them in the same
file; a folder without files gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapline.functions.addresses import BLANKS, canonical_ipv4
from tapline.functions.names import canonical_name


def _run(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files; each file is read as one piece so that lines keep their order."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("line_no", "line"))


def recorded(spark: SparkSession, root: str) -> DataFrame:
    """(run, ip, dns, source, seq) of all main tables below a folder."""
    rows = numbered_lines(spark, root).filter("file like '%/dns-table.txt' and startswith(line, '| ') and not startswith(line, '| Request Time')")
    cell = lambda k: F.btrim(F.split_part("line", F.lit("|"), F.lit(k)), F.lit(BLANKS))
    rows = rows.select(_run(F.col("file")).alias("run"), "line_no", F.nullif(cell(4), F.lit("")).alias("own"), cell(5).alias("cell_ip"), cell(6).alias("source"))
    above = Window.partitionBy("run").orderBy("line_no")
    rows = rows.withColumn("dns", F.last("own", ignorenulls=True).over(above)).withColumn("ip", canonical_ipv4(F.col("cell_ip")))
    return rows.filter("ip is not null and dns is not null").select("run", "ip", canonical_name(F.col("dns")).alias("dns"), "source", F.col("line_no").cast("bigint").alias("seq"))


def unresolved(spark: SparkSession, root: str) -> DataFrame:
    """(run, ip) of all lists of unresolved addresses below a folder."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "unresolved-ip.json").schema("ip string, port int, proto string, count bigint").json(root)
    return rows.select(_run(F.input_file_name()).alias("run"), canonical_ipv4(F.col("ip")).alias("ip")).filter("ip is not null")


def map_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, line) of map files, in file and line order."""
    rows = numbered_lines(spark, path)
    return rows.select(F.struct("file", "line_no").alias("line_id"), "line")
