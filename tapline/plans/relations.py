"""The relations operators work on, read from the tables: repeated rows folded, addresses in one form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions.addresses import canonical_ipv4, plain_address
from tapline.functions.names import canonical_name_trim_first
from tapline.functions.numbers import floor_div
from tapline.plans.tables import table


def transactions(spark: SparkSession, folder: str, columns: str = "") -> DataFrame:
    """Transactions with the columns named (all without), which are all that is read and shuffled."""
    rows = table(spark, folder, "dns_tx")
    rows = (rows.select(*columns.split()) if columns else rows).distinct()
    return rows.withColumns({c: plain_address(F.col(c)) for c in ("issuer_ip", "resolver_ip") if c in rows.columns})


def transaction_addresses(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dns_tx_ip").withColumn("ip", canonical_ipv4(F.col("ip"))).filter("ip is not null")
    return rows.groupBy("tx_id", "ip").agg(F.min("ord").cast("int").alias("ord"), F.bit_or("evidence").cast("int").alias("evidence"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "topology").select("row_ord", "issuer_ip", "destination_ip", "protocol", "port", "observed_ns").distinct()
    return rows.select(
        F.col("row_ord").alias("edge_ord"), floor_div(F.col("row_ord"), 400).cast("int").alias("file_idx"), plain_address(F.col("issuer_ip")).alias("issuer_ip"), canonical_ipv4(F.col("destination_ip")).alias("dst_ip"),
        F.lower("protocol").alias("proto"), "port", F.col("observed_ns").alias("first_seen_ns"),
    )


def topology(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "topology").drop("net_id").distinct()
    return rows.select(
        "row_ord", plain_address(F.col("issuer_ip")).alias("issuer_ip"), canonical_ipv4(F.col("destination_ip")).alias("destination_ip"), F.coalesce("dns_name", F.lit("")).alias("dns_name"),
        F.coalesce("dns_source", F.lit("")).alias("dns_source"), "protocol", "port", "observed_ns",
    )


def name_map(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ip_dns").select(canonical_ipv4(F.col("ip")).alias("ip"), canonical_name_trim_first(F.col("dns")).alias("dns"), "ord")
    return rows.filter("ip is not null and dns <> ''").groupBy("ip", "dns").agg(F.min("ord").alias("ord"))
