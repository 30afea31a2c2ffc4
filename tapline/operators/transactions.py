"""DNS transactions: answers matched to queries, files merged, names from client hellos added.

Edge cases: queries without a name are dropped; answers without id or addresses match nothing; of queries at the
same time the later packet is taken; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.functions import evidence as ev
from tapline.functions.names import looks_like_time_server

KEY = ["file_idx", "issuer_ip", "src_port", "resolver_ip", "proto", "dns_id"]


def matched(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """(response_id, query_id): each response with the latest earlier query of its key, one with its name first.

    Queries have KEY, ts_ns, pkt_idx, query_id, name; responses KEY as seen from the query, ts_ns, pkt_idx,
    response_id, name. One sort per key carries the last query on, so retransmissions are not multiplied.
    """
    asked = queries.filter("name <> ''").select(*KEY, "ts_ns", "pkt_idx", "name", F.col("query_id").alias("q"), F.lit(None).cast("bigint").alias("r"))
    told = responses.filter("dns_id <> 0").select(*KEY, "ts_ns", "pkt_idx", F.coalesce("name", F.lit("")).alias("name"), F.lit(None).cast("bigint").alias("q"), F.col("response_id").alias("r"))
    rows = asked.unionByName(told)
    before = lambda *more: Window.partitionBy(*KEY, *more).orderBy("ts_ns", "pkt_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"same": F.last("q", ignorenulls=True).over(before("name")), "any": F.last("q", ignorenulls=True).over(before())})
    best = F.when(F.col("name") == "", F.col("any")).otherwise(F.coalesce("same", "any"))
    return rows.filter("r is not null").select(F.col("r").alias("response_id"), best.alias("query_id")).filter("query_id is not null")


def answer_evidence(matches: DataFrame, answers: DataFrame) -> DataFrame:
    """(tx_id, ip, ord, evidence) from the answers (response_id, ord, ip) of matched responses."""
    rows = matches.join(answers.filter("ip is not null"), "response_id")
    return rows.groupBy(F.col("query_id").alias("tx_id"), "ip").agg(F.min(F.struct("response_id", "ord")).alias("o"), F.bit_or(F.lit(ev.DNS)).alias("evidence")).select("tx_id", "ip", F.col("o.ord").alias("ord"), "evidence")


def merged(transactions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and request time over all files: first file, first known evidence, first resolver."""
    known = F.when(F.coalesce("name_evidence", F.lit(0)) != 0, F.struct("file_idx", "tx_id", "name_evidence"))
    resolver = F.when(F.col("resolver_ip").isNotNull(), F.struct("file_idx", "tx_id", "resolver_ip"))
    rows = transactions.groupBy(*keys, "req_ts_ns").agg(F.min("tx_id").alias("tx_id"), F.min(F.struct("file_idx", "pcap_file")).alias("f"), F.min(known).alias("n"), F.min(resolver).alias("r"), F.count(F.lit(1)).alias("copies"))
    return rows.select("tx_id", *keys, "req_ts_ns", F.col("f.pcap_file").alias("pcap_file"), F.coalesce("n.name_evidence", F.lit(0)).alias("name_evidence"), F.col("r.resolver_ip").alias("resolver_ip"), "copies")


def hello_transactions(hellos: DataFrame, compat_blank: bool = False) -> DataFrame:
    """Names from client hellos as transactions: the first of each issuer, destination, port and name.

    They carry the evidence of a hello and an observed contact unless ``compat_blank`` asks for none.
    """
    first = F.min(F.struct("file_idx", "pkt_idx", "ts_ns", "pcap_file")).alias("f")
    rows = hellos.filter("sni <> '' and port <> 0").groupBy("issuer_ip", "dst_ip", "port", "sni").agg(first)
    bits = 0 if compat_blank else ev.SNI | ev.OBSERVED
    return rows.select("issuer_ip", "dst_ip", "port", F.col("sni").alias("dns_name"), F.col("f.ts_ns").alias("req_ts_ns"), "f.pcap_file", F.lit(0 if compat_blank else ev.SNI).alias("name_evidence"), F.lit(bits).alias("evidence"))


def _is_time_server() -> Column:
    sni = F.coalesce(F.col("name_evidence").bitwiseAND(F.lit(ev.SNI)) != 0, F.lit(False))
    return ~sni & looks_like_time_server(F.col("dns_name"))


def without_time_servers(transactions: DataFrame) -> DataFrame:
    return transactions.filter(~_is_time_server())


def time_servers(transactions: DataFrame) -> DataFrame:
    """What ``without_time_servers`` leaves out, to be counted."""
    return transactions.filter(_is_time_server())
