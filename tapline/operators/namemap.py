"""The map of addresses to names: reading, merging, learning, auditing and searching it.

Edge cases: lines and pairs without a valid address or with an empty name are left out; names are compared in
canonical form; repeated pairs count once, the first place is kept; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.functions import evidence as ev
from tapline.functions.addresses import BLANKS, canonical_ipv4, is_public, is_rfc1918
from tapline.functions.names import canonical_name

LEARNABLE = ev.DNS | ev.OBSERVED


def load(lines: DataFrame, place: Column) -> DataFrame:
    """(ip, dns, ord) of map lines: the first two fields by comma, else by white space; the left address wins.

    ``place`` orders lines; a pair keeps its first place. Lines that give no pair are skipped without a word; the
    operator for failing lines tells why.
    """
    text = F.lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    rows = lines.select(text.alias("t"), place.alias("ord")).filter("t <> '' and not startswith(t, '#')")
    parts = F.when(F.contains("t", F.lit(",")), F.split("t", ",")).otherwise(F.split("t", r"\s+"))
    rows = rows.withColumn("p", parts).filter("size(p) >= 2").select(F.btrim(F.col("p")[0], F.lit(BLANKS)).alias("a"), F.btrim(F.col("p")[1], F.lit(BLANKS)).alias("b"), "ord")
    left, right = canonical_ipv4(F.col("a")), canonical_ipv4(F.col("b"))
    rows = rows.select(F.coalesce(left, right).alias("ip"), canonical_name(F.when(left.isNotNull(), F.col("b")).otherwise(F.col("a"))).alias("dns"), "ord")
    return rows.filter("ip is not null and dns <> ''").groupBy("ip", "dns").agg(F.min("ord").alias("ord"))


def sortable(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines ``dns,ip`` of a map as distinct pairs (ip, dns), and the lines that are comments or no pair, whole.

    Comments begin with ``#`` or ``-``; a pair is what stands before and after the first comma, addresses unchecked.
    """
    bare = F.btrim(F.col("line"), F.lit(BLANKS))
    rows = lines.filter(bare != "").withColumns({"dns": F.btrim(F.substring_index("line", ",", 1), F.lit(BLANKS)), "ip": F.btrim(F.expr("substr(line, locate(',', line) + 1)"), F.lit(BLANKS))})
    pair = F.contains("line", F.lit(",")) & ~bare.rlike("^[#-]") & (F.col("dns") != "") & (F.col("ip") != "")
    return rows.filter(pair).select("ip", F.regexp_replace(F.lower("dns"), r"[.]$", "").alias("dns")).distinct(), rows.filter(~pair).select(*lines.columns)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(canonical_ipv4(F.col("ip")).alias("ip"), canonical_name(F.col("dns")).alias("dns")).filter("ip is not null and dns <> ''")


def new_pairs(base: DataFrame, extra: DataFrame) -> DataFrame:
    """For each address of ``extra`` that ``base`` lacks its representative name: the shortest, then the smallest."""
    best = F.min(F.struct(F.length("dns").alias("n"), "dns")).alias("b")
    found = _pairs(extra).groupBy("ip").agg(best).select("ip", "b.dns")
    return found.join(_pairs(base).select("ip").distinct(), "ip", "left_anti")


def merged(base: DataFrame, extra: DataFrame) -> DataFrame:
    """The base map and the new pairs."""
    return _pairs(base).unionByName(new_pairs(base, extra)).distinct()


def ambiguous(pairs: DataFrame) -> DataFrame:
    """(ip, names, dns): the addresses with more than one name, one row per name."""
    rows = _pairs(pairs).distinct()
    many = rows.groupBy("ip").agg(F.count(F.lit(1)).alias("names")).filter("names > 1")
    return rows.join(many, "ip").select("ip", "names", "dns")


def strong_pairs(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """(ip, dns) pairs that may be learned: answered and observed, not inferred, outside private blocks."""
    rows = transactions.filter("dns_name <> ''").select("tx_id", "dns_name", "name_evidence").join(addresses, "tx_id")
    bits = F.when(F.coalesce("evidence", F.lit(0)) != 0, F.col("evidence")).otherwise(F.coalesce("name_evidence", F.lit(0)))
    rows = rows.filter(ev.has(bits, LEARNABLE) & ~ev.has(bits, ev.CONN) & ~is_rfc1918(F.col("ip")))
    return rows.select("ip", canonical_name(F.col("dns_name")).alias("dns")).filter("dns <> ''").distinct()


def learned(base: DataFrame, transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    return new_pairs(base, strong_pairs(transactions, addresses))


def audit(pairs: DataFrame, transactions: DataFrame, addresses: DataFrame, time: Column) -> DataFrame:
    """Each new pair with its earliest strong transaction; pairs without one keep empty provenance.

    Unlike in learning, inferred evidence counts here, and the address's own bits, if any, replace the name's.
    """
    rows = transactions.filter("dns_name <> ''").withColumn("dns", canonical_name(F.col("dns_name"))).join(addresses, "tx_id")
    bits = F.coalesce("evidence", "name_evidence", F.lit(0))
    rows = rows.withColumn("bits", bits).filter(ev.has(F.col("bits"), LEARNABLE))
    first = F.min(F.struct("req_ts_ns", F.coalesce("pcap_file", F.lit("")).alias("pcap_file"), "tx_id", "bits", "issuer_ip", "resolver_ip", "proto", "dest_port")).alias("f")
    found = rows.groupBy("ip", "dns").agg(first)
    out = pairs.join(found, ["ip", "dns"], "left").withColumn("req_ts_ns", F.col("f.req_ts_ns"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        "dns", "ip", text(ev.label(F.coalesce("f.bits", F.lit(0)))).alias("evidence"), text(time).alias("observed_at"), text(F.col("f.issuer_ip")).alias("issuer_ip"), text(F.col("f.resolver_ip")).alias("resolver_ip"),
        text(F.col("f.proto")).alias("protocol"), F.coalesce("f.dest_port", F.lit(0)).alias("port"), text(F.col("f.pcap_file")).alias("pcap_file"),
    )


def recovered(unresolved: DataFrame, recorded: DataFrame) -> DataFrame:
    """(dns, ip) for unresolved (run, ip): the best recorded name of the same run, else of the first run that has one.

    ``recorded`` has run, ip, dns, source and seq. Better means higher rank, then smaller seq.
    """
    rank = ev.recovery_rank(F.col("source"))
    best = F.min(F.struct((-rank).alias("r"), "seq", "dns")).alias("b")
    known = recorded.filter("ip is not null and dns <> ''").groupBy("run", "ip").agg(best).select("run", "ip", F.col("b.dns").alias("own"))
    anywhere = known.groupBy("ip").agg(F.min(F.struct("run", "own")).alias("w")).select("ip", F.col("w.own").alias("other"))
    wanted = unresolved.filter(is_public(F.col("ip"))).select("run", "ip").distinct()
    out = wanted.join(known, ["run", "ip"], "left").join(anywhere, "ip", "left").select(F.coalesce("own", "other").alias("dns"), "ip")
    return out.filter("dns is not null").distinct()
