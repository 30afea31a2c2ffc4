"""Reports over transactions and topology rows.

Sets that a report lists per key are given as one row per member, so that a key with a third of all rows never
becomes one value of unbounded size; the writers join members into lines while they stream.

Transactions are one row per tx_id, their addresses one row per (tx_id, ip). Edge cases: a null name or issuer
counts as an empty text; a null or zero port means not connected, but only a null port drops a record; equal
request times are settled by name, then by transaction number; empty tables give empty reports (statistics give
zeros); columns not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.functions import evidence as ev
from tapline.functions.addresses import BLANKS, canonical_ipv4, is_public
from tapline.functions.hashing import fnv64
from tapline.functions.names import canonical_name, name_suffix
from tapline.functions.numbers import floor_div

# Names of endpoints that have none.
NO_ATTRIBUTION, PRIVATE_SERVER = "[no-dns-attribution]", "[private-server]"
SAMPLE_IPS, UNUSED_FILES = 10, 3


def _issuer() -> Column:
    """The label, or the address where there is none."""
    return F.coalesce(F.nullif(F.col("issuer_label"), F.lit("")), F.col("issuer_ip"), F.lit(""))


def _order() -> Column:
    return F.struct("req_ts_ns", F.coalesce("dns_name", F.lit("")).alias("n"), "tx_id")


def milliseconds(ns: Column) -> Column:
    """UTC time as text with milliseconds."""
    whole = floor_div(ns, 1_000_000_000)
    return F.concat(F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(floor_div(F.pmod(ns, F.lit(1_000_000_000)), 1_000_000).cast("string"), 3, "0"))


def nanoseconds(ns: Column) -> Column:
    """UTC time as text with nine digits and a Z, null where there is no time."""
    whole = floor_div(ns, 1_000_000_000)
    return F.concat(F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))


def _members(*members: tuple[Column | str, Column]) -> Column:
    """Rows (kind, value) to be inlined."""
    return F.inline(F.array(*[F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), v.alias("value")) for k, v in members]))


def record_keys(transactions: DataFrame) -> DataFrame:
    """(tx_id, issuer, dns_name, dest_port) of the first transaction per issuer, name and port; without a port none."""
    keyed = transactions.filter("dest_port is not null").select(_issuer().alias("issuer"), F.coalesce("dns_name", F.lit("")).alias("dns_name"), "dest_port", _order().alias("o"))
    return keyed.groupBy("issuer", "dns_name", "dest_port").agg(F.min("o").alias("o")).select("o.tx_id", "issuer", "dns_name", "dest_port")


def records(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """The main table: time, issuer, name, addresses in order with their sources, resolver, port."""
    first = record_keys(transactions).select("tx_id", "issuer")
    bits = F.when(F.coalesce("evidence", F.lit(0)) != 0, F.col("evidence")).otherwise(F.coalesce("name_evidence", F.lit(0)))
    rows = transactions.join(first, "tx_id").join(addresses.select("tx_id", "ip", "ord", "evidence"), "tx_id", "left")
    # A transaction has as many addresses as one answer holds, so its list is small.
    one = F.when(F.col("ip").isNotNull(), F.struct("ord", "ip", F.concat("ip", F.lit("="), ev.label(bits)).alias("s")))
    rows = rows.groupBy("tx_id", "req_ts_ns", "issuer", "dns_name", "resolver_ip", "dest_port", "pcap_file").agg(F.array_sort(F.collect_list(one)).alias("a"))
    return rows.select(
        milliseconds(F.col("req_ts_ns")).alias("request_time"), "tx_id", F.col("issuer").alias("issuer_ip"), F.coalesce("dns_name", F.lit("")).alias("dns_name"), F.array_join("a.ip", ";").alias("resolved_ips"),
        F.array_join("a.s", ";").alias("resolved_ip_sources"), "resolver_ip", F.col("dest_port").alias("destination_port"),
    )


def table_stats(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row: distinct issuers, addresses and names of the main table."""
    used = record_keys(transactions)
    ips = used.select("tx_id").join(addresses.select("tx_id", "ip"), "tx_id").agg(F.count_distinct("ip").alias("unique_dest_ips"))
    one = used.agg(F.count_distinct("issuer").alias("unique_sources"), F.count_distinct(F.nullif("dns_name", F.lit(""))).alias("unique_connected_dns"))
    return one.join(F.broadcast(ips)).select("unique_sources", "unique_dest_ips", "unique_connected_dns")


def unused_names(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """(dns_name, kind, value): issuers, addresses and files of the names no transaction of which has a port."""
    named = transactions.filter("dns_name <> ''")
    unused = named.groupBy("dns_name").agg(F.max(F.col("dest_port").isNotNull()).alias("used")).filter("not used").select("dns_name")
    rows = named.filter("pcap_file <> ''").join(unused, "dns_name").select("tx_id", "dns_name", "issuer_ip", "pcap_file")
    long = rows.select("dns_name", _members(("issuer", F.col("issuer_ip")), ("pcap", F.col("pcap_file"))))
    ips = rows.join(addresses.select("tx_id", "ip"), "tx_id").select("dns_name", F.lit("ip").alias("kind"), F.col("ip").alias("value"))
    return long.unionByName(ips).filter("value <> ''").distinct()


def unused_name_files(transactions: DataFrame, most: int = UNUSED_FILES) -> DataFrame:
    """(dns_name, pcap_file): the first files, by name, of every name the main table does not have."""
    used = record_keys(transactions).select("dns_name").distinct()
    files = transactions.filter("dns_name <> '' and pcap_file <> ''").select("dns_name", "pcap_file").distinct().join(used, "dns_name", "left_anti")
    return files.withColumn("r", F.row_number().over(Window.partitionBy("dns_name").orderBy("pcap_file"))).filter(F.col("r") <= most).drop("r")


def issuer_profile(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """Per issuer: transactions, distinct names, addresses and ports, and the share that led to a connection.

    Names and ports are counted with the transactions and addresses apart, so no transaction is counted twice.
    """
    tx = transactions.withColumn("issuer", _issuer()).filter("issuer <> ''")
    port = F.when(F.col("dest_port") > 0, F.col("dest_port"))
    one = tx.groupBy("issuer").agg(F.count(F.lit(1)).alias("total_dns"), F.count_distinct(F.coalesce("dns_name", F.lit(""))).alias("unique_names"), F.count_distinct(port).alias("unique_ports"), F.count(port).alias("connected"))
    ips = tx.select("tx_id", "issuer").join(addresses.select("tx_id", "ip"), "tx_id").groupBy("issuer").agg(F.count_distinct("ip").alias("unique_ips"))
    rows = one.join(ips, "issuer", "left").select("issuer", "total_dns", "unique_names", F.coalesce("unique_ips", F.lit(0).cast("bigint")).alias("unique_ips"), "unique_ports", (F.col("connected") / F.col("total_dns")).alias("connection_rate"))
    return rows


def unresolved_names(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """(dns_name, issuer_ip, first_pcap): names no transaction of which got an address, per issuer."""
    tx = transactions.withColumns({"name": canonical_name(F.col("dns_name")), "who": F.coalesce("issuer_ip", F.lit(""))}).filter("name <> ''")
    resolved = tx.join(addresses.select("tx_id").distinct(), "tx_id", "left_semi").select("name").distinct()
    first = F.min(F.when(F.col("pcap_file") != "", F.struct(_order().alias("o"), "pcap_file"))).alias("f")
    rows = tx.groupBy("name", "who").agg(first).join(resolved, "name", "left_anti")
    return rows.select(F.col("name").alias("dns_name"), F.col("who").alias("issuer_ip"), F.coalesce("f.pcap_file", F.lit("")).alias("first_pcap"))


def unresolved_per_transaction(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """(dns_name, issuer_ip, first_pcap) of transactions without address, whatever others of the name got."""
    tx = transactions.withColumns({"name": F.regexp_replace(F.btrim("dns_name", F.lit(BLANKS)), r"\.$", ""), "who": F.coalesce("issuer_ip", F.lit(""))}).filter("name <> '' and pcap_file <> ''")
    first = F.min(F.struct(_order().alias("o"), "pcap_file")).alias("f")
    rows = tx.join(addresses.select("tx_id").distinct(), "tx_id", "left_anti").groupBy("name", "who").agg(first)
    return rows.select(F.col("name").alias("dns_name"), F.col("who").alias("issuer_ip"), F.col("f.pcap_file").alias("first_pcap"))


def name_evidence(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """(name, ip, evidence, label): all that is known of a pair of name and address, with an observed contact added."""
    rows = transactions.filter("dns_name <> ''").select("tx_id", canonical_name(F.col("dns_name")).alias("name"), F.coalesce("name_evidence", F.lit(0)).alias("n")).join(addresses.select("tx_id", "ip", F.coalesce("evidence", F.lit(0)).alias("e")), "tx_id")
    rows = rows.groupBy("name", "ip").agg(F.bit_or(F.col("n").bitwiseOR(F.col("e"))).alias("bits")).withColumn("evidence", ev.normalised(F.col("bits")))
    shown = F.when(F.col("evidence") != 0, ev.label(ev.normalised(F.col("evidence").bitwiseOR(F.lit(ev.OBSERVED))))).otherwise("")
    return rows.select("name", "ip", "evidence", shown.alias("label"))


def minus_topology(unresolved: DataFrame, rows: DataFrame) -> DataFrame:
    """Unresolved names that no topology row carries, whoever issued it."""
    named = rows.select(canonical_name(F.col("dns_name")).alias("dns_name")).filter("dns_name <> ''").distinct()
    return unresolved.join(named, "dns_name", "left_anti")


def connectivity(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """Distinct (issuer, dns_name, ip, port) of connected transactions."""
    tx = transactions.filter("dest_port > 0").select("tx_id", _issuer().alias("issuer"), F.coalesce("dns_name", F.lit("")).alias("dns_name"), F.col("dest_port").alias("port")).filter("issuer <> ''")
    return tx.join(addresses.select("tx_id", "ip"), "tx_id").select("issuer", "dns_name", "ip", "port").distinct()


def connectivity_short(rows: DataFrame) -> DataFrame:
    """One address, the smallest, per issuer, name and port."""
    return rows.groupBy("issuer", "dns_name", "port").agg(F.min("ip").alias("ip")).select("issuer", "dns_name", "ip", "port")


def service_endpoints(rows: DataFrame) -> DataFrame:
    """Per destination, name, protocol and port: distinct non-public issuers, hash, first time in milliseconds.

    Rows without a name make a synthetic endpoint, but only where the contact has no named one. Issuers are
    counted after they were folded to one row each, so a busy endpoint is counted by many tasks.
    """
    slim = rows.select(canonical_ipv4(F.col("dst")).alias("ip"), canonical_name(F.col("dns_name")).alias("dns"), F.lower(F.trim("proto")).alias("protocol"), "port", canonical_ipv4(F.col("issuer")).alias("issuer"), floor_div(F.col("observed_ns"), 1_000_000).alias("ms"))
    slim = slim.filter("ip is not null and protocol <> '' and port <> 0").withColumn("dns", F.coalesce("dns", F.lit("")))
    key = ["ip", "protocol", "port", "dns"]
    per = slim.groupBy(*key, "issuer").agg(F.min(F.when(F.col("ms") > 0, F.col("ms"))).alias("ms"))
    peer = F.when(F.col("issuer").isNotNull() & ~is_public(F.col("issuer")), 1)
    out = per.groupBy(*key).agg(F.count(peer).alias("peers_count"), F.coalesce(F.min("ms"), F.lit(0).cast("bigint")).alias("observed_at"))
    named = F.max(F.col("dns") != "").over(Window.partitionBy("ip", "protocol", "port"))
    out = out.withColumn("named", named).filter("dns <> '' or not named")
    synthetic = F.when(is_public(F.col("ip")), NO_ATTRIBUTION).otherwise(PRIVATE_SERVER)
    out = out.withColumn("dns", F.when(F.col("dns") == "", synthetic).otherwise(F.col("dns")))
    text = F.concat_ws("|", "ip", "dns", "protocol", F.col("port").cast("string"))
    return out.select("ip", "dns", "protocol", "port", "peers_count", fnv64(text).alias("hash_val"), "observed_at")


def external_endpoints(rows: DataFrame, sample: int = SAMPLE_IPS) -> DataFrame:
    """(suffix, kind, value): per name suffix its names, its first addresses and its ports by protocol."""
    named = rows.filter("dns_name <> ''").select(name_suffix(F.col("dns_name")).alias("suffix"), "dns_name", "dst", "proto", "port").filter("suffix <> ''")
    port = F.when((F.col("proto") != "") & (F.col("port") != 0), F.col("port").cast("string"))
    long = named.select("suffix", _members(("name", F.col("dns_name")), ("ip", F.col("dst")), (F.col("proto"), port)))
    long = long.filter("value is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("suffix").orderBy("value"))
    ips = long.filter("kind = 'ip'").withColumn("r", rank).filter(F.col("r") <= sample).drop("r")
    return long.filter("kind <> 'ip'").unionByName(ips)


def egress_endpoints(rows: DataFrame) -> DataFrame:
    """(ip, kind, value): names and ports by protocol of every public destination."""
    out = rows.filter(is_public(F.col("dst"))).select("dst", F.nullif("dns_name", F.lit("")).alias("dns_name"), "proto", F.when(F.col("port") != 0, F.col("port").cast("string")).alias("port"))
    out = out.select(F.col("dst").alias("ip"), _members(("name", F.col("dns_name")), (F.col("proto"), F.col("port"))))
    return out.filter("value is not null and kind <> ''").distinct()


def unresolved_endpoints(rows: DataFrame) -> DataFrame:
    """(ip, port, proto, count) of public destinations without a name."""
    blank = rows.filter((F.trim("dns_name") == "") & is_public(F.col("dst"))).withColumn("proto", F.lower(F.trim("proto"))).filter("proto <> ''")
    return blank.groupBy(F.col("dst").alias("ip"), F.coalesce("port", F.lit(0)).alias("port"), "proto").agg(F.count(F.lit(1)).alias("count"))


def first_packet(packets: DataFrame) -> DataFrame:
    """(ts_ns, pcap_file) of the earliest packet; of equal times the first file in order."""
    return packets.agg(F.min(F.struct("ts_ns", "file_idx", "pcap_file")).alias("f")).filter("f is not null").select("f.ts_ns", "f.pcap_file")
