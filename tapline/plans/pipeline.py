"""From captures to all reports, as one lazy plan per report over packets that are read once.

``build`` gives the DataFrames, ``write`` puts them in a run folder. Intermediate relations that several reports
share are cut, that is written to the shared folder, so nothing is computed twice and lost executors cost little.
"""

from __future__ import annotations

import contextlib
import logging
import os
from dataclasses import dataclass, replace
from datetime import date, timedelta
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions import evidence as ev
from tapline.functions.numbers import floor_div
from tapline.operators import correlate, edges, extract, namemap, radius, reports, resolve, topology, transactions
from tapline.options import RunOptions
from tapline.session import cut
from tapline.sinks import text
from tapline.sinks.rundir import RunFolder
from tapline.sources import pcap, runout

EMPTY_PAIRS = "ip string, dns string"
SORTED_MAPS = ("dns-ip-sorted.txt", "ip-dns-sorted.txt", "ip-multi-dns-sorted.txt")
LOG = logging.getLogger(__name__)


@dataclass
class Results:
    """Everything a run derives."""

    packets: DataFrame
    transactions: DataFrame
    addresses: DataFrame
    edges: DataFrame
    pairs: DataFrame
    learned: DataFrame
    matrix: DataFrame
    first: DataFrame


def packet_number(row: tuple[str, str] = ("file_idx", "pkt_idx")) -> Column:
    """One number per packet of a run, in file and packet order."""
    return F.col(row[0]).cast("bigint") * F.lit(1 << 40) + F.col(row[1])


def dns_transactions(packets: DataFrame, sni: bool = True, compat_sni_blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """Transactions and their addresses from DNS messages and client hellos, copies across files merged."""
    messages = cut(extract.dns_messages(packets))
    queries = messages.filter("is_query").withColumn("query_id", packet_number())
    responses = messages.filter("not is_query").withColumn("response_id", packet_number())
    matches = cut(transactions.matched(queries, responses))
    answers = responses.select("response_id", F.posexplode("answers").alias("ord", "ip"))
    found = transactions.answer_evidence(matches, answers)
    answered = matches.select(F.col("query_id").alias("tx_id")).distinct().withColumn("name_evidence", F.lit(ev.DNS))
    tx = queries.select(F.col("query_id").alias("tx_id"), "file_idx", "pcap_file", "issuer_ip", "src_port", "resolver_ip", F.col("proto").alias("via"), "dns_id", F.col("name").alias("dns_name"), F.col("ts_ns").alias("req_ts_ns"))
    tx = tx.join(answered, "tx_id", "left").withColumn("server", F.col("resolver_ip"))
    keys = ["issuer_ip", "src_port", "server", "via", "dns_id", "dns_name"]
    merged = transactions.merged(tx, keys)
    kept = merged.select(F.col("tx_id").alias("kept"), *keys, "req_ts_ns")
    found = found.join(tx.join(kept, [*keys, "req_ts_ns"]).select("tx_id", "kept"), "tx_id")
    ips = found.groupBy(F.col("kept").alias("tx_id"), "ip").agg(F.min("ord").alias("ord"), F.bit_or("evidence").alias("evidence"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = merged.select("tx_id", "req_ts_ns", "issuer_ip", none("string").alias("issuer_label"), "dns_name", "resolver_ip", none("int").alias("dest_port"), none("string").alias("proto"), "pcap_file", "name_evidence")
    if sni:
        hello = cut(extract.hellos(packets))
        # Numbers behind all query packets of a file keep them apart: a hello is a packet of its own.
        named = transactions.hello_transactions(hello, compat_sni_blank).join(hello.groupBy("issuer_ip", "dst_ip", "port", F.col("sni").alias("dns_name")).agg(F.min(packet_number()).alias("tx_id")), ["issuer_ip", "dst_ip", "port", "dns_name"])
        rows = rows.unionByName(named.select("tx_id", "req_ts_ns", "issuer_ip", none("string").alias("issuer_label"), "dns_name", none("string").alias("resolver_ip"), F.col("port").alias("dest_port"), F.lit("tcp").alias("proto"), "pcap_file", "name_evidence"))
        ips = ips.unionByName(named.select("tx_id", F.col("dst_ip").alias("ip"), F.lit(0).alias("ord"), "evidence"))
    return rows, ips


def connections(packets: DataFrame, excluded: tuple[int, ...]) -> DataFrame:
    """Packets that open or carry a connection to a server, name resolution left out."""
    syn = (F.col("l4") == "tcp") & (F.col("tcp_flags").bitwiseAND(F.lit(edges.SYN | edges.ACK)) == edges.SYN)
    udp = (F.col("l4") == "udp") & ~F.col("dst_port").isin(*excluded) if excluded else F.col("l4") == "udp"
    rows = packets.filter((syn | udp) & (F.col("dst_port") != 53))
    return rows.select(packet_number().alias("conn_id"), "file_idx", "pkt_idx", F.col("src_ip").alias("issuer_ip"), "dst_ip", F.col("l4").alias("proto"), F.col("dst_port").alias("port"), "ts_ns")


def correlated(tx: DataFrame, ips: DataFrame, conns: DataFrame, pairs: DataFrame, only_tcp: bool) -> tuple[DataFrame, DataFrame]:
    """Transactions with the port of their closest connection, addresses with what connections confirmed."""
    direct = cut(correlate.direct(conns, tx, ips))
    inferred = cut(correlate.fallback_sequential(conns, tx, ips, pairs))
    best = correlate.best_candidates(direct.unionByName(inferred), conns, only_tcp)
    hit = direct.select("tx_id").unionByName(inferred.select("tx_id")).distinct().withColumn("hit", F.lit(True))
    marked = correlate.observed(ips, tx, direct, inferred, conns)
    rows = tx.drop("issuer_label").join(best.select("tx_id", F.col("port").alias("_port"), F.col("proto").alias("_proto")), "tx_id", "left").join(hit, "tx_id", "left")
    none_yet = F.col("hit").isNotNull() & (F.coalesce("name_evidence", F.lit(0)) == 0)
    rows = rows.withColumns({"dest_port": F.coalesce("_port", "dest_port"), "proto": F.coalesce("_proto", "proto"), "name_evidence": F.when(none_yet, ev.DNS).otherwise(F.col("name_evidence")), "issuer_label": F.lit(None).cast("string")})
    return rows.drop("_port", "_proto", "hit"), marked


def build(spark: SparkSession, options: RunOptions, packets: DataFrame | None = None) -> Results:
    """All relations of a run. ``packets`` replaces reading captures, e.g. from Parquet partitioned by file."""
    if packets is None:
        packets = cut(pcap.read_captures(spark, options.read_dir))
    tx, ips = dns_transactions(packets, not options.disable_sni, options.compat_sni_blank)
    if options.ignore_ntp:
        tx = cut(tx)
        LOG.info("time servers: %d transactions left out", transactions.time_servers(tx).count())
        tx = transactions.without_time_servers(tx)
        ips = ips.join(tx.select("tx_id"), "tx_id", "left_semi")
    tx, ips = cut(tx), cut(ips)
    if options.active_resolve:
        ips = cut(ips.unionByName(resolve.resolved(tx, ips, options.active_resolvers)))
    pairs = spark.createDataFrame([], EMPTY_PAIRS)
    if options.dns_ip_file:
        pairs = cut(namemap.load(runout.map_lines(spark, options.dns_ip_file), F.col("line_id")).select("ip", "dns"))
    tx, ips = correlated(tx, ips, cut(connections(packets, options.exclude_ports)), pairs, options.only_tcp)
    found = edges.collected(packets, options.exclude_ports, options.enforce_private_as_source)
    found = found.orderBy("file_idx", "first_seen_ns", *edges.EDGE).withColumns({"edge_ord": F.monotonically_increasing_id(), "label": F.lit(None).cast("string")})
    tx, ips, found = cut(tx), cut(ips), cut(found)
    if options.radius_imsi:
        windows = cut(radius.coalesced(radius.sessions(extract.deduplicated_accounting(packets))))
        named = radius.labels(tx, windows, "tx_id", F.col("issuer_ip"), floor_div(F.col("req_ts_ns"), 1_000_000))
        tx = cut(tx.drop("issuer_label").join(named.withColumnRenamed("imsi", "issuer_label"), "tx_id", "left"))
        named = radius.labels(found, windows, "edge_ord", F.col("issuer_ip"), floor_div(F.col("first_seen_ns"), 1_000_000))
        found = cut(found.drop("label").join(named.withColumnRenamed("imsi", "label"), "edge_ord", "left"))
    learned = cut(namemap.learned(pairs, tx, ips)) if options.dns_ip_file else spark.createDataFrame([], EMPTY_PAIRS)
    matrix = cut(topology.matrix(found, tx, ips, pairs.unionByName(learned.select("ip", "dns")), options.topology_window_ns, label=F.col("label")))
    return Results(packets, tx, ips, found, pairs, learned, topology.short(matrix) if options.short else matrix, reports.first_packet(packets))


MATRIX = (("issuer", "dst", "dns_name", "dns_source", "proto", "port"), ("Issuer IP", "Destination IP", "DNS Name", "Source", "Protocol", "Port"))
PROFILE = (("issuer", "total_dns", "unique_names", "unique_ips", "unique_ports", "rate"), ("Issuer IP", "Total DNS", "Unique Domains", "Unique IPs", "Unique Ports", "Connection Rate"))
UNRESOLVED = (("dns_name", "issuer_ip", "first_pcap"), ("DNS Name", "Issuer IP", "First PCAP File"))
AUDIT = (("dns", "ip", "evidence", "observed_at", "shown_port", "issuer_ip", "resolver_ip", "pcap_file"), ("DNS Name", "IP", "Evidence", "Observed At UTC", "Port", "Issuer IP", "Resolver IP", "PCAP File"))


def write(r: Results, options: RunOptions, folder: RunFolder) -> RunFolder:
    """Write all reports that have rows, the manifest, and run the commands."""
    first = r.first.first()
    first_time, first_file = (text.rfc3339(first.ts_ns), first.pcap_file) if first else ("", "")
    records = cut(reports.records(r.transactions, r.addresses).orderBy("request_time", "issuer_ip", "tx_id"))
    if options.format == "json":
        with folder.create("dns_table_json", "dns-table.json") as out:
            text.json_array(out, text.record_items(records))
    else:
        with folder.create("dns_table_txt", "dns-table.txt") as out:
            text.main_table(out, records, reports.table_stats(r.transactions, r.addresses).first())
    if options.export_csv:
        with folder.create("dns_table_csv", options.export_csv) as out:
            text.records_csv(out, records)
    profile = reports.issuer_profile(r.transactions, r.addresses).withColumn("rate", F.format_string("%.2f", "connection_rate")).orderBy(F.desc("total_dns"), "issuer")
    if not profile.isEmpty():
        with folder.create("dns_issuer_profile", "dns-issuer-profile.txt") as out:
            text.aligned(out, profile, *PROFILE, empty="No DNS issuer activity found.")
    if options.dns_ip_file:
        audit = cut(namemap.audit(r.learned, r.transactions, r.addresses, reports.nanoseconds(F.col("req_ts_ns"))))
        appended = text.append_pairs(options.dns_ip_file, text.rows(r.learned.orderBy("ip", "dns")))
        if options.debug and appended:
            with folder.create("ip_dns_append_audit", "ip-dns-append-audit.txt") as out:
                out.write(f"run_id: {folder.run_id}\nnet_id: {folder.net_id}\nrun_started_at_utc: {folder.started.strftime('%Y-%m-%dT%H:%M:%S.%fZ')}\ndns_ip_file: {options.dns_ip_file}\nfirst_packet_ts_utc: {first_time}\nfirst_packet_pcap_file: {first_file}\nnew_pairs_appended: {appended}\n\n")
                shown = audit.withColumn("shown_port", F.nullif("port", F.lit(0))).orderBy(F.col("observed_at") == "", "observed_at", "dns", "ip")
                text.aligned(out, shown, *AUDIT, empty="No new learned IP->DNS pairs were appended.")
    matrix = cut(topology.ordered(r.matrix, not options.unsorted, by_name=not options.short))
    if not matrix.isEmpty():
        with folder.create("network_topology_matrix_txt", "network-topology-matrix.txt") as out:
            text.aligned(out, matrix, *MATRIX, empty="No network topology entries found.", stack="issuer", gap=True)
        with folder.create("network_topology_matrix_json", "network-topology-matrix.json") as out:
            text.topology_json(out, matrix)
    with folder.create("service_endpoints", "service-endpoints.txt") as out:
        text.json_array(out, (row.asDict() for row in text.rows(reports.service_endpoints(r.matrix).orderBy("ip", "dns", "protocol", "port"))))
    unresolved = reports.minus_topology(reports.unresolved_names(r.transactions, r.addresses), r.matrix).orderBy("dns_name", "issuer_ip", "first_pcap")
    if not unresolved.isEmpty():
        with folder.create("dns_unresolved", "dns-unresolved-dns.txt") as out:
            text.aligned(out, unresolved, *UNRESOLVED, empty="No unresolved DNS queries were found.", stack="dns_name")
    external = reports.external_endpoints(r.matrix)
    if not external.isEmpty():
        with folder.create("external_endpoints", "external-endpoints.txt") as out:
            text.external_endpoints(out, external)
    blank = reports.unresolved_endpoints(r.matrix).orderBy(F.desc("count"), "ip", "port", "proto")
    if not blank.isEmpty():
        with folder.create("unresolved_ip", "unresolved-ip.json") as out:
            text.json_array(out, (row.asDict() for row in text.rows(blank)))
    files = r.packets.select("file_idx").distinct().count()
    manifest = folder.manifest(options.read_dir, files, options.format, first_time, first_file, options.manifest_out)
    folder.run_hooks(options.post_hooks, manifest)
    return folder


def run(spark: SparkSession, options: RunOptions, packets: DataFrame | None = None) -> RunFolder:
    return write(build(spark, options, packets), options, RunFolder(options.net_id, options.output_root))


def recover(spark: SparkSession, root: str, out: str) -> int:
    """Names for unresolved addresses of earlier runs from their main tables, as sorted ``dns,ip`` lines; how many."""
    found = namemap.recovered(runout.unresolved(spark, root), runout.recorded(spark, root)).orderBy("dns", "ip")
    with open(out, "w", encoding="utf-8") as f:
        n = 0
        for n, row in enumerate(text.rows(found), 1):
            f.write(f"{row.dns},{row.ip}\n")
    return n


def sort_map(spark: SparkSession, path: str, out: str) -> None:
    """A map file as dns-ip-sorted.txt, ip-dns-sorted.txt and ip-multi-dns-sorted.txt in a folder; the file stays.

    Lines that are comments or no pair stand first in each, as they are.
    """
    lines = cut(runout.numbered_lines(spark, path))
    pairs, other = namemap.sortable(lines)
    os.makedirs(out, exist_ok=True)
    with contextlib.ExitStack() as files:
        opened = [files.enter_context(open(os.path.join(out, n), "w", encoding="utf-8")) for n in SORTED_MAPS]
        text.sorted_maps(cut(pairs), *opened, first=(r.line for r in text.rows(other.orderBy("file", "line_no"))))


def run_days(spark: SparkSession, options: RunOptions, first: date) -> list[RunFolder]:
    """One run per day folder ``<read_dir>/<YYYY-MM-DD>`` from the first on, until a day has no captures.

    Nothing is copied: the folders are read where they are, on any file system Spark knows.
    """
    done = []
    for k in count():
        day = (first + timedelta(days=k)).isoformat()
        try:
            packets = cut(pcap.read_captures(spark, f"{options.read_dir.rstrip('/')}/{day}"))
        except (AnalysisException, FileNotFoundError):
            break
        one = replace(options, read_dir=f"{options.read_dir.rstrip('/')}/{day}")
        done.append(write(build(spark, one, packets), one, RunFolder(one.net_id, f"{one.output_root}/{day}")))
    return done
