"""Edges from packets: who contacted which address, by protocol and port.

Packets have file_idx, pkt_idx, ts_ns, src_ip, dst_ip, l4, src_port, dst_port, tcp_flags and payload (text or
bytes of FTP control lines); packet order within a file is (ts_ns, pkt_idx). Pairing state lives TTL after the
first packet. All pairing is done with windows over stretches of a flow or joins with one row per flow, so a flood of
packets of one flow stays linear, is spread over time and is folded before it is shuffled on.

Edge cases: packets without addresses or with port 0 make no edge; equal times are ordered by packet number;
repeated packets change nothing; an empty table gives no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.functions.addresses import is_local
from tapline.functions.numbers import floor_div
from tapline.operators import radius
from tapline.parsers import ftp
from tapline.session import cut

# TCP flags, lowest port of passive data, lifetime of pairing state.
SYN, RST, ACK = 2, 4, 16
CONTROL_PORTS = ftp.CONTROL_PORTS
PASSIVE_FROM = 30_000
TTL_NS = 30 * 10**9
EDGE = ["issuer_ip", "dst_ip", "proto", "port"]
FLOW = ["file_idx", "issuer_ip", "dst_ip", "cport", "port"]


def _flag(bit: int) -> Column:
    return F.col("tcp_flags").bitwiseAND(F.lit(bit)) != 0


def _tcp(packets: DataFrame) -> DataFrame:
    return packets.filter("l4 = 'tcp' and src_ip is not null and dst_ip is not null and src_port <> 0 and dst_port <> 0").withColumn("tcp_flags", F.coalesce("tcp_flags", F.lit(0)))


def _excluded(c: str, ports: tuple[int, ...]) -> Column:
    return F.col(c).isin(*ports) if ports else F.lit(False)


def _syns(packets: DataFrame, excluded: tuple[int, ...], ttl_ns: int, first_only: bool) -> DataFrame:
    rows = _tcp(packets).filter(_flag(SYN) & ~_flag(ACK) & ~_excluded("dst_port", excluded))
    rows = rows.select("file_idx", F.col("src_ip").alias("issuer_ip"), F.col("dst_ip"), F.col("src_port").alias("cport"), F.col("dst_port").alias("port"), "ts_ns", "pkt_idx", F.lit(0).alias("kind"))
    if not first_only:
        return rows
    rows = rows.withColumn("_row", F.col("file_idx").cast("bigint") * F.lit(1 << 40) + F.col("pkt_idx"))
    kept = radius.first_in_window(rows, F.concat_ws("|", *FLOW), F.col("ts_ns"), "_row", ttl_ns)
    return rows.join(kept, "_row", "left_semi").drop("_row")


def _in_chunks(rows: DataFrame, ttl_ns: int, beside: int = 0) -> DataFrame:
    """Rows with ``chunk``, their stretch of TTL, and again with the one ``beside`` it if that is not 0. Pairs at most
    TTL apart then meet in a chunk, and a flow of any length is spread over its chunks."""
    own = floor_div(F.col("ts_ns"), ttl_ns)
    return rows.withColumn("chunk", F.explode(F.array(own, own + beside)) if beside else own)


def handshake_events(packets: DataFrame, excluded: tuple[int, ...] = (), ttl_ns: int = TTL_NS, first_only: bool = False) -> DataFrame:
    """Answers to a live request: one row per SYN-ACK that has a SYN of its flow at most TTL before.

    With ``first_only`` a request repeated while an earlier one of its flow lives does not count, and does not
    prolong it.
    """
    rows = _tcp(packets).filter(_flag(SYN) & _flag(ACK) & ~_excluded("src_port", excluded))
    answers = rows.select("file_idx", F.col("dst_ip").alias("issuer_ip"), F.col("src_ip").alias("dst_ip"), F.col("dst_port").alias("cport"), F.col("src_port").alias("port"), "ts_ns", "pkt_idx", F.lit(1).alias("kind"))
    both = _in_chunks(_syns(packets, excluded, ttl_ns, first_only), ttl_ns, 1).unionByName(_in_chunks(answers, ttl_ns))
    flow = Window.partitionBy(*FLOW, "chunk").orderBy("ts_ns", "pkt_idx").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("asked", F.last(F.when(F.col("kind") == 0, F.col("ts_ns")), ignorenulls=True).over(flow))
    return both.filter((F.col("kind") == 1) & (F.col("ts_ns") - F.col("asked") <= ttl_ns)).select(*FLOW, "ts_ns", "pkt_idx")


def handshakes(packets: DataFrame, answers: DataFrame, excluded: tuple[int, ...] = (), ttl_ns: int = TTL_NS, first_only: bool = False) -> DataFrame:
    """Edges of answered requests, at the time of the earliest request that an answer followed within TTL."""
    both = _in_chunks(_syns(packets, excluded, ttl_ns, first_only), ttl_ns).unionByName(_in_chunks(answers.withColumn("kind", F.lit(1)), ttl_ns, -1))
    ahead = Window.partitionBy(*FLOW, "chunk").orderBy(F.desc("ts_ns"), F.desc("pkt_idx")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("answered", F.last(F.when(F.col("kind") == 1, F.col("ts_ns")), ignorenulls=True).over(ahead))
    live = both.filter((F.col("kind") == 0) & (F.col("answered") - F.col("ts_ns") <= ttl_ns))
    return live.groupBy("file_idx", "issuer_ip", "dst_ip", "port").agg(F.min("ts_ns").alias("first_seen_ns")).select("file_idx", "issuer_ip", "dst_ip", F.lit("tcp").alias("proto"), "port", "first_seen_ns")


def midsession_events(packets: DataFrame) -> DataFrame:
    """Packets of running sessions between a local and a foreign address, the local side as issuer."""
    rows = _tcp(packets).filter(~_flag(SYN) & ~_flag(RST)).withColumns({"a": is_local(F.col("src_ip")), "b": is_local(F.col("dst_ip"))}).filter("a <> b")
    side = lambda here, there: F.when(F.col("a"), F.col(here)).otherwise(F.col(there))
    return rows.select("file_idx", side("src_ip", "dst_ip").alias("issuer_ip"), side("dst_ip", "src_ip").alias("dst_ip"), side("dst_port", "src_port").alias("port"), "ts_ns", "pkt_idx")


def _folded(events: DataFrame, proto: str) -> DataFrame:
    return events.groupBy("file_idx", "issuer_ip", "dst_ip", "port").agg(F.min("ts_ns").alias("first_seen_ns")).select("file_idx", "issuer_ip", "dst_ip", F.lit(proto).alias("proto"), "port", "first_seen_ns")


def handshake_edges(packets: DataFrame, excluded: tuple[int, ...] = (), ttl_ns: int = TTL_NS, first_only: bool = False) -> DataFrame:
    return handshakes(packets, handshake_events(packets, excluded, ttl_ns, first_only), excluded, ttl_ns, first_only)


def midsession_edges(packets: DataFrame) -> DataFrame:
    return _folded(midsession_events(packets), "tcp")


def udp_edges(packets: DataFrame, excluded: tuple[int, ...] = (), private_source: bool = False, ttl_ns: int = TTL_NS) -> DataFrame:
    """Flows that were answered within TTL, issued by the first sender; so a third packet also makes the opposite edge.

    With ``private_source`` an edge from a foreign to a local address is turned round.
    """
    rows = packets.filter("l4 = 'udp' and src_ip is not null and dst_ip is not null and src_port <> 0 and dst_port <> 0").filter(~_excluded("src_port", excluded) & ~_excluded("dst_port", excluded))
    flow = ["file_idx", "src_ip", "dst_ip", "src_port", "dst_port"]
    first = rows.groupBy(*flow).agg(F.min(F.struct("ts_ns", "pkt_idx")).alias("f"))
    back = rows.select("file_idx", F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), F.col("dst_port").alias("src_port"), F.col("src_port").alias("dst_port"), "ts_ns", "pkt_idx")
    met = back.join(first, flow).filter((F.struct("ts_ns", "pkt_idx") > F.col("f")) & (F.col("ts_ns") - F.col("f.ts_ns") <= ttl_ns))
    met = met.groupBy(*flow).agg(F.min("f.ts_ns").alias("ts_ns"))
    turn = (~is_local(F.col("src_ip")) & is_local(F.col("dst_ip"))) if private_source else F.lit(False)
    met = met.withColumn("turn", turn)
    pick = lambda one, two: F.when(F.col("turn"), F.col(two)).otherwise(F.col(one))
    return _folded(met.select("file_idx", pick("src_ip", "dst_ip").alias("issuer_ip"), pick("dst_ip", "src_ip").alias("dst_ip"), pick("dst_port", "src_port").alias("port"), "ts_ns"), "udp")


def passive_ports(packets: DataFrame) -> DataFrame:
    """Data ports announced on FTP control sessions: file_idx, issuer_ip (the client), dst_ip, port, ts_ns, pkt_idx."""
    rows = _tcp(packets).filter(F.col("src_port").isin(*CONTROL_PORTS) & ~F.col("dst_port").isin(*CONTROL_PORTS) & F.col("payload").isNotNull())
    return rows.select("file_idx", F.col("dst_ip").alias("issuer_ip"), F.col("src_ip").alias("dst_ip"), ftp.passive_port(F.col("payload").cast("string")).alias("port"), "ts_ns", "pkt_idx").filter("port is not null")


def without_announced(events: DataFrame, announced: DataFrame, ttl_ns: int = TTL_NS) -> DataFrame:
    """Events on a port announced at most TTL before go."""
    key = ["file_idx", "issuer_ip", "dst_ip", "port"]
    told = _in_chunks(announced.select(*key, "ts_ns", "pkt_idx", F.col("ts_ns").alias("_a")), ttl_ns, 1)
    both = _in_chunks(events.withColumn("_a", F.lit(None).cast("bigint")), ttl_ns).unionByName(told, allowMissingColumns=True)
    past = Window.partitionBy(*key, "chunk").orderBy("ts_ns", "pkt_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("_a", ignorenulls=True).over(past)
    both = both.withColumn("_last", last).filter("_a is null")
    return both.filter(F.col("_last").isNull() | (F.col("ts_ns") - F.col("_last") > ttl_ns)).drop("_a", "_last", "chunk")


def without_passive_range(events: DataFrame, passive_from: int = PASSIVE_FROM) -> DataFrame:
    """Events on high ports go once the pair has had a control contact in the file."""
    control = events.filter(F.col("port").isin(*CONTROL_PORTS)).groupBy("file_idx", "issuer_ip", "dst_ip").agg(F.min(F.struct("ts_ns", "pkt_idx")).alias("_c"))
    rows = events.join(control, ["file_idx", "issuer_ip", "dst_ip"], "left")
    return rows.filter((F.col("port") < passive_from) | F.col("_c").isNull() | (F.struct("ts_ns", "pkt_idx") < F.col("_c"))).drop("_c")


def file_edges(packets: DataFrame, excluded: tuple[int, ...] = (), private_source: bool = False, collapse_ftp: bool = True, ttl_ns: int = TTL_NS) -> DataFrame:
    """All edges of every file: handshakes, running sessions and answered UDP, FTP data contacts left out."""
    answers, running = handshake_events(packets, excluded, ttl_ns), midsession_events(packets)
    if collapse_ftp:
        events = answers.withColumn("_how", F.lit(0)).unionByName(running.withColumn("_how", F.lit(1)), allowMissingColumns=True)
        events = cut(without_passive_range(cut(without_announced(events, passive_ports(packets), ttl_ns))))
        answers, running = events.filter("_how = 0").drop("_how"), events.filter("_how = 1").drop("_how", "cport")
    tcp = handshakes(packets, answers, excluded, ttl_ns).unionByName(_folded(running, "tcp"))
    tcp = tcp.groupBy("file_idx", *EDGE).agg(F.min("first_seen_ns").alias("first_seen_ns"))
    return tcp.unionByName(udp_edges(packets, excluded, private_source, ttl_ns).select(*tcp.columns))


def across_files(edges: DataFrame) -> DataFrame:
    """One edge per issuer, destination, protocol and port: that of the first file, even if another saw it earlier."""
    return edges.groupBy(*EDGE).agg(F.min(F.struct("file_idx", "first_seen_ns")).alias("f")).select(*EDGE, "f.file_idx", "f.first_seen_ns")


def without_ftp_data(edges: DataFrame, passive_from: int = PASSIVE_FROM) -> DataFrame:
    """High TCP ports go wherever the pair has a control contact anywhere in the run."""
    control = edges.filter((F.col("proto") == "tcp") & F.col("port").isin(*CONTROL_PORTS)).select("issuer_ip", "dst_ip").distinct()
    high = (F.col("proto") == "tcp") & (F.col("port") >= passive_from)
    return edges.filter(~high).unionByName(edges.filter(high).join(control, ["issuer_ip", "dst_ip"], "left_anti").select(*edges.columns))


def collected(packets: DataFrame, excluded: tuple[int, ...] = (), private_source: bool = False) -> DataFrame:
    """The edges of a run, numbered in a fixed order."""
    return without_ftp_data(across_files(file_edges(packets, excluded, private_source)))
