"""Connections joined back to the DNS transactions that led to them.

Connections have conn_id, file_idx, pkt_idx, issuer_ip, dst_ip, proto, port, ts_ns. Transactions that already have
a port are left out. Edge cases: connections without issuer or destination match nothing; equal request times go to
the smaller transaction number; empty tables give empty results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapline.functions import evidence as ev
from tapline.functions.names import canonical_name, looks_resolvable
from tapline.functions.numbers import floor_div
from tapline.operators import intervals
from tapline.operators.carry import last_before, run_ordered
from tapline.session import cut

DELAY_NS = 5 * 10**9
CANDIDATES = 8


def _open(transactions: DataFrame) -> DataFrame:
    return transactions.filter("coalesce(dest_port, 0) <= 0 and issuer_ip is not null and issuer_ip <> ''")


def direct(connections: DataFrame, transactions: DataFrame, addresses: DataFrame, delay_ns: int = DELAY_NS) -> DataFrame:
    """(conn_id, tx_id, dt_ns): the latest transaction strictly before that resolved to the destination, if recent."""
    facts = _open(transactions).select("tx_id", "issuer_ip", F.col("req_ts_ns").alias("t")).join(addresses.select("tx_id", F.col("ip").alias("dst_ip")), "tx_id").withColumnRenamed("tx_id", "id")
    found = last_before(connections.withColumn("t", F.col("ts_ns")), facts, ["issuer_ip", "dst_ip"], delay_ns, strict=True)
    return found.filter("fact_id is not null").select("conn_id", F.col("fact_id").alias("tx_id"), (F.col("t") - F.col("fact_t")).alias("dt_ns"))


def without_direct_key(connections: DataFrame, transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """TCP connections whose issuer never resolved a name to their destination."""
    keys = _open(transactions).select("tx_id", "issuer_ip").join(addresses.select("tx_id", F.col("ip").alias("dst_ip")), "tx_id").select("issuer_ip", "dst_ip").distinct()
    return connections.filter("proto = 'tcp' and issuer_ip is not null and dst_ip is not null").join(keys, ["issuer_ip", "dst_ip"], "left_anti")


def _unresolved(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """Transactions a connection can still be inferred for."""
    return _open(transactions).filter(looks_resolvable(F.col("dns_name"))).join(addresses.select("tx_id").distinct(), "tx_id", "left_anti")


def fallback_snapshot(connections: DataFrame, transactions: DataFrame, addresses: DataFrame, delay_ns: int = DELAY_NS) -> DataFrame:
    """(conn_id, tx_id, dt_ns) where exactly one unresolved transaction of the issuer lies in the window.

    Eligibility is that before the pass. Each transaction carries the time of the one before it, so that "exactly
    one" is told from the last one alone.
    """
    facts = _unresolved(transactions, addresses).select("issuer_ip", F.col("req_ts_ns").alias("t"), F.col("tx_id").alias("id"), floor_div(F.col("req_ts_ns"), delay_ns).alias("b"))
    cell = Window.partitionBy("issuer_ip", "b").orderBy("t", F.desc("id"))
    ends = facts.groupBy("issuer_ip", "b").agg(F.max("t").alias("end")).withColumn("b", F.col("b") + 1)
    facts = facts.withColumn("prev", F.lag("t").over(cell)).join(ends, ["issuer_ip", "b"], "left").withColumn("prev", F.coalesce("prev", "end"))
    probes = without_direct_key(connections, transactions, addresses).withColumn("t", F.col("ts_ns"))
    found = last_before(probes, facts.select("issuer_ip", "t", "id"), ["issuer_ip"], delay_ns, strict=False).filter("fact_id is not null")
    found = found.join(facts.select(F.col("id").alias("fact_id"), "prev"), "fact_id")
    return found.filter(F.col("prev").isNull() | (F.col("prev") < F.col("t") - delay_ns)).select("conn_id", F.col("fact_id").alias("tx_id"), (F.col("t") - F.col("fact_t")).alias("dt_ns"))


class _Infer:
    """One run of an issuer's transactions and connections in time order."""

    def __init__(self, delay: int):
        self.delay, self.open = delay, {}  # in order of time, as rows come in it

    def step(self, row: dict) -> list:
        t = row["t"]
        while self.open and self.open[first := next(iter(self.open))] < t - self.delay:
            del self.open[first]
        if row["conn_id"] is None:
            self.open[row["tx_id"]] = t
            return []
        if len(self.open) != 1 or row["known"] and next(iter(self.open)) not in row["allowed"]:
            return []
        only = next(iter(self.open))
        return [(row["conn_id"], only, t - self.open.pop(only))]

    def end(self) -> list:
        return []


def fallback_sequential(connections: DataFrame, transactions: DataFrame, addresses: DataFrame, pairs: DataFrame, delay_ns: int = DELAY_NS) -> DataFrame:
    """(conn_id, tx_id, dt_ns) as found one after another: a transaction inferred once is resolved from then on.

    Runs of an issuer that lie more than the window apart cannot influence each other, so each run is a key of its
    own and a busy issuer is spread over its runs. The map's veto is attached to the connections beforehand.
    """
    open_ = cut(_unresolved(transactions, addresses).select("issuer_ip", F.col("req_ts_ns").alias("t"), "tx_id", canonical_name(F.col("dns_name")).alias("name")))
    probes = without_direct_key(connections, transactions, addresses)
    near = cut(probes.select("conn_id", "issuer_ip", "dst_ip", F.col("ts_ns").alias("t"), "file_idx", "pkt_idx"))
    # Where the map has names for the destination, only transactions of those names will do. Few are, so they are
    # found from the names: by name to the addresses connected to, then to connections of the issuer in the window.
    bucket = lambda c: floor_div(F.col(c), delay_ns)
    named = pairs.select(F.col("ip").alias("dst_ip"), canonical_name(F.col("dns")).alias("name")).filter("name <> ''").distinct()
    named = cut(named.join(near.select("dst_ip").distinct(), "dst_ip", "left_semi"))
    around = open_.withColumn("b", F.explode(F.array(bucket("t"), bucket("t") + 1))).join(named, "name").select("issuer_ip", "b", "dst_ip", "tx_id")
    allowed = near.withColumn("b", bucket("t")).join(around, ["issuer_ip", "b", "dst_ip"]).groupBy("conn_id").agg(F.collect_set("tx_id").alias("allowed"))
    near = near.join(named.select("dst_ip").distinct().withColumn("known", F.lit(True)), "dst_ip", "left").join(allowed, "conn_id", "left")
    near = near.withColumns({"known": F.coalesce("known", F.lit(False)), "allowed": F.coalesce("allowed", F.array().cast("array<bigint>"))})
    rows = open_.select("issuer_ip", "t", "tx_id").unionByName(near.select("issuer_ip", "t", "conn_id", "file_idx", "pkt_idx", "known", "allowed"), allowMissingColumns=True)
    runs = intervals.marked(rows.select(F.col("issuer_ip").alias("entity"), F.col("t").alias("start"), (F.col("t") + delay_ns).alias("end")), chunk=delay_ns * 720)
    rows = rows.join(runs.select(F.col("entity").alias("issuer_ip"), F.col("start").alias("t"), "island"), ["issuer_ip", "t"])
    out = pa.schema([("conn_id", pa.int64()), ("tx_id", pa.int64()), ("dt_ns", pa.int64())])
    columns = ["issuer_ip", "island", "t", "tx_id", "conn_id", "file_idx", "pkt_idx", "known", "allowed"]
    order = ["t", F.col("conn_id").isNotNull(), "file_idx", "pkt_idx", "tx_id"]
    return run_ordered(rows.select(*columns), ["issuer_ip", "island"], order, lambda: _Infer(delay_ns), "conn_id bigint, tx_id bigint, dt_ns bigint", out)


def allowed_by_map(matches: DataFrame, connections: DataFrame, transactions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Inferred matches the map does not contradict: it has no name for the address, or this very one."""
    rows = matches.join(connections.select("conn_id", "dst_ip"), "conn_id").join(transactions.select("tx_id", canonical_name(F.col("dns_name")).alias("name")), "tx_id")
    clean = pairs.select(F.col("ip").alias("dst_ip"), canonical_name(F.col("dns")).alias("name")).filter("name <> ''").distinct()
    known = clean.select("dst_ip").distinct().withColumn("known", F.lit(True))
    same = clean.withColumn("same", F.lit(True))
    rows = rows.join(known, "dst_ip", "left").join(same, ["dst_ip", "name"], "left")
    return rows.filter("known is null or same is not null").select(*matches.columns)


def best_candidates(matches: DataFrame, connections: DataFrame, only_tcp: bool = False, most: int = CANDIDATES) -> DataFrame:
    """(tx_id, port, proto): of a transaction's first candidates the closest connection, the earlier of equals."""
    rows = matches.join(connections.select("conn_id", "file_idx", "pkt_idx", "port", "proto"), "conn_id")
    rank = F.row_number().over(Window.partitionBy("tx_id").orderBy("file_idx", "pkt_idx", "conn_id"))
    rows = rows.withColumn("r", rank).filter(F.col("r") <= most)
    if only_tcp:
        rows = rows.filter("proto = 'tcp'")
    return rows.groupBy("tx_id").agg(F.min(F.struct("dt_ns", "r", "port", "proto")).alias("b")).select("tx_id", "b.port", "b.proto")


def observed(addresses: DataFrame, transactions: DataFrame, direct_matches: DataFrame, inferred: DataFrame, connections: DataFrame) -> DataFrame:
    """Addresses with evidence after the pass: known ones marked as observed, inferred ones added."""
    ips = connections.select("conn_id", F.col("dst_ip").alias("ip"))
    mark = direct_matches.join(ips, "conn_id").join(addresses.select("tx_id", "ip"), ["tx_id", "ip"], "left_semi").select("tx_id", "ip", F.lit(None).cast("int").alias("ord"), F.lit(ev.OBSERVED).alias("evidence"))
    name = F.when(F.coalesce("name_evidence", F.lit(0)) == 0, ev.DNS).otherwise(F.col("name_evidence"))
    added = inferred.join(ips, "conn_id").join(transactions.select("tx_id", name.alias("n")), "tx_id").select("tx_id", "ip", F.lit(None).cast("int").alias("ord"), F.col("n").bitwiseOR(F.lit(ev.CONN | ev.OBSERVED)).alias("evidence"))
    rows = addresses.select("tx_id", "ip", "ord", "evidence").unionByName(mark).unionByName(added)
    return rows.groupBy("tx_id", "ip").agg(F.min("ord").alias("ord"), F.bit_or("evidence").alias("evidence"))


def first_after(connections: DataFrame, transactions: DataFrame, addresses: DataFrame, chunk_ns: int = 3600 * 10**9) -> DataFrame:
    """(tx_id, conn_id, port): the first connection strictly after a request to one of its addresses, however late.

    Without a tolerance the next connection may be any time away, so what follows a chunk of time is carried back
    by one row per chunk, and no task holds all rows of a pair.
    """
    key, cell = ["issuer_ip", "dst_ip"], ["issuer_ip", "dst_ip", "chunk"]
    chunk = floor_div(F.col("t"), chunk_ns).alias("chunk")
    facts = connections.filter("issuer_ip is not null and dst_ip is not null").select(*key, F.col("ts_ns").alias("t"), F.lit(None).cast("bigint").alias("tx_id"), F.struct(F.col("ts_ns").alias("t"), "conn_id", "port").alias("c"))
    asked = transactions.filter("issuer_ip is not null").select("tx_id", "issuer_ip", F.col("req_ts_ns").alias("t")).join(addresses.select("tx_id", F.col("ip").alias("dst_ip")), "tx_id")
    both = facts.unionByName(asked, allowMissingColumns=True).select("*", chunk)
    later = Window.partitionBy(*key).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy(*cell).agg(F.min("c").alias("first")).select(*cell, F.last("first", ignorenulls=True).over(later).alias("carry"))
    # Backwards in time, of equal times the request first, then connections from the largest number down.
    inside = Window.partitionBy(*cell).orderBy(F.desc("t"), F.col("tx_id").isNull(), F.desc("c.conn_id")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("own", F.last("c", ignorenulls=True).over(inside)).filter("tx_id is not null").join(carry, cell)
    best = found.groupBy("tx_id").agg(F.min(F.coalesce("own", "carry")).alias("b")).filter("b is not null")
    return best.select("tx_id", "b.conn_id", "b.port")
