"""Asking resolvers for names that captures left without an address. Off unless asked for.

Names are folded to one row each and resolved in partitions, at most WORKERS of them at a time, so that resolvers
are not flooded. The lookup is a plain function (name, servers) -> addresses and can be replaced, as in tests.

Edge cases: names that are not well-formed are not asked for; a failed lookup gives no address; no names, no rows.
"""

from __future__ import annotations

import random
import socket
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.functions import evidence as ev
from tapline.functions.addresses import canonical_ipv4
from tapline.functions.names import canonical_name, is_resolvable
from tapline.parsers import dns

WORKERS, TIMEOUT_S = 32, 10.0


def lookup(name: str, servers: tuple[str, ...]) -> list[str]:
    """IPv4 addresses of a name from the first server that answers."""
    question = struct.pack(">HHHHHH", random.randrange(1, 65536), 0x0100, 1, 0, 0, 0) + b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0" + struct.pack(">HH", dns.TYPE_A, dns.CLASS_IN)
    for server in servers:
        try:
            with socket.socket(socket.AF_INET6 if ":" in server else socket.AF_INET, socket.SOCK_DGRAM) as s:
                s.settimeout(TIMEOUT_S)
                s.sendto(question, (server, 53))
                answer = dns.parse(s.recv(4096), "udp", 53, 40000, False)
                return answer.answers if answer and answer.dns_id == int.from_bytes(question[:2], "big") else []
        except OSError:
            continue
    return []


def resolved(transactions: DataFrame, addresses: DataFrame, servers: tuple[str, ...], ask: Callable[[str, tuple[str, ...]], list[str]] = lookup) -> DataFrame:
    """(tx_id, ip, ord, evidence) for transactions whose name has no address in any transaction."""
    tx = transactions.select("tx_id", canonical_name(F.col("dns_name")).alias("name"))
    known = tx.join(addresses.select("tx_id").distinct(), "tx_id", "left_semi").select("name").distinct()
    open_ = tx.join(known, "name", "left_anti").filter(is_resolvable(F.col("name")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(batch.column("name").to_pylist()):
                ips = list(dict.fromkeys(ask(name, servers[k % len(servers) :] + servers[: k % len(servers)])))
                if ips:
                    yield pa.RecordBatch.from_pydict({"name": [name] * len(ips), "ip": ips, "ord": list(range(len(ips)))}, schema=pa.schema([("name", pa.string()), ("ip", pa.string()), ("ord", pa.int32())]))

    found = open_.select("name").distinct().repartition(WORKERS).mapInArrow(run, "name string, ip string, ord int")
    found = found.withColumn("ip", canonical_ipv4(F.col("ip"))).filter("ip is not null")
    return open_.join(found, "name").select("tx_id", "ip", "ord", F.lit(ev.ACTIVE).alias("evidence"))
