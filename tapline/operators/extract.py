"""Packets turned into DNS messages, client hellos and accounting messages.

Payloads are parsed in Arrow batches; protocol and ports are filtered beforehand, where the source can do it, and
payloads go no further than here. Further kinds of messages are added with ``register`` and read with ``extracted``;
runs that need other payloads than the built-in ones read their captures with all payloads. Edge cases: payloads that do not parse give no row; null payloads are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.functions.numbers import floor_div
from tapline.operators import radius as sessions
from tapline.parsers import dns, radius, tls

PLACE = ["file_idx", "pcap_file", "pkt_idx", "ts_ns"]
PLACE_SCHEMA = "file_idx int, pcap_file string, pkt_idx bigint, ts_ns bigint"
PLACE_ARROW = [("file_idx", pa.int32()), ("pcap_file", pa.string()), ("pkt_idx", pa.int64()), ("ts_ns", pa.int64())]


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch of numbers, truth values, texts and bytes, several times as fast as ``to_pylist``; through NumPy, which would make floats of numbers beside nulls."""
    columns = [c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns]
    return (dict(zip(batch.schema.names, values, strict=True)) for values in zip(*columns, strict=True))


def _parsed(packets: DataFrame, row: Callable[[dict], tuple | None], schema: str, arrow: list) -> DataFrame:
    full = pa.schema(PLACE_ARROW + arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tuple(p[c] for c in PLACE) + r for p in rows_of(batch) if (r := row(p)) is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), full, strict=True)], schema=full)

    columns = [*PLACE, "truncated", "src_ip", "dst_ip", "l4", "src_port", "dst_port", "payload"]
    return packets.filter("payload is not null and src_ip is not null").select(*columns).mapInArrow(run, f"{PLACE_SCHEMA}, {schema}")


def _port(ports: tuple[int, ...]) -> Column:
    return F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)


@dataclass(frozen=True)
class Extractor:
    """One kind of message: which packets to look at, and what a packet gives.

    ``row`` gets a packet as a dict and returns a tuple of the columns in ``schema``, whose Arrow types are ``arrow``,
    or None.
    """

    name: str
    wanted: Callable[[], Column]
    row: Callable[[dict], tuple | None]
    schema: str
    arrow: list[tuple[str, pa.DataType]]


EXTRACTORS: dict[str, Extractor] = {}


def register(extractor: Extractor) -> Extractor:
    """Make a kind of message known by its name; a name is given once."""
    if extractor.name in EXTRACTORS:
        raise ValueError(f"there is an extractor {extractor.name!r} already")
    EXTRACTORS[extractor.name] = extractor
    return extractor


def extracted(packets: DataFrame, name: str) -> DataFrame:
    """The messages of a registered kind, after the packet's place."""
    e = EXTRACTORS[name]
    return _parsed(packets.filter(e.wanted()), e.row, e.schema, e.arrow)


def _dns(p: dict) -> tuple | None:
    m = dns.parse(p["payload"], p["l4"], p["src_port"], p["dst_port"], bool(p["truncated"]))
    if m is None:
        return None
    asked = (p["src_ip"], p["src_port"], p["dst_ip"]) if m.query else (p["dst_ip"], p["dst_port"], p["src_ip"])
    return (m.query, *asked, p["l4"], m.dns_id, m.name, m.answers)


def _hello(p: dict) -> tuple | None:
    name = tls.server_name(p["payload"])
    return (p["src_ip"], p["dst_ip"], p["dst_port"], name) if name and p["dst_port"] else None


def _accounting(p: dict) -> tuple | None:
    return radius.accounting(p["payload"], p["src_ip"], p["src_port"])


register(Extractor(
    "dns", lambda: _port((53,)), _dns, "is_query boolean, issuer_ip string, src_port int, resolver_ip string, proto string, dns_id int, name string, answers array<string>",
    [("is_query", pa.bool_()), ("issuer_ip", pa.string()), ("src_port", pa.int32()), ("resolver_ip", pa.string()), ("proto", pa.string()), ("dns_id", pa.int32()), ("name", pa.string()), ("answers", pa.list_(pa.string()))],
))
register(Extractor(
    "hello", lambda: F.expr("l4 = 'tcp' and not truncated and hex(substring(payload, 1, 1)) = '16'"), _hello, "issuer_ip string, dst_ip string, port int, sni string",
    [("issuer_ip", pa.string()), ("dst_ip", pa.string()), ("port", pa.int32()), ("sni", pa.string())],
))
register(Extractor(
    "accounting", lambda: (F.col("l4") == "udp") & _port(tuple(sorted(radius.PORTS))), _accounting, "imsi string, ip string, sid string, sess_time_sec bigint, status int, dedup_key string",
    [("imsi", pa.string()), ("ip", pa.string()), ("sid", pa.string()), ("sess_time_sec", pa.int64()), ("status", pa.int32()), ("dedup_key", pa.string())],
))


def dns_messages(packets: DataFrame) -> DataFrame:
    """Queries and responses; issuer and resolver as seen from the query, whichever way the packet went."""
    return extracted(packets, "dns")


def hellos(packets: DataFrame) -> DataFrame:
    """Client hellos with a server name; cut packets are left alone."""
    return extracted(packets, "hello")


def accounting(packets: DataFrame) -> DataFrame:
    """Accounting messages before repeats are dropped."""
    return extracted(packets, "accounting")


def deduplicated_accounting(packets: DataFrame) -> DataFrame:
    """(imsi, ip, sid, ts_ms, sess_time_sec, status) without retransmissions."""
    rows = accounting(packets).withColumns({"row": F.col("file_idx").cast("bigint") * F.lit(1 << 40) + F.col("pkt_idx"), "ts_ms": floor_div(F.col("ts_ns"), 1_000_000)})
    kept = sessions.first_in_window(rows, F.col("dedup_key"), F.col("ts_ms"), "row")
    return rows.join(kept, "row", "left_semi").select("imsi", "ip", "sid", "ts_ms", "sess_time_sec", "status")
