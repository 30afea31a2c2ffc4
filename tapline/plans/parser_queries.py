"""Queries of the byte parsers: rows are turned into bytes and parsed back, which SQL can follow on the rows."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions.addresses import canonical_ipv4
from tapline.operators import extract
from tapline.plans import relations as R
from tapline.plans import sqltext as S
from tapline.plans.tables import table
from tapline.session import remove_at_exit, shared_folder
from tapline.sinks import capturebytes as B
from tapline.sources import pcap

# Packets of a capture file that pcap_read writes: what a task holds in memory, and what one task reads back.
PER_FILE = 50_000
PACKETS = "file_idx int, pcap_file string, pkt_idx bigint, ts_ns bigint, truncated boolean, src_ip string, dst_ip string, l4 string, src_port int, dst_port int, payload binary"


def _as_packets(rows: DataFrame, make: Callable[[dict], tuple], truncated: bool = False) -> DataFrame:
    """Rows as packets; ``make`` gives l4, ports and payload, the row's first column numbers the packet."""
    arrow = pa.schema([("file_idx", pa.int32()), ("pcap_file", pa.string()), ("pkt_idx", pa.int64()), ("ts_ns", pa.int64()), ("truncated", pa.bool_()), ("src_ip", pa.string()), ("dst_ip", pa.string()), ("l4", pa.string()), ("src_port", pa.int32()), ("dst_port", pa.int32()), ("payload", pa.binary())])
    first = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(0, "made.pcap", r[first], 0, truncated, "10.0.0.1", "10.0.0.2", *make(r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], t.type) for t in arrow], schema=arrow)

    return rows.mapInArrow(run, PACKETS)


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions whose name can be put on the wire."""
    return R.transactions(spark, folder).filter(r"dns_name rlike '^[A-Za-z0-9_-]{1,63}([.][A-Za-z0-9_-]{1,63})*[.]?$'")


def dns_extract_bytes(spark, folder):
    rows = _named(spark, folder).select("tx_id", "dns_name")

    def make(r: dict) -> tuple:
        message = B.query(r["dns_name"].removesuffix("."), dns_id=1 + r["tx_id"] % 65535)
        return ("udp", 5000, 53, message) if r["tx_id"] % 2 else ("tcp", 5000, 53, B.framed(message))

    return extract.dns_messages(_as_packets(rows, make)).select(F.col("pkt_idx").alias("tx_id"), "dns_id", "name", "proto")


def dns_answers_bytes(spark, folder):
    """Responses with the stored addresses, as answers."""
    rows = _named(spark, folder).join(R.transaction_addresses(spark, folder), "tx_id").groupBy("tx_id", "dns_name").agg(F.array_sort(F.collect_list("ip")).alias("ips"))  # at most the addresses of one answer
    make = lambda r: ("udp", 53, 5000, B.response(r["dns_name"].removesuffix("."), r["ips"]))
    return extract.dns_messages(_as_packets(rows, make)).select(F.col("pkt_idx").alias("tx_id"), F.explode("answers").alias("ip"))


def dns_cut_query_bytes(spark, folder):
    """Queries cut in the question's type, behind the name, or one or two characters before its end."""
    make = lambda r: ("udp", 5000, 53, B.query(r["dns_name"].removesuffix("."))[: -(3, 5, 6, 7)[r["tx_id"] % 4]])
    return extract.dns_messages(_as_packets(_named(spark, folder).select("tx_id", "dns_name"), make, truncated=True)).select(F.col("pkt_idx").alias("tx_id"), "name")


def dns_cut_answers_bytes(spark, folder):
    """Responses cut within the last answer: those before it come out."""
    rows = _named(spark, folder).join(R.transaction_addresses(spark, folder), "tx_id").groupBy("tx_id", "dns_name").agg(F.array_sort(F.collect_list("ip")).alias("ips"))  # at most the addresses of one answer
    make = lambda r: ("udp", 53, 5000, B.response(r["dns_name"].removesuffix("."), r["ips"])[:-5])
    return extract.dns_messages(_as_packets(rows, make, truncated=True)).select(F.col("pkt_idx").alias("tx_id"), F.explode("answers").alias("ip"))


def radius_repeat_key(spark, folder):
    """A request and its repeat, which differ in authenticator and volatile attributes, have one key; another session has its own."""
    rows = table(spark, folder, "radius_msgs").select("recv_id", "imsi", canonical_ipv4(F.col("ip")).alias("ip"), "status")

    def made(authenticator: bytes, delay: int, session: bytes) -> DataFrame:
        def make(r: dict) -> tuple:
            vendor = (r["imsi"] or "").encode()[:200]
            attributes = [(26, (10415).to_bytes(4, "big") + bytes([1, len(vendor) + 2]) + vendor), (44, session), (40, r["status"].to_bytes(4, "big")), (41, delay.to_bytes(4, "big")), (33, bytes([delay]) * 3), (80, authenticator)]
            return "udp", 40000, 1813, B.accounting(attributes + ([(8, B.ip(r["ip"]))] if r["ip"] else []), authenticator=authenticator)

        return extract.accounting(_as_packets(rows, make)).select(F.col("pkt_idx").alias("recv_id"), "imsi", "dedup_key")

    one, again, other = made(b"a" * 16, 0, b"s1"), made(b"b" * 16, 9, b"s1"), made(b"a" * 16, 0, b"s2")
    both = one.join(again.select("recv_id", F.col("dedup_key").alias("again")), "recv_id").join(other.select("recv_id", F.col("dedup_key").alias("other")), "recv_id")
    return both.select("recv_id", "imsi", (F.col("dedup_key") == F.col("again")).cast("int").alias("same"), (F.col("dedup_key") == F.col("other")).cast("int").alias("mixed_up"))


def tls_sni_extract(spark, folder):
    make = lambda r: ("tcp", 5000, 443, B.client_hello(r["dns_name"]))
    return extract.hellos(_as_packets(_named(spark, folder).select("tx_id", "dns_name"), make)).select(F.col("pkt_idx").alias("tx_id"), "sni")


def radius_attr_decode(spark, folder):
    rows = table(spark, folder, "radius_msgs").select("recv_id", "imsi", canonical_ipv4(F.col("ip")).alias("ip"), "sid", "sess_time_sec", "status")

    def make(r: dict) -> tuple:
        wire = {1: 1, 2: 3, 3: 2}[r["status"]]
        attributes = [(1, (r["imsi"] or "").encode()), (44, (r["sid"] or "").encode()), (46, (r["sess_time_sec"] or 0).to_bytes(4, "big")), (40, wire.to_bytes(4, "big"))]
        return "udp", 40000, 1813, B.accounting(attributes + ([(8, B.ip(r["ip"]))] if r["ip"] else []))

    return extract.accounting(_as_packets(rows, make)).select(F.col("pkt_idx").alias("recv_id"), "imsi", "ip", "sid", "sess_time_sec", "status")


def pcap_read(spark, folder):
    """Queries written to capture files, each of at most ``PER_FILE`` packets, and read back through the source."""
    place = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    remove_at_exit(spark, place)
    rows = _named(spark, folder).filter(canonical_ipv4(F.col("issuer_ip")).isNotNull() & canonical_ipv4(F.col("resolver_ip")).isNotNull()).select("tx_id", "req_ts_ns", "issuer_ip", "resolver_ip", "dns_name")

    def packet(r: dict) -> tuple[int, bytes]:
        return r["req_ts_ns"], B.frame(r["issuer_ip"], r["resolver_ip"], B.udp(B.query(r["dns_name"].removesuffix(".")), 1024 + r["tx_id"] % 60000, 53), vlan=r["tx_id"] % 3 == 0)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(place) if ":" in place else (fs.LocalFileSystem(), place)
        system.create_dir(folder, recursive=True)
        n, task = 0, TaskContext.get().partitionId()
        packets = (packet(r) for batch in batches for r in extract.rows_of(batch))
        for k in itertools.count():
            some = list(itertools.islice(packets, PER_FILE))
            if not some:
                break
            n += len(some)
            with system.open_output_stream(unfinished := f"{folder}/{uuid.uuid4().hex}.part") as f:
                f.write(B.classic(some, nano=True))
            system.move(unfinished, f"{folder}/{task}-{k}.pcap")  # a task that is repeated replaces what it left
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.mapInArrow(store, "n bigint").agg(F.sum("n")).first()
    read = extract.dns_messages(pcap.read_captures(spark, place))
    return read.select("ts_ns", "issuer_ip", "src_port", "resolver_ip", "name")


NAMES = "dns_extract_bytes dns_answers_bytes dns_cut_query_bytes dns_cut_answers_bytes tls_sni_extract radius_attr_decode radius_repeat_key pcap_read"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_NAMED = f"{S.TX}, {S.TXIP}, n AS (SELECT * FROM tx WHERE regexp_full_match(dns_name, '[A-Za-z0-9_-]{{1,63}}([.][A-Za-z0-9_-]{{1,63}})*[.]?'))"
_TRIMMED = "regexp_replace(imsi, '^[' || chr(0) || '[:space:]]+|[' || chr(0) || '[:space:]]+$', '', 'g')"

_DIGITS = f"WITH a AS (SELECT *, {_TRIMMED} AS i FROM radius_msgs), b AS (SELECT *, regexp_replace(CASE WHEN strpos(i, '@') > 1 THEN split_part(i, '@', 1) ELSE i END, '[^0-9]', '', 'g') AS d FROM a)"

SQL = {
    "dns_cut_query_bytes": f"""WITH {_NAMED}, m AS (SELECT tx_id, regexp_replace(dns_name, '[.]$', '') AS w FROM n), k AS (SELECT tx_id, lower(regexp_replace(left(w, len(w) - greatest(tx_id % 4 - 1, 0)), '[.]$', '')) AS name FROM m)
SELECT tx_id, name FROM k WHERE name <> ''""",
    "dns_cut_answers_bytes": f"WITH {_NAMED}, k AS (SELECT tx_id, ip, row_number() OVER (PARTITION BY tx_id ORDER BY ip DESC) AS r FROM n JOIN tx_ip USING (tx_id)) SELECT tx_id, ip FROM k WHERE r > 1",
    "radius_repeat_key": f"{_DIGITS} SELECT recv_id, d AS imsi, 1 AS same, 0 AS mixed_up FROM b WHERE length(d) BETWEEN 14 AND 16 AND {S.ipv4('ip')} IS NOT NULL",
    "dns_extract_bytes": f"WITH {_NAMED} SELECT tx_id, CAST(1 + tx_id % 65535 AS INT) AS dns_id, {S.name('dns_name')} AS name, CASE WHEN tx_id % 2 = 1 THEN 'udp' ELSE 'tcp' END AS proto FROM n",
    "dns_answers_bytes": f"WITH {_NAMED} SELECT tx_id, ip FROM n JOIN tx_ip USING (tx_id)",
    "tls_sni_extract": f"WITH {_NAMED} SELECT tx_id, lower(dns_name) AS sni FROM n",
    "radius_attr_decode": f"""WITH a AS (SELECT *, {_TRIMMED} AS i FROM radius_msgs), b AS (SELECT *, regexp_replace(CASE WHEN strpos(i, '@') > 1 THEN split_part(i, '@', 1) ELSE i END, '[^0-9]', '', 'g') AS d FROM a)
SELECT recv_id, d AS imsi, {S.ipv4('ip')} AS ip, trim(coalesce(sid, '')) AS sid, coalesce(sess_time_sec, 0) AS sess_time_sec, status FROM b WHERE length(d) BETWEEN 14 AND 16 AND {S.ipv4('ip')} IS NOT NULL""",
    "pcap_read": f"WITH {_NAMED} SELECT req_ts_ns AS ts_ns, issuer_ip, CAST(1024 + tx_id % 60000 AS INT) AS src_port, resolver_ip, {S.name('dns_name')} AS name FROM n WHERE {S.ipv4('issuer_ip')} IS NOT NULL AND {S.ipv4('resolver_ip')} IS NOT NULL",
}
