"""Captures as a DataFrame of packets: a Python data source with one partition per file.

``register(spark)`` makes ``spark.read.format("pcap").load(folder)`` work for folders that all executors mount and
for URIs of file systems pyarrow knows (s3, gs, hdfs, abfs, file). Files are streamed front to back in bounded
pieces, whatever their size; a capture is written in one stream whose records can only be told apart from its start,
so one file is one task, and big archives are spread by having many files. Files are found recursively by their
endings and numbered in path order. The options ``l4`` and ``ports`` (either side) keep other packets from ever
becoming rows, and ``payloads=needed`` drops the payloads no parser looks at. They are options and not pushed
filters because a data source written in Python keeps the filters of one query for the next query over the same
DataFrame.

Edge cases: a folder without captures is an error, as a run over nothing would look like an answer; a file cut off
in the middle gives the packets before that; a file that is no capture fails with its name.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tapline.parsers import capture, ftp, radius

# Fixed value: endings of capture files, case-sensitive.
ENDINGS = (".pcap", ".pcapng", ".cap")
SCHEMA = "file_idx int, pcap_file string, pkt_idx bigint, ts_ns bigint, cap_len int, orig_len int, truncated boolean, ip_version int, src_ip string, dst_ip string, l4 string, src_port int, dst_port int, tcp_flags int, payload binary"
ARROW = pa.schema([
    ("file_idx", pa.int32()), ("pcap_file", pa.string()), ("pkt_idx", pa.int64()), ("ts_ns", pa.int64()), ("cap_len", pa.int32()), ("orig_len", pa.int32()), ("truncated", pa.bool_()), ("ip_version", pa.int32()),
    ("src_ip", pa.string()), ("dst_ip", pa.string()), ("l4", pa.string()), ("src_port", pa.int32()), ("dst_port", pa.int32()), ("tcp_flags", pa.int32()), ("payload", pa.binary()),
])
BATCH = 10_000
HELLO = b"\x16"  # fixed value: how a TLS handshake record begins


def _is_uri(place: str) -> bool:
    return "://" in place or place.startswith("file:")


def discover(folder: str) -> list[str]:
    """Capture files below a folder (or the file itself), in path order."""
    if _is_uri(folder):
        system, path = fs.FileSystem.from_uri(folder)
        if system.get_file_info(path).type == fs.FileType.File:
            return [folder]
        head = folder[: len(folder) - len(path)] if folder.endswith(path) else folder[: folder.index(path.strip("/"))]
        found = sorted(head + f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(ENDINGS))
    elif os.path.isfile(folder):
        return [folder]
    else:

        def fail(error: OSError) -> None:
            raise error

        found = sorted(os.path.join(d, n) for d, _, names in os.walk(folder, onerror=fail) for n in names if n.endswith(ENDINGS))
    if not found:
        raise FileNotFoundError(f"no capture files in {folder}")
    return found


def opened(place: str):
    """A capture file to be read front to back, wherever it is."""
    if not _is_uri(place):
        return open(place, "rb")
    system, path = fs.FileSystem.from_uri(place)
    return system.open_input_stream(path, buffer_size=1 << 20)


def needs_payload(p: capture.Packet) -> bool:
    """Whether a parser would look at the packet's payload: name resolution, accounting, FTP replies, client hellos."""
    ports = {p.src_port, p.dst_port}
    return 53 in ports or p.l4 == "udp" and not ports.isdisjoint(radius.PORTS) or p.l4 == "tcp" and (p.src_port in ftp.CONTROL_PORTS or (p.payload or b"")[:1] == HELLO)


def batches(index: int, name: str, f, wanted: dict[str, frozenset] | None = None, ports: frozenset[int] = frozenset(), lean: bool = False) -> Iterator[pa.RecordBatch]:
    """Record batches of one file's packets."""
    wanted, rows = wanted or {}, []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
    for p in capture.packets(f):
        if wanted and any(getattr(p, c) not in values for c, values in wanted.items()) or ports and not ports & {p.src_port, p.dst_port}:
            continue
        if lean and not needs_payload(p):
            p = p._replace(payload=None)
        rows.append((index, name, p.pkt_idx, p.ts_ns, p.cap_len, p.orig_len, p.cap_len < p.orig_len, *p[4:]))
        if len(rows) == BATCH:
            yield make()
            rows.clear()
    if rows:
        yield make()


class _File(InputPartition):
    def __init__(self, index: int, path: str):
        self.index, self.path = index, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.wanted = options.get("path", ""), {}
        if l4 := options.get("l4"):
            self.wanted["l4"] = frozenset(x.strip() for x in l4.split(","))
        self.lean = options.get("payloads", "all") == "needed"
        self.ports = frozenset(map(int, filter(None, options.get("ports", "").split(","))))

    def partitions(self) -> list[_File]:
        return [_File(k, p) for k, p in enumerate(discover(self.folder))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            try:
                yield from batches(partition.index, os.path.basename(partition.path), f, self.wanted, self.ports, self.lean)
            except ValueError as error:
                raise ValueError(f"{partition.path}: {error}") from error


class PcapSource(DataSource):
    """The data source ``pcap``."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def read_captures(spark: SparkSession, place: str, payloads: str = "needed") -> DataFrame:
    """Packets of the captures under a folder or URI, as runs read them; a missing or empty one is an error at once."""
    discover(place)
    register(spark)
    return spark.read.format("pcap").option("payloads", payloads).load(place)
