"""Reports as single text files, the form people and scripts read them in.

Rows come sorted from Spark and stream through the driver one partition at a time; column widths are one small
aggregation beforehand. The scalable twin of every report is its DataFrame, to be written with ``write.parquet``.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Iterator, Sequence
from datetime import UTC, datetime
from itertools import groupby
from typing import TextIO

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tapline.functions.addresses import ipv4_value


def rows(df: DataFrame) -> Iterator[Row]:
    return df.toLocalIterator(prefetchPartitions=True)


def rfc3339(ns: int | None) -> str:
    """UTC time with as many digits of the second as are not zero; empty without a time."""
    if not ns:
        return ""
    whole, part = divmod(ns, 10**9)
    digits = f".{part:09d}".rstrip("0").rstrip(".") if part else ""
    return datetime.fromtimestamp(whole, UTC).strftime("%Y-%m-%dT%H:%M:%S") + digits + "Z"


def widths(df: DataFrame, columns: Sequence[str], headers: Sequence[str]) -> list[int]:
    """Widest cell of each column, at least the header."""
    sized = df.agg(*[F.max(F.octet_length(F.col(c).cast("string"))).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [max(len(h), sized[k] or 0) for k, h in enumerate(headers)]


def _line(out: TextIO, cells: Iterable, sizes: Sequence[int]) -> None:
    out.write("  ".join(str(c) + " " * (w - len(str(c).encode())) for c, w in zip(cells, sizes, strict=True)) + "\n")


def aligned(out: TextIO, df: DataFrame, columns: Sequence[str], headers: Sequence[str], empty: str, stack: str = "", gap: bool = False, closing: bool = True) -> None:
    """A table with aligned columns. Repeats of ``stack`` are left blank; with ``gap`` its groups are set apart."""
    shown = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    first = True
    for key, group in groupby(rows(shown), key=lambda r: r[stack] if stack else None):
        if first:
            sizes = widths(shown, columns, headers)
            _line(out, headers, sizes)
            _line(out, ("-" * w for w in sizes), sizes)
        elif gap:
            out.write("\n")
        for k, row in enumerate(group):
            _line(out, ["" if c == stack and k else row[c] for c in columns], sizes)
        first = False
    if first:
        out.write(empty + "\n")
    elif closing:
        out.write("\n" if gap else "")
        _line(out, ("-" * w for w in sizes), sizes)


MAIN_HEADERS = ("Request Time", "Issuer IP", "DNS Name", "Resolved IP(s)", "Source", "Resolver IP", "Port")


def _stacked(record: Row) -> Iterator[tuple]:
    """One table line per address, the rest of the record on the first."""
    ips = record.resolved_ips.split(";") if record.resolved_ips else [""]
    sources = dict(s.split("=", 1) for s in record.resolved_ip_sources.split(";") if s)
    yield record.request_time, record.issuer_ip, record.dns_name, ips[0], sources.get(ips[0], ""), record.resolver_ip or "", record.destination_port
    for ip in ips[1:]:
        yield "", "", "", ip, sources.get(ip, ""), "", ""


def main_table(out: TextIO, records: DataFrame, stats: Row) -> None:
    longest = records.agg(
        F.max(F.length("request_time")), F.max(F.octet_length("issuer_ip")), F.max(F.octet_length("dns_name")), F.max(F.array_max(F.transform(F.split("resolved_ips", ";"), F.length))),
        F.max(F.array_max(F.transform(F.split("resolved_ip_sources", ";"), lambda x: F.length(F.substring_index(x, "=", -1))))), F.max(F.length("resolver_ip")), F.max(F.length(F.col("destination_port").cast("string"))),
    ).first()
    sizes = [max(len(h), n or 0) for h, n in zip(MAIN_HEADERS, longest, strict=True)]
    put = lambda cells: out.write("|" + "".join(f" {c}{' ' * (w - len(str(c).encode()))} |" for c, w in zip(cells, sizes, strict=True)) + "\n")
    put(MAIN_HEADERS)
    out.write("|" + "".join("-" * (w + 2) + "|" for w in sizes) + "\n")
    for record in rows(records):
        for cells in _stacked(record):
            put(cells)
    out.write(f"\nStats:\n  Unique source IPs:        {stats.unique_sources}\n  Unique destination IPs:   {stats.unique_dest_ips}\n  Unique DNS with traffic:  {stats.unique_connected_dns}\n\n")


def json_array(out: TextIO, items: Iterable[dict]) -> None:
    """An indented array, written item by item; angle brackets and ampersands escaped."""
    first = True
    for item in items:
        text = json.dumps(item, indent=2, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
        out.write(("[\n  " if first else ",\n  ") + text.replace("\n", "\n  "))
        first = False
    out.write("[]\n" if first else "\n]\n")


def record_items(records: DataFrame) -> Iterator[dict]:
    for r in rows(records):
        item = {"request_time": r.request_time, "issuer_ip": r.issuer_ip, "dns_name": r.dns_name, "resolved_ips": r.resolved_ips.split(";") if r.resolved_ips else None}
        if r.resolved_ip_sources and (sources := {k: v for k, _, v in (s.partition("=") for s in r.resolved_ip_sources.split(";")) if v}):
            item["resolved_ip_sources"] = dict(sorted(sources.items()))
        if r.resolver_ip:
            item["resolver_ip"] = r.resolver_ip
        yield item | {"destination_port": r.destination_port}


def records_csv(out: TextIO, records: DataFrame) -> None:
    w = csv.writer(out, lineterminator="\n")
    columns = ["request_time", "issuer_ip", "dns_name", "resolved_ips", "resolver_ip", "destination_port"]
    w.writerow(columns)
    for r in rows(records):
        w.writerow(["" if r[c] is None else r[c] for c in columns])


def topology_json(out: TextIO, matrix: DataFrame) -> None:
    out.write('{\n  "version": 1,\n  "entries": ')
    first = True
    for r in rows(matrix):
        item = {"issuer_ip": r.issuer, "destination_ip": r.dst, "dns_name": r.dns_name, "dns_source": r.dns_source, "protocol": r.proto, "port": r.port}
        if r.observed_ns:
            item["observed_at_utc"] = rfc3339(r.observed_ns)
        out.write(("[\n    " if first else ",\n    ") + json.dumps(item, indent=2, ensure_ascii=False).replace("\n", "\n    "))
        first = False
    out.write("[]\n}\n" if first else "\n  ]\n}\n")


def external_endpoints(out: TextIO, members: DataFrame) -> None:
    """Blocks per suffix from rows (suffix, kind, value), then all ports seen.

    Ports come first, then names, then addresses, and are written as they come; only ports are remembered.
    """
    value = F.when(F.col("kind").isin("tcp", "udp"), F.lpad("value", 5, "0")).otherwise(F.col("value"))
    place = F.when(F.col("kind") == "name", 1).when(F.col("kind") == "ip", 2).otherwise(0)
    everywhere: dict[str, set[int]] = {"udp": set(), "tcp": set()}
    for suffix, group in groupby(rows(members.withColumn("place", place).orderBy("suffix", "place", "kind", value)), key=lambda r: r.suffix):
        out.write(f'- id: "svc_{suffix}"\n  group: "{suffix}"\n  match: {{ dns_suffix: "{suffix}" }}\n  listeners:\n')
        behind = ["top_dns_seen", "sample_ips"]

        def begin(what: str) -> None:
            """Start the list ``what``, with the lists before it empty if they did not come."""
            while behind:
                if len(behind) == 2:
                    out.write('  ip_churn_expected: true\n  grouping_key: ["dns_suffix", "proto", "dst_port"]\n  observations:\n')
                now = behind.pop(0)
                out.write(f"    {now}: [")
                if now == what:
                    return
                out.write("]\n")

        for kind, some in groupby(group, key=lambda r: r.kind):
            if kind in ("name", "ip"):
                begin("top_dns_seen" if kind == "name" else "sample_ips")
                for k, r in enumerate(some):
                    out.write((", " if k else "") + f'"{r.value}"')
                out.write("]\n")
            else:
                ports = [r.value for r in some]
                out.write(f'    - {{ proto: "{kind}", port: [{",".join(ports)}] }}\n')
                everywhere.setdefault(kind, set()).update(map(int, ports))
        begin("")
        out.write("\n")
    out.write("\n# Observed destination ports (global)\n")
    for proto in ("udp", "tcp"):
        if everywhere[proto]:
            out.write(f'- {{ proto: "{proto}", port: [{",".join(map(str, sorted(everywhere[proto])))}] }}\n')


def append_pairs(path: str, pairs: Iterable[Row]) -> int:
    """Append ``dns,ip`` lines to a map file, after a missing line end; how many."""
    n = 0
    with open(path, "a+b") as f:
        f.seek(0, 2)
        if f.tell():
            f.seek(-1, 2)
            missing = f.read(1) != b"\n"
        else:
            missing = False
        for p in pairs:
            f.write((("\n" if missing else "") + f"{p.dns},{p.ip}\n").encode())
            missing, n = False, n + 1
    return n


def sorted_maps(pairs: DataFrame, by_name: TextIO, by_address: TextIO, ambiguous: TextIO, first: Iterable[str] = ()) -> None:
    """A map (ip, dns) in three orders: ``dns,ip`` lines, ``ip,dns`` lines by address, and the addresses with more
    than one name as ``ip,count,a|b``. Lines of ``first`` stand above each.

    Names of an address are counted beforehand and written as they come, so none is gathered in memory.
    """
    distinct = pairs.select("ip", "dns").distinct()
    above = False
    for line in first:
        above = True
        for out in (by_name, by_address, ambiguous):
            out.write(f"{line}\n")
    if above and not distinct.isEmpty():
        for out in (by_name, by_address, ambiguous):
            out.write("\n")
    place = ipv4_value(F.col("ip"))
    for row in rows(distinct.orderBy("dns", place, "ip")):
        by_name.write(f"{row.dns},{row.ip}\n")
    counted = distinct.join(distinct.groupBy("ip").agg(F.count(F.lit(1)).alias("n")), "ip")
    for (ip, n), group in groupby(rows(counted.orderBy(place, "ip", "dns")), key=lambda r: (r.ip, r.n)):
        lead = f"{ip},{n},"
        for row in group:
            by_address.write(f"{ip},{row.dns}\n")
            if n > 1:
                ambiguous.write(lead + row.dns)
                lead = "|"
        if n > 1:
            ambiguous.write("\n")
