"""Capture files, classic and next generation, as packets with addresses, ports and payload.

Files are read front to back in bounded pieces; a file cut off in the middle of a record ends there.
"""

from __future__ import annotations

import ipaddress
import socket
import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

from tapline.parsers.cursor import Cursor, Short

# Magic numbers (microseconds, nanoseconds), block types, link types, ether types, IP protocols.
MICRO, NANO, SECTION = 0xA1B2C3D4, 0xA1B23C4D, 0x0A0D0D0A
INTERFACE, SIMPLE, ENHANCED = 1, 3, 6
NULL, ETHERNET, RAW_OLD, RAW, LOOP, SLL, IPV4_LINK, IPV6_LINK, SLL2 = 0, 1, 12, 101, 108, 113, 228, 229, 276
IPV4_TYPE, IPV6_TYPE = 0x0800, 0x86DD
IPV4_BYTES, IPV6_BYTES, TAGS = b"\x08\x00", b"\x86\xdd", (b"\x81\x00", b"\x88\xa8", b"\x91\x00")
TCP, UDP = 6, 17
EXTENSIONS = (0, 43, 60)  # hop-by-hop, routing, destination options
FRAGMENT = 44
# Fixed layouts: first byte, length, fragment, protocol and addresses of an IPv4 header; ports; ports, offset and flags of TCP.
IPV4_HEADER, PORTS, TCP_HEADER = struct.Struct(">BxHxxHxBxx4s4s"), struct.Struct(">HH"), struct.Struct(">HH8xBB")


class Packet(NamedTuple):
    pkt_idx: int
    ts_ns: int
    cap_len: int
    orig_len: int
    ip_version: int | None
    src_ip: str | None
    dst_ip: str | None
    l4: str | None
    src_port: int | None
    dst_port: int | None
    tcp_flags: int | None
    payload: bytes | None


def _classic(f: BinaryIO, head: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(time, captured, original, link, data) of a classic file."""
    order = "<" if int.from_bytes(head, "little") in (MICRO, NANO) else ">"
    unit = 1 if struct.unpack(order + "I", head)[0] == NANO else 1000
    rest = f.read(20)
    if len(rest) < 20:
        return
    link = struct.unpack(order + "I", rest[16:])[0] & 0xFFFF
    while len(record := f.read(16)) == 16:
        seconds, part, captured, original = struct.unpack(order + "IIII", record)
        data = f.read(captured)
        if len(data) < captured:
            return
        yield seconds * 10**9 + part * unit, captured, original, link, data


def _resolution(options: bytes, order: str) -> tuple[int, int]:
    """(ticks per second, offset in seconds) from an interface's options."""
    ticks, offset, at = 10**6, 0, 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at : at + 4])
        value = options[at + 4 : at + 4 + size]
        if code == 0:
            break
        if code == 9 and size >= 1:
            ticks = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == 14 and size >= 8:
            offset = struct.unpack(order + "q", value[:8])[0]
        at += 4 + (size + 3) // 4 * 4
    return ticks, offset


def _next_generation(f: BinaryIO, head: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    order, interfaces, kind_bytes = "<", [], head
    while len(kind_bytes) == 4:
        size_bytes = f.read(4)
        if len(size_bytes) < 4:
            return
        if kind_bytes == SECTION.to_bytes(4, "big"):
            magic = f.read(4)
            if len(magic) < 4:
                return
            order, interfaces = ("<" if magic == b"\x4d\x3c\x2b\x1a" else ">"), []
            size = struct.unpack(order + "I", size_bytes)[0]
            f.read(max(0, size - 12))
            kind_bytes = f.read(4)
            continue
        kind, size = struct.unpack(order + "I", kind_bytes)[0], struct.unpack(order + "I", size_bytes)[0]
        block = f.read(max(0, size - 8))
        if size < 12 or len(block) < size - 8:
            return
        block = block[:-4]
        if kind == INTERFACE and len(block) >= 8:
            link, limit = struct.unpack(order + "HxxI", block[:8])
            interfaces.append((link, limit, *_resolution(block[8:], order)))
        elif kind == ENHANCED and len(block) >= 20:
            which, high, low, captured, original = struct.unpack(order + "IIIII", block[:20])
            if which < len(interfaces):
                link, _, ticks, offset = interfaces[which]
                yield ((high << 32 | low) * 10**9 // ticks) + offset * 10**9, captured, original, link, block[20 : 20 + captured]
        elif kind == SIMPLE and len(block) >= 4 and interfaces:
            original = struct.unpack(order + "I", block[:4])[0]
            captured = min(original, interfaces[0][1] or original, len(block) - 4)
            yield 0, captured, original, interfaces[0][0], block[4 : 4 + captured]
        kind_bytes = f.read(4)


def _network(link: int, data: bytes) -> Cursor:
    """A cursor at the IP header."""
    c = Cursor(data)
    if link == ETHERNET:
        c.at = 14
        while (kind := data[c.at - 2 : c.at]) in TAGS:
            c.at += 4
        c.need(kind in (IPV4_BYTES, IPV6_BYTES))
    elif link == SLL:
        c.take(14)
        c.need(c.number(2) in (IPV4_TYPE, IPV6_TYPE))
    elif link == SLL2:
        c.need(c.number(2) in (IPV4_TYPE, IPV6_TYPE))
        c.take(18)
    elif link in (NULL, LOOP):
        c.take(4)
    else:
        c.need(link in (RAW, RAW_OLD, IPV4_LINK, IPV6_LINK))
    return c


def _transport(c: Cursor) -> tuple:
    """(version, src, dst, l4, src_port, dst_port, flags, payload) from the IP header on; None where absent."""
    start, version = c.at, c.data[c.at] >> 4 if c.left() else 0
    if version == 4:
        c.need(c.left() >= IPV4_HEADER.size)
        first, total, fragment, proto, src, dst = IPV4_HEADER.unpack_from(c.data, start)
        head, src, dst = (first & 15) * 4, socket.inet_ntoa(src), socket.inet_ntoa(dst)
        c.need(head >= 20)
        c.take(head)
        if total >= head:
            c.end = min(c.end, start + total)
        whole = not fragment & 0x1FFF
    else:
        c.need(version == 6)
        c.take(4)
        size, proto, _ = c.number(2), c.number(1), c.take(1)
        src, dst = (str(ipaddress.IPv6Address(c.take(16))) for _ in range(2))
        c.end = min(c.end, c.at + size) if size else c.end
        whole = True
        while proto in EXTENSIONS:
            proto, more = c.number(1), c.number(1)
            c.take(6 + more * 8)
        if proto == FRAGMENT:
            proto, _, fragment = c.number(1), c.take(1), c.number(2)
            c.take(4)
            whole = not fragment >> 3
    nothing = (version, src, dst, None, None, None, None, None)
    if not whole or proto not in (TCP, UDP):
        return nothing
    try:
        if proto == UDP:
            src_port, dst_port = PORTS.unpack(c.take(8)[:4])
            return version, src, dst, "udp", src_port, dst_port, None, c.take(c.left())
        here = c.at
        src_port, dst_port, offset, flags = TCP_HEADER.unpack(c.take(TCP_HEADER.size))
        c.at = here
        c.take(max((offset >> 4) * 4, 20))
        return version, src, dst, "tcp", src_port, dst_port, flags, c.take(c.left())
    except Short:
        return nothing


def packets(f: BinaryIO) -> Iterator[Packet]:
    """All packets of an open capture file; nothing for a file that is none."""
    head = f.read(4)
    if len(head) < 4:
        return
    if head == SECTION.to_bytes(4, "big"):
        records = _next_generation(f, head)
    elif int.from_bytes(head, "little") in (MICRO, NANO) or int.from_bytes(head, "big") in (MICRO, NANO):
        records = _classic(f, head)
    else:
        raise ValueError("not a capture file")
    for k, (ts, captured, original, link, data) in enumerate(records):
        try:
            decoded = _transport(_network(link, data))
        except Short:
            decoded = (None,) * 8
        yield Packet(k, ts, captured, original, *decoded)
