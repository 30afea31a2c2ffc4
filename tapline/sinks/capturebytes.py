"""Packets and capture files byte by byte: for writing captures out, and for round trips through the parsers."""

from __future__ import annotations

import struct


def ip(text):
    return bytes(map(int, text.split(".")))


def dns_name(name):
    return b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"


def query(name, kind=1, dns_id=0x090A):
    return struct.pack(">HHHHHH", dns_id, 0x0100, 1, 0, 0, 0) + dns_name(name) + struct.pack(">HH", kind, 1)


def response(name, answers, dns_id=0x090A):
    body = struct.pack(">HHHHHH", dns_id, 0x8180, 1, len(answers), 0, 0) + dns_name(name) + struct.pack(">HH", 1, 1)
    return body + b"".join(b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + ip(a) for a in answers)


def framed(message):
    return struct.pack(">H", len(message)) + message


def client_hello(name, kind=0):
    host = name.encode()
    names = struct.pack(">BH", kind, len(host)) + host
    sni = struct.pack(">H", len(names)) + names
    extensions = struct.pack(">HH", 10, 2) + b"\0\0" + struct.pack(">HH", 0, len(sni)) + sni
    hello = b"\x03\x03" + bytes(32) + b"\x01\x07" + struct.pack(">H", 2) + b"\x13\x01" + b"\x01\0" + struct.pack(">H", len(extensions)) + extensions
    handshake = b"\x01" + len(hello).to_bytes(3, "big") + hello
    return b"\x16\x03\x01" + struct.pack(">H", len(handshake)) + handshake


def accounting(attributes, code=4, ident=7, authenticator=b"a" * 16):
    body = b"".join(bytes([t, len(v) + 2]) + v for t, v in attributes)
    return struct.pack(">BBH", code, ident, 20 + len(body)) + authenticator + body


def udp(payload, sport, dport):
    return 17, struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def tcp(payload, sport, dport, flags):
    return 6, struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + payload


def frame(src, dst, transport, vlan=False):
    proto, body = transport
    packet = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0) + ip(src) + ip(dst) + body
    return bytes(12) + (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00" + packet


def classic(packets, order="<", nano=False, link=1):
    """Packets are (ns, frame) or (ns, frame, captured)."""
    parts = [struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)]
    for ns, data, *cut in packets:
        kept = data[: cut[0]] if cut else data
        parts += (struct.pack(order + "IIII", ns // 10**9, ns % 10**9 // (1 if nano else 1000), len(kept), len(data)), kept)
    return b"".join(parts)  # adding to one bytes object would copy it for each packet


def _block(kind, body, order):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def next_generation(packets, order="<", ticks=9):
    out = _block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    out += _block(1, struct.pack(order + "HHI", 1, 0, 65535) + struct.pack(order + "HH", 9, 1) + bytes([ticks]) + bytes(3) + struct.pack(order + "HH", 0, 0), order)
    for ns, data in packets:
        t = ns * 10**ticks // 10**9
        out += _block(6, struct.pack(order + "IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(data), len(data)) + data, order)
    return out
