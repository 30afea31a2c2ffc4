"""RADIUS accounting requests."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

# Ports, code, attribute numbers, vendor and its attribute, attributes that differ between repeats.
PORTS = frozenset((1812, 1813, 1645, 1646))
ACCOUNTING_REQUEST = 4
USER_NAME, FRAMED_IP, VENDOR, STATUS_TYPE, SESSION_ID, SESSION_TIME = 1, 8, 26, 40, 44, 46
VENDOR_ID, VENDOR_IMSI = 10415, 1
VOLATILE = frozenset((33, 41, 80))
# Status numbers on the wire (start, stop, interim) as message kinds.
KINDS = {1: 1, 3: 2, 2: 3}
INTERIM_KIND = 2
IMSI = re.compile(r"[0-9]{14,16}\Z")


class Accounting(NamedTuple):
    imsi: str
    ip: str
    sid: str
    sess_time_sec: int
    status: int
    dedup_key: str


def imsi_of(text: str) -> str:
    """14 to 16 digits left of the realm, or nothing."""
    bare = text.strip("\0").strip()
    if bare.find("@") > 0:
        bare = bare[: bare.index("@")]
    digits = re.sub("[^0-9]", "", bare)
    return digits if IMSI.match(digits) else ""


def _attributes(payload: bytes) -> list[tuple[int, int, int]] | None:
    """(type, start, end) of every attribute's value; None if they do not fill the packet exactly."""
    end = min(int.from_bytes(payload[2:4], "big"), len(payload))
    if len(payload) < 20 or int.from_bytes(payload[2:4], "big") > len(payload) or end < 20:
        return None
    found, at = [], 20
    while at < end:
        if at + 2 > end or payload[at + 1] < 2 or at + payload[at + 1] > end:
            return None
        found.append((payload[at], at + 2, at + payload[at + 1]))
        at += payload[at + 1]
    return found


def canonical_payload(payload: bytes) -> bytes:
    """The payload with authenticator and volatile attributes zeroed, the same for every repeat of a request."""
    if len(payload) < 20:
        return payload
    out = bytearray(payload)
    out[4:20] = bytes(16)
    at = 20
    while at + 2 <= len(out) and out[at + 1] >= 2 and at + out[at + 1] <= len(out):
        if out[at] in VOLATILE:
            out[at + 2 : at + out[at + 1]] = bytes(out[at + 1] - 2)
        at += out[at + 1]
    return bytes(out)


def accounting(payload: bytes, src_ip: str, src_port: int) -> Accounting | None:
    """The fields of an accounting request that has an address, an identity and a status."""
    if len(payload) < 20 or payload[0] != ACCOUNTING_REQUEST or (attributes := _attributes(payload)) is None:
        return None
    ip = user = vendor_imsi = sid = ""
    status = seconds = 0
    for kind, a, b in attributes:
        value = payload[a:b]
        if kind == FRAMED_IP and len(value) >= 4:
            ip = ".".join(map(str, value[:4]))
        elif kind == USER_NAME:
            user = value.decode("utf-8", "replace")
        elif kind == SESSION_ID:
            sid = value.decode("utf-8", "replace").rstrip("\0").strip()
        elif kind == STATUS_TYPE and len(value) >= 4:
            status = int.from_bytes(value[:4], "big")
        elif kind == SESSION_TIME and len(value) >= 4:
            seconds = int.from_bytes(value[:4], "big")
        elif kind == VENDOR and len(value) >= 6 and int.from_bytes(value[:4], "big") == VENDOR_ID and value[4] == VENDOR_IMSI and 2 < value[5] <= len(value) - 4:
            vendor_imsi = imsi_of(value[6 : 4 + value[5]].decode("utf-8", "replace"))
    imsi = vendor_imsi or imsi_of(user)
    if not ip or not imsi or not status:
        return None
    digest = hashlib.sha1(canonical_payload(payload)).hexdigest()
    return Accounting(imsi, ip, sid, seconds, KINDS.get(status, INTERIM_KIND), f"{payload[0]}|{payload[1]}|{src_ip}|{src_port}|{digest}")
