"""DNS messages from payloads, whole or cut off by the capture.

``parse`` gives one message per payload. A message that decodes is taken as it stands; where the capture cut the
packet, a name or the answers that are still complete are salvaged.
"""

from __future__ import annotations

import re
import struct
from typing import NamedTuple

from tapline.parsers.cursor import Cursor, Short

# Record type A, class IN, the response bit, and what a salvaged label may consist of.
TYPE_A, CLASS_IN, RESPONSE = 1, 1, 0x8000
LABEL = re.compile(rb"[A-Za-z0-9_-]+\Z")
MAX_LABELS = 128
HEADER = struct.Struct(">HHHH4x")  # fixed layout: id, flags, number of questions and of answers


class Message(NamedTuple):
    query: bool
    dns_id: int
    name: str
    answers: list[str]


def canonical(name: str) -> str:
    return name.removesuffix(".").strip().lower()


def body(payload: bytes, proto: str) -> bytes:
    """The message without the length that precedes it over TCP; a longer payload is clipped to that length."""
    if proto != "tcp":
        return payload
    if len(payload) < 3 or not (size := int.from_bytes(payload[:2], "big")):
        return b""
    return payload[2 : 2 + size]


def _name(c: Cursor) -> str:
    """A name with compression pointers followed; the cursor ends behind it."""
    data, at, end, labels, jumps = c.data, c.at, c.end, [], 0
    while True:
        c.need(at < end)
        size, at = data[at], at + 1
        if size == 0:
            break
        if size >= 0xC0:
            c.need(at < end)
            target, at = (size & 0x3F) << 8 | data[at], at + 1
            if not jumps:
                c.at = at
            jumps += 1
            c.need(jumps < MAX_LABELS and target < len(data))
            at, end = target, len(data)
            continue
        c.need(size < 64 and len(labels) < MAX_LABELS and at + size <= end)
        labels.append(data[at : at + size])
        at += size
    if not jumps:
        c.at = at
    return b".".join(labels).decode("latin-1")


def _skip_name(c: Cursor) -> None:
    for _ in range(MAX_LABELS):
        size = c.number(1)
        if size == 0:
            return
        if size >= 0xC0:
            c.take(1)
            return
        c.need(size < 64)
        c.take(size)
    raise Short


def _records(c: Cursor, count: int) -> list[str]:
    """IPv4 addresses of the next records, up to the first that is not complete."""
    found = []
    try:
        for _ in range(count):
            _skip_name(c)
            kind, cls = c.number(2), c.number(2)
            c.take(4)
            data = c.take(c.number(2))
            if kind == TYPE_A and cls == CLASS_IN and len(data) == 4:
                found.append(".".join(map(str, data)))
    except Short:
        pass
    return found


def _decoded(msg: bytes) -> tuple[Message, int] | None:
    """The message and its first question's type (0 without question), or None if it does not decode as a whole."""
    c = Cursor(msg)
    try:
        dns_id, flags, questions, answers = HEADER.unpack(c.take(HEADER.size))
        name, kind = "", 0
        for k in range(questions):
            asked, asked_kind = _name(c), c.number(2)
            c.take(2)
            if k == 0:
                name, kind = asked, asked_kind
        found = []
        for _ in range(answers):
            _skip_name(c)
            rr, cls = c.number(2), c.number(2)
            c.take(4)
            data = c.take(c.number(2))
            if rr == TYPE_A and cls == CLASS_IN and len(data) == 4:
                found.append(".".join(map(str, data)))
    except Short:
        return None
    return Message(not flags & RESPONSE, dns_id, canonical(name), found), kind


def _salvaged_name(c: Cursor) -> tuple[str, bool]:
    """(name, complete): labels as far as they go, the last perhaps in part; pointers are not allowed here."""
    labels: list[bytes] = []
    for _ in range(MAX_LABELS):
        if not c.left():
            c.need(bool(labels))
            return b".".join(labels).decode().lower(), False
        size = c.number(1)
        if size == 0:
            c.need(bool(labels))
            return b".".join(labels).decode().lower(), True
        c.need(size < 64)
        if size > c.left():
            part = c.take(c.left())
            if LABEL.match(part):
                labels.append(part)
            c.need(bool(labels))
            return b".".join(labels).decode().lower(), False
        label = c.take(size)
        c.need(bool(LABEL.match(label)))
        labels.append(label)
    raise Short


def salvaged_query(payload: bytes, proto: str, truncated: bool = True) -> Message | None:
    """Id and name of an A query whose packet was cut."""
    c = Cursor(body(payload, proto))
    try:
        dns_id, flags, questions = c.number(2), c.number(2), c.number(2)
        c.take(6)
        c.need(not flags & RESPONSE and questions > 0)
        name, complete = _salvaged_name(c)
        if c.left() >= 4:
            c.need(c.number(2) == TYPE_A)
        else:
            c.need(truncated or not complete)
    except Short:
        return None
    return Message(True, dns_id, canonical(name), [])


def salvaged_response(payload: bytes, proto: str, truncated: bool = True) -> Message | None:
    """Id, name and the complete answers of a response whose packet was cut; None without any answer."""
    c = Cursor(body(payload, proto))
    try:
        dns_id, flags, questions, answers = (c.number(2) for _ in range(4))
        c.take(4)
        c.need(bool(flags & RESPONSE) and answers > 0)
        name = ""
        for k in range(questions):
            start = c.at
            try:
                asked, _ = _salvaged_name(c)
            except Short:
                c.need(k == 0 and truncated)
                c.at = start
                break
            name = canonical(asked) if k == 0 else name
            c.take(4)
    except Short:
        return None
    found = _records(c, answers)
    return Message(False, dns_id, name, found) if found else None


def parse(payload: bytes, proto: str, src_port: int, dst_port: int, truncated: bool) -> Message | None:
    """The A query or the answering response in a payload to or from port 53; None for anything else."""
    if not payload or 53 not in (src_port, dst_port):
        return None
    decoded = _decoded(body(payload, proto))
    if decoded and decoded[0].query and decoded[1]:
        return decoded[0] if decoded[1] == TYPE_A and decoded[0].name else None
    if truncated and dst_port == 53 and (not decoded or decoded[0].query) and (found := salvaged_query(payload, proto)):
        return found
    is_response = decoded and not decoded[0].query
    if not is_response and not (truncated and src_port == 53):
        return None
    dns_id, name, answers = (decoded[0].dns_id, decoded[0].name, list(decoded[0].answers)) if is_response else (0, "", [])
    if truncated and src_port == 53 and (more := salvaged_response(payload, proto)):
        dns_id, name, answers = dns_id or more.dns_id, name or more.name, answers + more.answers
    return Message(False, dns_id, name, answers) if dns_id and answers else None
