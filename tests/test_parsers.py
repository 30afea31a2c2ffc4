import io

import pytest

from tapline.parsers import capture, dns, radius, tls
from tapline.sinks.capturebytes import accounting, classic, client_hello, framed, frame, next_generation, query, response, tcp, udp

LONG = "a293ycymj5u8y6-ats.iot.eu-west-1.amazonaws.com"


def test_query_whole():
    assert dns.parse(query("A.Example"), "udp", 5000, 53, False) == dns.Message(True, 0x090A, "a.example", [])
    assert dns.parse(framed(query("a.example")), "tcp", 5000, 53, False).name == "a.example"
    assert dns.parse(query("a.example", kind=28), "udp", 5000, 53, True) is None
    assert dns.parse(query("a.example"), "udp", 5000, 5353, False) is None
    assert dns.parse(b"", "udp", 5000, 53, True) is None and dns.parse(b"\0" * 5, "udp", 5000, 53, True) is None


def test_query_cut():
    cut = query(LONG)[:-6]
    assert dns.parse(cut, "udp", 5000, 53, True).name.endswith(".amazonaws.co")
    assert dns.parse(cut, "udp", 5000, 53, False) is None
    assert dns.salvaged_query(framed(query(LONG))[:-3], "tcp").name.startswith("a293")
    assert dns.salvaged_query(query(LONG, kind=28), "udp") is None
    assert dns.salvaged_query(response(LONG, ["1.2.3.4"]), "udp") is None
    assert dns.salvaged_query(query("a.b c"), "udp") is None  # not a character of names


def test_response():
    whole = dns.parse(response("api.store.test", ["80.72.142.122", "80.72.142.123"]), "udp", 53, 5000, False)
    assert whole == dns.Message(False, 0x090A, "api.store.test", ["80.72.142.122", "80.72.142.123"])
    cut = response("api.store.test", ["80.72.142.122", "80.72.142.123"])[:-2]
    assert dns.parse(cut, "udp", 53, 5000, True).answers == ["80.72.142.122"]
    assert dns.parse(cut, "udp", 53, 5000, False) is None
    assert dns.salvaged_response(query("a.example"), "udp") is None
    assert dns.parse(response("a.example", ["1.2.3.4"], dns_id=0), "udp", 53, 5000, False) is None
    assert dns.parse(response("a.example", []), "udp", 53, 5000, False) is None


@pytest.mark.parametrize("keep", range(0, 60, 7))
def test_no_cut_raises(keep):
    for message in (query(LONG), response(LONG, ["1.2.3.4"]), client_hello("a.example"), accounting([(1, b"x")])):
        dns.parse(message[:keep], "udp", 53, 53, True)
        tls.server_name(message[:keep])
        radius.accounting(message[:keep], "1.1.1.1", 1813)


def test_server_name():
    assert tls.server_name(client_hello(" API.Example ")) == "api.example"
    assert tls.server_name(client_hello("a.example")[:-1]) is None
    assert tls.server_name(client_hello("a.example", kind=1)) is None
    assert tls.server_name(b"\x17" + client_hello("a.example")[1:]) is None


def test_accounting():
    vsa = (10415).to_bytes(4, "big") + b"\x01" + bytes([2 + 15]) + b"001010123456789"
    attributes = [(1, b"999990123456789@r"), (8, bytes([10, 1, 2, 3])), (26, vsa), (40, (1).to_bytes(4, "big")), (44, b"ab \0"), (46, (60).to_bytes(4, "big"))]
    got = radius.accounting(accounting(attributes), "9.9.9.9", 40000)
    assert got[:5] == ("001010123456789", "10.1.2.3", "ab", 60, 1)
    assert radius.accounting(accounting(attributes[:2] + attributes[3:]), "9.9.9.9", 1)[0] == "999990123456789"
    again = radius.accounting(accounting([*attributes], authenticator=b"b" * 16), "9.9.9.9", 40000)
    assert again.dedup_key == got.dedup_key
    late = [radius.accounting(accounting([*attributes, (41, bytes([0, 0, 0, d]))]), "9.9.9.9", 40000).dedup_key for d in (1, 2)]
    assert late[0] == late[1] != got.dedup_key
    assert radius.accounting(accounting(attributes, code=1), "9.9.9.9", 1) is None
    assert radius.accounting(accounting(attributes[:3]), "9.9.9.9", 1) is None
    assert [radius.accounting(accounting([*attributes[:3], (40, s.to_bytes(4, "big"))]), "9.9.9.9", 1).status for s in (1, 2, 3, 7)] == [1, 3, 2, 2]


PACKETS = [(1_700_000_000_000_001_000, frame("10.0.0.1", "1.2.3.4", udp(b"hi", 5, 53))), (1_700_000_001_000_000_000, frame("1.2.3.4", "10.0.0.1", tcp(b"yo", 443, 6, 18), vlan=True))]


@pytest.mark.parametrize("data", [classic(PACKETS), classic(PACKETS, ">"), classic(PACKETS, nano=True), next_generation(PACKETS), next_generation(PACKETS, ">"), next_generation(PACKETS, ticks=6)])
def test_capture_formats(data):
    one, two = capture.packets(io.BytesIO(data))
    assert one == (0, PACKETS[0][0], len(PACKETS[0][1]), len(PACKETS[0][1]), 4, "10.0.0.1", "1.2.3.4", "udp", 5, 53, None, b"hi")
    assert two[5:] == ("1.2.3.4", "10.0.0.1", "tcp", 443, 6, 18, b"yo")
    assert len(list(capture.packets(io.BytesIO(data[:-3])))) == 1  # cut off in the last record


def test_capture_oddities():
    assert list(capture.packets(io.BytesIO(b""))) == []
    with pytest.raises(ValueError, match="not a capture"):
        list(capture.packets(io.BytesIO(b"PK\x03\x04 and more")))
    arp = bytes(12) + b"\x08\x06" + bytes(28)
    short = frame("10.0.0.1", "1.2.3.4", udp(b"", 5, 53))[:30]
    assert [p.l4 for p in capture.packets(io.BytesIO(classic([(0, arp), (1, short), (2, b"")])))] == [None, None, None]
    raw = frame("10.0.0.1", "1.2.3.4", udp(b"x", 5, 53))[14:]
    assert next(capture.packets(io.BytesIO(classic([(0, raw)], link=101)))).payload == b"x"
    v6 = bytes([0x60, 0, 0, 0, 0, 9, 17, 64]) + bytes(15) + b"\1" + bytes(15) + b"\2" + udp(b"x", 5, 53)[1]
    assert next(capture.packets(io.BytesIO(classic([(0, v6)], link=101))))[4:10] == (6, "::1", "::2", "udp", 5, 53)
