import pytest

from tapline.operators import edges

SCHEMA = "file_idx int, pkt_idx bigint, ts_ns bigint, src_ip string, dst_ip string, l4 string, src_port int, dst_port int, tcp_flags int, payload string"
MS, S = 10**6, 10**9
A, B = "10.22.111.161", "54.154.187.160"


@pytest.fixture
def packets(spark):
    def make(items):
        return spark.createDataFrame([(0, k, t, a, b, l4, ap, bp, flags, text) for k, (t, a, b, l4, ap, bp, flags, text) in enumerate(items)], SCHEMA)

    return make


def shake(t, port, cport=6000, answer=MS):
    return [(t, A, B, "tcp", cport, port, 2, None), (t + answer, B, A, "tcp", port, cport, 18, None)]


def udp(t, a, b, ap, bp):
    return (t, a, b, "udp", ap, bp, None, None)


def found(df):
    return sorted((r.issuer_ip, r.dst_ip, r.proto, r.port) for r in df.collect())


def test_udp(packets):
    there, back = udp(0, A, B, 50234, 3000), udp(10 * MS, B, A, 3000, 50234)
    assert found(edges.udp_edges(packets([there, back]))) == [(A, B, "udp", 3000)]
    assert found(edges.udp_edges(packets([there]))) == []
    assert found(edges.udp_edges(packets([there, udp(31 * S, B, A, 3000, 50234)]))) == []
    third = packets([there, back, udp(20 * MS, A, B, 50234, 3000)])
    assert found(edges.udp_edges(third)) == [(A, B, "udp", 3000), (B, A, "udp", 50234)]
    assert found(edges.udp_edges(third, private_source=True)) == [(A, B, "udp", 3000)]
    clock = packets([udp(0, "216.239.35.4", A, 123, 41811), udp(10 * MS, A, "216.239.35.4", 41811, 123)])
    assert found(edges.udp_edges(clock, (123,))) == []


def test_handshakes(packets):
    got = edges.handshake_edges(packets(shake(0, 443) + shake(S, 8443) + shake(2 * S, 9, answer=31 * S) + [(5 * S, A, B, "tcp", 1, 80, 2, None)]))
    assert [(r.port, r.first_seen_ns) for r in got.orderBy("first_seen_ns").collect()] == [(443, 0), (8443, S)]
    assert found(edges.handshake_edges(packets(shake(0, 443)), (443,))) == []
    twice = packets([(0, A, B, "tcp", 6000, 443, 2, None), *shake(5 * S, 443)])
    assert [r.first_seen_ns for r in edges.handshake_edges(twice).collect()] == [0]


def test_midsession(packets):
    got = packets([(7, B, A, "tcp", 443, 6000, 16, None), (9, A, B, "tcp", 6000, 443, 24, None), (3, B, "1.1.1.1", "tcp", 443, 1, 16, None), (3, A, "10.0.0.1", "tcp", 1, 2, 16, None), (1, B, A, "tcp", 80, 6000, 4, None)])
    assert [(r.issuer_ip, r.dst_ip, r.port, r.first_seen_ns) for r in edges.midsession_edges(got).collect()] == [(A, B, 443, 7)]


@pytest.mark.parametrize(("reply", "data"), [("227 Entering Passive Mode (185,5,124,52,8,174)", 2222), ("229 Entering Extended Passive Mode (|||2121|)", 2121)])
def test_announced_ports(packets, reply, data):
    control = [*shake(0, 21), (S, B, A, "tcp", 21, 6000, 2**4 + 8, reply)]
    rows = packets([*control, *shake(2 * S, data, 6001), *shake(3 * S, 2223, 6002), *shake(40 * S, data + 5, 6003)])
    tcp = [e for e in found(edges.file_edges(rows)) if e[2] == "tcp"]
    assert tcp == sorted([(A, B, "tcp", 21), (A, B, "tcp", 2223), (A, B, "tcp", data + 5)])
    late = packets([*control, *shake(32 * S, data, 6001)])
    assert (A, B, "tcp", data) in found(edges.file_edges(late))
    assert (A, B, "tcp", data) in found(edges.file_edges(rows, collapse_ftp=False))


def test_high_ports_after_control(packets):
    rows = packets([*shake(0, 40000, 6001), *shake(S, 21), *shake(2 * S, 40001, 6002), *shake(3 * S, 29999, 6003)])
    assert [e[3] for e in found(edges.file_edges(rows))] == [21, 29999, 40000]
    assert [e[3] for e in found(edges.collected(rows))] == [21, 29999]


def test_merged(spark):
    rows = [(A, B, "tcp", p, 0, 1) for p in (21, 49824, 50081, 1882)] + [(A, "9.9.9.9", "tcp", 40000, 0, 1), (A, B, "udp", 40000, 0, 1)]
    df = spark.createDataFrame(rows, "issuer_ip string, dst_ip string, proto string, port int, file_idx int, first_seen_ns bigint")
    assert sorted(r.port for r in edges.without_ftp_data(df).collect()) == [21, 1882, 40000, 40000]
    later = spark.createDataFrame([(A, B, "tcp", 1, 1, 5), (A, B, "tcp", 1, 0, 9)], df.schema)
    assert [(r.file_idx, r.first_seen_ns) for r in edges.across_files(later).collect()] == [(0, 9)]


def test_empty(packets):
    assert edges.collected(packets([udp(0, A, B, 1, 2)]).limit(0)).count() == 0


def test_first_request_rule(packets):
    syn = lambda t: (t, A, B, "tcp", 6000, 443, 2, None)
    back = lambda t: (t, B, A, "tcp", 443, 6000, 18, None)
    late = packets([syn(0), syn(20 * S), back(35 * S)])
    assert [r.first_seen_ns for r in edges.handshake_edges(late).collect()] == [20 * S]
    assert edges.handshake_edges(late, first_only=True).count() == 0
    again = packets([syn(0), syn(20 * S), syn(31 * S), back(45 * S)])
    assert [r.first_seen_ns for r in edges.handshake_edges(again, first_only=True).collect()] == [31 * S]


def test_long_flow_against_brute_force(packets):
    import random

    rng = random.Random(3)
    for _ in range(4):
        events = sorted((rng.randrange(0, 400), k, rng.choice([2, 18])) for k in range(60))
        df = packets([(t * S, A, B, "tcp", 6000, 443, 2, None) if f == 2 else (t * S, B, A, "tcp", 443, 6000, 18, None) for t, _, f in events])
        rows = [(t, k, f) for k, (t, _, f) in enumerate(events)]
        want = sorted(k for t, k, f in rows if f == 18 and any(g == 2 and (u, j) < (t, k) and t - u <= 30 for u, j, g in rows))
        assert sorted(r.pkt_idx for r in edges.handshake_events(df).collect()) == want
        live = [u for u, j, g in rows if g == 2 and any(f == 18 and (t, k) > (u, j) and t - u <= 30 for t, k, f in rows)]
        assert [r.first_seen_ns for r in edges.handshake_edges(df).collect()] == ([min(live) * S] if live else [])
