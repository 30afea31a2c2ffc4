import io

import pytest
from pyspark.sql import functions as F

from tapline.functions import addresses, evidence, hashing, names, subscribers
from tapline.functions.numbers import floor_div
from tapline.operators import namemap, reports
from tapline.parsers import ftp
from tapline.sinks import text

CASES = [
    (names.canonical_name, {"A.Example.": "a.example", " x ": "x", "x. ": "x.", "x..": "x.", "": "", None: None}),
    (names.canonical_name_trim_first, {"x. ": "x", " X.": "x", None: None}),
    (names.looks_resolvable, {"a.b": True, "localhost": False, "x.lan": False, "x.local": False, "ab": False, "_a.b": False, "": False, None: False}),
    (names.is_resolvable, {"a.b": True, "a.lan": True, "-a.b": False, "a-.b": False, "a_b.c": False, "ab": False, "a..b": False, "x" * 64 + ".b": False, "x" * 63 + ".b": True, None: False}),
    (names.looks_like_time_server, {"time.esa.int": True, "ntp.ubuntu.com": True, "ntp1.google.com": True, "time1.facebook.com": True, "0.pool.ntp.org": True, "foo-timesync-bar.example.com": True, "ntp-a.x": True, "ntp-.x": False,
                                    "api.mobilepay.dk": False, "rtlgermany.payment.banksys.be": False, "timestamp.api.example.com": False, "x.chronyd": True, "": False, None: False}),
    (names.name_suffix, {"a.b.Example.": "b.example", "x": "", "a.b": "a.b"}),
    (addresses.canonical_ipv4, {" 1.2.3.4 ": "1.2.3.4", "::ffff:1.2.3.4": "1.2.3.4", "::FFFF:1.2.3.4": "1.2.3.4", "01.2.3.4": None, "1.2.3.256": None, "1.2.3": None, "::1": None, "": None, None: None}),
    (addresses.is_rfc1918, {"10.1.1.1": True, "172.16.0.1": True, "172.31.0.1": True, "172.32.0.1": False, "192.168.1.1": True, "100.64.0.1": False, "1.1.1.1": False, "x": False, None: False}),
    (addresses.is_local, {"100.64.0.1": True, "100.127.255.255": True, "100.128.0.1": False, "100.63.0.1": False, "10.0.0.1": True, "110.0.0.1": False}),
    (addresses.is_public, {"1.1.1.1": True, "203.0.113.9": False, "192.0.2.1": False, "198.51.100.1": False, "224.0.0.1": False, "239.1.1.1": False, "240.0.0.1": True, "169.254.1.1": False, "0.1.1.1": False, "127.0.0.1": False, "100.64.0.1": False, "x": False, None: False}),
    (addresses.ipv4_value, {"0.0.1.2": 258, "255.255.255.255": 2**32 - 1, "x": None}),
    (subscribers.canonical_imsi, {" 001010123456789\0": "001010123456789", "001010123456789@r": "001010123456789", "@001010123456789": "001010123456789", "12": None, None: None}),
    (subscribers.imsi15, {"001010123456789@r": "001010123456789", "\x00001010123456789 ": "001010123456789", "1": None, None: None}),
    (subscribers.same_sid, {None: "-", "": "-", " ": "-", "-": "-", " AB ": "ab"}),
    (ftp.passive_port, {"227 Entering Passive Mode (185,5,124,52,8,174)": 2222, "227 x (1,2,3,4,5": None, "227 (1,2,3,4,256,1)": None, "227 (1,2,3,4,0,0)": None, "229 ok (|||2121|)": 2121, "229 ok (|||70000|)": None, "230 (1,2,3,4,5,6)": None, " 229 (|1|::1|99|)": 99, "227 (1,2,3,4,5,6": 1286, "": None, None: None}),
    (ftp.is_passive_command, {" pasv\r\n": True, "EPSV": True, "LIST": False, None: False}),
    (hashing.fnv64, {"34.120.10.1|api.example.com|tcp|443": -4457809186194833340, "": -3750763034362895579, None: None}),
    (evidence.source_rank, {"dns+synack": 30, "CSV+mid ": 20, "mid-session": 10, "": 0, None: 0, "peer+ipport": 15}),
    (evidence.recovery_rank, {"dns+synack": 100, "csv+mid": 30, "": 0, "dns": 10}),
]


@pytest.mark.parametrize(("f", "cases"), CASES, ids=[f.__name__ for f, _ in CASES])
def test_function(spark, f, cases):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, v string")
    got = {r.k: r.out for r in df.select("k", f(F.col("v")).alias("out")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (33,), (63,), (2 | 16 | 32,), (64,)], "v int")
    got = [(r.a, r.b) for r in df.select(evidence.label(F.col("v")).alias("a"), evidence.normalised(F.col("v")).alias("b")).collect()]
    assert got == [("", 0), ("dns", 1), ("dns+synack", 33), ("dns+sni+active+csv+conn+synack", 47), ("sni+conn+synack", 34), ("", 64)]


ROWS = "issuer string, dst string, dns_name string, dns_source string, proto string, port int, observed_ns bigint, ord bigint"


def test_service_endpoints(spark):
    ip, ms = "34.120.10.1", 10**6
    rows = [("10.0.0.1", ip, "API.example.com.", "", "tcp", 443, 9 * ms, 0), ("10.0.0.2", ip, "api.example.com", "", "TCP", 443, 5 * ms, 1), ("100.64.0.1", ip, "api.example.com", "", "tcp", 443, 7 * ms, 2), ("8.8.4.4", ip, "api.example.com", "", "tcp", 443, 7 * ms, 3),
            ("001010123456789", ip, "api.example.com", "", "tcp", 443, 7 * ms, 3), ("10.0.0.9", ip, "", "", "tcp", 443, ms, 4), ("10.0.0.1", "34.120.10.2", "", "", "udp", 1, ms, 5), ("10.0.0.1", "10.0.0.9", "", "", "tcp", 1, ms, 6), ("10.0.0.2", "10.0.0.9", None, "", "tcp", 1, None, 7), ("x", ip, "a", "", "tcp", 0, 1, 8), ("x", "bad", "a", "", "tcp", 1, 1, 9)]
    got = {(r.ip, r.dns, r.port): r for r in reports.service_endpoints(spark.createDataFrame(rows, ROWS)).collect()}
    assert set(got) == {(ip, "api.example.com", 443), ("34.120.10.2", "[no-dns-attribution]", 1), ("10.0.0.9", "[private-server]", 1)}
    first = got[ip, "api.example.com", 443]
    assert (first.peers_count, first.observed_at, first.hash_val) == (3, 5, -4457809186194833340)
    assert got["10.0.0.9", "[private-server]", 1].peers_count == 2


def test_unresolved(spark):
    rows = [("i", "159.69.94.54", "", "", "tcp", 443, 1, 0), ("j", "159.69.94.54", " ", "", "TCP", 443, 1, 1), ("i", "159.69.94.54", "", "", "udp", 53, 1, 2), ("i", "10.0.0.1", "", "", "tcp", 1, 1, 3), ("i", "1.1.1.1", "n", "", "tcp", 1, 1, 4)]
    got = sorted(tuple(r) for r in reports.unresolved_endpoints(spark.createDataFrame(rows, ROWS)).collect())
    assert got == [("159.69.94.54", 53, "udp", 1), ("159.69.94.54", 443, "tcp", 2)]


TX = "tx_id bigint, req_ts_ns bigint, issuer_ip string, issuer_label string, dns_name string, resolver_ip string, dest_port int, proto string, pcap_file string, name_evidence int"
IPS = "tx_id bigint, ip string, ord int, evidence int"


def test_unresolved_names_and_profile(spark):
    tx = spark.createDataFrame([(1, 5, "a", None, "X.example", "r", None, None, "2.pcap", 0), (2, 4, "a", None, "x.example.", "r", None, None, "1.pcap", 0), (3, 1, "b", None, "y.example", "r", 443, "tcp", "1.pcap", 0), (4, 1, "b", "L", "y.example", "r", 443, "tcp", "1.pcap", 0), (5, 1, None, None, None, None, None, None, None, None)], TX)
    ips = spark.createDataFrame([(3, "1.1.1.1", 0, 1)], IPS)
    open_ = reports.unresolved_names(tx, ips)
    assert [tuple(r) for r in open_.collect()] == [("x.example", "a", "1.pcap")]
    named = spark.createDataFrame([("z", "1.1.1.1", "X.EXAMPLE.", "", "tcp", 1, 1, 0)], ROWS)
    assert reports.minus_topology(open_, named).count() == 0 and reports.minus_topology(open_, named.limit(0)).count() == 1
    got = {r.issuer: (r.total_dns, r.unique_names, r.unique_ips, r.unique_ports, r.connection_rate) for r in reports.issuer_profile(tx, ips).collect()}
    assert got == {"a": (2, 2, 0, 0, 0.0), "b": (1, 1, 1, 1, 1.0), "L": (1, 1, 0, 1, 1.0)}
    assert reports.table_stats(tx.limit(0), ips).first().unique_sources == 0


def test_map(spark):
    tx = spark.createDataFrame([(k, k, "i", None, n, "r", 443, "tcp", f"{k}.pcap", e) for k, n, e in ((1, "long.example", 0), (2, "s.example", 0), (3, "w.example", 0), (4, "n.example", 33), (5, "p.example", 0), (6, "q.example", 34))], TX)
    ips = spark.createDataFrame([(1, "34.0.0.1", 0, 33), (2, "34.0.0.1", 0, 33), (3, "34.0.0.2", 0, 49), (4, "34.0.0.3", 0, 1), (5, "10.0.0.1", 0, 33), (6, "34.0.0.4", 0, 34), (4, "34.0.0.5", 1, 0)], IPS)
    assert {tuple(r) for r in namemap.strong_pairs(tx, ips).collect()} == {("34.0.0.1", "long.example"), ("34.0.0.1", "s.example"), ("34.0.0.5", "n.example")}
    base = spark.createDataFrame([("34.0.0.5", "old.example"), ("bad", "x"), ("34.0.0.9", ".")], "ip string, dns string")
    new = namemap.learned(base, tx, ips)
    assert {tuple(r) for r in new.collect()} == {("34.0.0.1", "s.example")}
    assert namemap.merged(base, namemap.strong_pairs(tx, ips)).count() == 2
    pairs = spark.createDataFrame([("34.0.0.1", "s.example"), ("34.0.0.2", "w.example"), ("34.0.0.3", "n.example")], "ip string, dns string")
    got = {r.ip: (r.evidence, r.observed_at, r.pcap_file, r.port) for r in namemap.audit(pairs, tx, ips, reports.nanoseconds(F.col("req_ts_ns"))).collect()}
    assert got == {"34.0.0.1": ("dns+synack", "1970-01-01 00:00:00.000000002Z", "2.pcap", 443), "34.0.0.2": ("dns+conn+synack", "1970-01-01 00:00:00.000000003Z", "3.pcap", 443), "34.0.0.3": ("", "", "", 0)}


def test_map_lines(spark):
    lines = ["# c", "", "A.example,1.2.3.4", "1.2.3.4 b.example extra", "1.2.3.4\tA.Example.", "5.6.7.8,9.9.9.9", "x,y", "only", "c.example , 1.2.3.5,junk", "::1,v6.example", "1.2.3.6,"]
    df = spark.createDataFrame(list(enumerate(lines)), "n bigint, line string")
    assert {tuple(r) for r in namemap.load(df, F.col("n")).collect()} == {("1.2.3.4", "a.example", 2), ("1.2.3.4", "b.example", 3), ("5.6.7.8", "9.9.9.9", 5), ("1.2.3.5", "c.example", 8)}


def test_sorted_maps(spark):
    df = spark.createDataFrame([("10.0.0.10", "b.x"), ("9.0.0.1", "a.x"), ("10.0.0.9", "b.x"), ("10.0.0.9", "a.x"), ("10.0.0.9", "a.x")], "ip string, dns string")
    a, b, c = io.StringIO(), io.StringIO(), io.StringIO()
    text.sorted_maps(df, a, b, c)
    assert a.getvalue() == "a.x,9.0.0.1\na.x,10.0.0.9\nb.x,10.0.0.9\nb.x,10.0.0.10\n"
    assert b.getvalue() == "9.0.0.1,a.x\n10.0.0.9,a.x\n10.0.0.9,b.x\n10.0.0.10,b.x\n" and c.getvalue() == "10.0.0.9,2,a.x|b.x\n"


def test_floor_div_is_exact(spark):
    values = [1740960099809999999, 1740960099810000000, -1, -1_000_000, -1_000_001, 0, 999_999, 2**62, None]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert [r[0] for r in df.select(floor_div(F.col("v"), 1_000_000)).collect()] == [None if v is None else v // 1_000_000 for v in values]
