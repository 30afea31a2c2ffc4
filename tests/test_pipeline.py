import json
from datetime import date

import pytest

from tapline.__main__ import parser
from tapline.options import RunOptions, duration_ns, port_list, resolver_list
from tapline.plans import pipeline
from tapline.sinks.capturebytes import accounting, classic, client_hello, frame, query, response, tcp, udp
from tapline.sources import pcap

T = 1_700_000_000 * 10**9
MS = 10**6
ME, RESOLVER, SERVER, OTHER = "10.0.0.5", "8.8.8.8", "34.120.10.1", "34.120.10.9"


def talk(t, src, dst, sport, dport):
    return [(t, frame(src, dst, tcp(b"", sport, dport, 2))), (t + 10 * MS, frame(dst, src, tcp(b"", dport, sport, 18)))]


def lookup(t, name, answers, sport, dns_id=5):
    return [(t, frame(ME, RESOLVER, udp(query(name, dns_id=dns_id), sport, 53))), (t + 20 * MS, frame(RESOLVER, ME, udp(response(name, answers, dns_id), 53, sport)))]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    vsa = (10415).to_bytes(4, "big") + b"\x01" + bytes([17]) + b"001010123456789"
    start = accounting([(8, bytes([10, 0, 0, 5])), (26, vsa), (40, (1).to_bytes(4, "big")), (44, b"s1")])
    stop = accounting([(8, bytes([10, 0, 0, 5])), (26, vsa), (40, (2).to_bytes(4, "big")), (44, b"s1")], ident=9)
    one = [(T - 10**9, frame("9.9.9.9", "9.9.9.8", udp(start, 40000, 1813))), (T - 9 * 10**8, frame("9.9.9.9", "9.9.9.8", udp(start, 40000, 1813)))]
    one += lookup(T, "api.example.com", [SERVER], 5000) + talk(T + 100 * MS, ME, SERVER, 6000, 443)
    one += lookup(T + 200 * MS, "ntp.example.com", ["34.120.10.7"], 5001)
    two = lookup(T + 10**9, "lost.example.com", [], 5002)[:1] + talk(T + 2 * 10**9, ME, OTHER, 6001, 8443)
    two += [(T + 3 * 10**9, frame(ME, "34.120.10.3", tcp(client_hello("sni.example.org"), 6002, 443, 24)))]
    two += lookup(T + 10**10, "never.example.com", [], 5003)[:1]
    two += [(T + 11 * 10**9, frame("9.9.9.9", "9.9.9.8", udp(stop, 40000, 1813)))]
    (root / "a.pcap").write_bytes(classic(sorted(one)))
    (root / "sub").mkdir()
    (root / "sub" / "b.cap").write_bytes(classic(sorted(two), nano=True))
    (root / "notes.txt").write_text("no capture")
    return root


def test_source(spark, folder):
    pcap.register(spark)
    df = spark.read.format("pcap").load(str(folder))
    assert [r.pcap_file for r in df.select("file_idx", "pcap_file").distinct().orderBy("file_idx").collect()] == ["a.pcap", "b.cap"]
    assert df.filter("l4 = 'udp' and dst_port in (53)").count() == 4
    assert spark.read.format("pcap").option("l4", "udp").option("ports", "53").load(str(folder)).count() == 6
    assert pcap.read_captures(spark, str(folder)).count() == df.count()
    with pytest.raises(Exception, match="No such file|no capture files"):
        spark.read.format("pcap").load(str(folder / "sub" / "..") + "/none").count()


def test_run(spark, folder, tmp_path):
    names = tmp_path / "map.csv"
    names.write_text("# map\nold.example.net,34.120.99.1")
    options = RunOptions(str(folder), "net-1", output_root=str(tmp_path / "out"), dns_ip_file=str(names), debug=True, radius_imsi=True, export_csv="x/records.csv", manifest_out="copy.json", post_hooks=("cp \"$TAPLINE_MANIFEST\" hook.json",))
    done = pipeline.run(spark, options)
    manifest = json.loads((done.path / "_run-artifacts.json").read_text())
    assert manifest["pcap_files_count"] == 2 and manifest["first_packet_pcap_file"] == "a.pcap" and manifest["first_packet_ts_utc"].startswith("2023-11-14T22:13:19")
    assert (done.path / "copy.json").read_text() == (done.path / "hook.json").read_text()
    rows = json.loads((done.path / "network-topology-matrix.json").read_text())
    got = {(r["issuer_ip"], r["destination_ip"], r["dns_name"], r["dns_source"], r["port"]) for r in rows["entries"]}
    me = "001010123456789"
    assert rows["version"] == 1
    assert (me, SERVER, "api.example.com", "dns+synack", 443) in got
    assert (me, OTHER, "lost.example.com", "dns+conn+synack", 8443) in got
    assert (me, "34.120.10.3", "sni.example.org", "sni+synack", 443) in got
    assert not any("ntp" in r[2] for r in got)
    table = (done.path / "dns-table.txt").read_text()
    assert "| 2023-11-14 22:13:20.000 | 001010123456789 | api.example.com" in table and "Unique DNS with traffic:  3" in table
    assert "never.example.com" in (done.path / "dns-unresolved-dns.txt").read_text()
    assert names.read_text() == f"# map\nold.example.net,34.120.99.1\napi.example.com,{SERVER}\n"
    assert "new_pairs_appended: 1" in (done.path / "ip-dns-append-audit.txt").read_text()
    assert {e["dns"] for e in json.loads((done.path / "service-endpoints.txt").read_text())} == {"api.example.com", "lost.example.com", "sni.example.org"}
    assert 'group: "example.com"' in (done.path / "external-endpoints.txt").read_text()
    assert (done.path / "x" / "records.csv").read_text().startswith("request_time,issuer_ip")
    assert "Connection Rate" in (done.path / "dns-issuer-profile.txt").read_text()


def test_recover(spark, tmp_path):
    for run, table, blank in (("r1", f"| 2023 | i | a.example | {SERVER} | dns+synack | r | 443 |\n|  |  |  | {OTHER} | csv+mid |  |  |\n", []), ("r2", f"| Request Time | x |\n|---|\n| 2023 | i | b.example. | {OTHER} | dns | r | 443 |\n", [SERVER, OTHER, "10.0.0.1"])):
        (tmp_path / run).mkdir()
        (tmp_path / run / "dns-table.txt").write_text("| Request Time | ...\n" + table)
        (tmp_path / run / "unresolved-ip.json").write_text(json.dumps([{"ip": x, "port": 1, "proto": "tcp", "count": 1} for x in blank]))
    out = tmp_path / "recovered.csv"
    assert pipeline.recover(spark, str(tmp_path), str(out)) == 2
    assert out.read_text() == f"a.example,{SERVER}\nb.example,{OTHER}\n"


def test_options():
    assert port_list("53, ,123,53") == (53, 123) and resolver_list("8.8.8.8, 1.1.1.1,8.8.8.8") == ("8.8.8.8", "1.1.1.1")
    assert duration_ns("1m30s") == 90 * 10**9 and duration_ns("0") == 0 and duration_ns("2m") == 120 * 10**9
    for bad in ("0", "70000", "x"):
        with pytest.raises(ValueError, match="not a port"):
            port_list(bad)
    for bad in ({"net_id": "../x"}, {"net_id": ""}, {"format": "xml"}, {"topology_window_ns": -1}, {"read_dir": ""}):
        with pytest.raises(ValueError):
            RunOptions(**({"read_dir": "d", "net_id": "n"} | bad))
    with pytest.raises(ValueError):
        duration_ns("5 parsecs")
    got = parser().parse_args(["-r", "d", "--net-id", "n", "--ignore-ntp=false", "--exclude-ports", "53,123"])
    assert got.ignore_ntp is False and got.exclude_ports == (53, 123)


def test_hook_failure(spark, tmp_path):
    from tapline.sinks.rundir import RunFolder

    f = RunFolder("n", str(tmp_path))
    with pytest.raises(RuntimeError, match="post-hook 1"):
        f.run_hooks(("false",), tmp_path / "m")
    with pytest.raises(FileExistsError):
        RunFolder("n", str(tmp_path), f.started)


def test_days(spark, folder, tmp_path):
    for day in ("2024-02-28", "2024-02-29", "2024-03-02"):
        (tmp_path / "in" / day).mkdir(parents=True)
        (tmp_path / "in" / day / "a.pcap").write_bytes((folder / "a.pcap").read_bytes())
    done = pipeline.run_days(spark, RunOptions(str(tmp_path / "in"), "n", output_root=str(tmp_path / "out")), date(2024, 2, 28))
    assert [d.root.name for d in done] == ["2024-02-28", "2024-02-29"]


def test_days_beyond_a_year(spark, monkeypatch):
    def read(_, path):
        if path.endswith("2025-03-10"):
            raise FileNotFoundError(path)

    monkeypatch.setattr(pipeline.pcap, "read_captures", read)
    monkeypatch.setattr(pipeline, "cut", lambda packets: packets)
    monkeypatch.setattr(pipeline, "build", lambda *_: None)
    monkeypatch.setattr(pipeline, "write", lambda _, options, folder: options.read_dir)
    done = pipeline.run_days(spark, RunOptions("in", "n", output_root="out"), date(2024, 1, 1))
    assert len(done) == (date(2025, 3, 10) - date(2024, 1, 1)).days and done[-1] == "in/2025-03-09"


def test_source_by_uri_and_lean_payloads(spark, folder):
    pcap.register(spark)
    whole = spark.read.format("pcap").load(str(folder))
    key = ["file_idx", "pcap_file", "pkt_idx", "ts_ns", "src_ip", "dst_port"]
    assert sorted(pcap.read_captures(spark, folder.as_uri()).select(*key).collect()) == sorted(whole.select(*key).collect())
    lean = pcap.read_captures(spark, str(folder), payloads="needed")
    assert lean.count() == whole.count()
    idle = "l4 = 'tcp' and dst_port = 8443 or src_port = 8443"
    assert lean.filter("payload is not null").count() == whole.filter(f"payload is not null and not ({idle})").filter("length(payload) > 0").count()
    with pytest.raises(FileNotFoundError):
        pcap.read_captures(spark, folder.as_uri() + "/none")


def test_commands(spark, folder, tmp_path, capsys):
    from tapline.__main__ import main

    (tmp_path / "in" / "2024-02-28").mkdir(parents=True)
    (tmp_path / "in" / "2024-02-28" / "a.pcap").write_bytes((folder / "a.pcap").read_bytes())
    main(["days", "--first-day", "2024-02-28", "-r", str(tmp_path / "in"), "--net-id", "n", "-o", str(tmp_path / "out"), "--no-banner"])
    said = capsys.readouterr()
    assert "2024-02-28" in said.out and "tapline:" not in said.err
    main(["recover", str(tmp_path / "out"), str(tmp_path / "found.csv")])
    assert (tmp_path / "found.csv").exists()
    (tmp_path / "map.csv").write_text("# note\nB.example.,2.2.2.2\n\n- dash\nno pair\na.example, 10.0.0.1 \na.example,2.2.2.2\na.example,10.0.0.1\n")
    main(["sort-map", str(tmp_path / "map.csv"), str(tmp_path / "maps")])
    head = "# note\n- dash\nno pair\n\n"
    assert (tmp_path / "maps" / "dns-ip-sorted.txt").read_text() == head + "a.example,2.2.2.2\na.example,10.0.0.1\nb.example,2.2.2.2\n"
    assert (tmp_path / "maps" / "ip-dns-sorted.txt").read_text() == head + "2.2.2.2,a.example\n2.2.2.2,b.example\n10.0.0.1,a.example\n"
    assert (tmp_path / "maps" / "ip-multi-dns-sorted.txt").read_text() == head + "2.2.2.2,2,a.example|b.example\n"


def test_further_extractor(spark, folder):
    import pyarrow as pa

    from pyspark.sql import functions as F

    from tapline.operators import extract

    row = lambda p: (p["dst_port"], len(p["payload"])) if p["dst_port"] == 443 else None
    one = extract.Extractor("syn_sizes", lambda: F.col("l4") == "tcp", row, "port int, size int", [("port", pa.int32()), ("size", pa.int32())])
    extract.register(one)
    try:
        with pytest.raises(ValueError, match="already"):
            extract.register(one)
        pcap.register(spark)
        got = extract.extracted(spark.read.format("pcap").load(str(folder)), "syn_sizes")
        assert got.columns == [*extract.PLACE, "port", "size"] and {r.port for r in got.collect()} == {443}
    finally:
        del extract.EXTRACTORS["syn_sizes"]


def test_external_endpoints_text(spark):
    import io

    from tapline.sinks import text

    rows = [("a.example", "name", "x.a.example"), ("a.example", "ip", "9.9.9.9"), ("a.example", "tcp", "443"), ("a.example", "tcp", "80"), ("a.example", "udp", "53"), ("b.example", "ip", "8.8.8.8"), ("b.example", "ip", "8.8.4.4"), ("b.example", "name", "b.example"), ("c.example", "tcp", "1")]
    out = io.StringIO()
    text.external_endpoints(out, spark.createDataFrame(rows, "suffix string, kind string, value string"))
    block = '- id: "svc_{0}"\n  group: "{0}"\n  match: {{ dns_suffix: "{0}" }}\n  listeners:\n{1}  ip_churn_expected: true\n  grouping_key: ["dns_suffix", "proto", "dst_port"]\n  observations:\n    top_dns_seen: [{2}]\n    sample_ips: [{3}]\n\n'
    want = block.format("a.example", '    - { proto: "tcp", port: [80,443] }\n    - { proto: "udp", port: [53] }\n', '"x.a.example"', '"9.9.9.9"')
    want += block.format("b.example", "", '"b.example"', '"8.8.4.4", "8.8.8.8"') + block.format("c.example", '    - { proto: "tcp", port: [1] }\n', "", "")
    assert out.getvalue() == want + '\n# Observed destination ports (global)\n- { proto: "udp", port: [53] }\n- { proto: "tcp", port: [1,80,443] }\n'
