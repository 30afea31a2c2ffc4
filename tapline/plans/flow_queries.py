"""Queries of packets, edges, DNS matching, correlation and RADIUS accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapline.functions.addresses import plain_address
from tapline.functions.numbers import floor_div
from tapline.functions.subscribers import imsi15
from tapline.operators import correlate, edges, radius, reports, transactions
from tapline.plans import derived as D
from tapline.plans import relations as R
from tapline.plans import sqltext as S
from tapline.plans.data_queries import IMSI
from tapline.plans.tables import table
from tapline.session import cut

EXCLUDED = (123,)


def _packets(spark, folder):
    return D.relation(spark, folder, D.PACKETS, "packets")


def first_packet(spark, folder):
    return reports.first_packet(_packets(spark, folder))


def tcp_handshake_edges(spark, folder):
    return edges.handshake_edges(_packets(spark, folder))


def tcp_first_request_edges(spark, folder):
    """Handshakes of first requests only, repeats of a live one left out."""
    return edges.handshake_edges(_packets(spark, folder), first_only=True)


def tcp_midsession_edges(spark, folder):
    return edges.midsession_edges(_packets(spark, folder))


def udp_pair_edges(spark, folder):
    return edges.udp_edges(_packets(spark, folder), EXCLUDED)


def udp_private_source(spark, folder):
    return edges.udp_edges(_packets(spark, folder), EXCLUDED, private_source=True)


def ftp_exact_suppress(spark, folder):
    packets = _packets(spark, folder)
    return edges.without_announced(edges.handshake_events(packets), edges.passive_ports(packets)).select("file_idx", "issuer_ip", "dst_ip", "port", "ts_ns", "pkt_idx")


def ftp_highport_suppress(spark, folder):
    return edges.without_passive_range(edges.handshake_events(_packets(spark, folder))).select("file_idx", "issuer_ip", "dst_ip", "port", "ts_ns", "pkt_idx")


def file_edges(spark, folder):
    return edges.file_edges(cut(_packets(spark, folder)), EXCLUDED)


def edge_cross_file_dedup(spark, folder):
    return edges.across_files(edges.handshake_edges(_packets(spark, folder)))


def edges_collected(spark, folder):
    return edges.collected(cut(_packets(spark, folder)), EXCLUDED)


def _messages(spark, folder, name):
    return D.relation(spark, folder, D.MESSAGES, name)


def dns_query_response_match(spark, folder):
    return transactions.matched(_messages(spark, folder, "queries"), _messages(spark, folder, "responses"))


def dns_answer_evidence(spark, folder):
    return transactions.answer_evidence(dns_query_response_match(spark, folder), _messages(spark, folder, "answers"))


def dns_tx_merge(spark, folder):
    """Stored transactions, as each file saw them, merged over files."""
    tx = R.transactions(spark, folder).withColumn("file_idx", F.col("pcap_file"))
    return transactions.merged(tx, ["issuer_ip", "dns_name", "proto"])


def sni_dedup(spark, folder):
    return transactions.hello_transactions(D.relation(spark, folder, D.HELLOS, "hellos"))


def _linked(spark, folder):
    conns = R.edges(spark, folder).filter("issuer_ip is not null and dst_ip is not null").select(F.col("edge_ord").alias("conn_id"), "file_idx", F.col("edge_ord").alias("pkt_idx"), "issuer_ip", "dst_ip", "proto", "port", F.col("first_seen_ns").alias("ts_ns"))
    # As before the pass: no transaction has a port yet.
    tx = R.transactions(spark, folder, "tx_id req_ts_ns issuer_ip dns_name name_evidence").withColumn("dest_port", F.lit(None).cast("int"))
    return conns, tx, R.transaction_addresses(spark, folder)


def conn_asof_direct(spark, folder):
    return correlate.direct(*_linked(spark, folder))


def conn_first_after(spark, folder):
    return correlate.first_after(*_linked(spark, folder))


def conn_fallback_unique_snapshot(spark, folder):
    return correlate.fallback_snapshot(*_linked(spark, folder))


def conn_fallback_sequential(spark, folder):
    return correlate.fallback_sequential(*_linked(spark, folder), R.name_map(spark, folder))


def csv_guard(spark, folder):
    conns, tx, addresses = _linked(spark, folder)
    return correlate.allowed_by_map(correlate.fallback_snapshot(conns, tx, addresses), conns, tx, R.name_map(spark, folder))


def best_candidate(spark, folder):
    conns, tx, addresses = _linked(spark, folder)
    return correlate.best_candidates(correlate.direct(conns, tx, addresses), conns)


def observed_conn_evidence(spark, folder):
    conns, tx, addresses = _linked(spark, folder)
    return correlate.observed(addresses, tx, correlate.direct(conns, tx, addresses), csv_guard(spark, folder), conns)


def radius_dedup_ttl(spark, folder):
    rows = table(spark, folder, "radius_msgs")
    key = F.concat_ws("|", imsi15(F.col("imsi")), plain_address(F.col("ip")), F.lower(F.trim("sid")), "status", "ts_ms")
    return radius.first_in_window(rows, key, F.unix_millis("recv_ts"), "recv_id")


def _accounting(spark, folder):
    rows = table(spark, folder, "radius_msgs")
    return rows.select(imsi15(F.col("imsi")).alias("imsi"), plain_address(F.col("ip")).alias("ip"), F.lower(F.trim("sid")).alias("sid"), "ts_ms", "sess_time_sec", "status")


def radius_sessions(spark, folder):
    return radius.sessions(_accounting(spark, folder))


def _windows(spark, folder):
    return table(spark, folder, "radius_sessions").withColumns({"imsi": imsi15(F.col("imsi")), "ip": plain_address(F.col("ip"))})


def radius_coalesce(spark, folder):
    return radius.coalesced(_windows(spark, folder))


def radius_label_lookup(spark, folder):
    return radius.labels(R.transactions(spark, folder, "tx_id req_ts_ns issuer_ip"), _windows(spark, folder), "tx_id", F.col("issuer_ip"), floor_div(F.col("req_ts_ns"), 1_000_000))


def radius_label_digits(spark, folder):
    """Labels of 14, 15 and 16 digits, made from the stored identities."""
    imsi = F.when(F.col("session_row") % 3 == 0, F.substring("imsi", 1, 14)).when(F.col("session_row") % 3 == 1, F.col("imsi")).otherwise(F.concat("imsi", F.lit("7")))
    return radius.labels(R.transactions(spark, folder, "tx_id req_ts_ns issuer_ip"), _windows(spark, folder).withColumn("imsi", imsi), "tx_id", F.col("issuer_ip"), floor_div(F.col("req_ts_ns"), 1_000_000))


NAMES = """first_packet tcp_handshake_edges tcp_first_request_edges tcp_midsession_edges udp_pair_edges udp_private_source ftp_exact_suppress ftp_highport_suppress file_edges edge_cross_file_dedup edges_collected dns_query_response_match dns_answer_evidence
dns_tx_merge sni_dedup conn_asof_direct conn_first_after conn_fallback_unique_snapshot conn_fallback_sequential csv_guard best_candidate observed_conn_evidence radius_dedup_ttl radius_sessions radius_coalesce radius_label_lookup radius_label_digits"""
QUERIES = {n: globals()[n] for n in NAMES.split()}

_SYN = "tcp AS (SELECT * FROM packets WHERE l4 = 'tcp' AND src_port <> 0 AND dst_port <> 0), syn AS (SELECT * FROM tcp WHERE tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0)"
_ACK = f"""{_SYN}, sack AS (SELECT a.* FROM tcp a WHERE tcp_flags & 2 <> 0 AND tcp_flags & 16 <> 0 AND EXISTS (SELECT 1 FROM syn s WHERE s.file_idx = a.file_idx AND s.src_ip = a.dst_ip AND s.dst_ip = a.src_ip AND s.src_port = a.dst_port AND s.dst_port = a.src_port
  AND (s.ts_ns, s.pkt_idx) < (a.ts_ns, a.pkt_idx) AND a.ts_ns - s.ts_ns <= 30000000000)),
ans AS (SELECT file_idx, dst_ip AS issuer_ip, src_ip AS dst_ip, dst_port AS cport, src_port AS port, ts_ns, pkt_idx FROM sack)"""


def _shake(answers: str, name: str) -> str:
    return f"""{name} AS (SELECT s.file_idx, s.src_ip AS issuer_ip, s.dst_ip, 'tcp' AS proto, s.dst_port AS port, min(s.ts_ns) AS first_seen_ns FROM syn s JOIN {answers} a ON s.file_idx = a.file_idx AND s.src_ip = a.issuer_ip AND s.dst_ip = a.dst_ip AND s.src_port = a.cport AND s.dst_port = a.port
  AND (s.ts_ns, s.pkt_idx) < (a.ts_ns, a.pkt_idx) AND a.ts_ns - s.ts_ns <= 30000000000 GROUP BY 1, 2, 3, 5)"""


_MIDE = f"""mid AS (SELECT *, {S.local('src_ip')} AS a, {S.local('dst_ip')} AS b FROM tcp WHERE tcp_flags & 2 = 0 AND tcp_flags & 4 = 0),
mide AS (SELECT file_idx, CASE WHEN a THEN src_ip ELSE dst_ip END AS issuer_ip, CASE WHEN a THEN dst_ip ELSE src_ip END AS dst_ip, CAST(NULL AS INT) AS cport, CASE WHEN a THEN dst_port ELSE src_port END AS port, ts_ns, pkt_idx FROM mid WHERE a <> b)"""


def _udp(private: bool) -> str:
    turn = f"(NOT {S.local('b.dst_ip')} AND {S.local('b.src_ip')})" if private else "false"
    return f"""ud AS (SELECT * FROM packets WHERE l4 = 'udp' AND src_port NOT IN (0, 123) AND dst_port NOT IN (0, 123)), uf AS (SELECT *, row_number() OVER (PARTITION BY file_idx, src_ip, dst_ip, src_port, dst_port ORDER BY ts_ns, pkt_idx) AS r FROM ud),
ue AS (SELECT f.file_idx, CASE WHEN {turn} THEN b.src_ip ELSE f.src_ip END AS issuer_ip, CASE WHEN {turn} THEN f.src_ip ELSE f.dst_ip END AS dst_ip, 'udp' AS proto, CASE WHEN {turn} THEN f.src_port ELSE f.dst_port END AS port, min(f.ts_ns) AS first_seen_ns
  FROM uf f JOIN ud b ON f.r = 1 AND b.file_idx = f.file_idx AND b.src_ip = f.dst_ip AND b.dst_ip = f.src_ip AND b.src_port = f.dst_port AND b.dst_port = f.src_port AND (b.ts_ns, b.pkt_idx) > (f.ts_ns, f.pkt_idx) AND b.ts_ns - f.ts_ns <= 30000000000 GROUP BY ALL)"""


_PASV = f"""rep AS (SELECT *, regexp_extract(payload, '\\(([^)]*)', 1) AS inside FROM tcp WHERE src_port IN (21, 990) AND dst_port NOT IN (21, 990) AND payload IS NOT NULL),
pasv AS (SELECT file_idx, dst_ip AS issuer_ip, src_ip AS dst_ip, ts_ns, pkt_idx, CASE WHEN payload LIKE '227%' THEN CAST(string_split(inside, ',')[-2] AS INT) * 256 + CAST(string_split(inside, ',')[-1] AS INT) WHEN payload LIKE '229%' THEN CAST(regexp_extract(inside, '([0-9]+)[^0-9]*$', 1) AS INT) END AS port FROM rep)"""


def _quiet(events: str, name: str) -> str:
    return f"""{name} AS (SELECT x.* FROM {events} x WHERE NOT EXISTS (SELECT 1 FROM pasv p WHERE p.file_idx = x.file_idx AND p.issuer_ip = x.issuer_ip AND p.dst_ip = x.dst_ip AND p.port = x.port AND (p.ts_ns, p.pkt_idx) < (x.ts_ns, x.pkt_idx) AND x.ts_ns - p.ts_ns <= 30000000000))"""


def _low(events: str, name: str) -> str:
    return f"""{name} AS (SELECT x.* FROM {events} x WHERE x.port < 30000 OR NOT EXISTS (SELECT 1 FROM {events} c WHERE c.port IN (21, 990) AND c.file_idx = x.file_idx AND c.issuer_ip = x.issuer_ip AND c.dst_ip = x.dst_ip AND (c.ts_ns, c.pkt_idx) <= (x.ts_ns, x.pkt_idx)))"""


_FILE = f"""{D.PACKETS}, {_ACK}, {_MIDE}, {_PASV}, both_ AS (SELECT *, 0 AS how FROM ans UNION ALL SELECT *, 1 AS how FROM mide), {_quiet('both_', 'q1')}, {_low('q1', 'q2')}, a2 AS (SELECT * FROM q2 WHERE how = 0), {_shake('a2', 'sh')}, {_udp(False)},
t1 AS (SELECT file_idx, issuer_ip, dst_ip, proto, port, min(first_seen_ns) AS first_seen_ns FROM (SELECT * FROM sh UNION ALL SELECT file_idx, issuer_ip, dst_ip, 'tcp', port, ts_ns FROM q2 WHERE how = 1) GROUP BY 1, 2, 3, 4, 5),
fe AS (SELECT * FROM t1 UNION ALL SELECT * FROM ue)"""
_EV = "file_idx, issuer_ip, dst_ip, port, ts_ns, pkt_idx"
_CROSS = "cross_ AS (SELECT issuer_ip, dst_ip, proto, port, file_idx, first_seen_ns FROM (SELECT *, row_number() OVER (PARTITION BY issuer_ip, dst_ip, proto, port ORDER BY file_idx, first_seen_ns) AS r FROM {0}) WHERE r = 1)"
_MATCH = f"""{D.MESSAGES}, m AS (SELECT r.response_id, q.query_id, row_number() OVER (PARTITION BY r.response_id ORDER BY (r.name = '' OR q.name = r.name) DESC, q.ts_ns DESC, q.pkt_idx DESC) AS k
  FROM responses r JOIN queries q ON q.file_idx = r.file_idx AND q.issuer_ip = r.issuer_ip AND q.src_port = r.src_port AND q.resolver_ip = r.resolver_ip AND q.proto = r.proto AND q.dns_id = r.dns_id AND (q.ts_ns, q.pkt_idx) < (r.ts_ns, r.pkt_idx) WHERE r.dns_id <> 0)"""
_LINK = f"""{S.TX}, {S.TXIP}, {S.EDGES}, {S.MAP}, {D.CONNECTIONS}, ips AS (SELECT * FROM tx_ip), ix AS (SELECT t.tx_id, t.issuer_ip, t.req_ts_ns, i.ip FROM tx t JOIN ips i USING (tx_id) WHERE issuer_ip <> ''),
dr AS (SELECT conn_id, tx_id, ts_ns - req_ts_ns AS dt_ns FROM (SELECT c.conn_id, c.ts_ns, x.tx_id, x.req_ts_ns, row_number() OVER (PARTITION BY c.conn_id ORDER BY x.req_ts_ns DESC, x.tx_id) AS r FROM conns c JOIN ix x ON x.issuer_ip = c.issuer_ip AND x.ip = c.dst_ip AND x.req_ts_ns < c.ts_ns) WHERE r = 1 AND ts_ns - req_ts_ns <= 5000000000),
un AS (SELECT tx_id, issuer_ip, req_ts_ns, dns_name FROM tx WHERE issuer_ip <> '' AND {S.resolvable('dns_name')} AND tx_id NOT IN (SELECT tx_id FROM ips)),
nk AS (SELECT * FROM conns c WHERE proto = 'tcp' AND NOT EXISTS (SELECT 1 FROM ix x WHERE x.issuer_ip = c.issuer_ip AND x.ip = c.dst_ip)),
fb AS (SELECT c.conn_id, min(u.tx_id) AS tx_id, min(c.ts_ns - u.req_ts_ns) AS dt_ns FROM nk c JOIN un u ON u.issuer_ip = c.issuer_ip AND u.req_ts_ns BETWEEN c.ts_ns - 5000000000 AND c.ts_ns GROUP BY c.conn_id HAVING count(*) = 1),
gd AS (SELECT f.* FROM fb f JOIN conns c USING (conn_id) JOIN tx t ON t.tx_id = f.tx_id WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.ip = c.dst_ip) OR EXISTS (SELECT 1 FROM pairs p WHERE p.ip = c.dst_ip AND p.dns = {S.name('t.dns_name')}))"""
_WIN = f"""w0 AS (SELECT DISTINCT session_row, {IMSI} AS imsi, {S.address('ip')} AS ip, coalesce(nullif(sid, ''), '-') AS sid, start_ms AS s, CASE WHEN end_ms IS NULL OR end_ms = 0 THEN 9223372036854775807 ELSE end_ms END AS e FROM radius_sessions WHERE {IMSI} IS NOT NULL AND ip IS NOT NULL AND start_ms IS NOT NULL),
w1 AS (SELECT * FROM w0 WHERE e >= s)"""

# The sequential rules, one row after another.
_SEQUENTIAL = f"""{_LINK}, ev AS (SELECT issuer_ip, req_ts_ns AS t, 0 AS c, tx_id, NULL::BIGINT AS conn_id, {S.name('dns_name')} AS n, NULL::VARCHAR[] AS known, NULL::INT AS file_idx, NULL::BIGINT AS pkt_idx FROM un
  UNION ALL SELECT issuer_ip, ts_ns, 1, NULL, conn_id, NULL, k.dns, file_idx, pkt_idx FROM nk LEFT JOIN (SELECT ip, list(dns) AS dns FROM pairs GROUP BY ip) k ON k.ip = dst_ip),
rk AS (SELECT *, row_number() OVER (PARTITION BY issuer_ip ORDER BY t, c, file_idx NULLS FIRST, pkt_idx NULLS FIRST, tx_id NULLS FIRST) AS k FROM ev),
run AS (SELECT DISTINCT issuer_ip, 0::BIGINT AS k, []::STRUCT(i BIGINT, t BIGINT, n VARCHAR)[] AS open, NULL::BIGINT AS conn_id, NULL::BIGINT AS tx_id, NULL::BIGINT AS dt_ns FROM rk
  UNION ALL SELECT issuer_ip, k, CASE WHEN c = 0 THEN list_append(live, {{'i': i, 't': t, 'n': n}}) WHEN hit THEN live[2:] ELSE live END, CASE WHEN hit THEN conn_id END, CASE WHEN hit THEN live[1].i END, CASE WHEN hit THEN t - live[1].t END
  FROM (SELECT *, c = 1 AND len(live) = 1 AND (known IS NULL OR list_contains(known, live[1].n)) AS hit
    FROM (SELECT r.issuer_ip, r.k, r.t, r.c, r.tx_id AS i, r.conn_id, r.n, r.known, list_filter(s.open, lambda u: u.t >= r.t - 5000000000) AS live FROM run s JOIN rk r ON r.issuer_ip = s.issuer_ip AND r.k = s.k + 1)))"""
_TTL = f"""m AS (SELECT recv_id, epoch_ms(recv_ts) AS t, concat_ws('|', {IMSI}, {S.address('ip')}, lower(trim(sid)), status, ts_ms) AS key FROM radius_msgs WHERE recv_ts IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, recv_id) AS k FROM m),
run AS (SELECT key, k, recv_id, t AS kept, true AS keep FROM rk WHERE k = 1
  UNION ALL SELECT r.key, r.k, r.recv_id, CASE WHEN r.t - s.kept > 7200000 THEN r.t ELSE s.kept END, r.t - s.kept > 7200000 FROM run s JOIN rk r ON r.key = s.key AND r.k = s.k + 1)"""
_W = "STRUCT(sid VARCHAR, s BIGINT, e BIGINT, p BOOLEAN)[]"
_SESSIONS = f"""m AS (SELECT {IMSI} AS imsi, {S.address('ip')} AS ip, coalesce(nullif(lower(trim(sid)), ''), '-') AS sid, ts_ms AS t, greatest(coalesce(sess_time_sec, 0), 0) * 1000 AS back, CASE WHEN status IN (1, 2, 3) THEN status ELSE 2 END AS status
  FROM radius_msgs WHERE {IMSI} IS NOT NULL AND {S.address('ip')} <> '' AND ts_ms IS NOT NULL AND coalesce(status, 0) <> 0),
tail AS (SELECT max(t) AS tail FROM m),
rk AS (SELECT *, row_number() OVER (PARTITION BY imsi, ip ORDER BY t, sid, status, back DESC) AS k FROM m),
run AS (SELECT DISTINCT imsi, ip, 0::BIGINT AS k, []::{_W} AS open, []::{_W} AS closed, []::{_W} AS said FROM m
  UNION ALL SELECT imsi, ip, k,
    CASE WHEN status = 1 THEN [CASE WHEN t BETWEEN w.s - 5000 AND w.e + 5000 THEN {{'sid': sid, 's': w.s, 'e': w.e, 'p': false}} ELSE {{'sid': sid, 's': t, 'e': t, 'p': false}} END]
      WHEN status = 3 THEN others WHEN w IS NOT NULL THEN list_append(others, {{'sid': sid, 's': w.s, 'e': greatest(w.e, t), 'p': w.p}})
      WHEN len(out) > 0 THEN open ELSE list_append(open, {{'sid': sid, 's': t - back, 'e': t, 'p': true}}) END,
    list_concat(list_filter(closed, lambda x: NOT list_contains(list_transform(out, lambda y: y.sid), x.sid)), out), out
  FROM (SELECT *, CASE WHEN status = 1 THEN list_transform(others, lambda x: {{'sid': x.sid, 's': x.s, 'e': CASE WHEN x.e >= t THEN t - 1 ELSE x.e END, 'p': x.p}})
      WHEN status = 3 THEN [CASE WHEN w IS NOT NULL THEN {{'sid': sid, 's': w.s, 'e': t, 'p': w.p}} ELSE {{'sid': sid, 's': t - back, 'e': t, 'p': false}} END]
      WHEN w IS NULL AND d IS NOT NULL AND t - d.e <= 120000 THEN [{{'sid': sid, 's': d.s, 'e': t, 'p': d.p}}] ELSE []::{_W} END AS out
    FROM (SELECT r.*, s.open, s.closed, list_filter(s.open, lambda x: x.sid <> r.sid) AS others, list_filter(s.open, lambda x: x.sid = r.sid)[1] AS w, list_filter(s.closed, lambda x: x.sid = r.sid)[1] AS d
      FROM run s JOIN rk r ON r.imsi = s.imsi AND r.ip = s.ip AND r.k = s.k + 1))),
ends AS (SELECT imsi, ip, max(k) AS k FROM run GROUP BY imsi, ip),
all_ AS (SELECT imsi, ip, unnest(said) AS x FROM run UNION ALL
  SELECT imsi, ip, {{'sid': x.sid, 's': x.s, 'e': least(x.e, tail), 'p': x.p}} FROM (SELECT imsi, ip, unnest(open) AS x FROM run JOIN ends USING (imsi, ip, k)), tail WHERE x.p OR x.e <= tail - 21600000)"""

SQL = {
    "conn_fallback_sequential": f"WITH RECURSIVE {_SEQUENTIAL} SELECT conn_id, tx_id, dt_ns FROM run WHERE conn_id IS NOT NULL",
    "radius_dedup_ttl": f"WITH RECURSIVE {_TTL} SELECT recv_id FROM run WHERE keep",
    "radius_sessions": f"WITH RECURSIVE {_SESSIONS} SELECT imsi, ip, x.sid AS sid, x.s AS start_ms, x.e AS end_ms, x.p AS provisional FROM all_",
    "first_packet": f"WITH {D.PACKETS} SELECT ts_ns, pcap_file FROM packets ORDER BY ts_ns, file_idx LIMIT 1",
    "tcp_handshake_edges": f"WITH {D.PACKETS}, {_ACK}, {_shake('ans', 'sh')} SELECT * FROM sh",
    "tcp_first_request_edges": f"""WITH RECURSIVE {D.PACKETS}, tcp AS (SELECT * FROM packets WHERE l4 = 'tcp' AND src_port <> 0 AND dst_port <> 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY file_idx, src_ip, dst_ip, src_port, dst_port ORDER BY ts_ns, pkt_idx) AS k FROM tcp WHERE tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0),
run AS (SELECT file_idx, src_ip, dst_ip, src_port, dst_port, k, ts_ns, pkt_idx, ts_ns AS kept, true AS keep FROM rk WHERE k = 1
  UNION ALL SELECT r.file_idx, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.k, r.ts_ns, r.pkt_idx, CASE WHEN r.ts_ns - s.kept > 30000000000 THEN r.ts_ns ELSE s.kept END, r.ts_ns - s.kept > 30000000000
  FROM run s JOIN rk r ON r.file_idx = s.file_idx AND r.src_ip = s.src_ip AND r.dst_ip = s.dst_ip AND r.src_port = s.src_port AND r.dst_port = s.dst_port AND r.k = s.k + 1)
SELECT s.file_idx, s.src_ip AS issuer_ip, s.dst_ip, 'tcp' AS proto, s.dst_port AS port, min(s.ts_ns) AS first_seen_ns FROM run s JOIN tcp a ON keep AND a.tcp_flags & 2 <> 0 AND a.tcp_flags & 16 <> 0 AND s.file_idx = a.file_idx AND s.src_ip = a.dst_ip AND s.dst_ip = a.src_ip
  AND s.src_port = a.dst_port AND s.dst_port = a.src_port AND (s.ts_ns, s.pkt_idx) < (a.ts_ns, a.pkt_idx) AND a.ts_ns - s.ts_ns <= 30000000000 GROUP BY 1, 2, 3, 5""",
    "tcp_midsession_edges": f"WITH {D.PACKETS}, {_SYN}, {_MIDE} SELECT file_idx, issuer_ip, dst_ip, 'tcp' AS proto, port, min(ts_ns) AS first_seen_ns FROM mide GROUP BY ALL",
    "udp_pair_edges": f"WITH {D.PACKETS}, {_udp(False)} SELECT * FROM ue",
    "udp_private_source": f"WITH {D.PACKETS}, {_udp(True)} SELECT file_idx, issuer_ip, dst_ip, proto, port, min(first_seen_ns) AS first_seen_ns FROM ue GROUP BY ALL",
    "ftp_exact_suppress": f"WITH {D.PACKETS}, {_ACK}, {_PASV}, {_quiet('ans', 'q1')} SELECT {_EV} FROM q1",
    "ftp_highport_suppress": f"WITH {D.PACKETS}, {_ACK}, {_low('ans', 'q1')} SELECT {_EV} FROM q1",
    "file_edges": f"WITH {_FILE} SELECT * FROM fe",
    "edge_cross_file_dedup": f"WITH {D.PACKETS}, {_ACK}, {_shake('ans', 'sh')}, {_CROSS.format('sh')} SELECT * FROM cross_",
    "edges_collected": f"WITH {_FILE}, {_CROSS.format('fe')} SELECT * FROM cross_ x WHERE NOT (proto = 'tcp' AND port >= 30000 AND EXISTS (SELECT 1 FROM cross_ c WHERE c.proto = 'tcp' AND c.port IN (21, 990) AND c.issuer_ip = x.issuer_ip AND c.dst_ip = x.dst_ip))",
    "dns_query_response_match": f"WITH {_MATCH} SELECT response_id, query_id FROM m WHERE k = 1",
    "dns_answer_evidence": f"WITH {_MATCH} SELECT query_id AS tx_id, ip, arg_min(ord, (response_id, ord)) AS ord, CAST(1 AS INT) AS evidence FROM m JOIN answers USING (response_id) WHERE k = 1 GROUP BY query_id, ip",
    "dns_tx_merge": f"""WITH {S.TX} SELECT min(tx_id) AS tx_id, issuer_ip, dns_name, proto, req_ts_ns, arg_min(pcap_file, (pcap_file, pcap_file)) AS pcap_file, coalesce(arg_min(name_evidence, (pcap_file, tx_id)) FILTER (WHERE coalesce(name_evidence, 0) <> 0), 0) AS name_evidence,
  arg_min(resolver_ip, (pcap_file, tx_id)) FILTER (WHERE resolver_ip IS NOT NULL) AS resolver_ip, count(*) AS copies FROM tx GROUP BY issuer_ip, dns_name, proto, req_ts_ns""",
    "sni_dedup": f"WITH {D.HELLOS} SELECT issuer_ip, dst_ip, port, sni AS dns_name, ts_ns AS req_ts_ns, pcap_file, 2 AS name_evidence, 34 AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY issuer_ip, dst_ip, port, sni ORDER BY file_idx, pkt_idx) AS r FROM hellos) WHERE r = 1",
    "conn_asof_direct": f"WITH {_LINK} SELECT conn_id, tx_id, dt_ns FROM dr",
    "conn_first_after": f"""WITH {_LINK} SELECT x.tx_id, arg_min(c.conn_id, (c.ts_ns, c.conn_id)) AS conn_id, arg_min(c.port, (c.ts_ns, c.conn_id)) AS port FROM ix x JOIN conns c ON c.issuer_ip = x.issuer_ip AND c.dst_ip = x.ip AND c.ts_ns > x.req_ts_ns GROUP BY x.tx_id""",
    "conn_fallback_unique_snapshot": f"WITH {_LINK} SELECT conn_id, tx_id, dt_ns FROM fb",
    "csv_guard": f"WITH {_LINK} SELECT conn_id, tx_id, dt_ns FROM gd",
    "best_candidate": f"""WITH {_LINK}, c AS (SELECT d.*, port, proto, row_number() OVER (PARTITION BY tx_id ORDER BY file_idx, pkt_idx, conn_id) AS r FROM dr d JOIN conns USING (conn_id))
SELECT tx_id, arg_min(port, (dt_ns, r)) AS port, arg_min(proto, (dt_ns, r)) AS proto FROM c WHERE r <= 8 GROUP BY tx_id""",
    "observed_conn_evidence": f"""WITH {_LINK}, x AS (SELECT tx_id, ip, ord, evidence FROM ips UNION ALL SELECT d.tx_id, c.dst_ip, NULL, 32 FROM dr d JOIN conns c USING (conn_id) WHERE EXISTS (SELECT 1 FROM ips i WHERE i.tx_id = d.tx_id AND i.ip = c.dst_ip)
  UNION ALL SELECT g.tx_id, c.dst_ip, NULL, (CASE WHEN coalesce(t.name_evidence, 0) = 0 THEN 1 ELSE t.name_evidence END) | 48 FROM gd g JOIN conns c USING (conn_id) JOIN tx t ON t.tx_id = g.tx_id)
SELECT tx_id, ip, min(ord) AS ord, CAST(bit_or(evidence) AS INT) AS evidence FROM x GROUP BY tx_id, ip""",
    "radius_coalesce": f"""WITH {_WIN}, a AS (SELECT *, CASE WHEN e > 9223372036854655807 THEN e ELSE e + 120000 END AS r FROM w1), b AS (SELECT *, max(r) OVER (PARTITION BY imsi, ip, sid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
c AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY imsi, ip, sid ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT imsi, ip, sid, min(s) AS start_ms, nullif(max(e), 9223372036854775807) AS end_ms FROM c GROUP BY imsi, ip, sid, g""",
    "radius_label_digits": f"""WITH {S.TX}, {_WIN}, w2 AS (SELECT ip, s, e, CASE session_row % 3 WHEN 0 THEN left(imsi, 14) WHEN 1 THEN imsi ELSE imsi || '7' END AS imsi FROM w1)
SELECT tx_id, min(imsi) AS imsi FROM tx JOIN w2 ON tx.issuer_ip = w2.ip AND req_ts_ns // 1000000 BETWEEN s AND e GROUP BY tx_id""",
    "radius_label_lookup": f"WITH {S.TX}, {_WIN} SELECT tx_id, min(imsi) AS imsi FROM tx JOIN w1 ON tx.issuer_ip = w1.ip AND req_ts_ns // 1000000 BETWEEN s AND e GROUP BY tx_id",
}
