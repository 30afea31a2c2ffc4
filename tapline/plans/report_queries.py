"""Queries of the reports and of the map of addresses to names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapline.functions import evidence as ev
from tapline.functions.names import canonical_name
from tapline.functions.numbers import floor_div
from tapline.operators import namemap, reports, topology
from tapline.plans import relations as R
from tapline.plans import sqltext as S
from tapline.plans import topology_queries as T
from tapline.plans.tables import table


def _tx(spark, folder, columns=""):
    return R.transactions(spark, folder, columns), R.transaction_addresses(spark, folder)


# Columns the reports read.
WHO = "tx_id issuer_ip issuer_label dns_name dest_port"
WHEN = "tx_id req_ts_ns issuer_ip dns_name pcap_file"
BITS = "tx_id dns_name name_evidence"


def _topo(spark, folder):
    return R.topology(spark, folder).select(F.col("issuer_ip").alias("issuer"), F.col("destination_ip").alias("dst"), "dns_name", "dns_source", F.col("protocol").alias("proto"), "port", "observed_ns", F.col("row_ord").alias("ord"))


def records_dedup(spark, folder):
    return reports.records(*_tx(spark, folder))


def table_stats(spark, folder):
    return reports.table_stats(*_tx(spark, folder, f"{WHO} req_ts_ns"))


def unused_dns(spark, folder):
    return reports.unused_names(*_tx(spark, folder, "tx_id dns_name dest_port issuer_ip pcap_file"))


def unused_dns_files(spark, folder):
    return reports.unused_name_files(R.transactions(spark, folder, f"{WHO} req_ts_ns pcap_file"))


def issuer_profile(spark, folder):
    return reports.issuer_profile(*_tx(spark, folder, WHO))


def connectivity_matrix(spark, folder):
    return reports.connectivity(*_tx(spark, folder, WHO))


def connectivity_short(spark, folder):
    return reports.connectivity_short(reports.connectivity(*_tx(spark, folder, WHO)))


def unresolved_dns(spark, folder):
    return reports.unresolved_names(*_tx(spark, folder, WHEN))


def unresolved_per_tx(spark, folder):
    return reports.unresolved_per_transaction(*_tx(spark, folder, WHEN))


def name_evidence_index(spark, folder):
    return reports.name_evidence(*_tx(spark, folder, BITS))


def unresolved_minus_topology(spark, folder):
    return reports.minus_topology(unresolved_dns(spark, folder), _topo(spark, folder))


def service_endpoints(spark, folder):
    """Endpoints of the stored topology rows."""
    return reports.service_endpoints(_topo(spark, folder))


def attributed_endpoints(spark, folder):
    """Endpoints straight from edges: attribution, rules, folding. Who talks to which named service."""
    return reports.service_endpoints(T.topology_full(spark, folder))


def external_endpoints(spark, folder):
    return reports.external_endpoints(_topo(spark, folder))


def egress_endpoints(spark, folder):
    return reports.egress_endpoints(_topo(spark, folder))


def unresolved_ip(spark, folder):
    return reports.unresolved_endpoints(_topo(spark, folder))


def ipdns_load(spark, folder):
    return namemap.load(table(spark, folder, "ip_dns_lines"), F.col("line_id"))


def ipdns_unambiguous(spark, folder):
    return topology.unambiguous(R.name_map(spark, folder))


def _split(spark, folder):
    pairs = table(spark, folder, "ip_dns")
    return pairs.filter("batch_no = 0"), pairs.filter("batch_no > 0")


def ipdns_merge_new_pairs(spark, folder):
    return namemap.new_pairs(*_split(spark, folder))


def ipdns_merged(spark, folder):
    return namemap.merged(*_split(spark, folder))


def ipdns_normalize_multi(spark, folder):
    return namemap.ambiguous(table(spark, folder, "ip_dns"))


def learned_pairs(spark, folder):
    return namemap.learned(table(spark, folder, "ip_dns"), *_tx(spark, folder, BITS))


def append_audit(spark, folder):
    tx = _tx(spark, folder)
    return namemap.audit(namemap.learned(table(spark, folder, "ip_dns"), *tx), *tx, time=reports.nanoseconds(F.col("req_ts_ns")))


def recover_pairs(spark, folder):
    """A day stands for a run here."""
    day = lambda c: floor_div(F.col(c), 86_400_000_000_000).alias("run")
    wanted = _topo(spark, folder).filter("dns_name = ''").select(day("observed_ns"), F.col("dst").alias("ip"))
    tx, addresses = _tx(spark, folder, "tx_id req_ts_ns dns_name")
    rows = tx.join(addresses, "tx_id").select(day("req_ts_ns"), "ip", canonical_name(F.col("dns_name")).alias("dns"), ev.label(F.col("evidence")).alias("source"), (F.col("tx_id") * 16 + F.col("ord")).alias("seq"))
    return namemap.recovered(wanted, rows)


NAMES = """records_dedup table_stats unused_dns unused_dns_files issuer_profile connectivity_matrix connectivity_short unresolved_dns unresolved_per_tx name_evidence_index unresolved_minus_topology service_endpoints attributed_endpoints
external_endpoints egress_endpoints unresolved_ip ipdns_load ipdns_unambiguous ipdns_merge_new_pairs ipdns_merged ipdns_normalize_multi learned_pairs append_audit recover_pairs"""
QUERIES = {n: globals()[n] for n in NAMES.split()}

_B = f"{S.TX}, {S.TXIP}"
_WHO = "coalesce(nullif(issuer_label, ''), issuer_ip, '')"
_KEYS = f"""k AS (SELECT tx_id, issuer, name, dest_port FROM (SELECT tx_id, {_WHO} AS issuer, coalesce(dns_name, '') AS name, dest_port, row_number() OVER (PARTITION BY {_WHO}, coalesce(dns_name, ''), dest_port ORDER BY req_ts_ns, coalesce(dns_name, ''), tx_id) AS r
  FROM tx WHERE dest_port IS NOT NULL) WHERE r = 1)"""
_T = f"{S.TOPO}, t AS (SELECT issuer_ip AS issuer, destination_ip AS dst, dns_name, dns_source, protocol AS proto, port, observed_ns FROM topo)"
_UNRES = f"""n AS (SELECT tx_id, {S.name('dns_name')} AS name, coalesce(issuer_ip, '') AS who, pcap_file, req_ts_ns, dns_name FROM tx), res AS (SELECT DISTINCT name FROM n JOIN tx_ip USING (tx_id) WHERE name <> ''),
u AS (SELECT name AS dns_name, who AS issuer_ip, coalesce(arg_min(pcap_file, (req_ts_ns, coalesce(dns_name, ''), tx_id)) FILTER (WHERE pcap_file <> ''), '') AS first_pcap FROM n WHERE name <> '' AND name NOT IN (SELECT name FROM res) GROUP BY name, who)"""


def _endpoints(source: str) -> str:
    return f"""s AS (SELECT {S.ipv4('dst')} AS ip, coalesce({S.name('dns_name')}, '') AS dns, lower(trim(proto)) AS protocol, port, {S.ipv4('issuer')} AS issuer, observed_ns // 1000000 AS ms FROM {source}),
g AS (SELECT ip, dns, protocol, port, count(DISTINCT CASE WHEN issuer IS NOT NULL AND NOT {S.public('issuer')} THEN issuer END) AS peers_count, min(ms) AS observed_at FROM s WHERE ip IS NOT NULL AND protocol <> '' AND port <> 0 GROUP BY ip, dns, protocol, port),
h AS (SELECT *, bool_or(dns <> '') OVER (PARTITION BY ip, protocol, port) AS named FROM g),
z AS (SELECT ip, CASE WHEN dns <> '' THEN dns WHEN {S.public('ip')} THEN '[no-dns-attribution]' ELSE '[private-server]' END AS dns, protocol, port, peers_count, observed_at FROM h WHERE dns <> '' OR NOT named)
SELECT ip, dns, protocol, port, peers_count, {S.fnv64("(ip || '|' || dns || '|' || protocol || '|' || port)")} AS hash_val, observed_at FROM z"""


def _pairs(where: str) -> str:
    return f"SELECT {S.ipv4('ip')} AS ip, {S.name('dns')} AS dns FROM ip_dns WHERE {where}"


_GOOD = "ip IS NOT NULL AND dns <> ''"
_SPLIT = f"b AS (SELECT * FROM ({_pairs('batch_no = 0')}) WHERE {_GOOD}), x AS (SELECT * FROM ({_pairs('batch_no > 0')}) WHERE {_GOOD}), np AS (SELECT ip, arg_min(dns, (length(dns), dns)) AS dns FROM x WHERE ip NOT IN (SELECT ip FROM b) GROUP BY ip)"
_LEARN = f"""base AS (SELECT DISTINCT ip FROM ({_pairs('true')}) WHERE {_GOOD}),
st AS (SELECT i.ip, {S.name('t.dns_name')} AS dns, CASE WHEN coalesce(i.evidence, 0) <> 0 THEN i.evidence ELSE coalesce(t.name_evidence, 0) END AS bits FROM tx t JOIN tx_ip i USING (tx_id) WHERE t.dns_name <> ''),
lp AS (SELECT ip, arg_min(dns, (length(dns), dns)) AS dns FROM st WHERE bits & 33 = 33 AND bits & 16 = 0 AND NOT {S.private('ip')} AND dns <> '' AND ip NOT IN (SELECT ip FROM base) GROUP BY ip)"""
_MS = "strftime(make_timestamp(req_ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%g')"

SQL = {
    "records_dedup": f"""WITH {_B}, {_KEYS}, a AS (SELECT k.tx_id, array_to_string(list(ip ORDER BY ord, ip) FILTER (WHERE ip IS NOT NULL), ';') AS ips,
  array_to_string(list(ip || '=' || {S.label("(CASE WHEN coalesce(evidence, 0) <> 0 THEN evidence ELSE coalesce(name_evidence, 0) END)")} ORDER BY ord, ip) FILTER (WHERE ip IS NOT NULL), ';') AS src FROM k JOIN tx USING (tx_id) LEFT JOIN tx_ip USING (tx_id) GROUP BY k.tx_id)
SELECT strftime(make_timestamp(req_ts_ns // 1000), '%Y-%m-%d %H:%M:%S.') || lpad(CAST(req_ts_ns % 1000000000 // 1000000 AS VARCHAR), 3, '0') AS request_time, k.tx_id, k.issuer AS issuer_ip, k.name AS dns_name, coalesce(ips, '') AS resolved_ips, coalesce(src, '') AS resolved_ip_sources, resolver_ip, k.dest_port AS destination_port
FROM k JOIN tx USING (tx_id) JOIN a USING (tx_id)""",
    "table_stats": f"""WITH {_B}, {_KEYS} SELECT count(DISTINCT issuer) AS unique_sources, (SELECT count(DISTINCT ip) FROM k JOIN tx_ip USING (tx_id)) AS unique_dest_ips, count(DISTINCT nullif(name, '')) AS unique_connected_dns FROM k""",
    "unused_dns": f"""WITH {_B}, un AS (SELECT dns_name FROM tx WHERE dns_name <> '' GROUP BY dns_name HAVING count(dest_port) = 0), r AS (SELECT * FROM tx WHERE dns_name IN (SELECT dns_name FROM un) AND pcap_file <> '')
SELECT DISTINCT dns_name, 'issuer' AS kind, issuer_ip AS value FROM r WHERE issuer_ip <> '' UNION SELECT DISTINCT dns_name, 'pcap', pcap_file FROM r UNION SELECT DISTINCT dns_name, 'ip', ip FROM r JOIN tx_ip USING (tx_id)""",
    "unused_dns_files": f"""WITH {_B}, {_KEYS}, f AS (SELECT DISTINCT dns_name, pcap_file FROM tx WHERE dns_name <> '' AND pcap_file <> '' AND dns_name NOT IN (SELECT name FROM k))
SELECT dns_name, pcap_file FROM (SELECT *, row_number() OVER (PARTITION BY dns_name ORDER BY pcap_file) AS r FROM f) WHERE r <= 3""",
    "issuer_profile": f"""WITH {_B}, w AS (SELECT *, {_WHO} AS issuer FROM tx), i AS (SELECT issuer, count(DISTINCT ip) AS n FROM w JOIN tx_ip USING (tx_id) GROUP BY issuer)
SELECT w.issuer, count(*) AS total_dns, count(DISTINCT coalesce(dns_name, '')) AS unique_names, coalesce(any_value(n), 0) AS unique_ips, count(DISTINCT CASE WHEN dest_port > 0 THEN dest_port END) AS unique_ports,
  count(CASE WHEN dest_port > 0 THEN 1 END) / count(*) AS connection_rate FROM w LEFT JOIN i ON i.issuer = w.issuer WHERE w.issuer <> '' GROUP BY w.issuer""",
    "connectivity_matrix": f"WITH {_B} SELECT DISTINCT {_WHO} AS issuer, coalesce(dns_name, '') AS dns_name, ip, dest_port AS port FROM tx JOIN tx_ip USING (tx_id) WHERE dest_port > 0 AND {_WHO} <> ''",
    "connectivity_short": f"WITH {_B} SELECT {_WHO} AS issuer, coalesce(dns_name, '') AS dns_name, min(ip) AS ip, dest_port AS port FROM tx JOIN tx_ip USING (tx_id) WHERE dest_port > 0 AND {_WHO} <> '' GROUP BY 1, 2, 4",
    "unresolved_dns": f"WITH {_B}, {_UNRES} SELECT dns_name, issuer_ip, first_pcap FROM u",
    "unresolved_per_tx": f"""WITH {_B}, n AS (SELECT *, regexp_replace({S.trim('dns_name')}, '[.]$', '') AS name, coalesce(issuer_ip, '') AS who FROM tx WHERE tx_id NOT IN (SELECT tx_id FROM tx_ip) AND pcap_file <> '')
SELECT name AS dns_name, who AS issuer_ip, arg_min(pcap_file, (req_ts_ns, coalesce(dns_name, ''), tx_id)) AS first_pcap FROM n WHERE name <> '' GROUP BY name, who""",
    "name_evidence_index": f"""WITH {_B}, a AS (SELECT {S.name('dns_name')} AS name, ip, CAST(bit_or(coalesce(name_evidence, 0) | coalesce(evidence, 0)) AS INT) AS b FROM tx JOIN tx_ip USING (tx_id) WHERE dns_name <> '' GROUP BY 1, 2),
c AS (SELECT name, ip, CASE WHEN b & 15 <> 0 THEN b & ~16 ELSE b END AS evidence FROM a) SELECT name, ip, evidence, CASE WHEN evidence <> 0 THEN {S.label('(evidence | 32)')} ELSE '' END AS label FROM c""",
    "unresolved_minus_topology": f"WITH {_B}, {_UNRES}, {_T} SELECT dns_name, issuer_ip, first_pcap FROM u WHERE dns_name NOT IN (SELECT {S.name('dns_name')} FROM t WHERE trim(dns_name) <> '')",
    "service_endpoints": f"WITH {_T}, {_endpoints('t')}",
    "attributed_endpoints": f"WITH {T.CHAIN}, {_endpoints('peer')}",
    "external_endpoints": f"""WITH {_T}, a AS (SELECT *, {S.suffix('dns_name')} AS suffix FROM t WHERE dns_name <> ''), i AS (SELECT DISTINCT suffix, dst FROM a WHERE suffix <> '' AND dst IS NOT NULL)
SELECT DISTINCT suffix, 'name' AS kind, dns_name AS value FROM a WHERE suffix <> '' UNION SELECT DISTINCT suffix, proto, CAST(port AS VARCHAR) FROM a WHERE suffix <> '' AND proto <> '' AND port <> 0
UNION SELECT suffix, 'ip', dst FROM (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY dst) AS r FROM i) WHERE r <= 10""",
    "egress_endpoints": f"""WITH {_T} SELECT DISTINCT dst AS ip, 'name' AS kind, dns_name AS value FROM t WHERE {S.public('dst')} AND dns_name <> '' UNION SELECT DISTINCT dst, proto, CAST(port AS VARCHAR) FROM t WHERE {S.public('dst')} AND proto <> '' AND port <> 0""",
    "unresolved_ip": f"WITH {_T} SELECT dst AS ip, coalesce(port, 0) AS port, lower(trim(proto)) AS proto, count(*) AS count FROM t WHERE trim(dns_name) = '' AND {S.public('dst')} AND trim(proto) <> '' GROUP BY 1, 2, 3",
    "ipdns_load": f"""WITH a AS (SELECT line_id, lower({S.trim('line')}) AS t FROM ip_dns_lines), p AS (SELECT line_id, CASE WHEN contains(t, ',') THEN string_split(t, ',') ELSE regexp_split_to_array(t, '\\s+') END AS p FROM a WHERE t <> '' AND t NOT LIKE '#%'),
f AS (SELECT line_id, {S.trim('p[1]')} AS l, {S.trim('p[2]')} AS r FROM p WHERE len(p) >= 2),
g AS (SELECT line_id, coalesce({S.ipv4('l')}, {S.ipv4('r')}) AS ip, {S.name(f"(CASE WHEN {S.ipv4('l')} IS NOT NULL THEN r ELSE l END)")} AS dns FROM f)
SELECT ip, dns, min(line_id) AS ord FROM g WHERE ip IS NOT NULL AND dns <> '' GROUP BY ip, dns""",
    "ipdns_unambiguous": f"WITH {S.MAP} SELECT ip, min(dns) AS map_name FROM pairs GROUP BY ip HAVING count(DISTINCT dns) = 1",
    "ipdns_merge_new_pairs": f"WITH {_SPLIT} SELECT ip, dns FROM np",
    "ipdns_merged": f"WITH {_SPLIT} SELECT ip, dns FROM b UNION SELECT ip, dns FROM np",
    "ipdns_normalize_multi": f"WITH a AS (SELECT DISTINCT ip, dns FROM ({_pairs('true')}) WHERE {_GOOD}) SELECT ip, names, dns FROM (SELECT *, count(*) OVER (PARTITION BY ip) AS names FROM a) WHERE names > 1",
    "learned_pairs": f"WITH {_B}, {_LEARN} SELECT ip, dns FROM lp",
    "append_audit": f"""WITH {_B}, {_LEARN}, c AS (SELECT i.ip, {S.name('t.dns_name')} AS dns, coalesce(i.evidence, t.name_evidence, 0) AS bits, t.* FROM tx t JOIN tx_ip i USING (tx_id) WHERE t.dns_name <> ''),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ip, dns ORDER BY req_ts_ns, coalesce(pcap_file, ''), tx_id) AS r FROM c WHERE bits & 33 = 33) WHERE r = 1)
SELECT lp.dns, lp.ip, coalesce({S.label('bits')}, '') AS evidence, coalesce(strftime(make_timestamp(req_ts_ns // 1000), '%Y-%m-%d %H:%M:%S.') || lpad(CAST(req_ts_ns % 1000000000 AS VARCHAR), 9, '0') || 'Z', '') AS observed_at,
  coalesce(issuer_ip, '') AS issuer_ip, coalesce(resolver_ip, '') AS resolver_ip, coalesce(proto, '') AS protocol, coalesce(dest_port, 0) AS port, coalesce(pcap_file, '') AS pcap_file FROM lp LEFT JOIN f ON f.ip = lp.ip AND f.dns = lp.dns""",
    "recover_pairs": f"""WITH {_B}, {_T}, r AS (SELECT t.req_ts_ns // 86400000000000 AS run, i.ip, {S.name('t.dns_name')} AS dns, {S.label('i.evidence')} AS source, t.tx_id * 16 + i.ord AS seq FROM tx t JOIN tx_ip i USING (tx_id)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, ip ORDER BY {S.recovery_rank('source')} DESC, seq, dns) AS q FROM r WHERE dns <> '') WHERE q = 1),
o AS (SELECT ip, arg_min(dns, run) AS dns FROM k GROUP BY ip), w AS (SELECT DISTINCT observed_ns // 86400000000000 AS run, dst AS ip FROM t WHERE dns_name = '' AND {S.public('dst')})
SELECT DISTINCT coalesce(k.dns, o.dns) AS dns, w.ip FROM w LEFT JOIN k ON k.run = w.run AND k.ip = w.ip LEFT JOIN o ON o.ip = w.ip WHERE coalesce(k.dns, o.dns) IS NOT NULL""",
}
