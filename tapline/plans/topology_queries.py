"""Queries of the topology chain, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.operators import topology as T
from tapline.plans import relations as R
from tapline.plans import sqltext as S

COLUMNS = ["issuer", "dst", "dns_name", "dns_source", "proto", "port", "observed_ns", "ord"]


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    return R.edges(spark, folder), R.transactions(spark, folder, "tx_id req_ts_ns issuer_ip dns_name resolver_ip dest_port proto name_evidence"), R.transaction_addresses(spark, folder), R.name_map(spark, folder)


def topology_asof(spark, folder):
    edges, tx, addresses, _ = _inputs(spark, folder)
    return T.best_transactions(T.eligible(edges, tx), tx, addresses)


def topology_csv_fallback(spark, folder):
    return T.attributed(*_inputs(spark, folder))


def topology_emit_dedup(spark, folder):
    return T.folded(T.attributed(*_inputs(spark, folder)))


def topology_unresolved_suppress(spark, folder):
    return T.without_unnamed_twins(topology_emit_dedup(spark, folder))


def topology_strong_over_csv(spark, folder):
    return T.strong_over_fallback(topology_unresolved_suppress(spark, folder))


def topology_cross_port_downgrade(spark, folder):
    return T.cross_port_downgrade(topology_strong_over_csv(spark, folder))


def topology_full(spark, folder):
    return T.matrix(*_inputs(spark, folder))


def topology_peer_completion(spark, folder):
    """The peer rule by itself, on the stored rows."""
    rows = R.topology(spark, folder).filter("issuer_ip is not null and destination_ip is not null and protocol is not null and port is not null")
    rows = rows.select(F.col("issuer_ip").alias("issuer"), F.col("destination_ip").alias("dst"), "dns_name", "dns_source", F.col("protocol").alias("proto"), "port", "observed_ns", F.col("row_ord").alias("ord"))
    return T.completed_by_peers(rows)


def topology_short(spark, folder):
    return T.short(topology_full(spark, folder))


def topology_sorted_rank(spark, folder):
    rows = T.with_sort_keys(topology_full(spark, folder))
    return rows.select("ord", "endpoints", "inner", (F.col("dns_name") == "").cast("int").alias("blank"))


NAMES = "topology_asof topology_csv_fallback topology_emit_dedup topology_unresolved_suppress topology_strong_over_csv topology_cross_port_downgrade topology_full topology_peer_completion topology_short topology_sorted_rank"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_ALL = "issuer, dst, dns_name, dns_source, proto, port, observed_ns, ord"
_BASE = f"""{S.TX}, {S.TXIP}, {S.EDGES}, {S.MAP},
resolvers AS (SELECT DISTINCT resolver_ip AS ip FROM tx WHERE {S.ipv4('resolver_ip')} IS NOT NULL),
el AS (SELECT * FROM edges WHERE coalesce(issuer_ip, '') <> '' AND dst_ip IS NOT NULL AND coalesce(port, 0) <> 0 AND port NOT IN (53, 853, 5353) AND issuer_ip NOT IN (SELECT ip FROM resolvers)),
cand AS (SELECT e.edge_ord, t.tx_id, t.req_ts_ns, {S.name('t.dns_name')} AS name, coalesce(t.name_evidence, 0) | coalesce(i.evidence, 0) AS bits,
  CASE WHEN t.proto IS NULL THEN 0 ELSE 2 END + CASE WHEN coalesce(t.dest_port, 0) > 0 THEN 2 ELSE 0 END + CASE WHEN coalesce(t.name_evidence, 0) & 2 <> 0 THEN 1 ELSE 0 END AS score
  FROM el e JOIN tx t ON e.issuer_ip = t.issuer_ip AND t.req_ts_ns BETWEEN e.first_seen_ns - 120000000000 AND e.first_seen_ns AND t.dns_name <> ''
    AND (t.proto IS NULL OR t.proto = e.proto) AND (coalesce(t.dest_port, 0) <= 0 OR t.dest_port = e.port)
  JOIN tx_ip i ON i.tx_id = t.tx_id AND i.ip = e.dst_ip),
best AS (SELECT edge_ord, tx_id, name, bits FROM (SELECT *, row_number() OVER (PARTITION BY edge_ord ORDER BY score DESC, req_ts_ns DESC, tx_id) AS r FROM cand) WHERE r = 1),
one AS (SELECT ip, min(dns) AS map_name FROM pairs GROUP BY ip HAVING count(DISTINCT dns) = 1),
j AS (SELECT e.*, b.name, b.bits, b.tx_id IS NOT NULL AS found, o.map_name, {S.private('e.dst_ip')} AS pd, {S.private('e.issuer_ip')} AS pi
  FROM el e LEFT JOIN best b ON b.edge_ord = e.edge_ord LEFT JOIN one o ON o.ip = e.dst_ip),
att AS (SELECT issuer_ip AS issuer, dst_ip AS dst, CASE WHEN pd THEN '' WHEN found AND name <> '' THEN name ELSE coalesce(map_name, '') END AS dns_name,
  CASE WHEN pd THEN '' WHEN found AND name <> '' THEN CASE WHEN bits <> 0 THEN {S.label('(bits | 32)')} ELSE '' END WHEN found THEN CASE WHEN map_name IS NOT NULL THEN 'csv+conn' ELSE '' END
    WHEN pi THEN CASE WHEN map_name IS NOT NULL THEN 'csv+mid' ELSE 'mid-session' END WHEN map_name IS NOT NULL THEN 'csv+conn' ELSE '' END AS dns_source,
  proto, port, first_seen_ns AS observed_ns, edge_ord AS ord FROM j)"""
_FOLD = f"""fold AS (SELECT issuer, dst, dns_name, dns_source, proto, port, observed_ns, o AS ord FROM (SELECT *, min(ord) OVER w AS o, row_number() OVER (PARTITION BY issuer, dst, dns_name, proto, port ORDER BY {S.rank('dns_source')} DESC, ord) AS r
  FROM att WINDOW w AS (PARTITION BY issuer, dst, dns_name, proto, port)) WHERE r = 1)"""
_TWIN = "twin AS (SELECT f.* FROM fold f WHERE dns_name <> '' OR NOT EXISTS (SELECT 1 FROM fold g WHERE g.issuer = f.issuer AND g.dst = f.dst AND g.proto = f.proto AND g.port = f.port AND g.dns_name <> ''))"
_STRONG = f"""strong AS (SELECT * FROM twin WHERE dns_name <> '' AND dns_source IN ('dns+synack', 'dns+conn+synack') AND NOT {S.private('dst')}),
kept AS (SELECT t.* FROM twin t WHERE NOT (dns_name <> '' AND dns_source IN ('csv+mid', 'csv+conn') AND NOT {S.private('dst')}
  AND EXISTS (SELECT 1 FROM strong s WHERE s.issuer = t.issuer AND s.dst = t.dst AND s.proto = t.proto AND s.port = t.port)))"""
_CROSS = f"""k2 AS (SELECT t.*, dns_name <> '' AND dns_source IN ('csv+mid', 'csv+conn') AND NOT {S.private('dst')} AND EXISTS (SELECT 1 FROM strong s WHERE s.issuer = t.issuer AND s.dst = t.dst AND s.proto = t.proto)
  AND NOT EXISTS (SELECT 1 FROM strong s WHERE s.issuer = t.issuer AND s.dst = t.dst AND s.proto = t.proto AND {S.name_trim_first('s.dns_name')} = {S.name_trim_first('t.dns_name')}) AS clash FROM kept t),
crossed AS (SELECT issuer, dst, CASE WHEN clash THEN '' ELSE dns_name END AS dns_name, CASE WHEN clash THEN CASE WHEN dns_source = 'csv+mid' THEN 'mid-session' ELSE '' END ELSE dns_source END AS dns_source, proto, port, observed_ns, ord FROM k2)"""


def _peers(source: str) -> str:
    return f"""don AS (SELECT dst, proto, port, count(DISTINCT CASE WHEN dns_source IN ('dns+synack', 'sni+synack') THEN dns_name END) AS nd, count(DISTINCT CASE WHEN dns_source = 'dns+conn+synack' THEN dns_name END) AS ni,
  min(CASE WHEN dns_source IN ('dns+synack', 'sni+synack') THEN dns_name END) AS d, min(CASE WHEN dns_source = 'dns+conn+synack' THEN dns_name END) AS i FROM {source} WHERE dns_name <> '' AND NOT {S.private('dst')} GROUP BY dst, proto, port),
peer AS (SELECT x.issuer, x.dst, CASE WHEN x.dns_name = '' AND NOT {S.private('x.dst')} AND nd = 1 THEN d WHEN x.dns_name = '' AND NOT {S.private('x.dst')} AND nd = 0 AND ni = 1 THEN i ELSE x.dns_name END AS dns_name,
  CASE WHEN x.dns_name = '' AND NOT {S.private('x.dst')} AND nd = 1 THEN 'peer+ipport' WHEN x.dns_name = '' AND NOT {S.private('x.dst')} AND nd = 0 AND ni = 1 THEN 'peer+ipport+conn' ELSE x.dns_source END AS dns_source, x.proto, x.port, x.observed_ns, x.ord
  FROM {source} x LEFT JOIN don n ON n.dst = x.dst AND n.proto = x.proto AND n.port = x.port)"""


CHAIN = f"{_BASE}, {_FOLD}, {_TWIN}, {_STRONG}, {_CROSS}, {_peers('crossed')}"
SQL = {
    "topology_asof": f"WITH {_BASE} SELECT edge_ord, tx_id, name, bits FROM best",
    "topology_csv_fallback": f"WITH {_BASE} SELECT {_ALL} FROM att",
    "topology_emit_dedup": f"WITH {_BASE}, {_FOLD} SELECT {_ALL} FROM fold",
    "topology_unresolved_suppress": f"WITH {_BASE}, {_FOLD}, {_TWIN} SELECT {_ALL} FROM twin",
    "topology_strong_over_csv": f"WITH {_BASE}, {_FOLD}, {_TWIN}, {_STRONG} SELECT {_ALL} FROM kept",
    "topology_cross_port_downgrade": f"WITH {_BASE}, {_FOLD}, {_TWIN}, {_STRONG}, {_CROSS} SELECT {_ALL} FROM crossed",
    "topology_full": f"WITH {CHAIN} SELECT {_ALL} FROM peer",
    "topology_peer_completion": f"""WITH {S.TOPO}, rows AS (SELECT issuer_ip AS issuer, destination_ip AS dst, dns_name, dns_source, protocol AS proto, port, observed_ns, row_ord AS ord FROM topo
  WHERE issuer_ip IS NOT NULL AND destination_ip IS NOT NULL AND protocol IS NOT NULL AND port IS NOT NULL), {_peers('rows')} SELECT {_ALL} FROM peer""",
    "topology_short": f"WITH {CHAIN} SELECT {_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY issuer, dst, proto, port ORDER BY dns_name = '', dns_name, ord) AS r FROM peer) WHERE r = 1",
    "topology_sorted_rank": f"""WITH {CHAIN}, c AS (SELECT issuer, count(DISTINCT (dst, proto, port)) AS endpoints FROM peer GROUP BY issuer)
SELECT ord, endpoints, CAST({S.private('dst')} AS INT) AS inner, CAST(dns_name = '' AS INT) AS blank FROM peer JOIN c USING (issuer)""",
}
