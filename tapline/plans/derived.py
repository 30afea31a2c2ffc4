"""Packets and DNS messages derived from the ``events`` table, as SQL that both engines read the same way.

Only integer arithmetic is used. ``relation`` runs a text on Spark; the comparison uses the same text as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapline.plans.tables import table

BASE = """ev AS (SELECT event_id AS e, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(abs(value) * 100) AS BIGINT) AS v, event_type AS ty FROM events),
hs AS (SELECT e, k, v, ty, CAST(floor(e / 400.0) AS INT) AS f, (1704067200000 + e * 700) * 1000000 AS ts, CAST(1024 + e % 60000 AS INT) AS sp,
  CASE WHEN u % 17 = 0 THEN concat('44.1.1.', CAST(1 + u % 250 AS STRING)) WHEN u % 10 = 0 THEN concat('100.64.', CAST(CAST(floor(u / 250.0) AS BIGINT) AS STRING), '.', CAST(1 + u % 250 AS STRING))
    ELSE concat('10.20.', CAST(CAST(floor(u / 250.0) AS BIGINT) AS STRING), '.', CAST(1 + u % 250 AS STRING)) END AS src,
  CASE WHEN k % 11 = 0 THEN concat('10.4.17.', CAST(1 + k AS STRING)) WHEN k % 13 = 0 THEN concat('203.0.113.', CAST(1 + k AS STRING)) ELSE concat('34.120.', CAST(k % 8 AS STRING), '.', CAST(1 + k AS STRING)) END AS dst,
  CAST(CASE (k + e % 2) % 5 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 8883 WHEN 3 THEN 21 ELSE 40000 + k END AS INT) AS port, CASE WHEN u % 2 = 0 THEN '8.8.8.8' ELSE '10.4.0.230' END AS resolver FROM ev)"""

PACKETS = f"""{BASE},
raw AS (
  SELECT f, e, 0 AS j, ts + (v % 7000) * 1000000 AS t, src AS a, dst AS b, 'tcp' AS l4, sp AS ap, port AS bp, 2 AS flags, CAST(NULL AS STRING) AS payload FROM hs WHERE ty IN ('view', 'click', 'error')
  UNION ALL SELECT f, e, 1, ts + (v % 7000) * 1000000 + CASE WHEN k % 37 = 0 THEN 31000000000 ELSE 10000000 END, dst, src, 'tcp', port, sp, 18, CAST(NULL AS STRING) FROM hs WHERE ty IN ('view', 'click')
  UNION ALL SELECT f, e, 2, ts + 1500000000, src, dst, 'tcp', sp, port, 2, CAST(NULL AS STRING) FROM hs WHERE ty = 'click' AND k % 5 = 0
  UNION ALL SELECT f, e, 3, ts + 50000000, dst, src, 'tcp', port, sp, CASE WHEN k % 9 = 0 THEN 4 ELSE 16 END, CAST(NULL AS STRING) FROM hs WHERE ty = 'error'
  UNION ALL SELECT f, e, 0, ts, src, dst, 'udp', CAST(50000 + k AS INT), CASE WHEN k % 7 = 0 THEN 123 ELSE 3000 END, 0, CAST(NULL AS STRING) FROM hs WHERE ty = 'signup'
  UNION ALL SELECT f, e, 1, ts + CASE WHEN k % 19 = 0 THEN 31000000000 ELSE 10000000 END, dst, src, 'udp', CASE WHEN k % 7 = 0 THEN 123 ELSE 3000 END, CAST(50000 + k AS INT), 0, CAST(NULL AS STRING) FROM hs WHERE ty = 'signup'
  UNION ALL SELECT f, e, 2, ts + 20000000, src, dst, 'udp', CAST(50000 + k AS INT), CASE WHEN k % 7 = 0 THEN 123 ELSE 3000 END, 0, CAST(NULL AS STRING) FROM hs WHERE ty = 'signup' AND k % 2 = 1
  UNION ALL SELECT f, e, 4, ts, dst, src, 'tcp', 21, sp, 24, CASE WHEN e % 3 = 0 THEN concat('227 Entering Passive Mode (10,1,2,3,', CAST(CAST(floor((2000 + k) / 256.0) AS BIGINT) AS STRING), ',', CAST((2000 + k) % 256 AS STRING), ')') WHEN e % 3 = 1 THEN concat('229 Extended (|||', CAST(2000 + k AS STRING), '|)') ELSE '220 ready' END FROM hs WHERE ty = 'purchase'
  UNION ALL SELECT f, e, 5, ts + 100000000, src, dst, 'tcp', sp, CAST(CASE WHEN k % 4 = 0 THEN 40000 + k ELSE 2000 + k END AS INT), 2, CAST(NULL AS STRING) FROM hs WHERE ty = 'purchase'
  UNION ALL SELECT f, e, 6, ts + 110000000, dst, src, 'tcp', CAST(CASE WHEN k % 4 = 0 THEN 40000 + k ELSE 2000 + k END AS INT), sp, 18, CAST(NULL AS STRING) FROM hs WHERE ty = 'purchase'),
packets AS (SELECT f AS file_idx, concat('cap', CAST(f AS STRING), '.pcap') AS pcap_file, CAST(e * 8 + j AS BIGINT) AS pkt_idx, t AS ts_ns, a AS src_ip, b AS dst_ip, l4, CAST(ap AS INT) AS src_port, CAST(bp AS INT) AS dst_port, CAST(flags AS INT) AS tcp_flags, payload FROM raw)"""

MESSAGES = f"""{BASE},
qs AS (SELECT e, 0 AS j, k, f, ts, src, sp, resolver, CAST(1 + e % 65535 AS INT) AS id, concat('h', CAST(k AS STRING), '.example') AS name FROM hs WHERE ty IN ('view', 'click', 'purchase')
  UNION ALL SELECT e, 1, k, f, ts + 5000000, src, sp, resolver, CAST(1 + e % 65535 AS INT), concat('h', CAST(k AS STRING), '.example') FROM hs WHERE ty IN ('view', 'click', 'purchase') AND k % 4 = 1
  UNION ALL SELECT e, 2, k, f, ts + 6000000, src, sp, resolver, CAST(1 + e % 65535 AS INT), concat('other', CAST(k AS STRING), '.example') FROM hs WHERE ty IN ('view', 'click', 'purchase') AND k % 6 = 1),
queries AS (SELECT CAST(e * 4 + j AS BIGINT) AS query_id, CAST(e * 8 + j AS BIGINT) AS pkt_idx, f AS file_idx, concat('cap', CAST(f AS STRING), '.pcap') AS pcap_file, ts AS ts_ns, src AS issuer_ip, sp AS src_port, resolver AS resolver_ip, 'udp' AS proto, id AS dns_id, name FROM qs),
responses AS (SELECT CAST(e AS BIGINT) AS response_id, CAST(e * 8 + 5 AS BIGINT) AS pkt_idx, f AS file_idx, ts + 20000000 AS ts_ns, src AS issuer_ip, sp AS src_port, resolver AS resolver_ip, 'udp' AS proto, CASE WHEN k % 17 = 3 THEN 0 ELSE CAST(1 + e % 65535 AS INT) END AS dns_id,
  CASE WHEN k % 19 = 0 THEN '' WHEN k % 19 = 1 THEN 'unasked.example' ELSE concat('h', CAST(k AS STRING), '.example') END AS name, dst, k FROM hs WHERE ty IN ('view', 'click', 'purchase') AND k % 4 <> 3),
answers AS (SELECT response_id, CAST(0 AS INT) AS ord, dst AS ip FROM responses UNION ALL SELECT response_id, CAST(1 AS INT), concat('34.121.0.', CAST(1 + k AS STRING)) FROM responses WHERE k % 2 = 1)"""

HELLOS = f"""{BASE}, hellos AS (SELECT CAST(e * 8 + 7 AS BIGINT) AS pkt_idx, f AS file_idx, concat('cap', CAST(f AS STRING), '.pcap') AS pcap_file, ts + 30000000 AS ts_ns, src AS issuer_ip, dst AS dst_ip, 443 AS port, concat('s', CAST(k % 9 AS STRING), '.example') AS sni FROM hs WHERE ty = 'purchase')"""

# Connections: the stored edges taken as connection attempts, one each.
CONNECTIONS = "conns AS (SELECT edge_ord AS conn_id, file_idx, edge_ord AS pkt_idx, issuer_ip, dst_ip, proto, port, first_seen_ns AS ts_ns FROM edges WHERE issuer_ip IS NOT NULL AND dst_ip IS NOT NULL)"


def relation(spark: SparkSession, folder: str, text: str, name: str) -> DataFrame:
    return spark.sql(f"WITH {text.replace(' FROM events', ' FROM {events}')} SELECT * FROM {name}", events=table(spark, folder, "events"))
