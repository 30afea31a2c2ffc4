"""Queries of the general data-processing operators over whole tables, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions.addresses import plain_address
from tapline.functions.numbers import floor_div
from tapline.functions.subscribers import imsi15, same_sid
from tapline.operators import asof, badlines, intervals, messages
from tapline.plans.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return badlines.failed_lines(table(spark, folder, "ip_dns_lines")).select("line_id", "reason")


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return badlines.valid_pairs(table(spark, folder, "ip_dns_lines")).select("line_id", "ip", "dns")


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "radius_sessions").withColumn("imsi", imsi15(F.col("imsi")))
    return intervals.usable(rows, "imsi", "start_ms", "end_ms")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.gaps(_windows(spark, folder)).select(F.col("entity").alias("imsi"), F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms"))


def p3_periods(spark: SparkSession, folder: str) -> DataFrame:
    end = F.nullif(F.col("period_end"), F.lit(intervals.FOREVER))
    return intervals.periods(_windows(spark, folder)).select(F.col("entity").alias("imsi"), F.col("period_start").alias("start_ms"), end.alias("end_ms"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = asof.as_known(
        table(spark, folder, "dns_tx"),
        table(spark, folder, "radius_sessions").filter(imsi15(F.col("imsi")).isNotNull()),
        event_id="tx_id", event_entity=plain_address(F.col("issuer_ip")), event_time=floor_div(F.col("req_ts_ns"), 1_000_000),
        version_id="session_row", version_entity=plain_address(F.col("ip")), start="start_ms", end="end_ms", known="known_ms",
    )
    return found.select(F.col("event_id").alias("tx_id"), F.col("version_id").alias("session_row"))


MESSAGE_KEYS = {"imsi": imsi15, "sid": same_sid, "ts_ms": lambda c: c, "status": lambda c: c}


def _message_keys() -> dict:
    return {k: f(F.col(k)) for k, f in MESSAGE_KEYS.items()}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return messages.repeated_copies(table(spark, folder, "radius_msgs"), _message_keys(), ["imsi", "ts_ms"], "recv_id")


def p5_kept(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "radius_msgs").select("recv_id", "batch_no", "imsi", "sid", "ts_ms", "status")
    kept = messages.deduplicated(rows, _message_keys(), ["imsi", "ts_ms"], "recv_id")
    return kept.select("recv_id", "batch_no", "ts_ms", "status")


QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p3_found, p3_periods, p4_found, p5_found, p5_kept)}

ADDRESS = "regexp_replace(trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^::ffff:', '', 'i')"
IMSI = "nullif(regexp_extract(imsi, '[0-9]{15}'), '')"
_BLANK = "' ' || chr(9)"
_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = f"'^{_OCT}[.]{_OCT}[.]{_OCT}[.]{_OCT}$'"
_LABEL = "[A-Za-z0-9_]([A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?"
_LINES = rf"""
a AS (SELECT line_id, trim(line, {_BLANK}) AS b FROM ip_dns_lines),
p AS (SELECT line_id, b, string_split(b, '"') AS s FROM a WHERE b <> '' AND b NOT LIKE '#%'),
q AS (SELECT line_id, len(s) % 2 = 1 AS even, s,
  len(list_filter(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i % 2 = 1 AND contains(s[i], ',') THEN 1 ELSE 0 END), lambda x: x = 1)) > 0 AS commas FROM p),
r AS (SELECT line_id, even, array_to_string(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i % 2 = 0 THEN s[i]
  WHEN commas THEN replace(s[i], ',', chr(1)) ELSE regexp_replace(s[i], '[ ' || chr(9) || ']+', chr(1), 'g') END), '"') AS x FROM q),
f AS (SELECT line_id, even, list_transform(string_split(x, chr(1)), lambda y: trim(y, {_BLANK})) AS y FROM r),
g AS (SELECT line_id, even, len(y) AS n, len(list_filter(y, lambda z: contains(z, '"') AND NOT regexp_full_match(z, '"[^"]*"', 's'))) > 0 AS bad,
  list_transform(y, lambda z: CASE WHEN regexp_full_match(z, '"[^"]*"', 's') THEN trim(z[2:-2], {_BLANK}) ELSE z END) AS z FROM f),
h AS (SELECT line_id, even, bad, n, regexp_matches(z[1], {_IP}) AS l, regexp_matches(z[2], {_IP}) AS m, z FROM g),
k AS (SELECT line_id, CASE WHEN NOT even OR bad THEN 'quoting' WHEN n <> 2 THEN 'columns' WHEN NOT l AND NOT m THEN 'ip'
  WHEN NOT (regexp_full_match(CASE WHEN l THEN z[2] ELSE z[1] END, '({_LABEL}[.])+{_LABEL}[.]?')
    AND length(regexp_replace(CASE WHEN l THEN z[2] ELSE z[1] END, '[.]$', '')) <= 253
    AND NOT regexp_matches(CASE WHEN l THEN z[2] ELSE z[1] END, '(^|[.])[0-9]+[.]?$')) THEN 'dns' END AS reason,
  CASE WHEN l THEN z[1] ELSE z[2] END AS ip, CASE WHEN l THEN z[2] ELSE z[1] END AS dns FROM h)"""
_USABLE = f"""u AS (SELECT DISTINCT {IMSI} AS imsi, start_ms AS s, CASE WHEN end_ms IS NULL OR end_ms = 0 THEN 9223372036854775807 ELSE end_ms END AS e
  FROM radius_sessions WHERE {IMSI} IS NOT NULL AND start_ms IS NOT NULL AND (end_ms IS NULL OR end_ms = 0 OR end_ms >= start_ms)),
w AS (SELECT imsi, s, e, max(e) OVER (PARTITION BY imsi ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u)"""
_SID = "coalesce(nullif(lower(regexp_replace(coalesce(sid, ''), '[ ' || chr(9) || chr(10) || chr(13) || chr(0) || ']+', '', 'g')), ''), '-')"

SQL = {
    "p2_found": f"WITH {_LINES} SELECT line_id, reason FROM k WHERE reason IS NOT NULL",
    "p2_loaded": f"WITH {_LINES} SELECT line_id, ip, dns FROM k WHERE reason IS NULL",
    "p3_found": f"WITH {_USABLE} SELECT imsi, before AS gap_start_ms, s AS gap_end_ms FROM w WHERE s > before",
    "p3_periods": f"""WITH {_USABLE}, i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY imsi ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM w)
SELECT imsi, min(s) AS start_ms, nullif(max(e), 9223372036854775807) AS end_ms FROM i GROUP BY imsi, k""",
    "p4_found": f"""WITH t AS (SELECT DISTINCT tx_id, {ADDRESS.format(c="issuer_ip")} AS a, req_ts_ns // 1000000 AS t FROM dns_tx WHERE issuer_ip IS NOT NULL),
v AS (SELECT DISTINCT session_row, {ADDRESS.format(c="ip")} AS a, start_ms AS s, CASE WHEN end_ms IS NULL OR end_ms = 0 THEN 9223372036854775807 ELSE end_ms END AS e, known_ms AS k
  FROM radius_sessions WHERE {IMSI} IS NOT NULL AND start_ms IS NOT NULL)
SELECT tx_id, arg_max(session_row, (s, k, session_row)) AS session_row FROM t JOIN v ON t.a = v.a AND s <= t AND t <= e AND e >= s AND k <= t GROUP BY tx_id""",
    "p5_found": f"""SELECT recv_id FROM (SELECT recv_id, row_number() OVER (PARTITION BY {IMSI}, {_SID}, ts_ms, status ORDER BY recv_id) AS r
  FROM radius_msgs WHERE {IMSI} IS NOT NULL AND ts_ms IS NOT NULL) WHERE r > 1""",
    "p5_kept": f"""SELECT recv_id, batch_no, ts_ms, status FROM (SELECT *, row_number() OVER (PARTITION BY {IMSI}, {_SID}, ts_ms, status ORDER BY recv_id) AS r
  FROM radius_msgs) WHERE r = 1 OR {IMSI} IS NULL OR ts_ms IS NULL""",
}
