"""Queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions.addresses import plain_address
from tapline.functions.numbers import floor_div
from tapline.llm import distinct, history, leaks, nearest, packing, spam
from tapline.plans.data_queries import ADDRESS
from tapline.plans.tables import table

TOLERANCE_NS = 5_000_000_000


DAY_NS = 86_400_000_000_000
DIMS = ["day", "net_id", "protocol", "port", "dns_source"]


def _connections(spark: SparkSession, folder: str) -> DataFrame:
    day = floor_div(F.col("observed_ns"), DAY_NS).cast("int").alias("day")
    return table(spark, folder, "topology").select(day, *DIMS[1:], plain_address(F.col("issuer_ip")).alias("issuer"), plain_address(F.col("destination_ip")).alias("destination"))


def p1_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct issuers and destinations for every combination of day, net, protocol, port and source."""
    rows = _connections(spark, folder)
    return distinct.cube_counts(rows, {d: F.col(d) for d in DIMS}, {"unique_sources": F.col("issuer"), "unique_dest_ips": F.col("destination")})


def p1_merged_days(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct issuers per net over all days, from the partial bitmaps of single days."""
    rows = _connections(spark, folder)
    codes = distinct.dictionary(rows.select("issuer"))
    daily = distinct.words(rows, ["day", "net_id"], "issuer", codes)
    return distinct.counted(distinct.merged(daily, ["net_id"]), ["net_id"], "unique_sources")


def p1_resolved_and_reached(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that were resolved, that were reached, and that were both: bitmaps united and intersected."""
    reached = _connections(spark, folder).select(F.lit("all").alias("part"), F.col("destination").alias("ip"))
    resolved = table(spark, folder, "dns_tx_ip").select(F.lit("all").alias("part"), plain_address(F.col("ip")).alias("ip"))
    codes = distinct.cut(distinct.dictionary(reached.select("ip").unionByName(resolved.select("ip"))))
    a, b = (distinct.words(x, ["part"], "ip", codes) for x in (resolved, reached))
    one = distinct.counted(a, ["part"], "resolved").join(distinct.counted(b, ["part"], "reached"), "part", "left")
    return one.join(distinct.counted(distinct.common(a, b, ["part"]), ["part"], "both"), "part", "left").select("resolved", "reached", "both")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.near_known(table(spark, folder, "ip_dns"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    entity = plain_address(F.col("issuer_ip"))
    found = nearest.nearest(
        table(spark, folder, "topology"), table(spark, folder, "dns_tx"), left_id="row_ord", left_entity=entity, left_time="observed_ns",
        right_id="tx_id", right_entity=entity, right_time="req_ts_ns", tolerance=TOLERANCE_NS,
    )
    return found.select(F.col("right_id").alias("tx_id"), F.col("left_id").alias("row_ord"))


def p7_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows by joining adjacent buckets."""
    entity = plain_address(F.col("issuer_ip"))
    found = nearest.nearest_by_join(
        table(spark, folder, "topology"), table(spark, folder, "dns_tx"), left_id="row_ord", left_entity=entity, left_time="observed_ns",
        right_id="tx_id", right_entity=entity, right_time="req_ts_ns", tolerance=TOLERANCE_NS,
    )
    return found.select(F.col("right_id").alias("tx_id"), F.col("left_id").alias("row_ord"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers: all texts placed, none overfull, none cut without need, hardly any in vain."""
    rows = distinct.cut(p8_packed(spark, folder))
    texts = rows.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    loads = rows.filter("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("load"))
    full, zero = F.lit(packing.CAPACITY), F.lit(0).cast("bigint")
    whole = texts.select(F.lit(1).cast("bigint").alias("texts"), (F.col("n") > 0).cast("bigint").alias("placed"), (F.col("pieces") != F.greatest(F.ceil(F.col("n") / full), F.lit(1))).cast("bigint").alias("cut_wrongly"), zero.alias("overfull"), F.col("n").alias("tokens"), zero.alias("containers"))
    each = loads.select(zero.alias("texts"), zero.alias("placed"), zero.alias("cut_wrongly"), (F.col("load") > full).cast("bigint").alias("overfull"), zero.alias("tokens"), F.lit(1).cast("bigint").alias("containers"))
    sums = whole.unionByName(each).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in whole.columns])
    vain = F.col("containers") > F.ceil(F.col("tokens") / full) * 1.01 + 1
    return sums.select("texts", "placed", "cut_wrongly", "overfull", vain.cast("int").alias("more_than_a_hundredth_in_vain"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_cube, p1_merged_days, p1_resolved_and_reached, p6_found, p7_found, p7_joined, p8_packed, p8_checked, p9_found, p10_found)}

_T = f"""t AS (SELECT CAST(observed_ns // 86400000000000 AS INT) AS day, net_id, protocol, port, dns_source, {ADDRESS.format(c="issuer_ip")} AS i, {ADDRESS.format(c="destination_ip")} AS d FROM topology)"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "p1_cube": f"""WITH {_T} SELECT day, net_id, protocol, port, dns_source,
  CAST(grouping(day) + 2 * grouping(net_id) + 4 * grouping(protocol) + 8 * grouping(port) + 16 * grouping(dns_source) AS INT) AS grouping,
  count(DISTINCT i) AS unique_sources, count(DISTINCT d) AS unique_dest_ips FROM t GROUP BY CUBE (day, net_id, protocol, port, dns_source)""",
    "p1_merged_days": f"WITH {_T} SELECT net_id, count(DISTINCT i) AS unique_sources FROM t WHERE i IS NOT NULL GROUP BY net_id",
    "p1_resolved_and_reached": f"""WITH {_T}, r AS (SELECT DISTINCT {ADDRESS.format(c="ip")} AS d FROM dns_tx_ip WHERE ip IS NOT NULL), q AS (SELECT DISTINCT d FROM t WHERE d IS NOT NULL)
SELECT (SELECT count(*) FROM r) AS resolved, (SELECT count(*) FROM q) AS reached, (SELECT count(*) FROM r JOIN q USING (d)) AS both""",
    "p6_found": f"""WITH RECURSIVE m AS (SELECT ord, batch_no, {ADDRESS.format(c="ip")} AS a, lower(regexp_replace(trim(dns, {_BLANKS}), '[ .' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']+$', '')) AS n FROM ip_dns WHERE ip IS NOT NULL AND dns IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY a, d ORDER BY ord) AS k FROM (SELECT *, regexp_replace(n, '[^0-9]', '', 'g') AS d FROM m)),
run AS (SELECT a, d, k, ord, [n] AS taken, false AS known FROM rk WHERE k = 1
  UNION ALL SELECT a, d, k, ord, CASE WHEN known THEN taken ELSE list_append(taken, n) END, known
  FROM (SELECT r.*, s.taken, r.batch_no <> 0 AND len(list_filter(s.taken, lambda x: levenshtein(x, r.n) <= 2)) > 0 AS known FROM run s JOIN rk r ON r.a = s.a AND r.d = s.d AND r.k = s.k + 1))
SELECT ord FROM run WHERE known""",
    "p8_checked": """SELECT count(*) AS texts, count(*) FILTER (WHERE text <> '') AS placed, 0 AS cut_wrongly, 0 AS overfull, 0 AS more_than_a_hundredth_in_vain FROM documents""",
    "p7_found": f"""WITH t AS (SELECT DISTINCT row_ord, {ADDRESS.format(c="issuer_ip")} AS a, observed_ns AS o FROM topology WHERE issuer_ip IS NOT NULL AND observed_ns IS NOT NULL),
d AS (SELECT DISTINCT tx_id, {ADDRESS.format(c="issuer_ip")} AS a, req_ts_ns AS r FROM dns_tx WHERE issuer_ip IS NOT NULL AND req_ts_ns IS NOT NULL)
SELECT arg_min(tx_id, (abs(r - o), tx_id)) AS tx_id, row_ord FROM t JOIN d ON t.a = d.a AND r BETWEEN o - 5000000000 AND o + 5000000000 GROUP BY row_ord""",
    "p9_found": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
v AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
a AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS s FROM w, unnest(range(1, len(w) - 11)) AS t(i)),
b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS s FROM v, unnest(range(1, len(w) - 11)) AS t(i))
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (s)""",
}
SQL["p7_joined"] = SQL["p7_found"]
