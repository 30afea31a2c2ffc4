"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions import addresses, evidence, names
from tapline.functions.hashing import fnv64
from tapline.functions.subscribers import canonical_imsi
from tapline.operators import transactions
from tapline.parsers import ftp
from tapline.plans import sqltext as S
from tapline.plans.tables import table


def _tx(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dns_tx").select("tx_id", "dns_name", "name_evidence").distinct()


def canon_dns_name(spark, folder):
    return _tx(spark, folder).select("tx_id", names.canonical_name(F.col("dns_name")).alias("name"))


def canon_dns_name_trim_first(spark, folder):
    return _tx(spark, folder).select("tx_id", names.canonical_name_trim_first(F.col("dns_name")).alias("name"))


def canon_ipv4(spark, folder):
    return table(spark, folder, "dns_tx_ip").groupBy(addresses.canonical_ipv4(F.col("ip")).alias("ip")).agg(F.count(F.lit(1)).alias("n"))


def ip_class_flags(spark, folder):
    rows = table(spark, folder, "topology").select(addresses.canonical_ipv4(F.col("issuer_ip")).alias("ip")).unionByName(table(spark, folder, "topology").select(addresses.canonical_ipv4(F.col("destination_ip")).alias("ip")))
    rows = rows.filter("ip is not null").distinct()
    return rows.select("ip", *[f(F.col("ip")).cast("int").alias(n) for n, f in (("private", addresses.is_rfc1918), ("local", addresses.is_local), ("public", addresses.is_public))])


def dns_suffix(spark, folder):
    return _tx(spark, folder).filter("dns_name is not null").groupBy(names.name_suffix(F.col("dns_name")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def evidence_label(spark, folder):
    return table(spark, folder, "dns_tx_ip").groupBy("evidence").agg(F.count(F.lit(1)).alias("n")).select("evidence", evidence.label(F.col("evidence")).alias("label"), "n")


def evidence_normalize(spark, folder):
    return table(spark, folder, "dns_tx_ip").select("tx_id", "ord", evidence.normalised(F.col("evidence")).alias("evidence"))


def source_rank(spark, folder):
    rows = table(spark, folder, "topology").groupBy("dns_source").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("dns_source", evidence.source_rank(F.col("dns_source")).alias("rank"), evidence.recovery_rank(F.col("dns_source")).alias("recovery"), "n")


def endpoint_hash_fnv64(spark, folder):
    """Hash of every published endpoint, beside the value it was published with."""
    rows = table(spark, folder, "service_endpoints")
    text = F.concat_ws("|", "ip", "dns", "protocol", F.col("port").cast("string"))
    return rows.select("ip", "dns", "protocol", "port", "observed_at", fnv64(text).alias("hash_val"))


def resolvable_name_loose(spark, folder):
    return _tx(spark, folder).select("tx_id", names.looks_resolvable(F.col("dns_name")).cast("int").alias("ok"))


def resolvable_name_strict(spark, folder):
    return _tx(spark, folder).select("tx_id", names.is_resolvable(F.col("dns_name")).cast("int").alias("ok"))


def ntp_name_filter(spark, folder):
    """Transactions that stay when time servers are left out; names seen in a client hello always stay."""
    return transactions.without_time_servers(_tx(spark, folder)).select("tx_id", "dns_name")


def ntp_dropped_count(spark, folder):
    """How many transactions that leaves out."""
    return transactions.time_servers(_tx(spark, folder)).agg(F.count(F.lit(1)).alias("dropped"))


def imsi_canonical(spark, folder):
    return table(spark, folder, "radius_msgs").select("recv_id", canonical_imsi(F.col("imsi")).alias("imsi"))


def ftp_passive_port(spark, folder):
    """Port announced by a passive reply; replies are made up from transactions."""
    rows = _tx(spark, folder).select("tx_id", F.when(F.col("tx_id") % 2 == 0, F.concat(F.lit("227 Entering Passive Mode (10,1,2,3,"), F.pmod("tx_id", F.lit(300)), F.lit(","), F.pmod("tx_id", F.lit(256)), F.lit(")"))).otherwise(F.concat(F.lit("229 Entering Extended Passive Mode (|||"), F.pmod(F.col("tx_id") * 37, F.lit(70000)), F.lit("|)"))).alias("line"))
    return rows.select("tx_id", ftp.passive_port(F.col("line")).alias("port")).filter("port is not null")


NAMES = "canon_dns_name canon_dns_name_trim_first canon_ipv4 ip_class_flags dns_suffix evidence_label evidence_normalize source_rank endpoint_hash_fnv64 resolvable_name_loose resolvable_name_strict ntp_name_filter ntp_dropped_count imsi_canonical ftp_passive_port"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_TX = "t AS (SELECT DISTINCT tx_id, dns_name, name_evidence FROM dns_tx)"
_LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
_IMSI = "regexp_replace(imsi, '^[' || chr(0) || '[:space:]]+|[' || chr(0) || '[:space:]]+$', '', 'g')"

SQL = {
    "canon_dns_name": f"WITH {_TX} SELECT tx_id, {S.name('dns_name')} AS name FROM t",
    "canon_dns_name_trim_first": f"WITH {_TX} SELECT tx_id, {S.name_trim_first('dns_name')} AS name FROM t",
    "canon_ipv4": f"SELECT {S.ipv4('ip')} AS ip, count(*) AS n FROM dns_tx_ip GROUP BY 1",
    "ip_class_flags": f"""WITH a AS (SELECT {S.ipv4('issuer_ip')} AS ip FROM topology UNION SELECT {S.ipv4('destination_ip')} FROM topology)
SELECT ip, CAST({S.private('ip')} AS INT) AS private, CAST({S.local('ip')} AS INT) AS local, CAST({S.public('ip')} AS INT) AS public FROM a WHERE ip IS NOT NULL""",
    "dns_suffix": f"WITH {_TX} SELECT {S.suffix('dns_name')} AS suffix, count(*) AS n FROM t WHERE dns_name IS NOT NULL GROUP BY 1",
    "evidence_label": f"SELECT evidence, {S.label('evidence')} AS label, count(*) AS n FROM dns_tx_ip GROUP BY evidence",
    "evidence_normalize": "SELECT tx_id, ord, CASE WHEN evidence & 15 <> 0 THEN evidence & ~16 ELSE evidence END AS evidence FROM dns_tx_ip",
    "source_rank": f"SELECT dns_source, {S.rank('dns_source')} AS rank, {S.recovery_rank('dns_source')} AS recovery, count(*) AS n FROM topology GROUP BY dns_source",
    "endpoint_hash_fnv64": "SELECT ip, dns, protocol, port, observed_at, hash_val FROM service_endpoints",
    "resolvable_name_loose": f"WITH {_TX} SELECT tx_id, CAST({S.resolvable('dns_name')} AS INT) AS ok FROM t",
    "resolvable_name_strict": f"WITH {_TX} SELECT tx_id, CAST(coalesce(length({S.name('dns_name')}) <= 253 AND regexp_full_match({S.name('dns_name')}, '({_LABEL}[.])+{_LABEL}'), false) AS INT) AS ok FROM t",
    "ntp_dropped_count": f"WITH {_TX} SELECT count(*) AS dropped FROM t WHERE NOT coalesce(name_evidence & 2 <> 0, false) AND {S.time_server('dns_name')}",
    "ntp_name_filter": f"WITH {_TX} SELECT tx_id, dns_name FROM t WHERE coalesce(name_evidence & 2 <> 0, false) OR NOT {S.time_server('dns_name')}",
    "imsi_canonical": f"""WITH a AS (SELECT recv_id, {_IMSI} AS i FROM radius_msgs), b AS (SELECT recv_id, regexp_replace(CASE WHEN strpos(i, '@') > 1 THEN split_part(i, '@', 1) ELSE i END, '[^0-9]', '', 'g') AS d FROM a)
SELECT recv_id, CASE WHEN length(d) BETWEEN 14 AND 16 THEN d END AS imsi FROM b""",
    "ftp_passive_port": f"""WITH {_TX}, p AS (SELECT tx_id, CASE WHEN tx_id % 2 = 0 THEN CASE WHEN tx_id % 300 <= 255 THEN (tx_id % 300) * 256 + tx_id % 256 END ELSE (tx_id * 37) % 70000 END AS port FROM t)
SELECT tx_id, CAST(port AS INT) AS port FROM p WHERE port BETWEEN 1 AND 65535""",
}
