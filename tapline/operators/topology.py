"""Topology: observed edges joined with what was asked for, and the chain of rules that settle names.

Every rule is a filter, a window over small keys or a two-step aggregation; none gathers names of a key in a list.
A unique name is told by its minimum being its maximum, which both have map-side combine.

Rows have the columns issuer, dst, dns_name, dns_source, proto, port, observed_ns and ord, the number of the edge
that gave the row; a missing name or source is an empty text. Edge cases: edges without issuer, destination or
port are dropped by ``eligible``; null names count as empty; equal candidates are settled by the smaller
transaction number; empty inputs give empty results; columns not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.functions import evidence as ev
from tapline.functions.addresses import is_ipv4, is_rfc1918
from tapline.functions.names import canonical_name, canonical_name_trim_first
from tapline.functions.numbers import floor_div
from tapline.session import cut

# Ports of name resolution itself, and the labels rules compare with.
DNS_PORTS = (53, 853, 5353)
PREFERRED = ("dns+synack", "dns+conn+synack")
FALLBACK = ("csv+mid", "csv+conn")
DIRECT_DONORS = ("dns+synack", "sni+synack")
INFERRED_DONOR = "dns+conn+synack"
MAX_AGE_NS = 120 * 10**9
HOUR_NS = 3600 * 10**9
TUPLE = ["issuer", "dst", "proto", "port"]


def eligible(edges: DataFrame, transactions: DataFrame) -> DataFrame:
    """Edges that can be a service contact: complete, not name resolution, not issued by a resolver."""
    resolvers = transactions.select(F.col("resolver_ip").alias("issuer_ip")).filter(is_ipv4(F.col("issuer_ip"))).distinct()
    kept = edges.filter("issuer_ip is not null and issuer_ip <> '' and dst_ip is not null and port is not null and port <> 0").filter(~F.col("port").isin(*DNS_PORTS))
    return kept.join(resolvers, "issuer_ip", "left_anti")


def _candidates(transactions: DataFrame, addresses: DataFrame) -> DataFrame:
    """Named transactions as (issuer_ip, dst_ip, proto, port, t, fit): protocol and port are null where unknown."""
    named = transactions.filter("issuer_ip is not null and dns_name is not null and dns_name <> ''").select("tx_id", "issuer_ip", F.col("req_ts_ns").alias("t"), "dns_name", F.coalesce("name_evidence", F.lit(0)).alias("name_bits"), F.lower("proto").alias("proto"), F.when(F.col("dest_port") > 0, F.col("dest_port")).alias("port"))
    tx = named.filter("t is not null").join(addresses.select("tx_id", F.col("ip").alias("dst_ip"), F.coalesce("evidence", F.lit(0)).alias("ip_bits")), "tx_id")
    score = F.when(F.col("proto").isNotNull(), 2).otherwise(0) + F.when(F.col("port").isNotNull(), 2).otherwise(0) + F.when(ev.has(F.col("name_bits"), ev.SNI), 1).otherwise(0)
    fit = F.struct(score.alias("score"), F.col("t").alias("req_ts_ns"), (-F.col("tx_id")).alias("minus"), canonical_name(F.col("dns_name")).alias("name"), F.col("name_bits").bitwiseOR(F.col("ip_bits")).alias("bits"))
    return tx.select("issuer_ip", "dst_ip", "proto", "port", "t", fit.alias("fit"))


def _carried(rows: DataFrame, cell: list[str], order: list, max_age_ns: int) -> DataFrame:
    """Adds ``best`` to rows sorted by ``order``: the greatest fit among the last of each class up to a row.

    A class is which of protocol and port a transaction has, and whether a client hello named it: within a class
    the score is equal, so the last one is the best. All four partitionings refine ``cell``, so the rows are
    shuffled once and sorted four times.
    """
    sni, fits = F.col("fit.score") % 2 == 1, []
    for extra, has_proto, has_port in ([], False, False), (["proto"], True, False), (["port"], False, True), (["proto", "port"], True, True):
        mine = F.col("fit").isNotNull() & (F.col("proto").isNotNull() == has_proto) & (F.col("port").isNotNull() == has_port)
        past = Window.partitionBy(*cell, *extra).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        fits += [F.last(F.when(mine & kind, F.col("fit")), ignorenulls=True).over(past) for kind in (sni, ~sni)]
    names = [f"_fit{k}" for k in range(len(fits))]
    rows = rows.withColumns(dict(zip(names, fits, strict=True)))
    young = lambda c: F.when(F.col("t") - F.col(f"{c}.req_ts_ns") <= max_age_ns, F.col(c)) if max_age_ns > 0 else F.col(c)
    return rows.withColumn("best", F.greatest(*[young(c) for c in names])).drop(*names)


def _with_best(edges: DataFrame, transactions: DataFrame, addresses: DataFrame, max_age_ns: int) -> DataFrame:
    """The edges with ``best``: score, time, -tx_id, name and bits of the transaction that fits best, null if none.

    Transactions with a protocol or port of their own must agree with the edge and are preferred, names from a
    client hello slightly; then the latest request wins, then the smaller number. Nothing is multiplied: edges and
    transactions of a pair meet per chunk of time in one sort and the last transaction of each class is carried on.
    With an age limit chunks are as long as that, and a transaction goes to its own and the next one. Without one
    all earlier chunks count, so the best of them is carried along a list of the pair's chunks.
    """
    columns, pair, chunk_ns = edges.columns, ["issuer_ip", "dst_ip"], max_age_ns or HOUR_NS
    own = floor_div(F.col("t"), chunk_ns)
    tx = _candidates(transactions, addresses)
    facts = tx.withColumn("chunk", F.explode(F.array(own, own + 1)) if max_age_ns > 0 else own)
    e = edges.select(*pair, F.lower("proto").alias("proto"), "port", F.col("first_seen_ns").alias("t"), F.struct(*columns).alias("edge"), floor_div(F.col("first_seen_ns"), chunk_ns).alias("chunk"))
    minus, kind = F.col("fit.minus").asc(), F.col("fit").isNull()
    rows = e.unionByName(facts, allowMissingColumns=True).repartition(*pair, "chunk")
    found = _carried(rows, [*pair, "chunk"], ["t", kind, minus], max_age_ns).filter("edge is not null")
    once = lambda c: F.explode(F.array(c)).alias("best")  # noqa: E731  a generator keeps later steps from repeating what it is made of
    if max_age_ns > 0:
        return found.select("edge.*", once(F.col("best")))
    places = e.select(*pair, "proto", "port", "chunk").distinct()
    last = facts.groupBy(*pair, "proto", "port", (F.col("fit.score") % 2).alias("sni"), "chunk").agg(F.max("fit").alias("fit"))
    last = last.select(*pair, "proto", "port", "fit", (F.col("chunk") + 1).alias("chunk"))
    earlier = _carried(places.unionByName(last, allowMissingColumns=True).repartition(*pair).withColumn("t", F.lit(0)), pair, ["chunk", kind, "fit.req_ts_ns", minus], 0)
    keys = [*pair, "proto", "port", "chunk"]
    earlier = earlier.filter("fit is null").select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("best").alias("_earlier"))
    same = [F.col(c) == F.col(f"_{c}") for c in (*pair, "chunk")] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("proto", "port")]
    found = found.join(earlier, same, "left")
    return found.select("edge.*", once(F.greatest("best", "_earlier")))


def best_transactions(edges: DataFrame, transactions: DataFrame, addresses: DataFrame, max_age_ns: int = MAX_AGE_NS) -> DataFrame:
    """(edge_ord, tx_id, name, bits): for each edge the best transaction that named its destination beforehand."""
    found = _with_best(edges, transactions, addresses, max_age_ns).filter("best is not null")
    return found.select("edge_ord", (-F.col("best.minus")).alias("tx_id"), "best.name", "best.bits")


def unambiguous(pairs: DataFrame) -> DataFrame:
    """(ip, map_name) of the addresses that the map gives exactly one name."""
    name = canonical_name_trim_first(F.col("dns"))
    one = pairs.select("ip", name.alias("n")).filter("ip is not null and n <> ''").groupBy("ip").agg(F.min("n").alias("map_name"), F.max("n").alias("last"))
    return one.filter("map_name = last").drop("last")


def attributed(edges: DataFrame, transactions: DataFrame, addresses: DataFrame, pairs: DataFrame, max_age_ns: int = MAX_AGE_NS, label: Column | None = None) -> DataFrame:
    """One row per eligible edge with name and source: a transaction first, then the map, then nothing."""
    rows = _with_best(eligible(edges, transactions), transactions, addresses, max_age_ns)
    rows = rows.join(unambiguous(pairs), F.col("dst_ip") == F.col("ip"), "left").select("*", "best.name", "best.bits")
    inner_dst, inner_issuer = is_rfc1918(F.col("dst_ip")), is_rfc1918(F.col("issuer_ip"))
    # A transaction without a usable name leaves a blank row, which the map fills afterwards whoever the issuer is.
    found, mapped = F.col("best").isNotNull(), F.col("map_name").isNotNull()
    told = found & (F.coalesce("name", F.lit("")) != "")
    name = F.when(inner_dst, "").when(told, F.col("name")).otherwise(F.coalesce("map_name", F.lit("")))
    from_tx = F.when(F.col("bits") != 0, ev.label(F.col("bits").bitwiseOR(F.lit(ev.OBSERVED)))).otherwise("")
    source = F.when(inner_dst, "").when(told, from_tx).when(found, F.when(mapped, "csv+conn").otherwise("")).when(inner_issuer, F.when(mapped, "csv+mid").otherwise("mid-session")).otherwise(F.when(mapped, "csv+conn").otherwise(""))
    who = F.col("issuer_ip") if label is None else F.coalesce(label, F.col("issuer_ip"))
    return rows.select(who.alias("issuer"), F.col("dst_ip").alias("dst"), name.alias("dns_name"), source.alias("dns_source"), "proto", "port", F.col("first_seen_ns").alias("observed_ns"), F.col("edge_ord").alias("ord"))


def folded(rows: DataFrame) -> DataFrame:
    """One row per issuer, destination, name, protocol and port: the first, with the best ranked source."""
    rank = ev.source_rank(F.col("dns_source"))
    best = F.max(F.struct(rank.alias("rank"), (-F.col("ord")).alias("minus"), "dns_source", "observed_ns")).alias("b")
    out = rows.groupBy("issuer", "dst", "dns_name", "proto", "port").agg(F.min("ord").alias("ord"), best)
    return out.select("issuer", "dst", "dns_name", "b.dns_source", "proto", "port", "b.observed_ns", "ord")


def without_unnamed_twins(rows: DataFrame) -> DataFrame:
    """Unnamed rows go where a named one has the same issuer, destination, protocol and port.

    Rows are spread by issuer and destination, which serves the windows of the rules that follow as well.
    """
    rows = rows.repartition("issuer", "dst")
    named = F.max(F.col("dns_name") != "").over(Window.partitionBy(*TUPLE))
    return rows.withColumn("_named", named).filter("dns_name <> '' or not _named").drop("_named")


def _marks(rows: DataFrame) -> DataFrame:
    strong = (F.col("dns_name") != "") & F.col("dns_source").isin(*PREFERRED) & ~is_rfc1918(F.col("dst"))
    rows = rows.withColumns({"_strong": strong, "_name": canonical_name_trim_first(F.col("dns_name")), "_csv": (F.col("dns_name") != "") & F.col("dns_source").isin(*FALLBACK) & ~is_rfc1918(F.col("dst"))})
    over = lambda *keys: F.max("_strong").over(Window.partitionBy(*keys))
    return rows.withColumns({"_here": over(*TUPLE), "_other": over("issuer", "dst", "proto"), "_same": over("issuer", "dst", "proto", "_name")})


def strong_over_fallback(rows: DataFrame) -> DataFrame:
    """Names from the map go where a transaction named the very same contact."""
    return _marks(rows).filter("not (_csv and _here)").drop("_strong", "_name", "_csv", "_here", "_other", "_same")


def cross_port_downgrade(rows: DataFrame) -> DataFrame:
    """Names from the map are blanked where transactions named the pair otherwise on another port."""
    clash = F.col("_csv") & F.col("_other") & ~F.col("_same")
    out = _marks(rows).withColumn("_clash", clash)
    source = F.when(F.col("_clash"), F.when(F.col("dns_source") == "csv+mid", "mid-session").otherwise("")).otherwise(F.col("dns_source"))
    name = F.when(F.col("_clash"), "").otherwise(F.col("dns_name"))
    return out.withColumns({"dns_source": source, "dns_name": name}).drop("_strong", "_name", "_csv", "_here", "_other", "_same", "_clash")


def settle_fallback(rows: DataFrame) -> DataFrame:
    """Both rules at once, as they share their windows."""
    out = _marks(rows).filter("not (_csv and _here)").withColumn("_clash", F.col("_csv") & F.col("_other") & ~F.col("_same"))
    source = F.when(F.col("_clash"), F.when(F.col("dns_source") == "csv+mid", "mid-session").otherwise("")).otherwise(F.col("dns_source"))
    return out.withColumns({"dns_source": source, "dns_name": F.when(F.col("_clash"), "").otherwise(F.col("dns_name"))}).drop("_strong", "_name", "_csv", "_here", "_other", "_same", "_clash")


def completed_by_peers(rows: DataFrame) -> DataFrame:
    """Unnamed public rows take the one name other issuers have for the same destination, protocol and port."""
    public = ~is_rfc1918(F.col("dst"))
    direct, inferred = (F.when(F.col("dns_source").isin(*x), F.col("dns_name")) for x in (DIRECT_DONORS, [INFERRED_DONOR]))
    donors = rows.filter((F.col("dns_name") != "") & public).groupBy("dst", "proto", "port").agg(F.min(direct).alias("d1"), F.max(direct).alias("d2"), F.min(inferred).alias("i1"), F.max(inferred).alias("i2"))
    donors = donors.filter("d1 = d2 or (d1 is null and i1 = i2)").select("dst", "proto", "port", F.coalesce("d1", "i1").alias("_donor"), F.when(F.col("d1").isNotNull(), "peer+ipport").otherwise("peer+ipport+conn").alias("_how"))
    out = rows.join(donors, ["dst", "proto", "port"], "left").withColumn("_take", (F.col("dns_name") == "") & public & F.col("_donor").isNotNull())
    out = out.withColumns({"dns_source": F.when(F.col("_take"), F.col("_how")).otherwise(F.col("dns_source")), "dns_name": F.when(F.col("_take"), F.col("_donor")).otherwise(F.col("dns_name"))})
    return out.select("issuer", "dst", "dns_name", "dns_source", "proto", "port", "observed_ns", "ord")


def matrix(edges: DataFrame, transactions: DataFrame, addresses: DataFrame, pairs: DataFrame, max_age_ns: int = MAX_AGE_NS, label: Column | None = None) -> DataFrame:
    """The whole chain. Peers are rows of the same result, so that is cut before it is looked at twice; the folded
    contacts are cut as well, being few beside the edges, since one plan of everything takes longer to plan than to run."""
    rows = cut(folded(attributed(edges, transactions, addresses, pairs, max_age_ns, label)))
    return completed_by_peers(cut(settle_fallback(without_unnamed_twins(rows))))


def short(rows: DataFrame) -> DataFrame:
    """One row per issuer, destination, protocol and port: the smallest name, unnamed only if there is no other."""
    best = F.min(F.struct((F.col("dns_name") == "").alias("blank"), "dns_name", "ord", "dns_source", "observed_ns")).alias("b")
    return rows.groupBy(*TUPLE).agg(best).select("issuer", "dst", "b.dns_name", "b.dns_source", "proto", "port", "b.observed_ns", "b.ord")


def with_sort_keys(rows: DataFrame) -> DataFrame:
    """Adds ``endpoints``, the issuer's number of contacts, and ``inner``, whether the destination is private."""
    counts = rows.groupBy("issuer").agg(F.count_distinct("dst", "proto", "port").alias("endpoints"))
    return rows.join(counts, "issuer").withColumn("inner", is_rfc1918(F.col("dst")).cast("int"))


def ordered(rows: DataFrame, sort: bool = True, by_name: bool = True) -> DataFrame:
    """For presentation: busiest issuers first, private destinations and unnamed rows last; or as first seen."""
    if not sort:
        first = rows.groupBy("issuer").agg(F.min("ord").alias("_first"))
        return rows.join(first, "issuer").orderBy("_first", "ord").drop("_first")
    name = [F.col("dns_name") == "", "dns_name"] if by_name else []
    return with_sort_keys(rows).orderBy(F.desc("endpoints"), "issuer", "inner", *name, "dst", "proto", "port").drop("endpoints", "inner")
