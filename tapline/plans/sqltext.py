"""Pieces of SQL shared by the texts the queries are compared with."""

from __future__ import annotations

from tapline.plans.data_queries import _IP, ADDRESS

# Fixed values, written out here once more so that the comparison does not take them from what it checks: address
# blocks as first and last address, tokens of evidence bits, ranks of labels, labels of time servers.
RFC1918 = [("10.0.0.0", "10.255.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255")]
SHARED = [("100.64.0.0", "100.127.255.255")]
SPECIAL = [("0.0.0.0", "0.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("192.0.2.0", "192.0.2.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "239.255.255.255")]
TOKENS = "concat_ws('+', CASE WHEN {b} & 1 <> 0 THEN 'dns' END, CASE WHEN {b} & 2 <> 0 THEN 'sni' END, CASE WHEN {b} & 4 <> 0 THEN 'active' END, CASE WHEN {b} & 8 <> 0 THEN 'csv' END, CASE WHEN {b} & 16 <> 0 THEN 'conn' END, CASE WHEN {b} & 32 <> 0 THEN 'synack' END)"
RANKS = "(CASE WHEN {s} IN ('dns+synack', 'dns+conn+synack', 'sni+synack', 'sni+conn+synack', 'active+synack', 'active+conn+synack') THEN 30 WHEN {s} IN ('csv+conn', 'csv+mid') THEN 20 WHEN {s} = 'mid-session' THEN 10 WHEN {s} = '' THEN 0 ELSE 15 END)"
RECOVERY_RANKS = "(CASE {s} WHEN 'dns+synack' THEN 100 WHEN 'dns+conn+synack' THEN 90 WHEN 'sni+synack' THEN 80 WHEN 'sni+conn+synack' THEN 70 WHEN 'active+synack' THEN 60 WHEN 'active+conn+synack' THEN 50 WHEN 'csv+conn' THEN 40 WHEN 'csv+mid' THEN 30 WHEN 'mid-session' THEN 20 WHEN '' THEN 0 ELSE 10 END)"
TIME_LABEL = "(^|[.])(ntp|time|timesync|sntp|ntpd|chrony|chronyd|(ntp|time|timesync)(-[^.]+|[0-9]+))([.]|$)"

TRIM = "trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def trim(c: str) -> str:
    return TRIM.format(c=c)


def address(c: str) -> str:
    return ADDRESS.format(c=c)


def ipv4(c: str) -> str:
    return f"(CASE WHEN regexp_matches({address(c)}, {_IP}) THEN {address(c)} END)"


def value(ip: str) -> str:
    """BIGINT of a canonical address."""
    return "(" + " + ".join(f"CAST(split_part({ip}, '.', {k + 1}) AS BIGINT) * {256 ** (3 - k)}" for k in range(4)) + ")"


def within(ip: str, blocks: list[tuple[str, str]]) -> str:
    v = value(ip)
    return "coalesce(" + " OR ".join(f"({v} BETWEEN {number(first)} AND {number(last)})" for first, last in blocks) + ", false)"


def number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def private(ip: str) -> str:
    return within(ip, RFC1918)


def local(ip: str) -> str:
    return within(ip, RFC1918 + SHARED)


def public(ip: str) -> str:
    return f"({ip} IS NOT NULL AND NOT {within(ip, RFC1918 + SHARED + SPECIAL)})"


def name(c: str) -> str:
    return f"lower({trim(f'''regexp_replace({c}, '[.]$', '')''')})"


def name_trim_first(c: str) -> str:
    return f"lower(regexp_replace({trim(c)}, '[.]$', ''))"


def label(bits: str) -> str:
    return TOKENS.format(b=bits)


def rank(source: str) -> str:
    return RANKS.format(s=f"lower(trim(coalesce({source}, '')))")


def recovery_rank(source: str) -> str:
    return RECOVERY_RANKS.format(s=f"lower(trim(coalesce({source}, '')))")


def resolvable(c: str) -> str:
    n = name(c)
    return f"coalesce({n} <> '' AND {n} <> 'localhost' AND NOT regexp_matches({n}, '[.](lan|local)$') AND contains({n}, '.') AND NOT contains({n}, '_'), false)"


def time_server(c: str) -> str:
    n = name(c)
    return f"coalesce({n} <> '' AND (regexp_matches({n}, '{TIME_LABEL}') OR contains({n}, 'timesync') OR contains({n}, 'chrony')), false)"


def suffix(c: str) -> str:
    p = f"string_split(lower(regexp_replace({c}, '[.]$', '')), '.')"
    return f"(CASE WHEN len({p}) < 2 THEN '' ELSE {p}[-2] || '.' || {p}[-1] END)"


def fnv64(text: str) -> str:
    """Signed FNV-1a 64 of a text."""
    big = f"list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::INT::HUGEINT)), lambda a, b: ((a - a % 256 + xor((a % 256)::INT, b::INT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    return f"(SELECT CASE WHEN z >= 9223372036854775808 THEN (z - 18446744073709551616)::BIGINT ELSE z::BIGINT END FROM (SELECT {big} AS z))"


# Relations: transactions, their addresses, edges, topology rows and the map, as the operators take them.
TX = f"""tx AS (SELECT DISTINCT tx_id, req_ts_ns, {address('issuer_ip')} AS issuer_ip, issuer_label, dns_name, {address('resolver_ip')} AS resolver_ip, dest_port, proto, pcap_file, name_evidence FROM dns_tx)"""
TXIP = f"""tx_ip AS (SELECT tx_id, ip, CAST(min(ord) AS INT) AS ord, CAST(bit_or(evidence) AS INT) AS evidence FROM (SELECT tx_id, {ipv4('ip')} AS ip, ord, evidence FROM dns_tx_ip) WHERE ip IS NOT NULL GROUP BY tx_id, ip)"""
EDGES = f"""edges AS (SELECT DISTINCT row_ord AS edge_ord, CAST(row_ord // 400 AS INT) AS file_idx, {address('issuer_ip')} AS issuer_ip, {ipv4('destination_ip')} AS dst_ip, lower(protocol) AS proto, port, observed_ns AS first_seen_ns FROM topology)"""
TOPO = f"""topo AS (SELECT DISTINCT row_ord, {address('issuer_ip')} AS issuer_ip, {ipv4('destination_ip')} AS destination_ip, coalesce(dns_name, '') AS dns_name, coalesce(dns_source, '') AS dns_source, protocol, port, observed_ns FROM topology)"""
MAP = f"""pairs AS (SELECT ip, dns, min(ord) AS ord FROM (SELECT {ipv4('ip')} AS ip, {name_trim_first('dns')} AS dns, ord FROM ip_dns) WHERE ip IS NOT NULL AND dns <> '' GROUP BY ip, dns)"""
