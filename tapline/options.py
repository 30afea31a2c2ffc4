"""Options of a run, validated before anything is read."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field

# What a network id may look like, the main formats, and default resolvers.
NET_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}\Z")
FORMATS = ("table", "json")
RESOLVERS = ("8.8.8.8", "1.1.1.1")


def port_list(text: str) -> tuple[int, ...]:
    """Ports 1 to 65535 of a comma-separated list; blank items are skipped."""
    ports = []
    for item in filter(None, (x.strip() for x in text.split(","))):
        if not item.isdecimal() or not 1 <= int(item) <= 65535:
            raise ValueError(f"not a port: {item!r}")
        ports.append(int(item))
    return tuple(dict.fromkeys(ports))


def resolver_list(text: str) -> tuple[str, ...]:
    """Addresses of a comma-separated list, each once."""
    found = [str(ipaddress.ip_address(x.strip())) for x in text.split(",") if x.strip()]
    return tuple(dict.fromkeys(found))


def duration_ns(text: str) -> int:
    """Nanoseconds of a duration such as 90s, 2m, 1h30m or 0."""
    units = {"ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
    if text.strip() == "0":
        return 0
    parts = re.findall(r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h)", text.strip())
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"not a duration: {text!r}")
    return round(sum(float(a) * units[b] for a, b in parts))


@dataclass(frozen=True)
class RunOptions:
    read_dir: str
    net_id: str
    output_root: str = "tapline_output"
    format: str = "table"
    export_csv: str = ""
    short: bool = False
    radius_imsi: bool = False
    only_tcp: bool = False
    ignore_ntp: bool = True
    dns_ip_file: str = ""
    exclude_ports: tuple[int, ...] = (53,)
    enforce_private_as_source: bool = False
    active_resolve: bool = False
    active_resolvers: tuple[str, ...] = RESOLVERS
    disable_sni: bool = False
    compat_sni_blank: bool = False
    unsorted: bool = False
    debug: bool = False
    manifest_out: str = ""
    post_hooks: tuple[str, ...] = field(default=())
    topology_window_ns: int = 120 * 10**9

    def __post_init__(self) -> None:
        if not self.read_dir:
            raise ValueError("read_dir is required")
        if not NET_ID.match(self.net_id):
            raise ValueError(f"net_id {self.net_id!r}: use letters, digits and ._- only")
        if self.format not in FORMATS:
            raise ValueError(f"format {self.format!r}: one of {', '.join(FORMATS)}")
        if self.topology_window_ns < 0:
            raise ValueError("the topology window must not be negative")
