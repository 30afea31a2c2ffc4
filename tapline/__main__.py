"""Command line: python -m tapline --read-dir DIR --net-id ID [options], or one of the commands below.

``days --first-day YYYY-MM-DD`` with the same options runs one day folder after another, ``recover ROOT OUT`` finds
names for what earlier runs left unresolved, ``sort-map FILE OUT_DIR`` writes a map in its three orders.
"""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import SparkSession

from tapline.options import RunOptions, duration_ns, port_list, resolver_list
from tapline.plans import pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tapline", description="Reports on who contacted which named service, from captures.")
    add = p.add_argument
    add("--read-dir", "-r", required=True, help="folder of captures")
    add("--net-id", required=True, help="name of the network, a folder of the output")
    add("--output-root", "-o", default="tapline_output")
    add("--no-banner", action="store_true", help="do not say what is run")
    add("--format", choices=("table", "json"), default="table")
    add("--export-csv", default="", help="also write the main table as CSV")
    add("--short", "-s", action="store_true", help="one topology row per issuer, destination, protocol and port")
    add("--radius-imsi", action="store_true", help="label issuers by subscriber")
    add("--only-tcp", action="store_true", help="consider only TCP connections for a transaction's port")
    add("--ignore-ntp", type=lambda x: x.lower() not in ("false", "0", "no"), default=True, metavar="BOOL")
    add("--dns-ip-file", default="", help="map of names and addresses; new pairs are appended")
    add("--exclude-ports", type=port_list, default=(53,))
    add("--enforce-private-as-source", action="store_true")
    add("--active-resolve", action="store_true", help="ask resolvers for names without address")
    add("--active-resolvers", type=resolver_list, default=())
    add("--disable-sni", action="store_true")
    add("--unsorted", action="store_true", help="topology in order of first sight")
    add("--debug", action="store_true", help="write provenance of learned pairs")
    add("--manifest-out", default="")
    add("--post-hook", dest="post_hooks", action="append", default=[])
    add("--topology-dns-window", dest="topology_window_ns", type=duration_ns, default=duration_ns("2m"))
    return p


def _session() -> SparkSession:
    return SparkSession.builder.appName("tapline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _recover(arguments: list[str]) -> None:
    p = argparse.ArgumentParser("tapline recover")
    p.add_argument("root", help="folder of earlier runs")
    p.add_argument("out", help="file of dns,ip lines")
    given = p.parse_args(arguments)
    print(pipeline.recover(_session(), given.root, given.out))


def _sort_map(arguments: list[str]) -> None:
    p = argparse.ArgumentParser("tapline sort-map")
    p.add_argument("file")
    p.add_argument("out", help="folder of the sorted maps")
    given = p.parse_args(arguments)
    pipeline.sort_map(_session(), given.file, given.out)


def _run(arguments: list[str] | None, days: bool) -> None:
    p = parser()
    if days:
        p.add_argument("--first-day", type=date.fromisoformat, required=True)
    given = vars(p.parse_args(arguments))
    first, quiet = given.pop("first_day", None), given.pop("no_banner")
    if not given["active_resolvers"]:
        del given["active_resolvers"]
    options = RunOptions(**given | {"post_hooks": tuple(given["post_hooks"])})
    if not quiet:
        print(f"tapline: {options.read_dir}, network {options.net_id}", file=sys.stderr)
    for done in pipeline.run_days(_session(), options, first) if days else [pipeline.run(_session(), options)]:
        print(done.path)


def main(arguments: list[str] | None = None) -> None:
    arguments = sys.argv[1:] if arguments is None else arguments
    command = arguments[0] if arguments else ""
    if command == "recover":
        _recover(arguments[1:])
    elif command == "sort-map":
        _sort_map(arguments[1:])
    else:
        _run(arguments[1:] if command == "days" else arguments, command == "days")


if __name__ == "__main__":
    main()
