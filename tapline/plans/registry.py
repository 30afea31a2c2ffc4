"""All registered queries of the core."""

from __future__ import annotations

from tapline.plans import data_queries, flow_queries, function_queries, parser_queries, report_queries, topology_queries

MODULES = (data_queries, function_queries, topology_queries, report_queries, flow_queries, parser_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark, folder: str):
    return report_queries.attributed_endpoints(spark, folder)
