"""Capture attribution on Spark: DataFrame operators for DNS, TLS, flow and RADIUS records."""
