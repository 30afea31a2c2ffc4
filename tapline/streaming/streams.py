"""The pairing operators over unbounded streams, with state that is dropped by watermark or timer.

Streams are DataFrames from ``readStream``. The batch operators are exact over whole runs; these give the same
rows as long as messages are at most as late as the watermark allows, and never keep state for longer.

Edge cases: rows with null keys never pair; rows later than the watermark are dropped; empty streams give nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapline.functions.numbers import floor_div
from tapline.operators import edges
from tapline.operators.radius import INTERIM, JOIN_MS, REPEAT_MS, START, STOP, _Sessions


def _timed(df: DataFrame, ns: str, late: str) -> DataFrame:
    return df.withColumn("at", F.timestamp_micros(floor_div(F.col(ns), 1000))).withWatermark("at", late)


def handshake_edges(packets: DataFrame, ttl_s: int = 30, late: str = "10 seconds") -> DataFrame:
    """(issuer_ip, dst_ip, port, first_seen_ns, at) for every request answered within the time to live.

    A stream-stream join; each side's state is bounded by the time condition and the watermark.
    """
    tcp = packets.filter("l4 = 'tcp' and src_port <> 0 and dst_port <> 0").select("src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "ts_ns")
    flag = lambda bits: F.col("tcp_flags").bitwiseAND(F.lit(edges.SYN | edges.ACK)) == bits
    ask = _timed(tcp.filter(flag(edges.SYN)), "ts_ns", late).alias("a")
    answer = _timed(tcp.filter(flag(edges.SYN | edges.ACK)), "ts_ns", late).alias("b")
    same = F.expr("a.src_ip = b.dst_ip and a.dst_ip = b.src_ip and a.src_port = b.dst_port and a.dst_port = b.src_port")
    soon = F.expr(f"b.at >= a.at and b.at <= a.at + interval {ttl_s} seconds")
    return ask.join(answer, same & soon).select(F.col("a.src_ip").alias("issuer_ip"), F.col("a.dst_ip").alias("dst_ip"), F.col("a.dst_port").alias("port"), F.col("a.ts_ns").alias("first_seen_ns"), F.col("a.at").alias("at"))


def first_deliveries(messages: DataFrame, keys: list[str], time: str, window_ms: int = REPEAT_MS) -> DataFrame:
    """One delivery of each message within the window; state for a key is dropped when the window has passed."""
    return messages.withWatermark(time, f"{window_ms} milliseconds").dropDuplicatesWithinWatermark(keys)


def periods(events: DataFrame, key: str, time: str, gap_ms: int = JOIN_MS, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of events at most ``gap_ms`` apart, given out when they cannot grow any more."""
    rows = events.withWatermark(time, late).groupBy(key, F.session_window(time, f"{gap_ms} milliseconds").alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("end")).select(key, F.col("w.start").alias("start"), "end", "n")


SESSIONS = "imsi string, ip string, sid string, start_ms bigint, end_ms bigint, provisional boolean"


def sessions(messages: DataFrame, late: str = "10 minutes", idle_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """Session windows of (imsi, ip, sid, ts_ms, sess_time_sec, status), by the rules of the batch operator.

    Messages of a subscriber's address are taken in time order within each micro-batch; what is open when none has
    come for ``idle_ms`` of event time is closed and its state removed.
    """
    rows = messages.filter("imsi <> '' and ip <> '' and ts_ms is not null and status is not null").withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    rows = rows.select("imsi", "ip", F.when(F.coalesce("sid", F.lit("")) == "", "-").otherwise(F.col("sid")).alias("sid"), "ts_ms", "sess_time_sec", F.when(F.col("status").isin(START, INTERIM, STOP), F.col("status")).otherwise(INTERIM).alias("status"), "at")

    late_ms = int(pd.Timedelta(late).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = _Sessions(2**62, False, late_ms)
        machine.who = (key[0], key[1])
        if state.exists:
            machine.open, machine.closed = pickle.loads(state.get[0])
        out = []
        if state.hasTimedOut:
            out = [(*key, sid, *w) for sid, w in machine.open.items()]
            state.remove()
        else:
            frame = pd.concat(parts).fillna({"sess_time_sec": 0}).sort_values(["ts_ms", "sid", "status", "sess_time_sec"], ascending=[True, True, True, False])
            for row in frame.to_dict("records"):
                row["sess_time_sec"] = 0 if pd.isna(row["sess_time_sec"]) else int(row["sess_time_sec"])
                out += machine.step(row)
            state.update((pickle.dumps((machine.open, machine.closed)),))
            state.setTimeoutTimestamp(max(int(frame["ts_ms"].max()) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["imsi", "ip", "sid", "start_ms", "end_ms", "provisional"])

    return rows.groupBy("imsi", "ip").applyInPandasWithState(step, SESSIONS, "machine binary", "append", GroupStateTimeout.EventTimeTimeout)
