"""RADIUS accounting: repeated messages dropped, sessions built, fragments joined, addresses labelled.

Edge cases: messages without identity, address or time make no session; a missing session id is ``-``; windows
that end before they start are left out; messages of equal time are ordered by session id, status and, the longer
first, session time; empty tables give empty results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.functions.numbers import floor_div
from tapline.operators import asof, intervals
from tapline.operators.carry import run_ordered

# Message kinds, and the times that steer pairing, in milliseconds.
START, INTERIM, STOP = 1, 2, 3
REPEAT_MS = 2 * 3600 * 1000
SAME_START_MS = 5_000
LATE_MS = 120_000
JOIN_MS = 120_000
IDLE_MS = 6 * 3600 * 1000
FEW = 64  # closed windows that are kept without looking through them
# Fixed value: the most digits of an identity.
DIGITS = 16


class _FirstInWindow:
    """Keeps a message unless one was kept at most ``ttl`` before; what is dropped does not prolong."""

    def __init__(self, ttl: int):
        self.ttl, self.kept = ttl, None

    def step(self, row: dict) -> list:
        if self.kept is not None and row["t"] - self.kept <= self.ttl:
            return []
        self.kept = row["t"]
        return [(row["id"],)]

    def end(self) -> list:
        return []


def first_in_window(messages: DataFrame, key: Column, time: Column, row_id: str, ttl: int = REPEAT_MS) -> DataFrame:
    """Row numbers of the messages that are not repeats. Runs of a key further apart than ``ttl`` are keys of their own."""
    rows = messages.select(key.alias("entity"), time.cast("bigint").alias("t"), F.col(row_id).alias("id")).filter("entity is not null and t is not null")
    runs = intervals.marked(rows.select("entity", F.col("t").alias("start"), (F.col("t") + ttl).alias("end")), chunk=12 * ttl)
    rows = rows.join(runs.select("entity", F.col("start").alias("t"), "island"), ["entity", "t"])
    out = pa.schema([("id", pa.int64())])
    return run_ordered(rows.select("entity", "island", "t", "id"), ["entity", "island"], ["t", "id"], lambda: _FirstInWindow(ttl), "id bigint", out).withColumnRenamed("id", row_id)


class _Sessions:
    """The session rules for one (imsi, ip): what a start, an interim and a stop do to open windows."""

    def __init__(self, tail: int, emit_open: bool, late_ms: int = 0):
        self.tail, self.emit_open, self.keep_ms, self.most = tail, emit_open, LATE_MS + late_ms, FEW
        self.open: dict[str, list] = {}  # sid: [start, end, provisional]
        self.closed: dict[str, list] = {}  # those an interim can still prolong
        self.who = ("", "")

    def _out(self, sid: str, w: list) -> tuple:
        return (*self.who, sid, w[0], w[1], w[2])

    def _forget(self, t: int) -> None:
        """Drop closed windows no message can reach any more, each time their number has doubled."""
        if len(self.closed) >= self.most:
            self.closed = {s: w for s, w in self.closed.items() if w[1] >= t - self.keep_ms}
            self.most = max(FEW, 2 * len(self.closed))

    def step(self, row: dict) -> list:
        self.who = (row["imsi"], row["ip"])
        self._forget(row["ts_ms"])
        t, sid, back = row["ts_ms"], row["sid"], max(row["sess_time_sec"] or 0, 0) * 1000
        if row["status"] == START:
            return self._start(t, sid)
        window = self.open.get(sid)
        if row["status"] == STOP:
            if window is not None:
                window[1] = t
                self.closed[sid] = self.open.pop(sid)
            else:
                self.closed[sid] = [t - back, t, False]
            return [self._out(sid, self.closed[sid])]
        if window is not None:
            window[1] = max(window[1], t)
        elif sid in self.closed and t - self.closed[sid][1] <= LATE_MS:
            self.closed[sid] = [self.closed[sid][0], t, self.closed[sid][2]]
            return [self._out(sid, self.closed[sid])]
        else:
            self.open[sid] = [t - back, t, True]
        return []

    def _start(self, t: int, sid: str) -> list:
        result = []
        for other in [s for s in self.open if s != sid]:
            window = self.open.pop(other)
            if window[1] >= t:
                window[1] = t - 1
            self.closed[other] = window
            result.append(self._out(other, window))
        window = self.open.get(sid)
        if window is not None and window[0] - SAME_START_MS <= t <= window[1] + SAME_START_MS:
            window[2] = False
        else:
            self.open[sid] = [t, t, False]
        return result

    def end(self) -> list:
        result = []
        for sid, w in self.open.items():
            if w[2] or w[1] <= self.tail - IDLE_MS:
                result.append(self._out(sid, [w[0], min(w[1], self.tail), w[2]]))
            elif self.emit_open:
                result.append(self._out(sid, w))
        return result


def sessions(messages: DataFrame, emit_open: bool = False) -> DataFrame:
    """(imsi, ip, sid, start_ms, end_ms, provisional) windows of messages (imsi, ip, sid, ts_ms, sess_time_sec, status).

    Rules touch one (imsi, ip) at a time; its messages stream through in order with only its open windows in
    memory. The greatest time of all messages, which decides what counts as idle, is one number taken beforehand.
    """
    rows = messages.filter("imsi is not null and imsi <> '' and ip is not null and ip <> '' and ts_ms is not null and status is not null and status <> 0")
    rows = rows.select("imsi", "ip", F.when(F.coalesce("sid", F.lit("")) == "", "-").otherwise(F.col("sid")).alias("sid"), "ts_ms", "sess_time_sec", F.when(F.col("status").isin(START, INTERIM, STOP), F.col("status")).otherwise(INTERIM).alias("status"))
    tail = rows.agg(F.max("ts_ms")).first()[0] or 0
    out = pa.schema([("imsi", pa.string()), ("ip", pa.string()), ("sid", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("provisional", pa.bool_())])
    return run_ordered(rows, ["imsi", "ip"], ["ts_ms", "sid", "status", F.coalesce("sess_time_sec", F.lit(0)).desc()], lambda: _Sessions(tail, emit_open), "imsi string, ip string, sid string, start_ms bigint, end_ms bigint, provisional boolean", out)


def coalesced(windows: DataFrame, reach_ms: int = JOIN_MS) -> DataFrame:
    """Windows of the same (imsi, ip, sid) at most ``reach_ms`` apart joined into one; an open end stays null."""
    rows = windows.filter("imsi is not null and ip is not null").withColumn("who", F.struct("imsi", "ip", F.coalesce(F.nullif("sid", F.lit("")), F.lit("-")).alias("sid")))
    rows = intervals.usable(rows, "who", "start_ms", "end_ms")
    rows = rows.withColumn("end", F.when(F.col("end") < intervals.FOREVER, F.col("end") + reach_ms).otherwise(F.col("end")))
    end = F.when(F.col("period_end") < intervals.FOREVER, F.col("period_end") - reach_ms)
    return intervals.periods(rows).select("entity.imsi", "entity.ip", "entity.sid", F.col("period_start").alias("start_ms"), end.alias("end_ms"))


def labels(events: DataFrame, windows: DataFrame, event_id: str, ip: Column, time_ms: Column) -> DataFrame:
    """(event_id, imsi): the subscriber whose window holds the address at that moment; the first imsi of several as text.

    An imsi, at most ``DIGITS`` digits, becomes one number that keeps its length and the order of the texts.
    """
    number = F.rpad("imsi", DIGITS, "0").cast("bigint") * (DIGITS + 1) + F.length("imsi")
    rows = windows.filter("imsi is not null and ip is not null").withColumns({"wid": number, "always": F.col("start_ms")})
    found = asof.as_known(events, rows, event_id=event_id, event_entity=ip, event_time=time_ms, version_id="wid", version_entity=F.col("ip"), start="start_ms", end="end_ms", known="always", prefer=(-number, F.lit(0).cast("bigint")))
    digits = F.lpad(floor_div(F.col("version_id"), DIGITS + 1).cast("string"), DIGITS, "0")
    return found.select(F.col("event_id").alias(event_id), F.substr(digits, F.lit(1), (F.col("version_id") % (DIGITS + 1)).cast("int")).alias("imsi"))
