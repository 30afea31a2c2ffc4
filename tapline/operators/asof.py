"""Attributes as known at event time: each event with the version that was valid and already recorded then.

A version is active from the later of its start and the moment it became known, to its end. Events and versions
are co-grouped by entity and time bucket, many cells to a task, and inside a task every version finds the run of
events it covers by vectorised binary search; the best version of each event comes from a maximum over a segment
tree of those runs, so that neither long histories nor many overlapping versions make the search quadratic.

A version is sent only to the buckets in which it becomes active or ends. Where it covers whole buckets, it is
entered at the few nodes of a binary tree over the buckets that make up that range, and only the best version of
each node is kept, by an aggregation with map-side combine. A cell then takes one row, the best of its ancestors.
So an entity with a third of all rows is split by time, an open-ended version is not copied to every later bucket,
and a cell with more than ``cell_rows`` events is split further by a hash of the event. A cell in which more than
``cell_rows`` versions begin or end is split by a hash of the version: its events go to every part, and the best of
the parts' answers is taken. Such cells are counted beforehand; where there is none the plan has no trace of parts.

Edge cases: events without entity or time get no row; versions without entity or start, and those that end before
they start, are not used; an end that is null or 0 is open; a null record time means known from the start. Of
several versions the greatest start wins, then the greatest record time, then the greatest version id. Repeated
events and versions count once; empty tables give an empty result. Only the columns named are read, so further
columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.functions.numbers import floor_div
from tapline.session import cut, task_count

BUCKET_MS = 6 * 3600 * 1000
CELL_ROWS = 200_000
TASK_ROWS = 250_000
PARTS = 1 << 20  # more than a cell can have parts
KNOWN_HEAVY = 100_000  # cells with very many versions up to which their list is broadcast
LOW, HIGH = -(2**62), 2**62


def best_cover(at: np.ndarray, since: np.ndarray, until: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each value of the sorted ``at`` the greatest weight of the ranges [since, until] that hold it, or -1."""
    size = 1 << max(0, int(len(at) - 1).bit_length())
    tree = np.full(2 * size, -1, dtype=np.int64)
    left = np.searchsorted(at, since, side="left") + size
    right = np.searchsorted(at, until, side="right") + size
    live = left < right
    left, right, weight = left[live], right[live], weight[live]
    while len(left):
        odd = (left & 1) == 1
        np.maximum.at(tree, left[odd], weight[odd])
        left = (left + odd) >> 1
        odd = (right & 1) == 1
        np.maximum.at(tree, right[odd] - 1, weight[odd])
        right = (right - odd) >> 1
        live = left < right
        left, right, weight = left[live], right[live], weight[live]
    level = 1
    while level < size:
        tree[2 * level : 4 * level] = np.maximum(tree[2 * level : 4 * level], np.repeat(tree[level : 2 * level], 2))
        level *= 2
    return tree[size : size + len(at)]


def _match(span: int) -> callable:
    """The co-group function: cells of one task, times as offsets from the start of their bucket."""

    def run(events: pa.Table, versions: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("event_id", "version_id", "first", "second")})
        if not events.num_rows or not versions.num_rows:
            return empty
        n = events.num_rows
        cells = pd.MultiIndex.from_arrays([np.concatenate([events[c].to_numpy(), versions[c].to_numpy()]) for c in ("entity", "bucket", "salt")])
        code, _ = pd.factorize(cells)
        step = span + 2  # a cell's times are 0 to span - 1
        at = code[:n].astype(np.int64) * step + events["offset"].to_numpy()
        since = code[n:].astype(np.int64) * step + np.clip(versions["since"].to_numpy(), 0, span)
        until = code[n:].astype(np.int64) * step + np.clip(versions["until"].to_numpy(), -1, span - 1)
        one, two, vid = (versions[c].to_numpy() for c in ("first", "second", "version_id"))
        order = np.lexsort((vid, two, one))
        weight = np.empty(len(order), dtype=np.int64)
        weight[order] = np.arange(len(order))
        by_time = np.argsort(at, kind="stable")
        keep = until >= since
        best = best_cover(at[by_time], since[keep], until[keep], weight[keep])
        hit = best >= 0
        won = order[best[hit]]
        return pa.table({"event_id": events["event_id"].to_numpy()[by_time][hit], "version_id": vid[won], "first": one[won], "second": two[won]})

    return run


def as_known(
    events: DataFrame, versions: DataFrame, *, event_id: str, event_entity: Column, event_time: Column, version_id: str, version_entity: Column, start: str, end: str, known: str, prefer: tuple[Column, Column] | None = None,
    bucket: int = BUCKET_MS, cell_rows: int = CELL_ROWS, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(event_id, version_id) of every event that has an active version, times in milliseconds.

    ``prefer`` are two BIGINT columns the greatest of which wins; start and record time unless given.
    """
    e = events.select(F.col(event_id).cast("bigint").alias("event_id"), event_entity.alias("entity"), event_time.cast("bigint").alias("t")).filter("event_id is not null and entity is not null and t is not null")
    low, high, n = e.agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
    low, high = (low, high) if n else (0, 0)
    first = low // bucket
    levels = max(1, math.ceil(math.log2(high // bucket - first + 1)) + 1)
    tasks = task_count(events, n + versions.count(), task_rows)
    e = e.distinct().withColumn("bucket", floor_div(F.col("t"), bucket) - F.lit(first))

    opened = F.when(F.col(end).isNull() | (F.col(end) == 0), F.lit(HIGH)).otherwise(F.col(end).cast("bigint"))
    begun, recorded = F.col(start).cast("bigint"), F.coalesce(F.col(known), F.col(start)).cast("bigint")
    first_choice, second_choice = prefer or (begun, recorded)
    v = versions.filter(F.col(version_id).isNotNull() & begun.isNotNull() & (opened >= begun))
    v = v.select(F.col(version_id).cast("bigint").alias("version_id"), version_entity.alias("entity"), opened.alias("until"), F.greatest(begun, recorded).alias("since"), first_choice.alias("first"), second_choice.alias("second"))
    v = v.filter("entity is not null")
    v = v.filter((F.col("since") <= F.col("until")) & (F.col("since") <= F.lit(high)) & (F.col("until") >= F.lit(low)))
    inside = lambda c: floor_div(F.least(F.greatest(c, F.lit(low)), F.lit(high)), bucket) - F.lit(first)
    v = v.withColumns({"b1": inside(F.col("since")), "b2": inside(F.col("until"))})

    cells = e.groupBy("entity", "bucket").agg(F.count(F.lit(1)).alias("n"))
    nodes = v.filter("b2 - b1 > 1").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    width = F.expr("shiftleft(1L, level)")
    nodes = nodes.withColumns({"l": floor_div(F.col("b1") + width, width), "r": floor_div(F.col("b2"), width)}).filter("l < r")
    nodes = nodes.withColumn("node", F.explode(F.filter(F.array(F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("r") % 2 == 1, F.col("r") - 1)), lambda x: x.isNotNull())))
    best = F.max(F.struct("first", "second", "version_id")).alias("best")
    nodes = nodes.groupBy("entity", "level", "node").agg(best)
    up = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", floor_div(F.col("bucket"), width))
    covers = up.join(nodes, ["entity", "level", "node"]).groupBy("entity", "bucket").agg(F.max("best").alias("best"))
    covers = covers.select("entity", "bucket", F.lit(0).cast("bigint").alias("since"), F.lit(bucket - 1).cast("bigint").alias("until"), "best.first", "best.second", "best.version_id")
    begin = (F.col("bucket") + F.lit(first)) * F.lit(bucket)
    edge = v.withColumn("bucket", F.explode(F.array_distinct(F.array("b1", "b2"))))
    limit = lambda c: F.least(F.greatest(c - begin, F.lit(-1)), F.lit(bucket)).cast("bigint")
    edge = edge.select("entity", "bucket", limit(F.col("since")).alias("since"), limit(F.col("until")).alias("until"), "first", "second", "version_id")
    heavy = edge.groupBy("entity", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
    heavy = cut(heavy.select("entity", "bucket", F.ceil(F.col("n") / F.lit(cell_rows)).alias("parts")))
    n_heavy = heavy.count()
    v = edge.unionByName(covers)

    crowded = cells.filter(F.col("n") > cell_rows).select("entity", "bucket", F.ceil(F.col("n") / F.lit(cell_rows)).alias("salts"))
    e = e.join(crowded, ["entity", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("event_id"), F.coalesce("salts", F.lit(1))))
    v = v.join(crowded, ["entity", "bucket"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1)))
    if n_heavy:
        known = F.broadcast(heavy) if n_heavy <= KNOWN_HEAVY else heavy
        parts = F.coalesce("parts", F.lit(1))
        e = e.join(known, ["entity", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        v = v.join(known, ["entity", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("version_id"), parts))
        e, v = (x.withColumn("salt", F.col("salt") * PARTS + F.col("part")) for x in (e, v))
    task = F.pmod(F.xxhash64("entity", "bucket", "salt"), F.lit(tasks)).alias("task")
    e = e.select(task, "entity", "bucket", "salt", "event_id", (F.col("t") - begin).alias("offset"))
    v = v.select(task, "entity", "bucket", "salt", "since", "until", "first", "second", "version_id")
    found = e.groupBy("task").cogroup(v.groupBy("task")).applyInArrow(_match(bucket), "event_id bigint, version_id bigint, first bigint, second bigint")
    if n_heavy:
        found = found.groupBy("event_id").agg(F.max(F.struct("first", "second", "version_id")).alias("b")).select("event_id", "b.version_id")
    return found.select("event_id", "version_id")
