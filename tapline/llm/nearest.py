"""Matching records by nearest time: each left row with the nearest right row of its entity within a tolerance.

Times are cut into buckets as wide as the tolerance, so a partner lies in the same or an adjacent bucket. Rows of
both sides meet per (entity, bucket), which spreads an entity with a third of all rows over its buckets. A plain
join there would multiply the two sides of a burst; instead each bucket is sorted once per direction and carries
the last right row forward, which is linear. Of an adjacent bucket only its last or first right row can be the
nearest, so only those two rows, found by an aggregation with map-side combine, cross the border.

A bucket with more than ``hot_rows`` rows is split into slices of time, of which there are at most as many as rows
over ``hot_rows``; each slice gets the bordering right rows from one row per slice. Buckets are counted with
map-side combine beforehand, and where none is that full the plan has no trace of slices.

Rows that share an instant cannot be told apart by time: right rows of a full bucket are first folded to the smallest
id of each instant, and a slice that still has more than ``hot_rows`` left rows is split by a hash of these.

``nearest_by_join`` is the join itself, bucket against same and adjacent buckets, filtered by difference, the minimum
kept. It is exact as well and has one sort less, but multiplies the two sides of a burst; so buckets where that would
come to more than ``most_pairs`` pairs are left to ``nearest``.

Edge cases: rows with null entity or time have no partner; equal distances before and after, and equal times, go
to the smaller right id; repeated rows count once; empty tables give an empty result; only the named columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.functions.numbers import floor_div
from tapline.session import cut


HOT_ROWS = 500_000
SLICES = 4096
MOST_PAIRS = 10_000
KNOWN_HOT = 100_000  # hot buckets up to which their list is broadcast
CELL = ["entity", "bucket"]


def _ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First and last right row of each cell; of equal times the smaller id."""
    last = F.max(F.struct("t", (-F.col("id")).alias("minus")))
    ends = rows.groupBy(*keys).agg(F.min(F.struct("t", "id")).alias("first"), last.alias("l"))
    return ends.select(*keys, "first", F.struct(F.col("l.t").alias("t"), (-F.col("l.minus")).alias("id")).alias("last"))


def _slice_borders(hot: DataFrame, right: DataFrame, over: DataFrame) -> DataFrame:
    """For every slice of a hot bucket the last right row before it and the first after it."""
    none = F.lit(None).cast("struct<t:bigint,id:bigint>")
    outside = over.join(hot, CELL).withColumn("earlier", F.col("t") < F.col("bucket") * F.col("width"))
    row = F.struct("t", "id")
    outside = outside.select(*CELL, F.when(F.col("earlier"), -1).otherwise(SLICES).cast("bigint").alias("slice"), F.when(~F.col("earlier"), row).alias("first"), F.when(F.col("earlier"), row).alias("last"))
    every = hot.select(*CELL, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"), none.alias("first"), none.alias("last"))
    rows = every.unionByName(outside).unionByName(_ends(right.join(hot.select(*CELL), CELL, "left_semi"), [*CELL, "slice"]))
    rows = rows.groupBy(*CELL, "slice").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    cell = Window.partitionBy(*CELL)  # at most SLICES + 2 rows
    seen = lambda c, order: F.last(c, ignorenulls=True).over(cell.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"b": seen("last", F.col("slice").asc()), "a": seen("first", F.col("slice").desc())}).filter(F.col("slice").between(0, SLICES - 1))
    return rows.select(*CELL, "slice", F.explode(F.array_compact(F.array("b", "a"))).alias("x")).select(*CELL, "slice", "x.t", "x.id")


def _rows(df: DataFrame, key: str, entity: Column, time: str, tolerance: int) -> DataFrame:
    """(entity, t, id, bucket) of the rows that can have a partner."""
    out = df.select(entity.alias("entity"), F.col(time).cast("bigint").alias("t"), F.col(key).cast("bigint").alias("id"))
    return out.filter("entity is not null and t is not null and id is not null").withColumn("bucket", floor_div(F.col("t"), tolerance))


def nearest_by_join(
    left: DataFrame, right: DataFrame, *, left_id: str, left_entity: Column, left_time: str, right_id: str, right_entity: Column, right_time: str, tolerance: int, most_pairs: int = MOST_PAIRS
) -> DataFrame:
    """The rows of ``nearest``, by joining each bucket with the same and the adjacent ones."""
    a, b = _rows(left, left_id, left_entity, left_time, tolerance), _rows(right, right_id, right_entity, right_time, tolerance)
    beside = b.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    n = lambda df, name: df.groupBy(*CELL).agg(F.count(F.lit(1)).alias(name))
    crowded = cut(n(a, "n").join(n(beside, "m"), CELL).filter(F.col("n") * F.col("m") > most_pairs).select(*CELL))
    n_crowded, rest = crowded.count(), None
    if n_crowded:
        known = F.broadcast(crowded) if n_crowded <= KNOWN_HOT else crowded
        mine, theirs = a.join(known, CELL, "left_semi"), beside.join(known, CELL, "left_semi").select("entity", "t", "id").distinct()
        rest = nearest(mine, theirs, left_id="id", left_entity=F.col("entity"), left_time="t", right_id="id", right_entity=F.col("entity"), right_time="t", tolerance=tolerance)
        a, beside = a.join(known, CELL, "left_anti"), beside.join(known, CELL, "left_anti")
    apart = F.abs(F.col("a.t") - F.col("b.t"))
    pairs = a.alias("a").join(beside.alias("b"), CELL).filter(apart <= tolerance)
    best = pairs.groupBy(F.col("a.id").alias("left_id")).agg(F.min(F.struct(apart.alias("distance"), F.col("b.id").alias("right_id"))).alias("x"))
    found = best.select("left_id", "x.right_id", "x.distance")
    return found if rest is None else found.unionByName(rest)


def nearest(
    left: DataFrame, right: DataFrame, *, left_id: str, left_entity: Column, left_time: str, right_id: str, right_entity: Column, right_time: str, tolerance: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(left_id, right_id, distance) for every left row that has a right row at most ``tolerance`` away."""

    none = F.lit(None).cast("bigint")
    a, b = _rows(left, left_id, left_entity, left_time, tolerance), _rows(right, right_id, right_entity, right_time, tolerance)
    full = a.select(*CELL).unionByName(b.select(*CELL)).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows)
    hot = cut(full.select(*CELL, F.least(F.ceil(F.col("n") / F.lit(hot_rows)), F.lit(SLICES)).alias("slices"), F.lit(tolerance).alias("width")))
    n_hot = hot.count()

    over = F.explode(F.array(F.struct((F.col("bucket") - 1).alias("bucket"), F.col("first.t").alias("t"), F.col("first.id").alias("id")), F.struct((F.col("bucket") + 1).alias("bucket"), F.col("last.t").alias("t"), F.col("last.id").alias("id"))))
    over = _ends(b, CELL).select("entity", over.alias("x")).select("entity", "x.bucket", "x.t", "x.id")
    keys = list(CELL)
    if n_hot:
        keys.append("slice")
        known = F.broadcast(hot) if n_hot <= KNOWN_HOT else hot
        width = floor_div(F.lit(tolerance) + F.col("slices") - 1, F.col("slices"))  # of a slice, rounded up
        place = floor_div(F.col("t") - F.col("bucket") * F.lit(tolerance), width)
        sliced = lambda df: df.join(known, CELL, "left").withColumn("slice", F.coalesce(F.least(place, F.col("slices") - 1), F.lit(0).cast("bigint"))).drop("slices", "width")
        b = b.join(known.select(*CELL, F.lit(True).alias("full")), CELL, "left")
        b = b.filter("full is null").drop("full").unionByName(b.filter("full").groupBy(*CELL, "t").agg(F.min("id").alias("id")).select(*b.columns[:-1]))
        a, b = sliced(a), sliced(b)
        over = over.withColumn("slice", F.lit(0).cast("bigint")).unionByName(_slice_borders(hot, b, over))

        salts = a.join(known.select(*CELL), CELL, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows)
        salts = cut(salts.select(*keys, F.ceil(F.col("n") / F.lit(hot_rows)).alias("salts")))
        if n_salted := salts.count():
            salts, many = F.broadcast(salts) if n_salted <= KNOWN_HOT else salts, F.coalesce("salts", F.lit(1))
            a = a.join(salts, keys, "left").withColumn("salt", F.pmod(F.xxhash64("id"), many)).drop("salts")
            b, over = (x.join(salts, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1))).drop("salts") for x in (b, over))
            keys = [*keys, "salt"]

    both = a.select(*keys, "t", F.col("id").alias("left_id"), none.alias("right_id"))
    both = both.unionByName(b.unionByName(over).select(*keys, "t", none.alias("left_id"), F.col("id").alias("right_id")))
    # Right rows stand before left rows of the same time, the smallest id of equal times last, so that it is the one carried on.
    cell = Window.partitionBy(*keys)
    partner = F.when(F.col("right_id").isNotNull(), F.struct("t", "right_id"))
    carried = lambda *order: F.last(partner, ignorenulls=True).over(cell.orderBy(*order, F.col("right_id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("before", carried(F.col("t").asc())).withColumn("after", carried(F.col("t").desc()))
    near = lambda c: F.when(F.abs(F.col(f"{c}.t") - F.col("t")) <= tolerance, F.struct(F.abs(F.col(f"{c}.t") - F.col("t")).alias("distance"), F.col(f"{c}.right_id").alias("right_id")))
    found = both.filter("left_id is not null").select(*keys, "left_id", F.least(near("before"), near("after")).alias("x")).filter("x is not null")
    return found.groupBy(*keys, "left_id").agg(F.min("x").alias("x")).select("left_id", "x.right_id", "x.distance")
