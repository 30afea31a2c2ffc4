"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them.

Starts are sorted per entity and compared with the greatest end seen before. The running maximum is taken in two
steps, inside chunks of time and over one summary row per chunk, so that an entity with a third of all rows is
spread over as many tasks as it has chunks; no task ever holds all intervals of an entity.

Edge cases: rows without entity or start, and rows whose end lies before their start, are left out; an end that
is null or 0 means the interval lasts for good; repeated rows and equal starts count once; an empty table gives
empty results. An interval covers its start and its end, so one that starts exactly at the greatest end so far
continues the period and one that starts later opens a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.functions.numbers import floor_div

FOREVER = 2**63 - 1
CHUNK_MS = 6 * 3600 * 1000


def usable(windows: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Entity, start and end of the intervals that count, as ``entity``, ``start``, ``end``; open ends become FOREVER."""
    ended = F.when(F.col(end).isNull() | (F.col(end) == 0), F.lit(FOREVER)).otherwise(F.col(end).cast("bigint"))
    rows = windows.select(F.col(entity).alias("entity"), F.col(start).cast("bigint").alias("start"), ended.alias("end"))
    return rows.filter(F.col("entity").isNotNull() & F.col("start").isNotNull() & (F.col("end") >= F.col("start")))


def _chunk(time: str, chunk: int) -> Column:
    """Number of the chunk. Times are not null, but Spark must see that: a join would else filter one of its sides by
    it, which would then not be the same as the other any more, and be read and shuffled for itself."""
    return F.coalesce(floor_div(F.col(time), chunk), F.lit(0).cast("bigint"))


def marked(rows: DataFrame, chunk: int = CHUNK_MS) -> DataFrame:
    """One row per (entity, start) with the greatest ``end`` from there, ``before``, the greatest end of all
    earlier starts (null for the first), and ``island``, the period's number within the entity from 1 on."""
    cells = rows.withColumn("chunk", _chunk("start", chunk)).repartition("entity", "chunk")
    cells = cells.groupBy("entity", "chunk", "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("entity", "chunk").orderBy("start")
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy("entity").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.groupBy("entity", "chunk").agg(F.max("end").alias("top")).select("entity", "chunk", F.max("top").over(chunks).alias("carry"))
    cells = cells.join(carry, ["entity", "chunk"]).withColumn("before", F.greatest("carry", F.max("end").over(past)))
    cells = cells.withColumn("opens", F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0))
    opened = cells.groupBy("entity", "chunk").agg(F.sum("opens").alias("o")).select("entity", "chunk", F.coalesce(F.sum("o").over(chunks), F.lit(0)).alias("islands"))
    running = F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return cells.join(opened, ["entity", "chunk"]).select("entity", "start", "end", "before", "n", "opens", (F.col("islands") + running).alias("island"))


def periods(rows: DataFrame, chunk: int = CHUNK_MS) -> DataFrame:
    """(entity, period_start, period_end, n_intervals): the continuous periods; an open one ends at FOREVER."""
    return marked(rows, chunk).groupBy("entity", "island").agg(F.min("start").alias("period_start"), F.max("end").alias("period_end"), F.sum("n").alias("n_intervals")).drop("island")


def gaps(rows: DataFrame, chunk: int = CHUNK_MS) -> DataFrame:
    """(entity, gap_start, gap_end): from the end of each period to the start of the entity's next.

    Periods are looked through by chunks of time; the last end of each chunk is carried on to the next.
    """
    found = periods(rows, chunk).withColumn("chunk", _chunk("period_start", chunk))
    inside = Window.partitionBy("entity", "chunk").orderBy("period_start")
    last = found.groupBy("entity", "chunk").agg(F.max("period_end").alias("top"))
    carry = last.select("entity", "chunk", F.lag("top").over(Window.partitionBy("entity").orderBy("chunk")).alias("carry"))
    found = found.join(carry, ["entity", "chunk"]).withColumn("gap_start", F.coalesce(F.lag("period_end").over(inside), "carry"))
    return found.filter("gap_start is not null").select("entity", "gap_start", F.col("period_start").alias("gap_end"))
