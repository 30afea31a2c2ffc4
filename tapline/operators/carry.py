"""Looking back in time within a tolerance, and running sequential rules over sorted rows.

``last_before`` finds for every probe the latest fact of the same key not older than the tolerance. Both sides
meet per (key, time bucket as wide as the tolerance), each bucket is sorted once and the last fact carried on; of
the bucket before only its last fact is needed, which an aggregation with map-side combine provides. Nothing is
multiplied, and a busy key is spread over its buckets.

``run_ordered`` feeds rows, sorted within their key, to a state machine batch by batch; memory holds a batch and
the state of one key, however many rows the key has.

Edge cases: null keys or times never match; of facts at equal times the smaller id is taken; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.functions.numbers import floor_div


def last_before(probes: DataFrame, facts: DataFrame, keys: list[str], tolerance: int, strict: bool) -> DataFrame:
    """Adds ``fact_id`` and ``fact_t`` to the probes (keys, t, and anything else); both null where there is none.

    Facts have keys, t and id. With ``strict`` a fact at the very time of the probe does not count.
    """
    whole = floor_div(F.col("t"), tolerance)
    have = " and ".join(f"{k} is not null" for k in [*keys, "t"])
    p = probes.withColumn("_b", whole).withColumn("_kind", F.lit(0 if strict else 2))
    f = facts.filter(have).select(*keys, "t", "id", whole.alias("_b"))
    ends = f.groupBy(*keys, "_b").agg(F.max(F.struct("t", (-F.col("id")).alias("m"))).alias("e")).select(*keys, F.col("e.t").alias("t"), (-F.col("e.m")).alias("id"), (F.col("_b") + 1).alias("_b"))
    f = f.unionByName(ends).select(*keys, "t", "_b", F.col("id").alias("_id"), F.lit(1).alias("_kind"))
    both = p.unionByName(f, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_b").orderBy("t", "_kind", F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    fact = F.last(F.when(F.col("_kind") == 1, F.struct(F.col("t").alias("t"), F.col("_id").alias("id"))), ignorenulls=True).over(order)
    out = both.withColumn("_f", fact).filter("_kind <> 1")
    near = F.when(F.col("t") - F.col("_f.t") <= tolerance, F.col("_f"))
    return out.withColumn("_f", near).withColumns({"fact_id": F.col("_f.id"), "fact_t": F.col("_f.t")}).drop("_b", "_kind", "_id", "_f")


def run_ordered(rows: DataFrame, keys: list[str], order: list[str | Column], machine: Callable[[], object], schema: str, out: pa.Schema) -> DataFrame:
    """Rows in order to ``machine()``, an object with ``step(key, row) -> list`` and ``end() -> list`` of result tuples.

    ``end`` is called when a key is complete. The object is made anew for every key.
    """
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            result = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(columns, values, strict=True))
                key = tuple(row[k] for k in keys)
                if state is None or key != now:
                    if state is not None:
                        result += state.end()
                    now, state = key, machine()
                result += state.step(row)
            if result:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*result, strict=True), out, strict=True)], schema=out)
        if state is not None and (result := state.end()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*result, strict=True), out, strict=True)], schema=out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
