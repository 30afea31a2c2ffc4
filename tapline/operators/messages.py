"""Messages delivered more than once: keep exactly one copy of each, over stored and new batches alike.

Identifiers are split by their aggregated frequency, which one aggregation with map-side combine gives together
with the smallest and the greatest row number of each. An identifier seen once passes directly, and of one seen
twice both rows are known by then. Only rows of identifiers seen more often are looked up and ranked, in two steps:
inside (identifier, salt), then over the first row of each salt, so that a group with a third of all rows is
ranked by many tasks. Their list is broadcast if it is counted to be short; else it is joined by identifier and
salt, so no join has a hot key either. Kept rows carry their other columns through the aggregation, so that the
messages are shuffled once.

Edge cases: rows with a null in a required key column are not messages with an identity; they are kept and never
cases. Ties cannot occur, row numbers are unique; should a row number repeat, its rows are equal copies of one
delivery and count once. Empty tables give empty results; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.session import cut

SALTS = 64
KNOWN = 100_000  # identifiers seen more than twice up to which their list is broadcast


def _keyed(messages: DataFrame, keys: dict[str, Column], required: list[str], row_id: str, rest: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    names = [f"_key_{k}" for k in keys]
    rows = messages.select(F.col(row_id).alias("_id"), *[c.alias(f"_key_{k}") for k, c in keys.items()], *([F.struct(*rest).alias("_row")] if rest else []))
    for k in required:
        rows = rows.filter(F.col(f"_key_{k}").isNotNull())
    return rows, names


def _frequency(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), F.max("_id").alias("_last"))


def _more_than_two(rows: DataFrame, often: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Row numbers of every copy but the first of the identifiers in ``often``."""
    n = often.count()
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    spread = often if n <= KNOWN else often.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (keys if n <= KNOWN else [*keys, "_salt"])]
    rows = salted.alias("a").join(F.broadcast(spread.alias("b")) if n <= KNOWN else spread.alias("b"), same, "left_semi").distinct()
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("_id")))
    over = Window.partitionBy(*keys).orderBy("_id")  # at most one row per salt
    heads = rows.filter("_rank = 1").withColumn("_head", F.row_number().over(over)).filter("_head > 1")
    return heads.select("_id").unionByName(rows.filter("_rank > 1").select("_id"))


def repeated_copies(messages: DataFrame, keys: dict[str, Column], required: list[str], row_id: str, salts: int = SALTS) -> DataFrame:
    """Row numbers of every copy but the first of its message."""
    rows, names = _keyed(messages, keys, required, row_id)
    repeated = cut(_frequency(rows, names).filter((F.col("_n") > 1) & (F.col("_first") < F.col("_last"))))
    twice = repeated.filter("_n = 2").select(F.col("_last").alias("_id"))
    often = repeated.filter("_n > 2").select(*names)
    return twice.unionByName(_more_than_two(rows, often, names, salts)).select(F.col("_id").alias(row_id))


def first_copies(messages: DataFrame, keys: dict[str, Column], required: list[str], row_id: str, salts: int = SALTS) -> DataFrame:
    """One copy of each message, whole rows: the singletons and the first of every repeated group.

    First copies of both kinds come out of the frequency aggregation; its map-side combine does what ``salts`` do
    where rows are ranked, so the number makes no difference here.
    """
    rest = [c for c in messages.columns if c != row_id]
    rows, names = _keyed(messages, keys, required, row_id, rest)
    freq = rows.groupBy(*names).agg(F.min_by(F.struct("_id", "_row"), "_id").alias("_kept"))
    return freq.select(F.col("_kept._id").alias(row_id), "_kept._row.*").select(*messages.columns)


def deduplicated(messages: DataFrame, keys: dict[str, Column], required: list[str], row_id: str, salts: int = SALTS) -> DataFrame:
    """The messages without their repeated copies; rows without an identity are all kept."""
    bare = F.lit(False)
    for k in required:
        bare = bare | keys[k].isNull()
    return first_copies(messages, keys, required, row_id, salts).unionByName(messages.filter(bare))
