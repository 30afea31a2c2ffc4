"""Deduplicating new batches against everything accepted before, without going through the history again.

Accepted pairs live in one bucketed table in the shared folder, keyed by hashes: one row for the hash of the whole
normalised content and one for that of each of its three parts (the paragraphs of these short texts). A new batch
is shuffled to the buckets and joined there: whole hashes find full copies, part hashes find near copies, which are
confirmed on the text. What remains is compared with itself in the same way, decided in order, and its hashes are
appended. The history is neither shuffled nor normalised again; a batch small enough to be broadcast does not even
make it sort. Inside a file whole and part hashes stand apart, so that only those asked for are read. Every ``compact_every`` appends the files of a bucket are merged into one.

The folder holds a note of what the table is like, so it can be opened again, in another session too, and goes on
with what was accepted. A batch taken twice, e.g. after a crash, finds its own rows but only compares itself with
smaller order numbers, so nothing changes.

Part hashes are exact for edit distance: a text within two edits of another keeps at least one of that text's
three parts unchanged, moved by at most two places (Li et al., Pass-Join, PVLDB 2011), so every near copy shares a
part hash, and each hit is checked with the true distance. Buckets are chosen by hash of the part, so an address
with a third of all pairs is spread over all of them; copies of one pair are first folded into one row by an
aggregation with map-side combine, and rows are told apart by their unique order number afterwards. A part that
very many texts of a batch share (a common ending) would compare them all with each other: such keys are counted in
the batch and refined by what is left of the text around the part with up to two characters deleted, of which two
near copies share one (texts with more than ``LONG`` characters around the part excepted).

Within a batch resemblances are decided in one pass in order of the later text, per address and digits, remembering
the order numbers of texts that fell; there is no loop in the driver.

Edge cases: pairs with null address or name are left alone (neither found nor accepted); empty names and names
shorter than three characters have empty parts, which still match exactly; repeated pairs are cases from the
second on; an empty batch changes nothing; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions.addresses import BLANKS, plain_address
from tapline.operators.carry import run_ordered
from tapline.session import cut, read_note, remove, shared_folder, write_note

DISTANCE = 2
CROWD = 2000  # texts of one batch that may share a key before it is refined
LONG = 64  # characters around a part up to which it is refined
COMPACT_EVERY = 16
SCHEMA = "key BIGINT, kind INT, ip STRING, name STRING, digits STRING, ord BIGINT"
WHOLE, PART = 0, 1
TEXT = ["ip", "name", "digits", "ord"]


def plain_name(name: Column) -> Column:
    """Lower case, without blanks around it and without dots at the end."""
    return F.lower(F.regexp_replace(F.btrim(name, F.lit(BLANKS)), r"[\s.]+$", ""))


def normalised(pairs: DataFrame) -> DataFrame:
    """(ord, ip, name, digits) of the pairs that have both fields."""
    rows = pairs.filter("ip is not null and dns is not null").select("ord", plain_address(F.col("ip")).alias("ip"), plain_name(F.col("dns")).alias("name"))
    return rows.withColumn("digits", F.regexp_replace("name", "[^0-9]", ""))


def _folded(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ip", "name", "digits").agg(F.min("ord").alias("ord"))


def _key(n: str, i: int, start: str, size: str) -> str:
    return f"xxhash64(ip, digits, {n}, {i}, substring(name, {start} + 1, {size}))"


def _around(start: str, size: str) -> str:
    """The text without the part, a mark in its place."""
    return f"concat(substring(name, 1, {start}), char(0), substring(name, {start} + {size} + 1, length(name)))"


def _part(n: str, i: int) -> tuple[str, str]:
    """Start (0-based) and length of part i of a text of n characters; the last parts take what is left over."""
    start, end = (f"CAST(floor({n} * {k} / 3) AS INT)" for k in (i, i + 1))
    return start, f"({end} - {start})"


def _part_keys(around: bool = False) -> Column:
    """Keys of the parts, or structs (key, around). The many expressions are one text, which is quicker to build."""
    n = "length(name)"
    parts = [(i, *_part(n, i)) for i in range(3)]
    return F.expr("array_distinct(array(" + ", ".join(f"named_struct('key', {_key(n, *p)}, 'around', {_around(*p[1:])})" if around else _key(n, *p) for p in parts) + "))")


def _probe_keys(around: bool = False) -> Column:
    """Keys of the parts that a text within DISTANCE edits could have, at the places where they could stand here."""
    m, keys = "length(name)", []
    for change in range(-DISTANCE, DISTANCE + 1):  # the other text is so much shorter
        n = f"(length(name) - {change})"
        for i in range(3):
            start, size = _part(n, i)
            for move in range(max(-i, change - (DISTANCE - i)), min(i, change + (DISTANCE - i)) + 1):
                at = f"({start} + {move})"
                key = _key(n, i, at, size)
                key = f"named_struct('key', {key}, 'around', {_around(at, size)})" if around else key
                keys.append(f"CASE WHEN {n} >= 0 AND {at} >= 0 AND {at} + {size} <= {m} THEN {key} END")
    return F.expr("array_compact(array_distinct(array(" + ", ".join(keys) + ")))")


def part_rows(rows: DataFrame) -> DataFrame:
    """One row per part hash of a text that later texts are to be compared with."""
    return rows.withColumn("key", F.explode(_part_keys())).select("key", *TEXT)


def probe_rows(rows: DataFrame) -> DataFrame:
    """One row per part hash that a text within DISTANCE edits could have been filed under."""
    return rows.withColumn("key", F.explode(_probe_keys())).select("key", *TEXT)


def _shortened(text: Column) -> Column:
    """The text with none, one and two characters deleted."""
    drop = lambda t, k: F.concat(F.substring(t, F.lit(1), k - 1), F.substring(t, k + 1, F.length(t)))
    places = lambda t: F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
    one = lambda t: F.transform(places(t), lambda k: drop(t, k))
    return F.array_distinct(F.concat(F.array(text), one(text), F.flatten(F.transform(one(text), one))))


def _refined(rows: DataFrame, keys: Column, crowded: DataFrame) -> DataFrame:
    """Rows of crowded keys under a key for each shortened form of what stands around the part."""
    rows = rows.select(*TEXT, F.explode(keys).alias("k")).select("k.key", "k.around", *TEXT)
    rows = rows.join(crowded, "key", "left_semi").distinct()
    forms = F.when(F.length("around") <= LONG, _shortened(F.col("around"))).otherwise(F.array(F.lit("\1")))
    # A text just above the limit must still meet one just below it.
    forms = F.when(F.length("around").between(LONG - DISTANCE, LONG), F.array_union(forms, F.array(F.lit("\1")))).otherwise(forms)
    return rows.withColumn("form", F.explode(forms)).select(F.xxhash64("key", "form").alias("key"), *TEXT).distinct()


def _same(a: str, b: str, columns: tuple[str, ...]) -> Column:
    """Equal bucket keys, and the columns they are made of equal too, as two comparisons each: were these plain
    equalities, they would count as join keys, by which the tables are not bucketed, and the history be shuffled."""
    same = F.col(f"{a}.key") == F.col(f"{b}.key")
    for c in columns:
        same = same & (F.col(f"{a}.{c}") <= F.col(f"{b}.{c}")) & (F.col(f"{a}.{c}") >= F.col(f"{b}.{c}"))
    return same


def _near(a: str, b: str) -> Column:
    return _same(a, b, ("ip", "digits")) & F.levenshtein(F.col(f"{a}.name"), F.col(f"{b}.name"), DISTANCE).between(0, DISTANCE)


def _crowded(probes: DataFrame, texts: int) -> DataFrame | None:
    """(key) that more than CROWD texts of a batch ask for, at most texts * 30 / CROWD of them; None where there is none."""
    if texts <= CROWD:
        return None
    keys = cut(probes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key"))
    return None if keys.isEmpty() else keys


def _meet(parts: DataFrame, probes: DataFrame, texts: DataFrame, on: Column, how: str, crowded: DataFrame | None) -> DataFrame:
    """Probes (b) joined with parts (a), those of crowded keys by their refined keys."""
    if crowded is None:
        return probes.alias("b").join(parts.alias("a"), on, how)
    plain = probes.join(crowded, "key", "left_anti").alias("b").join(parts.alias("a"), on, how)
    kept = parts.join(crowded, "key", "left_semi").select(*TEXT).distinct()
    fine = _refined(texts, _probe_keys(around=True), crowded).alias("b").join(_refined(kept, _part_keys(around=True), crowded).alias("a"), on, how)
    return plain.union(fine)


class _Fall:
    """Texts of one address and digits: edges in order of the later text, which falls if an earlier one stands."""

    def __init__(self):
        self.fallen: set[int] = set()

    def step(self, row: dict) -> list:
        if row["dst"] in self.fallen or row["src"] in self.fallen:
            return []
        self.fallen.add(row["dst"])
        return [(row["dst"],)]

    def end(self) -> list:
        return []


def _decided(fresh: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Of texts that resemble nothing accepted, the order numbers of those that resemble an earlier accepted one."""
    on = _near("a", "b") & (F.col("a.ord") < F.col("b.ord"))
    edges = _meet(part_rows(fresh), probe_rows(fresh), fresh, on, "inner", crowded)
    edges = edges.select(F.col("b.ip").alias("ip"), F.col("b.digits").alias("digits"), F.col("a.ord").alias("src"), F.col("b.ord").alias("dst"))
    return run_ordered(edges, ["ip", "digits"], ["dst", "src"], _Fall, "ord bigint", pa.schema([("ord", pa.int64())]))


class AcceptedPairs:
    """Everything accepted so far, as a bucketed table of hashes under one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 0, compact_every: int = COMPACT_EVERY):
        self.spark, self.compact_every = spark, compact_every
        self.folder = folder or f"{shared_folder(spark)}/accepted-{uuid.uuid4().hex[:12]}"
        said = read_note(spark, self._note)
        # Fewer buckets than shuffle partitions would make Spark prefer to shuffle the table after all.
        now = json.loads(said) if said else {"buckets": max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "generation": 0, "appends": 0}
        self.buckets, self.generation, self.appends = now["buckets"], now["generation"], now["appends"]
        self._create(self.generation)
        if not said:
            self._write_note()

    @property
    def _note(self) -> str:
        return f"{self.folder}/index.json"

    def _write_note(self) -> None:
        write_note(self.spark, self._note, json.dumps({"buckets": self.buckets, "generation": self.generation, "appends": self.appends}))

    def _name(self, generation: int) -> str:
        return f"accepted_{hashlib.md5(self.folder.encode()).hexdigest()[:12]}_{generation}"

    def _create(self, generation: int) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(generation)} ({SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (kind, key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/keys-{generation}'")

    @property
    def empty(self) -> bool:
        return self.appends == 0

    def table(self, kind: int) -> DataFrame:
        return self.spark.read.table(self._name(self.generation)).filter(F.col("kind") == kind).drop("kind")

    def _store(self, rows: DataFrame, generation: int) -> None:
        rows.repartition(self.buckets, "key").write.insertInto(self._name(generation))

    def append(self, accepted: DataFrame) -> None:
        """Add accepted pairs, columns (ord, ip, name, digits)."""
        parts = F.transform(_part_keys(), lambda k: F.struct(k.alias("key"), F.lit(PART).alias("kind")))
        whole = F.array(F.struct(F.xxhash64("ip", "name").alias("key"), F.lit(WHOLE).alias("kind")))
        rows = accepted.select(F.explode(F.concat(whole, parts)).alias("k"), *TEXT).select("k.key", "k.kind", *TEXT)
        # Counted before the rows are written: a crash in between leaves a number too high, never rows unknown of.
        self.appends += 1
        self._write_note()
        self._store(rows, self.generation)
        if self.appends % self.compact_every == 0:
            self.compact()

    def compact(self) -> None:
        """Merge the files of every bucket into one. The note names the new files only when they are complete."""
        old, new = self.generation, self.generation + 1
        self._drop(new)
        self._create(new)
        # Read by path: of a bucketed table the planner would take the buckets for partitions and then not read it so.
        self._store(self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/keys-{old}"), new)
        self.generation = new
        self._write_note()
        self._drop(old)

    def take(self, batch: DataFrame) -> None:
        """Check a batch of pairs (ip, dns, ord) and accept what is new."""
        rows = _folded(normalised(batch))
        if not self.empty:
            keyed = rows.withColumn("key", F.xxhash64("ip", "name")).alias("n")
            rows = keyed.join(self.table(WHOLE).alias("w"), _same("n", "w", ("ip", "name")) & (F.col("w.ord") < F.col("n.ord")), "left_anti").drop("key")
        rest = cut(rows.select(*TEXT))
        texts = rest.count()
        if not texts:
            return
        probes = probe_rows(rest)
        crowded = _crowded(probes, texts)
        if not self.empty:
            on = _near("a", "b") & (F.col("a.ord") < F.col("b.ord"))
            near = _meet(self.table(PART), probes, rest, on, "left_semi", crowded).select("ord").distinct()
            rest = cut(rest.join(near, "ord", "left_anti").select(*TEXT))
        self.append(rest.join(_decided(rest, crowded), "ord", "left_anti"))

    def accept_all(self, history: DataFrame) -> None:
        """Accept pairs unseen, the history a run starts with."""
        self.append(_folded(normalised(history)))

    def _drop(self, generation: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(generation)}")
        remove(self.spark, f"{self.folder}/keys-{generation}")

    def drop(self) -> None:
        """Remove the table and its files."""
        self._drop(self.generation)
        remove(self.spark, self.folder)


def near_known(pairs: DataFrame) -> DataFrame:
    """(ord) of every pair of a later batch that is the same or nearly the same as an accepted earlier one.

    Batch 0 is accepted as it is. Batches are taken one after another as they would arrive; the list of batch
    numbers is all that reaches the driver.
    """
    index = AcceptedPairs(pairs.sparkSession)
    try:
        index.accept_all(pairs.filter("batch_no = 0"))
        for (batch,) in pairs.filter("batch_no > 0").select("batch_no").distinct().orderBy("batch_no").collect():
            index.take(pairs.filter(F.col("batch_no") == batch))
        later = pairs.filter("batch_no > 0 and ip is not null and dns is not null").select("ord")
        return cut(later.join(index.table(WHOLE).select("ord"), "ord", "left_anti"))
    finally:
        index.drop()
