"""Distinct counts over huge identifier sets by exact compressed bitmaps. The error bound is zero.

Identifiers are numbered densely and cut in 64-bit words; a set is the list of its non-empty words, so a small set
costs a few words and a large one a bit per member. Sets are united by OR and intersected by AND of words with
equal number, and counted by adding up bits. Words of one day or net are partial results: ``merged`` unites any
number of them, in any order, with map-side combine, and further days are added by extending the dictionary.

``BitmapStore`` counts identifiers for every combination of dimensions. The dictionary is global and in buckets: a
hash of the identifier gives the bucket, and inside a bucket identifiers are numbered from 0 on. ``add`` reads its
rows twice, once for the groups and identifiers that are new and once to build the bitmaps of the finest groups,
which are stored bucket by bucket, those of further days beside those of earlier ones. ``cube`` reads only stored
bitmaps: in each bucket they are united step by step along the lattice of combinations (each from its smallest
finer one) and counted, and since buckets share no identifier their counts add up. An identifier with more than
``hot_rows`` rows would burden its bucket: such identifiers, of which there are at most rows / ``hot_rows``, get
words of their own, built with map-side combine and spread over all tasks by their groups; their words, not counts,
are then united across tasks, so that nothing is counted twice.

Edge cases: a null identifier is not counted, its groups appear with 0; a null dimension value is a group of its
own, told from "all" by ``grouping``, in which a bit is set for each dimension that was rolled up; repeated rows
change nothing, which is why duplicates need no removal; empty tables give an empty result, without a grand total;
further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapline.functions.numbers import floor_div
from tapline.session import cut, partition_labels, remove, remove_at_exit, shared_folder, task_count

WORD_BITS = 64
BUCKETS = 256
TASK_ROWS = 200_000
HOT_ROWS = 100_000
BROADCAST_ROWS = 100_000


def dictionary(ids: DataFrame, known: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(id, code): dense numbers for the distinct ids; with ``known``, its numbers stay and new ids follow on.

    Numbers are dense over buckets of ids, whose sizes (``buckets`` of them) are all that is added up in one place.
    """
    new = ids.toDF("id").filter("id is not null").distinct()
    start = 0
    if known is not None:
        new = new.join(known.select("id"), "id", "left_anti")
        top = known.agg(F.max("code")).first()[0]
        start = 0 if top is None else top + 1
    new = cut(new.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))))
    sizes = new.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over `buckets` rows
    offset = sizes.select("bucket", (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.lit(start)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    coded = new.withColumn("place", place).join(F.broadcast(offset), "bucket").select("id", (F.col("place") + F.col("offset")).alias("code"))
    return coded if known is None else known.unionByName(coded)


def words(rows: DataFrame, by: list[str], ident: str, codes: DataFrame) -> DataFrame:
    """Partial bitmaps: (by..., word, bits) for each group of ``rows``."""
    slim = rows.select(*by, F.col(ident).alias("id")).filter("id is not null").distinct()
    coded = slim.join(codes, "id")
    bit = F.expr(f"shiftleft(1L, cast(code % {WORD_BITS} as int))")
    return coded.withColumn("word", floor_div(F.col("code"), WORD_BITS)).groupBy(*by, "word").agg(F.bit_or(bit).alias("bits"))


def merged(partials: DataFrame, by: list[str]) -> DataFrame:
    """Union of partial bitmaps, coarser or equal groups: (by..., word, bits)."""
    return partials.groupBy(*by, "word").agg(F.bit_or("bits").alias("bits"))


def common(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Intersection of two lists of bitmaps: (by..., word, bits)."""
    both = a.withColumnRenamed("bits", "x").join(b.withColumnRenamed("bits", "y"), [*by, "word"])
    return both.select(*by, "word", F.col("x").bitwiseAND(F.col("y")).alias("bits")).filter("bits <> 0")


def counted(bitmaps: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Members of each bitmap: (by..., n)."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bit_count("bits").cast("bigint")).alias(name))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most BROADCAST_ROWS rows, else left to a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


Codes = list[np.ndarray]  # the most significant first


def _packs(radix: list[int]) -> list[list[int]]:
    """Places of a mixed-radix number, first to last, grouped so that each group fits in one 64-bit number."""
    packs, size = [[]], 1
    for k, r in enumerate(radix):
        if packs[-1] and size * r >= 2**62:
            packs.append([])
            size = 1
        packs[-1].append(k)
        size *= r
    return packs


def _unite(codes: Codes, bits: np.ndarray) -> tuple[Codes, np.ndarray]:
    """Equal codes folded into one, their bits united; sorted by code."""
    if not len(bits):
        return codes, bits
    order = np.argsort(codes[0]) if len(codes) == 1 else np.lexsort(codes[::-1])
    codes, bits = [c[order] for c in codes], bits[order]
    change = np.zeros(len(bits), dtype=bool)
    change[0] = True
    for c in codes:
        change[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(change)
    return [c[first] for c in codes], np.bitwise_or.reduceat(bits, first)


def _lattice(digits: list[np.ndarray], sizes: list[int], word: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(grouping, digits of each group, word, bits) of every combination of dimensions, finest first.

    Groups and words are one mixed-radix number (in several pieces if it is too long); a dimension is rolled up by
    clearing its digit.
    """
    radix = [*sizes, int(word.max()) + 1 if len(word) else 1]
    columns, place = [*digits, word], {}
    codes: Codes = []
    for at, pack in enumerate(_packs(radix)):
        stride, code = 1, np.zeros(len(word), dtype=np.int64)
        for k in reversed(pack):
            place[k] = (at, stride)
            code = code + columns[k].astype(np.int64) * stride
            stride *= radix[k]
        codes.append(code)
    digit = lambda codes, k: codes[place[k][0]] // place[k][1] % radix[k]
    done = {0: _unite(codes, bits)}
    for grouping in sorted(range(1 << len(sizes)), key=lambda g: g.bit_count()):
        if grouping:
            source = min((grouping & ~(1 << k) for k in range(len(sizes)) if grouping >> k & 1), key=lambda g: len(done[g][1]))
            k = (grouping & ~source).bit_length() - 1
            c, b = done[source]
            at, stride = place[k]
            done[grouping] = _unite([x - digit(c, k) * stride if n == at else x for n, x in enumerate(c)], b)
        c, b = done[grouping]
        yield grouping, [digit(c, k) for k in range(len(sizes))], digit(c, len(sizes)), b
        for g in [g for g in done if g.bit_count() < grouping.bit_count() - 1]:
            del done[g]


def _build_task(fields: list[tuple[int, int, int]], packs: int, kinds: int) -> callable:
    """Bitmaps of the finest groups over the rows of one bucket, which are numbered by the bucket's dictionary.

    ``fields`` gives the packed number, place and bits of each dimension.
    """
    schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *((f"d{k}", pa.int64()) for k in range(len(fields))), ("word", pa.int64()), ("bits", pa.int64())])

    def run(rows: pa.Table, codes: pa.Table) -> pa.Table:
        out = []
        for kind in range(kinds):
            mine, known = rows.filter(pc.equal(rows["kind"], kind)), codes.filter(pc.equal(codes["kind"], kind))
            if not mine.num_rows:
                continue
            at = pc.index_in(mine["id"].combine_chunks(), value_set=known["id"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
            place = known["place"].to_numpy()[at]
            mask = np.left_shift(np.uint64(1), (place % WORD_BITS).astype(np.uint64))
            keys, bits = _unite([*(mine[f"p{w}"].to_numpy() for w in range(packs)), place // WORD_BITS], mask)
            dims = [keys[w] >> shift & (1 << n) - 1 for w, shift, n in fields]
            out.append(pa.table([np.full(len(bits), mine["bucket"][0].as_py()), np.full(len(bits), kind, dtype=np.int32), *dims, keys[-1], bits.view(np.int64)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _count_task(fields: list[tuple[int, int, int]], packs: int, kinds: int, hot: bool) -> callable:
    """Counts per kind (or, for hot identifiers, words) of every combination over the bitmaps of one task."""
    counts = ["bits"] if hot else [f"n{k}" for k in range(kinds)]
    schema = pa.schema([("grouping", pa.int32()), *((f"p{w}", pa.int64()) for w in range(packs)), ("word", pa.int64()), *((c, pa.int64()) for c in counts)])

    def run(table: pa.Table) -> pa.Table:
        packed = [table[f"p{w}"].to_numpy() for w in range(packs)]
        factors = [np.unique(packed[w] >> shift & (1 << n) - 1, return_inverse=True) for w, shift, n in fields]
        values, digits = [v for v, _ in factors], [d for _, d in factors]
        word = table["word"].to_numpy() * kinds + table["kind"].to_numpy()
        out = []
        for grouping, group, w, b in _lattice(digits, [max(1, len(v)) for v in values], word, table["bits"].to_numpy().view(np.uint64)):
            if hot:
                columns, x = [w, b.view(np.int64)], group
            else:  # words of a group are neighbours
                change = np.zeros(len(b), dtype=bool)
                change[:1] = True
                for g in group:
                    change[1:] |= g[1:] != g[:-1]
                first = np.flatnonzero(change)
                members = np.bitwise_count(b).astype(np.int64)
                sums = [np.add.reduceat(np.where(w % kinds == k, members, 0), first) if len(first) else np.zeros(0, np.int64) for k in range(kinds)]
                columns, x = [np.zeros(len(first), dtype=np.int64), *sums], [g[first] for g in group]
            keys = [np.zeros(len(columns[0]), dtype=np.int64) for _ in range(packs)]
            for k, (at, shift, _) in enumerate(fields):
                if not grouping >> k & 1:
                    keys[at] |= values[k][x[k]] << shift
            out.append(pa.table([np.full(len(columns[0]), grouping, dtype=np.int32), *keys, *columns], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


class _Packing:
    """Dimension codes, given as columns d0, d1, ..., in as few 62-bit numbers p0, p1, ... as their sizes allow."""

    def __init__(self, values: list[int]):
        bits = [int(v).bit_length() for v in values]
        self.packs: list[list[int]] = [[]]
        for k, b in enumerate(bits):
            if self.packs[-1] and sum(bits[i] for i in self.packs[-1]) + b > 62:
                self.packs.append([])
            self.packs[-1].append(k)
        self.names = [f"p{w}" for w in range(len(self.packs))]
        self.fields = [(w, sum(bits[i] for i in self.packs[w] if i < k), bits[k]) for k in range(len(bits)) for w in [next(w for w, g in enumerate(self.packs) if k in g)]]

    def packed(self) -> list[Column]:
        place = lambda k: F.col(f"d{k}") * F.lit(1 << self.fields[k][1])
        return [sum((place(k) for k in g), F.lit(0).cast("bigint")).alias(p) for p, g in zip(self.names, self.packs, strict=True)]

    def kept(self, w: int) -> Column:
        """Mask of the bits of pack ``w`` that ``grouping`` does not roll up."""
        mask = lambda k: F.lit(((1 << self.fields[k][2]) - 1) << self.fields[k][1])
        return sum((F.when(F.expr(f"(grouping >> {k}) & 1 = 0"), mask(k)).otherwise(F.lit(0)) for k in self.packs[w]), F.lit(0).cast("bigint"))

    def digit(self, k: int) -> Column:
        w, shift, bits = self.fields[k]
        return F.shiftright(F.col(f"p{w}"), shift).bitwiseAND(F.lit((1 << bits) - 1))


class BitmapStore:
    """Stored bitmaps of the finest groups of ``dims`` for each kind of identifier, to which rows can be added.

    Dimension values are coded from 1 on, null as 0; whole numbers by their distance from the smallest of the first
    rows (zigzag, as later ones may be smaller), others by a dictionary that grows.
    """

    def __init__(self, spark: SparkSession, dims: dict[str, Column], idents: dict[str, Column], task_rows: int = TASK_ROWS, hot_rows: int = HOT_ROWS):
        self.spark, self.dims, self.idents, self.task_rows, self.hot_rows = spark, dims, idents, task_rows, hot_rows
        self.name = f"bitmaps_{uuid.uuid4().hex[:12]}"
        self.folder = f"{shared_folder(spark)}/{self.name}"
        self.tables: dict[str, int] = {}  # rows in files of each
        self.values: dict[str, int] = {}  # greatest code of each dimension
        self.low: dict[str, int] = {}
        self.types: dict[str, str] = {}
        self.codes: dict[str, DataFrame] = {}
        self.hot: DataFrame | None = None
        self.buckets = 0
        self.labels: list[int] = []  # of the buckets, chosen so that each is a task of its own
        self.added = 0
        remove_at_exit(spark, self.folder)

    def drop(self) -> None:
        """Remove the tables and their files; results that were not read yet cannot be read any more."""
        for what in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{what}")
        remove(self.spark, self.folder)

    def _store(self, rows: DataFrame, what: str) -> None:
        """Append rows to a table bucketed by ``bucket``; they come partitioned so, a file a bucket."""
        rows.write.format("parquet").bucketBy(self.buckets, "bucket").option("path", f"{self.folder}/{what}").mode("append").saveAsTable(f"{self.name}_{what}")
        self.tables[what] = 1

    def _bucket(self, *columns: str) -> Column:
        return F.element_at(F.lit(self.labels), (F.pmod(F.xxhash64(*columns), F.lit(self.buckets)) + 1).cast("int")).cast("bigint")

    def _stored(self, what: str) -> DataFrame:
        return self.spark.read.table(f"{self.name}_{what}")

    def _written(self, rows: DataFrame, what: str) -> DataFrame:
        path = f"{self.folder}/{what}-{self.added}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _code_dimensions(self, groups: DataFrame) -> None:
        numeric = [n for n in self.dims if self.types[n] in ("int", "bigint", "smallint", "tinyint")]
        limits = groups.agg(F.count(F.lit(1)), *[f(F.col(n)) for n in numeric for f in (F.min, F.max)]).first()[1:]
        for k, name in enumerate(numeric):
            low, high = (int(x or 0) for x in limits[2 * k : 2 * k + 2])
            start = self.low.setdefault(name, low)
            self.values[name] = max(self.values.get(name, 1), 2 * (high - start) + 1, 2 * (start - low))
        for name in self.dims:
            if name not in numeric:
                known = self.codes.get(name)
                coded = dictionary(groups.select(name), None if known is None else known.select(F.col("value").alias("id"), (F.col("code") - 1).alias("code")))
                self.codes[name] = cut(coded.select(F.col("id").alias("value"), (F.col("code") + 1).alias("code")))
                self.values[name] = self.codes[name].count()

    def _coded(self, rows: DataFrame) -> DataFrame:
        """Adds d0, d1, ... to rows with the dimensions."""
        for k, name in enumerate(self.dims):
            if name in self.low:
                away = F.col(name).cast("bigint") - F.lit(self.low[name])
                rows = rows.withColumn(f"d{k}", F.coalesce(F.when(away >= 0, 2 * away + 1).otherwise(-2 * away), F.lit(0)))
            else:
                codes = self.codes[name].select(F.col("value").alias(name), F.col("code").alias(f"d{k}"))
                rows = rows.join(_small(codes, self.values[name]), name, "left").withColumn(f"d{k}", F.coalesce(f"d{k}", F.lit(0)))
        return rows

    def _number(self, ids: DataFrame) -> None:
        """Give new identifiers (kind, id) the next places of their buckets and store them."""
        ids = ids.withColumn("bucket", self._bucket("kind", "id"))
        if "ids" in self.tables:
            known = self._stored("ids")
            top = known.groupBy("bucket", "kind").agg(F.max("place").alias("top"))
            ids = ids.join(known.select("kind", "id"), ["kind", "id"], "left_anti").join(top, ["bucket", "kind"], "left")
        else:
            ids = ids.withColumn("top", F.lit(None).cast("bigint"))
        place = F.row_number().over(Window.partitionBy("bucket", "kind").orderBy("id")) + F.coalesce("top", F.lit(-1).cast("bigint"))
        ids = ids.repartition(self.buckets, "bucket").withColumn("place", place)
        self._store(ids.select("bucket", "kind", "id", "place"), "ids")

    def add(self, rows: DataFrame) -> None:
        """Build and store the bitmaps of further rows, e.g. of one day."""
        self.added += 1
        names, kinds = list(self.dims), list(self.idents)
        base = rows.select(*[c.alias(k) for k, c in self.dims.items()], *[c.cast("string").alias(f"_{k}") for k, c in self.idents.items()])
        self.types = self.types or dict(base.dtypes)
        own = [[f"_{k}"] for k in kinds]
        bare = F.min(F.coalesce(*[F.col(f"_{k}") for k in kinds]).isNull())
        seen = base.groupingSets([names, *own], *names, *[f"_{k}" for k in kinds]).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("rows"), bare.alias("bare"))
        seen = self._written(seen, "seen")
        bits = len(names) + len(kinds)
        level = lambda kept: sum(1 << (bits - 1 - k) for k in range(bits) if k not in kept)
        groups = seen.filter(F.col("level") == level(range(len(names)))).select(*names, "rows", "bare")
        total = groups.agg(F.sum("rows")).first()[0] or 0
        self.buckets = self.buckets or task_count(rows, total, self.task_rows)
        self.labels = self.labels or partition_labels(self.buckets)
        self._code_dimensions(groups)
        ids = None
        for k, kind in enumerate(kinds):
            mine = seen.filter((F.col("level") == level([len(names) + k])) & F.col(f"_{kind}").isNotNull()).select(F.lit(k).alias("kind"), F.col(f"_{kind}").alias("id"), "rows")
            ids = mine if ids is None else ids.unionByName(mine)
        often = ids.filter(F.col("rows") > self.hot_rows).select("kind", "id")
        if self.hot is not None:
            often = often.unionByName(self.hot.select("kind", "id")).distinct()
        fresh = often if self.hot is None else often.join(self.hot, ["kind", "id"], "left_anti")
        fresh = cut(fresh)
        if fresh.count():
            # Their number is bounded by rows / hot_rows.
            first = 0 if self.hot is None else self.hot.agg(F.max("place")).first()[0] + 1
            fresh = fresh.withColumn("place", (F.row_number().over(Window.orderBy("kind", "id")) - 1 + first).cast("bigint"))
            if "ids" in self.tables:
                self._promote(fresh)
            self.hot = cut(fresh if self.hot is None else self.hot.unionByName(fresh))
        if self.hot is not None:
            ids = ids.join(_small(self.hot, self.hot.count()), ["kind", "id"], "left_anti")
        self._number(ids.select("kind", "id"))

        packing = _Packing([self.values[n] for n in names])
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{kind}").alias("id")) for k, kind in enumerate(kinds)])).alias("x")
        tall = self._coded(base).select(*packing.packed(), each).select(*packing.names, "x.kind", "x.id").filter("id is not null")
        if self.hot is not None:
            hot = _small(self.hot, self.hot.count())
            tall = tall.join(hot, ["kind", "id"], "left_anti")
            # Hot rows are picked out before their dimensions are coded, so the other rows cost little here.
            found = self._coded(base.select(*names, each).select(*names, "x.kind", "x.id").join(hot, ["kind", "id"]))
            word = floor_div(F.col("place"), WORD_BITS).alias("word")
            bit = F.expr(f"shiftleft(1L, cast(place % {WORD_BITS} as int))")
            found = found.select(*[f"d{k}" for k in range(len(names))], "kind", word, bit.alias("bit"))
            found = found.groupBy(*[f"d{k}" for k in range(len(names))], "kind", "word").agg(F.bit_or("bit").alias("bits"))
            self._store(found.withColumn("bucket", F.lit(0).cast("bigint")).select("bucket", "kind", *[f"d{k}" for k in range(len(names))], "word", "bits"), "hot")
        tall = tall.withColumn("bucket", self._bucket("kind", "id")).repartition(self.buckets, "bucket")
        shape = "bucket bigint, kind int, " + ", ".join(f"d{k} bigint" for k in range(len(names))) + ", word bigint, bits bigint"
        built = tall.groupBy("bucket").cogroup(self._stored("ids").groupBy("bucket")).applyInArrow(_build_task(packing.fields, len(packing.packs), len(kinds)), shape)
        self._store(built, "words")
        blank = self._coded(groups.filter("bare")).select(F.lit(0).cast("bigint").alias("bucket"), *[f"d{k}" for k in range(len(names))])
        self._store(blank, "blank")

    def _promote(self, fresh: DataFrame) -> None:
        """Identifiers that became hot after earlier adds: their old bits go over to the words of hot ones."""
        dims = [f"d{k}" for k in range(len(self.dims))]
        old = self._stored("ids").join(_small(fresh.withColumnRenamed("place", "to"), fresh.count()), ["kind", "id"]).select("bucket", "kind", "place", "to")
        old = old.withColumns({"word": floor_div(F.col("place"), WORD_BITS), "bit": F.expr(f"shiftleft(1L, cast(place % {WORD_BITS} as int))")})
        bits = self._stored("words").join(_small(old, fresh.count()), ["bucket", "kind", "word"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        moved = bits.select(F.lit(0).cast("bigint").alias("bucket"), "kind", *dims, floor_div(F.col("to"), WORD_BITS).alias("word"), F.expr(f"shiftleft(1L, cast(to % {WORD_BITS} as int))").alias("bits"))
        self._store(self._written(moved, "moved"), "hot")
        away = cut(old.groupBy("bucket", "kind", "word").agg(F.bit_or("bit").alias("gone")))
        cleared = self._stored("words").join(_small(away, fresh.count()), ["bucket", "kind", "word"], "left")
        cleared = cleared.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0).cast("bigint"))))).filter("bits <> 0").drop("gone").select(*self._stored("words").columns)
        cleared = self._written(cleared, "cleared")
        self.spark.sql(f"DROP TABLE {self.name}_words")
        remove(self.spark, f"{self.folder}/words")
        self._store(cleared.repartition(self.buckets, "bucket"), "words")

    def cube(self) -> DataFrame:
        """(dims..., grouping, one count per identifier) of every combination of dimension values, from stored bitmaps."""
        names, kinds = list(self.dims), list(self.idents)
        packing = _Packing([self.values[n] for n in names])
        shape = "grouping int, " + ", ".join(f"{p} bigint" for p in packing.names) + ", word bigint, "
        key, n = ["grouping", *packing.names], len(kinds)
        words = self._stored("words").select("bucket", *packing.packed(), "kind", "word", "bits")
        parts = words.groupBy("bucket").applyInArrow(_count_task(packing.fields, len(packing.packs), n, False), shape + ", ".join(f"n{k} bigint" for k in range(n))).drop("word")
        if "hot" in self.tables:
            hot = self._stored("hot").select(*packing.packed(), "kind", "word", "bits").withColumn("task", self._bucket(*packing.names))
            united = hot.groupBy("task").applyInArrow(_count_task(packing.fields, len(packing.packs), n, True), shape + "bits bigint").groupBy(*key, "word").agg(F.bit_or("bits").alias("bits"))
            members = F.bit_count("bits").cast("bigint")
            parts = parts.unionByName(united.select(*key, *[F.when(F.col("word") % n == k, members).otherwise(F.lit(0).cast("bigint")).alias(f"n{k}") for k in range(n)]))
        # Groups without any identifier still exist: their rows come in with counts of 0.
        blank = self._stored("blank").select(*packing.packed(), F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("grouping"))
        blank = blank.select("grouping", *[F.col(p).bitwiseAND(packing.kept(w)).alias(p) for w, p in enumerate(packing.names)])
        parts = parts.unionByName(blank.select(*key, *[F.lit(0).cast("bigint").alias(f"n{k}") for k in range(n)]))
        result = parts.groupBy(*key).agg(*[F.sum(f"n{k}").alias(kind) for k, kind in enumerate(kinds)])
        for k, name in enumerate(names):
            code = packing.digit(k)
            if name in self.codes:
                back = self.codes[name].select(F.col("value").alias(name), F.col("code").alias(f"d{k}"))
                result = result.withColumn(f"d{k}", code).join(_small(back, self.values[name]), f"d{k}", "left")
            else:
                away = F.when(code % 2 == 1, floor_div(code, 2)).otherwise(-floor_div(code, 2))
                result = result.withColumn(name, F.when(code > 0, away + F.lit(self.low[name])).cast(self.types[name]))
        return result.select(*names, "grouping", *kinds)


def cube_counts(rows: DataFrame, dims: dict[str, Column], idents: dict[str, Column], task_rows: int = TASK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(dims..., grouping, one count per identifier column) for every combination of dimension values."""
    store = BitmapStore(rows.sparkSession, dims, idents, task_rows, hot_rows)
    store.add(rows)
    return store.cube()
