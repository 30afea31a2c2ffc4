"""Filling containers of a fixed capacity with texts, by sizes in tokens of a public tokenizer.

Only sizes matter, so the instance is its histogram, of at most ``capacity`` counters however many texts there
are. On it the reduction of Martello and Toth (Knapsack Problems, 1990, section 8.6) fixes containers that are
part of some best solution: a size with which nothing else fits stands alone; a size and its largest partner are
fixed if they fill the container exactly or if nothing but one more text fits; three are fixed if every other
choice could be exchanged for them. A fix is applied as often as the counters allow at once. What remains is
packed by best fit, largest sizes first, again on counters: equal sizes go to equal containers together.

The result is a short list of patterns with their numbers of containers, so its size is bounded by the capacity
and not by the data. Texts are numbered within their size (in salted parts whose counts are added up, so that a
size with a third of all texts is numbered by many tasks) and look their container up by that number.

Edge cases: null and empty texts have no tokens and get no container (null); a text above the capacity is cut in
pieces of the full capacity and a rest, all other texts stay whole; ties are numbered by id and piece; repeated
texts are packed each for itself; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapline.session import cut, spread

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's tokenizer splits text.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PARTS = 64
PART_ROWS = 500_000

_encoders: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once per worker; where the path is not mounted, from what the job brought."""
    if path not in _encoders:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every text. The vocabulary, one file of bounded size, is shipped with the job."""
    documents.sparkSession.sparkContext.addFile(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(count, "doc_id bigint, tokens bigint")


class _Sizes:
    """Counters of sizes 1 to capacity with fast neighbours."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 2, dtype=np.int64)
        for size, k in counts.items():
            self.n[size] = k

    def largest(self, limit: int, used: tuple[int, ...] = ()) -> int:
        """The largest size up to ``limit`` of which a text is left besides those in ``used``; 0 if none."""
        for size in np.flatnonzero(self.n[: limit + 1])[::-1] if limit > 0 else ():
            if self.n[size] > used.count(int(size)):
                return int(size)
        return 0

    def smallest(self, above: int, used: tuple[int, ...] = ()) -> int:
        for size in np.flatnonzero(self.n[above + 1 :]) + above + 1:
            if self.n[size] > used.count(int(size)):
                return int(size)
        return 0

    def take(self, pattern: tuple[int, ...]) -> int:
        """Remove as many copies of the pattern as the counters hold."""
        times = min(int(self.n[s]) // pattern.count(s) for s in set(pattern))
        for s in pattern:
            self.n[s] -= times
        return times


def _dominating(sizes: _Sizes, j: int, capacity: int) -> tuple[int, ...] | None:
    """A container with a text of size j that some best solution has, or None if none is proven."""
    room = capacity - j
    first = sizes.smallest(0, (j,))
    if not first or first > room:
        return (j,)
    best = sizes.largest(room, (j,))
    second = sizes.smallest(0, (j, first))
    if best == room or not second or first + second > room:
        return (j, best)  # it fills the container, or nothing but one more text fits
    third = sizes.smallest(0, (j, first, second))
    if third and first + second + third <= room:
        return None  # three more fit: nothing is proven
    partner = sizes.largest(room - best, (j, best))
    # Any pair x >= y that fits has x <= best. If no pair fits both of whose texts exceed partner, x and y can be
    # exchanged for best and partner; a single x for best.
    above = sizes.smallest(partner, (j,))
    again = sizes.smallest(above - 1, (j, above)) if above else 0
    if not above or not again or above + again > room:
        return (j, best, partner) if partner else (j, best)
    return None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Containers fixed by dominance, as (sizes, how many), and the counters that remain."""
    sizes, fixed = _Sizes(counts, capacity), []
    moved = True
    while moved:
        moved = False
        for j in np.flatnonzero(sizes.n)[::-1].tolist():
            while sizes.n[j] and (pattern := _dominating(sizes, j, capacity)):
                fixed.append((pattern, sizes.take(pattern)))
                moved = True
    return fixed, {int(s): int(sizes.n[s]) for s in np.flatnonzero(sizes.n)}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, on counters: containers as (sizes, how many)."""
    open_: dict[int, list[list]] = {capacity: []}  # by room: [sizes, how many]
    rooms = {capacity}
    done: list[tuple[tuple[int, ...], int]] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in rooms if r >= size and open_.get(r)), default=0)
            if not room:
                fits = capacity // size
                new, rest = divmod(left, fits)
                for times, k in ((new, fits), (1, rest)):
                    if times and k:
                        open_.setdefault(capacity - k * size, []).append([(size,) * k, times])
                        rooms.add(capacity - k * size)
                break
            fits = room // size  # equal texts go on filling the container whose room has become the smallest
            sizes, times = open_[room].pop()
            whole = min(times, left // fits)
            if whole:
                open_.setdefault(room - fits * size, []).append([sizes + (size,) * fits, whole])
                rooms.add(room - fits * size)
                left -= whole * fits
                times -= whole
            if times and left:  # fewer than one container's worth are left
                open_.setdefault(room - left * size, []).append([sizes + (size,) * left, 1])
                rooms.add(room - left * size)
                left, times = 0, times - 1
            if times:
                open_[room].append([sizes, times])
    for bins in open_.values():
        done += [(sizes, times) for sizes, times in bins]
    return done


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """All containers as (sizes, how many)."""
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each size, runs of numbers and the containers they go to: size, first number, texts per container, first container."""
    rows, following, container = [], {}, 0
    for sizes, times in patterns:
        for size in sorted(set(sizes)):
            k, at = sizes.count(size), following.get(size, 0)
            rows.append((size, at, k, container))
            following[size] = at + k * times
        container += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece_no, token_start, tokens, container_id) of every piece of every text."""
    counted = cut(token_counts(documents, vocabulary))
    pieces = counted.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("tokens") / F.lit(capacity)), F.lit(1)) - 1)))
    start = F.col("piece_no") * F.lit(capacity)
    pieces = pieces.select("doc_id", "piece_no", start.alias("token_start"), F.least(F.col("tokens") - start, F.lit(capacity)).alias("tokens"))
    counts = {r.tokens: r.n for r in pieces.filter("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    size, first, per, base = _slots(plan(counts, capacity))
    parts = max(PARTS, -(-sum(counts.values()) // PART_ROWS))

    cell = ["tokens", "part"]
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts))).repartition(*cell)
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id", "piece_no")) - 1
    before = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parted.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = parted.withColumn("number", number).join(offset, cell).withColumn("number", F.col("number") + F.col("offset"))
    key = (size << 44) + first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tokens = batch.column("number").to_numpy(), batch.column("tokens").to_numpy()
            if len(key):
                at = np.maximum(np.searchsorted(key, (tokens << 44) + n, side="right") - 1, 0)
                container = base[at] + (n - first[at]) // per[at]
            else:
                container = np.zeros(len(n), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece_no", "token_start", "tokens")), pa.array(container, pa.int64(), mask=tokens <= 0)], names=["doc_id", "piece_no", "token_start", "tokens", "container_id"])

    columns = ["doc_id", "piece_no", "token_start", "tokens", "number"]
    return numbered.select(*[F.col(c).cast("bigint").alias(c) for c in columns]).mapInArrow(place, "doc_id bigint, piece_no bigint, token_start bigint, tokens bigint, container_id bigint")
