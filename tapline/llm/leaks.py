"""Evaluation texts leaking into training text: documents that share a run of at least ``RUN`` words with an item.

Every item is cut into windows of RUN words, and every window into shingles of GRAM words. A document holds a
window only if it holds all its shingles, so one of them, the rarest over all documents, is the only prefix that
has to be joined (prefix filter for containment 1). The place of the shingle inside the window bounds where the
window would have to start and end in the document, and what remains is verified word by word over the window.

The documents are read once per block of items and never shuffled: a task keeps only the places where a shingle
of the item vocabulary occurs, with the few words around them. Items are the stated query set. They are cut in
pieces that overlap by RUN - 1 words, so that every window lies in one, and pieces are taken in blocks of at most
``block_words`` words by their running sum, so what is sent to the tasks has a fixed bound however long an item is.
A shingle that very many places hold, as where an item quotes boilerplate, is split into one part for every
``salt_rows`` of its places; the windows that look for it go to all parts.

Edge cases: null and empty texts hold nothing; items shorter than RUN words leak nowhere; a text of any length is
used whole; repeated documents and items each give their rows; an empty table on either side gives an empty result;
only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapline.functions.numbers import floor_div
from tapline.session import cut, spread

RUN, GRAM = 13, 5
BLOCK_WORDS = 2_000_000
SALT_ROWS = 20_000
KNOWN_HOT = 100_000  # shingles in several parts up to which their list is broadcast
WORD = re.compile(r"[^\W_]+")
OCCURS = "doc_id bigint, pos int, n_words int, lead int, shingle string, around array<string>"
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


def _hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    out = np.zeros(len(ids) - gram + 1, dtype=np.uint64)
    for k in range(gram):
        out = out * BASE + ids[k : len(ids) - gram + 1 + k]
    return out


def _finder(vocabulary: dict[str, int], wanted: np.ndarray, run: int, gram: int) -> callable:
    side = run - gram

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("n_words", pa.int32()), ("lead", pa.int32()), ("shingle", pa.string()), ("around", pa.list_(pa.string()))])
        get = vocabulary.get
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                n = len(words)
                if n < run:
                    continue
                ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=n)
                known = np.concatenate([[0], np.cumsum(ids > 0)])
                full = known[gram:] - known[:-gram] == gram
                if not full.any():
                    continue
                at = np.flatnonzero(full)
                h = _hashes(ids, gram)[at]
                slot = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                for p in at[wanted[slot] == h].tolist():
                    lead = min(side, p)
                    rows.append((doc, p, n, lead, " ".join(words[p : p + gram]), words[p - lead : p + run]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return find


def _window_rows(run: int, gram: int) -> callable:
    """(item_id, win, place, shingle): every shingle of every window."""
    schema = pa.schema([("item_id", pa.int64()), ("win", pa.int32()), ("place", pa.int32()), ("shingle", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, piece, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "piece", "text")), strict=True):
                words = words_of(text)
                grams = [" ".join(words[i : i + gram]) for i in range(len(words) - gram + 1)]
                out += [(item, piece + w, k, grams[w + k]) for w in range(len(words) - run + 1) for k in range(run - gram + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows


def _window_words(run: int) -> callable:
    schema = pa.schema([("item_id", pa.int64()), ("win", pa.int32()), ("words", pa.list_(pa.string()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, piece, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "piece", "text")), strict=True):
                words = words_of(text)
                out += [(item, piece + w, words[w : w + run]) for w in range(len(words) - run + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows


def _pieces(most: int, run: int) -> callable:
    """(item_id, piece, n_words, text): the items as words, in pieces of at most ``most`` words, numbered by their place."""
    schema = pa.schema([("item_id", pa.int64()), ("piece", pa.int32()), ("n_words", pa.int64()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(0, len(words) - run + 1), most - run + 1):
                    part = words[at : at + most]
                    out.append((item, at, len(part), " ".join(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows


def _blocks(items: DataFrame, block_words: int, run: int) -> Iterator[DataFrame]:
    """The items that can leak, in blocks of at most ``block_words`` words (or four windows, if that is more)."""
    block_words = max(block_words, 4 * run)
    pieces = cut(items.mapInArrow(_pieces(block_words // 2, run), "item_id bigint, piece int, n_words bigint, text string"))
    total = pieces.agg(F.sum("n_words")).first()[0] or 0
    if total <= block_words:
        yield pieces.select("item_id", "piece", "text")
        return
    # Three numbers a piece are sorted in one place. Pieces have at most half a block, so a block that takes all
    # that begin in its half has no more than the whole.
    upto = F.sum("n_words").over(Window.orderBy("item_id", "piece").rowsBetween(Window.unboundedPreceding, 0))
    half = block_words - block_words // 2
    placed = pieces.select("item_id", "piece", "n_words").withColumn("block", floor_div(upto - F.col("n_words"), half))
    placed = cut(pieces.join(placed.drop("n_words"), ["item_id", "piece"]))
    for b in range(-(-total // half)):
        yield placed.filter(F.col("block") == b).select("item_id", "piece", "text")


def _wanted(texts: list[str | None], run: int, gram: int) -> tuple[dict[str, int], np.ndarray]:
    """Numbers for the words of a block of items, and the sorted hashes of its shingles."""
    vocabulary: dict[str, int] = {}
    found = [np.zeros(0, dtype=np.uint64)]
    for text in texts:
        words = words_of(text)
        if len(words) >= run:
            found.append(_hashes(np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), dtype=np.uint64, count=len(words)), gram))
    return vocabulary, np.unique(np.concatenate(found))


def _split(occurs: DataFrame, prefix: DataFrame, rarity: DataFrame, salt_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Places and windows with ``part`` where a shingle has more than ``salt_rows`` places, and what to join them by."""
    often = cut(rarity.filter(F.col("n") > salt_rows).select("shingle", F.ceil(F.col("n") / F.lit(salt_rows)).alias("parts")))
    n = often.count()
    if not n:
        return occurs, prefix, ["shingle"]
    known, parts = F.broadcast(often) if n <= KNOWN_HOT else often, F.coalesce("parts", F.lit(1))
    occurs = occurs.join(known, "shingle", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "pos"), parts)).drop("parts")
    prefix = prefix.join(known, "shingle", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("parts")
    return occurs, prefix, ["shingle", "part"]


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM, block_words: int = BLOCK_WORDS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(doc_id, item_id) of every document and item that share ``run`` consecutive words."""
    gram = min(gram, run)
    spark = documents.sparkSession
    docs = spread(documents.select("doc_id", "text").filter("text is not null"))
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint")
    for block in _blocks(items.select("item_id", "text"), block_words, run):
        vocabulary, wanted = _wanted([r.text for r in block.select("text").collect()], run, gram)
        if not len(wanted):
            continue
        occurs = cut(docs.mapInArrow(_finder(vocabulary, wanted, run, gram), OCCURS))
        windows = block.mapInArrow(_window_rows(run, gram), "item_id bigint, win int, place int, shingle string")
        rarity = occurs.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
        # A window with a shingle that no document holds is in no document; of the others the rarest shingle is the prefix.
        rated = windows.join(rarity, "shingle", "left")
        per = Window.partitionBy("item_id", "win")
        rated = rated.withColumns({"all_held": F.min(F.col("n").isNotNull()).over(per), "rank": F.row_number().over(per.orderBy(F.col("n").asc_nulls_last(), "shingle", "place"))})
        prefix = rated.filter("all_held and rank = 1").select("item_id", "win", "place", "shingle")
        prefix = prefix.join(block.mapInArrow(_window_words(run), "item_id bigint, win int, words array<string>"), ["item_id", "win"])
        places, sought, by = _split(occurs, prefix, rarity, salt_rows)
        found = places.join(sought, by).filter((F.col("pos") >= F.col("place")) & (F.col("pos") - F.col("place") + run <= F.col("n_words")))
        found = found.filter(F.slice("around", F.col("lead") - F.col("place") + 1, F.lit(run)) == F.col("words"))
        out = out.unionByName(found.select("doc_id", "item_id"))
    return out.distinct()
