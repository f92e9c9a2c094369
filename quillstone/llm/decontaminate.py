"""Benchmark passages in documents: a size-partitioned MinHash containment search with exact verification.

Test items are short and documents long, so signatures of whole documents would say nothing. Instead each item keeps
its bottom-k MinHash sketch: the k smallest hashes among its n shingles, with k = n - ceil(t n) + 1. A document that
holds a share t of the item's shingles lacks at most n - ceil(t n) of them, so it holds one of those k: no item is
missed. Items are partitioned by size, a partition sharing the largest k of its items, and indexed in blocks of
bounded size. Every document is streamed against a block; items that it touches are verified on all their shingles,
by 128 bits of each under keys that no document's writer knows. Items of fewer words than a shingle form size
partitions of their own, whose shingles are as long as the item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import SHINGLE_WORDS, Words, distinct_wide, fresh_key, mix, pieces, second_key

#: Shingles of the items that are sent to the executors at once: 32 MB as hashes. More items mean more blocks.
BLOCK_SHINGLES = 2_000_000
_SLOTS = 1 << 22


def _item_sets(width: int, key: int):
    """The shingles of each item, by both keys, at its own width: `width`, or its number of words if less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch.column("text"), key)
            other = words.rehashed(second_key(key))
            for k in range(1, width + 1):
                some = np.flatnonzero(np.minimum(words.counts, width) == k)
                if not len(some):
                    continue
                first, second, offsets = distinct_wide(words.shingles(k)[0], *other.shingles(k))
                sets = [(first[offsets[r] : offsets[r + 1]].tobytes(), second[offsets[r] : offsets[r + 1]].tobytes()) for r in some]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(some)), pa.array(np.full(len(some), k, np.int32)), *(pa.array(x, pa.binary()) for x in zip(*sets))], names=["item_id", "width", "first", "second"])

    return run


class Block:
    """Some items of one width: their full sets, and the sorted index of the sketches, size partition by size partition."""

    def __init__(self, ids: list[int | None], sets: list[tuple[np.ndarray, np.ndarray]], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        sizes = np.array([len(s) for s, _ in sets])
        classes = np.floor(np.log2(sizes)).astype(int)
        # ceil(t n) in whole numbers; k is shared by a partition, which can only find more.
        needed = sizes - -(-sizes * percent // 100) + 1
        keys, owners = [], []
        for c in np.unique(classes):
            k = needed[classes == c].max()
            for i in np.flatnonzero(classes == c):
                order = np.argsort(mix(sets[i][0] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))[:k]
                keys.append(sets[i][0][order])
                owners.append(np.full(len(order), i))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.slots = np.zeros(_SLOTS, dtype=bool)
        self.slots[self.keys & np.uint64(_SLOTS - 1)] = True

    def touched(self, values: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) wherever a row holds a hash of an item's sketch. Rows may repeat values."""
        hits = np.flatnonzero(self.slots[values & np.uint64(_SLOTS - 1)])
        left = np.searchsorted(self.keys, values[hits], side="left")
        right = np.searchsorted(self.keys, values[hits], side="right")
        found = right > left
        hits, left, right = hits[found], left[found], right[found]
        rows = np.searchsorted(offsets, hits, side="right") - 1
        return sorted({(r, int(o)) for r, a, b in zip(rows.tolist(), left.tolist(), right.tolist()) for o in self.owners[a:b]})

    def search(self, column: pa.Array, words: Words, key: int, width: int) -> Iterator[tuple[int, int, int]]:
        """(row, item, common shingles) of every item that a row of the column, given as words too, holds to the wanted share."""
        pairs = self.touched(*words.shingles(width))
        if not pairs:
            return
        rows = sorted({r for r, _ in pairs})
        place = {r: k for k, r in enumerate(rows)}
        words = Words(column.take(pa.array(rows)), key)
        first, second, offsets = distinct_wide(words.shingles(width)[0], *words.rehashed(second_key(key)).shingles(width))
        for r, i in pairs:
            a, b = offsets[place[r] : place[r] + 2]
            x, y = first[a:b], second[a:b]
            left, right = (np.searchsorted(x, self.sets[i][0], side=s) for s in ("left", "right"))
            at = np.minimum(left, len(x) - 1)
            same = (right > left) & (y[at] == self.sets[i][1])
            for k in np.flatnonzero(right > left + 1):  # one 64-bit hash for two shingles
                same[k] = self.sets[i][1][k] in y[left[k] : right[k]]
            common = int(same.sum())
            if 100 * common >= self.percent * len(self.sets[i][0]):
                yield r, i, common


def _searched(shared, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = shared.value
        for batch in pieces(batches):
            words = Words(batch.column("text"), key)
            ids = batch.column("doc_id")
            for width, block in blocks.items():
                found = list(block.search(batch.column("text"), words, key, width))
                if found:
                    rows, items, common = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows)), pa.array([block.ids[i] for i in items], pa.int64()), pa.array([len(block.sets[i][0]) for i in items], pa.int64()), pa.array(common, pa.int64())],
                        names=["doc_id", "item_id", "n_item", "n_common"],
                    )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, width: int = SHINGLE_WORDS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_item, n_common) wherever a document holds at least percent of an item's distinct shingles.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. n_item counts the item's
    shingles, n_common those in the document. An item of fewer than `width` words is one shingle of all its words, and
    is found wherever these follow each other in a document; leave out of the benchmark what is too short to tell
    anything. Null texts and texts without words hold nothing and are found nowhere. Repeated documents or items give
    a row each. Null ids are carried along. An empty side gives an empty result. Texts are read whole, of any length.

    Items are streamed to the driver and sent on in blocks of `block_shingles` shingles at most (or one item), so
    memory is bounded for a benchmark of any size; each block is one scan of the documents, which are never shuffled.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_item long, n_common long"
    key = fresh_key()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_item_sets(width, key), "item_id long, width int, first binary, second binary")
    results: list[DataFrame] = []
    held: dict[int, tuple[list, list]] = {}
    size = 0

    def search() -> DataFrame:
        return source.mapInArrow(_searched(spark.sparkContext.broadcast({k: Block(*x, percent) for k, x in held.items()}), key), schema)

    for row in items.toLocalIterator():
        pair = tuple(np.frombuffer(row[c], np.uint64) for c in ("first", "second"))
        if held and size + len(pair[0]) > block_shingles:
            results.append(search())
            held, size = {}, 0
        ids, sets = held.setdefault(row["width"], ([], []))
        ids.append(row["item_id"])
        sets.append(pair)
        size += len(pair[0])
    if held:
        results.append(search())
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], schema)
