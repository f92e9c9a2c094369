"""Near-duplicate documents by circulant MinHash, with every link confirmed on the full shingle sets.

Two bijections of 32-bit integers stand for the two permutations. The first scatters the shingles; coordinate k of the
signature is the least value of the second after its argument is shifted circularly by k. So all coordinates come from
two permutations (Li and Li, "C-MinHash", 2021). Coordinates are cut into bands; documents that share a band are
candidates; a candidate becomes a link only if the exact Jaccard similarity of the two sets reaches the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .spread import HOT_ROWS, dropped, hot_keys, joined, written
from .textops import SHINGLE_WORDS, Words, distinct_per_row, distinct_wide, fresh_key, mix, pieces, second_key

#: 25 bands of 5 coordinates: a pair of similarity 0.85 misses all of them with probability 4e-7, one of 0.8 with 5e-5.
BANDS, ROWS = 25, 5
_BLOCK = 1 << 15
#: Coordinates of which a signature keeps one byte each, to tell pairs near the threshold before their sets are moved.
SKETCH = 512
#: Coordinates of a band by which large buckets are cut finer.
FINE_ROWS = 8
#: Places of the bitmap of wanted ids: 4 MB, whatever the corpus.
FILTER_BITS = 25
#: Members of a bucket that are compared as one block.
_MEMBERS = 1024


def _turn(x: np.ndarray, spare: np.ndarray) -> None:
    """The second permutation, in place: a bijection of 32-bit integers."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def signatures(values: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash signature of each row of shingles; rows without shingles get all ones."""
    rows = len(offsets) - 1
    out = np.full((rows, coordinates), 0xFFFFFFFF, np.uint32)
    placed = mix(values ^ np.uint64(0x5851F42D4C957F2D)).astype(np.uint32)  # the first permutation
    full = np.flatnonzero(np.diff(offsets) > 0)
    at = 0
    while at < len(full):
        stop = at + 1
        while stop < len(full) and offsets[full[stop] + 1] - offsets[full[at]] <= _BLOCK:
            stop += 1
        some = full[at:stop]
        base = offsets[some[0]]
        block = placed[base : offsets[some[-1] + 1]]
        starts = offsets[some] - base
        x, spare = np.empty_like(block), np.empty_like(block)
        for k in range(coordinates):
            np.subtract(block, np.uint32(k), out=x)
            _turn(x, spare)
            out[some, k] = np.minimum.reduceat(x, starts)
        at = stop
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each row and band, the number of the band mixed in."""
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :].repeat(len(signature), axis=0)
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _sketched(bands: int, rows: int, width: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values, offsets = distinct_per_row(*Words(batch.column("text"), key).shingles(width))
            counts = np.diff(offsets)
            step = max(SKETCH, bands * rows)
            signature = signatures(values, offsets, step)
            keys = band_keys(signature, bands, rows)
            low = signature.astype(np.uint8).tobytes()
            sketch = [low[k : k + step] for k in range(0, len(low), step)]
            whole = memoryview(values.view(np.uint8))
            digests = [hashlib.blake2b(whole[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)
        words, which = np.unique(at >> np.uint64(6), return_inverse=True)
        masks = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(masks, which, np.uint64(1) << (at & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(masks.view(np.int64))], names=["word", "mask"])


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** FILTER_BITS hashed places that holds every id of a one-column table; its size never grows."""
    words = ids.mapInArrow(_bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def _sets(width: int, shared, key: int):
    """Full shingle sets of the rows whose id the bitmap may hold, 128 bits a shingle under keys that no writer of texts knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in pieces(batches):
            at = mix(batch.column("doc_id").fill_null(0).to_numpy().view(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)
            held = (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            batch = batch.filter(pa.array(held))
            words = Words(batch.column("text"), key)
            first, second, offsets = distinct_wide(words.shingles(width)[0], *words.rehashed(second_key(key)).shingles(width))
            whole = np.stack([first, second], axis=1).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([whole[16 * a : 16 * b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["id", "shingles"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("of_a"), batch.column("of_b"))):
                both = np.concatenate([np.frombuffer(z.as_buffer(), np.uint64).reshape(-1, 2) for z in (x, y)])
                n = len(both)
                rows = both[np.argsort(both[:, 0], kind="stable")]
                halves = rows[1:] == rows[:-1]
                if (halves[:, 0] & ~halves[:, 1]).any():  # one 64-bit hash for two shingles
                    rows = both[np.lexsort((both[:, 1], both[:, 0]))]
                    halves = rows[1:] == rows[:-1]
                common = int(halves.all(axis=1).sum())
                keep[i] = 100 * common >= percent * (n - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, key: int, width: int = SHINGLE_WORDS) -> DataFrame:
    """Those pairs (a, b) of document ids whose full shingle sets have 100 * intersection >= percent * union.

    No text is shuffled: a bitmap of fixed size tells the scan which documents may be on a pair, and only their sets
    leave it. A document on very many pairs is dealt to as many salts as its pairs need, so that no task meets more
    than about HOT_ROWS of them.
    """
    total = pairs.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))
    sets = written(docs.select("doc_id", "text").mapInArrow(_sets(width, shared, key), "id long, shingles binary"), "sets")

    def salted(rows: DataFrame, one: str, other: str) -> DataFrame:
        hot = hot_keys(pairs, one, total).select(one, F.ceil(F.col("count") / HOT_ROWS).alias("salts"))
        return rows.join(F.broadcast(hot), one, "left").withColumn(f"salt_{one}", F.coalesce(F.pmod(F.xxhash64(other), F.col("salts")), F.lit(0))).drop("salts")

    both = rows = written(salted(salted(pairs.select("a", "b"), "a", "b"), "b", "a"), "salted")
    for one in ("b", "a"):
        wanted = rows.select(F.col(one).alias("id"), f"salt_{one}").distinct().join(sets, "id")
        both = both.join(wanted.withColumnsRenamed({"id": one, "shingles": f"of_{one}"}), [one, f"salt_{one}"])
    links = written(both.select("a", "b", "of_a", "of_b").mapInArrow(_linked(percent), "a long, b long").distinct(), "links")
    dropped(rows)
    dropped(sets)
    shared.destroy()
    return links


def _close(percent: int, coordinates: int):
    """Pairs of one block, or of two blocks of one bucket, whose one-byte signatures agree often enough.

    The least agreement is five standard deviations under the threshold: a link is missed with probability 3e-7.
    """
    share = percent / 100
    least = coordinates * (share - 5 * np.sqrt(share * (1 - share) / coordinates))

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        node, n, part = (rows.column(c).to_numpy() for c in ("node", "n_shingles", "component"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(node), coordinates)
        low, high, home = (rows.column(c).to_numpy() for c in ("low", "high", "block"))
        a, b = [], []
        for i in range(len(node)):
            fit = (part != part[i]) & (node > node[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if low[i] != high[i]:
                fit &= home != home[i]
            some = np.flatnonzero(fit)
            if len(some):
                some = some[(sketch[some] == sketch[i]).sum(axis=1) >= least]
                a.append(np.full(len(some), node[i]))
                b.append(node[some])
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[x])
                if held and key != last:
                    yield pairs(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(batch.slice(x, y - x))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _finer(nodes: DataFrame, sketches: DataFrame) -> DataFrame:
    """Finer buckets of the nodes (node, n_shingles, component) of mixed ones, by bands of FINE_ROWS coordinates of the one-byte
    signatures: one rule for every size. Buckets that lie in one component are left out.

    With 64 bands of 8 a pair of similarity 0.85 misses all of them with probability 1e-9, one of 0.8 with 8e-6, while
    one of 0.5, as passages that many documents share make it, meets in a fifth of cases and one of 0.3 hardly ever.
    """
    told = nodes.join(sketches, "node")
    bands = F.sequence(F.lit(0), F.floor(F.octet_length("sketch") / FINE_ROWS).cast("int") - 1)
    keys = F.transform(bands, lambda j: F.xxhash64(j, F.substring("sketch", j * FINE_ROWS + 1, F.lit(FINE_ROWS))))
    fine = told.select(F.explode(keys).alias("bucket"), "node", "n_shingles", "component")
    sizes = fine.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high").select("bucket", "size")
    return joined(fine, sizes, "bucket").select("bucket", "size", "node", "n_shingles", "component")


def _apart(nodes: DataFrame, sketches: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """Candidate pairs (a, b) among the nodes that meet in a finer bucket and lie in different components.

    nodes: node, n_shingles, component; sketches: node, sketch. A bucket is cut into blocks of about
    _MEMBERS rows and each pair of blocks is one small unit of work, so a bucket of any size is spread over many tasks;
    only pairs that agree in enough of their signatures leave a task.
    """
    blocks = F.ceil(F.col("size") / _MEMBERS).cast("long")
    placed = _finer(nodes, sketches).join(sketches, "node")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    placed = placed.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
    placed = placed.select("bucket", "low", "high", "block", "node", "n_shingles", "component", "sketch")
    placed = placed.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")
    return placed.mapInArrow(_close(percent, coordinates), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs, which needs doc_id and text; other columns are ignored.

    A document's set holds its distinct `width`-word shingles; with fewer words, its whole sequence as one. Sets with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable over links, kept
    marks the rows whose doc_id that is.

    Null or empty texts, and texts without words, have an empty set and stay alone. Rows without a doc_id stay alone
    with a null component_id and are kept. Repeated rows have equal sets, hence one component; rows that share a
    doc_id are one document, linked where any of its texts is. An empty table gives an empty result.

    1. Equal sets become one node, by 128 bits of the whole set: groups of copies of any size cost one row a copy.
    2. In every bucket (documents that share a band) each node is paired with the bucket's first; confirmed links
       give components. A bucket that lies in one component is done, which ends most buckets of near copies.
    3. In the other buckets, all cut finer by one rule, every two nodes of different components are compared by
       their signatures, in blocks, and those that come near the threshold are confirmed in the same way.
    """
    key = fresh_key()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(source.mapInArrow(_sketched(bands, rows, width, key), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"), "sketch")
    some = sketch.filter("doc_id is not null and digest is not null")
    first = some.groupBy("digest").agg(F.min("doc_id").alias("node"))
    base = written(joined(some.select("doc_id", "n_shingles", "digest"), first, "digest").drop("digest"), "base")
    nodes = some.join(first, [some["digest"] == first["digest"], some["doc_id"] == first["node"]], "left_semi").withColumnRenamed("doc_id", "node")
    buckets = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).filter("size > 1")
    shared = written(joined(buckets, heads, "bucket"), "shared")
    fits = 100 * F.least("n_shingles", "of_head") >= percent * F.greatest("n_shingles", "of_head")
    sizes = shared.filter("node = head").select("bucket", F.col("n_shingles").alias("of_head"))
    tried = shared.filter("node <> head").join(sizes.groupBy("bucket").agg(F.max("of_head").alias("of_head")), "bucket").filter(fits)
    tried = written(tried.select(F.col("node").alias("b"), F.col("head").alias("a")).distinct(), "tried")
    links = confirmed(tried, source, percent, key, width)
    found = components(links)
    placed = joined(shared.select("bucket", "node", "n_shingles"), found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high").select("bucket")
    members = written(joined(placed, mixed, "bucket").select("node", "n_shingles", "component").distinct(), "members")
    sketches = written(nodes.select("node", "sketch").join(members.select("node"), "node", "left_semi").distinct(), "sketches")
    apart = written(_apart(members, sketches, percent, max(SKETCH, bands * rows)).join(tried, ["a", "b"], "left_anti"), "apart")
    dropped(shared)
    dropped(placed)
    dropped(members)
    dropped(sketches)
    labels = components(links.unionByName(confirmed(apart, source, percent, key, width)))
    told = joined(base, labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    alone = sketch.filter("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
