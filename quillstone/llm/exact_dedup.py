"""Exact duplicates by content-defined chunk recipes.

A gear hash over the last 32 bytes ends a chunk wherever its top bits are zero, so equal passages fall into equal
chunks wherever they stand. A chunk is named by a short hash and verified by its SHA-256: where one short hash covers
chunks of different SHA-256, an ordinal tells them apart. A document's recipe is its ordered list of verified
identifiers; documents are equal when their lists are. Only digests are shuffled, never a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import joined, written
from .textops import mix, pieces, text_bytes

#: Bytes of a chunk: least, most, and the bits that must be zero at a border (1 KiB on average beyond the least).
LEAST, MOST, BORDER_BITS = 256, 8192, 10
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def borders(data: np.ndarray) -> np.ndarray:
    """Positions after which the gear hash of the 32 bytes that end there allows a border."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k) if k < len(h) else 0
    return np.flatnonzero(h >> np.uint32(32 - BORDER_BITS) == 0) + 1


def cut(start: int, end: int, allowed: np.ndarray) -> list[int]:
    """The chunk ends of the text at start..end. Each is an allowed border at least LEAST bytes on, or MOST bytes on.

    What lies before `start` never counts: a border needs 32 bytes, and LEAST is more than that.
    """
    ends = []
    while end - start > LEAST:
        k = int(np.searchsorted(allowed, start + LEAST))
        stop = int(allowed[k]) if k < len(allowed) else end
        start = min(stop, start + MOST, end)
        ends.append(start)
    if start < end:
        ends.append(end)
    return ends


def _recipes(bits: int):
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_bytes(batch.column("text"))
            allowed = borders(data) if len(data) else np.zeros(0, np.int64)
            view = memoryview(data)
            whole, short, strong = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                whole.append(hashlib.sha256(view[a:b]).hexdigest())
                ends = cut(a, b, allowed)
                parts = [view[x:y] for x, y in zip([a, *ends], ends)]
                short.append([(xxhash.xxh3_64_intdigest(p) & mask) - (1 << 63) for p in parts])
                strong.append([hashlib.sha256(p).digest() for p in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(whole, pa.string()), pa.array(short, pa.list_(pa.int64())), pa.array(strong, pa.list_(pa.binary()))],
                names=["doc_id", "text_sha256", "short", "strong"],
            )

    return run


def exact_duplicates(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs, which needs doc_id and text; other columns are ignored.

    Rows of equal text form a group; the largest doc_id stays. Null counts as empty text, and all empty texts are
    equal. Repeated rows count in group_size, and each row that bears keep_id is kept. A row without a doc_id is kept
    only where its whole group has none; keep_id is null there. An empty table gives an empty result. Texts of any
    length are read whole. hash_bits narrows the short hash, which tests use to make it collide.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(source.mapInArrow(_recipes(hash_bits), "doc_id long, text_sha256 string, short array<long>, strong array<binary>"), "recipes")
    chunks = rows.select(F.explode(F.arrays_zip("short", "strong")).alias("c")).select("c.short", "c.strong").distinct()
    clashes = chunks.groupBy("short").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # Verified identifiers of clashing chunks: within one short hash, by SHA-256. With 64 bits there are next to none.
    ordinals = written(chunks.join(clashes, "short", "left_semi").withColumn("ordinal", F.row_number().over(Window.partitionBy("short").orderBy("strong"))), "ordinals")
    plain = F.transform("short", lambda x: F.struct(x.alias("short"), F.lit(0).alias("ordinal")))
    if ordinals.isEmpty():
        told = rows.select("doc_id", "text_sha256", plain.alias("recipe"))
    else:
        pieces_ = rows.select("text_sha256", F.posexplode(F.arrays_zip("short", "strong")).alias("at", "c")).select("text_sha256", "at", "c.short", "c.strong").distinct()
        named = pieces_.join(ordinals, ["short", "strong"], "left").select("text_sha256", F.struct("at", "short", F.coalesce("ordinal", F.lit(0)).alias("ordinal")).alias("p"))
        lists = named.groupBy("text_sha256").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["short"].alias("short"), p["ordinal"].alias("ordinal"))).alias("recipe"))
        none = F.array().cast("array<struct<short:bigint,ordinal:int>>")
        told = rows.select("doc_id", "text_sha256").join(lists, "text_sha256", "left").withColumn("recipe", F.coalesce("recipe", none))
    told = told.withColumn("recipe_id", F.sha2(F.to_json("recipe"), 256))
    groups = told.groupBy("recipe_id", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("recipe")
    many = groups.filter("group_size > 1")
    out = joined(told.drop("recipe"), many, "recipe_id", "left", total=rows.count())
    out = out.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    return out.select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
