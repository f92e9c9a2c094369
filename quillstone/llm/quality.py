"""A quality classifier by compression: dictionaries of good and of bad text, and which of them compresses better.

A text is cut into blocks of BLOCK bytes, so that dictionaries matter throughout a long text; each block is compressed
by zstandard with either dictionary. The size difference per byte and per compressed byte, with the good size per
byte, pass through a logistic function fitted on labelled rows that no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import pieces, text_bytes

BLOCK, DICTIONARY_BYTES, LEVEL = 2048, 64 << 10, 3
#: Labelled rows for each dictionary, whose whole texts are read, and rows for calibration.
DICTIONARY_ROWS, CALIBRATION_ROWS = 2_000, 8_000


@dataclass
class Model:
    """Dictionaries of bad (0) and good (1) text, and the logistic weights; picklable."""

    dictionaries: list[bytes]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) if d else zstandard.ZstdCompressor(**plain) for d in self.dictionaries]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves, all of them, where there are too few to train one."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)


def features(column: pa.Array, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    data, offsets = text_bytes(column)
    view = memoryview(data)
    out = np.zeros((len(column), 6))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        bad, good = (sum(len(c.compress(view[k : min(k + BLOCK, b)])) for k in range(a, b, BLOCK)) for c in compressors)
        n = b - a
        if n:
            short = 1 / (1 + n / 100)
            out[i] = (1, (bad - good) / n, (bad - good) / (bad + good), good / n, short, short * (bad - good) / n)
        else:
            out[i, 0] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; a ridge keeps them finite where the classes part."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.01, *[1.0] * (x.shape[1] - 1)]) * 0.01
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = text_bytes(batch.column("text"))
        rows = []
        for a, b, label in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("label").to_pylist()):
            rows += [(label, data[k : min(k + BLOCK, b)].tobytes()) for k in range(a, b, BLOCK)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "block"])


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = shared.value.compressors()
        for batch in pieces(batches):
            values = features(batch.column("text"), compressors)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], names=["label", "x"])

    return run


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        compressors = model.compressors()
        for batch in pieces(batches):
            score = 1 / (1 + np.exp(-np.clip(features(batch.column("text"), compressors) @ model.weights, -30, 30)))
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*(c for c in batch.schema.names if c != "text"), "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, dictionary_rows: int = DICTIONARY_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Fits on rows of docs (doc_id, text) that labels (doc_id, label 0 or 1; others pass over) names.

    At most dictionary_rows ids a label make the dictionaries and calibration_rows others the logistic function; they
    are the first in a hashed order, so the choice is the same wherever it runs. Lines that good rows have too are
    left out of the bad dictionary. Without labels of both kinds every score is the share of label 1, or 0.5.
    """
    spark = docs.sparkSession
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    place = F.xxhash64("doc_id", F.lit("quality"))
    first = {k: [r[0] for r in named.filter(F.col("label") == k).orderBy(place, "doc_id").limit(dictionary_rows).select("doc_id").collect()] for k in (0, 1)}
    used = {i for ids in first.values() for i in ids}
    more = [(r[0], r[1]) for r in named.orderBy(F.xxhash64("doc_id", F.lit("calibrate")), "doc_id").limit(calibration_rows + len(used)).select("doc_id", "label").collect() if r[0] not in used]
    # Few labels: half of them calibrate.
    if len(more) < min(calibration_rows, len(used)) // 2:
        more += [(i, k) for k, ids in first.items() for i in ids[1::2]]
        first = {k: ids[::2] for k, ids in first.items()}
    more = more[:calibration_rows]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rows(ids: list[tuple[int, int]]) -> DataFrame:
        return texts.join(F.broadcast(spark.createDataFrame(ids, "doc_id long, label int")), "doc_id").select("label", "text")

    blocks: dict[int, list[bytes]] = {0: [], 1: []}
    for row in rows([(i, k) for k, ids in first.items() for i in ids]).mapInArrow(_blocks, "label int, block binary").collect():
        blocks[row["label"]].append(bytes(row["block"]))
    for k in blocks:
        blocks[k].sort()
    good = {line for b in blocks[1] for line in b.split(b"\n")}
    bad = [b"\n".join(line for line in b.split(b"\n") if line not in good) for b in blocks[0]]
    model = Model([dictionary(bad), dictionary(blocks[1])])
    points = rows(more).mapInArrow(_featured(spark.sparkContext.broadcast(model)), "label int, x array<double>").collect()
    y = np.array([float(p["label"]) for p in points])
    if len(y) and 0 < y.mean() < 1:
        x = np.array([p["x"] for p in points])
        order = np.lexsort((*x.T, y))
        model.weights = logistic(x[order], y[order])
    elif len(y):
        model.weights[0] = 30.0 if y.mean() else -30.0
    return model


def judged(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns of docs and score: from 0 to 1, higher where label 1 is likelier. One row for each row of docs.

    Only `text` enters the score. Null counts as empty; an empty text gets the score of no evidence. Whole texts are
    read, of any length. Repeated rows get equal scores, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("text").schema)
    return source.mapInArrow(_judged(shared), f"{fields}, score double" if fields else "score double")


def _passed(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        compressors = model.compressors()
        for batch in pieces(batches):
            score = 1 / (1 + np.exp(-np.clip(features(batch.column("text"), compressors) @ model.weights, -30, 30)))
            yield batch.filter(pa.array(score >= least))

    return run


def passed(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score as `judged` gives it is `least` or more."""
    return docs.mapInArrow(_passed(docs.sparkSession.sparkContext.broadcast(model), least), docs.schema)
