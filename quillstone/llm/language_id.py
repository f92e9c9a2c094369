"""Language identification by interpolated Kneser-Ney character models, one a language.

Letters are lower-cased, runs of other characters become one border. A model keeps its counts of up to ORDER symbols
in sorted arrays of 64-bit hashes. A text gets the language of the lowest cross-entropy per symbol; a logistic
function, fitted on rows no model has seen, turns that entropy and its margin into a confidence, below which a text
can be rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import logistic
from .textops import Table, mix, pieces, text_bytes

ORDER = 5
#: Rows of each language that train its model, and that calibrate, about (chosen by hash).
TRAIN_ROWS, CALIBRATION_ROWS = 400, 400
#: Models are broadcast, 3.6 MB a language on sf0.1 at TRAIN_ROWS, so there may be this many.
MOST_LANGUAGES = 500
#: Probabilities of seen runs that a model keeps at hand, languages times runs; beyond it they are worked out anew.
_AT_HAND = 1 << 24
UNKNOWN = "und"
_BORDER = 0


def decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows one after the other, and the rows' n + 1 offsets."""
    data, offsets = text_bytes(column)
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32), starts[offsets]


@lru_cache
def letters() -> np.ndarray:
    """The symbol of each code point: its lower-case letter's (the first where that is several), or the border for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            table[p] = ord(c.lower()[0])
    return table


class Grams:
    """Keys of the last 1 to ORDER symbols at each symbol of each row, and of all but the last of these.

    A row begins and ends with a border; borders in a row collapse into one. What lies before a row is borders.
    """

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        numbers = letters()[points]
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = (numbers[1:] != _BORDER) | (numbers[:-1] != _BORDER)
        inner = offsets[:-1][offsets[:-1] < len(points)]
        keep[inner] = numbers[inner] != _BORDER  # the border that every row begins with is added below
        total = np.zeros(len(points) + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        lengths = np.diff(total[offsets])
        self.starts = np.zeros(rows + 1, np.int64)
        np.cumsum(lengths + 1, out=self.starts[1:])
        symbols = np.full(self.starts[-1], _BORDER, np.uint64)
        symbols[np.arange(int(lengths.sum())) + np.repeat(np.arange(rows), lengths) + 1] = numbers[keep]
        self.keys, self.contexts = (np.zeros((ORDER, len(symbols)), np.uint64) for _ in range(2))
        before, outside = np.zeros(len(symbols), np.uint64), np.zeros(1, np.uint64)
        for k in range(ORDER):
            self.contexts[k] = before
            own = extended(before, symbols, k)
            outside = extended(outside, np.zeros(1, np.uint64), k)
            self.keys[k] = own
            before = np.concatenate([outside, own[:-1]]) if len(own) else own
            before[self.starts[:-1]] = outside[0]
        has = np.zeros(len(points) + 1, np.int64)
        np.cumsum(numbers != _BORDER, out=has[1:])
        self.has = np.diff(has[offsets]) > 0

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct runs of ORDER symbols, a row of all keys and contexts each, and their counts."""
        _, first, counts = np.unique(self.keys[-1], return_index=True, return_counts=True)
        return np.concatenate([self.keys[:, first], self.contexts[:, first]]).T, counts


def extended(context: np.ndarray, symbols: np.ndarray, k: int) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + symbols + (np.uint64(k + 1) << np.uint64(32)))


class KneserNey:
    """One language's model: counts by length in sorted hash arrays. Lower orders count distinct symbols before."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, size: int):
        """runs: the distinct runs as `Grams.distinct` gives them; size: of the alphabet."""
        self.size, self.orders = size, []
        for k in range(ORDER, 0, -1):
            keys, contexts = runs[:, k - 1], runs[:, ORDER + k - 1]
            ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            known, which = np.unique(contexts, return_inverse=True)
            totals, kinds = np.bincount(which, weights=counts, minlength=len(known)), np.bincount(which, minlength=len(known))
            order = np.argsort(keys)
            self.orders.append(((keys[order], counts[order].astype(float)), (known, totals, kinds.astype(float)), discount))
            if k > 1:
                _, first, counts = np.unique(runs[:, k - 2], return_index=True, return_counts=True)
                runs = runs[first]
        self.orders.reverse()

    def log10(self, keys: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol after the others; keys and contexts by length."""
        p = np.full(keys.shape[1], 1 / self.size)
        for (runs, counts), (known, totals, kinds), discount, want, context in zip(*zip(*self.orders), keys, contexts):
            if not len(runs):
                continue
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            own = np.minimum(np.searchsorted(runs, want), len(runs) - 1)
            count = np.where(runs[own] == want, counts[own], 0)
            p = np.where(known[at] == context, (np.maximum(count - discount, 0) + discount * kinds[at] * p) / totals[at], p)
        return np.log10(p)


class Model:
    """All languages' models, with a table of the runs seen; and the logistic weights of the confidence."""

    def __init__(self, samples: dict[str, tuple[np.ndarray, np.ndarray]]):
        """samples: each language's distinct runs and their counts."""
        self.languages = sorted(samples)
        every = np.concatenate([np.zeros((0, 2 * ORDER), np.uint64), *(runs for runs, _ in samples.values())])
        size = len(np.unique(every[:, 0])) + 1
        self.models = [KneserNey(*samples[name], size) for name in self.languages]
        seen, first = np.unique(every[:, ORDER - 1], return_index=True)
        if len(seen) * len(samples) > _AT_HAND:
            seen, first = seen[:0], first[:0]
        self.table = Table(seen)
        self.values = self._all(every[first, :ORDER].T, every[first, ORDER:].T)
        self.weights: np.ndarray | None = None

    def _all(self, keys: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        return np.stack([m.log10(keys, contexts) for m in self.models], axis=0) if self.models else np.zeros((0, keys.shape[1]))

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (rows by languages), symbols, and whether there is a letter, of each row."""
        grams = Grams(*decoded(column))
        at = self.table.find(grams.keys[-1])
        missed = np.flatnonzero(at < 0)
        _, first, which = np.unique(grams.keys[-1][missed], return_index=True, return_inverse=True)
        rare = self._all(grams.keys[:, missed[first]], grams.contexts[:, missed[first]])
        n = np.diff(grams.starts)
        out = np.zeros((len(n), len(self.languages)))
        for j in range(len(self.languages)):
            value = self.values[j][at] if len(self.table.keys) else np.zeros(len(at))
            value[missed] = rare[j][which]
            out[:, j] = -np.add.reduceat(value, grams.starts[:-1]) / n if len(n) else 0
        return out, n, grams.has

    @staticmethod
    def evidence(entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        best = np.sort(entropy, axis=1)
        margin = best[:, 1] - best[:, 0] if best.shape[1] > 1 else np.ones(len(n))
        return np.stack([np.ones(len(n)), margin, margin * np.sqrt(np.minimum(n, 10_000)), best[:, 0], 1 / np.sqrt(n)], axis=1)

    def predict(self, column: pa.Array, reject: float = 0.0) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        entropy, n, has = self.entropies(column)
        best = entropy.argmin(axis=1) if len(n) else np.zeros(0, int)
        if self.weights is None:
            score = np.ones(len(n))
        else:
            score = 1 / (1 + np.exp(-np.clip(self.evidence(entropy, n) @ self.weights, -30, 30)))
        score = np.where(has, score, 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has & (score >= reject))], score


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct runs of a task's texts by language, and their counts."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in pieces(batches):
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        for lang in dict.fromkeys(langs.tolist()):
            runs, counts = Grams(*decoded(batch.column("text").filter(pa.array(langs == lang)))).distinct()
            held[lang] = added([held[lang], (runs, counts)]) if lang in held else (runs, counts)
    for lang, (runs, counts) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([runs.tobytes()], pa.binary()), pa.array([counts.astype(np.int64).tobytes()], pa.binary())], names=["lang", "runs", "counts"])


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of several samples and the sums of their counts."""
    runs, counts = (np.concatenate(x) for x in zip(*parts))
    _, first, which = np.unique(runs[:, ORDER - 1], return_index=True, return_inverse=True)
    return runs[first], np.bincount(which, weights=counts).astype(np.int64)


def _measured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in pieces(batches):
            entropy, n, has = model.entropies(batch.column("text"))
            guess = [model.languages[b] for b in entropy.argmin(axis=1)]
            right = [g == t for g, t in zip(guess, batch.column("lang").to_pylist())]
            x = model.evidence(entropy, n)[has]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, ok in zip(right, has) if ok], pa.bool_()), lists], names=["right", "x"])

    return run


def _named(shared, reject: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in pieces(batches):
            names, score = model.predict(batch.column("text"), reject)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return run


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Fits a model for each non-null lang of docs (text, lang) on about train_rows whole texts of it, chosen by hash.

    As many others calibrate. A language of fewer rows gives two thirds of them to its model, and the text whose hash
    is the least in any case, so each has a model. A language whose texts are all null or empty is learnt as one
    border. Without languages every prediction is UNKNOWN; over MOST_LANGUAGES are refused. Runs are counted on the
    executors; the driver gets the distinct ones of a task's texts.
    """
    spark = docs.sparkSession
    draw = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("language")), F.lit(1_000_000)) / 1e6
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null").withColumn("draw", draw)
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not sizes:
        return Model({})
    shares = [(r["lang"], min(2 / 3, train_rows / r["n"]), min(1 / 3, calibration_rows / r["n"]), r["least"]) for r in sorted(sizes)]
    table = spark.createDataFrame(shares, "lang string, fit double, check double, least double")
    drawn = texts.join(F.broadcast(table), "lang").filter("draw < fit + check or draw = least")
    fits = "draw < fit or draw = least"
    fit, check = drawn.filter(fits).select("lang", "text"), drawn.filter(f"not ({fits})").select("lang", "text")
    samples: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for row in fit.mapInArrow(_counted, "lang string, runs binary, counts binary").toLocalIterator():
        samples.setdefault(row["lang"], []).append((np.frombuffer(row["runs"], np.uint64).reshape(-1, 2 * ORDER), np.frombuffer(row["counts"], np.int64)))
    model = Model({lang: added(parts) for lang, parts in samples.items()})
    seen = check.mapInArrow(_measured(spark.sparkContext.broadcast(model)), "right boolean, x array<double>").collect()
    if seen:
        x, y = np.array([r["x"] for r in seen]), np.array([float(r["right"]) for r in seen])
        order = np.lexsort((*x.T, y))
        # One miss is assumed, so that a sample without any still gives finite confidence.
        x, y = np.vstack([x[order], x.mean(axis=0) * [1, 0, 0, 1, 1]]), np.append(y[order], 0.0)
        model.weights = logistic(x, y)
    return model


def identified(docs: DataFrame, model: Model, *keep: str, reject: float = 0.0) -> DataFrame:
    """The kept columns of docs, lang_pred and score (confidence, 0 to 1), one row for each row of docs.

    Only `text` enters a prediction. A null text, or one without a letter, is UNKNOWN with score 0; so is, in name,
    any whose score is under `reject`. Whole texts are read. Repeated rows get equal answers, and equal entropies the
    language first in order. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.drop("text").schema)
    return source.mapInArrow(_named(shared, reject), f"{fields}lang_pred string, score double")
