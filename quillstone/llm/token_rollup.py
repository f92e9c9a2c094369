"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch is a table of signed rows: +1 inserts a document, -1 deletes one; a revised document is both. Its counts are
added up by group and stored as one small delta; totals are the sum of the deltas, since all measures are additive. A
batch takes effect by the creation of one file named after it, which the file system does for one writer only: a batch
that is sent again, or by two drivers, counts once, and one that failed half-way counts not at all.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import pieces

#: How the byte-pair vocabularies in use cut a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = {name: f"/opt/tokenizers/{name}.tiktoken" for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
_GROUP = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"


#: Largest vocabulary file that is sent to the executors.
MOST_BYTES = 64 << 20


@lru_cache
def encoding(vocabulary: bytes):
    """A byte-pair encoding from lines of base64 tokens and ranks."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str):
    with open(path, "rb") as file:
        return encoding(file.read())


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {version: encoding(vocabulary).encode_ordinary for version, vocabulary in shared.value.items()}
        sums: dict[tuple, np.ndarray] = {}

        def table() -> pa.RecordBatch:
            keys, values = list(sums), np.array(list(sums.values()), np.int64).reshape(-1, 3)
            columns = [pa.array([k[j] for k in keys], pa.string()) for j in range(3)] + [pa.array(values[:, j].copy()) for j in range(3)]
            return pa.RecordBatch.from_arrays(columns, names=[*_GROUP, "n_docs", "n_tokens", "n_bytes"])

        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            signs, sources, langs = (batch.column(c).to_pylist() for c in ("sign", "source", "lang"))
            for version, encode in encoders.items():
                for sign, source, lang, text in zip(signs, sources, langs, texts):
                    sums.setdefault((source, lang, version), np.zeros(3, np.int64))[:] += np.array([1, len(encode(text)), len(text.encode())]) * (sign or 0)
            if len(sums) > 100_000:
                yield table()
                sums = {}
        if sums:
            yield table()

    return run


def signed(inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """One batch of changes from the new states and the old states of documents (source, lang, text)."""
    parts = [df.select(F.lit(sign).alias("sign"), "source", "lang", "text") for sign, df in ((1, inserts), (-1, deletes)) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class TokenRollup:
    """Totals kept under a folder on a file system that all executors share.

    Measures: documents, tokens and UTF-8 bytes. Null texts count as empty documents; null sources and languages are
    groups of their own; a null sign changes nothing; repeated rows each count; an empty batch is a batch. Texts of any
    length are read whole; columns beyond those named are ignored. A batch's name is any string, "" and long ones too.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, str] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tokenizers = dict(TOKENIZERS if tokenizers is None else tokenizers)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._shared = None

    def _vocabularies(self):
        """The vocabulary files, read here and broadcast, so executors need no file of their own."""
        if self._shared is None:
            sizes = {version: os.path.getsize(path) for version, path in self.tokenizers.items()}
            if sum(sizes.values()) > MOST_BYTES:
                raise ValueError(f"vocabularies of {sum(sizes.values())} bytes are too large to broadcast")
            self._shared = self.spark.sparkContext.broadcast({version: Path(path).read_bytes() for version, path in self.tokenizers.items()})
        return self._shared

    def _marker(self, batch: str):
        return self._path(f"{self.folder}/commits/{hashlib.sha256(str(batch).encode('utf-8', 'surrogatepass')).hexdigest()}")

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._marker(batch))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes (sign, source, lang, text). False, and nothing done, where it is already committed."""
        if self.committed(batch):
            return False
        rows = changes.select(F.col("sign").cast("int").alias("sign"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
        delta = rows.mapInArrow(_counted(self._vocabularies()), _SCHEMA)
        return self.apply_counts(batch, delta)

    def apply_counts(self, batch: str, delta: DataFrame) -> bool:
        """Adds a batch of signed counts, as of documents counted elsewhere, or revised counts less the old ones."""
        if self.committed(batch):
            return False
        sums = delta.groupBy(*_GROUP).agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_bytes")))
        attempt = f"deltas/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{attempt}")
        return self._claim(self._ready(attempt, {"batch": str(batch), "delta": attempt}), self._marker(batch))

    def _ready(self, attempt: str, content: dict):
        """A finished file that waits for its name."""
        ready = self._path(f"{self.folder}/{attempt}.json")
        out = self._fs.create(ready, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return ready

    def _claim(self, ready, marker) -> bool:
        """Renames the finished file to a name, which one writer alone can do; False for any other."""
        self._fs.mkdirs(marker.getParent())
        context = self.spark.sparkContext
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), context._jsc.hadoopConfiguration())
        options = context._gateway.new_array(getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(ready, marker, options)
        except Exception:
            if self._fs.exists(marker):
                return False
            raise
        return True

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _snapshot(self) -> tuple[int, dict]:
        """The number and the content of the last snapshot; 0 and nothing where there is none."""
        names = self._names("snapshots")
        if not names:
            return 0, {"delta": None, "batches": []}
        return int(names[-1]), json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/snapshots/{names[-1]}").collect()))

    def deltas(self) -> list[str]:
        """Folders of the snapshot and of the deltas committed after it."""
        _, last = self._snapshot()
        fresh = sorted(set(self._names("commits")) - set(last["batches"]))
        lines = self.spark.read.text([f"{self.folder}/commits/{n}" for n in fresh]).collect() if fresh else []
        return sorted(f"{self.folder}/{d}" for d in [*([last["delta"]] if last["delta"] else []), *(json.loads(r[0])["delta"] for r in lines)])

    def compact(self) -> bool:
        """Adds all committed deltas up into one snapshot, which `totals` reads in their place; False where another did so meanwhile.

        A batch's marker stays, so it still counts once. Deltas that a snapshot holds are deleted when the next one is
        made, so a reader that has just listed them still finds them.
        """
        number, last = self._snapshot()
        names, paths = self._names("commits"), self.deltas()
        if set(names) == set(last["batches"]):
            return False
        attempt = f"deltas/{uuid.uuid4().hex}"
        self._sums(paths).write.parquet(f"{self.folder}/{attempt}")
        content = {"delta": attempt, "batches": names, "held": [p.removeprefix(f"{self.folder}/") for p in paths]}
        if not self._claim(self._ready(attempt, content), self._path(f"{self.folder}/snapshots/{number + 1:012d}")):
            return False
        for old in last.get("held", []):
            self._fs.delete(self._path(f"{self.folder}/{old}"), True)
        return True

    def _sums(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*_GROUP).agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_bytes")))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_bytes) after all committed batches; groups that came to nothing are left out."""
        return self._sums(self.deltas()).filter("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")
