"""Language-model scores from a probabilistic suffix tree over words, with an add-one word baseline at its root.

A text is read as its words (A-Z lower-cased) and one end; an end also stands before its first word. Contexts of up to
DEPTH words become states of the tree where their next-word distribution diverges from that of their longest shorter
state: count times Kullback-Leibler divergence against a likelihood-ratio cutoff, the upper LEVEL point of half a
chi-square. A state's distribution is discounted (Witten and Bell) and backs off to that of its longest shorter state,
down to the root, which is the baseline itself: (c + 1) / (N + V + 1), whose one spare share stands for unknown words.
So every state's distribution sums to one. A word is scored in the state of the longest suffix of what precedes it.

All words and all runs of up to DEPTH + 1 words are counted; those that occur LEAST times are kept, whatever the size
of the corpus, so the tree grows with it. It stays a table: nothing of it goes to the driver or is broadcast.

Texts are cut into chunks, which ask for what they need and get answers in the order in which they asked:

1. A chunk's distinct words go to the word's bucket, by a keyed hash. Words that occur LEAST times get numbers there, the
   frequent ones low, and the chunk keeps its texts as numbers, with 0 for other words: no run that holds one can occur
   often enough. The baseline's sums are made on the way.
2. A chunk's distinct runs go, sorted and packed, to the bucket of their first word, those of a hot word to that of
   their first two; sums are made there, so all runs of a context meet, but for single hot words' as contexts, whose
   sums of sums the driver gets (4 a bucket at most).
3. States and their runs' terms are made in each bucket, a length after the other; what a run ends in lies in another
   bucket, which is asked for the probability of the last word in the shorter state.
4. What a run gains over the root is the sum of its terms and of the weights of its contexts, so a chunk asks once for
   each of its distinct runs and words and adds up the answers by row.

Chunks and buckets are of an even size, so packets from the ones to the others grow as the square of the corpus. A step's
packets are therefore cut from columns that are made for all of them at once; what is done for a packet alone is little.

Each step is written before the next and what it no longer needs is deleted, so disk holds a step at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import dropped, written
from .textops import Words, fresh_key, mix, pieces

DEPTH = 2
#: Occurrences that keep a word or run: an absolute number, the same at every size.
LEAST = 2
#: The normal quantile of the cutoff's level, 5 %.
QUANTILE = 1.6448536269514722
#: The end token's key among the words.
_END_WORD = np.uint64(0x2545F4914F6CDD1D)
#: Bytes of text that ask together.
_CHUNK = 4 << 20
#: Shares of the chunks that ask one after the other, so that answers and what they meet lie on disk a share at a time.
PASSES = 2
#: A word is hot above this share of a bucket of even size, so there are at most 4 hot words a bucket.
_HOT = 4
#: Numbers of words stay below this, so that two of them fit in 64 bits.
_MOST = 1 << 31


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _least(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the least width; floats as they are."""
    if x.dtype.kind == "f":
        return x
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _planes(*columns: np.ndarray) -> np.ndarray:
    """The bytes of columns of one length, those of a rank after each other."""
    out, at = np.empty((sum(x.dtype.itemsize for x in columns), len(columns[0])), np.uint8), 0
    for x in columns:
        size = x.dtype.itemsize
        each = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), size)
        for k in range(size):
            out[at + k] = each[:, k]
        at += size
    return out


def _head(columns: list[np.ndarray], rows: list[int]) -> bytes:
    return struct.pack("<I" + "cBQ" * len(columns), len(columns), *(v for x, n in zip(columns, rows) for v in (x.dtype.kind.encode(), x.dtype.itemsize, n)))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0, or of floats, as compressed byte planes of the least width."""
    columns = [_least(x) for x in columns]
    return _ZIP.compress(b"".join([_head(columns, [len(x) for x in columns]), *(_planes(x).tobytes() for x in columns)]))


def packed_parts(columns: list[np.ndarray], cuts: np.ndarray) -> list[bytes]:
    """The parts of columns of one length, each as `packed` would have it, but for widths that are those of whole columns.

    The planes are made for all parts at once, so that a part costs little however small it is.
    """
    columns, cuts = [_least(x) for x in columns], cuts.tolist()
    planes = _planes(*columns)
    return [_ZIP.compress(_head(columns, [y - x] * len(columns)) + planes[:, x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:])]


def unpacked(data: bytes, wide: bool = True) -> list[np.ndarray]:
    """The columns; numbers as 64-bit ones, or else as they were packed."""
    data = _UNZIP.decompress(data)
    (n,) = struct.unpack_from("<I", data)
    at, out, head = 4 + 10 * n, [], struct.unpack_from("<" + "cBQ" * n, data, 4)
    for kind, size, rows in zip(head[::3], head[1::3], head[2::3]):
        x = np.frombuffer(data, np.uint8, rows * size, at)
        at += rows * size
        if size > 1:
            each = np.empty((rows, size), np.uint8)
            for k in range(size):
                each[:, k] = x[k * rows : (k + 1) * rows]
            x = each.reshape(-1).view(f"{kind.decode()}{size}")
        elif not wide:
            x = x.copy()  # else it would hold all columns
        out.append(x.astype(np.int64) if wide and kind == b"u" else x)
    return out


_PACKET = "bucket int, kind int, chunk long, part int, a binary, b binary"
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())


#: Rows and bytes of a batch of packets; a packet of more bytes is alone.
_BATCH_ROWS, _BATCH_BYTES = 256, 1 << 20


def _packets(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    start, size = 0, 0
    for k in range(len(rows) + 1):
        size += len(rows[k][4]) + len(rows[k][5]) if k < len(rows) else 0
        if k > start and (k == len(rows) or k - start == _BATCH_ROWS or size > _BATCH_BYTES):
            columns = list(zip(*rows[start:k]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=[x.split()[0] for x in _PACKET.split(", ")])
            start, size = k, len(rows[k][4]) + len(rows[k][5]) if k < len(rows) else 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        numbers = zip(*(batch.column(c).to_numpy().tolist() for c in range(4)))
        for k, plain in enumerate(numbers):
            yield *plain, batch.column(4)[k].as_py(), batch.column(5)[k].as_py()


def _home(chunk: int, buckets: int) -> int:
    """The bucket that `mix` of a chunk gives."""
    x = chunk ^ (chunk >> 30)
    x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 31)) % buckets


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _grouped(where: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their buckets, as they were within one, and the buckets' cuts in it; those beyond `buckets` come last."""
    order = np.argsort(where.astype(np.uint16 if buckets < 1 << 16 else np.uint32), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(where, minlength=buckets)[:buckets])])


def _filled(cuts: np.ndarray) -> np.ndarray:
    """The buckets that have any."""
    return np.flatnonzero(cuts[1:] > cuts[:-1])


def _steps(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The steps between rising numbers, from 0 anew in each part."""
    out = np.diff(x, prepend=0)
    starts = cuts[:-1][_filled(cuts)]
    out[starts] = x[starts]
    return out


def _sent(columns: list[np.ndarray], cuts: np.ndarray) -> dict[int, bytes]:
    """The packed parts of the buckets that have any; columns are in the order of buckets, the first rises within one."""
    some = _filled(cuts)
    return dict(zip(some.tolist(), packed_parts([_steps(columns[0], cuts), *columns[1:]], np.append(cuts[some], cuts[-1]))))


def padded(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each row's tokens, an end before and after its words, and the rows' offsets."""
    offsets = words.first + 2 * np.arange(len(words.first))
    keys = np.full(offsets[-1], _END_WORD, np.uint64)
    inside = np.ones(offsets[-1], dtype=bool)
    inside[offsets[:-1]] = False
    inside[offsets[1:] - 1] = False
    keys[inside] = words.hashes
    return keys, offsets


class Chunk:
    """Some rows: their distinct words' keys and buckets' cuts in them, their tokens as places among these, and the rows' offsets."""

    def __init__(self, parts: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], buckets: int):
        self.offsets = np.concatenate([[0], np.cumsum(np.concatenate([n for *_, n in parts]))])
        self.rows = pa.Table.from_batches([b for b, *_ in parts]).combine_chunks()
        coded = pc.dictionary_encode(pa.array(np.concatenate([k for _, k, _ in parts])))
        distinct, tokens = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order, self.cuts = _grouped(_bucket(distinct, buckets), buckets)
        place = np.zeros(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.vocabulary, self.tokens = distinct[order], place[tokens]

    def counts(self) -> np.ndarray:
        """Occurrences of each word, and of the end after the words, in the rows learnt from."""
        taken = np.repeat(self.rows.column("learnt").to_numpy(), np.diff(self.offsets))
        taken[self.offsets[:-1]] = False
        return np.bincount(self.tokens[taken], minlength=len(self.vocabulary))


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _chunked(buckets: int, key: int):
    """Kind 0: a chunk's tokens as places among its distinct words, these in the order of their buckets, and its rows;
    kind 1: its distinct words and their counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def out(chunk: int) -> Iterator[pa.RecordBatch]:
            whole = Chunk(held, buckets)
            cuts = whole.cuts
            some = _filled(cuts)
            counts = packed_parts([whole.counts()], np.append(cuts[some], cuts[-1]))
            rows = whole.rows.append_column("n_tokens", pa.array(np.diff(whole.offsets) - 1))
            yield from _packets([(_home(chunk, buckets), 0, chunk, 0, packed(whole.tokens), _stream(rows))])
            yield from _packets([(b, 1, chunk, 0, whole.vocabulary[cuts[b] : cuts[b + 1]].tobytes(), c) for b, c in zip(some.tolist(), counts)])

        for batch in pieces(batches):
            keys, offsets = padded(Words(batch.column("text"), key))
            held.append((batch.select(["doc_id", "learnt"]), keys, np.diff(offsets)))
            size += batch.column("text").nbytes
            if size > _CHUNK:
                yield from out((task << 32) + at)
                held, at, size = [], at + 1, 0
        if held:
            yield from out((task << 32) + at)

    return run


def _numbered(buckets: int, least: int):
    """Kind 2: a bucket's kept words' counts in the order of their numbers, its numbers of tokens and of words; kind 3:
    each chunk's words' numbers (0: not kept) and counts, in the order asked. Rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            sizes = [len(k) for _, k, _ in held]
            words, which = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate([c for *_, c in held])).astype(np.int64)
            kept = np.flatnonzero(counts >= least)
            kept = kept[np.lexsort((words[kept], -counts[kept]))]
            numbers = np.zeros(len(words), np.int64)
            numbers[kept] = np.arange(len(kept)) * buckets + last + 1
            yield from _packets([(last, 2, 0, 0, packed(counts[kept]), packed(np.array([counts.sum(), (counts > 0).sum()])))])
            answers = packed_parts([numbers[which], counts[which]], np.cumsum([0, *sizes]))
            yield from _packets([(_home(chunk, buckets), 3, chunk, last, a, b"") for (chunk, *_), a in zip(held, answers)])

        for bucket, _, chunk, _, a, b in _rows(batches):
            if held and bucket != last:
                yield from out()
                held = []
            last = bucket
            held.append((chunk, np.frombuffer(a, np.uint64), unpacked(b)[0]))
        if held:
            yield from out()

    return run


def _coded(buckets: int, scale: float):
    """Kind 4: a chunk as its kept words' numbers, their counts, and its tokens as places among these, from 1; and its rows' plain figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        body: tuple[bytes, bytes] | None = None
        answers: list[list[np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            (tokens,), rows = unpacked(body[0]), pa.ipc.open_stream(body[1]).read_all().combine_chunks()
            # Answers come in the order of buckets, as the chunk's words are.
            numbers, counts = (np.concatenate(x) for x in zip(*answers))
            lengths = rows.column("n_tokens").to_numpy() + 1
            starts = np.cumsum(lengths) - lengths
            kept = np.unique(numbers[numbers > 0])
            places = np.where(numbers > 0, np.searchsorted(kept, numbers) + 1, 0).astype(np.int32)
            often = np.zeros(len(kept), np.int64)
            often[places[places > 0] - 1] = counts[places > 0]
            worth = (np.log10(counts + 1) - np.log10(scale))[tokens]
            worth[starts] = 0
            seen = (counts > 0)[tokens]
            seen[starts] = False
            base, known = np.add.reduceat(worth, starts), np.add.reduceat(seen.astype(np.int64), starts)
            table = pa.table([rows.column("doc_id"), pa.array(~rows.column("learnt").to_numpy()), rows.column("n_tokens"), pa.array(known), pa.array(base)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score"])
            yield from _packets([(_home(last, buckets), 4, last, 0, packed(kept, often, places[tokens]), _stream(table))])

        for _, kind, chunk, _, a, b in _rows(batches):
            if body and chunk != last:
                yield from out()
                body, answers = None, []
            last = chunk
            if kind == 0:
                body = a, b
            else:
                answers.append(unpacked(a))
        if body:
            yield from out()

    return run


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers from 0 in order, and the rank of each of `codes`; sorted with their places in the low bits where these fit."""
    bits = len(codes).bit_length()
    if int(codes.max(initial=0)).bit_length() + bits > 63:
        return np.unique(codes, return_inverse=True)
    both = (codes << bits) | np.arange(len(codes))
    both.sort()
    ordered = both >> bits
    fresh = np.ones(len(codes), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(codes), np.int64)
    ranks[both & ((1 << bits) - 1)] = np.cumsum(fresh) - 1
    return ordered[fresh], ranks


class Runs:
    """The distinct runs of 2 to `width` tokens in some rows, a length after the other.

    at: where runs of two kept tokens begin; levels: for each length the runs as (place of the run without its last
    token, last token or 0 where there is none kept), in order, and which of them stands at each of `at`.
    """

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, width: int, chosen: np.ndarray | None = None):
        ends = np.repeat(offsets[1:], np.diff(offsets))
        ok = np.zeros(len(tokens), dtype=bool)
        ok[:-1] = (tokens[:-1] > 0) & (tokens[1:] > 0) & (np.arange(1, len(tokens)) < ends[:-1])
        if chosen is not None:
            ok &= np.repeat(chosen, np.diff(offsets))
        self.at = np.flatnonzero(ok)
        bits = int(tokens.max(initial=0)).bit_length()
        own, end = tokens[self.at].astype(np.int64), ends[self.at]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.first = np.zeros(0, np.int64)
        alive = np.ones(len(own), dtype=bool)
        for n in range(2, width + 1):
            place = self.at + n - 1
            alive = alive & (place < end)
            more = np.where(alive, tokens[np.minimum(place, len(tokens) - 1)], 0)
            alive = more > 0
            codes, own = _ranked((own << bits) | more)
            self.levels.append((codes >> bits, codes & ((1 << bits) - 1), own))
        self.first = self.levels[0][0]

    def buckets(self, numbers: np.ndarray, counts: np.ndarray, buckets: int, hot: float) -> list[np.ndarray]:
        """The bucket of each run of each length, by the number of its first word, or of its first two where that is hot."""
        first, second, _ = self.levels[0]
        key = numbers[first].astype(np.uint64)
        own = np.where(counts[first] > hot, mix(key) + numbers[second].astype(np.uint64), key)
        out = [_bucket(own, buckets)]
        for before, _, _ in self.levels[1:]:
            out.append(out[-1][before])
        return out

    def columns(self) -> list[np.ndarray]:
        """The tokens of each of the longest runs, 0 beyond an end."""
        out, place = [], np.arange(len(self.levels[-1][0]))
        for before, last, _ in reversed(self.levels):
            out.append(last[place])
            place = before[place]
        return [place, *reversed(out)]


def _runs(buckets: int, width: int, hot: float, learnt: bool):
    """Kind 1: the distinct runs in a chunk's rows learnt from, by bucket, sorted, with the counts of their first two words
    and their own. Or, for all rows, kind 2: the distinct runs, and the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, chunk, _, a, b in _rows(batches):
            kept, often, tokens = unpacked(a)
            table = pa.ipc.open_stream(b).read_all()
            offsets = np.concatenate([[0], np.cumsum(table.column("n_tokens").to_numpy() + 1)])
            runs = Runs(tokens, offsets, width, ~table.column("held_out").to_numpy() if learnt else None)
            numbers, often = np.concatenate([[0], kept]), np.concatenate([[0], often])
            order, cuts = _grouped(runs.buckets(numbers, often, buckets, hot)[-1], buckets)
            places = [c[order] for c in runs.columns()]
            own = [numbers[c] for c in places]
            if learnt:
                counts = np.bincount(runs.levels[-1][2], minlength=len(order))
                own += [often[places[0]], often[places[1]], counts[order]]
                yield from _packets([(to, 1, chunk, 0, x, b"") for to, x in _sent(own, cuts).items()])
            else:
                order, others = _grouped((kept - 1) % buckets, buckets)
                whole, words = _sent(own, cuts), _sent([kept[order]], others)
                yield from _packets([(to, 2, chunk, 0, whole.get(to, b""), words.get(to, b"")) for to in sorted(whole.keys() | words.keys())])

    return run


def cutoff(kinds: np.ndarray) -> np.ndarray:
    """The upper 5 % point of half a chi-square with `kinds` degrees of freedom (Wilson and Hilferty)."""
    part = 2 / (9 * kinds)
    return kinds * (1 - part + QUANTILE * np.sqrt(part)) ** 3 / 2


class Contexts:
    """Sums over the kept runs of each of some contexts: of which run which context is, and what decides on its state."""

    def __init__(self, which: np.ndarray, counts: np.ndarray, total: np.ndarray, shorter: np.ndarray):
        """which: each run's context, from 0, in order; total: of each run's context; shorter: log10 of its last word's probability."""
        self.first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x, self.first) if len(x) else np.zeros(0)
        self.which = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(which))))
        self.sums = [np.diff(np.append(self.first, len(which))).astype(float), add(counts.astype(float)), add(10**shorter), add(counts * (np.log(counts) - shorter * np.log(10)))]
        self.total = total[self.first].astype(float)


def states(kinds: np.ndarray, kept: np.ndarray, mass: np.ndarray, gain: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts are states, log10 of their weights for other words, and what a run's count is divided by in one."""
    other, rest = total - kept, np.maximum(1 - mass, 1e-12)
    divergence = gain - kept * np.log(np.maximum(total, 1)) + np.where(other > 0, other * np.log(np.maximum(other, 1) / np.maximum(total, 1) / rest), 0)
    return divergence >= cutoff(kinds), np.log10((other + kinds) / (total + kinds) / rest), total + kinds


def _names(n: int, start: int = 1) -> list[str]:
    return [f"w{k}" for k in range(start, start + n)]


def _added(width: int, least: int, scale: float, hot: float):
    """Sums each bucket's runs and keeps those that occur often enough. Kind 5: runs of two words, their counts, those of
    their first words, and log10 of the last ones' probabilities at the root; kind 6: longer ones of a length (`part`)
    with the occurrences of their contexts; kind 7: sums over the runs of hot words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            # Numbers are kept in 32 bits or in the width they came in, so that a bucket stays small.
            whole = list(zip(*held))
            columns = [np.concatenate(whole[k]).astype(np.uint32, copy=False) for k in range(width)]
            first_often, second_often, counts = (np.concatenate(whole[k]) for k in range(width, width + 3))
            held.clear()
            own, length, whole = columns[0], sum((c > 0).astype(np.uint8) for c in columns), None
            for n in range(2, width + 1):
                codes = own.astype(np.int64)
                codes *= _MOST
                codes += columns[n - 1]
                order = np.argsort(codes)
                codes = codes[order]
                fresh = np.ones(len(codes), dtype=bool)
                fresh[1:] = codes[1:] != codes[:-1]
                starts = np.flatnonzero(fresh)
                del codes
                sums = np.add.reduceat(counts[order], starts, dtype=np.int64)
                first, own = order[starts], np.zeros(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
                own[order] = np.cumsum(fresh, dtype=own.dtype) - 1
                x = np.flatnonzero((sums >= least) & (length[first] >= n))
                at = first[x]
                if n == 2:
                    total, shorter = first_often[at].astype(np.int64), np.log10((second_often[at].astype(np.int64) + 1) / scale)
                    yield from _packets([(last, 5, 0, 0, packed(columns[0][at], columns[1][at], sums[x], total, shorter), b"")])
                    some = np.flatnonzero(total > hot)
                    if len(some):
                        told = Contexts(columns[0][at][some], sums[x][some], total[some], shorter[some])
                        yield from _packets([(last, 7, 0, 0, packed(columns[0][at][some][told.first], *told.sums, told.total), b"")])
                elif len(x):
                    yield from _packets([(last, 6, 0, n, packed(*(c[at] for c in columns[:n]), sums[x], whole[at]), b"")])
                whole = sums[own]

        for bucket, _, _, _, a, _ in _rows(batches):
            if held and bucket != last:
                yield from out()
            last = bucket
            columns = unpacked(a, wide=False)
            columns[0] = np.cumsum(columns[0], dtype=np.uint32)
            held.append(columns)
        if held:
            yield from out()

    return run


def _names(n: int, start: int = 1) -> list[str]:
    return [f"w{k}" for k in range(start, start + n)]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, _, _, _, a, b in _rows(batches):
        totals = unpacked(b)[0]
        yield pa.RecordBatch.from_arrays([pa.array([int(totals[0])]), pa.array([int(totals[1])]), pa.array([len(unpacked(a)[0])])], names=["tokens", "words", "kept"])


_SUMS = ["kinds", "kept", "mass", "gain", "total"]


def _hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for *_, a, _ in _rows(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpacked(a)], names=["w1", *_SUMS])


def _placed(bucket: int, width: int, columns: list[np.ndarray], gains: np.ndarray) -> tuple:
    """Kind 0: runs and what is added to their gains."""
    columns = [np.diff(columns[0], prepend=0), *columns[1:], *[np.zeros(len(gains), np.int64)] * (width - len(columns))]
    return bucket, 0, 0, 0, packed(*columns, gains), b""


def _pair_terms(buckets: int, width: int, hot: float, known: dict[int, tuple[bool, float, float]]):
    """From kind 5: kind 0, the gains of runs of two words; kind 1: the weights of words that are states, by their bucket;
    and kind 8: log10 of the runs' probabilities in the longest state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, _, _, a, _ in _rows(batches):
            first, second, counts, total, shorter = unpacked(a)
            if not len(first):
                continue
            told = Contexts(first, counts, total, shorter)
            state, weight, whole = states(*told.sums, told.total)
            names = first[told.first]
            for k in np.flatnonzero(told.total > hot):
                state[k], weight[k], whole[k] = known[int(names[k])]
            inside = state[told.which]
            value = np.where(inside, np.log10(counts / whole[told.which]), shorter)
            term = np.where(inside, value - weight[told.which] - shorter, 0.0)
            some = np.flatnonzero(term != 0)
            yield from _packets([_placed(bucket, width, [first[some], second[some]], term[some])])
            words = names[state & (told.total <= hot)]
            values = weight[state & (told.total <= hot)]
            order, cuts = _grouped((words - 1) % buckets, buckets)
            yield from _packets([(to, 1, 0, 0, x, b"") for to, x in _sent([words[order], values[order]], cuts).items()])
            yield from _packets([(bucket, 8, 0, 0, packed(first, second, value), b"")])

    return run


def _endings(columns: list[np.ndarray], buckets: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which runs ask for what they end in (all but their first words), by bucket and sorted, and the buckets' cuts in it."""
    key = columns[1].astype(np.uint64)
    where = _bucket(np.where(np.isin(columns[1], hot), mix(key) + columns[2].astype(np.uint64), key), buckets)
    return np.lexsort((*columns[:0:-1], where)), np.concatenate([[0], np.cumsum(np.bincount(where, minlength=buckets))])


def _asking(n: int, buckets: int, hot: np.ndarray):
    """From kind 6: kind 9, what a bucket's (`chunk`) runs of n words end in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, _, _, a, _ in _rows(batches):
            columns = unpacked(a)[:n]
            order, cuts = _endings(columns, buckets, hot)
            yield from _packets([(to, 9, bucket, 0, x, b"") for to, x in _sent([c[order] for c in columns[1:]], cuts).items()])

    return run


class Values:
    """The values of distinct runs of a length, found by their words' numbers."""

    def __init__(self, columns: list[np.ndarray], values: np.ndarray):
        self.levels, own = [], columns[0]
        for column in columns[1:]:
            distinct, own = np.unique(own * _MOST + column, return_inverse=True)
            self.levels.append(distinct)
        self.values = np.zeros(len(values))
        self.values[own] = values

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        own = columns[0]
        for distinct, column in zip(self.levels, columns[1:]):
            codes = own * _MOST + column
            own = np.searchsorted(distinct, codes)
            if len(own) and (own.max() >= len(distinct) or (distinct[own] != codes).any()):
                raise ValueError("a run was kept, but not what it ends in")
        return self.values[own]


def _told_endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 10: what each bucket asked for (kind 9), in the order asked, from what is there (kind 8)."""
    last, found = None, None
    for bucket, kind, chunk, _, a, _ in _rows(batches):
        if bucket != last:
            last, found = bucket, None
        columns = unpacked(a)
        if kind == 8:
            found = Values(columns[:-1], columns[-1])
            continue
        if found is None:
            raise ValueError("a run was kept, but not what it ends in")
        columns[0] = np.cumsum(columns[0])
        yield from _packets([(chunk, 10, 0, bucket, packed(found.find(columns)), b"")])


def _longer_terms(n: int, width: int, buckets: int, hot: np.ndarray):
    """From kind 6 and the answers of each bucket (kind 10), in their order: kind 0, the gains of runs of n words and the
    weights of their contexts that are states; and kind 8 as of runs of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, body = None, b""
        answers: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            *words, counts, total = unpacked(body)
            shorter = np.zeros(len(counts))
            shorter[_endings(words, buckets, hot)[0]] = np.concatenate(answers)
            fresh = np.ones(len(counts), dtype=bool)
            fresh[1:] = np.any([w[1:] != w[:-1] for w in words[:-1]], axis=0)
            told = Contexts(np.cumsum(fresh), counts, total, shorter)
            state, weight, whole = states(*told.sums, told.total)
            inside = state[told.which]
            value = np.where(inside, np.log10(counts / whole[told.which]), shorter)
            term = np.where(inside, value - weight[told.which] - shorter, 0.0)
            some, ones = np.flatnonzero(term != 0), told.first[state]
            rows = [_placed(last, width, [w[some] for w in words], term[some]), _placed(last, width, [w[ones] for w in words[:-1]], weight[state])]
            yield from _packets(rows + ([(last, 8, 0, 0, packed(*words, value), b"")] if n < width else []))

        for bucket, kind, _, _, a, _ in _rows(batches):
            if answers and bucket != last:
                yield from out()
                answers = []
            last = bucket
            if kind == 6:
                body = a
            else:
                answers.append(unpacked(a)[0])
        if answers:
            yield from out()

    return run


def _told(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, _, _, a, _ in _rows(batches):
            columns = unpacked(a)
            columns[0] = np.cumsum(columns[0])
            none = [np.zeros(len(columns[0]), np.int64)] * (width - 1 if kind else 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns[:-1], *none, columns[-1])], names=[*_names(width), "gain"])

    return run


class Model:
    """numbers: packets of the kept words' counts; gains: packets of runs' gains (kind 0) and of single words' weights as
    contexts (kind 1); coded: the texts as numbers; tokens, distinct: N and V."""

    def __init__(self, docs: DataFrame, depth: int = DEPTH, least: int = LEAST, key: int | None = None):
        """Learns from the rows of docs (doc_id, text, learnt) that are learnt."""
        spark = docs.sparkSession
        self.buckets = buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.width = width = depth + 1
        key = fresh_key() if key is None else key
        together = lambda df, *by: df.repartitionById(buckets, F.col("bucket")).sortWithinPartitions(*by)
        asked = written(docs.mapInArrow(_chunked(buckets, key), _PACKET), "chunks")
        numbered = written(together(asked.filter("kind = 1"), "bucket").mapInArrow(_numbered(buckets, least), _PACKET), "numbers")
        totals = numbered.filter("kind = 2").mapInArrow(_totals, "tokens long, words long, kept long").agg(F.sum("tokens"), F.sum("words"), F.max("kept")).first()
        self.tokens, self.distinct, kept = (x or 0 for x in totals)
        if (kept + 1) * buckets >= _MOST:
            raise ValueError(f"more than {_MOST} numbers of words")
        self.scale, self.hot = float(self.tokens + self.distinct + 1), self.tokens / (_HOT * buckets)
        both = asked.filter("kind = 0").unionByName(numbered.filter("kind = 3"))
        self.coded = written(together(both, "chunk", "kind", "part").mapInArrow(_coded(buckets, self.scale), _PACKET), "coded")
        dropped(asked)
        dropped(numbered)
        runs = self.coded.mapInArrow(_runs(buckets, width, self.hot, True), _PACKET)
        counted = written(together(runs, "bucket").mapInArrow(_added(width, least, self.scale, self.hot), _PACKET), "runs")
        sums = counted.filter("kind = 7").mapInArrow(_hot_sums, ", ".join(["w1 long", *(f"{c} double" for c in _SUMS)]))
        sums = sums.groupBy("w1").agg(*(F.sum(c).alias(c) for c in _SUMS[:-1]), F.max("total").alias("total")).toArrow()
        names = sums.column("w1").to_numpy()
        state, weight, whole = states(*(sums.column(c).to_numpy() for c in _SUMS))
        hot = {int(w): (bool(s), float(x), float(t)) for w, s, x, t in zip(names, state, weight, whole)}
        terms = [written(counted.filter("kind = 5").mapInArrow(_pair_terms(buckets, width, self.hot, hot), _PACKET), "terms")]
        for n in range(3, width + 1):
            longer = counted.filter(f"kind = 6 and part = {n}")
            asking = terms[-1].filter("kind = 8").unionByName(longer.mapInArrow(_asking(n, buckets, names), _PACKET))
            endings = together(asking, "bucket", "kind").mapInArrow(_told_endings, _PACKET)
            rows = together(longer.unionByName(endings), "bucket", "kind", "part")
            terms.append(written(rows.mapInArrow(_longer_terms(n, width, buckets, names), _PACKET), "terms"))
        dropped(counted)
        first = [(w, x) for w, (s, x, _) in sorted(hot.items()) if s]
        packets = list(_packets([((w - 1) % buckets, 1, 0, 0, packed(np.array([w]), np.array([x])), b"") for w, x in first]))
        self._terms = terms
        self.gains = spark.createDataFrame(pa.Table.from_batches(packets)) if packets else spark.createDataFrame([], _PACKET)
        for table in terms:
            self.gains = self.gains.unionByName(table.filter("kind < 2"))

    def told(self) -> DataFrame:
        """(w1, ..., gain): what each run adds, 0 beyond its end; a run may have several rows."""
        return self.gains.mapInArrow(_told(self.width), ", ".join([*(f"{w} long" for w in _names(self.width)), "gain double"]))

    def drop(self) -> None:
        for table in (*self._terms, self.coded):
            dropped(table)


class Gains:
    """The runs of a bucket with their gains, found by their words' numbers."""

    def __init__(self, columns: list[np.ndarray], gains: np.ndarray, base: int):
        length = sum((c > 0).astype(np.int64) for c in columns)
        own, self.levels, self.base = columns[0], [], base
        for n in range(2, len(columns) + 1):
            codes, some = own * base + columns[n - 1], length >= n
            distinct = np.unique(codes[some])
            own = np.searchsorted(distinct, codes)
            gain = np.bincount(own[length == n], weights=gains[length == n], minlength=len(distinct))
            self.levels.append((distinct, gain))

    def find(self, columns: list[np.ndarray], starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length the gains of the beginnings of distinct runs, which are sorted in each part: once for each
        distinct one, in order, and the parts' starts among them."""
        fresh = np.zeros(len(columns[0]), dtype=bool)
        fresh[starts] = True
        fresh[1:] |= columns[0][1:] != columns[0][:-1]
        own = columns[0]
        for (distinct, gain), column in zip(self.levels, columns[1:]):
            fresh[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(fresh)
            x = column[first] > 0
            asked = np.flatnonzero(x & (own[first] >= 0))
            codes = own[first[asked]] * self.base + column[first[asked]]
            at, place = np.searchsorted(distinct, codes), np.full(len(first), -1)
            right = at < len(distinct)
            right[right] = distinct[at[right]] == codes[right]
            place[asked[right]] = at[right]
            gains = np.zeros(len(first))
            gains[asked[right]] = gain[at[right]]
            yield gains[x], np.searchsorted(first[x], starts)
            own = place[np.cumsum(fresh) - 1]


#: Runs that are looked up at once.
_ASKED = 1 << 17


def _answered(buckets: int, width: int, base: int):
    """Answers what chunks ask of each bucket, in the order asked, at the chunk's own bucket: which are found, and their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, found, size = None, {}, None, 0
        asked: list[tuple[int, list[np.ndarray], list[np.ndarray]]] = []

        def built() -> tuple[Gains, tuple[np.ndarray, np.ndarray]]:
            whole = [np.concatenate(x) for x in zip(*held.get(0, []))] or [np.zeros(0, np.int64)] * width + [np.zeros(0)]
            words = [np.concatenate(x) for x in zip(*held.get(1, []))] or [np.zeros(0, np.int64), np.zeros(0)]
            order = np.argsort(words[0])
            return Gains(whole[:-1], whole[-1], base), (words[0][order], words[1][order])

        def out() -> Iterator[pa.RecordBatch]:
            lengths = [len(c[0]) for _, c, _ in asked]
            levels = list(found[0].find([np.concatenate(x) for x in zip(*(c for _, c, _ in asked))], (np.cumsum(lengths) - lengths)[np.array(lengths) > 0]))
            levels = [(gains, np.append(starts, len(gains)).tolist()) for gains, starts in levels]
            keys, values = found[1]
            words = np.concatenate([w for *_, w in asked])
            at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
            weights = np.where(keys[at] == words, values[at], 0.0) if len(keys) else np.zeros(len(words))
            rows, part, start = [], 0, 0
            for (chunk, columns, own), n in zip(asked, lengths):
                gains = np.concatenate([g[cuts[part] : cuts[part + 1]] for g, cuts in levels]) if n else np.zeros(0)
                rows.append((_home(chunk, buckets), 2, chunk, last, _some(gains), _some(weights[start : start + len(own)])))
                part, start = part + (n > 0), start + len(own)
            yield from _packets(rows)

        for bucket, kind, chunk, _, a, b in _rows(batches):
            if asked and (bucket != last or size > _ASKED):
                yield from out()
                asked, size = [], 0
            if bucket != last:
                last, held, found = bucket, {}, None
            if kind < 2:
                columns = unpacked(a)
                columns[0] = np.cumsum(columns[0])
                held.setdefault(kind, []).append(columns)
                continue
            if found is None:
                found, held = built(), {}
            columns = unpacked(a) if a else [np.zeros(0, np.int64)] * width
            columns[0] = np.cumsum(columns[0])
            asked.append((chunk, columns, np.cumsum(unpacked(b)[0]) if b else np.zeros(0, np.int64)))
            size += len(columns[0])
        if asked:
            yield from out()

    return run


def _some(gains: np.ndarray) -> bytes:
    """Which gains aren't 0, and these."""
    if not len(gains):
        return b""
    some = gains != 0
    return packed(np.packbits(some), gains[some])


def _gains(answers: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The gains of all answers, one after the other."""
    parts = [(*unpacked(a, wide=False), n) for a, n in zip(answers, lengths.tolist()) if n]
    out = np.zeros(lengths.sum())
    if parts:
        out[np.concatenate([np.unpackbits(bits, count=n) for bits, _, n in parts]).astype(bool)] = np.concatenate([x for _, x, _ in parts])
    return out


def _finished(buckets: int, width: int, hot: float, tokens_learnt: int):
    """Scores the rows of each chunk; its answers come first."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, tuple[bytes, bytes]] = {}
        for _, kind, chunk, part, a, b in _rows(batches):
            if kind < 4:
                answers[part] = a, b
                continue
            kept, often, tokens = unpacked(a)
            table = pa.ipc.open_stream(b).read_all()
            offsets = np.concatenate([[0], np.cumsum(table.column("n_tokens").to_numpy() + 1)])
            numbers, often = np.concatenate([[0], kept]), np.concatenate([[0], often])
            told = [answers.get(to, (b"", b"")) for to in range(buckets)]
            answers = {}
            weight = np.zeros(len(numbers))
            order, cuts = _grouped((kept - 1) % buckets, buckets)
            weight[order + 1] = _gains([b for _, b in told], np.diff(cuts))
            gain = weight[tokens]
            gain[offsets[1:] - 1] = 0  # the last end is no context
            runs = Runs(tokens, offsets, width)
            # A bucket's answer has its runs of two words, then those of three and so on; runs with no kept last word aren't asked for.
            parts = [_grouped(np.where(last > 0, where, buckets), buckets) for where, (_, last, _) in zip(runs.buckets(numbers, often, buckets, hot), runs.levels)]
            sizes = [np.diff(cuts) for _, cuts in parts]
            whole = _gains([a for a, _ in told], sum(sizes))
            start = np.cumsum(sum(sizes)) - sum(sizes)
            for (order, cuts), size, (_, _, which) in zip(parts, sizes, runs.levels):
                value = np.zeros(len(order))
                value[order[: cuts[-1]]] = whole[np.arange(cuts[-1]) + np.repeat(start - cuts[:-1], size)]
                gain[runs.at] += value[which]
                start = start + size
            base = table.column("base_score").to_numpy()
            some = [table.column(c).combine_chunks() for c in names[:4]]
            yield pa.RecordBatch.from_arrays([*some, pa.array(np.full(len(base), tokens_learnt, np.int64)), pa.array(base), pa.array(base + np.add.reduceat(gain, offsets[:-1]))], names=names)

    return run


def scored(docs: DataFrame, learnt: str = "crc32(coalesce(cast(doc_id as string), '')) % 7 <> 2", depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text; others ignored).

    The SQL condition `learnt` on doc_id tells the rows that are learnt from; held_out marks the others. Tokens are
    the text's words and one end. base_score sums log10((c + 1) / (N + V + 1)) over tokens, c being a token's count
    in the rows learnt from, N all counts, V distinct tokens; n_known counts tokens with c > 0. score is the suffix
    tree's log10 probability of the words and the end. Whole texts are read, of any length.

    A null text counts as empty: its one token is the end. A null doc_id counts as an empty string in `learnt`.
    Repeated rows are counted and returned each. Where nothing is learnt, N = V = 0 and the tree is its root.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr(f"coalesce({learnt}, false)").alias("learnt"))
    model = Model(source, depth, least)
    buckets, width = model.buckets, model.width
    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    results: list[DataFrame] = []
    for k in range(PASSES):
        coded = model.coded.filter(F.pmod(F.xxhash64("chunk"), F.lit(PASSES)) == k)
        packets = model.gains.unionByName(coded.mapInArrow(_runs(buckets, width, model.hot, False), _PACKET))
        asked = packets.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")
        answers = written(asked.mapInArrow(_answered(buckets, width, _MOST), _PACKET), "answers")
        final = answers.unionByName(coded).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("chunk", "kind")
        results.append(written(final.mapInArrow(_finished(buckets, width, model.hot, model.tokens), fields), "scores"))
        dropped(answers)
    model.drop()
    return reduce(DataFrame.unionByName, results)
