"""Chat formatting with a template seen as a black box.

A template is any function from a list of (role, text) turns to a string. Prefixes of a conversation are rendered one
after the other; what each adds to the last is that turn's span. Probes, in which the newest turn is empty or holds a
character that no template writes, find where its text lies in the span. A template that changes what it wrote before
is detected: the first turn at which it does is reported, and no loss mask is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
_PROBE = "\x00"


def escape(text: str) -> str:
    """Leaves no control string in a text: a backslash is doubled, and one parts `<|`. `unescape` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def marked(turns: list[Turn]) -> str:
    """The default template: each turn between start and end marks; a role's line breaks are escaped too."""
    return "".join(f"<|im_start|>{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}<|im_end|>\n" for role, text in turns)


def parsed(formatted: str) -> list[Turn]:
    """The turns of a string that `marked` made."""
    found = re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", formatted, flags=re.DOTALL)
    return [(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role), unescape(text)) for role, text in found]


@dataclass
class Rendered:
    """A formatted conversation: spans of its turns, spans of their texts, and the first turn that rewrote history."""

    text: str = ""
    turns: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    rewritten_at: int | None = None

    def loss(self, roles: list[str], learnt: str = "assistant") -> list[tuple[int, int]] | None:
        return None if self.rewritten_at is not None else [s for s, role in zip(self.texts, roles) if role == learnt]


def _common(a: str, b: str, start: int) -> int:
    """Length of the common beginning of two strings that agree up to `start`."""
    low, high = start, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[start:middle] == b[start:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def rendered(turns: list[Turn], template: Template = marked) -> Rendered:
    """Renders successive prefixes and compares each with the one before."""
    out = Rendered(template([]))
    for k, (role, text) in enumerate(turns):
        before, prefix = out.text, turns[:k]
        whole = template([*prefix, (role, text)])
        if not whole.startswith(before):
            if out.rewritten_at is None:
                out.rewritten_at = k
        out.turns.append((len(before), len(whole)))
        probe = template([*prefix, (role, _PROBE)])
        start = probe.find(_PROBE, len(before)) if probe.startswith(before) else -1
        if start >= 0:
            out.texts.append((start, len(whole) - (len(probe) - start - 1)))
        else:  # a template that drops the probe, or writes elsewhere
            empty = template([*prefix, (role, "")])
            start = _common(empty, probe, 0)
            out.texts.append((start, len(whole) - (len(empty) - start)))
        out.text = whole
    if out.rewritten_at is not None:
        out.turns, out.texts = [], []
    return out


def _sha(*parts: str) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part.encode("utf-8", "surrogatepass"))
    return digest.hexdigest()


def _formatted(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Turn] = []
        last: tuple | None = None

        def row() -> pa.RecordBatch:
            result = rendered(held, template)
            mask = result.loss([role for role, _ in held])
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            pairs = lambda x: pa.array([None if x is None else [{"start": a, "end": b} for a, b in x]], spans)
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]], pa.int64()), pa.array([result.text], pa.string()), pairs(None if result.rewritten_at is not None else result.turns), pairs(mask), pa.array([result.rewritten_at], pa.int64())],
                names=["conv_id", "formatted", "turn_spans", "loss_spans", "rewritten_at"],
            )

        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if last is not None and last[0] != conv:
                    yield row()
                    held = []
                last = (conv,)
                held.append((role, text))
        if last is not None:
            yield row()

    return run


def formatted(conversations: DataFrame, template: Template = marked) -> DataFrame:
    """(conv_id, formatted, turn_spans, loss_spans, rewritten_at) for each conversation of (conv_id, turn, role, text).

    Spans are in code points, ends exclusive; loss_spans cover the assistants' texts as they stand in the output. They
    are null, as are turn_spans, where the template rewrote history, first at turn number rewritten_at (else null).
    Null roles and texts count as empty; rows come by turn, null turns first, ties by role and text, repeated rows
    each. All rows of a null conv_id make one conversation. Other columns are ignored; an empty table gives no rows.

    A conversation's output is one string, so its rows meet in one task; conversations are spread evenly. Texts of any
    length are read whole. A black box has to be asked for every prefix, twice a turn, so the time of one conversation
    grows with the square of its turns (1.4 s for 2,000 turns of 60 characters on one core).
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    span = "array<struct<start:long,end:long>>"
    return placed.mapInArrow(_formatted(template), f"conv_id long, formatted string, turn_spans {span}, loss_spans {span}, rewritten_at long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
            turns = parsed(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans or [])
            out.append((len(turns), _sha(*(p for role, said in turns for p in (role, "\n", said, "\n"))), len(loss), _sha(loss), len(text)))
        columns = list(zip(*out)) or [[]] * 5
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["conv_id", *names])


def digest(result: DataFrame) -> DataFrame:
    """What a result of `formatted` with the template `marked` says when read back from its strings."""
    return result.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
