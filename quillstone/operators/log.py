"""The append-only log: records numbered from 0, addressed by the base-256 digits of their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..tables import TREE, written

FAN_OUT = 256


def width(count: int) -> int:
    """Levels of the tree that holds `count` records: the least w >= 1 with 256 ** w >= count."""
    w = 1
    while FAN_OUT**w < count:
        w += 1
    return w


def address(number: Column, levels: int) -> Column:
    """The path of a record, one two-digit name a level."""
    hexed = F.lower(F.hex(number))
    wide = F.raise_error(F.concat(F.lit(f"more than {levels} levels: "), number.cast("string"))).cast("string")
    digits = F.when(F.length(hexed) > 2 * levels, wide).otherwise(F.lpad(hexed, 2 * levels, "0"))
    return F.concat_ws("/", *(F.substring(digits, 2 * k + 1, 2) for k in range(levels)))


def count(paths: DataFrame) -> int:
    """Number of records of a tree listed by (path): one more than the last address, read off the right edge."""
    last = paths.agg(F.max("path")).first()[0]
    return 0 if last is None else int(last.replace("/", ""), 16) + 1


def appended(log: DataFrame, more: DataFrame, order: str = "ord") -> DataFrame:
    """The log (idx, payload) with the rows of more (ord, payload) numbered on after its last."""
    start = log.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("n")).first()[0]
    # Numbered in two steps, so that no window holds all rows: sizes of ranges first, then places within each. The
    # ranges are written in between, so both steps see the same ones.
    parts = written(more.select(order, "payload").repartitionByRange(F.col(order)).withColumn("part", F.spark_partition_id()), "ranges")
    parts = parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(order, "payload")))
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    before, total = {}, start
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return log
    offset = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair))[F.col("part").cast("long")]
    return log.select("idx", "payload").unionByName(parts.select((offset + F.col("k") - 1).alias("idx"), "payload"))


def problems(entries: DataFrame) -> DataFrame:
    """(tree_hash, problem) of log nodes that are wrong: over 256 entries, names with gaps, or files beside directories."""
    number = codec.entry_number(F.col("name"))
    rows = entries.groupBy("tree_hash").agg(
        F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.min(number).alias("low"), F.max(number).alias("high"), F.sum(number.isNull().cast("int")).alias("odd"), F.count_distinct(F.col("mode") == TREE).alias("kinds")
    )
    wrong = F.when(F.col("n") > FAN_OUT, "too many").when((F.col("odd") > 0) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("names") != F.col("n")), "names").when(F.col("kinds") > 1, "mixed")
    return rows.select("tree_hash", wrong.alias("problem")).filter("problem is not null")


class SingleWriter:
    """Refuses a second entry while one is open; it does not wait."""

    def __init__(self) -> None:
        self._open = False

    def __enter__(self) -> "SingleWriter":
        if self._open:
            raise RuntimeError("the log is being written")
        self._open = True
        return self

    def __exit__(self, *_: object) -> None:
        self._open = False


class Log:
    """A log (idx, payload) that is appended to by one writer at a time."""

    def __init__(self, rows: DataFrame):
        self.rows, self._writer = rows, SingleWriter()

    def append(self, more: DataFrame, order: str = "ord") -> None:
        with self._writer:
            self.rows = appended(self.rows, more, order)
