"""From raw documents to a training mix: five stages, each written and read again before the next.

A stage takes any table with the columns of `documents` (doc_id, text, source; further ones, of any name, are carried
along) and returns its columns, the last one two more. Null texts count as empty, texts are read whole, and an empty
table gives an empty one. Decisions are made by row: a row without a doc_id, or with one that others have too, stays or
goes by itself, and exactly one of several equal rows stays in the stages that look for copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from quillstone.llm.spread import written
from quillstone.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under 0.7; the labels train the score and never decide themselves.

    An empty text has the score of no evidence; where no label of either kind is left to learn from, all score 0.5
    and go. Rows of equal text stay or go together.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.passed(docs, quality.train(docs, labels))


def keyed(docs: DataFrame, last: bool) -> DataFrame:
    """(row_id, text, document): the rows of docs, each as one struct, with a row_id that no two share: the doc_id, but for rows
    that have none or one that others have too.

    Those get numbers beyond all doc_ids, above them where they are to come last, else below; they are written once,
    so that the numbers stay.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("own"))
    own = F.col("own")
    shared = rows.groupBy(own.alias("shared_id")).agg(F.count("*").alias("n")).filter("shared_id is null or n > 1").select("shared_id")
    if shared.isEmpty():
        return rows.select(own.alias("row_id"), "text", "document")
    shared = written(shared, "shared")
    low, high = rows.agg(F.coalesce(F.min(own), F.lit(0)), F.coalesce(F.max(own), F.lit(0))).first()
    number = F.monotonically_increasing_id() + 1
    same = own.eqNullSafe(F.col("shared_id"))
    odd = rows.join(shared, same, "left_semi").select((F.lit(high) + number if last else F.lit(low) - number).alias("row_id"), "text", "document")
    return rows.join(shared, same, "left_anti").select(own.alias("row_id"), "text", "document").unionByName(written(odd, "odd"))


def by_row(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").alias("doc_id"), "text")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose row_id is not among the dropped doc_ids."""
    return rows.join(dropped.select(F.col("doc_id").alias("row_id")).distinct(), "row_id", "left_anti").select("document.*")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: that of the largest doc_id; one without, or with a shared one, only for want of others.

    All null and empty texts are one group.
    """
    ship(spark)
    rows = keyed(docs, last=False)
    return without(rows, exact_dedup.exact_duplicates(by_row(rows)).filter("not kept"))


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles, similarity 0.8 or more): that of the smallest doc_id;
    one without, or with a shared one, only for want of others. Texts without words stay, each by itself."""
    ship(spark)
    rows = keyed(docs, last=True)
    return without(rows, near_dedup.near_duplicates(by_row(rows)).filter("not kept"))


def unleaked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold at least 0.8 of a benchmark item's shingles; texts without words hold nothing and stay."""
    ship(spark)
    rows = keyed(docs, last=True)
    return without(rows, decontaminate.leaks(by_row(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated to their sources' target weights and shuffled; each row tells its copy and place.

    Rows without a doc_id draw by their text; repeated rows draw alike; a null source is one source.
    """
    ship(spark)
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", unlike_documents),
    ("decontamination", unleaked_documents),
    ("source_mix", source_mix),
]

#: Scores of the first stage have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
