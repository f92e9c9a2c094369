"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

A document of a source with mean repetition rate r appears n times, n being the inverse Poisson distribution function
at a number in [0, 1) hashed from a seed and the document; so a rerun, a lost executor or another partitioning gives
the same mix. Rates above PART are split into equal independent parts, so no sum underflows. The copies are then
shuffled globally: a hash of seed, document and copy gives each its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import joined

#: The largest mean that one inversion handles.
PART = 64
#: Sources up to this number are broadcast with their rates (at most some 200 numbers each); more are shuffled.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def document_key(df: DataFrame) -> Column:
    """What a document's draws are hashed from: its doc_id, or its text where that is null."""
    text = F.col("text").cast("string") if "text" in df.columns else F.lit("")
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def rates(docs: DataFrame, weights: DataFrame | None = None, mean_rate: float = 1.0, temperature: float = 0.5) -> DataFrame:
    """(source, rate): each source's mean repetition rate, so that the mix has mean_rate times the rows and the target shares.

    weights has source and weight; a source that it lacks, or whose weight is null or negative, gets none of the mix.
    Without weights a source's weight is its number of rows to the power `temperature`. A null source is one source.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("of")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    # Decimals add up to the same in any order, so a rerun has the same rates.
    whole = F.sum(F.col("weight").cast("decimal(38,12)")).cast("double")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(whole, F.lit(0.0)).alias("w")).first()
    share = F.col("weight") / F.lit(float(total["w"]) or 1.0)
    return sizes.select("source", (share * F.lit(mean_rate * total["n"]) / F.col("n")).alias("rate"))


def cumulative(mean: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ... to where it is one in double precision."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.array_append(s["all"], s["c"] + p).alias("all"))

    return F.aggregate(steps, start, step, lambda s: s["all"])


def mixed(docs: DataFrame, weights: DataFrame | None = None, mean_rate: float = 1.0, temperature: float = 0.5, seed: str = "mix") -> DataFrame:
    """The mix: all columns of docs, then copy (0, 1, ... among a document's copies) and place (its hashed place, by which rows are ordered).

    docs needs doc_id and source. Columns of docs named copy or place are replaced. Texts of any length, null or empty,
    are carried along. Rows without a doc_id draw by their text. Repeated rows draw alike, so each appears as often.
    An empty table gives an empty mix.
    """
    docs = docs.drop("copy", "place")
    row, rate = "document", "rated"
    table = rates(docs, weights, mean_rate, temperature)
    parts = F.greatest(F.ceil(F.col("rate") / PART).cast("int"), F.lit(1))
    table = table.select(F.struct(F.col("source").alias("of"), parts.alias("parts"), cumulative(F.col("rate") / parts).alias("steps")).alias(rate)).filter(F.col(f"{rate}.steps").isNotNull())
    # All columns of docs travel in one, so that no name of theirs can clash with one of ours.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), document_key(docs).alias("key"), F.col("source").alias("of"))
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rated = whole.join(F.broadcast(table), F.col("of").eqNullSafe(F.col(f"{rate}.of")), "left")
    else:
        name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
        rated = joined(whole.withColumn("name", name(F.col("of"))), table.withColumn("name", name(F.col(f"{rate}.of"))), "name", "left")
    draws = F.transform(F.sequence(F.lit(0), F.col(f"{rate}.parts") - 1), lambda j: uniform(F.lit(seed), F.col("key"), j.cast("string")))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col(f"{rate}.steps"), lambda c: c <= u)))
    counted = rated.select(row, "key", copies.alias("copies")).filter("copies > 0")
    each = counted.select(row, "key", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    place = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), F.col("key"), F.col("copy").cast("string"))), 1, 16)
    each = each.select(*(F.col(row).getField(c).alias(c) for c in docs.columns), "copy", place.alias("place"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / float(1 << 32) * tasks).cast("int")
    return each.repartitionById(tasks, at).sortWithinPartitions("place", "doc_id", "copy")
