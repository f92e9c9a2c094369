"""Histories as tables of edges (child, parent, ord): walks, first-parent logs, merge bases, latest valid commits.

Loops are driven by frontiers. A round joins the frontier to the edges and leaves out what was seen; each round's
table is written in the shared folder, so a plan never grows with the history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def walk(edges: DataFrame, heads: DataFrame, descend: Column | None = None) -> DataFrame:
    """(commit, depth): everything that the heads (commit) reach, once each, with its least number of hops.

    descend, a condition on `commit`, tells whether a commit's parents are looked at.
    """
    seen = written(heads.select("commit").dropna().distinct().withColumn("depth", F.lit(0)), "walk")
    depth = 0
    while True:
        frontier = seen.filter(F.col("depth") == depth)
        if descend is not None:
            frontier = frontier.filter(descend)
        step = frontier.join(edges, F.col("commit") == F.col("child")).select(F.col("parent").alias("commit")).distinct()
        step = step.join(seen.select("commit"), "commit", "left_anti").withColumn("depth", F.lit(depth + 1))
        step = written(step, "walk")
        if step.isEmpty():
            return seen
        seen, depth = seen.unionByName(step), depth + 1
        if depth % 8 == 0:
            seen = written(seen, "walk")


def first_parents(edges: DataFrame, head: str) -> DataFrame:
    """(commit, depth) along first parents alone: jumps of 1, 2, 4, ... parents, so a chain of n commits takes log2(n) rounds."""
    jumps = written(edges.filter("ord = 0").select("child", "parent"), "jumps")
    known = written(edges.sparkSession.createDataFrame([(head, 0)], "commit string, depth int"), "chain")
    reach, most = 1, jumps.count()
    while reach <= 2 * most:
        step = written(known.join(jumps, F.col("commit") == F.col("child")).select(F.col("parent").alias("commit"), (F.col("depth") + reach).alias("depth")), "chain")
        if step.isEmpty():
            break
        known = written(known.unionByName(step), "chain")
        far = jumps.select(F.col("child").alias("parent"), F.col("parent").alias("far"))
        jumps, reach = written(jumps.join(far, "parent").select("child", F.col("far").alias("parent")), "jumps"), 2 * reach
    return known


@dataclass
class MergeBase:
    best: list[str]
    leaves: list[str]


def marks(edges: DataFrame, heads: list[str]) -> tuple[DataFrame, int | None]:
    """(head, commit, d, trail) for all commits that a search from all heads at once has marked, and the last round.

    The search ends in the first round in which a commit bears every head's mark. trail is the least list of parent
    ordinals on a shortest way. One row a head and commit is kept, so a history of diamonds does not multiply. The
    round is None where the heads have no common ancestor.
    """
    spark = edges.sparkSession
    rows = [(k, h, 0, []) for k, h in enumerate(heads)]
    seen = written(spark.createDataFrame(rows, "head int, commit string, d int, trail array<int>"), "marks")
    r = 0
    while True:
        covered = seen.groupBy("commit").agg(F.count("*").alias("n")).filter(F.col("n") == len(heads))
        if not covered.isEmpty():
            return seen, r
        step = seen.filter(F.col("d") == r).join(edges, F.col("commit") == F.col("child"))
        step = step.select("head", F.col("parent").alias("commit"), F.concat("trail", F.array(F.col("ord").cast("int"))).alias("trail"))
        step = step.groupBy("head", "commit").agg(F.min("trail").alias("trail")).join(seen.select("head", "commit"), ["head", "commit"], "left_anti")
        step = written(step.select("head", "commit", F.lit(r + 1).alias("d"), "trail"), "marks")
        if step.isEmpty():
            return seen, None
        seen, r = seen.unionByName(step), r + 1
        if r % 8 == 0:
            seen = written(seen, "marks")


def merge_base(edges: DataFrame, heads: list[str], known: DataFrame | None = None, exact: bool = False) -> MergeBase:
    """The nearest common ancestors of the heads, and those heads that no other head is known to reach.

    Heads are taken once each, in order. `best` comes in the order in which the search meets it: by the last head that
    reaches it in the last round, then by the least way from there. Leaves are judged by the marks set when the search
    ends. known (commit) are the commits that can be read: if no base is found and a marked one is not among them, the
    search is not to be trusted and raises. exact leaves out bases that others of them reach.
    """
    heads = list(dict.fromkeys(heads))
    if not heads:
        return MergeBase([], [])
    seen, r = marks(edges, heads)
    if r is None and known is not None:
        missing = seen.select("commit").distinct().join(known.select("commit"), "commit", "left_anti").orderBy("commit").first()
        if missing:
            raise LookupError(f"missing object: {missing['commit']}")
    best: list[str] = []
    if r is not None:
        full = seen.groupBy("commit").agg(F.count("*").alias("n"), F.max(F.when(F.col("d") == r, F.struct("head", "d"))).alias("last")).filter(F.col("n") == len(heads))
        full = full.join(seen, [full["commit"] == seen["commit"], F.col("last.head") == F.col("head")]).select(full["commit"], "head", "trail")
        best = [row["commit"] for row in full.orderBy("head", "trail", "commit").collect()]
    counts = seen.join(F.broadcast(edges.sparkSession.createDataFrame([(h,) for h in heads], "commit string")), "commit").groupBy("commit").count().collect()
    single = {row["commit"] for row in counts if row["count"] == 1}
    if exact and len(best) > 1:
        spark = edges.sparkSession
        above = {b: {x["commit"] for x in walk(edges, spark.createDataFrame([(b,)], "commit string")).filter("depth > 0").collect()} for b in best}
        best = [b for b in best if not any(b in above[o] for o in best if o != b)]
    return MergeBase(best, [h for h in heads if h in single])


def latest(journal: DataFrame, valid: Column | None = None, keys: tuple[str, ...] = ("ref",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The newest entry of each key that passes `valid`: one aggregate with partial maxima, no sort of a key's journal."""
    rows = journal if valid is None else journal.filter(valid)
    rest = [c for c in journal.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("newest"))
    return newest.select(*keys, *(F.col(f"newest.{c}").alias(c) for c in rest))


def previous(journal: DataFrame, keys: tuple[str, ...] = ("ref",), order: tuple[str, ...] = ("seq",), value: str = "new") -> DataFrame:
    """The journal with `previous`: the value of the entry before in the same key."""
    return journal.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def find_commit(edges: DataFrame, journal: DataFrame, ref: str, head: str | None, valid: DataFrame) -> str | None:
    """The first valid commit (valid: commit) along the head's first parents; else the newest valid one in the ref's journal."""
    if head is not None:
        chain = first_parents(edges, head).join(valid.select("commit"), "commit")
        found = chain.orderBy("depth").first()
        if found:
            return found["commit"]
    entries = journal.filter(F.col("ref") == ref).withColumn("commit", F.col("new")).join(valid.select("commit"), "commit", "left_semi")
    found = latest(entries).first()
    return found["new"] if found else None
