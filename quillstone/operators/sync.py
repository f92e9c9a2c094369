"""Incremental replication between two stores under five consistency levels."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store
from ..tables import TREE, written
from . import diff


class Level(IntEnum):
    """How much of the destination is believed: SKIP nothing is done; TOTAL a commit there has all it needs; COMMIT_TREE
    it has its tree; OBJECT_INTEGRITY each object is what it says; PESSIMISTIC nothing, all is rewritten."""

    SKIP = 0
    TOTAL = 1
    COMMIT_TREE = 2
    OBJECT_INTEGRITY = 3
    PESSIMISTIC = 4


#: Levels of the top commit and of all others, by strategy; fetching has all but the two at the end of a push's own.
STRATEGIES = {
    "fastest": (1, 1),
    "faster_but_risky": (1, 1),
    "fast_and_deepen": (2, 2),
    "default_for_fetch": (2, 2),
    "full_sync_top_commit": (3, 1),
    "default_for_push": (3, 1),
    "full_sync_all": (3, 3),
    "default_for_push_slower_but_safe": (3, 3),
    "overwrite_all": (4, 4),
}


class MissingObject(LookupError):
    pass


class SyncError(Exception):
    """code: RefNotFound or UnableToResolveRef."""

    def __init__(self, code: str, ref: str):
        super().__init__(f"{code}: {ref}")
        self.code, self.ref = code, ref


@dataclass
class Synced:
    """How many objects a synchronisation wrote, and the commits it cut because something was missing."""

    written: int
    cut: list[str]


def missing_objects(needed: DataFrame, there: DataFrame) -> DataFrame:
    """Difference copy: the hashes of needed that are not there."""
    return needed.select("hash").distinct().join(there.select("hash"), "hash", "left_anti")


def _trees(entries: DataFrame, roots: DataFrame, there: DataFrame, source: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(commit, hash) to copy, and (commit) whose trees lack something in the source, for roots (commit, hash).

    Up to COMMIT_TREE a subtree that is there is not entered. Beyond, every directory is entered, so it must be in the
    source; files are copied where they are not there. PESSIMISTIC copies all.
    """
    frontier = roots.select("commit", "hash", F.lit(TREE).alias("mode")).distinct()
    wanted, gaps = [], []
    while True:
        if level <= Level.COMMIT_TREE:
            frontier = frontier.join(there, "hash", "left_anti")
        frontier = written(frontier, "frontier")
        if frontier.isEmpty():
            break
        needed = frontier
        if level == Level.OBJECT_INTEGRITY:
            absent = frontier.join(there, "hash", "left_anti")
            needed = frontier.filter(F.col("mode") == TREE).unionByName(absent.filter(F.col("mode") != TREE))
            wanted.append(absent.select("commit", "hash"))
        else:
            wanted.append(frontier.select("commit", "hash"))
        gaps.append(needed.join(source, "hash", "left_anti").select("commit"))
        inner = frontier.filter(F.col("mode") == TREE).select("commit", F.col("hash").alias("tree_hash"))
        frontier = inner.join(entries, "tree_hash").filter(F.col("mode") != 0o160000).select("commit", F.col("child_hash").alias("hash"), "mode").distinct()
    none = roots.select("commit", "hash").limit(0)
    return reduce(DataFrame.unionByName, wanted, none), reduce(DataFrame.unionByName, gaps, none.select("commit")).distinct()


def sync_commits(source: Store, target: Store, top: str, top_level: int, other_level: int, allow_shallow: bool = True) -> Synced:
    """Copies a commit and what it needs. A commit whose tree is incomplete in the source is left out with all that is
    reached only through it; that is an error for the top commit, and for any if not allow_shallow.

    Trees and blobs are written before commits, all in one step each.
    """
    if top_level == Level.SKIP or top_level < other_level:
        raise ValueError("the top commit's level must not be SKIP nor below the others'")
    spark = source.spark
    there, have = written(target.objects.select("hash"), "there"), written(source.objects.select("hash"), "have")
    commits = written(source.commits().select("hash", "tree", "parents"), "commits")
    entries = written(source.entries(), "entries")
    frontier = written(spark.createDataFrame([(top,)], "commit string"), "frontier")
    seen, bodies, made, cut, level = frontier, [], [], [], top_level
    while not frontier.isEmpty() and level != Level.SKIP:
        at = frontier.join(there.withColumnRenamed("hash", "commit").withColumn("present", F.lit(True)), "commit", "left").withColumn("present", F.coalesce("present", F.lit(False)))
        if level == Level.TOTAL:
            at = at.filter("not present")
        at = written(at.join(commits.withColumnRenamed("hash", "commit"), "commit", "left"), "at")
        check = at.filter("tree is not null") if level >= Level.OBJECT_INTEGRITY else at.filter("tree is not null and not present")
        copy, gaps = _trees(entries, check.select("commit", F.col("tree").alias("hash")), there, have, level)
        gone = written(gaps.unionByName(at.filter("tree is null").select("commit")).distinct(), "gone")
        lost = [r["commit"] for r in gone.orderBy("commit").collect()]
        if lost and (level is top_level and top in lost or not allow_shallow):
            raise MissingObject(f"incomplete in the source: {lost[0]}")
        cut += lost
        fine = written(at.join(gone, "commit", "left_anti"), "fine")
        bodies.append(copy.join(fine.select("commit"), "commit", "left_semi").select("hash"))
        made.append((fine if level == Level.PESSIMISTIC else fine.filter("not present")).select(F.col("commit").alias("hash")))
        step = fine.select(F.explode("parents").alias("commit")).distinct().join(seen, "commit", "left_anti")
        frontier = written(step, "frontier")
        seen, level = seen.unionByName(frontier), other_level
    total = 0
    rewrite = Level.PESSIMISTIC in (top_level, other_level)
    for parts in (bodies, made):
        if not parts:
            continue
        wanted = reduce(DataFrame.unionByName, parts).distinct()
        rows = written(source.objects.join(wanted, "hash", "left_semi"), "copied")
        total += rows.count()
        target.add(rows, overwrite=rewrite)
    return Synced(total, cut)


def try_sync(source: Store, target: Store, top: str, top_level: int, other_level: int) -> bool:
    try:
        sync_commits(source, target, top, top_level, other_level)
    except MissingObject:
        return False
    return True


def sync_ref(source: Store, target: Store, ref: str, strategy: str, operation: str, use_journal: bool) -> str:
    """Brings a ref over with its commits; with use_journal, the newest journal entry that can be had stands in for it."""
    top_level, other_level = STRATEGIES[strategy]
    head, old = source.get_ref(ref), target.get_ref(ref)
    if head is None:
        raise SyncError("RefNotFound", ref)
    candidates = [head]
    if use_journal:
        candidates += [r["new"] for r in source.get_journal(ref).orderBy(F.desc("seq")).select("new").collect()]
    for commit in candidates:
        if top_level == Level.TOTAL and old == commit:
            return commit
        if try_sync(source, target, commit, top_level, other_level):
            if commit != old:
                row = target.commits().filter(F.col("hash") == commit).first()
                target.update_ref(ref, commit, tuple(row["author"]), f"{operation}: {row['message']}")
            return commit
    raise SyncError("UnableToResolveRef", ref)


def fetch_ref(local: Store, remote: Store, ref: str, strategy: str = "default_for_fetch") -> str:
    return sync_ref(remote, local, ref, strategy, "fetch", True)


def push_ref(local: Store, remote: Store, ref: str, strategy: str = "default_for_push") -> str:
    return sync_ref(local, remote, ref, strategy, "push", False)


def fetch_refs(local: Store, remote: Store, me: str, branch: str | None = None, strategy: str = "default_for_fetch") -> list[str]:
    """Fetches every other client's branch; refs that are gone or not yet whole are passed over. Returns those that came."""
    done = []
    for row in diff.other_clients(remote.refs, me, branch).orderBy("ref").collect():
        try:
            fetch_ref(local, remote, row["ref"], strategy)
            done.append(row["ref"])
        except SyncError:
            continue
    return done
