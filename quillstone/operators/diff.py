"""Two- and three-way comparison of listings, and the rules by which containers are reconciled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec


def modified(a_kind: Column, a_hash: Column, b_kind: Column, b_hash: Column) -> Column:
    """Whether an entry differs: present on one side, another kind, or a file of another hash; two directories never do."""
    return (
        F.when(a_kind.isNull() & b_kind.isNull(), False)
        .when(a_kind.isNull() | b_kind.isNull(), True)
        .when(a_kind != b_kind, True)
        .when(a_kind == "directory", False)
        .otherwise(~a_hash.eqNullSafe(b_hash))
    )


def three_way(base: DataFrame, a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """Each key of any side with both sides' hashes and its class: unchanged, a, b or both. Sides: key, kind, hash."""
    side = lambda df, s: df.select(key, F.col("kind").alias(f"{s}_kind"), F.col("hash").alias(f"{s}_hash"))
    rows = side(base, "base").join(side(a, "a"), key, "full_outer").join(side(b, "b"), key, "full_outer")
    changed = {s: modified(F.col("base_kind"), F.col("base_hash"), F.col(f"{s}_kind"), F.col(f"{s}_hash")) for s in "ab"}
    rows = rows.withColumns({f"{s}_changed": c for s, c in changed.items()})
    return rows.withColumn("class", F.when(F.col("a_changed") & F.col("b_changed"), "both").when(F.col("a_changed"), "a").when(F.col("b_changed"), "b").otherwise("unchanged"))


def merged_files(rows: DataFrame, take_changes: bool = False) -> DataFrame:
    """The result of a three-way comparison: always side a; or, if asked, the side that changed, and conflicts told."""
    if not take_changes:
        return rows.withColumn("result_hash", F.col("a_hash")).withColumn("conflict", F.lit(False))
    both = (F.col("class") == "both") & ~(F.col("a_hash").eqNullSafe(F.col("b_hash")) & F.col("a_kind").eqNullSafe(F.col("b_kind")))
    return rows.withColumn("result_hash", F.when(F.col("class") == "b", F.col("b_hash")).otherwise(F.col("a_hash"))).withColumn("conflict", both)


def container_decisions(base: DataFrame, a: DataFrame, b: DataFrame, older_wins: bool = False) -> DataFrame:
    """(container, decision, hash) from the containers (container, hash, seconds) of two snapshots and their base.

    keep: equal on both sides, or on one side and not in the base; merge: on all three and unequal; a or b: new on
    both sides and unequal (a, or the older by seconds if older_wins); delete: gone on one side, changed or not.
    """
    side = lambda df, s: df.select("container", F.col("hash").alias(f"{s}_hash"), F.col("seconds").alias(f"{s}_s"))
    rows = side(a, "a").join(side(b, "b"), "container", "full_outer").join(side(base, "base"), "container", "left")
    both = F.col("a_hash").isNotNull() & F.col("b_hash").isNotNull()
    b_older = F.lit(older_wins) & F.coalesce(F.col("b_s") < F.col("a_s"), F.lit(False))
    decision = (
        F.when(both & (F.col("a_hash") == F.col("b_hash")), "keep")
        .when(both & F.col("base_hash").isNotNull(), "merge")
        .when(both, F.when(b_older, "b").otherwise("a"))
        .when(F.col("base_hash").isNotNull(), "delete")
        .otherwise("keep")
    )
    rows = rows.withColumn("decision", decision)
    taken = F.when(F.col("decision") == "b", F.col("b_hash")).when(F.col("decision").isin("merge", "delete"), None).otherwise(F.coalesce("a_hash", "b_hash"))
    return rows.select("container", "decision", taken.alias("hash"), "a_hash", "b_hash", "base_hash")


def containers(flat: DataFrame) -> DataFrame:
    """(root, container, hash): the directories right under `containers` of flattened snapshots; raises where that is missing."""
    from ..tables import TREE

    missing = flat.select("root").distinct().join(flat.filter("path = 'containers'").select("root"), "root", "left_anti").first()
    if missing:
        raise LookupError(f"no containers in {missing['root']}")
    here = codec.is_immediate_parent_of(F.lit("containers"), F.col("path")) & (F.col("mode") == TREE)
    return flat.filter(here).select("root", F.col("name").alias("container"), "hash")


@dataclass
class Container:
    """A container's snapshot as the mergers see it."""

    store: object
    name: str
    type: str
    version: str
    hash: str


class Mergers:
    """Registered container mergers; the first that returns something decides."""

    def __init__(self) -> None:
        self._known: list[Callable[[Container, Container, Container], str | None]] = []

    def register(self, merger: Callable[[Container, Container, Container], str | None]) -> None:
        self._known.append(merger)

    def merge(self, base: Container, a: Container, b: Container) -> str:
        if not (base.store is a.store is b.store):
            raise ValueError("containers of different stores cannot be merged")
        if len({(c.type, c.version) for c in (base, a, b)}) != 1:
            raise ValueError("containers of different types cannot be merged")
        for merger in self._known:
            if (found := merger(base, a, b)) is not None:
                return found
        raise LookupError(f"no merger for {a.type} {a.version}")


def file_merger(base: Container, a: Container, b: Container) -> str | None:
    """For directories of files of version 1: side a, as `merged_files` by default."""
    return a.hash if a.type == "filesystem" and a.version == "1" else None


def other_clients(refs: DataFrame, me: str, branch: str | None = None) -> DataFrame:
    """Branch refs of clients other than me, of one branch if given."""
    rows = refs.withColumn("b", codec.parsed_branch(F.col("ref"))).filter("b is not null").select("ref", "hash", "b.client", "b.branch")
    rows = rows.filter(F.col("client") != me)
    return rows if branch is None else rows.filter(F.col("branch") == branch)
