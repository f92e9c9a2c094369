"""Merging the heads of all clients of a branch into one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import codec
from ..sources.store import Store
from ..tables import TREE
from . import diff, graph, trees


def snapshot(store: Store, commit: str):
    """(container, hash, seconds) of a commit's containers."""
    row = store.commits().filter(F.col("hash") == commit).first()
    flat = trees.flatten(store.entries(), store.spark.createDataFrame([(row["tree"],)], "root string"), descend=F.col("path") == "containers")
    return diff.containers(flat).select("container", "hash", F.lit(row["author"]["seconds"]).alias("seconds"))


def container(store: Store, name: str, hash_: str) -> diff.Container:
    """A container with the type and version of its settings."""
    entry = store.entries().filter((F.col("tree_hash") == hash_) & (F.col("name") == "config.json")).select(F.col("child_hash").alias("hash"))
    found = entry.join(store.objects, "hash").select(codec.container_config(F.col("body")).alias("c")).select("c.*").first()
    if found is None or found["error"]:
        raise ValueError(f"container {name}: {found['error'] if found else 'missing'}")
    return diff.Container(store, name, found["type"], found["version"], hash_)


def merge_commits(store: Store, base: str, a: str, b: str, mergers: diff.Mergers, committer: tuple, message: str) -> str:
    """A commit of both parents whose containers follow the decision table."""
    rows = diff.container_decisions(snapshot(store, base), snapshot(store, a), snapshot(store, b)).collect()
    kept = {r["container"]: r["hash"] for r in rows if r["decision"] in ("keep", "a", "b")}
    for r in rows:
        if r["decision"] == "merge":
            kept[r["container"]] = mergers.merge(*(container(store, r["container"], r[f"{s}_hash"]) for s in ("base", "a", "b")))
    files = store.spark.createDataFrame([(f"containers/{name}", TREE, None, h) for name, h in sorted(kept.items())], "path string, mode int, body binary, hash string")
    return store.create_commit(store.save_tree(files), [a, b], committer, message)


def reconcile(store: Store, me: str, branch: str, person: tuple, mergers: diff.Mergers | None = None, assume_consistent: bool = False, merge: Callable[[str, str, str, str], str] | None = None) -> str:
    """Moves my ref of a branch to a commit that has all clients' heads behind it, and returns that commit.

    The heads that no other reaches are sorted by author time, then id, and folded from the oldest; each merge's base
    is the first nearest common ancestor. One such head needs no merge. merge(base, a, b, message) can stand in for the
    merging of containers.
    """
    mine = f"refs/remotes/{me}/{branch}"
    heads = store.resolve_branch(branch, assume_consistent)
    own = {ref: commit for ref, _, commit in heads}.get(mine)
    leaves = graph.merge_base(store.edges(), [commit for _, _, commit in heads], store.commits().select(F.col("hash").alias("commit"))).leaves if heads else []
    if not leaves:
        raise LookupError(f"no commits of branch {branch}")
    rows = store.commits().filter(F.col("hash").isin(leaves)).select("hash", "author").orderBy(F.col("author.seconds"), "hash").collect()
    names = [r["author"]["name"] for r in rows]
    if len(rows) == 1:
        if own != rows[0]["hash"]:
            store.update_ref(mine, rows[0]["hash"], person, f"reconcile ({'initial' if own is None else 'fast-forward'}): {names[0]}")
        return rows[0]["hash"]
    at = rows[0]["hash"]
    for k, row in enumerate(rows[1:], 2):
        base = graph.merge_base(store.edges(), [at, row["hash"]]).best
        if not base:
            raise LookupError("no common ancestor")
        message = f"Reconcile clients {', '.join(names[:k])}"
        at = merge(base[0], at, row["hash"], message) if merge else merge_commits(store, base[0], at, row["hash"], mergers or default_mergers(), person, message)
    store.update_ref(mine, at, person, f"reconcile: {', '.join(names)}")
    return at


def default_mergers() -> diff.Mergers:
    known = diff.Mergers()
    known.register(diff.file_merger)
    return known
