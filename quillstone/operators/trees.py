"""Directory trees as tables of entries: flattening, reachability, Merkle roll-up, and N-way traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..tables import TREE, written


def flatten(entries: DataFrame, roots: DataFrame, descend: Column | None = None) -> DataFrame:
    """(root, path, name, mode, hash, depth): files and directories under each root (root).

    Only directories are entered. descend, a condition on the row of a directory, can leave one shut.
    """
    level = roots.select("root", F.col("root").alias("at"), F.lit("").alias("under"))
    found, depth = [], 0
    while True:
        step = level.join(entries, F.col("at") == F.col("tree_hash"))
        step = step.select("root", codec.joined_path(F.col("under"), F.col("name")).alias("path"), "name", "mode", F.col("child_hash").alias("hash"), F.lit(depth).alias("depth"))
        step = written(step, "level")
        if step.isEmpty():
            break
        found.append(step)
        inner = step.filter(F.col("mode") == TREE)
        inner = inner if descend is None else inner.filter(descend)
        level, depth = inner.select("root", F.col("hash").alias("at"), F.col("path").alias("under")), depth + 1
    return reduce(DataFrame.unionByName, found) if found else step


def files(flat: DataFrame) -> DataFrame:
    return flat.filter(codec.is_file(F.col("mode")))


def closure(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, hash): each root and every object below it, once. Equal subtrees are entered once a root."""
    seen = written(roots.select("root", F.col("root").alias("hash"), F.lit(TREE).alias("mode")).distinct(), "closure")
    frontier = seen
    while True:
        step = frontier.filter(F.col("mode") == TREE).join(entries, F.col("hash") == F.col("tree_hash")).select("root", F.col("child_hash").alias("hash"), entries["mode"]).distinct()
        step = written(step.join(seen.select("root", "hash"), ["root", "hash"], "left_anti"), "closure")
        if step.isEmpty():
            return seen.select("root", "hash").distinct()
        seen, frontier = written(seen.unionByName(step), "closure"), step


def fully_reachable(entries: DataFrame, objects: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, complete): whether every object below a root exists in objects (hash)."""
    needed = closure(entries, roots)
    missing = needed.join(objects.select("hash"), "hash", "left_anti").select("root").distinct().withColumn("gap", F.lit(True))
    return roots.select("root").distinct().join(missing, "root", "left").select("root", F.col("gap").isNull().alias("complete"))


def lookup(entries: DataFrame, root: str, path: str) -> DataFrame:
    """The entry at a path below a root: one join a segment, nothing else read."""
    at = entries.sparkSession.createDataFrame([(root,)], "hash string")
    out = at.select(F.lit(TREE).alias("mode"), "hash")
    for name in [s for s in path.split("/") if s]:
        out = out.filter(F.col("mode") == TREE).select(F.col("hash").alias("tree_hash")).join(entries.filter(F.col("name") == name), "tree_hash").select("mode", F.col("child_hash").alias("hash"))
    return out


def roll_up(leaves: DataFrame) -> DataFrame:
    """Trees made from files: (path, hash, body) of every directory, the root having the empty path.

    leaves: path, mode, hash; a row of mode tree is a directory known by its hash and is taken as it is. Directories
    are hashed from the deepest level up, one grouping a level. Without leaves the root is the empty tree.
    """
    empty = leaves.sparkSession.createDataFrame([("",)], "path string").select("path", F.lit(bytearray()).alias("body"))
    rows = written(leaves.select("path", "mode", "hash").withColumn("depth", codec.num_segments(F.col("path"))), "leaves")
    deepest = rows.agg(F.max("depth")).first()[0]
    if not deepest:
        return empty.select("path", codec.object_id(F.lit("tree"), F.col("body")).alias("hash"), "body")
    made: DataFrame | None = None
    above = None
    for depth in range(deepest, 0, -1):
        here = rows.filter(F.col("depth") == depth).select("path", "mode", "hash")
        if above is not None:
            here = here.unionByName(above.select("path", F.lit(TREE).alias("mode"), "hash"))
        entry = F.struct(codec.leaf(F.col("path")).alias("name"), "mode", F.col("hash").alias("child_hash"))
        above = here.groupBy(codec.parent(F.col("path")).alias("path")).agg(codec.tree_body(F.collect_list(entry)).alias("body"))
        above = written(above.select("path", codec.object_id(F.lit("tree"), F.col("body")).alias("hash"), "body"), "level")
        made = above if made is None else made.unionByName(above)
    return made


def traverse(listings: list[DataFrame]) -> DataFrame:
    """One row for each path of any listing (path, kind, hash) with one optional struct a listing, in path order. Of a path
    that a listing repeats the least (kind, hash) counts."""
    sides = [df.groupBy("path").agg(F.min(F.struct("kind", "hash")).alias(f"at_{k}")) for k, df in enumerate(listings)]
    merged = reduce(lambda a, b: a.join(b, "path", "full_outer"), sides)
    return merged.withColumn("depth", codec.num_segments(F.col("path"))).orderBy(codec.segments(F.col("path")))


def reduce_up(rows: DataFrame, value: Column, combine) -> DataFrame:
    """(path, value): a value for each path from its own and those below it, children before parents.

    combine(own, values) makes a column from the path's own value and the array of its children's results.
    """
    own = written(rows.select("path", value.alias("own"), codec.num_segments(F.col("path")).alias("depth")), "own")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    out, below = None, None
    for depth in range(deepest, 0, -1):
        here = own.filter(F.col("depth") == depth)
        if below is None:
            here = here.withColumn("values", F.array().cast(f"array<{own.schema['own'].dataType.simpleString()}>"))
        else:
            sums = below.groupBy(codec.parent(F.col("path")).alias("path")).agg(F.sort_array(F.collect_list("value")).alias("values"))
            here = here.join(sums, "path", "left").withColumn("values", F.coalesce("values", F.array().cast(sums.schema["values"].dataType)))
        below = written(here.select("path", combine(F.col("own"), F.col("values")).alias("value")), "level")
        out = below if out is None else out.unionByName(below)
    return out if out is not None else own.select("path", F.col("own").alias("value"))
