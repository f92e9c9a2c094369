"""A file system over a stored tree: reads go to the tree, writes to an overlay that `save` rolls up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..sources.files import FileError
from ..sources.store import Store
from ..tables import EXEC, FILE, TREE, written
from . import trees

_ROWS = "path string, mode int, hash string"


class TreeFiles:
    def __init__(self, store: Store, tree: str | None = None, prefix: str = ""):
        self.store, self._tree, self._base, self._prefix = store, tree, None, prefix
        self._rows = store.spark.createDataFrame([], _ROWS)
        if tree is not None:
            self._rows = written(trees.flatten(store.entries(), store.spark.createDataFrame([(tree,)], "root string")).select("path", "mode", "hash"), "tree")
        self._modified = tree is None

    @classmethod
    def from_files(cls, store: Store, rows: DataFrame) -> "TreeFiles":
        """From a working tree (path, mode, hash)."""
        made = cls(store)
        made._rows = rows.select("path", "mode", "hash")
        return made

    def _top(self) -> "TreeFiles":
        return self._base._top() if self._base else self

    def _at(self, path: str) -> str:
        return "/".join(p for p in (self._base._at(self._prefix) if self._base else "", path) if p)

    def _entry(self, path: str) -> tuple[int, str | None] | None:
        full, rows = self._at(path), self._top()._rows
        if full == "":
            return TREE, None
        row = rows.filter(F.col("path") == full).first()
        if row:
            return row["mode"], row["hash"]
        return None

    def _cut(self, path: str) -> bool:
        """Whether a path lies below a directory whose tree is not in the store."""
        parts = self._at(path).split("/")
        above = ["/".join(parts[:k]) for k in range(1, len(parts))]
        row = self._top()._rows.filter(F.col("path").isin(above)).orderBy(F.desc(F.length("path"))).first() if above else None
        return row is not None and row["mode"] == TREE and row["hash"] is not None and not self.store.has(row["hash"])

    def _need(self, path: str, directory: bool) -> tuple[int, str | None]:
        entry = self._entry(path)
        if entry is None:
            raise FileError("EIO" if self._cut(path) else "ENOENT", path)
        if directory != (entry[0] == TREE):
            raise FileError("ENOTDIR" if directory else "EISDIR", path)
        return entry

    def file_exists(self, path: str) -> bool:
        """False where nothing is; a directory there is an error."""
        if self._entry(path) is None:
            return False
        self._need(path, False)
        return True

    def directory_exists(self, path: str) -> bool:
        if self._entry(path) is None:
            return False
        self._need(path, True)
        return True

    def read(self, path: str) -> bytes:
        _, hash_ = self._need(path, False)
        row = self.store.objects.filter(F.col("hash") == hash_).first()
        if row is None:
            raise FileError("EIO", path)
        return bytes(row["body"])

    def list(self, path: str = "", recursive: bool = False) -> list[tuple[str, str]]:
        """(path, kind) right under a directory, in order; a subtree whose object is missing is an error."""
        if recursive:
            raise NotImplementedError("a tree is not listed recursively; flatten it")
        _, hash_ = self._need(path, True)
        if hash_ is not None and not self.store.has(hash_):
            raise FileError("EIO", path)
        full = self._at(path)
        skip = len(self._at("")) + 1 if self._at("") else 0
        rows = self._top()._rows.filter(codec.is_immediate_parent_of(F.lit(full), F.col("path"))).orderBy("path").collect()
        return [(r["path"][skip:], "directory" if r["mode"] == TREE else "file") for r in rows]

    def _change(self, rows: DataFrame, touched: str) -> None:
        """Directories above a change lose their stored hash."""
        top = self._top()
        above = codec.starts_with(F.lit(touched), F.col("path")) & (F.col("mode") == TREE)
        top._rows = written(rows.withColumn("hash", F.when(above, None).otherwise(F.col("hash"))), "tree")
        top._modified = True

    def _with_parents(self, path: str, mode: int, hash_: str | None) -> DataFrame:
        parts = path.split("/")
        ups = ["/".join(parts[:k]) for k in range(1, len(parts))]
        rows = self._top()._rows
        kinds = {r["path"]: r["mode"] for r in rows.filter(F.col("path").isin(ups)).collect()} if ups else {}
        for up in ups:
            if kinds.get(up, TREE) != TREE:
                raise FileError("ENOTDIR", up)
        new = [(up, TREE, None) for up in ups if up not in kinds] + [(path, mode, hash_)]
        return rows.filter(F.col("path") != path).unionByName(self.store.spark.createDataFrame(new, _ROWS))

    def write(self, path: str, body: bytes, executable: bool = False) -> None:
        entry = self._entry(path)
        if entry and entry[0] == TREE:
            raise FileError("EISDIR", path)
        full = self._at(path)
        self._change(self._with_parents(full, EXEC if executable else FILE, self.store.add_body("blob", body)), full)

    def create_directory(self, path: str) -> None:
        if self._entry(path) is not None:
            raise FileError("EEXIST", path)
        full = self._at(path)
        self._change(self._with_parents(full, TREE, None), full)

    def delete_file(self, path: str) -> None:
        self._need(path, False)
        full = self._at(path)
        self._change(self._top()._rows.filter(F.col("path") != full), full)

    def delete_directory(self, path: str) -> None:
        self._need(path, True)
        full = self._at(path)
        self._change(self._top()._rows.filter(~codec.starts_with(F.col("path"), F.lit(full))), full)

    def chroot(self, path: str) -> "TreeFiles":
        view = TreeFiles.__new__(TreeFiles)
        view.store, view._base, view._prefix, view._tree = self.store, self, path, None
        return view

    @property
    def modified(self) -> bool:
        return self._top()._modified

    @property
    def hash(self) -> str:
        if self.modified:
            raise RuntimeError("save the tree first")
        return self._top()._tree

    def save(self) -> str:
        """Stores the trees that changed and returns the root's hash. Untouched subtrees are taken by their hash; an
        empty directory without a stored tree becomes the empty tree."""
        top = self._top()
        if not top._modified:
            return top._tree
        dirty = [r["path"] for r in top._rows.filter((F.col("mode") == TREE) & F.col("hash").isNull()).select("path").collect()]
        parents = {"", *dirty}
        rows = top._rows.withColumn("up", codec.parent(F.col("path")))
        some = rows.join(F.broadcast(self.store.spark.createDataFrame([(p,) for p in parents], "up string")), "up", "left_semi")
        leaves = some.filter(F.col("hash").isNotNull()).select("path", "mode", F.lit(None).cast("binary").alias("body"), "hash")
        full = {r["up"] for r in some.select("up").distinct().collect()}
        empty = sorted(p for p in dirty if p not in full)
        if empty:
            tree = self.store.add_body("tree", b"")
            leaves = leaves.unionByName(self.store.spark.createDataFrame([(p, TREE, None, tree) for p in empty], "path string, mode int, body binary, hash string"))
        top._tree = self.store.save_tree(leaves)
        top._rows = written(trees.flatten(self.store.entries(), self.store.spark.createDataFrame([(top._tree,)], "root string")).select("path", "mode", "hash"), "tree")
        top._modified = False
        return top._tree
