"""A store of objects, refs and journals: tables, with readers and writers of the usual folder layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, packed
from ..operators import graph, trees
from ..tables import ENTRIES, JOURNAL, OBJECTS, REFS, TREE, written
from .files import read_folder, write_folder

#: Changes to a table after which the whole of it is written again.
_CHANGES = 8
DEFAULT_CONFIG = "[core]\n\trepositoryformatversion = 0\n\tfilemode = false\n\tbare = true\n[{section}]\n\tversion = 1\n"


class StoreError(Exception):
    """code: BadRepo, MissingObject, ObjectTypeMismatch, InvalidData, TreeEntryNotFound or ChildIsNotATree."""

    def __init__(self, code: str, what: str):
        super().__init__(f"{code}: {what}")
        self.code, self.what = code, what


class Store:
    """objects (hash, type, body), refs (ref, hash), journal (ref, seq, previous, new, person, description), files of the root by name."""

    def __init__(self, spark: SparkSession, objects: DataFrame | None = None, refs: DataFrame | None = None, journal: DataFrame | None = None, section: str = "store"):
        self.spark, self.section = spark, section
        self.objects = objects if objects is not None else spark.createDataFrame([], OBJECTS)
        self.refs = refs if refs is not None else spark.createDataFrame([], REFS)
        self.journal = journal if journal is not None else spark.createDataFrame([], JOURNAL)
        self.files: dict[str, bytes] = {}
        self._changes: dict[str, int] = {}
        self._from_folder = False

    def init(self, create: bool = True) -> str:
        """Writes HEAD and config; `reInit` where both are there. BadRepo where only one is, where a folder has objects or refs
        and neither, where the version is another, or where nothing is and nothing may be made."""
        there = {"HEAD", "config"} & set(self.files)
        if len(there) == 1 or self._from_folder and not there and not (self.objects.isEmpty() and self.refs.isEmpty()):
            raise StoreError("BadRepo", "HEAD or config is missing")
        if there:
            if codec_version(self.config(), self.section) != "1":
                raise StoreError("BadRepo", "another version")
            return "reInit"
        if not create:
            raise StoreError("BadRepo", "nothing is here")
        self.files |= {"HEAD": b"ref: refs/heads/main", "config": DEFAULT_CONFIG.format(section=self.section).encode()}
        return "init"

    def config(self) -> dict[str, list[str]] | None:
        if "config" not in self.files:
            return None
        try:
            return packed.parse_config(self.files["config"].decode())
        except ValueError as error:
            raise StoreError("InvalidData", "config") from error

    def metadata(self, name: str) -> bytes | None:
        if "/" in name:
            raise ValueError("metadata files lie in the root")
        return self.files.get(name)

    def save_metadata(self, name: str, body: bytes) -> None:
        if "/" in name:
            raise ValueError("metadata files lie in the root")
        self.files[name] = body

    def _change(self, table: str, rows: DataFrame) -> None:
        """Takes a changed table. What changed is written by itself; the whole only after _CHANGES of them, so that plans stay short."""
        self._changes[table] = self._changes.get(table, 0) + 1
        if self._changes[table] >= _CHANGES:
            rows, self._changes[table] = written(rows, table), 0
        setattr(self, table, rows)

    # Objects

    def add(self, objects: DataFrame, overwrite: bool = False) -> None:
        """Adds objects that are not there; with overwrite, replaces those that are."""
        more = objects.select("hash", "type", "body").dropDuplicates(["hash"])
        if overwrite:
            more = written(more, "more")
            self._change("objects", self.objects.join(more.select("hash"), "hash", "left_anti").select(*self.objects.columns).unionByName(more))
        else:
            self._change("objects", self.objects.unionByName(written(more.join(self.objects.select("hash"), "hash", "left_anti"), "more")))

    def add_body(self, kind: str, body: bytes) -> str:
        rows = self.spark.createDataFrame([(kind, bytearray(body))], "type string, body binary")
        row = rows.select(codec.object_id(F.col("type"), F.col("body")).alias("hash"), "type", "body")
        self.add(row)
        return row.first()["hash"]

    def has(self, hash_: str) -> bool:
        return not self.objects.filter(F.col("hash") == hash_).isEmpty()

    def load(self, hash_: str, kind: str | None = None) -> tuple[str, bytes]:
        row = self.objects.filter(F.col("hash") == hash_).first()
        if row is None:
            raise StoreError("MissingObject", hash_)
        if kind and row["type"] != kind:
            raise StoreError("ObjectTypeMismatch", f"{hash_} is a {row['type']}")
        return row["type"], bytes(row["body"])

    def delete(self, hash_: str) -> None:
        self._change("objects", self.objects.filter(F.col("hash") != hash_))

    def commits(self) -> DataFrame:
        """(hash, tree, parents, author, committer, message)."""
        # The optimizer may parse before it filters, so other bodies are made null first.
        body = F.when(F.col("type") == "commit", F.col("body"))
        return self.objects.filter("type = 'commit'").select("hash", codec.parsed_commit(body).alias("c")).select("hash", "c.*")

    def edges(self) -> DataFrame:
        return self.commits().select(F.col("hash").alias("child"), F.posexplode("parents").alias("ord", "parent")).select("child", "parent", "ord")

    def entries(self) -> DataFrame:
        return packed.tree_entries(self.objects.filter("type = 'tree'"))

    # Refs and journals

    def list_refs(self, under: str) -> list[str]:
        return [r["ref"] for r in self.refs.filter(F.col("ref").startswith(under + "/")).orderBy("ref").select("ref").collect()]

    def get_ref(self, ref: str) -> str | None:
        row = self.refs.filter(F.col("ref") == ref).first()
        return row["hash"] if row else None

    def set_ref(self, ref: str, hash_: str) -> None:
        if not ref.startswith("refs/"):
            raise ValueError(f"not a ref: {ref}")
        self._change("refs", self.refs.filter(F.col("ref") != ref).unionByName(self.spark.createDataFrame([(ref, hash_)], REFS)))

    def get_journal(self, ref: str) -> DataFrame:
        return self.journal.filter(F.col("ref") == ref).orderBy("seq")

    def set_journal(self, ref: str, rows: DataFrame) -> None:
        rows = written(rows.withColumn("ref", F.lit(ref)).select(*self.journal.columns), "entries")
        self._change("journal", self.journal.filter(F.col("ref") != ref).unionByName(rows))

    def update_ref(self, ref: str, hash_: str, person: tuple, description: str) -> None:
        """Moves a ref and notes it in its journal."""
        before = self.get_ref(ref)
        seq = self.journal.filter(F.col("ref") == ref).agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        self.set_ref(ref, hash_)
        entry = self.spark.createDataFrame([(ref, seq, before, hash_, person, description)], JOURNAL)
        self._change("journal", self.journal.unionByName(entry))

    # Trees and commits

    def save_tree(self, files: DataFrame) -> str:
        """Stores the blobs and trees of (path, mode, body, hash); a row without a body stands for an object by its hash."""
        known = F.coalesce(F.when(F.col("body").isNotNull(), codec.object_id(F.lit("blob"), F.col("body"))), F.col("hash"))
        rows = written(files.select("path", "mode", "body", known.alias("hash")), "files")
        self.add(rows.filter("body is not null").select("hash", F.lit("blob").alias("type"), "body"))
        made = written(trees.roll_up(rows), "trees")
        self.add(made.select("hash", F.lit("tree").alias("type"), "body"))
        return made.filter("path = ''").first()["hash"]

    def create_commit(self, tree: str, parents: list[str], author: tuple, message: str, committer: tuple | None = None) -> str:
        rows = self.spark.createDataFrame([(tree, parents, author, committer or author, message)], "tree string, parents array<string>, author struct<name:string,email:string,seconds:bigint,offset:int>, committer struct<name:string,email:string,seconds:bigint,offset:int>, message string")
        body = rows.select(codec.commit_body(F.col("tree"), F.col("parents"), F.col("author"), F.col("committer"), F.col("message")).alias("b")).first()["b"]
        return self.add_body("commit", bytes(body))

    def commit(self, ref: str, tree: str, author: tuple, message: str) -> str:
        """A commit on top of the ref, which moves to it."""
        before = self.get_ref(ref)
        made = self.create_commit(tree, [before] if before else [], author, message)
        self.update_ref(ref, made, author, f"commit: {message}")
        return made

    def complete_commits(self) -> DataFrame:
        """(commit): commits whose whole tree is there."""
        roots = self.commits().select(F.col("hash").alias("commit"), F.col("tree").alias("root"))
        whole = trees.fully_reachable(self.entries(), self.objects, roots.select("root").distinct())
        return roots.join(whole.filter("complete"), "root").select("commit")

    def resolve_branch(self, branch: str, assume_consistent: bool = False) -> list[tuple[str, str, str]]:
        """(ref, client, commit) of every client's branch: its ref, or the newest commit whose tree is whole."""
        refs = self.refs.withColumn("b", codec.parsed_branch(F.col("ref"))).filter(F.col("b.branch") == branch).select("ref", "b.client", "hash").orderBy("ref").collect()
        if assume_consistent:
            return [(r["ref"], r["client"], r["hash"]) for r in refs]
        valid, edges = written(self.complete_commits(), "complete"), self.edges()
        found = [(r["ref"], r["client"], graph.find_commit(edges, self.journal, r["ref"], r["hash"], valid)) for r in refs]
        return [f for f in found if f[2] is not None]

    def show_refs(self) -> DataFrame:
        """(ref, hash, found): heads, then remotes, each with whether its commit is there."""
        rows = self.refs.filter(F.col("ref").startswith("refs/heads/") | F.col("ref").startswith("refs/remotes/"))
        rows = rows.join(self.objects.select("hash", F.lit(True).alias("found")), "hash", "left")
        return rows.select("ref", "hash", F.coalesce("found", F.lit(False)).alias("found")).orderBy("ref")

    def log(self, ref: str) -> DataFrame:
        """(depth, hash, name, email, date, message) along first parents; the date in the author's own zone."""
        head = self.get_ref(ref)
        if head is None:
            raise StoreError("MissingObject", ref)
        rows = graph.first_parents(self.edges(), head).withColumnRenamed("commit", "hash").join(self.commits(), "hash")
        local = F.date_format(F.timestamp_seconds(F.col("author.seconds") - F.col("author.offset") * 60), "yyyy-MM-dd'T'HH:mm:ss")
        return rows.select("depth", "hash", "author.name", "author.email", F.concat(local, codec.zone(F.col("author.offset"))).alias("date"), "message").orderBy("depth")

    def checkout(self, ref: str) -> DataFrame:
        """(path, kind, body, mode) of the files of a ref's tree; MissingObject where there is no such ref, or its commit is not there."""
        head = self.get_ref(ref)
        if head is None:
            raise StoreError("MissingObject", f"there is no {ref}")
        self.load(head, "commit")
        tree = self.commits().filter(F.col("hash") == head).first()["tree"]
        flat = trees.files(trees.flatten(self.entries(), self.spark.createDataFrame([(tree,)], "root string")))
        return flat.join(self.objects.select("hash", "body"), "hash").select("path", F.lit("file").alias("kind"), "body", "mode")

    # Folders

    def save(self, folder: str) -> None:
        """The tables as Parquet; objects by the first two digits of their ids."""
        self.objects.withColumn("shard", F.substring("hash", 1, 2)).write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/objects")
        self.refs.write.mode("overwrite").parquet(f"{folder}/refs")
        self.journal.write.mode("overwrite").parquet(f"{folder}/journal")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "Store":
        return cls(spark, spark.read.parquet(f"{folder}/objects").drop("shard"), spark.read.parquet(f"{folder}/refs"), spark.read.parquet(f"{folder}/journal"))

    @classmethod
    def read_layout(cls, spark: SparkSession, folder: str, section: str = "store") -> "Store":
        """From a folder of zlib-compressed objects, ref files and journals under logs/."""
        files = written(read_folder(spark, folder), "layout")
        loose = files.filter(F.col("path").rlike("^objects/[0-9a-f]{2}/[0-9a-f]{38}$"))
        objects = loose.select(F.regexp_replace(F.substring("path", 9, 41), "/", "").alias("hash"), packed.decoded(packed.inflated(F.col("body"))).alias("o"))
        bad = objects.filter("o.error is not null").first()
        if bad:
            raise StoreError("InvalidData", bad["hash"])
        refs = files.filter(F.col("path").startswith("refs/")).select(F.col("path").alias("ref"), codec.parsed_ref_line(F.decode("body", "utf-8")).alias("hash"))
        logs = files.filter(F.col("path").startswith("logs/")).select(F.substring("path", 6, 1000).alias("ref"), F.explode(codec.parsed_journal(F.decode("body", "utf-8"))).alias("e")).select("ref", "e.*")
        store = cls(spark, written(objects.select("hash", "o.type", "o.body"), "objects"), written(refs, "refs"), written(logs, "journal"), section)
        store._from_folder = True
        store.files = {r["path"]: bytes(r["body"]) for r in files.filter(~F.contains("path", F.lit("/"))).select("path", "body").collect()}
        return store

    def write_layout(self, folder: str) -> None:
        objects = self.objects.select(codec.object_path(F.col("hash")).alias("path"), packed.deflated(codec.raw(F.col("type"), F.col("body"))).alias("body"))
        refs = self.refs.select(F.col("ref").alias("path"), codec.utf8(codec.ref_line(F.col("hash"))).alias("body"))
        line = codec.journal_line(F.col("previous"), F.col("new"), F.col("person"), F.col("description"))
        logs = self.journal.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda e: e["line"]), "").alias("text"))
        logs = logs.select(F.concat(F.lit("logs/"), "ref").alias("path"), codec.utf8(F.col("text")).alias("body"))
        root = self.spark.createDataFrame([(n, bytearray(b)) for n, b in self.files.items()], "path string, body binary")
        write_folder(objects.unionByName(refs).unionByName(logs).unionByName(root).withColumn("kind", F.lit("file")), folder)


def codec_version(config: dict[str, list[str]] | None, section: str) -> str | None:
    values = (config or {}).get(f"{section}.version")
    return values[-1] if values else None


__all__ = ["ENTRIES", "Store", "StoreError", "TREE"]
