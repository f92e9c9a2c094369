"""File systems as tables of (path, kind, body): in memory, or read from a shared folder."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..tables import EXEC, FILE, FILES


class FileError(Exception):
    """code: ENOENT, ENOTDIR, EISDIR or EEXIST."""

    def __init__(self, code: str, path: str):
        super().__init__(f"{code}: {path}")
        self.code, self.path = code, path


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All files under a folder, at any depth, with paths relative to it."""
    top, _ = _qualified(spark, folder)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top)
    bare = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    length = len(re.sub("^file:/+", "file:/", top).rstrip("/"))
    return rows.select(F.substring(bare, F.lit(length + 2), F.length(bare)).alias("path"), F.lit("file").alias("kind"), F.col("content").alias("body"))


def _qualified(spark: SparkSession, folder: str) -> tuple[str, object]:
    """A folder's full address and its file system, of any kind that the cluster knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") or "/")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(where).toString(), files


def local_root(spark: SparkSession, folder: str) -> Path | None:
    """The folder as a path that Python can open; None on other file systems."""
    top, _ = _qualified(spark, folder)
    return Path(re.sub("^file:/+", "/", top)) if top.startswith("file:") else None


def folder_exists(spark: SparkSession, folder: str) -> bool:
    """Whether there is a folder with anything in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and len(files.listStatus(where)) > 0


def executable(spark: SparkSession, folder: str) -> Callable[[Column], Column]:
    """Whether the file at a path below a folder may be run by its owner; false on file systems that Python cannot open."""
    root = local_root(spark, folder)
    if root is None:
        return lambda path: F.lit(False)
    return F.pandas_udf(lambda paths: paths.map(lambda p: bool((root / p).stat().st_mode & 0o100)), "boolean")


def write_folder(files: DataFrame, folder: str) -> None:
    """Writes every file of (path, kind, body), and mode where there is one, under a folder; directories come with their files.

    On a shared disk the executors write; on other file systems the driver streams the files through the cluster's own.
    """
    rows = files.filter("kind = 'file'").select("path", "body", F.col("mode") if "mode" in files.columns else F.lit(FILE).alias("mode"))
    root = local_root(files.sparkSession, folder)
    if root is None:
        top, system = _qualified(files.sparkSession, folder)
        for row in rows.toLocalIterator():
            out = system.create(files.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top}/{row['path']}"), True)
            out.write(bytearray(row["body"]))
            out.close()
        return

    def run(frames):
        for frame in frames:
            for path, body, mode in zip(frame["path"], frame["body"], frame["mode"]):
                at = root / path
                at.parent.mkdir(parents=True, exist_ok=True)
                part = at.with_name(at.name + ".part")  # renamed when whole, so a task that is run again does no harm
                part.write_bytes(bytes(body))
                if mode == EXEC:
                    part.chmod(part.stat().st_mode | 0o111)
                part.replace(at)
            yield frame[["path"]]

    rows.mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


class FileTable:
    """A mutable file system; each change makes a new table, and `chroot` gives a view that writes through."""

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None):
        self.spark = spark
        self._rows = rows if rows is not None else spark.createDataFrame([], FILES)

    @property
    def rows(self) -> DataFrame:
        return self._rows

    def _set(self, rows: DataFrame) -> None:
        self._rows = rows

    def kind(self, path: str) -> str | None:
        if path == "":
            return "directory"
        own = (F.col("path") == path).alias("own")
        found = self.rows.filter(codec.starts_with(F.col("path"), F.lit(path))).select(own, "kind").orderBy(F.desc("own")).limit(1).collect()
        return None if not found else found[0]["kind"] if found[0]["own"] else "directory"

    def exists(self, path: str) -> bool:
        return self.kind(path) is not None

    def read(self, path: str) -> bytes:
        if (kind := self.kind(path)) != "file":
            raise FileError("EISDIR" if kind else "ENOENT", path)
        return bytes(self.rows.filter(F.col("path") == path).first()["body"])

    def list(self, path: str = "", recursive: bool = False) -> DataFrame:
        """(path, kind) under a directory, in path order."""
        if (kind := self.kind(path)) != "directory":
            raise FileError("ENOTDIR" if kind else "ENOENT", path)
        below = self.rows.filter(codec.is_parent_of(F.lit(path), F.col("path")))
        depth = len(path.split("/")) if path else 0
        parts = codec.segments(F.col("path"))
        ups = F.transform(F.sequence(F.lit(depth + 1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), F.when(k == F.size(parts), F.col("kind")).otherwise("directory").alias("kind")))
        all_ = below.select(F.explode(ups).alias("e")).select("e.path", "e.kind").distinct()
        return (all_ if recursive else all_.filter(codec.is_immediate_parent_of(F.lit(path), F.col("path")))).orderBy("path")

    def write(self, path: str, body: bytes) -> None:
        if self.kind(path) == "directory":
            raise FileError("EISDIR", path)
        parts = path.split("/")
        for k in range(1, len(parts)):
            if self.kind("/".join(parts[:k])) == "file":
                raise FileError("ENOTDIR", path)
        row = self.spark.createDataFrame([(path, "file", bytearray(body))], FILES)
        self._set(self.rows.filter(F.col("path") != path).unionByName(row))

    def create_directory(self, path: str) -> None:
        if self.exists(path):
            raise FileError("EEXIST", path)
        self._set(self.rows.unionByName(self.spark.createDataFrame([(path, "directory", None)], FILES)))

    def delete_file(self, path: str) -> None:
        if (kind := self.kind(path)) != "file":
            raise FileError("EISDIR" if kind else "ENOENT", path)
        self._set(self.rows.filter(F.col("path") != path))

    def delete_directory(self, path: str) -> None:
        if (kind := self.kind(path)) != "directory":
            raise FileError("ENOTDIR" if kind else "ENOENT", path)
        self._set(self.rows.filter(~codec.starts_with(F.col("path"), F.lit(path))))

    def chroot(self, path: str) -> "FileTable":
        return _View(self, path)


class _View(FileTable):
    def __init__(self, base: FileTable, path: str):
        self.spark, self._base, self._path = base.spark, base, path

    @property
    def rows(self) -> DataFrame:
        inside = self._base.rows.filter(codec.is_parent_of(F.lit(self._path), F.col("path")))
        return inside.withColumn("path", F.substring("path", F.lit(len(self._path) + 2), F.length("path")))

    def _set(self, rows: DataFrame) -> None:
        outside = self._base.rows.filter(~codec.is_parent_of(F.lit(self._path), F.col("path")))
        self._base._set(outside.unionByName(rows.withColumn("path", F.concat(F.lit(self._path + "/"), F.col("path")))))


def copied(source: FileTable, target: FileTable, path: str = "") -> None:
    """Copies the files at or below a path; empty directories are not taken along."""
    more = source.rows.filter(codec.starts_with(F.col("path"), F.lit(path)) & (F.col("kind") == "file"))
    target._set(target.rows.join(more.select("path"), "path", "left_anti").unionByName(more))
