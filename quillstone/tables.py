"""Schemas of the engine's tables, and tables written in the shared folder in place of long lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PERSON = "struct<name:string,email:string,seconds:bigint,offset:int>"
OBJECTS = "hash string, type string, body binary"
REFS = "ref string, hash string"
JOURNAL = f"ref string, seq long, previous string, new string, person {PERSON}, description string"
EDGES = "child string, parent string, ord int"
ENTRIES = "tree_hash string, ord int, name string, mode int, child_hash string"
FILES = "path string, kind string, body binary"

TREE, BLOB, FILE, EXEC, SYM, COMMIT = 0o040000, 0o100000, 0o100644, 0o100755, 0o120000, 0o160000

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on one machine, where that is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "folder" not in _OWN:
        holder = tempfile.TemporaryDirectory(prefix="quillstone-")
        atexit.register(holder.cleanup)
        _OWN["folder"] = f"file://{holder.name}"
    return _OWN["folder"]


def _path(spark: SparkSession, folder: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read back; the files go when the JVM ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/quillstone-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of this write serve nothing after it
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    where, files = _path(spark, folder)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(folder)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by `written`."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quillstone-" in folder:
            where, files = _path(df.sparkSession, folder)
            files.delete(where, True)
