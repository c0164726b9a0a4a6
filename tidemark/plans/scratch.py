"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_folders: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dirs[app]


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its URL names."""
    hadoop, store = _file_system(spark, path)
    store.delete(hadoop, True)


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder for intermediate tables.

    The file system that it is in deletes it when the driver's JVM ends, whether the
    session was stopped before or not; a folder of an application that has ended in
    this process goes when the next one asks for its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        for old in [a for a in _folders if a != app]:
            delete_path(spark, _folders.pop(old))
        path = f"{scratch_root(spark)}/tidemark-{app}-{uuid.uuid4().hex[:12]}"
        hadoop, store = _file_system(spark, path)
        if "://" not in path:  # with its store's name, as tasks may write there without Hadoop
            path = re.sub(r"^file:/+", "file:///", store.makeQualified(hadoop).toString())
        store.mkdirs(hadoop)
        store.deleteOnExit(hadoop)
        _folders[app] = path
    return _folders[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own within the application's folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back.

    This cuts the lineage, so that later stages survive lost executors without
    recomputing, and evaluates an expensive input once. drop() deletes the table; what is
    left goes with the folder, and so does what a write that fails leaves.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for table in tables:
        delete_path(table.sparkSession, table._scratch_path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Each name, with underscores before it until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
