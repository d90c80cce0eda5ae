"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one on a single
    machine (tests); on a cluster that raises, as executors would write to folders that others do not see."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def remove(spark: SparkSession, path: str, later: bool = False) -> None:
    """Delete a folder, now or when the driver's JVM ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(target) if later else files.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder to a name that nothing has yet; False, with nothing changed, if something has."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = b.getFileSystem(conf)
    files.mkdirs(b.getParent())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(a), files.makeQualified(b), none)
    except Py4JJavaError as error:
        if files.exists(b):
            return False
        raise error
    return True


_OPEN = threading.local()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that this thread writes inside go at its end, also after an error: for work whose result is not a table that reads them."""
    _OPEN.scopes = [*getattr(_OPEN, "scopes", []), []]
    try:
        yield
    finally:
        own = _OPEN.scopes.pop()
        for path in own:
            remove(spark, path)


def materialise(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends at a file that outlives executors.

    The files go when the driver's JVM ends, or with the ``scope`` that they were written in.
    """
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    if scopes := getattr(_OPEN, "scopes", []):
        scopes[-1].append(path)
    df.write.parquet(path)
    remove(spark, path, later=True)
    return spark.read.schema(df.schema).parquet(path)
