"""Small JSON entries beside tables: what they name is finished, anything else in the folder is not."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    # Through Hadoop's file systems, as the folder may be in any store.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    target = hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def put_entry(spark: SparkSession, path: str, entry: dict) -> None:
    """One small JSON file that is either there as a whole or not at all."""
    fs, target = _file_system(spark, path)
    _, draft = _file_system(spark, f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if not fs.rename(draft, target):
        # Another attempt of the same entry was first.
        fs.delete(draft, False)


def read_entry(spark: SparkSession, path: str) -> dict:
    """The entry at a path."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names below a folder, sorted, without drafts; empty where there is no folder."""
    fs, target = _file_system(spark, folder)
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def age_of(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was last changed, by the clock of its store and this machine."""
    fs, target = _file_system(spark, path)
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    return (now - fs.getFileStatus(target).getModificationTime()) / 1000


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all below it."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def is_there(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()
