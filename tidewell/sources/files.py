"""Folders of any file system that Spark reaches: what a stream's bookkeeping needs of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def put_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write a small file whole or not at all; without ``replace`` False if it was there before."""
    fs, at = _at(spark, path)
    if not replace and fs.exists(at):
        return False
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if replace:
        fs.delete(at, False)
    if fs.rename(part, at):
        return True
    fs.delete(part, False)
    return False


def get_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _at(spark, old)
    if not fs.rename(at, _at(spark, new)[1]):
        raise OSError(f"cannot move {old} to {new}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share; a local one only on a local master that names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewell-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
