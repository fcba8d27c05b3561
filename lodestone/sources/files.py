"""Small files that claim a name: created whole, once, by one of several writers."""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = hadoop(spark, path)
    return system.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    system, at = hadoop(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    system, at = hadoop(spark, path)
    system.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder to a name that must not exist yet."""
    system, at = hadoop(spark, path)
    target = hadoop(spark, to)[1]
    if system.exists(target) or not system.rename(at, target):
        raise FileExistsError(to)


def read_json(spark: SparkSession, path: str):
    system, at = hadoop(spark, path)
    stream = system.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, content: object) -> bool:
    """Creates a file of JSON unless it exists; whether this writer did. Of several writers at once just one does.

    The creation itself is the claim: exclusive where a path is in a file system of this machine's kernel, and Hadoop's
    create without overwriting elsewhere, which stores such as HDFS do at one go.
    """
    text = json.dumps(content, sort_keys=True, ensure_ascii=False).encode()
    system, at = hadoop(spark, path)
    system.mkdirs(at.getParent())
    if system.getScheme() == "file":
        # a name appears with its content: a linked file is whole, and linking to a name that exists fails
        local = urlparse(at.toUri().toString()).path if "://" in path or path.startswith("file:") else path
        beside = f"{local}.{os.getpid()}.{os.urandom(6).hex()}"
        with open(beside, "wb") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(beside, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(beside)
        return True
    try:
        stream = system.create(at, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    stream.write(bytearray(text))
    stream.close()
    return True
