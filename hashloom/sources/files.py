"""Small files through Hadoop's FileSystem: any store Spark can write, with atomic replacement."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write to a temporary name, then rename over the target: readers see the old or the new file."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    temp = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    stream = fs.create(temp, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(temp, p, options)


def read_json(spark: SparkSession, path: str):
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, sort_keys=True))


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    _, q = _fs(spark, target)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"{source} can't be renamed to {target}")


def publish(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder to a name that nothing has yet; False if something has it."""
    jvm = spark.sparkContext._jvm
    _, p = _fs(spark, source)
    _, q = _fs(spark, target)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(q.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(p, q, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception) or exists(spark, target):
            return False
        raise
    return True


def sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name below ``path``, bytes) of every file in a folder and its folders, in order."""
    fs, p = _fs(spark, path)
    found, listed = [], fs.listFiles(p, True)
    root = fs.makeQualified(p).toUri().getPath()
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toUri().getPath()[len(root) :].lstrip("/"), status.getLen()))
    return sorted(found)


def chunks(spark: SparkSession, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        while part := bytes(stream.readNBytes(size)):
            yield part
    finally:
        stream.close()


def write_chunks(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    stream = fs.create(p, True)
    try:
        for part in parts:
            stream.write(bytearray(part))
    finally:
        stream.close()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or a folder with all it holds."""
    fs, p = _fs(spark, source)
    to_fs, q = _fs(spark, target)
    to_fs.mkdirs(q.getParent())
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to_fs, q, False, True, conf)
