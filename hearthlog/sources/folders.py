"""Folders of datasets: listing them and replacing them, on any file system of Hadoop."""

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _beside(path: str, what: str) -> str:
    parent, slash, name = path.rstrip("/").rpartition("/")
    return f"{parent}{slash}.{name}.{what}"


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The last names of the paths that match, in order."""
    files, folder = _of(spark, pattern)
    return sorted(status.getPath().getName() for status in files.globStatus(folder) or [])


def recover(spark: SparkSession, path: str) -> bool:
    """Put back what a replacement had moved aside if it ended before its new rows were
    in place; whether there was something to put back."""
    files, folder = _of(spark, path)
    _, old = _of(spark, _beside(path, "old"))
    if not files.exists(old):
        return False
    if files.exists(folder):  # the new rows are in place
        files.delete(old, True)
        return False
    return bool(files.rename(old, folder))


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace the folder at ``path`` by what ``write`` puts into the folder it is given.

    The new rows are complete beside the old ones before anything is moved, so ``write``
    may read ``path``, and if it fails the old rows are as they were. Then the old folder
    is renamed aside and the new one takes its place; a job that ends between the two
    leaves the old rows aside, from where the next replacement, or ``recover``, puts
    them back.
    """
    files, folder = _of(spark, path)
    recover(spark, path)
    new = _beside(path, f"new-{uuid.uuid4().hex}")
    _, ready = _of(spark, new)
    try:
        write(new)
    except BaseException:
        files.delete(ready, True)
        raise
    _, old = _of(spark, _beside(path, "old"))
    there = files.exists(folder)
    if not there:
        files.mkdirs(folder.getParent())
    elif not files.rename(folder, old):
        files.delete(ready, True)
        raise OSError(f"cannot move {path} aside")
    if not files.rename(ready, folder):
        if there:
            files.rename(old, folder)
        raise OSError(f"cannot move the new rows to {path}")
    if there:
        files.delete(old, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, file = _of(spark, path)
    out = files.create(file, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def join_files(spark: SparkSession, folder: str, names: list[str], path: str) -> None:
    """Copy files of a folder one behind the other into the file ``path``, in blocks."""
    files, _ = _of(spark, folder)
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = files.create(_of(spark, path)[1], True)
    try:
        for name in names:
            part = files.open(_of(spark, f"{folder}/{name}")[1])
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, settings, False)
            finally:
                part.close()
    finally:
        out.close()
