"""Files of any store by address: ranges and whole contents from the tasks of a job, claims and small files from the driver."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

#: What a file that cannot be read raises.
UNREADABLE = (OSError, pa.ArrowException)


def is_local(uri: str) -> bool:
    return urlsplit(uri).scheme in ("", "file")


def opened_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a percent-encoded address and the path in it."""
    if is_local(uri):
        return fs.LocalFileSystem(), unquote(urlsplit(uri).path)
    return fs.FileSystem.from_uri(uri)


def has_store(uri: str) -> bool:
    """Whether tasks can open this store by themselves."""
    try:
        opened_store(uri)
        return True
    except UNREADABLE:
        return False


def address(root: str, base: str, path: str) -> str:
    """The address of a path below `base`, which is the path of `root` in its store."""
    if is_local(root):
        return "file://" + quote(path, safe="/")
    return root.rstrip("/") + quote(path[len(base.rstrip("/")) :], safe="/")


@contextmanager
def ranges(uri: str) -> Iterator:
    """A function (place, number of bytes) -> bytes over an open file."""
    if is_local(uri):
        with open(opened_store(uri)[1], "rb") as file:

            def read(place: int, n: int) -> bytes:
                file.seek(place)
                return file.read(n)

            yield read
        return
    store, path = opened_store(uri)
    with store.open_input_file(path) as file:
        size = file.size()
        yield lambda place, n: file.read_at(min(n, size - place), place) if place < size else b""


def content(uri: str) -> bytes | None:
    """The whole file; None where it cannot be read."""
    store, path = opened_store(uri)
    try:
        with store.open_input_stream(path) as file:
            return file.read()
    except UNREADABLE:
        return None


# --- on the driver --------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    """Spark's own view of a path: (its file system, the path)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def full_address(spark: SparkSession, path: str) -> str:
    """A path as the percent-encoded address that Spark would look it up at."""
    store, path = _folder(spark, path)
    return store.makeQualified(path).toUri().toString()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    store, path = _folder(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []


def small_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None where there is none."""
    store, path = _folder(spark, path)
    if not store.exists(path):
        return None
    stream = store.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that nobody else has written: of several that try, one succeeds, and none sees half a file.

    The text is written under another name first. On a local disk it is then linked, elsewhere renamed, which stores with an
    atomic rename (HDFS and alike) refuse where the name is taken.
    """
    store, target = _folder(spark, path)
    other = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    store.mkdirs(target.getParent())
    stream = store.create(other, False)
    stream.write(text.encode())
    stream.close()
    try:
        if store.getScheme() == "file":
            try:
                os.link(other.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return not store.exists(target) and store.rename(other, target)
    finally:
        store.delete(other, False)


def moved(spark: SparkSession, path: str, to: str) -> None:
    store, source = _folder(spark, path)
    if not store.rename(source, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} cannot be moved to {to}")


def dropped(spark: SparkSession, folder: str) -> None:
    store, path = _folder(spark, folder)
    store.delete(path, True)
