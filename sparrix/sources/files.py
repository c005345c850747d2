"""Files by way of the file system that their path names, whatever it is."""

from __future__ import annotations

import hashlib
import mmap
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrix.runtime import work_path

BLOCK = 1 << 16


def _path(path: str) -> tuple[SparkSession, Any, Any]:
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark, target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    _, target, fs = _path(path)
    return fs.exists(target)


def is_folder(path: str) -> bool:
    _, target, fs = _path(path)
    return fs.getFileStatus(target).isDirectory()


def size_of(path: str) -> int:
    _, target, fs = _path(path)
    return fs.getFileStatus(target).getLen()


def local_path(path: str) -> str | None:
    """The path in the local file system, if it is there."""
    _, target, fs = _path(path)
    return target.toUri().getPath() if fs.getScheme() == "file" else None


def blocks(path: str, unzipped: bool = False) -> Iterator[bytes]:
    """The bytes of a file, block by block."""
    spark, target, fs = _path(path)
    stream = fs.open(target)
    if unzipped:
        stream = spark._jvm.java.util.zip.GZIPInputStream(stream)
    try:
        while block := bytes(stream.readNBytes(BLOCK)):
            yield block
    finally:
        stream.close()


def first_bytes(path: str, n: int) -> bytes:
    return next(blocks(path), b"")[:n]


def md5_of(path: str) -> str:
    digest = hashlib.md5()
    for block in blocks(path):
        digest.update(block)
    return digest.hexdigest()


def copy(path: str, to: str) -> None:
    spark, source, fs = _path(path)
    _, target, other = _path(to)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, other, target, False, True, spark._jsc.hadoopConfiguration())


class TextFile:
    """One file, put together from texts and from ordered frames that the tasks write in parts."""

    def __init__(self, path: str):
        self.spark, target, fs = _path(path)
        self.out = fs.create(target, True)

    def text(self, text: str) -> None:
        self.out.write(bytearray(text.encode("utf-8")))

    def rows(self, df: DataFrame, order: list[str], column: str | Column, listed: bool = False) -> None:
        """The texts of a column in the order of others, a line each; with ``listed`` commas stand between them."""
        folder = work_path(self.spark, "text")
        column = F.col(column) if isinstance(column, str) else column
        text = F.concat(F.lit(","), column) if listed else column
        df.repartitionByRange(*order).sortWithinPartitions(*order).select(text.alias("value")).write.text(folder)
        _, target, fs = _path(folder)
        parts = sorted((s.getPath() for s in fs.listStatus(target) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
        for i, part in enumerate(parts):
            stream = fs.open(part)
            if listed and not i:
                stream.read()  # the comma before the first
            self.spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, self.out, BLOCK, False)
            stream.close()
        fs.delete(target, True)


@contextmanager
def text_file(path: str) -> Iterator[TextFile]:
    file = TextFile(path)
    try:
        yield file
    finally:
        file.out.close()


def places(path: str, text: bytes) -> Iterator[int]:
    """Where a text stands in a file."""
    if (local := local_path(path)) and size_of(path):
        with open(local, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
            at = m.find(text)
            while at >= 0:
                yield at
                at = m.find(text, at + len(text))
        return
    start, held = 0, b""
    for block in blocks(path):
        held, at = held + block, 0
        while (found := held.find(text, at)) >= 0:
            yield start + found
            at = found + len(text)
        cut = max(at, len(held) - len(text) + 1)  # from here on it may go on in the next block
        start, held = start + cut, held[cut:]


def copy_changed(path: str, to: str, old: str, new: str) -> None:
    """A copy of a file with one text in place of another; all between them stays within the JVM."""
    spark, source, fs = _path(path)
    copied = spark._jvm.org.apache.commons.io.IOUtils.copyLarge
    text, at = old.encode("utf-8"), 0
    stream = fs.open(source)
    try:
        with text_file(to) as out:
            for place in places(path, text):
                stream.seek(at)
                copied(stream, out.out, 0, place - at)
                out.text(new)
                at = place + len(text)
            stream.seek(at)
            copied(stream, out.out)
    finally:
        stream.close()


__all__ = ["blocks", "copy", "copy_changed", "exists", "first_bytes", "is_folder", "local_path", "md5_of", "places", "size_of", "text_file"]
