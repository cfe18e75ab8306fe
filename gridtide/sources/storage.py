"""The few calls to Hadoop's file systems. They need a classic session (not Spark Connect)."""

from __future__ import annotations

import os
import posixpath
from typing import NamedTuple
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Different names of one store, and ports that a name without one stands for.
_ALIASES = {"s3": "s3a", "s3n": "s3a", "abfss": "abfs", "wasbs": "wasb"}
_PORTS = {"hdfs": ":8020"}


class Place(NamedTuple):
    """Where a path points to: equal for equal places, however they are written."""

    scheme: str
    authority: str
    path: str

    def overlaps(self, other: Place) -> bool:
        if self[:2] != other[:2]:
            return False
        one, two = self.path.rstrip("/") + "/", other.path.rstrip("/") + "/"
        return one.startswith(two) or two.startswith(one)


def default_store(spark: SparkSession) -> str:
    return spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")


def place(path: str, default: str = "file:///", home: str = "") -> Place:
    """Resolve a path that may lack scheme and authority against the default file system.

    Local paths lose their symbolic links. ``home`` completes relative paths of other stores.
    """
    parts = urlsplit(path)
    base = urlsplit(default)
    scheme, authority = (parts.scheme, parts.netloc) if parts.scheme else (base.scheme, base.netloc)
    scheme = _ALIASES.get(scheme.lower(), scheme.lower())
    # A path may hold characters that a URI takes for a query or fragment.
    name = path.split(":", 1)[1] if parts.scheme else path
    if parts.scheme and name.startswith("//"):
        name = name[2 + len(parts.netloc) :]
    if scheme == "file":
        return Place("file", "", os.path.realpath("/" + name.lstrip("/") if name.startswith("/") else name))
    if not name.startswith("/"):
        name = posixpath.join(home or "/", name)
    clean = "/" + posixpath.normpath(name).lstrip("/")
    return Place(scheme, authority.lower().removesuffix(_PORTS.get(scheme, "\0")), clean)


def resolve(spark: SparkSession, path: str) -> Place:
    default = default_store(spark)
    home = ""
    if not urlsplit(default).scheme.startswith("file") and not urlsplit(path).scheme:
        jvm = spark._jvm.org.apache.hadoop.fs
        home = jvm.FileSystem.get(spark._jsc.hadoopConfiguration()).getWorkingDirectory().toUri().getPath()
    return place(path, default, home)


def _open(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def exists(spark: SparkSession, path: str) -> bool:
    fs, name = _open(spark, path)
    return fs.exists(name)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file if it is there; raise if it stays."""
    fs, name = _open(spark, path)
    if fs.exists(name) and not fs.delete(name, True) and fs.exists(name):
        raise OSError(f"Could not delete {path}")


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, name = _open(spark, source)
    if not fs.rename(name, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"Could not move {source} to {target}")


def create(spark: SparkSession, path: str, text: str = "") -> bool:
    """Write a small new file; false if one of this name is there already, which then stays as it is."""
    fs, name = _open(spark, path)
    if fs.exists(name):
        return False
    try:
        out = fs.create(name, False)
    except Py4JJavaError:
        if fs.exists(name):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    fs, name = _open(spark, path)
    source = fs.open(name)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def children(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Paths right below a folder, with their modification times in seconds; none if it is missing."""
    fs, name = _open(spark, path)
    found = fs.listStatus(name) if fs.exists(name) else []
    return [(s.getPath().toString(), s.getModificationTime() / 1000) for s in found]
