"""File catalogs: listings as tables, and file contents read only for the rows that are left."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: What a URI has before its path; a URI's scheme, authority and path.
SCHEME = "(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/]*)?"
URI = "(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/]*))?(.*)"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob matches anything."""
    files, where = hadoop(spark, pattern)
    return bool(files.globStatus(where))


def read_text_file(spark: SparkSession, path: str) -> str | None:
    """The content of one small file, or None if there is none."""
    files, where = hadoop(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


class Place(NamedTuple):
    """A URI in its parts; Hadoop writes them unescaped."""

    scheme: str
    authority: str
    path: str


def parsed(uri: str) -> Place:
    """``scheme:path``, ``scheme:/path``, ``scheme://authority/path`` or a plain path."""
    scheme, authority, path = re.fullmatch(URI, uri, re.DOTALL).groups()
    return Place(scheme or "", authority or "", path)


def qualified(spark: SparkSession, path: str) -> str:
    """The whole URI of a path, as scans name their files."""
    files, where = hadoop(spark, path)
    return files.makeQualified(where).toString()


def relative(root: str, column: str | Column) -> Column:
    """What follows ``root`` in a full path below it; only the paths of both are compared, not how scheme and authority are written."""
    start = parsed(root).path.rstrip("/")
    return F.substr(F.regexp_replace(column, f"^{SCHEME}", ""), F.lit(len(start) + 2))


def arrow_store(uri: str):
    """The Arrow file system of a URI and the path on it, or None if Arrow has none for the scheme. Credentials and libraries are the process's own."""
    where = parsed(uri)
    host, _, port = where.authority.partition(":")
    if where.scheme in ("", "file"):
        return pafs.LocalFileSystem(), where.path
    if where.scheme in ("s3", "s3a", "s3n"):
        return pafs.S3FileSystem(), where.authority + where.path
    if where.scheme == "gs":
        return pafs.GcsFileSystem(), where.authority + where.path
    if where.scheme == "hdfs":
        try:
            return pafs.HadoopFileSystem(host or "default", int(port or 0)), where.path
        except OSError:  # its native library isn't installed
            return None
    return None


def name_pattern(names: str) -> str:
    """A regular expression of a glob with ``*``, ``?`` and alternatives in braces."""
    parts = {"*": "[^/]*", "?": "[^/]", "{": "(?:", ",": "|", "}": ")"}
    return "".join(parts.get(c, re.escape(c)) for c in names)


def list_files(spark: SparkSession, root: str, names: str = "*", folder: str | None = None, store: Callable = arrow_store) -> DataFrame:
    """(path, length) of the files below ``root`` whose base name matches ``names``, as paths relative to it.

    With ``folder``, only files directly in that folder. Folders are rows: each is listed by a task, and the folders that it holds are the rows of the
    next round, so rounds number the depth and no name comes to the driver. Tasks use the file system that ``store`` gives for the root's URI. As in scans, names
    that begin with "_" or "." are left out. Where ``store`` gives none, Spark's own listing is used; it leaves out empty files.
    """
    ship(spark)
    base = qualified(spark, root if folder is None else f"{root.rstrip('/')}/{folder.strip('/')}")
    prefix = "" if folder is None else f"{folder.strip('/')}/"
    if store(base) is None:
        return _scanned(spark, root, base, names, folder is None)
    deep, pattern = folder is None, name_pattern(names)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(base)
        for batch in batches:
            for path in batch["path"].to_pylist():
                selector = pafs.FileSelector(f"{top.rstrip('/')}/{path}".rstrip("/") or "/", allow_not_found=True)
                held = [x for x in files.get_file_info(selector) if x.base_name[:1] not in ("_", ".")]
                held = [x for x in held if x.type == pafs.FileType.File and re.fullmatch(pattern, x.base_name) or deep and x.type == pafs.FileType.Directory]
                found = [f"{path}/{x.base_name}" if path else x.base_name for x in held]
                folders = [x.type == pafs.FileType.Directory for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([x.size or 0 for x in held], pa.int64()), pa.array(folders, pa.bool_())], names=["path", "length", "folder"])

    level, files = spark.createDataFrame([("",)], "path string"), None
    while files is None or not level.isEmpty():
        entries = level.repartition("path").mapInArrow(visit, "path string, length long, folder boolean").checkpoint()
        here = entries.where("not folder").select(F.concat(F.lit(prefix), "path").alias("path"), "length")
        files = here if files is None else files.union(here)
        level = entries.where("folder").select("path")
    return files


def _scanned(spark: SparkSession, root: str, base: str, names: str, deep: bool) -> DataFrame:
    """list_files() by a scan's metadata; contents aren't read."""
    if not exists(spark, base):
        return spark.createDataFrame([], "path string, length long")
    scan = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", str(deep).lower())
    return scan.load(base).select(relative(qualified(spark, root), decoded("_metadata.file_path")).alias("path"), "length")


def decoded(path: str) -> Column:
    """A path as a scan's metadata has it, without escapes; most have none."""
    return F.when(F.contains(F.col(path), F.lit("%")), F.url_decode(F.regexp_replace(path, r"\+", "%2B"))).otherwise(F.col(path))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, where = hadoop(spark, path)
    files.delete(where, True)


def create_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create a file by the store's own conditional create; False if it was there. Of several writers exactly one creates it."""
    where = parsed(qualified(spark, path))
    if where.scheme == "file":  # Hadoop's local files only look before they create
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        try:
            made = os.open(where.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(made, "wb") as file:
            file.write(content)
        return True
    files, target = hadoop(spark, path)
    try:
        stream = files.createFile(target).recursive().overwrite(False).opt("fs.option.create.conditional.overwrite", True).build()
        stream.write(content)
        stream.close()
    except Py4JJavaError:
        if files.exists(target):
            return False
        raise
    return True


def read_contents(spark: SparkSession, root: str, keep: Callable[[Column], Column], names: str = "*") -> DataFrame:
    """(path, text) of the files below ``root`` whose relative path meets the condition that ``keep`` makes of it.

    The condition is on the scan's metadata, so files that don't meet it are never opened, and no path passes through the driver's Python.
    """
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    path = relative(qualified(spark, root), decoded("_metadata.file_path"))
    return files.where(keep(path)).select(path.alias("path"), F.decode("content", "UTF-8").alias("text"))


def marker_revision(spark: SparkSession, root: str) -> str | None:
    """The revision that a catalog's REVISION file names."""
    text = read_text_file(spark, f"{root.rstrip('/')}/REVISION")
    return text.strip() if text is not None else None


def assert_revision(spark: SparkSession, root: str, expected: str, resolver: Callable[[SparkSession, str], str | None] = marker_revision) -> None:
    """Fail unless the source is still at the recorded revision."""
    current = resolver(spark, root)
    if current != expected:
        raise RuntimeError(f"{root} is at revision {current}, not at {expected} to which it is pinned")


def list_pinned(spark: SparkSession, root: str, revision: str | None, resolver=marker_revision, **how) -> DataFrame:
    """list_files() of a source whose revision is checked before and after the listing."""
    if revision is not None:
        assert_revision(spark, root, revision, resolver)
    found = list_files(spark, root, **how)
    if revision is not None:
        assert_revision(spark, root, revision, resolver)
    return found
