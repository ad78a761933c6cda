"""Files as rows: reading by Spark, writing by the executors.

Reading whole files uses Spark's binary source, so every file system Spark knows will do.  What
needs a file's headers only opens it on an executor through Arrow's file systems and seeks;
where Arrow does not know the file system the whole file is read instead.  Writing goes through
Arrow's file systems too, to a name of its own first and then in place, so a task that runs
twice leaves one whole file.
"""

from __future__ import annotations

import bz2
import gzip
import os
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, content."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def listed(spark: SparkSession, *paths: str) -> DataFrame:
    """path; no content is read."""
    return spark.read.format("binaryFile").load(list(paths)).select("path")


def system_of(uri: str):
    """Arrow's file system and the path in it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return fs.LocalFileSystem(), os.path.abspath(uri)


def seekable(*paths: str) -> bool:
    """Whether Arrow can open these paths."""
    try:
        for p in paths:
            system_of(p)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def open_file(uri: str):
    """A file to seek in, unpacked if it is gzip or bzip2 whatever the name says."""
    system, path = system_of(uri)
    raw = system.open_input_file(path)
    mark = raw.read(3)
    raw.seek(0)
    if mark[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=raw)
    return bz2.BZ2File(raw) if mark == b"BZh" else raw


def opened(data: bytes) -> bytes:
    """The bytes, unpacked if they are gzip or bzip2 whatever the name says."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    return bz2.decompress(data) if data[:3] == b"BZh" else data


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row (name, content) as a file; how many were written."""

    def write(batches):
        system, root = system_of(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                half = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(half) as f:
                    f.write(content.as_buffer())
                system.move(half, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return files.select("name", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def match_files(spark: SparkSession, patterns: list[str], must: bool = True) -> list[str]:
    """Sorted names of all patterns, on any file system that Spark knows; each must match something if so asked."""
    out: set[str] = set()
    for p in patterns:
        try:
            found = [r.path for r in listed(spark, p).collect()]  # the files of a job, by name
        except AnalysisException:
            found = []
        if must and not found:
            raise FileNotFoundError(p)
        out.update(found)
    return sorted(out)


def numbered_files(listing: DataFrame, prefix: str, suffix: str, groups: int = 1) -> DataFrame:
    """path and numbers of the files named prefix, numbers joined by '.', '-' or '_', suffix; sorted."""
    pattern = "/" + prefix + r"[.\-_]?".join([r"([0-9]+)"] * groups) + suffix + "$"
    rows = listing.where(F.col("path").rlike(pattern))
    return rows.select(F.array(*(F.regexp_extract("path", pattern, k + 1).cast("long") for k in range(groups))).alias("numbers"), "path").orderBy("numbers", "path")


def output_name(path: str, folder: str | None = None, extension: str | None = None, label: str | None = None) -> str:
    """Where a file's result goes: another folder, another extension ('.x.gz' is one), a label before it."""
    base = os.path.basename(path)
    stem, ext = os.path.splitext(base)
    if ext in (".gz", ".bz2") and os.path.splitext(stem)[1]:
        stem, inner = os.path.splitext(stem)
        ext = inner + ext
    ext = ext if extension is None else "." + extension.lstrip(".") if extension else ""
    return os.path.join(folder if folder is not None else os.path.dirname(path), stem + (f".{label}" if label else "") + ext)
