"""Sinks: appended tables, event streams, stored objects, and tables replaced as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.audio import merged


def append(frame: DataFrame, path: str) -> None:
    """Add rows to a Parquet table."""
    frame.write.mode("append").parquet(path)


def swap(frame: DataFrame, path: str) -> None:
    """Put ``frame`` in place of the Parquet table ``path``, of which it may have been read.

    The new version is written beside the old one and renamed. A rename that fails puts the old version back; between
    the two renames there is no table at the path, and a reader may find none for that moment. After a crash in that
    moment the next call finds the old version beside the path and keeps it until its own is in place.
    """
    jvm = frame.sparkSession._jvm
    conf = frame.sparkSession._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.new", f"{path}.old"))
    system = target.getFileSystem(conf)
    system.delete(fresh, True)
    frame.write.parquet(f"{path}.new")
    there = system.exists(target)
    if there:
        system.delete(old, True)
        if not system.rename(target, old):
            raise OSError(f"{path} cannot be moved away")
    if not system.rename(fresh, target):
        if there and not system.rename(old, target):
            raise OSError(f"the table of {path} is at {path}.old")
        raise OSError(f"the new version cannot be moved to {path}")
    system.delete(old, True)


def _store(system: fs.FileSystem, folder: str, body: bytes, suffix: str) -> str:
    """Write a binary to a file named by its hash, which gets its name only when it is complete, and return the name."""
    name = sha256(body).hexdigest()[:32] + suffix
    half = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(half) as out:
        out.write(body)
    system.move(half, f"{folder}/{name}")
    return name


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)
    return system, place


def store_objects(frame: DataFrame, folder: str, column: str = "content", suffix: str = ".wav", prefix: str = "/audio/") -> DataFrame:
    """Write each binary to a file named by its hash, and return ``key, url``; the same object written twice is one file.

    ``folder`` must be one that all executors share, at an address that Arrow knows; null gives a null address.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _opened(folder)
        for batch in batches:
            urls = [None if body is None else prefix + _store(system, place, body, suffix) for body in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(urls, pa.string())], ["key", "url"])

    return frame.select(F.col("key").cast("long").alias("key"), F.col(column).alias("content")).mapInArrow(run, "key long, url string")


def store_merged(frame: DataFrame, folder: str, suffix: str = ".wav", prefix: str = "/audio/") -> DataFrame:
    """Merge the WAVs of each row's array ``content`` in order, store the whole, and return ``key, url, problem, more``.

    One row is held at a time, so a task needs the memory of the longest audio and not that of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _opened(folder)
        for batch in batches:
            urls, problems = [], []
            for pieces in batch["content"]:
                try:
                    urls.append(prefix + _store(system, place, merged(pieces.as_py()), suffix))
                    problems.append(None)
                except ValueError as problem:
                    urls.append(None)
                    problems.append(str(problem))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(urls, pa.string()), pa.array(problems, pa.string()), batch["more"]], ["key", "url", "problem", "more"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("url", T.StringType()), T.StructField("problem", T.StringType()), frame.schema["more"]])
    return frame.select(F.col("key").cast("long").alias("key"), "content", "more").mapInArrow(run, schema)


def store_texts(frame: DataFrame, folder: str) -> int:
    """Write each text of the columns ``name, content`` to the file ``name`` below ``folder``, and return how many there are.

    A file gets its name only when it is complete, and a repeated task writes the same; the driver gets only the number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _opened(folder)
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                at = f"{place}/{name}"
                system.create_dir(at.rpartition("/")[0], recursive=True)
                half = f"{at}.{uuid.uuid4().hex}"
                with system.open_output_stream(half) as out:
                    out.write((content or "").encode())
                system.move(half, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    rows = frame.select("name", "content").where("name is not null").mapInArrow(run, "files long")
    return rows.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files")).first().files
