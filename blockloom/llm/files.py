"""Flat files in the shared folder: tasks write whole files and name them in a manifest; readers take byte ranges.

A file's name is new for each attempt of a task, and only the rows of the attempt that Spark commits reach the stored manifest.
So a lost executor or a repeated task leaves at most a file that no manifest names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_of(uri: str):
    """The store and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Roll:
    """Writes records to files of about `limit` bytes in a folder."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.folder, self.suffix, self.limit, self.out, self.size = folder, suffix, limit, None, 0

    def write(self, data: bytes) -> tuple[str, int]:
        """The file's URI and the offset that data got in it."""
        if self.out is None or self.size >= self.limit:
            self.close()
            self.uri = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            store, path = store_of(self.uri)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.size = store.open_output_stream(path, compression=None), 0
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return self.uri, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Ranges:
    """Reads byte ranges of a file."""

    def __init__(self, uri: str):
        store, path = store_of(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    """files: path, size. A row per block: path, block; blocks are dealt over the tasks."""
    n = F.ceil(F.col("size") / block_bytes).cast("bigint")
    rows = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("block"))
    return rows.repartition(max(12, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path", "block")


def rows_of(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])
