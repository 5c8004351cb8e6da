"""What the corpus operators share: stored tables, chunks of Arrow batches, word hashes and file access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folds A-Z to a-z and leaves all other bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workdir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir. Where that is unset (tests, one machine), a temporary folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="blockloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: With this on, Spark removes a query's shuffle files when the query ends; else they stay until the driver happens to collect its garbage, which it may do too rarely for large inputs.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: later steps survive lost executors and nothing is computed twice. The shuffle files that it took are removed."""
    spark, path = df.sparkSession, workdir(df.sparkSession, name)
    before = spark.conf.get(REMOVE_SHUFFLES)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts have about `limit` bytes together; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 64
        cut = np.cumsum(sizes, dtype=np.int64) // limit
        starts = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def utf8(column: pa.Array) -> list[bytes]:
    """The values' UTF-8; null gives no bytes."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same in all processes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit values: a multiply-xorshift finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of `width` words; fewer words, but not none, are one run."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out + words[i : len(words) - width + 1 + i], i + 1)
    return out


def row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """A row's id and text as columns that an equi-join can use: __id, __no (no id), __t."""
    return [F.coalesce(doc_id, F.lit(0)).cast("bigint").alias("__id"), doc_id.isNull().alias("__no"), text_hash.alias("__t")]


def rows_by_key(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: str = "left_semi", once: bool = False) -> DataFrame:
    """The rows of docs whose id and text (keys: doc_id, t = xxhash64 of the text) are among keys, or with left_anti are not. Each row is judged by its own text, null ids too. once: of rows alike in both, one."""
    names = ["__id", "__no", "__t"]
    keys = keys.select(*row_key(F.col("doc_id"), F.col("t"))).distinct()
    found = docs.select("*", *row_key(F.col(id_col).cast("bigint"), F.xxhash64(text_col))).join(keys.hint("merge"), names, how)
    return (found.dropDuplicates(names) if once else found).select(*docs.columns)
