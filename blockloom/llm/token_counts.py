"""Token counts of flat, unindexed token files: a separator scan.

Token files are arrays of little-endian 16-bit ids with an end-of-document id after each document. They are cut into blocks; a task searches a
block for separators in one vectorised comparison. Blocks' summaries (separators, and the last one's place) go through a prefix scan
in file order; with what it carries, each block's first document gets its begin, however many blocks back that lies, and
documents get their numbers in the file.

Cases: a null or empty text is a document of 0 tokens. Tokens after a file's last separator are an open document: counted, with complete
false. A file of an odd number of bytes is damaged and raises an error. Repeated rows and null ids have a row each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, text_chunks, workdir
from .files import Ranges, Roll, blocks, rows_of

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END = 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: str):
    """A public byte-level vocabulary's encoder."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes token files. Returns the stored manifest: path, ordinal (a document's number in its file), doc_id, size (of the file, so far)."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, roll, ordinals = encoder(vocabulary), Roll(folder, ".tokens", file_bytes), {}
        for chunk in text_chunks(batches):
            rows = []
            for doc_id, text in rows_of([chunk]):
                data = np.array([*encode(text or ""), END], "<u2").tobytes()
                path, at = roll.write(data)
                ordinals[path] = n = ordinals.get(path, -1) + 1
                rows.append((path, n, doc_id, at + len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), *[pa.int64()] * 3])], names=["path", "ordinal", "doc_id", "size"])
        roll.close()

    return stored(docs.mapInArrow(put, "path string, ordinal bigint, doc_id bigint, size bigint"), "token-manifest")


def scan(files: DataFrame, end: int = END, block_bytes: int = 8 << 20) -> DataFrame:
    """files: path, size. Per document: path, ordinal, first (its first token's place), n_tokens, complete."""
    per = block_bytes // 2

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block in rows_of(batches):
            with Ranges(path) as file:
                if file.size % 2:
                    raise ValueError(f"{path} has an odd number of bytes")
                ids = np.frombuffer(file.read(block * per * 2, per * 2), "<u2")
                ends = np.flatnonzero(ids == end) + block * per
                open_ = (block + 1) * per * 2 >= file.size
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([ends], pa.list_(pa.int64())), pa.array([block * per + len(ids)]), pa.array([open_])], names=["path", "block", "ends", "stop", "final"])

    found = stored(blocks(files, per * 2).mapInArrow(search, "path string, block bigint, ends array<bigint>, stop bigint, final boolean"), "token-ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    carried = found.select("path", "block", F.coalesce(F.max(last).over(before) + 1, F.lit(0)).alias("begin"), F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("base"))
    rows = found.join(carried, ["path", "block"])
    starts = F.concat(F.array("begin"), F.transform("ends", lambda e: e + 1))
    tail = F.coalesce(F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1), F.col("begin"))
    stops = F.when(F.col("final") & (tail < F.col("stop")), F.concat("ends", F.array("stop"))).otherwise(F.col("ends"))
    docs = rows.select("path", "base", F.size("ends").alias("n"), F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size(stops)).alias("a"), stops.alias("z"))).alias("i", "x"))
    return docs.select("path", (F.col("base") + F.col("i")).alias("ordinal"), F.col("x.a").alias("first"), (F.col("x.z") - F.col("x.a")).alias("n_tokens"), (F.col("i") < F.col("n")).alias("complete"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op6 query: all documents written as token files, and the tokens of each counted from the files."""
    manifest = write(table(spark, sf_dir, "documents").select("doc_id", "text"), workdir(spark, "tokens"))
    files = manifest.groupBy("path").agg(F.max("size").alias("size"))
    return manifest.select("path", "ordinal", "doc_id").join(scan(files), ["path", "ordinal"]).select("doc_id", "n_tokens", "complete")
