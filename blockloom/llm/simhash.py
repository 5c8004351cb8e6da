"""Document fingerprints by SimHash, and a search for all fingerprints within a Hamming radius.

A text's terms are its runs of five words (A-Z folded; fewer words are one run), weighted by how often they occur. Each term's 128-bit hash
votes on every bit with its weight. Votes are counted by byte values (one bincount for all texts of a chunk) and turned to bits by a small
matrix product. Equal texts have equal fingerprints; a text without words has all bits zero.

The search cuts fingerprints into blocks; for each choice of blocks that a radius cannot all touch there is a table, keyed by those blocks
(permuted to the front). Fingerprints within the radius share a key in one of the tables; distances are then checked. Equal fingerprints
are one row before the join.

For the edited text, each document needs the next one by id. Ids are cut into ranges; every range also gets the first document
of the next one, and documents move once. The order is by id, null ids first, then by text. Null texts are empty. Repeated rows follow
each other, each with its row. With one document, it is its own next one. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, hash_words, mix, shingle_hashes, stored, table
from .files import rows_of

WIDTH, BYTES = 5, 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A row of BYTES bytes per text."""
    split = [t.translate(LOWER).split() for t in texts]
    words = hash_words([w for own in split for w in own])
    terms, at = [], 0
    for own in split:
        terms.append(shingle_hashes(words[at : at + len(own)], width))
        at += len(own)
    n = np.array([len(t) for t in terms], np.int64)
    out = np.zeros((len(texts), BYTES), np.uint8)
    flat, doc = np.concatenate([np.zeros(0, np.uint64), *terms]), np.repeat(np.arange(len(texts)), n)
    hashes = np.stack([mix(flat, 31), mix(flat, 32)], axis=1).view(np.uint8).reshape(len(flat), BYTES)
    step = 256  # texts in a table of votes
    ends = np.r_[0, np.cumsum(n)]
    for a in range(0, len(texts), step):
        z = min(len(texts), a + step)
        own = slice(ends[a], ends[z])
        cells = ((doc[own, None] - a) * BYTES + np.arange(BYTES)) * 256 + hashes[own]
        votes = np.bincount(cells.ravel(), minlength=(z - a) * BYTES * 256).reshape(z - a, BYTES, 256) @ _BITS
        out[a:z] = np.packbits(votes.reshape(z - a, -1) > 0, axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / (8 * BYTES)


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _ranged(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, k (order of ids), b (range), last (a copy of the next range's first document)."""
    rows = docs.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    where: Column = F.lit(0)
    if bounds:
        values = F.array(*map(F.lit, bounds))
        steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)])
        # Binary search: how many bounds are at or below the id.
        where = F.aggregate(steps, F.lit(0), lambda s, d: F.when((s + d <= len(bounds)) & (F.get(values, s + d - 1) <= F.col("k")), s + d).otherwise(s))
    rows = rows.withColumn("b", where).withColumn("last", F.lit(False))
    firsts = sorted((r.b, r.k) for r in rows.groupBy("b").agg(F.min("k").alias("k")).collect())  # a row per range
    heads = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)]
    spark = docs.sparkSession
    before = F.broadcast(spark.createDataFrame(heads, "b int, k bigint"))
    copies = rows.drop("b", "last").join(before, "k").groupBy("b", "k").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.unionByName(copies.select(F.lit(None).cast("bigint").alias("doc_id"), "text", "k", "b", F.lit(True).alias("last")))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2 << 20) -> DataFrame:
    """OUT for each document."""
    tasks = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = _ranged(docs, 4 * tasks).repartition(tasks, "b").sortWithinPartitions("b", "last", "k", "text")

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """Rows in order; each but the last one, and those that are copies, with the row after it."""
        texts = [r[1] or "" for r in rows]
        own = [i for i in range(len(rows) - 1) if not rows[i][4]]
        edits = [edited(texts[i], texts[i + 1]).encode() for i in own]
        marks, edit_marks = fingerprints([t.encode() for t in texts]), fingerprints(edits)
        at = np.array(own, np.int64)
        cols = [[rows[i][0] for i in own], [len(texts[i]) for i in own], [hashlib.sha256(e).hexdigest() for e in edits], [marks[i].tobytes().hex() for i in own], [e.tobytes().hex() for e in edit_marks], likeness(marks[at], edit_marks), likeness(marks[at], marks[at + 1])]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in OUT.split(", ")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows_of(batches):
            held.append(row)
            size += len(row[1] or "")
            if size > limit:
                yield work(held)
                held, size = held[-1:], len(held[-1][1] or "")
        if len(held) > 1:
            yield work(held)

    return dealt.select("doc_id", "text", "k", "b", "last").mapInArrow(find, OUT)


def within(marks: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """marks, queries: a column fingerprint (hex). Returns query, fingerprint, distance for all distinct pairs within the radius; blocks must exceed it. With the
    defaults there are 10 tables keyed by 51 bits, so even of 10^12 fingerprints few share a key by chance."""
    if blocks <= radius:
        raise ValueError("with so few blocks, a radius can touch all of them")
    cut = [8 * BYTES * i // blocks for i in range(blocks + 1)]

    def block(b: int) -> Column:
        """The block's bits: parts of the two 64-bit halves, moved to the low end."""
        parts = []
        for h in range(BYTES // 8):
            low, high = max(cut[b], 64 * h), min(cut[b + 1], 64 * (h + 1))
            if low < high:
                parts.append(F.shiftrightunsigned(F.shiftleft(F.col("w")[h], low - 64 * h), 64 - (high - low)))
        return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        halves = [F.conv(F.substring("fingerprint", 1 + 16 * h, 16), 16, -10).cast("bigint") for h in range(BYTES // 8)]
        rows = df.select("fingerprint").where("fingerprint is not null").distinct().select(F.col("fingerprint").alias(name), F.array(*halves).alias("w"))
        keys = [F.xxhash64(F.lit(t), *[block(b) for b in chosen]) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
        return rows.select(F.col("w").alias(f"{name}_w"), F.explode(F.array(*keys)).alias("key"))

    distance = F.aggregate(F.zip_with("query_w", "fingerprint_w", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    pairs = keyed(queries, "query").join(keyed(marks, "fingerprint"), "key").withColumn("distance", distance)
    text = lambda w: F.lower(F.concat(*[F.lpad(F.hex(w[h]), 16, "0") for h in range(BYTES // 8)]))
    return pairs.where(F.col("distance") <= radius).select("query_w", "fingerprint_w", "distance").distinct().select(text(F.col("query_w")).alias("query"), text(F.col("fingerprint_w")).alias("fingerprint"), "distance")


#: The query searches for all fingerprints so near those of every twentieth document.
RADIUS, EVERY = 3, 20


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op5 query: fingerprints of all documents and of their edited texts; for ids divisible by 20 also n_near (other fingerprints within the radius, of all documents) and n_alike (other documents that have its own or one of these)."""
    rows = stored(fingerprint(table(spark, sf_dir, "documents")), "fingerprints")
    wanted = rows.where(F.col("doc_id") % EVERY == 0)
    found = stored(within(rows, wanted, RADIUS), "hamming")
    of = rows.groupBy("fingerprint").agg(F.count("*").alias("n"))
    near = found.join(of, "fingerprint").groupBy("query").agg(F.count_if(F.col("distance") > 0).alias("n_near"), (F.sum("n") - 1).alias("n_alike"))
    counts = wanted.select("doc_id", F.col("fingerprint").alias("query")).distinct().join(stored(near, "hamming-counts"), "query").select("doc_id", F.col("query").alias("fingerprint"), "n_near", "n_alike")
    return rows.join(counts, ["doc_id", "fingerprint"], "left").select(*rows.columns, "n_near", "n_alike")
