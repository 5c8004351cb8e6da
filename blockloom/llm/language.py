"""Language identification by nearest centroid of TF-IDF n-gram vectors.

A text's letters are lower-cased; runs of all else count as one space. Its byte trigrams are hashed to DIMS dimensions; a dimension weighs the
square root of its count times its inverse document frequency over all learning documents, and vectors have length 1. For each language, a
sample of at most max_train learning documents is clustered by spherical k-means into `clusters` centroids (in a task per language,
which the sample bounds). A text gets the language of the most similar centroid by cosine; `accepted` is false where the cosine lies
under that centroid's floor, drawn from its members' distances.

Cases: `und` with score 0 for a null text, one without letters, or if nothing was learned. Learning takes text and a non-null language. A null id counts as the
empty string for the split. Ties go to the first language by name. Repeated documents have a row each. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_chunks

DIMS = 8192
NOT_LETTER = re.compile(r"[\W\d_]+")
OUT = "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean"


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by text and dimension, and which texts have letters."""
    folded = [NOT_LETTER.sub(" ", (t or "").lower()).strip() for t in texts]
    data = [f" {t} ".encode() for t in folded]
    n = np.array([len(d) for d in data], np.int64)
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros((len(texts), DIMS), np.float32), np.array([bool(t) for t in folded])
    with np.errstate(over="ignore"):
        code = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(19)
    doc = np.repeat(np.arange(len(texts)), n)
    inside = doc[:-2] == doc[2:]
    cells = doc[:-2][inside] * DIMS + code[inside]
    return np.bincount(cells, minlength=len(texts) * DIMS).reshape(len(texts), DIMS).astype(np.float32), np.array([bool(t) for t in folded])


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; begins at the first vector and then at those least like the chosen ones."""
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centres = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each dimension, and how many there are: sums over tasks, then over a row per dimension."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for chunk in text_chunks(batches, limit=1 << 20):
            total += (grams(chunk.column("text").to_pylist())[0] > 0).sum(axis=0)
            n += chunk.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(np.r_[total, n])], names=["i", "n"])

    rows = docs.select("text").mapInArrow(count, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        out[r.i] = r.n
    return out[:-1], int(out[-1])


def identify(docs: DataFrame, held_out: int = 2, folds: int = 4, clusters: int = 4, max_train: int = 400, slack: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """OUT for all documents; those whose crc32(id) mod folds is held_out are not learned from."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    train = docs.where((fold != held_out) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
    place = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = {r.lang: min(1.0, max_train / r.n) for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    rate = F.try_element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang")) if share else F.lit(0.0)
    sc = docs.sparkSession.sparkContext
    weights = sc.broadcast(idf)

    def centres(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "text"])
        counts, letters = grams(pdf.text.tolist())
        x = vectors(counts[letters], weights.value)
        if not len(x):
            return pd.DataFrame({"lang": [], "centre": [], "floor": []})
        c = cluster(x, clusters)
        like = x @ c.T
        own = like.argmax(axis=1)
        floors = [slack * float(like[own == i, i].min()) if (own == i).any() else 0.0 for i in range(len(c))]
        return pd.DataFrame({"lang": [key[0]] * len(c), "centre": [r.astype("<f4").tobytes() for r in c], "floor": floors})

    sample = train.where(place < rate).select("doc_id", "lang", "text")
    found = sorted(sample.groupBy("lang").applyInPandas(centres, "lang string, centre binary, floor double").collect(), key=lambda r: (r.lang, r.centre))  # a few rows per language
    model = sc.broadcast(([r.lang for r in found], np.stack([np.frombuffer(r.centre, "<f4") for r in found]) if found else np.zeros((0, DIMS), np.float32), np.array([r.floor for r in found])))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, floors = model.value
        names = np.array(names, object)
        for chunk in text_chunks(batches, limit=1 << 20):
            counts, letters = grams(chunk.column("text").to_pylist())
            if len(names):
                like = vectors(counts, weights.value) @ c.T
                best = like.argmax(axis=1)
                score = np.where(letters, np.clip(like[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                pred, ok = np.where(letters, names[best], "und"), letters & (score >= floors[best])
            else:
                score, pred, ok = np.zeros(len(letters)), np.full(len(letters), "und", object), np.zeros(len(letters), bool)
            out = [zlib.crc32(("" if d is None else str(d)).encode()) % folds == held_out for d in chunk.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(out), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(ok)], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(predict, OUT)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op10 query: languages of all documents."""
    return identify(table(spark, sf_dir, "documents"))
