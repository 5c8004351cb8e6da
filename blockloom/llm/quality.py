"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted texts.

Trusted texts are those with label quality 1. All of them train the model, and all set the thresholds. Those above come from costs of texts that a model does not know: trusted documents
have two halves, by a hash of the id, each half trains a model of its own besides that of all, and a document is held against the other half's. The lower limit is of the costs by the model of all, which judges.
Counts of n-grams are grouped by key over all executors. Continuation counts, discounts, interpolation weights and probabilities come from joins of the counts, level by level, on the n-gram and on its context.
The finished tables go to the executors; there a document's perplexity is the mean cost of its bytes and its end. Larger tables go in parts, by the symbol before the predicted one, one after another:
of a part come the whole costs of the n-grams that have its symbols there, and a text's cost is the sum over parts.
A document is rejected if its perplexity lies outside the trusted quantiles of its language, widened by a margin: above it is noise, below it is repetition.
Where a language has fewer than min_held trusted documents, too few for its quantiles, its band is at least that of all languages together; one without any takes that.

Cases: a null or empty text has no perplexity and is rejected. Without trusted documents all others are kept. Null ids have no
label; their rows are judged like others. A label that repeats or contradicts: a document is trusted if none of its labels is other than 1. Repeated documents have a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_by_key, stored, table, text_chunks, utf8
from .ppm import BITS, END, _find, _merged, symbols

ORDER = 3
#: So many n-grams of a model go to all executors at once, with those of the two halves' models that are among them.
MAX_GRAMS = 1 << 20
#: So many ids of trusted documents (8 bytes each) are sent to all executors at most; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def gram_counts(texts: DataFrame, order: int, half: str | None = None, spill: int = 1 << 20) -> DataFrame:
    """key, c: occurrences of order + 1 symbols. With half, the name of a boolean column, also c0 and c1: those in its false and its true rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]

        def emit(of: int) -> Iterator[pa.RecordBatch]:
            keys, n = _merged(held[of])
            held[of] = []
            for a in range(0, len(keys), 1 << 17):
                part = keys[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), of == 1)), pa.array(part), pa.array(n[a : a + (1 << 17)])], names=["half", "key", "c"])

        for chunk in text_chunks(batches, limit=1 << 20):
            for of in (0, 1):
                own = utf8(chunk.filter(pc.equal(chunk.column("half"), of == 1)).column("text"))
                if own:
                    held[of] = [_merged([*held[of], np.unique(symbols(own, order)[0], return_counts=True)])]
                    if len(held[of][0][0]) > spill:
                        yield from emit(of)
        for of in (0, 1):
            if held[of]:
                yield from emit(of)

    rows = texts.select("text", (F.col(half) if half else F.lit(False)).alias("half")).mapInArrow(count, "half boolean, key bigint, c bigint").groupBy("key")
    sums = [F.coalesce(F.sum(F.when(F.col("half") == (of == 1), F.col("c"))), F.lit(0)).alias(f"c{of}") for of in (0, 1)]
    return rows.agg(F.sum("c").alias("c"), *(sums if half else []))


def kneser_ney(grams: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """By level from 0: key, p (interpolated probability) and ctx, g (the weight of what is below)."""
    counts = [stored(grams, "kn-counts")]
    for k in range(order, 0, -1):  # below the top, a gram counts the symbols that it was seen after
        counts.insert(0, stored(counts[0].groupBy(F.col("key").bitwiseAND((1 << BITS * k) - 1).alias("key")).agg(F.count("*").alias("c")), "kn-counts"))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for k, level in enumerate(counts):
        n = level.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        y = n.n1 / (n.n1 + 2 * n.n2) if n.n1 and n.n2 else 0.5
        d = [min(i - 0.1, max(0.1, i - (i + 1) * y * a / b)) if a and b else 0.5 for i, a, b in ((1, n.n2, n.n1), (2, n.n3, n.n2), (3, n.n4, n.n3))]
        ctx = F.shiftright("key", BITS).alias("ctx")
        lost = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        weights = level.groupBy(ctx).agg(F.sum("c").alias("total"), (F.sum(lost) / F.sum("c")).alias("g"))
        rows = level.select("key", ctx, "c", lost.alias("d")).join(weights, "ctx")
        if k:
            rows = rows.withColumn("low", F.col("key").bitwiseAND((1 << BITS * k) - 1)).join(levels[-1][0].select(F.col("key").alias("low"), F.col("p").alias("below")), "low")
        else:
            rows = rows.withColumn("below", F.lit(1 / (END + 1)))
        p = stored(rows.select("key", ((F.col("c") - F.col("d")) / F.col("total") + F.col("g") * F.col("below")).alias("p")), "kn-level")
        levels.append((p, weights.select("ctx", "g")))
    return levels


def _last(codes: Column) -> Column:
    """The last symbol: of a context, that before the predicted one."""
    return codes.bitwiseAND((1 << BITS) - 1)


def parts(levels: list[tuple[DataFrame, DataFrame]], most: int) -> list[tuple[int, int]]:
    """Ranges of symbols before the predicted one, with at most `most` n-grams each or a single symbol."""
    keys = reduce(DataFrame.union, [p.select(_last(F.shiftright("key", BITS)).alias("s")) for k, (p, _) in enumerate(levels) if k])
    n = {r.s: r.n for r in keys.groupBy("s").agg(F.count("*").alias("n")).collect()}
    out, first, held = [], 0, 0
    for s in range(END + 1):
        if held and held + n.get(s, 0) > most:
            out, first, held = [*out, (first, s - 1)], s, 0
        held += n.get(s, 0)
    return [*out, (first, END)]


class Model:
    """The finished levels in memory, or the part of them with these symbols before the predicted one."""

    def __init__(self, levels: list[tuple[DataFrame, DataFrame]], part: tuple[int, int] = (0, END)):
        self.levels = []
        for k, (p, g) in enumerate(levels):
            if k and part != (0, END):
                p, g = p.where(_last(F.shiftright("key", BITS)).between(*part)), g.where(_last(F.col("ctx")).between(*part))
            p, g = p.toArrow(), g.toArrow()
            a, b = (x.column(0).to_numpy() for x in (p, g))
            i, j = np.argsort(a), np.argsort(b)
            self.levels.append((a[i], np.log2(p.column("p").to_numpy()[i]), b[j], np.log2(g.column("g").to_numpy()[j])))

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each code's last symbol."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(len(self.levels) - 1, -1, -1):
            keys, p, ctx, g = self.levels[k]
            code = codes[open_] & ((1 << BITS * (k + 1)) - 1)
            i, hit = _find(keys, code)
            out[open_[hit]] -= p[i[hit]]
            code, open_ = code[~hit], open_[~hit]
            i, known = _find(ctx, code >> BITS)
            out[open_[known]] -= g[i[known]]
        out[open_] += np.log2(END + 1)
        return out


def costs(docs: DataFrame, models: list[list[tuple[DataFrame, DataFrame]]], max_grams: int) -> DataFrame:
    """doc_id, t (hash of the text), lang, n_bytes and, for each model's levels, c0, c1 and so on: bits a symbol, null without bytes."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("t"), "lang", "text")
    order, names = len(models[0]) - 1, [f"c{i}" for i in range(len(models))]
    shares = parts(models[0], max_grams)

    def scored(part: tuple[int, int]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast([Model(levels, part) for levels in models])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in text_chunks(batches, limit=1 << 20):
                codes, n = symbols(utf8(chunk.column("text")), order)
                seen, back = np.unique(codes, return_inverse=True)
                before = seen >> BITS & (1 << BITS) - 1
                mine = (before >= part[0]) & (before <= part[1])
                bits = []
                for model in shared.value:
                    cost = np.zeros(len(seen))
                    cost[mine] = model.cost(seen[mine])
                    bits.append(np.add.reduceat(cost[back], np.cumsum(n) - n))
                yield pa.RecordBatch.from_arrays([*[chunk.column(c) for c in ("doc_id", "t", "lang")], pa.array(n - 1), *[pa.array(b / n, mask=n == 1) for b in bits]], names=["doc_id", "t", "lang", "n_bytes", *names])

        return docs.mapInArrow(read, f"doc_id bigint, t bigint, lang string, n_bytes bigint, {', '.join(f'{c} double' for c in names)}")

    if len(shares) == 1:
        return stored(scored(shares[0]), "costs")
    # Costs are the text's, so the other parts' are joined by its hash.
    first, *rest = [stored(scored(part), "costs-part") for part in shares]
    rest = reduce(DataFrame.union, [x.groupBy("t").agg(*[F.max(c).alias(c) for c in names]) for x in rest]).groupBy("t").agg(*[F.sum(c).alias(f"more_{c}") for c in names])
    return stored(first.join(stored(rest, "costs-rest"), "t").select("doc_id", "t", "lang", "n_bytes", *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in names]), "costs")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, tail: float = 0.002, margin: float = 0.12, min_held: int = 30, max_grams: int = MAX_GRAMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, least, most, keep. A language with fewer than min_held trusted documents has at least the band of all languages together. max_grams: n-grams of a model that go to the executors at once."""
    return _classified(docs, labels, order, tail, margin, min_held, max_grams, id_col, text_col, lang_col).drop("t")


def _classified(docs: DataFrame, labels: DataFrame, order: int = ORDER, tail: float = 0.002, margin: float = 0.12, min_held: int = 30, max_grams: int = MAX_GRAMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 1
    good = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("trusted"))
    trusted = stored(good.where("trusted and doc_id is not null").select("doc_id"), "trusted")
    few_ids = trusted.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(trusted) if few_ids else trusted.hint("merge"), "doc_id", "left_semi").select("text", half.alias("half"))
    grams = stored(gram_counts(texts, order, "half"), "kn-halves")
    models = [kneser_ney(grams.where(F.col(c) > 0).select("key", F.col(c).alias("c")), order) for c in ("c", "c0", "c1")]
    scored = costs(docs, models, max_grams).select("doc_id", "t", "lang", "n_bytes", F.col("c0").alias("cost"), F.when(half, F.col("c1")).otherwise(F.col("c2")).alias("held"))
    known = scored.where("cost is not null").join(F.broadcast(trusted) if few_ids else trusted.hint("merge"), "doc_id", "left_semi")
    # Texts that the model was trained on cost less than others; the lower limit leaves them in.
    limits = [F.percentile_approx("cost", tail, 10000).alias("least"), F.percentile_approx("held", 1 - tail, 10000).alias("most")]
    by_lang = known.groupBy("lang").agg(*limits, F.count("held").alias("n_held")).withColumnRenamed("lang", "l")
    every = known.agg(*limits).first()
    of_all = {n: F.lit(every[n]).cast("double") for n in ("least", "most")}
    few = F.coalesce(F.col("n_held") < min_held, F.lit(True))
    low = F.when(few, F.least("least", of_all["least"])).otherwise(F.col("least")) * (1 - margin)
    high = F.when(few, F.greatest("most", of_all["most"])).otherwise(F.col("most")) * (1 + margin)
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumns({"least": low, "most": high})
    keep = F.col("cost").isNotNull() & F.coalesce(F.col("cost").between(F.col("least"), F.col("most")), F.lit(True))
    return out.select("doc_id", "t", "lang", "n_bytes", F.pow(F.lit(2.0), "cost").alias("perplexity"), F.pow(F.lit(2.0), "least").alias("least"), F.pow(F.lit(2.0), "most").alias("most"), keep.alias("keep"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op9 query: all documents classified."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that classify() keeps, with all their columns. Each row is judged by its own text, rows without an id and different texts under one id too."""
    return rows_by_key(docs, _classified(docs, labels).where("keep"))
