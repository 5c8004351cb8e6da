"""Scores texts by prediction by partial matching over bytes, and by a unigram base over words.

The model is a trie of byte contexts up to an order. A symbol (a byte, or the end of the text) is sought in the longest context
that was seen; a miss costs that context's escape (half its number of distinct symbols against its count: method D) and goes on
in the next shorter one, where the symbols of the longer one are excluded. A symbol's cost depends on the bytes before it only,
so a pretrained trie scores all positions of a batch at once; with adaptive=True a text's own counts are added as it is read.

Counts of grams and of words are summed over all training texts, grouped by key, with partial sums in each task. The model has
the same order and the same grams at every size; what goes to the executors is bounded. If the top level has at most max_nodes
grams, that is the whole trie. Else it is the trie of the longest contexts that fit (order 1 always does) and the most frequent
grams of the top level (at most head_grams); all other grams of the texts are priced once each by joins with the stored levels,
from the longest contexts down, and the prices are joined to the texts. Both ways give the same scores.
Of the words, the most frequent (at most head_words) go to the executors; the rest are joined by hash, once per text and word.

Cases: a null text is empty: one end token, and one end symbol. A null id counts as the empty string for the split. Without
training texts, all symbols are as likely and the base gives 1 to each token. Repeated rows have a row each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, hash_words, stored, table, text_chunks, utf8

ORDER, END, BITS = 5, 256, 9
WORD, GRAM = 0, 1


def symbols(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of order + 1 symbols for each position that is predicted, and how many each text has: its bytes and its end. END also stands before a text."""
    n = np.array([len(t) for t in texts], np.int64)
    seq = np.full(int(n.sum()) + len(texts) * (order + 1), END, np.int64)
    at = np.repeat(np.arange(len(texts)) * (order + 1) + order, n) + np.arange(int(n.sum()))
    seq[at] = np.frombuffer(b"".join(texts), np.uint8)
    code = np.zeros(len(seq) - order, np.int64)
    for i in range(order + 1):
        code = (code << BITS) | seq[i : len(seq) - order + i]
    ends = np.cumsum(n + order + 1)
    keep = np.ones(len(code), bool)
    for i in range(order):  # what would predict the marks before the next text
        keep[ends[:-1] - 1 - i] = False
    return code[keep], n + 1


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def counts(train: DataFrame, order: int = ORDER, spill: int = 1 << 20) -> DataFrame:
    """kind, key, n: words and grams of all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: []}

        def emit(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = _merged(held[kind])
            held[kind] = []
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[a : a + 100_000]), kind, np.int32)), pa.array(keys[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["kind", "key", "n"])

        for chunk in text_chunks(batches, limit=1 << 20):
            texts = utf8(chunk.column("text"))
            words = [w for t in texts for w in t.translate(LOWER).split()]
            for kind, keys in ((WORD, hash_words(words).view(np.int64)), (GRAM, symbols(texts, order)[0])):
                held[kind].append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held[kind]) > spill:
                    held[kind] = [_merged(held[kind])]
                    if len(held[kind][0][0]) > spill // 2:
                        yield from emit(kind)
        for kind in (WORD, GRAM):
            if held[kind]:
                yield from emit(kind)

    return train.select("text").mapInArrow(count, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(sorted_, x)
    i[i == len(sorted_)] = 0
    return i, sorted_[i] == x if len(sorted_) else np.zeros(len(x), bool)


def _mask(k: int) -> int:
    """Bits of a code's last k + 1 symbols."""
    return (1 << BITS * (k + 1)) - 1


class Costs:
    """Costs by gram: a hash table, and the sorted grams for those that lost a slot to a more frequent one."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, costs: np.ndarray):
        self.keys, self.all = keys, costs.astype(np.float32)
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 2))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.costs = np.zeros(len(self.slots), np.float32)
        rare_first = np.argsort(n, kind="stable")
        slot = self._slot(keys[rare_first])
        self.slots[slot] = keys[rare_first]
        self.costs[slot] = self.all[rare_first]

    def _slot(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs (0 for unknown grams), and where the unknown ones are."""
        slot = self._slot(codes)
        miss = np.flatnonzero(self.slots[slot] != codes)
        out = self.costs[slot].astype(np.float64)
        i, ok = _find(self.keys, codes[miss])
        out[miss[ok]] = self.all[i[ok]]
        out[miss[~ok]] = 0
        return out, miss[~ok]


class Trie:
    """Static PPM model of gram counts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int):
        self.order, self.levels = order, []
        for k in range(order, -1, -1):
            keys, c = _merged([(grams & _mask(k), n)])
            ctx, first = np.unique(keys >> BITS, return_index=True)
            self.levels.insert(0, [keys, c, ctx, np.add.reduceat(c, first) if len(c) else c, np.diff(np.r_[first, len(keys)]), None])
        for k in range(1, order + 1):  # counts, in the next shorter context, of the symbols that a context has
            keys, _, ctx, _, _, _ = self.levels[k]
            below = self.levels[k - 1]
            mass = below[1][_find(below[0], keys & _mask(k - 1))[0]] if len(keys) else keys
            self.levels[k][5] = np.add.reduceat(mass, np.searchsorted(keys >> BITS, ctx)) if len(keys) else mass
        keys, c, ctx, total, distinct, _ = self.levels[order]
        at = np.searchsorted(ctx, keys >> BITS)
        self.head = Costs(keys, c, np.log10((c - 0.5) / total[at]) if len(keys) else np.zeros(0))

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's last symbol after those before it."""
        out, rest = self.head.get(codes)
        out[rest] = self.escaped(codes[rest])
        return out

    def escaped(self, codes: np.ndarray, mass: np.ndarray | None = None, seen: np.ndarray | None = None) -> np.ndarray:
        """The same, level by level; mass and seen are the count and the number of symbols that longer contexts exclude."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        mass = np.zeros(len(codes)) if mass is None else mass.astype(np.float64)
        seen = np.zeros(len(codes), np.int64) if seen is None else seen.copy()
        for k in range(self.order, -1, -1):
            keys, c, ctx, total, distinct, inner = self.levels[k]
            code = codes[open_] & _mask(k)
            i, known = _find(ctx, code >> BITS)
            j, hit = _find(keys, code)
            if not len(keys):
                continue
            rest = np.where(known, total[i] - mass[open_], 0)
            new = np.where(known, distinct[i] - seen[open_], 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(hit, c[j] - 0.5, new / 2) / rest
            out[open_] += np.where(known & (rest > 0), np.log10(np.where(known & (rest > 0), p, 1)), 0)
            mass[open_] = np.where(known, inner[i], 0) if k else 0
            seen[open_] = np.where(known, distinct[i], 0)
            open_ = open_[~hit]
        out[open_] -= np.log10(np.maximum(1, END + 1 - seen[open_]))
        return out


def adaptive_score(text: bytes, trie: Trie | None = None, order: int = ORDER) -> float:
    """log10 probability of one text when its own symbols are learned as they are read, on top of a trie's counts."""
    seen: dict[tuple[int, int], dict[int, int]] = {}
    if trie:
        for k, (keys, c, *_) in enumerate(trie.levels):
            for key, n in zip(keys.tolist(), c.tolist()):
                seen.setdefault((k, key >> BITS), {})[key & ((1 << BITS) - 1)] = n
    total = 0.0
    for code in symbols([text], order)[0].tolist():
        symbol, excluded, done = code & ((1 << BITS) - 1), set(), False
        for k in range(order, -1, -1):
            own = seen.setdefault((k, (code & _mask(k)) >> BITS), {})
            left = {s: n for s, n in own.items() if s not in excluded}
            if left and not done:
                done = symbol in left
                total += math.log10((left[symbol] - 0.5 if done else len(left) / 2) / sum(left.values()))
                excluded |= left.keys()
            own[symbol] = own.get(symbol, 0) + 1
        if not done:
            total -= math.log10(END + 1 - len(excluded))
    return total


def shortened(grams: DataFrame, k: int) -> DataFrame:
    """key, n: grams of k + 1 symbols."""
    return grams.groupBy(F.col("key").bitwiseAND(F.lit(_mask(k))).alias("key")).agg(F.sum("n").alias("n"))


def train_trie(grams: DataFrame, order: int, max_nodes: int) -> Trie:
    """The trie of the longest contexts whose grams number at most max_nodes."""
    for k in range(order, 0, -1):
        level = grams if k == order else shortened(grams, k)
        if k == 1 or level.count() <= max_nodes:
            rows = level.toArrow()
            return Trie(rows.column("key").to_numpy(), rows.column("n").to_numpy(), k)
    raise ValueError("order must be 1 or more")


def levels(grams: DataFrame, low: int, order: int) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For contexts of low + 1 to order symbols: grams (key, n) and contexts (context, total, distinct, inner), stored. No key of these joins has over 257 rows."""
    out, below = {}, shortened(grams, low)
    for k in range(low + 1, order + 1):
        level = grams if k == order else stored(shortened(grams, k), "ppm-level")
        under = below.select(F.col("key").alias("under"), F.col("n").alias("m"))
        both = level.join(under, F.col("key").bitwiseAND(F.lit(_mask(k - 1))) == F.col("under"))
        contexts = both.groupBy(F.shiftright("key", BITS).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("m").alias("inner"))
        out[k], below = (level, stored(contexts, "ppm-contexts")), level
    return out


def head_costs(grams: DataFrame, contexts: DataFrame, most: int) -> Costs:
    """Of the top level, the bands of the most frequent grams that number at most `most` together."""
    cut = _cut(grams, most)
    cost = F.log10((F.col("n") - 0.5) / F.col("total"))
    rows = grams.where(_band() >= cut).join(contexts, F.shiftright("key", BITS) == F.col("context")).select("key", "n", cost.alias("cost")).toArrow()
    keys = rows.column("key").to_numpy()
    sort = np.argsort(keys)
    return Costs(keys[sort], rows.column("n").to_numpy()[sort], rows.column("cost").to_numpy()[sort])


def prices(codes: DataFrame, above: dict[int, tuple[DataFrame, DataFrame]], model: Broadcast) -> DataFrame:
    """code, cost: log10 probabilities of different codes, by joins with the levels above the broadcast trie and then by the trie."""
    out = codes.select("code", F.lit(0.0).alias("cost"), F.lit(0).cast("bigint").alias("mass"), F.lit(0).cast("bigint").alias("seen"), F.lit(False).alias("done"))
    for k in sorted(above, reverse=True):
        level, contexts = above[k]
        tail = F.col("code").bitwiseAND(F.lit(_mask(k)))
        out = out.withColumn("tail", F.when(~F.col("done"), tail)).withColumn("before", F.shiftright("tail", BITS))
        out = out.join(level, F.col("tail") == F.col("key"), "left").join(contexts, F.col("before") == F.col("context"), "left")
        rest, open_ = F.col("total") - F.col("mass"), ~F.col("done")
        p = F.when(F.col("n").isNotNull(), F.col("n") - 0.5).otherwise((F.col("distinct") - F.col("seen")) / 2) / rest
        out = out.select(
            "code",
            (F.col("cost") + F.when(open_ & (rest > 0), F.log10(p)).otherwise(0.0)).alias("cost"),
            F.when(open_, F.coalesce("inner", F.lit(0))).otherwise(0).cast("bigint").alias("mass"),
            F.when(open_, F.coalesce("distinct", F.lit(0))).otherwise(0).cast("bigint").alias("seen"),
            (F.col("done") | F.col("n").isNotNull()).alias("done"),
        )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = model.value[0]
        for batch in batches:
            code, cost, mass, seen = (batch.column(x).to_numpy() for x in ("code", "cost", "mass", "seen"))
            left = np.flatnonzero(~batch.column("done").to_numpy(zero_copy_only=False))
            cost = cost.copy()
            cost[left] += trie.escaped(code[left] & _mask(trie.order), mass[left], seen[left])
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(cost)], names=["code", "cost"])

    return out.mapInArrow(finish, "code bigint, cost double")


def _band() -> Column:
    return F.floor(F.log2("n") * 8)


def _cut(rows: DataFrame, most: int) -> int:
    """The least band of counts such that those from it on are at most so many rows."""
    cut, taken = 1 << 20, 0
    for r in sorted(rows.groupBy(_band().alias("band")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.band):
        if taken + r.rows > most:
            break
        cut, taken = r.band, taken + r.rows
    return cut


def _by_text(keys: np.ndarray, place: np.ndarray, texts: int) -> list[pa.Array]:
    """For each text, a list of its different keys and one of how often each comes."""
    order = np.lexsort((keys, place))
    keys, place = keys[order], place[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])][: len(keys)])
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(place[first], minlength=texts))], pa.int32())
    times = np.diff(np.r_[first, len(keys)]).astype(np.int32)
    return [pa.ListArray.from_arrays(offsets, pa.array(keys[first])), pa.ListArray.from_arrays(offsets, pa.array(times))]


def _exploded(rows: DataFrame, keys: str, times: str, key: str) -> DataFrame:
    return rows.select("row", F.explode(F.arrays_zip(keys, times)).alias("x")).select("row", F.col(f"x.{keys}").alias(key), F.col(f"x.{times}").alias("times"))


def score(docs: DataFrame, held_out: int = 1, folds: int = 5, order: int = ORDER, max_nodes: int = 1 << 21, head_grams: int = 1 << 21, head_words: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all texts; texts whose crc32(id) mod folds is held_out are not learned from."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    train = docs.where(fold != held_out)
    table_ = stored(counts(train, order), "ppm-counts")
    words, grams = (table_.where(F.col("kind") == kind).select("key", "n") for kind in (WORD, GRAM))
    ends = train.count()
    all_words = words.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_all, n_distinct = all_words.n + ends, all_words.words + (ends > 0)
    cut = _cut(words, head_words)
    head = words.where(_band() >= cut).toArrow()
    sort = np.argsort(keys := head.column("key").to_numpy())
    trie = train_trie(grams, order, max_nodes)
    above = levels(grams, trie.order, order)
    top = head_costs(grams, above[order][1], head_grams) if above else None
    shared = spark.sparkContext.broadcast((trie, top, keys[sort], head.column("n").to_numpy()[sort]))
    least = n_all + 0.5 * (n_distinct + 1)
    end_score = math.log10((ends + 0.5) / least)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top, keys, n = shared.value
        costs, row = np.log10((n + 0.5) / least), TaskContext.get().partitionId() << 33
        for chunk in text_chunks(batches, limit=1 << 20):
            ids, texts = chunk.column("doc_id").to_pylist(), utf8(chunk.column("text"))
            codes, sizes = symbols(texts, order)
            cost, rest = (model.score(codes), np.zeros(0, np.int64)) if top is None else top.get(codes)
            score = np.add.reduceat(cost, np.cumsum(sizes) - sizes)
            grams = _by_text(codes[rest], np.repeat(np.arange(len(texts)), sizes)[rest], len(texts))
            split = [t.translate(LOWER).split() for t in texts]
            lengths = np.array([len(w) for w in split], np.int64)
            own = hash_words([w for words in split for w in words]).view(np.int64)
            doc = np.repeat(np.arange(len(texts)), lengths)
            i, ok = _find(keys, own)
            base = np.bincount(doc[ok], costs[i[ok]], len(texts)) + end_score
            known = np.bincount(doc[ok], minlength=len(texts)) + (ends > 0)
            out = [zlib.crc32(("" if d is None else str(d)).encode()) % folds == held_out for d in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(texts))), chunk.column("doc_id"), pa.array(out), pa.array(lengths + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), *_by_text(own[~ok], doc[~ok], len(texts)), *grams],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "far", "times", "grams", "gram_times"],
            )
            row += len(texts)

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, far array<bigint>, times array<int>, grams array<bigint>, gram_times array<int>"
    rows = stored(docs.mapInArrow(read, schema), "ppm-scored")
    far = _exploded(rows, "far", "times", "key").join(words.where(_band() < cut), "key", "left")
    far = far.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / least)).alias("base"))
    whole = rows.drop("far", "times", "grams", "gram_times").join(far, "row", "left")
    total = F.col("score")
    if above:
        far = _exploded(rows, "grams", "gram_times", "code")
        priced = far.join(prices(far.select("code").distinct(), above, shared), "code")
        whole = whole.join(priced.groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("rest")), "row", "left")
        total += F.coalesce("rest", F.lit(0.0))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), total.alias("score"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op3 query: all documents scored."""
    return score(table(spark, sf_dir, "documents"))
