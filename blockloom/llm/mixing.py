"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Sizes are summed by source and hash bucket: a block is one bucket of one source. A source has so many buckets that a block has about block_words words at
   most, and all sources together have about max_blocks at most, so blocks grow where the corpus is very large.
2. Targets: the budget is shared by weight; what lies above a source's limit is shared again by weight (water filling).
3. A source's blocks are permuted. A target of f whole passes and a rest draws all blocks f times and then the rest from the
   front of the permutation; the block that the rest ends in gives a part of its words. So words taken equal the floored target. With
   whole=True the document that the rest ends in is taken whole if the rest has at least half of it, else not at all.
4. The exact numbers of drawn blocks, one for each source, are split over the output shards by a binary tree: at a node, the
   left half's share of each source is a multivariate-hypergeometric draw (seeded by node, so reruns agree). The leaves' ranges
   of the permutation are disjoint, and rows get a hash position to be shuffled by within their shard.

One row per block reaches a source's window, so a source with a third of all rows is pre-aggregated. Texts are moved once.

Cases: null text has size 0, a source without words has target 0. Null is a source of its own, last in order. Repeated rows
each count. Helper columns are named __mix_*; all columns of the input stay. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Words are runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: So many sources' numbers of blocks are sent to all executors at most; more are joined by a shuffle.
BROADCAST_SOURCES = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _let(name: str, value: str, body: str) -> str:
    """SQL text: body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _log_factorial(n: str) -> str:
    """SQL text: Stirling's series at n + 9, taken back by the product of the eight numbers above n."""
    product = " * ".join(f"(x + {i})" for i in range(1, 9))
    series = f"(x + 8.5D) * ln(x + 9) - (x + 9) + {0.5 * math.log(2 * math.pi)}D + 1 / (12 * (x + 9)) - 1 / (360 * pow(x + 9, 3)) + 1 / (1260 * pow(x + 9, 5))"
    return _let("x", f"double({n})", f"{series} - ln({product})")


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'{n} - {k}')})"


def hypergeometric(u: str, total: str, marked: str, drawn: str) -> str:
    """SQL text: inverse of the hypergeometric distribution at u: marked ones among `drawn` of `total`. The values searched reach 12 deviations and 12 to either side of the mean; beyond is less than a
    double can show. The first one's probability comes from factorials, each further one's from the one before."""
    mean = "(double(a.m) * a.k / greatest(a.n, 1))"
    wide = f"(12 * sqrt(greatest({mean} * (1 - double(a.k) / greatest(a.n, 1)), 0D)) + 12)"
    span = f"named_struct('low', greatest(0L, a.m + a.k - a.n, bigint(floor({mean} - {wide}))), 'high', least(a.m, a.k, bigint(ceil({mean} + {wide}))))"
    first = f"exp({_log_choose('a.k', 'b.low')} + {_log_choose('(a.n - a.k)', '(a.m - b.low)')} - {_log_choose('a.n', 'a.m')})"
    ratio = "double(a.k - i) * double(a.m - i) / (double(i + 1) * double(a.n - a.k - a.m + i + 1))"
    step = f"named_struct('c', s.c + s.p, 'p', s.p * {ratio}, 'r', if(s.c + s.p <= a.u, i + 1, s.r))"
    search = f"aggregate(sequence(b.low, b.high), named_struct('c', 0D, 'p', {first}, 'r', b.low), (s, i) -> {step}, s -> least(s.r, b.high))"
    return _let("a", f"named_struct('u', {u}, 'n', bigint({total}), 'k', bigint({marked}), 'm', bigint({drawn}))", _let("b", span, search))


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: one row, an array q of the sources' numbers of blocks. A row per shard: shard, q. Each level halves every node. As SQL text, since a plan of so many expressions is slow to build one by one."""
    total = lambda xs: f"aggregate({xs}, 0L, (x, y) -> x + y)"
    uniform = f"shiftrightunsigned(xxhash64({seed}, low, high, j), 11) / {float(1 << 53):.1f}D"
    draw = hypergeometric(uniform, f"all - {total('slice(q, 1, j - 1)')}", "element_at(q, j)", f"share - {total('done')}")
    left = f"aggregate(slice(sequence(0, size(q)), 2, size(q)), cast(array() as array<bigint>), (done, j) -> array_append(done, {draw}))"
    halves = _let("l", left, "array(named_struct('q', l, 'low', low, 'high', mid), named_struct('q', zip_with(q, l, (x, y) -> x - y), 'low', mid, 'high', high))")
    nodes = quotas.selectExpr("q", "0 as low", f"{shards} as high")
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        nodes = nodes.selectExpr("q", "low", "high", "int(floor((low + high) / 2)) as mid", f"{total('q')} as all")
        nodes = nodes.selectExpr("*", "bigint(floor(all * (mid - low) / greatest(1, high - low) + 0.5D)) as share")
        nodes = nodes.selectExpr(f"explode(if(high - low > 1, {halves}, array(named_struct('q', q, 'low', low, 'high', high)))) as h").selectExpr("h.q", "h.low", "h.high")
    return nodes.selectExpr("low as shard", "q")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """sizes: __mix_s, source, words. Adds target: the budget of share times all words by weight, at most limit times a source's words each."""
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("__mix_source").isNull(), "__mix_source"))
    w = sizes.withColumn("__mix_rank", rank).withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("__mix_rank") - 1) % len(weights) + 1))
    w = w.withColumns({"cap": limit * F.col("source_size"), "budget": share * F.sum("source_size").over(every)}).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "__mix_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    w = w.withColumn("level", level)
    free = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "__mix_rank", "level"))).over(every)["level"]
    return w.withColumn("target", F.least(F.col("cap"), F.coalesce(free * F.col("w"), F.col("cap")))).drop("w", "cap", "budget", "ratio", "level")


def plan(docs: DataFrame, size_col: str = "size", source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, shards: int = 64, block_words: int = 1 << 18, max_blocks: int = 1 << 20, seed: int = 42, whole: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """The documents with source_size, target, taken (words the mix takes) and draws: an array of (epoch, shard, words). sizes: a stored table of the documents' id, source and size, from
    which the plan is made; docs is read once more for the rows. Without it docs is read four times."""
    base = docs if sizes is None else sizes
    total = base.agg(F.coalesce(F.sum(size_col), F.lit(0)).alias("n")).first().n
    block_words = max(block_words, math.ceil(total / max_blocks))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    buckets = stored(base.groupBy(key.alias("__mix_s")).agg(F.greatest(F.lit(1), F.ceil(F.sum(size_col) / block_words)).cast("bigint").alias("__mix_n")), "mix-buckets")
    buckets = F.broadcast(buckets) if buckets.count() <= BROADCAST_SOURCES else buckets.hint("merge")

    def in_blocks(df: DataFrame) -> DataFrame:
        rows = df.withColumns({"__mix_s": key, "__mix_h": F.xxhash64(F.lit(seed), F.col(id_col))}).join(buckets, "__mix_s")
        return rows.withColumn("__mix_b", F.pmod(F.xxhash64(F.lit(seed + 1), "__mix_h"), F.col("__mix_n"))).drop("__mix_n")

    rows = in_blocks(docs)
    blocks = in_blocks(base).groupBy("__mix_s", "__mix_b").agg(F.sum(size_col).alias("words"), F.first(source_col).alias("__mix_source"))
    sources = targets(blocks.groupBy("__mix_s", "__mix_source").agg(F.sum("words").alias("source_size"), F.count("*").alias("n")), weights, share, limit)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    sources = sources.withColumn("rest", F.floor(F.col("target")).cast("bigint") - F.col("passes") * F.col("source_size")).drop("__mix_source")
    order = Window.partitionBy("__mix_s").orderBy(F.xxhash64(F.lit(seed + 2), "__mix_s", "__mix_b"), "__mix_b")
    ranked = blocks.drop("__mix_source").withColumns({"slot": F.row_number().over(order) - 1, "before": F.sum("words").over(order) - F.col("words")})
    drawn = stored(ranked.join(sources, "__mix_s").withColumn("part", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before"))).cast("bigint")), "mix-blocks")
    quota = drawn.groupBy("__mix_s", "__mix_rank").agg((F.first("passes") * F.first("n") + F.count_if(F.col("part") > 0)).alias("quota"))
    one = quota.agg(F.transform(F.array_sort(F.collect_list(F.struct("__mix_rank", "quota", "__mix_s"))), lambda x: F.struct(x["__mix_s"].alias("s"), x["quota"].alias("k"))).alias("x")).withColumn("q", F.col("x.k"))
    leaves = split(one.select("q"), shards, seed).select("shard", F.posexplode("q").alias("i", "k"))
    ends = Window.partitionBy("i").orderBy("shard")
    bounds = leaves.withColumn("end", F.sum("k").over(ends)).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    named = one.select(F.posexplode("x.s").alias("i", "__mix_s")).join(bounds, "i").drop("i")
    shard_of = lambda slot: F.size(F.filter("ends", lambda e: e <= slot))
    draw = lambda epoch, words: F.struct(epoch.cast("int").alias("epoch"), shard_of(epoch * F.col("n") + F.col("slot")).alias("shard"), words.alias("words"))
    epochs = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("passes")), lambda e: (e < F.col("passes")) | (F.col("part") > 0))
    drawn = drawn.join(named, "__mix_s").select("__mix_s", "__mix_b", "source_size", "target", "passes", "part", F.transform(epochs, lambda e: draw(e, F.when(e < F.col("passes"), F.col("words")).otherwise(F.col("part")))).alias("__mix_d"))
    inside = Window.partitionBy("__mix_s", "__mix_b").orderBy("__mix_h", id_col, size_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__mix_before", F.coalesce(F.sum(size_col).over(inside), F.lit(0))).join(drawn, ["__mix_s", "__mix_b"])
    rows = rows.withColumn("__mix_part", F.greatest(F.lit(0), F.least(F.col(size_col), F.col("part") - F.col("__mix_before"))).cast("bigint"))
    if whole:
        rows = rows.withColumn("__mix_part", F.when(2 * F.col("__mix_part") >= F.col(size_col), F.col(size_col)).otherwise(0).cast("bigint"))
    own = F.transform("__mix_d", lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.when(d["epoch"] < F.col("passes"), F.col(size_col)).otherwise(F.col("__mix_part")).alias("words")))
    rows = rows.withColumns({"taken": F.col("passes") * F.col(size_col) + F.col("__mix_part"), "draws": F.filter(own, lambda d: d["words"] > 0)})
    return rows.select(*docs.columns, "source_size", "target", "taken", "draws")


def mix(planned: DataFrame, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """A row per draw of a plan: the columns, epoch, shard, words, and position, a hash by which a shard's rows are shuffled when written."""
    rows = planned.withColumn("__mix_draw", F.explode("draws")).drop("draws")
    rows = rows.select(*[c for c in rows.columns if c != "__mix_draw"], "__mix_draw.*")
    return rows.withColumn("position", F.xxhash64(F.lit(seed + 3), "shard", "epoch", id_col))


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text")))


def mixture(docs: DataFrame) -> DataFrame:
    """A row per draw of a mix of the documents: their columns, epoch, shard, words and position. All draws take whole texts."""
    docs = sized(docs)
    return mix(plan(docs, whole=True, sizes=stored(docs.select("doc_id", "source", "size"), "mix-sizes"))).drop("size", "taken")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op2 query: words that the mix takes from each document."""
    sizes = stored(sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size"), "mix-sizes")
    return plan(sizes).select("doc_id", "size", "source_size", "target", "taken", F.size("draws").alias("n_draws"), F.transform("draws", lambda d: d["shard"]).alias("shards"))
