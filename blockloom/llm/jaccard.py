"""Exact Jaccard join of word-shingle sets by PartEnum signatures, and the components of its links.

1. A text gives its set of distinct word shingles (64-bit hashes; 3 words unless told otherwise). Equal sets are one representative from here on.
2. Sizes fall into bands; a link belongs to the band of its smaller set, so a set has signatures of its own band and, unless it is too large for that, of the one
   below. A link needs a symmetric difference of at most k elements, k by the two sizes. The hash domain is cut into parts and each into n2 subparts. A set
   takes the first k // (k2 + 1) + 1 parts, k being the most that any of its links in the band may differ by: of the parts that two linked sets both take, one
   at least has at most k2 differences, so some choice of n2 - k2 of its subparts has none. Each choice's content is a signature, so linked sets share one.
   With spare parts, linked sets agree in more parts than there are spare ones; a set in which no more than these have an empty choice leaves its empty
   signatures out.
3. Signatures are dealt by their value; those of one set only go. Sets that share one form a group, and groups of the same sets are one. In a group each set
   carries a sketch: the parity of its elements in buckets. Two sketches differ in at most as many buckets as the sets differ in elements, so a pair whose
   sketches differ in more than k can't be linked. The other pairs of a group give a spanning forest; a very large group is dealt in pairs of blocks.
4. The components of these forests are compared exactly: in one task if small, else among neighbouring size classes in blocks, all pairs of blocks, each
   task holding two. A task returns a spanning forest of its links. Pairs of blocks come in rounds, by the blocks' distance: a round copies sets to about
   twice their size, and its shuffle goes before the next one, so all pairs take time that grows with the square of a component, but not disk.
5. Components of the forests give the result. Nothing is capped, and no pairs are emitted.

Cases: null and empty texts, or those without words, have an empty set and link with nothing. Fewer than 3 words are one shingle.
Repeated rows give a row each. Null ids are skipped when a component's id is chosen. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, hash_words, mix, row_key, rows_by_key, shingle_hashes, stored, table, text_chunks, utf8
from .graph import components

WIDTH, NUM, DEN = 3, 90, 100
#: Differences allowed in a part, and subparts of a part.
K2, N2 = 1, 2
SUBSETS = list(combinations(range(N2), N2 - K2))
#: Spare parts, as a share of those needed.
SPARE = 0.15
#: Bytes of text that one task's signatures come from, about; beyond so many tasks they grow with the corpus, and tasks sort on disk.
TASK_BYTES, MAX_TASKS = 16 << 20, 100_000


def bands(largest: int, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By band: its last size, the largest size that links with one in it, and the most differences of a link. A band's sizes grow by three tenths, more than a link's two sizes may differ by."""
    ends, low = [], 1
    while not ends or ends[-1] < largest:
        ends.append(max(low, low * 13 // 10, low * den // num))
        low = ends[-1] + 1
    last = np.array(ends, np.int64)
    reach = last * den // num
    return last, reach, (den - num) * (last + reach) // (den + num)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets, one after another and sorted within, and their sizes."""
    split = [t.translate(LOWER).split() for t in texts]
    hashes = hash_words([w for words in split for w in words])
    sets, at = [], 0
    for words in split:
        sets.append(np.unique(shingle_hashes(hashes[at : at + len(words)], width)))
        at += len(words)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def signatures(features: np.ndarray, sizes: np.ndarray, num: int = NUM, den: int = DEN, spare: float = SPARE) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of all sets and the number of each set's. Sets that link only with equal ones (k = 0) get none.

    Two linked sets agree in at least one part more than the spare ones, of those that both take. If one of the two has empty choices in no more than
    the spare parts, they agree in a part without any, and both emit it; if both have them in more, both emit all their signatures."""
    last, reach, most = bands(int(sizes.max(initial=1)) + 1, num, den)
    own = np.searchsorted(last, sizes)
    below = np.maximum(own - 1, 0)
    links = lambda a, b: (den - num) * (a + b) // (den + num)
    k_own, k_below = links(sizes, sizes * den // num), np.where((own > 0) & (sizes <= reach[below]), links(sizes, last[below]), 0)
    k_own[sizes == 0] = 0
    sets = np.r_[np.flatnonzero(k_own), np.flatnonzero(k_below)]
    band, k = np.r_[own[k_own > 0], below[k_below > 0]], np.r_[k_own[k_own > 0], k_below[k_below > 0]]
    order = np.argsort(sets, kind="stable")
    sets, band, k = sets[order], band[order], k[order]
    more = np.ceil(most // (K2 + 1) * spare).astype(np.int64)[band]
    parts, taken = most[band] // (K2 + 1) + 1 + more, k // (K2 + 1) + 1 + more
    starts = np.cumsum(sizes) - sizes
    first = np.cumsum(taken) - taken
    count = sizes[sets]
    entry = np.repeat(np.arange(len(sets)), count)
    x = features[np.repeat(starts[sets] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
    place = mix(x, 11)
    part = ((place >> np.uint64(8)) % parts[entry].astype(np.uint64)).astype(np.int64)
    used = part < taken[entry]
    entry, part, x, place = entry[used], part[used], x[used], place[used]
    slot = (first[entry] + part) * N2 + (place & np.uint64(255)).astype(np.int64) % N2
    content = np.zeros(int(taken.sum()) * N2, np.uint64)
    np.add.at(content, slot, mix(x, 12))
    held = np.bincount(slot, minlength=len(content)).reshape(-1, N2) > 0
    content = content.reshape(-1, N2)
    owner = np.repeat(np.arange(len(sets)), taken)
    name = mix(band[owner].astype(np.uint64) << np.uint64(40) | (np.arange(len(content)) - first[owner]).astype(np.uint64), 13)
    out = np.stack([mix(content[:, list(s)].sum(axis=1, dtype=np.uint64) + mix(name, 20 + i), 14) for i, s in enumerate(SUBSETS)], axis=1)
    full = np.stack([held[:, list(s)].any(axis=1) for s in SUBSETS], axis=1)
    full |= (np.bincount(owner, ~full.all(axis=1), len(sets)) > more)[owner, None]
    return out[full], np.bincount(sets[owner], full.sum(axis=1), len(sizes)).astype(np.int64)


def sketches(features: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Per set a bit for each bucket: whether its number of elements there is odd. There are 64 buckets or more, a power of two, at least twice the set's size up to 65536. Fewer pass many pairs that aren't linked, which join into components that outgrow the corpus."""
    bits = np.full(len(sizes), 64, np.int64)
    for _ in range(10):
        bits[bits < 2 * sizes] *= 2
    first = np.cumsum(bits) - bits
    bucket = (mix(features, 17) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(np.repeat(first, sizes) + bucket, minlength=int(bits.sum())) & 1).astype(np.uint8))
    offsets = np.r_[0, np.cumsum(bits // 8)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(odd)])


def signed(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, spare: float = SPARE) -> DataFrame:
    """Rows of two kinds: a document's (key, rep: the hash of its set, null if empty; doc) and a signature's (key, rep). Of equal sets in a task only the first has a sketch and signatures."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for chunk in text_chunks(batches):
            features, sizes = shingle_sets(utf8(chunk.column("text")), width)
            ends = np.r_[0, np.cumsum(sizes)]
            sums = np.r_[np.uint64(0), np.cumsum(mix(features, 15), dtype=np.uint64)]
            rep = mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64), 16).view(np.int64)
            new = np.zeros(len(sizes), bool)
            for i, r in enumerate(rep.tolist()):
                if sizes[i] and r not in seen:
                    seen.add(r)
                    new[i] = True
            own = features[np.repeat(new, sizes)]
            sketch = sketches(own, sizes[new]).take(pa.array(np.where(new, np.cumsum(new) - 1, 0), mask=~new))
            doc = pa.StructArray.from_arrays([chunk.column("doc_id"), chunk.column("t"), pa.array(sizes), sketch], fields=list(DOC_TYPE))
            key = np.where(sizes > 0, rep, chunk.column("t").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep, mask=sizes == 0), doc], names=["key", "rep", "doc"])
            sigs, n = signatures(own, sizes[new], num, den, spare)
            for a in range(0, len(sigs), 1 << 18):
                part = pa.array(sigs[a : a + (1 << 18)].view(np.int64))
                yield pa.RecordBatch.from_arrays([part, pa.array(np.repeat(rep[new], n)[a : a + (1 << 18)]), pa.nulls(len(part), DOC_TYPE)], names=["key", "rep", "doc"])

    return docs.mapInArrow(sign, f"key bigint, rep bigint, {DOC}")


DOC = "doc struct<doc_id: bigint, t: bigint, n: bigint, sketch: binary>"
DOC_TYPE = pa.struct([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, rep): documents as they are, and the members of groups of two sets or more. A group of up to `most` sets is named by its members, so equal ones can be merged; a larger one (big) by its signature."""
    key, reps = None, np.zeros(0, np.int64)  # the group that may go on in the next batch; of a big one, its last member
    big = False

    def rows(g: np.ndarray, rep: np.ndarray, large: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), large)), pa.array(rep), pa.nulls(len(g), DOC_TYPE)], names=["g", "big", "rep", "doc"])

    for batch in batches:
        is_doc = batch.column("doc").is_valid()
        docs = batch.filter(is_doc)
        if docs.num_rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(docs.num_rows, pa.int64()), pa.nulls(docs.num_rows, pa.bool_()), docs.column("rep"), docs.column("doc")], names=["g", "big", "rep", "doc"])
        mine = batch.filter(pc.invert(is_doc))
        if not mine.num_rows:
            continue
        sig, rep = mine.column("key").to_numpy(), mine.column("rep").to_numpy()
        if key is not None:
            sig, rep = np.r_[np.full(len(reps), key), sig], np.r_[reps, rep]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (rep[1:] != rep[:-1])]
        sig, rep = sig[new], rep[new]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[start, len(sig)])
        if big and size[0] > 1:  # what goes on of a big group; its held member is out already
            yield rows(np.full(size[0] - 1, key), rep[1 : size[0]], True)
        done = np.ones(len(start), bool)
        done[-1] = False
        done[0] &= not big
        yield from _named(sig, rep, start[done], size[done], most, rows)
        goes_on = big and len(start) == 1
        key, reps, big = sig[-1], rep[start[-1] :], goes_on
        if not big and size[-1] > most:
            yield rows(np.full(len(reps), key), reps, True)
            big = True
        if big:
            reps = reps[-1:]
    if key is not None and not big:
        yield from _named(np.full(len(reps), key), reps, np.zeros(1, np.int64), np.array([len(reps)]), most, rows)


def _named(sig: np.ndarray, rep: np.ndarray, start: np.ndarray, size: np.ndarray, most: int, rows) -> Iterator[pa.RecordBatch]:
    """Members of whole groups."""
    for large in (False, True):
        chosen = (size > most) if large else (size > 1) & (size <= most)
        if chosen.any():
            a, n = start[chosen], size[chosen]
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            if large:
                yield rows(sig[at], rep[at], True)
                continue
            name = mix(np.add.reduceat(mix(rep[at].view(np.uint64), 18), np.cumsum(n) - n) + n.astype(np.uint64), 19).view(np.int64)
            g, r = np.repeat(name, n), rep[at]
            once = np.unique(np.stack([g, r], axis=1), axis=0)
            yield rows(once[:, 0], once[:, 1], False)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nodes 0 to n - 1 and edges: the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        nxt = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(nxt, end, least)
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt


def folded(marks: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width in bytes: each row's place in the matrix of all sketches of this width or more, and that matrix, wider ones folded."""
    width = np.array([len(m) for m in marks])
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(width)[::-1].tolist():
        at = np.flatnonzero(width >= w)
        out[w] = (np.cumsum(width >= w) - 1, np.stack([np.bitwise_xor.reduce(np.frombuffer(marks[r], np.uint8).reshape(-1, w), axis=0) for r in at]))
    return out


def near_pairs(groups: np.ndarray, n: np.ndarray, marks: list[bytes], num: int, den: int, step: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by group: the pairs of rows in a group that sizes and sketches allow to be linked, some at a time."""
    start = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    size = np.diff(np.r_[start, len(groups)])
    width, by_width = np.array([len(m) for m in marks]), folded(marks)
    for z in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(z, 1)
        heads, many = start[size == z], max(1, step // len(i))
        for h in range(0, len(heads), many):
            a, b = ((heads[h : h + many, None] + x).ravel() for x in (i, j))
            ok = np.minimum(n[a], n[b]) * den >= num * np.maximum(n[a], n[b])
            a, b = a[ok], b[ok]
            w = np.minimum(width[a], width[b])
            for own in np.unique(w).tolist():
                place, m = by_width[own]
                pairs, part = np.flatnonzero(w == own), max(1, (1 << 23) // own)
                for x in range(0, len(pairs), part):
                    p, q = a[pairs[x : x + part]], b[pairs[x : x + part]]
                    keep = np.bitwise_count(m[place[p]] ^ m[place[q]]).sum(axis=1, dtype=np.int64) <= (den - num) * (n[p] + n[q]) // (den + num)
                    yield p[keep], q[keep]


def _near(batches: Iterator[pa.RecordBatch], num: int, den: int, limit: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, i, j): forests of the pairs that may be linked, over about `limit` rows at a time."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        reps, node = np.unique(rows.column("rep").to_numpy(), return_inverse=True)
        root, found = np.arange(len(reps)), [np.zeros((2, 0), np.int64)]

        def tie() -> None:
            nonlocal root, found
            up = np.flatnonzero(root != np.arange(len(reps)))
            a, b = np.concatenate([*found, [up, root[up]]], axis=1)
            root, found = _labels(len(reps), a, b), found[:1]

        for a, b in near_pairs(groups, rows.column("n").to_numpy(), rows.column("sketch").to_pylist(), num, den):
            found.append(np.stack([node[a], node[b]]))
            if sum(x.shape[1] for x in found) > 1 << 19:
                tie()
        tie()
        if (tied := root != np.arange(len(reps))).any():
            yield pa.RecordBatch.from_arrays([pa.array(reps[tied]), pa.array(reps[root[tied]])], names=["a", "b"])

    def named(rows: pa.Table) -> np.ndarray:
        g, i, j = (rows.column(x).to_numpy() for x in "gij")
        return np.cumsum(np.r_[0, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= limit:
            rows = pa.Table.from_batches(held)
            groups = named(rows)
            whole = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            if whole:
                yield from done(rows.slice(0, whole), groups[:whole])
            held = rows.slice(whole).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        rows = pa.Table.from_batches(held)
        yield from done(rows, named(rows))


def link_matrix(sets: list[np.ndarray], num: int = NUM, den: int = DEN, slice_: int = 4096) -> np.ndarray:
    """Which of two sets or more are linked, exactly; a set is linked with itself."""
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, feature, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = uses[feature] > 1
    dense = np.cumsum(uses > 1) - 1
    owner, feature = owner[keep], dense[feature[keep]]
    order = np.argsort(feature, kind="stable")
    owner, feature = owner[order], feature[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(feature[-1]) + 1 if len(feature) else 0, slice_):
        i, j = np.searchsorted(feature, [a, a + slice_])
        m = np.zeros((len(sets), min(slice_, int(feature[-1]) + 1 - a)), np.float32)
        m[owner[i:j], feature[i:j] - a] = 1
        shared += m @ m.T
    link = np.zeros(shared.shape, bool)
    for a in range(0, len(sets), 256):  # shared * den >= union * num, without wide copies of the whole
        link[a : a + 256] = (den + num) * shared[a : a + 256].astype(np.int64) >= num * (n[a : a + 256, None] + n[None, :])
    return link


def forest(reps: np.ndarray, sets: list[np.ndarray], num: int = NUM, den: int = DEN, link: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Exact links among sets, as a spanning forest: (rep, its tree's root)."""
    if len(sets) < 2:
        return []
    link = link_matrix(sets, num, den) if link is None else link
    edges, left = [], np.ones(len(sets), bool)
    for i in np.argsort(reps, kind="stable"):
        if left[i]:
            tree = new = np.zeros(len(sets), bool)
            new = new.copy()
            new[i] = True
            while new.any():
                tree = tree | new
                new = link[new].any(axis=0) & ~tree
            left &= ~tree
            edges += [(int(reps[x]), int(reps[i])) for x in np.flatnonzero(tree) if x != i]
    return edges


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int, counted: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (c, i, j): a group's exact links as a forest (a, b). counted: also rows (a, null, n): the documents of the sets that a is linked with, each pair in one of the tasks that it meets in."""
    names = ["rep", "features", *(["m", "low", "k", "nb"] if counted else [])]
    key, held = None, {}

    def done() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        reps, sets = np.array([*held], np.int64), [np.frombuffer(r[0], np.uint64) for r in held.values()]
        link = link_matrix(sets, num, den)
        out = [(a, b, None) for a, b in forest(reps, sets, num, den, link)]
        if counted and out:
            m, low, k, nb = (np.array([r[x] for r in held.values()]) for x in (1, 2, 3, 4))
            # A pair of one size class meets in two windows and counts in the one where the class is the lower; one of one block counts where the other block is the next.
            inner = (nb == 1) | (np.where(k == key[1], key[2], key[1]) == (k + 1) % nb)
            link &= low[:, None] | low[None, :]
            link &= (k[:, None] != k[None, :]) | inner[:, None]
            np.fill_diagonal(link, False)
            total = [int(m[row].sum()) for row in link]
            out += [(r, None, n) for r, n in zip(reps.tolist(), total) if n]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[x] for o in out], pa.int64()) for x in range(3 if counted else 2)], names=["a", "b", "n"][: 3 if counted else 2])

    for batch in batches:
        for row_key, row in zip(zip(*[batch.column(c).to_pylist() for c in "cij"]), zip(*[batch.column(c).to_pylist() for c in names])):
            if row_key != key:
                yield from done()
                key, held = row_key, {}
            held[row[0]] = row[1:]
    yield from done()


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches):
        features, sizes = shingle_sets(utf8(chunk.column("text")), width)
        ends = np.cumsum(sizes)
        own = [features[e - n : e].tobytes() for e, n in zip(ends, sizes)]
        yield pa.RecordBatch.from_arrays([*[chunk.column(c) for c in ("rep", "m", "ws")], pa.array(own, pa.binary())], names=["rep", "m", "ws", "features"])


def rounds(sized: DataFrame, weight: str) -> list[tuple[int, int]]:
    """Ranges of distances between blocks (0 within a single one), for rows in nb blocks: dealing one range copies rows to twice their whole weight at most."""
    nb, w = (np.array(x, np.float64) for x in zip(*sized.groupBy("nb").agg(F.sum(weight).alias("w")).select("nb", "w").collect() or [(1, 0)]))
    out, first, held, last = [], 0, 0.0, int(nb.max()) // 2
    for d in range(last + 1):
        copies = float((w * (nb == 1 if d == 0 else (2.0 * d <= nb) * 1 + (2.0 * d < nb))).sum())
        if held and held + copies > 2 * w.sum():
            out, first, held = [*out, (first, d - 1)], d, 0.0
        held += copies
    return [*out, (first, last)]


def in_blocks(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Deals rows of a key in nb blocks to pairs of blocks that are `first` to `last` apart, around the circle of blocks: adds i, j and k, the row's own block."""
    k, nb, near = F.col("k"), F.col("nb"), max(first, 1)
    apart = F.sequence(F.lit(near), F.least(F.lit(last), F.floor(nb / 2).cast("int")))
    others = F.array_distinct(F.flatten(F.transform(apart, lambda d: F.array(F.pmod(k + d, nb), F.pmod(k - d + nb, nb)))))
    others = F.when((nb > 1) & (nb >= 2 * near) & F.lit(last >= near), others).when((nb == 1) & F.lit(first == 0), F.array(F.lit(0)))
    both = rows.withColumn("k", F.pmod(F.xxhash64("rep"), nb).cast("int")).withColumn("o", F.explode(others))
    return both.withColumns({"i": F.least("k", "o"), "j": F.greatest("k", "o")}).drop("o")


def in_rounds(rows: DataFrame, ranges: list[tuple[int, int]], key: str, columns: list[str], tasks: int, work: Callable, schema: str, name: str) -> DataFrame:
    """What `work` finds in all pairs of blocks, sorted by key and pair; a stored table for each round."""
    found = []
    for first, last in ranges:
        dealt = in_blocks(rows, first, last).select(key, "i", "j", *columns).repartition(tasks, key, "i", "j").sortWithinPartitions(key, "i", "j")
        found.append(stored(dealt.mapInArrow(work, schema), name))
    return reduce(DataFrame.union, found)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_sets: int = 1024, block_features: int = 1 << 20, task_bytes: int = TASK_BYTES, width: int = WIDTH, num: int = NUM, den: int = DEN, spare: float = SPARE, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, t (hash of its text), n (set size), rep (the set's hash, null without words), m (documents with this set), first (their smallest id), g (its component) and with counted
    linked (documents of other sets that its set is linked with; null is none); and per component: g, least (smallest id), head (the first row's id and t, null ids last)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("t", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, -(-size // task_bytes)))
    dealt = signed(docs.select("doc_id", "t", "text"), width, num, den, spare).repartition(tasks, "key").sortWithinPartitions("key", "rep")
    grouped = stored(dealt.mapInArrow(lambda b: _groups(b, block_sets), f"g bigint, big boolean, rep bigint, {DOC}"), "signed")
    rows = grouped.where("doc is not null").select("doc.doc_id", "doc.t", "doc.n", "rep", "doc.sketch")
    members = grouped.where("doc is null").select("g", "big", "rep").distinct()
    reps = rows.where("rep is not null").groupBy("rep").agg(F.min(F.struct("t", "doc_id")).alias("d"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.count("*").alias("m"), F.min("doc_id").alias("first"))
    named = stored(members.join(reps, "rep").select("g", "big", "rep", "n", "sketch"), "groups")
    large = named.where("big")
    blocks = stored(large.groupBy("g").agg(F.ceil(2 * F.count("*") / block_sets).cast("int").alias("nb")), "blocks")
    pairs = named.where("not big").withColumn("nb", F.lit(1)).unionByName(large.join(blocks, "g")).withColumn("bytes", F.length("sketch") + 32)
    near = in_rounds(pairs, rounds(pairs, "bytes"), "g", ["rep", "n", "sketch"], tasks, lambda b: _near(b, num, den), "a bigint, b bigint", "near")
    roots = components(near)
    member = stored(roots.select(F.col("u").alias("rep"), F.col("root").alias("c")).union(roots.select(F.col("root").alias("rep"), F.col("root").alias("c")).distinct()), "candidates")
    one = stored(reps.drop("sketch", "first").join(member, "rep"), "chosen")
    count = F.greatest(F.ceil(F.sum("n") / block_features), F.ceil(F.count("*") / block_sets)).cast("int")
    blocks = stored(one.groupBy("c").agg(count.alias("nb")), "blocks")  # stored, as below: a join with an aggregate can't be split by Spark where one component is very large
    # Linked sets are in one size class or in neighbouring ones; a window is a class and the next one. Small components are one window.
    size_class = F.floor(F.log("n") / math.log(1.001 * den / num))
    windows = F.when(F.col("nb") == 1, F.array(F.lit(-2).cast("bigint"))).otherwise(F.array(size_class - 1, size_class))
    spread = stored(one.join(blocks, "c").select("rep", "c", "n", "m", "d", F.explode(windows).alias("w"), size_class.alias("s")), "windows")
    spread = spread.join(stored(spread.groupBy("c", "w").agg(count.alias("nb")), "blocks"), ["c", "w"])
    wanted = spread.groupBy("rep").agg(F.collect_list(F.struct(F.xxhash64("c", "w").alias("c"), "nb", ((F.col("w") == -2) | (F.col("w") == F.col("s"))).alias("low"))).alias("ws"), F.first("d").alias("d"), F.first("m").alias("m"))
    wanted = wanted.select("rep", "m", "ws", *row_key(F.col("d.doc_id"), F.col("d.t")))
    texts = docs.select("text", *row_key(F.col("doc_id"), F.col("t"))).join(wanted.hint("merge"), ["__id", "__no", "__t"]).select("rep", "m", "ws", "text")
    sets = stored(texts.mapInArrow(lambda b: _sets(b, width), "rep bigint, m bigint, ws array<struct<c: bigint, nb: int, low: boolean>>, features binary"), "features").select("rep", "m", "features", F.inline("ws"))
    compared = lambda columns, work, schema: in_rounds(sets, rounds(spread, "n"), "c", ["rep", "features", *columns], tasks, work, schema, "links")
    per_set = reps.select("rep", "m", "first")
    if counted:
        links = compared(["m", "low", "k", "nb"], lambda b: _verify(b, num, den, True), "a bigint, b bigint, n bigint")
        tree = components(links.where("b is not null").select("a", "b"))
        per_set = per_set.join(links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked")), "rep", "left")
    else:
        tree = components(compared([], lambda b: _verify(b, num, den), "a bigint, b bigint"))
    per_set = per_set.join(tree.withColumnRenamed("u", "rep"), "rep", "left").withColumn("g", F.coalesce("root", "rep")).drop("root")
    # Stored tables join, so that Spark can split a set or a component of very many documents.
    keyed = stored(rows.drop("sketch").join(stored(per_set, "sets"), "rep", "left"), "keyed")
    least = stored(keyed.where("rep is not null").groupBy("g").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t")).alias("head")), "least")
    return keyed, least


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, class_id (smallest id with an equal set; its own without words) and n_links (documents it is linked with, those of its own class too, itself not). Sets of
    shingles of `width` words link from a likeness of num / den; options are those of classes()."""
    keyed, least = classes(docs, id_col, text_col, counted=True, **options)
    keyed = keyed.withColumn("g", F.coalesce("g", F.xxhash64(F.lit("none"), "doc_id")))
    own = lambda c: F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col(c))
    n_links = F.coalesce(F.col("m") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0))
    return keyed.join(least, "g", "left").select("doc_id", F.col("n").alias("n_shingles"), own("least").alias("component_id"), own("first").alias("class_id"), n_links.alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents less all but the first of each component, by id (null ids last) and then by text. Of rows alike in id and text one stays; different texts under one id are
    judged each by itself. Rows without words link with nothing and stay."""
    keyed, least = classes(docs, id_col, text_col, **options)
    heads = least.select("head.doc_id", "head.t").union(keyed.where("rep is null").select("doc_id", "t"))
    return rows_by_key(docs, heads, id_col, text_col, once=True)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op8 query: components, classes and numbers of links of all documents."""
    return join(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b, shared = x.n AND shared = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links, min(b) FILTER (same) AS twin FROM l GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, least(d.doc_id, coalesce(twin, d.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
