"""Benchmark decontamination with a distributed positional inverted index.

The index has segments, each over some documents: a term dictionary, and per term the sorted list of token positions.
Segments are stored as rows of a table. A search sends the test phrases to every segment; there each phrase starts from
the postings of its locally rarest term and intersects them with the offset-adjusted postings of its other terms, from
rare to frequent. A proximity search starts from the same term's postings, keeps those that have all other terms within reach, and then looks
for a span of the given length that has them all, in any order. No postings are shuffled, and a segment has a bounded number of tokens unless one text is longer.

Cases: a null or empty text has no words, and no hits. An item of fewer words than a window is one window; an item
without words has none. A null item_id counts as the empty string. Repeated documents each get their row; repeated items with one
item_id count once. Columns besides the named ones are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_by_key, stored, table, text_chunks, utf8

#: Words have digits, letters and all beyond ASCII; A-Z fold to a-z, other bytes separate.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SEGMENT = "doc_ids array<bigint>, hashes array<bigint>, starts binary, lengths binary, terms binary, offsets binary, positions binary"
HITS = "doc_id bigint, t bigint, n_words bigint, n_hit bigint, items array<string>, near array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def segments(docs: DataFrame, gap: int, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20) -> DataFrame:
    """The positional inverted index: a row per segment. Documents lie `gap` positions apart, so no phrase of up to `gap` words crosses them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=segment_bytes):
            words: list[bytes] = []
            lengths = np.zeros(chunk.num_rows, np.int64)
            for i, text in enumerate(utf8(chunk.column("text"))):
                own = words_of(text)
                lengths[i] = len(own)
                words += own
            starts = np.cumsum(lengths) - lengths + gap * np.arange(len(lengths))
            ids = _Ids()
            term = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
            at = np.arange(len(words)) + gap * np.repeat(np.arange(len(lengths)), lengths)
            postings = np.sort(term << 32 | at)  # by term, then by position
            offsets = np.r_[0, np.cumsum(np.bincount(term, minlength=len(ids)))]
            row = [[chunk.column("doc_id").to_pylist()], [chunk.column("t").to_pylist()], [starts.tobytes()], [lengths.tobytes()], [b"\n".join(ids)], [offsets.astype(np.int64).tobytes()], [(postings & 0xFFFFFFFF).astype(np.uint32).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [*[pa.list_(pa.int64())] * 2, *[pa.binary()] * 5])], names=["doc_ids", "hashes", "starts", "lengths", "terms", "offsets", "positions"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t")).mapInArrow(build, SEGMENT)


class Segment:
    """A segment in memory."""

    def __init__(self, row: dict):
        self.doc_ids, self.starts, self.lengths = row["doc_ids"], np.frombuffer(row["starts"], np.int64), np.frombuffer(row["lengths"], np.int64)
        self.offsets, at = np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["positions"], np.uint32)
        self.counts = np.diff(self.offsets)
        self.positions = at.astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.counts), dtype=np.int64), self.counts) << 32 | self.positions
        self.terms = {w: i for i, w in enumerate(row["terms"].split(b"\n"))} if len(self.counts) else {}
        self.end = int(self.starts[-1] + self.lengths[-1]) if len(self.starts) else 0

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the terms' postings have the positions."""
        key = term << 32 | at
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return (self.keys[i] == key) & (at >= 0)

    def phrases(self, wanted: np.ndarray, budget: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """All (row of wanted, start position) where the row's terms stand consecutively. wanted: local term numbers, -1 for a term that isn't here."""
        rows = np.flatnonzero((wanted >= 0).all(axis=1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(rows):
            wanted = wanted[rows]
            by_rarity = np.argsort(self.counts[wanted], axis=1, kind="stable")
            first = np.take_along_axis(wanted, by_rarity[:, :1], 1)[:, 0]
            part = np.cumsum(self.counts[first]) // budget
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                n = self.counts[first[own]]
                row = np.repeat(own, n)
                start = self.positions[np.repeat(self.offsets[first[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())] - by_rarity[row, 0]
                for j in range(1, wanted.shape[1]):
                    col = by_rarity[row, j]
                    ok = self.has(wanted[row, col], start + col)
                    row, start = row[ok], start[ok]
                found.append((rows[row], start))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def next_at(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The terms' first positions from `at` on; far beyond the end where there is none."""
        i = np.searchsorted(self.keys, term << 32 | np.maximum(at, 0))
        found = self.keys[np.minimum(i, len(self.keys) - 1)]
        return np.where((i < len(self.keys)) & (found >> 32 == term), found & 0xFFFFFFFF, 1 << 40)

    def near(self, wanted: np.ndarray, within: int, budget: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(row of wanted, document) where some `within` consecutive words of the document have all of the row's terms, in any order. wanted: as for phrases; a term that stands there twice counts once."""
        rows = np.flatnonzero((wanted >= 0).all(axis=1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(rows):
            by_rarity = np.argsort(self.counts[wanted[rows]], axis=1, kind="stable")
            terms = np.take_along_axis(wanted[rows], by_rarity, 1)
            first = terms[:, 0]
            part = np.cumsum(self.counts[first]) // budget
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                n = self.counts[first[own]]
                row = np.repeat(own, n)
                at = self.positions[np.repeat(self.offsets[first[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                for j in range(1, terms.shape[1]):  # the rarest term's places that have each other term within reach
                    ok = self.next_at(terms[row, j], at - within + 1) < at + within
                    row, at = row[ok], at[ok]
                doc = self.doc_of(at)
                low, end = self.starts[doc], self.starts[doc] + self.lengths[doc]
                hit = np.zeros(len(row), bool)
                for back in range(within):  # a span of `within` words that begins so many words before
                    left = np.flatnonzero(~hit & (at - back >= low))
                    start = at[left] - back
                    last = np.max([self.next_at(terms[row[left], j], start) for j in range(terms.shape[1])], axis=0, initial=0)
                    hit[left] = last < np.minimum(start + within, end[left])
                found.append((rows[row[hit]], doc[hit]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def phrase_blocks(items: DataFrame, window: int, id_col: str, text_col: str, block_bytes: int) -> list[tuple]:
    """The test items as blocks of distinct windows. The driver holds the items' words; more than block_bytes of them are dealt to further blocks, each searched by itself."""
    blocks: list[tuple] = []
    size, phrases = 0, {}
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = words_of((row.t or "").encode())
        for a in range(max(1, len(words) - window + 1) if words else 0):
            phrases.setdefault(tuple(words[a : a + window]), set()).add(row.i or "")
        size += len(row.t or "") * window
        if size > block_bytes:
            blocks.append(phrases)
            size, phrases = 0, {}
    return [*blocks, phrases] if phrases or not blocks else blocks


def search(index: DataFrame, items: DataFrame, window: int = 8, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 32 << 20, within: int = 0) -> DataFrame:
    """Per document of the index: doc_id, n_words, n_hit (words inside occurring windows), items (sorted ids of items with occurring windows), and with `within`
    near: the sorted ids of items of which a window's words all stand, in any order, in that many consecutive words of the document."""
    return _search(index, items, window, id_col, text_col, block_bytes, within).drop("t", *([] if within else ["near"]))


def _search(index: DataFrame, items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 32 << 20, within: int = 0) -> DataFrame:
    sc = index.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in phrase_blocks(items, window, id_col, text_col, block_bytes)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                cover = np.zeros(seg.end + window + 1, np.int64)
                hits, near = ([set() for _ in seg.doc_ids] for _ in range(2))
                for block in blocks:
                    by_len: dict[int, list] = {}
                    for phrase in block.value:
                        local = [seg.terms.get(w, -1) for w in phrase]
                        if min(local) >= 0:
                            by_len.setdefault(len(phrase), []).append((local, phrase))
                    for n, group in by_len.items():
                        wanted = np.array([x for x, _ in group], np.int64)
                        which, start = seg.phrases(wanted)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + n, -1)
                        for doc, g in set(zip(seg.doc_of(start).tolist(), which.tolist())):
                            hits[doc] |= block.value[group[g][1]]
                        for g, doc in set(zip(*(x.tolist() for x in seg.near(wanted, within)))) if within else ():
                            near[doc] |= block.value[group[g][1]]
                inside = np.r_[0, np.cumsum(np.cumsum(cover) > 0)]
                n_hit = inside[seg.starts + seg.lengths] - inside[seg.starts]
                cols = [pa.array(seg.doc_ids, pa.int64()), pa.array(row["hashes"], pa.int64()), pa.array(seg.lengths), pa.array(n_hit), *[pa.array([sorted(x) for x in found], pa.list_(pa.string())) for found in (hits, near)]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "t", "n_words", "n_hit", "items", "near"])

    return index.mapInArrow(find, HITS)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 2, within: int = 0) -> DataFrame:
    """Index, store, search. Per document: doc_id, n_words, n_hit, items, contaminated (at least min_items items), and with `within` near."""
    index = stored(segments(docs, window), "postings")
    return search(index, items, window, within=within).withColumn("contaminated", F.size("items") >= min_items)


def keep_unseen(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 1) -> DataFrame:
    """The documents with windows of fewer than min_items test items, with all their columns. Each row is judged by its own text, rows without an id and different texts under one id too."""
    found = _search(stored(segments(docs, window), "postings"), items, window).where(F.size("items") >= min_items)
    return rows_by_key(docs, found, how="left_anti")


#: Words in which the query looks for all words of a window, in any order.
WITHIN = 12


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op4 query: benchmark items found in all documents."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), within=WITHIN)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.size("near").cast("bigint").alias("n_near"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item_id, w, least(8, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM bw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
m AS (SELECT r, i, dg.n, item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS s FROM m) GROUP BY r),
wt AS (SELECT g, list_distinct(string_split(g, ' ')) AS terms FROM (SELECT DISTINCT g FROM bg)),
pos AS (SELECT r, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM dw),
tc AS (SELECT term, count(*) AS c FROM pos GROUP BY term),
rare AS (SELECT g, arg_min(term, coalesce(c, 0)) AS term FROM (SELECT g, unnest(terms) AS term FROM wt) LEFT JOIN tc USING (term) GROUP BY g),
sp AS (SELECT DISTINCT r, g, unnest(range(greatest(1, i - 11), i + 1)) AS a FROM pos JOIN rare USING (term)),
nr AS (SELECT r, count(DISTINCT coalesce(CAST(item_id AS VARCHAR), '')) AS n_near FROM sp JOIN dw USING (r) JOIN wt USING (g) JOIN bg USING (g) WHERE list_has_all(list_slice(w, a, a + 11), terms) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN nr USING (r)
"""
