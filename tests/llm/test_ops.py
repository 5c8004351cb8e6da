"""Corpus operators against plain versions, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import decontaminate, jaccard, language, mixing, ppm, quality, secrets, simhash, token_counts, warc
from blockloom.llm.common import LOWER, REMOVE_SHUFFLES, stored, workdir
from blockloom.llm.graph import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep string, size string, draws int"
RND = random.Random(5)
VOCAB = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(1, 7))) for _ in range(300)] + ["éà", "日本", "Ünï"]


def prose(n):
    return " ".join(RND.choice(VOCAB) for _ in range(n))


@functools.cache
def corpus():
    base = prose(200)
    words = base.split()
    texts = [None, "", " \t\n", "one", "two words", "A b C", base, base, base.upper(), prose(4000)]
    for k in (1, 3, 5, 9, 20):
        w = words[:]
        for i in range(k):
            w[i * 9] = f"new{i}"
        texts.append(" ".join(w))
    texts += [prose(RND.randint(1, 60)) for _ in range(40)]
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c", ""][i % 5], None if t is None else len(t), "x", "y", 1) for i, t in enumerate(texts)]
    return [*rows, (None, "no id", "en", "a", 5, "x", "y", 1), (6, base, "en", "b", len(base), "x", "y", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return [w.decode() for w in (text or "").encode().translate(LOWER).split()]


# ---- WARC
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, large int")


@pytest.mark.parametrize("compress, block", [(True, 700), (False, 4096), (True, 1 << 20)])
def test_warc_round_trip(spark, compress, block):
    evil = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i if i != 9 else None, None if i % 7 == 0 else f"http://x/{i}\nq", (evil * (i % 5 + 1) + "é") * (i % 11) if i % 13 else None, "d", 1) for i in range(120)] + [(118, "u", "z" * 2000, "d", 1), (118, "u", "z" * 2000, "d", 1), (3, "u", "z" * 2000, "d", 1)]
    files = warc.write(warc.with_references(pages(spark, rows)), workdir(spark, "w"), compress, file_bytes=30000)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(files, block).collect())
    data = [(r[0], (r[2] or "").encode()) for r in rows]
    want = Counter()
    for page, payload in data:
        same = [p for p, x in data if x == payload and p is not None]
        first = max(same) if len(payload) >= 1000 and same and sum(x == payload for _, x in data) > 1 else None
        revisit = first is not None and first != page
        want[page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert got == want and any(k[3] == "revisit" for k in got)


def test_warc_empty_and_damaged(spark, tmp_path):
    assert warc.read(warc.write(warc.with_references(pages(spark, [])), workdir(spark, "w"))).count() == 0
    path = tmp_path / "x.warc"
    path.write_bytes(warc.record(1, None, b"abc", hashlib.sha1(b"abc").hexdigest(), None, False) + b"garbage")
    files = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, size bigint")
    with pytest.raises(Exception, match="chain breaks"):
        warc.read(files).collect()


# ---- mixing
def target_of(sizes, weights=(5, 2, 1)):
    """Water filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        unit = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            out[s] += unit * w[s]
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_.discard(s)
    return out


@pytest.mark.parametrize("block_words, shards", [(1 << 18, 64), (50, 5), (7, 1)])
def test_mix(docs, block_words, shards):
    sized = mixing.sized(docs.drop("size"))
    got = mixing.plan(sized, block_words=block_words, shards=shards).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(r.size == size(r.text) for r in got) and len(got) == len(corpus())
    by: dict = Counter()
    for r in got:
        by[r.source] += r.size
    want, taken = target_of(by), Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == by[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken == sum(d.words for d in r.draws) and all(0 <= d.shard < shards for d in r.draws)
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in by)
    again = mixing.plan(sized, block_words=block_words, shards=shards).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mix_empty_and_whole(docs, none):
    assert mixing.plan(mixing.sized(none.drop("size"))).count() == 0
    texts, by, taken = {r[1] for r in corpus()}, Counter(), Counter()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in mixing.mixture(docs.drop("size", "draws")).collect():
        assert r.text in texts and count(r.text) == r.words and r.n_chars == len(r.text)
        taken[r.source] += r.words
    for r in corpus():
        by[r[3]] += count(r[1])
    largest = max(count(r[1]) for r in corpus())
    assert all(abs(taken[s] - t) <= largest / 2 + 1 for s, t in target_of(by).items())


def test_hypergeometric(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    got = Counter(r[0] for r in u.selectExpr(mixing.hypergeometric("u", "30", "12", "10")).collect())
    for k in range(11):
        p = math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10)
        assert abs(got[k] / 4000 - p) < 0.002


def test_split_is_exact(spark):
    q = spark.createDataFrame([([40, 0, 3, 100],)], "q array<bigint>")
    for shards in (1, 2, 7, 16):
        leaves = [r.q for r in mixing.split(q, shards, 1).collect()]
        assert len(leaves) == shards and np.array(leaves).sum(axis=0).tolist() == [40, 0, 3, 100] and np.array(leaves).min() >= 0
        assert max(map(sum, leaves)) - min(map(sum, leaves)) <= max(2, math.ceil(math.log2(shards)) + 1)


# ---- PPM
def test_ppm_base_and_model(docs):
    rows = corpus()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4), r.held_out) for r in ppm.score(docs, head_words=20).collect()), key=str)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c: Counter = Counter()
    for r in rows:
        if not held(r[0]):
            c.update([*words(r[1]), None])
    n, v = sum(c.values()), len(c)
    codes = np.concatenate([ppm.symbols([(r[1] or "").encode()])[0] for r in rows if not held(r[0])])
    trie = ppm.Trie(*np.unique(codes, return_counts=True), ppm.ORDER)
    want = []
    for r in rows:
        t = [*words(r[1]), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want.append((r[0], len(t), sum(c[w] > 0 for w in t), n, round(base, 6), round(float(trie.score(ppm.symbols([(r[1] or "").encode()])[0]).sum()), 4), held(r[0])))
    same = lambda a, b: a[:4] == b[:4] and a[6] == b[6] and abs(a[4] - b[4]) < 1e-5 and abs(a[5] - b[5]) < 1e-2
    assert len(got) == len(want) and all(same(a, b) for a, b in zip(got, sorted(want, key=str)))


def brute_ppm(counts, order, context, symbol):
    excluded, p = set(), 1.0
    for k in range(order, -1, -1):
        own = {s: n for (c, s), n in counts[k].items() if c == context[len(context) - k :]}
        left = {s: n for s, n in own.items() if s not in excluded}
        if left:
            if symbol in left:
                return p * (left[symbol] - 0.5) / sum(left.values())
            p *= len(left) / 2 / sum(left.values())
            excluded |= set(left)
    return p / max(1, 257 - len(excluded))


def test_trie_is_exact_and_sums_to_one():
    texts, order = [b"abracadabra", b"abrupt cadence", b""], 3
    trie = ppm.Trie(*np.unique(ppm.symbols(texts, order)[0], return_counts=True), order)
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        seq = [256] * order + [*t] + [256]
        for i in range(order, len(seq)):
            for k in range(order + 1):
                counts[k][tuple(seq[i - k : i]), seq[i]] += 1
    for context in ((97, 98, 114), (256, 256, 256), (120, 97, 98), (1, 2, 3)):
        code = 0
        for s in context:
            code = code << 9 | s
        got = 10 ** trie.score((np.int64(code) << 9) + np.arange(257))
        assert abs(got.sum() - 1) < 1e-5
        assert np.allclose(got, [brute_ppm(counts, order, context, s) for s in range(257)], rtol=1e-4)
    assert ppm.adaptive_score(b"ab" * 50) / 50 > ppm.adaptive_score(b"ab")


def test_ppm_empty_and_small_trie(none, docs):
    assert ppm.score(none).count() == 0
    assert ppm.score(none, max_nodes=0).count() == 0


@pytest.mark.parametrize("max_nodes,head_grams,low", [(100, 50, 1), (100, 0, 1), (1500, 300, 2)])
def test_ppm_joined_grams_score_alike(docs, max_nodes, head_grams, low):
    train = ppm.counts(docs.where("doc_id is not null")).where(f"kind = {ppm.GRAM}").select("key", "n")
    assert ppm.train_trie(train, ppm.ORDER, max_nodes).order in (low, low + 1)
    by_row = lambda df: sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.score) for r in df.collect()), key=str)
    whole, joined = by_row(ppm.score(docs)), by_row(ppm.score(docs, max_nodes=max_nodes, head_grams=head_grams))
    assert [r[:3] for r in whole] == [r[:3] for r in joined]
    assert np.allclose([r[3] for r in whole], [r[3] for r in joined], rtol=1e-5)


# ---- decontamination
def test_decontaminate(spark, docs):
    long = [r for r in corpus() if r[1] and len(words(r[1])) > 150][0][1].split()
    items = [(1, " ".join(long[10:25]).upper()), (2, "!!".join(long[40:49])), (3, "one"), (10, "two words"), (4, None), (5, "--"), (None, " ".join(long[60:70])), (7, prose(30)), (1, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert len(got) == len(corpus())
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    want = []
    for r in corpus():
        w = [x.decode() for x in decontaminate.words_of((r[1] or "").encode())]
        hit, found = set(), set()
        for i, t in items:
            b = [x.decode() for x in decontaminate.words_of((t or "").encode())]
            n = min(8, len(b))
            grams = {tuple(b[a : a + n]) for a in range(len(b) - n + 1)} if n else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
                    found.add("" if i is None else str(i))
        want.append((r[0], len(w), len(hit), sorted(found), len(found) >= 2))
    assert sorted(map(key, (tuple(r) for r in got))) == sorted(map(key, want))
    blocks = decontaminate.search(decontaminate.segments(docs, 8, segment_bytes=500), bench, block_bytes=50).collect()
    assert sorted(map(key, (tuple(r) for r in blocks))) == sorted(map(key, (w[:4] for w in want)))


def near_by_brute_force(rows, items, window, within):
    out = []
    for doc_id, text, *_ in rows:
        w, found = [x.decode() for x in decontaminate.words_of((text or "").encode())], set()
        spans = [set(w[a : a + within]) for a in range(len(w))]
        for i, t in items:
            b = [x.decode() for x in decontaminate.words_of((t or "").encode())]
            for a in range(max(1, len(b) - window + 1) if b else 0):
                if any(set(b[a : a + window]) <= s for s in spans):
                    found.add("" if i is None else str(i))
        out.append((str(doc_id), sorted(found)))
    return sorted(out)


def test_proximity_search(spark):
    rows = [(1, "a x b y c"), (2, "c b a"), (3, "a b"), (4, "b b a a z z z c"), (5, None), (6, "c"), (None, "C, b; a!"), (7, "q a"), (8, "b c q"), (9, prose(200)), (10, " ".join("abcd"[i % 4] for i in range(40)))]
    rows += [(20 + i, " ".join(RND.choice("abcdefgh") for _ in range(30))) for i in range(8)]
    items = [(1, "a b c"), (2, "c c"), (3, "q"), (None, "a d"), (4, ""), (5, None), (6, " ".join("abcdefgh")), (7, "h g a f")]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for window, within, size in ((3, 3, 4 << 20), (3, 5, 4 << 20), (8, 12, 4 << 20), (2, 4, 20), (8, 30, 200)):
        got = decontaminate.search(decontaminate.segments(df, window, segment_bytes=size), bench, window, within=within)
        assert sorted((str(r.doc_id), r.near) for r in got.collect()) == near_by_brute_force(rows, items, window, within)


def test_rows_are_judged_by_their_own_text(spark):
    """Different texts under one id, and rows without one."""
    leak = "one two three four five six seven eight nine"
    rows = [(1, leak, 1), (1, "clean " + prose(30), 2), (None, leak + " ten", 3), (None, "also clean " + prose(20), 4), (2, None, 5), (1, "clean again", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k int").withColumn("t", F.lit(0))
    kept = decontaminate.keep_unseen(df, spark.createDataFrame([(1, leak)], "item_id bigint, text string"))
    assert sorted(r.k for r in kept.collect()) == [2, 4, 5, 6] and kept.columns == df.columns
    copies = [(1, "a b c d e f", 1), (1, "g h i j k l", 2), (1, "a b c d e f", 3), (None, "A b c d e f", 4), (None, "m n o p", 5), (3, "g h i j k l", 6), (0, "x", 7), (None, None, 8), (9, "", 9)]
    out = jaccard.keep_one(spark.createDataFrame(copies, "doc_id bigint, text string, k int")).collect()
    assert sorted(r.k for r in out if r.k not in (1, 3)) == [2, 5, 7, 8, 9] and sum(r.k in (1, 3) for r in out) == 1
    good = [(i, prose(60), "en", 0) for i in range(60)] + [(55, "".join(RND.choice("#$%@~ZQX ") for _ in range(300)), "en", 1), (None, "#$@!~" * 80, "en", 2), (None, prose(60), "en", 3)]
    docs = spark.createDataFrame(good, "doc_id bigint, text string, lang string, k int")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id bigint, quality int")
    kept = Counter(r.k for r in quality.keep_good(docs, labels).collect())
    assert kept[0] >= 58 and kept[1] == kept[2] == 0 and kept[3] == 1


def test_decontaminate_empty(spark, docs, none):
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.keep_unseen(docs, bench.limit(0)).count() == len(corpus())


# ---- SimHash
def test_simhash(docs):
    rows = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    got = sorted(simhash.fingerprint(docs, limit=500).collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_chars))
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, rows):
        after = rows[(rows.index((i, text)) + rows.count((i, text))) % len(rows)][1] if rows.count((i, text)) == 1 else None
        assert (r.doc_id, r.n_chars) == (i, len(text)) and r.fingerprint == simhash.fingerprints([text.encode()])[0].tobytes().hex()
        if after is not None:
            edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= r.near_next <= 1


def test_simhash_votes_by_brute_force():
    from blockloom.llm.common import hash_words, mix, shingle_hashes

    text = prose(40) + " " + prose(1) * 3
    terms = shingle_hashes(hash_words(text.encode().translate(LOWER).split()), 5)
    bits = np.unpackbits(np.stack([mix(terms, 31), mix(terms, 32)], axis=1).view(np.uint8).reshape(-1, 16), axis=1).astype(int)
    assert (np.packbits((2 * bits - 1).sum(axis=0) > 0) == simhash.fingerprints([text.encode()])[0]).all()


def test_hamming_search_is_complete(spark):
    base = [RND.getrandbits(128) for _ in range(30)]
    marks = base + [b ^ sum(1 << i for i in RND.sample(range(128), k)) for b in base for k in (1, 2, 3, 4, 6)]
    text = [f"{m:032x}" for m in marks] + [f"{base[0]:032x}", None]
    df = spark.createDataFrame([(t,) for t in text], "fingerprint string")
    got = {(r.query, r.fingerprint, r.distance) for r in simhash.within(df, df.limit(40), 3, 6).collect()}
    hexes = [t for t in text if t]
    want = {(a, b, d) for a in hexes[:40] for b in hexes if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert got == want and len(want) > 40


def test_simhash_query_counts_neighbours(spark, tmp_path):
    base = prose(400)
    rows = [(i, prose(40)) for i in range(30)] + [(40, base), (41, base), (42, base + " more"), (60, base), (61, None), (80, ""), (100, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in simhash.op5(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    marks = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for i, r in got.items():
        near = [d for j, m in marks.items() if j != i and (d := (m ^ marks[i]).bit_count()) <= simhash.RADIUS]
        want = (len({marks[j] for j in marks if 0 < (marks[j] ^ marks[i]).bit_count() <= simhash.RADIUS}), len(near)) if i % simhash.EVERY == 0 else (None, None)
        assert (r.n_near, r.n_alike) == want


def test_simhash_empty_and_alone(spark, none):
    assert simhash.fingerprint(none).count() == 0
    r = simhash.fingerprint(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).collect()
    assert len(r) == 1 and r[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


# ---- token counts
def test_token_counts(spark, docs):
    manifest = token_counts.write(docs.select("doc_id", "text"), workdir(spark, "t"), file_bytes=900)
    files = manifest.groupBy("path").agg(F.max("size").alias("size"))
    encode = token_counts.encoder(token_counts.VOCABULARY)
    want = sorted((str(r[0]), len(encode(r[1] or ""))) for r in corpus())
    for block in (64, 1 << 20):
        got = manifest.drop("size").join(token_counts.scan(files, block_bytes=block), ["path", "ordinal"]).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want and all(r.complete for r in got)


def test_token_scan_by_hand(spark, tmp_path):
    ids = [7, 9, 1, 9, 9, 4, 5, 6, 7, 8, 9, 3]
    (tmp_path / "a.tokens").write_bytes(np.array(ids, "<u2").tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/a.tokens", 2 * len(ids))], "path string, size bigint")
    for block in (2, 6, 100):
        got = [(r.ordinal, r.first, r.n_tokens, r.complete) for r in token_counts.scan(files, end=9, block_bytes=block).orderBy("ordinal").collect()]
        assert got == [(0, 0, 1, True), (1, 2, 1, True), (2, 4, 0, True), (3, 5, 5, True), (4, 11, 1, False)]
    assert token_counts.scan(files.limit(0)).count() == 0


# ---- secrets
def test_secret_base_spans():
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    parts = ["password: token = abcdefgh", "API_KEY='xyz123'", "api-key=zzzzzzz", "secret=ab", "ſecret=abcdefg", "AKIA" + "A" * 16, "AKIA" * 6, "AKIAAKIA" + "B" * 13, "0" * 24, "deadbeef" * 2, "é" + "ab12" * 6 + "g", "token\":\"a.b_c-d=\"", "x", "\n"]
    for _ in range(300):
        text = "".join(RND.choice(parts) + RND.choice(["", " ", "é"]) for _ in range(6))
        want = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secrets.base_spans(text) == sorted(want, key=lambda s: (s[0], secrets.ORDER[s[2]]))


def test_secret_linking():
    key, access = "aB3/" * 10, "AKIA" + "X" * 16
    near, far = f"{access} {key}", f"{access} {'lorem ' * 60}{key}"
    found = lambda t: [s[2] for s in secrets.all_spans(t, secrets.base_spans(t), 200)]
    assert found(near) == ["access", "key"] and found(far) == ["access"] and found(key) == []
    assert found(f"https://db.example/x {key}") == ["key"]
    token = "Ab1" * 8
    assert found(f"{access} {token}") == ["access", "token"] and found(f"https://db.example/x {token}") == found(token) == [] and found(f"{access} {'xy1' * 8}") == ["access"]
    weak = [(RND.randrange(900), 0) for _ in range(60)]
    weak, others = [(a, a + RND.randrange(1, 30)) for a, _ in weak], [(a := RND.randrange(900), a + RND.randrange(1, 30)) for _ in range(9)]
    for scope in (0, 5, 40):
        assert secrets.linked(weak, others, scope) == [any(o[0] <= b + scope and o[1] >= a - scope for o in others) for a, b in weak]


def test_secret_scan_and_redact(spark, none):
    rows = [(1, "é password=hunter22 x", "en", "a", 21), (2, None, "en", "a", None), (None, "", "de", "b", 0), (4, "clean", "de", None, 5), (4, "clean", "de", None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = secrets.scan(df).collect()
    assert len(got) == 5 and [(r.n_assign, r.spans) for r in got if r.doc_id == 1] == [(1, "assign:2:19")]
    back = secrets.redact(df).collect()
    assert [(r.text, r.n_chars) for r in back] == [("é [SECRET] x", 12), (None, None), ("", 0), ("clean", 5), ("clean", 5)]
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0


# ---- Jaccard join
def brute_components(rows):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    return [(r[0], len(s), min((x for x in ids[find(i)] if x is not None), default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def chains():
    """Small sets, steps across size bands, and chains whose ends don't link."""
    rows, i = [], 1000
    for n in (3, 10, 11, 12, 21, 33, 60, 150, 400):
        w = [f"w{n}_{k}" for k in range(n)]
        for step in range(6):
            rows.append((i, " ".join(w)))
            i += 1
            w = [*w[:-1], f"s{i}"] if step % 2 else [*w, *[f"x{i}_{k}" for k in range(max(1, n // 30))]]
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard(spark, block):
    rows = [(r[0], r[1]) for r in corpus()] + chains()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("t", F.lit(1))
    out = jaccard.join(df, block_sets=block).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    want = sorted(brute_components(rows), key=str)
    assert got == want and len({w[2] for w in want}) < len(want) - 20
    assert sorted(map(str, ((r.doc_id, r.class_id, r.n_links) for r in out))) == sorted(map(str, brute_links(rows)))


def brute_links(rows):
    """doc_id, the smallest id with an equal set, and how many other rows link."""
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    out = []
    for i, (r, a) in enumerate(zip(rows, sets)):
        equal = [q[0] for q, b in zip(rows, sets) if a and a == b and q[0] is not None]
        out.append((r[0], min(equal, default=None) if a else r[0], sum(j != i and bool(a) and 100 * len(a & b) >= 90 * len(a | b) for j, b in enumerate(sets))))
    return out


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for size in [*range(2, 60), 100, 333, 1000]:
        for _ in range(4):
            a = rng.integers(0, 1 << 62, size, dtype=np.uint64)
            cut = int(rng.integers(0, max(1, size // 9) + 1))
            b = np.r_[a[cut:], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, size // 20) + 1)), dtype=np.uint64)]
            shared, union = len(set(a) & set(b)), len(set(a) | set(b))
            if 100 * shared >= 90 * union and set(a) != set(b):
                sigs, n = jaccard.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]))
                assert set(sigs[: n[0]].tolist()) & set(sigs[n[0] :].tolist())


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for size in (1, 5, 60, 127, 129, 500, 3000):
        sets = [rng.integers(0, 1 << 62, size, dtype=np.uint64) for _ in range(3)]
        for base in list(sets):
            for d in (0, 1, size // 30, size // 12):
                sets.append(np.r_[base[d:], rng.integers(0, 1 << 62, d, dtype=np.uint64)])
        n = np.array([len(s) for s in sets])
        marks = jaccard.sketches(np.concatenate(sets), n).to_pylist()
        got = {(int(a), int(b)) for x, y in jaccard.near_pairs(np.zeros(len(n), np.int64), n, marks, 80, 100, step=7) for a, b in zip(x, y)}
        want = {(i, j) for j in range(len(n)) for i in range(j) if 100 * (k := len(set(sets[i]) & set(sets[j]))) >= 80 * (n[i] + n[j] - k)}
        assert want <= got and (size < 60 or len(got) < len(n) * (len(n) - 1) / 2)


def test_sketches_rule_out_sets_of_other_texts():
    rng = np.random.default_rng(6)
    for size in (130, 200, 250, 320, 9000):
        shared = rng.integers(0, 1 << 62, size // 2, dtype=np.uint64)
        sets = [np.r_[shared, rng.integers(0, 1 << 62, size - len(shared), dtype=np.uint64)] for _ in range(40)]
        n = np.array([len(s) for s in sets])
        marks = jaccard.sketches(np.concatenate(sets), n).to_pylist()
        assert not sum(len(a) for a, _ in jaccard.near_pairs(np.zeros(len(n), np.int64), n, marks, 80, 100)), size


def test_groups_go_on_in_later_batches():
    """Groups cut by batches, larger than the limit, and single."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted({(int(k), int(r)) for k, r in zip(rng.integers(0, 40, 400) ** 2 % 37, rng.integers(0, 60, 400))})
    rows += rows[:50]
    rows.sort()
    want: dict = {}
    for k, r in rows:
        want.setdefault(k, set()).add(r)
    for cut in (1, 3, 50, 1000):
        for most in (2, 8, 100):
            batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[a : a + cut]], pa.int64()) for i in (0, 1)] + [pa.nulls(len(rows[a : a + cut]), jaccard.DOC_TYPE)], names=["key", "rep", "doc"]) for a in range(0, len(rows), cut)]
            got: dict = {}
            for b in jaccard._groups(iter(batches), most):
                for g, big, r in zip(*(b.column(c).to_pylist() for c in ("g", "big", "rep"))):
                    got.setdefault((big, g), []).append(r)
            big = {g: sorted(v) for (large, g), v in got.items() if large}
            assert big == {k: sorted(v) for k, v in want.items() if len(v) > most}
            small = {tuple(sorted(set(v))) for (large, _), v in got.items() if not large}
            assert small == {tuple(sorted(v)) for v in want.values() if 1 < len(v) <= most}


def test_jaccard_keeps_one(docs, none):
    rows = corpus()
    kept = jaccard.keep_one(docs).collect()
    want = {w[0] for w in brute_components(rows) if w[0] is not None and w[0] == w[2]}
    assert Counter(r.doc_id for r in kept) == Counter([*want, None])
    assert jaccard.join(none).count() == 0 and jaccard.keep_one(none).count() == 0


def kept_by_brute_force(rows, width=5, num=80, den=100):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    least = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if least[i] != least[j] and a and b and den * len(a & b) >= num * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    ids = {}
    for (i, _), g in zip(rows, least):
        ids[g] = min(ids.get(g, i), i)
    return {i for (i, _), g in zip(rows, least) if ids[g] == i}


def test_stage_removes_near_copies_of_five_words(spark):
    import corpus_pipeline

    base = [f"v{i}" for i in range(200)]
    edits = [f"edit{i // 50}" if i % 50 == 25 else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(edits)), (3, " ".join(base[:165])), (4, " ".join([*base, *[f"new{i}" for i in range(40)]])), (5, " ".join([*base[:120], *[f"other{i}" for i in range(80)]]))]
    for n in (4, 5, 6, 8, 9, 12, 20, 33, 60, 150):
        for cut in (0, 1, 2, n // 10, n // 6, n // 4):
            rows.append((1000 + len(rows), " ".join([*[f"z{n}_{i}" for i in range(n)][cut:], f"e{cut}"])))
    rows += [(5000 + i, prose(RND.randint(1, 60))) for i in range(30)]
    want = kept_by_brute_force(rows)
    assert {2, 3, 4} & want == set() and 5 in want and len(want) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == sorted(want)
    joined = jaccard.join(df, block_sets=3, width=5, num=80, den=100).where("doc_id = component_id")
    assert sorted(r.doc_id for r in joined.collect()) == sorted(want)


def test_linked_sets_share_a_signature_with_spare_parts():
    rng = np.random.default_rng(3)
    for size in [*range(2, 60), 100, 333, 1000]:
        for _ in range(12):
            a = rng.integers(0, 1 << 62, size, dtype=np.uint64)
            b = np.r_[a[int(rng.integers(0, max(1, size // 6) + 1)) :], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, size // 9) + 1)), dtype=np.uint64)]
            if 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b)) and set(a) != set(b):
                sigs, n = jaccard.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]), 80, 100, 0.2)
                assert set(sigs[: n[0]].tolist()) & set(sigs[n[0] :].tolist())


def test_rounds_deal_each_pair_of_blocks_once_with_few_copies(spark):
    nb = F.when(F.col("rep") < 300, 1).when(F.col("rep") < 350, 2).when(F.col("rep") < 500, 5).otherwise(20)
    rows = spark.range(1000).select(F.col("id").alias("rep"), nb.alias("nb"), F.lit(1).alias("n")).withColumn("g", F.col("nb"))
    ranges = jaccard.rounds(rows, "n")
    dealt = [jaccard.in_blocks(rows, a, b).collect() for a, b in ranges]
    assert len(ranges) > 3 and all(len(d) <= 2000 for d in dealt)
    pairs = [{(r.g, r.i, r.j) for r in d} for d in dealt]
    assert sum(map(len, pairs)) == len(set.union(*pairs)) == 1 + 1 + 10 + 190
    copies = Counter(r.rep for d in dealt for r in d)
    assert all(copies[r.rep] == max(1, r.nb - 1) for r in rows.collect()) and all(r.k in (r.i, r.j) for d in dealt for r in d)
    assert jaccard.rounds(rows.limit(0), "n") == [(0, 0)]


def test_stored_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" ")))
    before, setting = shuffles(), spark.conf.get(REMOVE_SHUFFLES)
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    counts = rows.groupBy("k").count()
    both = stored(rows.repartition(5, "id").join(counts.hint("merge"), "k"), "joined")
    assert both.count() == 1000 and spark.conf.get(REMOVE_SHUFFLES) == setting
    made = [f for f in shuffles() - before if disk.getFile(f).length() > 1000]
    for _ in range(50):
        if not (left := [f for f in made if disk.getFile(f).exists()]):
            break
        time.sleep(0.1)
    assert not left


def test_components(spark):
    edges = [(RND.randrange(300), RND.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root) if find(x) != x}


# ---- quality
def test_kneser_ney_by_hand(spark):
    texts, order = [b"abab", b"abc", b"b"], 2
    df = spark.createDataFrame([(t.decode(),) for t in texts], "text string")
    model = quality.Model(quality.kneser_ney(quality.gram_counts(df, order), order))
    counts: list = [Counter() for _ in range(order + 1)]
    for t in texts:
        seq = [256] * order + [*t] + [256]
        for i in range(order, len(seq)):
            counts[order][tuple(seq[i - order : i + 1])] += 1
    for k in range(order - 1, -1, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k, c):
        n = [sum(v == i for v in counts[k].values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        i = min(c, 3)
        return min(i - 0.1, max(0.1, i - (i + 1) * y * n[i] / n[i - 1])) if n[i] and n[i - 1] else 0.5

    def p(k, gram):
        if k < 0:
            return 1 / 257
        own = {g[-1]: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        below = p(k - 1, gram[1:])
        if not own:
            return below
        c, total = own.get(gram[-1], 0), sum(own.values())
        return (max(0, c - discount(k, c)) if c else 0) / total + sum(discount(k, v) for v in own.values()) / total * below

    for context in ((97, 98), (256, 256), (99, 99), (256, 97)):
        code = np.int64(context[0] << 18 | context[1] << 9)
        got = 2 ** -model.cost(code + np.arange(257))
        assert abs(got.sum() - 1) < 1e-6 and np.allclose(got, [p(order, (*context, s)) for s in range(257)], rtol=1e-5)


def test_quality(spark, docs, none):
    rows = [(i, prose(60), "en") for i in range(200)] + [(500 + i, "".join(RND.choice("#$%@~ZQX ") for _ in range(300)), "en") for i in range(20)] + [(900, None, "en"), (901, "", None), (None, prose(50), "xx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("trusted", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(505, 0, 0), (150, 1, 0), (150, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(df, labels).collect()}
    assert sum(got[i] for i in range(200)) >= 198 and not any(got[500 + i] for i in range(20)) and not got[900] and not got[901] and len(got) == 223
    assert quality.keep_good(df, labels).where("doc_id is null").count() == 1
    assert quality.classify(none, labels).count() == 0 and quality.classify(docs, labels.limit(0)).where("keep").count() > 40


def test_quality_learns_from_all_trusted_texts(spark, monkeypatch):
    rows = [(i, prose(30 + i % 9), ["en", "de", None][i % 3]) for i in range(90)] + [(200, "", "en"), (201, None, "de"), (None, "other", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(70)] + [(200, 1, 0)], "doc_id bigint, quality int, toxic int")
    learned, real = [], quality.kneser_ney
    monkeypatch.setattr(quality, "kneser_ney", lambda grams, order: learned.append(grams.agg(F.sum("c")).first()[0]) or real(grams, order))
    whole = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert learned[0] == sum(len(t.encode()) + 1 for i, t, _ in rows if i in {*range(70), 200}) == sum(learned[1:]) and min(learned) > 0
    dealt = {r.doc_id: r for r in quality.classify(df, labels, max_grams=300).collect()}
    assert len(whole) == len(dealt) == len(rows)
    for i, r in whole.items():
        assert r.keep == dealt[i].keep and r.n_bytes == dealt[i].n_bytes
        assert (r.perplexity is None) == (dealt[i].perplexity is None) == (i in (200, 201))
        for c in ("perplexity", "least", "most"):
            assert r[c] is None or abs(r[c] - dealt[i][c]) < 1e-9 * r[c]


# ---- language
def test_language(spark, none):
    letters = {"aa": "abcde", "bb": "fghij", "cc": "éüñkl"}
    text = lambda l, n: " ".join("".join(RND.choice(letters[l]) for _ in range(4)) for _ in range(n))
    rows = [(i, text(l := "aa bb cc".split()[i % 3], RND.randint(3, 40)), l) for i in range(240)] + [(300, None, "aa"), (301, "12 !", "aa"), (302, "", None), (None, text("bb", 9), None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows[:240]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and got[300].score == 0 and got[None].lang_pred == "bb"
    assert all(r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) for i, r in got.items())
    assert language.identify(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert language.identify(unlabelled).first().lang_pred == "und"
