"""Secret scans by multipart credential linking.

Parts of three roles are found in each whole text: access identifiers, secrets and endpoints. Strong parts stand by
themselves. Weak candidates (a bare 40-character key, a mixed token, an account number) are reported only when, inside
one scope, a complementary part stands near (for a token, an identifier: near an endpoint alone it may be any part of an address): an interval join of the parts' spans, widened by the scope, within each
document. The join is a merge of sorted spans, so a text with many parts costs n log n, and no pairs are kept.

Cases: null is an empty text without spans. Texts are scanned whole; a document's row is made from its text only, so
repeated rows and null ids give one row each. Spans are code points with the end exclusive. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_chunks

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # what a longest run of 20 and more gives; a shorter run has no later match
HEX = re.compile(r"[0-9a-f]{24,}")  # of the longest runs, those of 24 and more
#: Weak: only linked ones are reported. Endpoints only link.
KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9_-]{20,128}(?![A-Za-z0-9+/=_.-])")  # with a digit, a small and a capital letter
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|\barn:aws:[a-z0-9:*/._-]+|\b[a-z0-9.-]+\.amazonaws\.com\b", re.A)
ACCOUNT = re.compile(r"(?i:(?:client|account|access)_?(?:id|key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._-]{8,})", re.A)
KINDS = ("assign", "access", "hex", "key", "account", "token")
ORDER = {k: i for i, k in enumerate(KINDS)}
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


def linked(weak: list[tuple[int, int]], others: list[tuple[int, int]], scope: int) -> list[bool]:
    """Interval join: which weak spans lie at most `scope` characters from any of the others."""
    if not weak or not others:
        return [False] * len(weak)
    starts, ends = np.array(sorted(s for s, _ in others)), np.array(sorted(e for _, e in others))
    a, b = np.array(weak).T
    # Those that begin before the widened span's end, less those that end before its begin, meet it.
    return (np.searchsorted(starts, b + scope, side="right") - np.searchsorted(ends, a - scope, side="left") > 0).tolist()


def all_spans(text: str, base: list[tuple[int, int, str]], scope: int) -> list[tuple[int, int, str]]:
    """The base spans, with the weak candidates whose complement is in scope and which no base span covers."""
    keys = [m.span() for m in KEY.finditer(text)]
    accounts = [m.span(1) for m in ACCOUNT.finditer(text)]
    if not keys and not accounts and not any(s[2] == "access" for s in base):
        return base
    access, secrets = [s[:2] for s in base if s[2] == "access"], [s[:2] for s in base if s[2] != "access"]
    named = {*keys, *accounts}
    mixed = lambda t: any(c.isdigit() for c in t) and t.upper() != t != t.lower()
    tokens = [m.span() for m in TOKEN.finditer(text) if m.span() not in named and mixed(m[0])] if access or accounts else []
    places = [m.span() for m in ENDPOINT.finditer(text)]
    near_id, near_place = linked(keys, access + accounts, scope), linked(keys, places, scope)
    more = [(*s, "key") for s, i, p in zip(keys, near_id, near_place) if i or p]
    more += [(*s, "token") for s, i in zip(tokens, linked(tokens, access + accounts, scope)) if i]
    near_secret = linked(accounts, secrets + [s[:2] for s in more], scope)
    near_place = linked(accounts, places, scope)
    more += [(*s, "account") for s, i, p in zip(accounts, near_secret, near_place) if i and p]
    if base and more:  # no second report of what a base span covers
        starts, ends = np.array([s[0] for s in base]), np.maximum.accumulate([s[1] for s in base])
        at = np.searchsorted(starts, [s[0] for s in more], side="right") - 1
        more = [s for s, i in zip(more, at) if i < 0 or ends[i] < s[1]]
    return sorted([*base, *more], key=lambda s: (s[0], ORDER[s[2]], s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, counts of base kinds, base_spans and spans as kind:start:end, comma-joined."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            rows = []
            for text in chunk.column("text").to_pylist():
                base = base_spans(text or "")
                n = [s[2] for s in base]
                rows.append((n.count("assign"), n.count("access"), n.count("hex"), written(base), written(all_spans(text or "", base, scope))))
            cols = [*zip(*rows)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, SCHEMA)


def redact(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by a mark (overlapping spans by one) and n_chars counted anew; texts without spans and all other columns stay."""
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, text_col):
            texts = chunk.column(text_col).to_pylist()
            changed = False
            for i, text in enumerate(texts):
                spans = all_spans(text, base_spans(text), scope) if text else []
                if spans:
                    parts, at = [], 0
                    for a, b, _ in spans:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    texts[i], changed = "".join([*parts, text[at:]]), True
            if changed:
                k = names.index(text_col)
                chunk = chunk.set_column(k, chunk.schema.field(k), pa.array(texts, chunk.schema.field(k).type))
            if size_col in names:
                k = names.index(size_col)
                chunk = chunk.set_column(k, chunk.schema.field(k), pa.array([None if t is None else len(t) for t in texts], chunk.schema.field(k).type))
            yield chunk

    return docs.mapInArrow(clean, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op7 query: secrets of all documents."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
