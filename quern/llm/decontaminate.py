"""Benchmark decontamination by winnowing.

A window is `WINDOW` consecutive words. Of the k-gram hashes in each window the least is
kept as the window's fingerprint, on both sides; as it depends on the window alone, every
span shared by a document and an item, of at least one window, shares a fingerprint. A
document's fingerprints are looked up among the benchmark's, and a hit is extended to
the windows around it, which are compared whole. An item shorter than a window is looked
up as it is.

The benchmark is handled in blocks of at most `BLOCK_BYTES` of text (an item above that is
a block alone), each of which is broadcast as sorted hashes; a larger benchmark takes more
passes over the documents, whose results are stored and merged per document. One block is
held at a time: its broadcast ends before the next one is read.

Cases: null and word-free texts have no words and no hits; items without an id or words
match nothing; copies of an item count by their ids; repeated documents come out once
each; an empty benchmark hits nothing. Other columns are ignored, or kept by
`clean_documents`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textcore as T
from quern.llm.lineage import free_names, refuse_clash, stored

WINDOW = 8
GRAM = 4
#: Text of benchmark items that one pass holds, so the size of what is broadcast.
BLOCK_BYTES = 32 << 20


class Index:
    """Windows and fingerprints of a block of items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(self.ids)}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints: list[np.ndarray] = []
        column = pa.array([t for _, t in items], pa.string())
        data, off = T.text_buffers(column)
        for lo, hi in T.slices(off):
            words = T.Words(data, off[lo : hi + 1], T.NON_WORD)
            for row, a, b in zip(range(lo, hi), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                size = min(b - a, WINDOW)
                if size:
                    g = T.grams(words.hash[a:b], size)
                    found.setdefault(size, []).append((g, np.full(len(g), number[items[row][0]])))
                    if size == WINDOW:
                        prints.append(_least(T.grams(words.hash[a:b], GRAM)))
        self.windows = {}
        for size, parts in found.items():
            g, who = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.argsort(g, kind="stable")
            self.windows[size] = (g[order], who[order])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        bits = max(16, min(26, int(len(self.prints) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.prints >> self.shift] = True

    def printed(self, g: np.ndarray) -> np.ndarray:
        """Which hashes are fingerprints of items."""
        maybe = self.filter[g >> self.shift]
        at = np.flatnonzero(maybe)
        if len(at):
            maybe[at] = _isin(g[at], self.prints)
        return maybe


def _least(g: np.ndarray) -> np.ndarray:
    """The fingerprint of the window that begins at each place."""
    n = len(g) - (WINDOW - GRAM)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(out, g[j : j + n], out=out)
    return out


def _isin(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _hits(words: T.Words, index: Index) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which words are inside an occurrence of a window, and (text, item number) pairs."""
    n = len(words.hash)
    edge = np.zeros(n + 1, np.int64)
    pairs: list[np.ndarray] = []
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    for size, (values, who) in index.windows.items():
        if n < size:
            continue
        if size == WINDOW:
            least = _least(T.grams(words.hash, GRAM))
            new = np.ones(len(least), bool)
            new[1:] = least[1:] != least[:-1]
            kept = np.flatnonzero(new)
            hit = np.repeat(index.printed(least[kept]), np.diff(np.append(kept, len(least))))
            at = np.flatnonzero(hit)
        else:
            at = np.arange(n - size + 1)
        at = at[doc[at] == doc[at + size - 1]]
        if not len(at):
            continue
        lo = int(at[0])
        g = T.grams(words.hash[lo : int(at[-1]) + size], size)[at - lo]
        same = _isin(g, values)
        at, g = at[same], g[same]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        first, last = np.searchsorted(values, g, "left"), np.searchsorted(values, g, "right")
        count = last - first
        which = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        pairs.append(np.unique(np.stack([np.repeat(doc[at], count), who[which]], axis=1), axis=0))
    both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return np.cumsum(edge[:-1]) > 0, [(int(a), int(b)) for a, b in both]


_SCHEMA = "n_words long, n_hit long, hits array<struct<first:long,last:long>>, items array<string>"


def _pass(docs: DataFrame, keep: list[str], text: str, shared: Broadcast, clean_only: bool = False) -> DataFrame:
    """The columns `keep` with n_words, n_hit, hit word ranges [first, last) and items; or of the rows without a hit those columns alone."""
    (whole,) = free_names(keep, "text")
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(whole))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            data, off = T.text_buffers(batch.column(len(keep)))
            for lo, hi in T.slices(off):
                words = T.Words(data, off[lo : hi + 1], T.NON_WORD)
                mark, pairs = _hits(words, index)
                sums = np.concatenate([[0], np.cumsum(mark)])
                n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
                part = batch.slice(lo, hi - lo)
                cols = [part.column(i) for i in range(len(keep))]
                if clean_only:
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(n_hit == 0)) for c in cols], names=keep)
                    continue
                spans: list[list[dict]] = [[] for _ in n_hit]
                items: list[list[str]] = [[] for _ in n_hit]
                for d, i in pairs:
                    items[d].append(index.ids[i])
                for d in np.flatnonzero(n_hit).tolist():
                    m = mark[words.first[d] : words.first[d + 1]].astype(np.int8)
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], m, [0]])))
                    spans[d] = [{"first": a, "last": b} for a, b in turn.reshape(-1, 2).tolist()]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(words.first)), pa.array(n_hit), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=[*keep, "n_words", "n_hit", "hits", "items"])

    return src.mapInArrow(run, schema if clean_only else f"{schema}, {_SCHEMA}")


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[DataFrame]:
    """(i, t) of the items, by block; at least one. Hash buckets of the items are put together up to the bound."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    size = F.sum(F.octet_length("t") + 16)
    total = rows.agg(size).first()[0] or 0
    if total <= block_bytes:
        yield rows
        return
    buckets = 32 * -(-total // block_bytes)
    bucket = F.pmod(F.xxhash64("i", "t"), F.lit(buckets))
    lo, held = 0, 0
    for r in rows.groupBy(bucket.alias("b")).agg(size.alias("s")).orderBy("b").collect():
        if held and held + r["s"] > block_bytes:
            yield rows.filter((bucket >= lo) & (bucket < r["b"]))
            lo, held = r["b"], 0
        held += r["s"]
    yield rows.filter(bucket >= lo)


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, hits, items): hit word ranges and the sorted ids of the items with windows in the document."""
    refuse_clash(doc_id, ["n_words", "n_hit", "hits", "items"])
    share = docs.sparkSession.sparkContext.broadcast
    blocks = list(item_blocks(benchmark, item_id, item_text, block_bytes))
    if len(blocks) == 1:
        return _pass(docs, [doc_id], text, share(Index([tuple(r) for r in blocks[0].collect()])))
    # Rows are numbered once, in storage, so that all passes mean the same row by a number.
    numbered = stored(docs.select(F.struct(F.col(f"`{doc_id}`").alias("id"), F.monotonically_increasing_id().alias("n")).alias("row"), F.col(f"`{text}`").alias("t")))
    every = None
    for items in blocks:
        shared = share(Index([tuple(r) for r in items.collect()]))
        part = _pass(numbered, ["row"], "t", shared)
        part = stored(part if every is None else part.filter("n_hit > 0"))
        shared.destroy()
        every = part if every is None else every.union(part)
    ranges = F.array_sort(F.flatten(F.collect_list("hits")))
    one = every.groupBy("row").agg(F.max("n_words").alias("n_words"), ranges.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr("""aggregate(hits, cast(array() as array<struct<first:bigint,last:bigint>>), (m, x) -> CASE
        WHEN size(m) = 0 OR x.first > element_at(m, -1).last THEN concat(m, array(x))
        ELSE concat(slice(m, 1, size(m) - 1), array(named_struct('first', element_at(m, -1).first, 'last', greatest(element_at(m, -1).last, x.last)))) END)""")
    one = one.withColumn("hits", merged)
    return one.select(F.col("row.id").alias(doc_id), "n_words", F.expr("aggregate(hits, 0L, (s, x) -> s + x.last - x.first)").alias("n_hit"), "hits", "items")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all their columns, that no window of the benchmark occurs in."""
    blocks = list(item_blocks(benchmark, block_bytes=block_bytes))
    last = None
    for n, items in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()]))
        docs = _pass(docs, docs.columns, text, shared, clean_only=True)
        if n + 1 < len(blocks):
            docs = last = stored(docs, instead_of=last)
            shared.destroy()
    return docs


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 8) AS k, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, least(len(w), 1)) + 1)) AS i FROM b)
), k AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, k)
), h AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g
), n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
