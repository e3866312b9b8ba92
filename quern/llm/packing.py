"""Conflict-constrained best-fit packing of documents into training sequences.

Documents, longest first, go to the open bin that they fill tightest among those without a
conflict. Bins are kept by residual; a bitmap of the residuals in use gives the least one
that fits, and the search goes on to its successors until a compatible bin is found (the
oldest of those with one residual), or a new one is opened. A bin carries a bitmap of the
sources and duplicate clusters in it: a document conflicts with a bin that holds a document
of its cluster, or one of its source. A source with a large share of the rows counts as
several, in proportion, so that it can fill its share of every bin.

A text longer than a bin is cut: its whole bins are full at once, and the rest is packed.
Documents are dealt by hash over shards of about `SHARD` rows, which are packed apart, so
the work and memory of a task are bounded whatever the sources and clusters; the tightest
bin is the tightest of its shard. Repeated rows are dealt over the shards one by one.

Cases: null and empty texts are one end token; a null source conflicts with none. The
clusters are those of a given column, in which null is no cluster; without one, copies of
a text, with letter case and spacing ignored, are a cluster, and null and empty texts are
in none. Every row, repeated or not, is placed once. Other columns are ignored.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textcore as T
from quern.llm.lineage import refuse_clash, stored
from quern.llm.near_dedup import _runs

#: Tokens in a bin. A document has a token per word and one for its end.
CAPACITY = 4096
#: Rows that are packed together.
SHARD = 4096
#: A source may fill so many times its share of a bin.
SLACK = 2.0


def measure(docs: DataFrame, doc_id: str, text: str, source: str, cluster: str | None = None) -> DataFrame:
    """(id, source, n_tokens, cluster): cluster is the given column, or a hash of the word sequence, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.text_buffers(batch.column(2))
            for lo, hi in T.slices(off):
                w = T.Words(data, off[lo : hi + 1], T.SPACE)
                n = np.diff(w.first)
                place = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first[:-1], n).astype(np.uint64)
                mixed = np.append(T.mix(w.hash + place * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
                copies = T.mix(np.add.reduceat(mixed, w.first[:-1]) + n.astype(np.uint64)).view(np.int64)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n + 1), part.column(3) if cluster else pa.array(copies, mask=n == 0)], names=["id", "source", "n_tokens", "cluster"])

    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"), *([F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster)).alias("cluster")] if cluster else []))
    return src.mapInArrow(run, "id long, source string, n_tokens long, cluster long")


def pack(sizes: list[int], bits: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and place in it of each document, given in the order of packing; bits are the bitmaps of what each conflicts with."""
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0
    held: list[int] = []
    left: list[int] = []
    where, place = [], []
    for size, own in zip(sizes, bits, strict=True):
        fits, bin_no = in_use >> size, -1
        residual = size
        while fits:
            step = (fits & -fits).bit_length() - 1
            residual += step
            bin_no = next((b for b in by_residual[residual] if not held[b] & own), -1)
            if bin_no >= 0:
                break
            fits >>= step + 1
            residual += 1
        if bin_no < 0:
            bin_no, residual = len(held), capacity
            held.append(0)
            left.append(capacity)
        else:
            by_residual[residual].remove(bin_no)
            if not by_residual[residual]:
                in_use &= ~(1 << residual)
        where.append(bin_no)
        place.append(capacity - residual)
        held[bin_no] |= own
        left[bin_no] = residual - size
        if left[bin_no]:
            insort(by_residual[left[bin_no]], bin_no)
            in_use |= 1 << left[bin_no]
    return where, place


def _pack_shards(capacity: int, slots: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            shard = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                d = batch.slice(lo, hi - lo).to_pydict()
                rest = [n % capacity or (capacity if n else 0) for n in d["n_tokens"]]
                order = sorted(range(hi - lo), key=lambda i: (-rest[i], d["cluster"][i] is None, d["cluster"][i] or 0, d["id"][i] is None, d["id"][i] or 0))
                bit: dict[tuple, int] = {}
                turn: dict[str, int] = {}
                copies: dict[int, int] = {}
                for c in d["cluster"]:
                    copies[c] = copies.get(c, 0) + 1
                bits = []
                for i in order:
                    own, s, c = 0, d["source"][i], d["cluster"][i]
                    if s is not None:
                        turn[s] = turn.get(s, -1) + 1
                        own |= 1 << bit.setdefault(("source", s, turn[s] % slots.get(s, 1)), len(bit))
                    if c is not None and copies[c] > 1:
                        own |= 1 << bit.setdefault(("cluster", c), len(bit))
                    bits.append(own)
                where, place = pack([rest[i] for i in order], bits, capacity)
                ids, first, size, bins, at = [], [], [], [], []
                base = int(shard[lo]) << 32
                count = max(where, default=-1) + 1
                for i, b, p in zip(order, where, place, strict=True):
                    whole = (d["n_tokens"][i] - rest[i]) // capacity
                    for k in range(whole):
                        ids.append(d["id"][i])
                        first.append(k * capacity)
                        size.append(capacity)
                        bins.append(base + count)
                        at.append(0)
                        count += 1
                    ids.append(d["id"][i])
                    first.append(whole * capacity)
                    size.append(rest[i])
                    bins.append(base + b)
                    at.append(p)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, first, size, bins, at)], names=["id", "first_token", "n_tokens", "bin_id", "bin_offset"])

    return run


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, shard: int = SHARD, cluster: str | None = None) -> DataFrame:
    """(doc_id, first_token, n_tokens, bin_id, bin_offset) of every piece of every document."""
    refuse_clash(doc_id, ["first_token", "n_tokens", "bin_id", "bin_offset"])
    spark = docs.sparkSession
    columns = ["id", "source", "n_tokens", "cluster"]
    sized = stored(measure(docs, doc_id, text, source, cluster).groupBy(columns).agg(F.count("*").alias("copies")))
    share = sized.groupBy("source").agg(F.sum("copies").alias("n"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    total = share.agg(F.sum("n"), F.sum("tokens")).first()
    rows, tokens = total[0] or 0, total[1] or 0
    per_bin = capacity * rows / tokens if tokens else 1.0
    # Only sources above a fixed share of all rows get more than one slot, so the table is small.
    hot = share.filter(F.col("source").isNotNull() & (F.col("n") * SLACK * per_bin > rows)).collect()
    slots = {r["source"]: max(1, int(-(-r["n"] * SLACK * per_bin // rows))) for r in hot}
    shards = max(1, -(-rows // shard))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    each = sized.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    dealt = each.select(F.pmod(F.xxhash64("id", "cluster", "n_tokens", "copy"), F.lit(shards)).alias("shard"), *columns)
    packed = dealt.repartition(max(parts, min(shards, 4 * parts)), "shard").sortWithinPartitions("shard").mapInArrow(_pack_shards(capacity, slots), "id long, first_token long, n_tokens long, bin_id long, bin_offset long")
    return packed.withColumnRenamed("id", doc_id)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into bins of CAPACITY tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
