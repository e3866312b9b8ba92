"""Language-model scoring with a log-frequency Bloom filter.

Words and word pairs of the training documents are counted exactly, by a shuffle of
sorted hash arrays. Their counts are quantised on a log scale: a count of level q is held
as the q filter items (n-gram, 1) .. (n-gram, q). The filter has one segment per hash
bucket, sized by the bucket's exact number of items, so that every n-gram counted is held
at any input size. It is never in one place: a segment is probed in the task that builds
it, for the n-grams that each block of documents asks for, and the levels read are sent
back to the blocks. A count is read back by probing levels 1, 2, .. until one is absent.
The probability of a word after another is

    L * count(pair) / count(first) + (1 - L) * (count(word) + 1) / (N + V + 1)

with the counts so read and L = 1 - (pairs seen once) / (pairs), the Good-Turing mass of
seen pairs. The base score uses the exact word counts, which are sent back to the blocks
with the levels, as arrays in the order asked. The texts are cut into tokens once; the
blocks are stored with their ids, so a repeated task, or an input that comes out in
another order, cannot give a block another's replies. What is sent is packed without
loss: sorted hashes as the steps of their upper 16 bits and the rest as it is, a block's
tokens as places in the order of how often they stand there, counts and levels by bytes
of one weight.

Cases: null and empty texts are one end token; with nothing to learn from, N and V are 0
and the base score is 0; a null id is held out. Repeated rows are learnt from and scored
one by one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textcore as T
from quern.llm.language_id import held_out
from quern.llm.lineage import refuse_clash, stored
from quern.llm.near_dedup import _runs

#: Least bits of a filter segment for each of its items.
BITS_PER_ITEM = 10
PROBES = 5
#: Counts of level q are about BASE**(q-1) to BASE**q.
BASE = 2**0.5
#: Text bytes in a block of documents, and text bytes that one hash bucket stands for.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20

END = np.uint64(0xC0FFEE1234567891)
_PAIR = np.uint64(0xA24BAED4963EE407)
UNI, BI, TOTAL = 0, 1, 2
#: Bits of a word's and of a pair's hash within its bucket.
KEY_BITS = {UNI: 48, BI: 32}

_small, _large = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _bytes(x: np.ndarray, size: int) -> np.ndarray:
    """The bytes of whole numbers, one row a number, the lowest first."""
    return np.ascontiguousarray(x, f"<u{size}").view(np.uint8).reshape(-1, size)


def _numbers(rows: np.ndarray, size: int) -> np.ndarray:
    """The numbers of rows of bytes, the lowest first; higher bytes are 0."""
    out = np.zeros((len(rows), size), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.reshape(-1).view(f"<u{size}")


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in few bytes: the width of the greatest, then the bytes of each weight together, compressed."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + _small.compress(_bytes(x, 4 if width <= 4 else 8)[:, :width].T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    """The numbers of `pack`, as 32-bit ones if they fit."""
    planes = np.frombuffer(_large.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return _numbers(planes.T, 4 if data[0] <= 4 else 8)


def pack_keys(keys: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Sorted numbers of so many bits, 32 or 48: the steps of their upper 16 bits, packed, and the bits below as they are."""
    return pack(np.diff(keys >> np.uint64(bits - 16), prepend=np.uint64(0))), _bytes(keys, 8)[:, : bits // 8 - 2].tobytes()


def unpack_keys(steps: bytes, rest: bytes, bits: int) -> np.ndarray:
    """The numbers of `pack_keys`."""
    low = _numbers(np.frombuffer(rest, np.uint8).reshape(-1, bits // 8 - 2), 8)
    return low | (np.cumsum(unpack(steps), dtype=np.uint64) << np.uint64(bits - 16))


def pack_tokens(h: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Token hashes as places in the distinct ones, the most frequent first, how often each stands there, and the steps of the sorted distinct ones."""
    u, code, n = np.unique(h, return_inverse=True, return_counts=True)
    place = np.empty(len(u), np.int64)
    place[np.argsort(-n, kind="stable")] = np.arange(len(u))
    return pack(place[code]), pack(n), pack(np.diff(u, prepend=np.uint64(0)))


def unpack_tokens(data: bytes, often: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of `pack_tokens`, and the tokens as places in them."""
    order = np.argsort(-unpack(often).astype(np.int64), kind="stable").astype(np.uint32)
    return np.cumsum(unpack(steps), dtype=np.uint64), order[unpack(data)]


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block's texts, each with its end token, and the first token of each text."""
    hashes, counts = [], []
    for lo, hi in T.slices(off):
        w = T.Words(data, off[lo : hi + 1], T.SPACE)
        hashes.append(w.hash)
        counts.append(np.diff(w.first))
    n = np.concatenate(counts) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.full(first[-1], END, np.uint64)
    words = np.ones(first[-1], bool)
    words[first[1:] - 1] = False
    out[words] = np.concatenate(hashes)
    return out, first


def _pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; a text's first token comes after an end token."""
    before = np.empty_like(h)
    before[0], before[1:] = END, h[:-1]
    return T.mix(before * _PAIR + h)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: an id, the rows' ids and whether they are held out, and the packed tokens."""
    block = TaskContext.get().partitionId() << 32
    one = lambda x, kind: pa.array([x], kind)
    for batch in batches:
        data, off = T.text_buffers(batch.column(2))
        for lo, hi in T.slices(off, BLOCK_BYTES):
            h, first = _tokens(data, off[lo : hi + 1])
            codes, often, steps = pack_tokens(h)
            ids, held = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [one(block, pa.int64()), *(one(x, pa.binary()) for x in (codes, often, steps)), one(first.astype(np.int64).tobytes(), pa.binary()), one(ids, pa.list_(pa.int64())), one(held, pa.list_(pa.bool_()))],
                names=["block", "data", "often", "level", "first", "ids", "held"],
            )
            block += 1


def spread(n: int) -> np.ndarray:
    """n integers that Spark's hash partitioning deals one to each of n partitions (32-bit Murmur3 with seed 42)."""
    out = np.full(n, -1, np.int64)
    for lo in range(0, 1 << 31, 16 * n):
        key = np.arange(lo, lo + 16 * n, dtype=np.uint32)
        turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        h = turn(np.uint32(42) ^ turn(key * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        part = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
        new, at = np.unique(part, return_index=True)
        fresh = out[new] < 0
        out[new[fresh]] = key[at[fresh]]
        if (out >= 0).all():
            return out
    return np.maximum(out, 0)


def _send(rbits: int, tasks: np.ndarray):
    """Per block and hash bucket the block's words and pairs with their training counts, which are 0 in held-out texts."""
    shift, buckets = np.uint64(64 - rbits), 1 << rbits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, data, often, level, first, held = (batch.column(c)[i].as_py() for c in ("block", "data", "often", "level", "first", "held"))
                u, code = unpack_tokens(data, often, level)
                train = np.repeat(~np.array(held, bool), np.diff(np.frombuffer(first, np.int64)))
                out: list[tuple[int, int, int, int, bytes, bytes, bytes]] = []
                count = np.bincount(code[train], minlength=len(u)).astype(np.uint32)
                pair, where = np.unique(_pairs(u[code]), return_inverse=True)
                many = np.bincount(where[train], minlength=len(pair)).astype(np.uint32)
                for kind, keys, n in ((UNI, u, count), (BI, pair, many)):
                    cut = np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))
                    keys = (keys << np.uint64(rbits)) >> np.uint64(64 - KEY_BITS[kind])
                    for b in np.flatnonzero(np.diff(cut)).tolist():
                        s = slice(cut[b], cut[b + 1])
                        out.append((int(tasks[b]), b, kind, block, *pack_keys(keys[s], KEY_BITS[kind]), pack(n[s])))
                for j in range(0, len(out), 64):
                    cols = list(zip(*out[j : j + 64], strict=True))
                    kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["task", "bucket", "kind", "block", "high", "low", "n"])

    return run


def level(count: np.ndarray) -> np.ndarray:
    """The quantised count: 1 for 1, and one more for each factor of BASE."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def expected(q: np.ndarray) -> np.ndarray:
    """The count that level q stands for; 0 for 0."""
    return np.where(q > 0, np.where(q == 1, 1.0, (BASE ** (q - 1.0) + BASE**q) / 2), 0.0)


def _probes(key: np.ndarray, kind: int, q: int, bits: int) -> Iterator[np.ndarray]:
    h = T.mix(key.astype(np.uint64) | np.uint64(kind << 32) | np.uint64(q << 34))
    a, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def segment_bits(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> int:
    """The power of two of bits that holds all items of a bucket's n-grams."""
    items = sum(int(level(count[count > 0]).sum()) for _, _, count in parts)
    return 1 << max(6, (BITS_PER_ITEM * items - 1).bit_length())


def segment(parts: list[tuple[int, np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    """The filter bits of one bucket's n-grams (kind, 32-bit keys, counts), all of them."""
    out = np.zeros(bits, bool)
    for kind, key, count in parts:
        key, q = key[count > 0], level(count[count > 0])
        for j in range(1, int(q.max()) + 1 if len(q) else 1):
            for at in _probes(key[q >= j], kind, j, bits):
                out[at] = True
    return out


class Model:
    """A filter of 2**rbits segments, and its totals; a bucket's own is one segment, probed with hashes within the bucket."""

    def __init__(self, segments: dict[int, bytes], rbits: int, bits: int, n: int, v: int, once: int, pairs: int):
        self.rbits, self.bits, self.totals = rbits, bits, (n, v, once, pairs)
        empty = bytes(bits // 8)
        self.filter = np.frombuffer(b"".join(segments.get(b, empty) for b in range(1 << rbits)), np.uint8)

    def levels(self, h: np.ndarray, kind: int) -> np.ndarray:
        """The levels read back for n-gram hashes."""
        base = (h >> np.uint64(64 - self.rbits)).astype(np.int64) * self.bits if self.rbits else np.zeros(len(h), np.int64)
        key = ((h << np.uint64(self.rbits)) >> np.uint64(32)).astype(np.uint32)
        q, live = np.zeros(len(h), np.uint8), np.arange(len(h))
        j = 0
        while len(live):
            j += 1
            here = np.ones(len(live), bool)
            for at in _probes(key[live], kind, j, self.bits):
                at = at + base[live]
                here &= (self.filter[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            live = live[here]
            q[live] = j
        return q

    def counts(self, h: np.ndarray, kind: int) -> np.ndarray:
        """The counts read back for n-gram hashes."""
        return expected(self.levels(h, kind).astype(np.int64))


def _count():
    """Sums each bucket, and gives its totals and, to each block, the exact counts and the levels read of the n-grams it asked for."""

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 1):
            bucket = batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.slice(lo, hi - lo).to_pydict()
                uni = [i for i, k in enumerate(rows["kind"]) if k == UNI]
                bi = [i for i, k in enumerate(rows["kind"]) if k == BI]
                asked = [unpack_keys(high, low, KEY_BITS[kind]) for kind, high, low in zip(rows["kind"], rows["high"], rows["low"], strict=True)]
                n = [unpack(x) for x in rows["n"]]
                u, code = np.unique(joined([asked[i] for i in uni]), return_inverse=True)
                count = np.bincount(code, weights=joined([n[i] for i in uni]), minlength=len(u)).astype(np.int64)
                pair, where = np.unique(joined([asked[i] for i in bi]).astype(np.uint32), return_inverse=True)
                many = np.bincount(where, weights=joined([n[i] for i in bi]), minlength=len(pair)).astype(np.int64)
                word = (u >> np.uint64(16)).astype(np.uint32)
                parts = [(UNI, word, count), (BI, pair, many)]
                bits = segment_bits(parts)
                m = Model({0: np.packbits(segment(parts, bits)).tobytes()}, 0, bits, int(count.sum()), int((count > 0).sum()), int((many == 1).sum()), int(many.sum()))
                read = {UNI: m.levels(word.astype(np.uint64) << np.uint64(32), UNI)[code], BI: m.levels(pair.astype(np.uint64) << np.uint64(32), BI)[where]}
                exact = count[code]
                block, data, levels = [], [], []
                for kind, which in ((UNI, uni), (BI, bi)):
                    at = 0
                    for i in which:
                        size = len(n[i])
                        block.append(rows["block"][i])
                        data.append(pack(exact[at : at + size]) if kind == UNI else b"")
                        levels.append(pack(read[kind][at : at + size]))
                        at += size
                k = len(block)
                cols = [pa.array([UNI] * len(uni) + [BI] * len(bi) + [TOTAL], pa.int32()), pa.array([int(bucket[lo])] * (k + 1), pa.int32()), pa.array([*block, -1], pa.int64()), pa.array([*data, b""], pa.binary()), pa.array([*levels, b""], pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([0] * k + [x], pa.int64()) for x in m.totals)], names=["kind", "bucket", "block", "data", "level", "n", "v", "once", "pairs"])

    return run


def _log_probabilities(u: np.ndarray, code: np.ndarray, words: np.ndarray, pairs: np.ndarray, mass: float, n: int, v: int) -> np.ndarray:
    """log10 probability of each token of a block, whose distinct hashes are u[code], by the counts read of its distinct words and pairs."""
    c = words[code]
    before = np.empty_like(c)
    before[0], before[1:] = words[np.searchsorted(u, END)], c[:-1]
    both = pairs[np.unique(_pairs(u[code]), return_inverse=True)[1]]
    p = np.where((both > 0) & (before > 0), np.minimum(both / np.maximum(before, 1), 1.0), 0.0)
    return np.log10(mass * p + (1 - mass) * (c + 1) / (n + v + 1))


def _scores(n: int, v: int, mass: float):
    """Joins each block, which comes first, with the replies to it, in the order of the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            block = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.slice(lo, hi - lo)
                kind, data, levels = (rows.column(i).to_pylist() for i in (2, 3, 4))
                u, code = unpack_tokens(data[0], rows.column(8)[0].as_py(), levels[0])
                c = np.concatenate([unpack(x) for x, y in zip(data, kind, strict=True) if y == UNI]).astype(np.int64)
                words, pairs = (expected(np.concatenate([unpack(x) for x, y in zip(levels, kind, strict=True) if y == which]).astype(np.int64)) for which in (UNI, BI))
                first = np.frombuffer(rows.column(5)[0].as_py(), np.int64)
                base = np.add.reduceat((np.log10(c + 1.0) - np.log10(n + v + 1.0))[code], first[:-1])
                known = np.add.reduceat((c > 0)[code], first[:-1], dtype=np.int64)
                score = np.add.reduceat(_log_probabilities(u, code, words, pairs, mass, n, v), first[:-1])
                ids = pa.array(rows.column(6)[0].as_py(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows.column(7)[0].as_py(), pa.bool_()), pa.array(np.diff(first)), pa.array(known), pa.array(np.full(len(known), n)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learning from the rows that are not held out."""
    spark = docs.sparkSession
    refuse_clash(doc_id, ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    held = held_out(doc_id, 7, 2) if held is None else held
    src = docs.select(F.col(doc_id).cast("long").alias("id"), held.alias("held"), F.col(text).cast("string").alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rbits = max(4, int(size // BUCKET_BYTES).bit_length())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << rbits)
    blocks = stored(src.mapInArrow(_tokenise, "block long, data binary, often binary, level binary, first binary, ids array<long>, held array<boolean>"))
    sent = blocks.select("block", "data", "often", "level", "first", "held").mapInArrow(_send(rbits, spread(parts)), "task int, bucket int, kind int, block long, high binary, low binary, n binary")
    counted = stored(sent.repartition(parts, "task").sortWithinPartitions("bucket").mapInArrow(_count(), "kind int, bucket int, block long, data binary, level binary, n long, v long, once long, pairs long"))
    n, v, once, pairs = (x or 0 for x in counted.filter(F.col("kind") == TOTAL).agg(*[F.sum(c) for c in ("n", "v", "once", "pairs")]).first())
    mass = 1 - once / pairs if pairs else 0.0
    names = ["block", "bucket", "kind", "data", "level", "first", "ids", "held", "often"]
    asked = blocks.select("block", F.lit(-1).alias("bucket"), F.lit(-1).alias("kind"), *names[3:])
    replies = counted.filter(F.col("kind") != TOTAL).select("block", "bucket", "kind", "data", "level", F.lit(None).cast("binary").alias("first"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<boolean>").alias("held"), F.lit(None).cast("binary").alias("often"))
    both = asked.select(*names).union(replies.select(*names)).repartition(parts, "block").sortWithinPartitions("block", "bucket")
    return both.mapInArrow(_scores(n, v, mass), f"`{doc_id}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32(doc_id) mod 7 is not 2."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
