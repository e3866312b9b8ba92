"""Near-duplicate embeddings by randomised-rotation binary codes.

Equal vectors of one label are one class. Each class's unit vector is rotated at random and
kept as packed sign bits with the correction factor <signs, vector>/sqrt(dims), and as a
query of QUERY_BITS bits a component, rounded at random, in bit planes. Sign bits against
bit planes (AND and popcount), over the factor, are an unbiased estimate of the inner
product, with a standard error of about

    sqrt(((1 - f**2) / (dims - 1) + step**2 / 4) / f**2)

Pairs whose estimate plus BOUND errors reaches the threshold are recomputed exactly in
double precision, and only those.

Which pairs are estimated is decided by tables of code bits of further rotations: vectors
of one label that agree on all bits of some table meet. The number of bits follows the
largest label's size, and the number of tables keeps the loss of a pair at the threshold
below `MISS`. Only codes go to the buckets; vectors follow for those classes alone that
have a pair inside the bound there. A bucket above BLOCK classes is dealt over blocks, and
its pairs of blocks are compared apart, so no task holds more than two blocks. A pair is
counted in the first table where it meets; buckets return counts and spanning forests,
never pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components, whose
squares sum to nothing or to infinity, and those with a null label or id, link with nothing
(a null id has a null component and is kept). Vectors of different lengths do not link.
Rows of one id are one vector (the least of them) and come out once each. Other columns
are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.lineage import refuse_clash, stored
from quern.llm.near_dedup import _Forest, _runs

#: Chance to lose a pair at the threshold.
MISS = 1e-3
#: Vectors of a bucket that are compared at once.
BLOCK = 2048
#: Bits of a rotated component on the query's side.
QUERY_BITS = 4
#: Errors of the estimate that are allowed for.
BOUND = 5.0


@functools.lru_cache(maxsize=64)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, made once per process."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    room = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, room))), axis=1).view(np.uint64)


class Codes:
    """Sign bits, bit planes and their scales of vectors of one length: what is stored of a vector, and what is estimated from it."""

    FIELDS = "code binary, planes binary, low float, step float, factor float"

    def __init__(self, dims: int, code: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, factor: np.ndarray):
        self.dims, self.code, self.planes, self.low, self.step, self.factor = dims, code, planes, low, step, factor

    @staticmethod
    def of(unit: np.ndarray) -> Codes:
        dims = unit.shape[1]
        turned = unit @ rotation(dims, 1)
        low, top = turned.min(axis=1), (1 << QUERY_BITS) - 1
        step = np.maximum((turned.max(axis=1) - low) / top, 1e-12)
        # The rounding is drawn from the vector itself, so a repeated task draws the same.
        drawn = np.random.default_rng(int(np.abs(turned).sum() * 1e6) & 0xFFFFFFFF).random(turned.shape)
        level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + drawn), 0, top).astype(np.uint8)
        planes = np.stack([_words(level >> b & 1) for b in range(QUERY_BITS)], axis=1)
        return Codes(dims, _words(turned >= 0), planes, low, step, np.abs(turned).sum(axis=1) / math.sqrt(dims))

    def columns(self) -> list[pa.Array]:
        """The fields as Arrow columns."""
        return [pa.array([x.tobytes() for x in self.code], pa.binary()), pa.array([x.tobytes() for x in self.planes], pa.binary()), *(pa.array(x.astype(np.float32), pa.float32()) for x in (self.low, self.step, self.factor))]

    @staticmethod
    def read(dims: int, columns: list[pa.Array]) -> Codes:
        words = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1)
        code = words(columns[0])
        return Codes(dims, code, words(columns[1]).reshape(len(code), QUERY_BITS, -1), *(c.to_numpy().astype(np.float64) for c in columns[2:5]))

    def estimates(self, queries: slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of some vectors, as queries (rows), with all (columns), and their standard errors."""
        planes = self.planes[queries]
        weighted = sum((1 << b) * np.bitwise_count(planes[:, b, None, :] & self.code[None]).sum(axis=2, dtype=np.int32) for b in range(QUERY_BITS))
        total = sum((1 << b) * np.bitwise_count(planes[:, b]).sum(axis=1, dtype=np.int32) for b in range(QUERY_BITS))
        ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int32)
        signed = self.step[queries, None] * (2.0 * weighted - total[:, None]) + self.low[queries, None] * (2.0 * ones - self.dims)[None]
        f2 = self.factor**2
        error = np.sqrt(((1 - np.minimum(f2, 1))[None] / max(self.dims - 1, 1) + (self.step[queries] ** 2 / 4)[:, None]) / f2[None])
        return signed / math.sqrt(self.dims) / self.factor[None], error

    def pairs(self, threshold: float, bound: float, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) that may reach the threshold; of two parts only those across."""
        n, two = len(self.code), (part != part[0]).any()
        for s in range(0, n, 256):
            e = min(s + 256, n)
            inner, error = self.estimates(slice(s, e))
            near = inner + bound * error >= threshold
            near &= np.arange(n)[None, :] > np.arange(s, e)[:, None]
            if two:
                near &= part[None, :] != part[s:e, None]
            i, j = np.nonzero(near)
            for p in range(0, len(i), 100_000):
                yield i[p : p + 100_000] + s, j[p : p + 100_000]


def plan_tables(most: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table's key and the number of tables, for a label of so many vectors."""
    bits = max(6, math.ceil(math.log2(max(most, 1) / 16 + 1)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _encode(bits: int, tables: int):
    """From (id, v): the id, its table keys and its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            size = np.diff(np.asarray(batch.column(1).offsets))
            for dims in np.unique(size).tolist():
                rows = pa.array(np.flatnonzero(size == dims))
                x = _matrix(batch.column(1).take(rows))
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                if dims not in planes:
                    need = -(-bits * tables // dims)
                    planes[dims] = np.concatenate([rotation(dims, 100 + i) for i in range(need)], axis=1)[:, : bits * tables]
                keys = (unit @ planes[dims] >= 0).reshape(len(rows), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(list(keys), pa.list_(pa.int64())), *Codes.of(unit).columns()], names=["id", "keys", "code", "planes", "low", "step", "factor"])

    return run


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each task, which comes in the first column, if it has two or more."""
    for batch in _runs(batches):
        task = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]])).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo > 1:
                yield batch.slice(lo, hi - lo)


def _candidates(threshold: float, bound: float):
    """From (task, id, part, dims, code..) sorted by task: (task, id) of the classes with a pair inside the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_task(batches):
            codes = Codes.read(rows.column(3)[0].as_py(), rows.columns[4:9])
            some = np.zeros(rows.num_rows, bool)
            for i, j in codes.pairs(threshold, bound, rows.column(2).to_numpy()):
                some[i] = some[j] = True
            if some.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(some)) for c in rows.columns[:2]], names=["task", "id"])

    return run


def _exact_links(threshold: float, bound: float):
    """From (task, id, part, dims, code.., turn, copies, keys, v) sorted by task: link counts (a, null, n) and forest links (a, b, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_task(batches):
            ids, copies, turn = rows.column(1).to_numpy(), rows.column(10).to_numpy(), rows.column(9)[0].as_py()
            keys, x = _matrix(rows.column(11)), _matrix(rows.column(12))
            length = np.sqrt((x * x).sum(axis=1))
            codes = Codes.read(rows.column(3)[0].as_py(), rows.columns[4:9])
            count, forest, ends = np.zeros(len(ids)), _Forest(len(ids)), []
            for a, b in codes.pairs(threshold, bound, rows.column(2).to_numpy()):
                linked = (x[a] * x[b]).sum(axis=1) / (length[a] * length[b]) >= threshold
                a, b = a[linked], b[linked]
                first = (keys[a] == keys[b]).argmax(axis=1) == turn
                a, b = a[first], b[first]
                count += np.bincount(a, weights=copies[b], minlength=len(ids)) + np.bincount(b, weights=copies[a], minlength=len(ids))
                ends += [(int(ids[u]), int(ids[v])) for u, v in zip(a.tolist(), b.tolist(), strict=True) if forest.join(u, v)]
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids[some].tolist(), *(u for u, _ in ends)], pa.int64()), pa.array([None] * len(some) + [v for _, v in ends], pa.int64()), pa.array([*count[some].astype(np.int64).tolist(), *(0 for _ in ends)], pa.int64())],
                names=["a", "b", "n"],
            )

    return run


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; vectors of one label link if their cosine reaches the threshold."""
    refuse_clash(vec_id, ["n_links", "component_id", "kept"])
    spark = vectors.sparkSession
    v = F.col("v")
    square = F.aggregate(v, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c)) & (square > 0) & (square < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    one = rows.filter(F.coalesce(good, F.lit(False))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    one = stored(one.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64("v", "label", F.lit(7))))
    same = stored(one.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    classes = one.join(same.select(F.col("rep").alias("id"), "copies"), "id").select("id", "label", "v", "copies")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan_tables(most, threshold, miss)
    coded = stored(classes.select("id", "v").mapInArrow(_encode(bits, tables), f"id long, keys array<long>, {Codes.FIELDS}").join(classes.select("id", "label", "copies", F.size("v").alias("dims"), "v"), "id"))
    met = coded.select("id", F.posexplode("keys").alias("turn", "key"), "dims", "label").select("id", "turn", F.xxhash64("turn", "key", "dims", "label").alias("bucket"))
    size = met.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    dealt = met.join(size, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tasks = dealt.select("id", "turn", "bucket", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("id", "turn", "part", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("task"))
    tasks = stored(tasks)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    codes = ["code", "planes", "low", "step", "factor"]
    near = tasks.join(coded.select("id", "dims", *codes), "id").select("task", "id", "part", "dims", *codes)
    flagged = stored(near.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_candidates(threshold, BOUND), "task long, id long"))
    full = flagged.join(tasks, ["task", "id"]).join(coded.select("id", "dims", *codes, "copies", "keys", "v"), "id").select("task", "id", "part", "dims", *codes, "turn", "copies", "keys", "v")
    found = stored(full.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_exact_links(threshold, BOUND), "a long, b long, n long"))
    count = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "rep")
    group = connected_components(found.filter("b IS NOT NULL")).withColumnRenamed("id", "rep")
    member = one.join(same.filter("copies > 1"), ["h1", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    known = member.join(count, "rep", "left").join(group, "rep", "left").select("id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return (
        rows.select("id")
        .join(known, "id", "left")
        .select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(True)))
    )


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings: cosine of 0.93 or more within a label."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
), q AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v
), k AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM q a JOIN q b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.l > 0 AND b.l > 0 AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.93
), r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT k.y, r.c FROM r JOIN k ON k.x = r.id WHERE r.c < k.y
), m AS (SELECT id, min(c) AS c FROM r GROUP BY id
), n AS (SELECT x, count(*) AS n FROM k GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, m.c = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id JOIN m ON m.id = e.vec_id
"""
