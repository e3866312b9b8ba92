"""Toxicity by a classifier chain.

Linear models over hashed words and word beginnings predict one category after the
other; each later model also sees the log-odds of the earlier categories. For its
training these come from models that were fitted without the row (out of fold), for new
texts from the models fitted on all rows. The models learn from at most `MAX_TRAIN`
labelled documents, chosen, like the folds, by a hash of their ids; the threshold of the last category is
the one with the best F1 over its out-of-fold predictions.

Cases: null and empty texts have no words and are scored by the bias alone; rows without
a label for all categories are not learnt from; with no labelled row, or one class alone,
a category's probability is the class share (0 without rows). Repeated rows are scored one
by one; repeated labels of a document count as their maximum. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textcore as T
from quern.llm.lineage import refuse_clash

#: Labelled documents that are learnt from: the bound of what reaches the driver.
MAX_TRAIN = 4000
DIMS = 1 << 18
#: Bytes of a word that make its beginning.
HEAD = 6
FOLDS = 4
L2 = 3.0
#: Features in fewer of the learnt documents than this are left out.
MIN_DOCS = 4


def features(words: T.Words, data_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the slice's texts, in row order."""
    doc = np.repeat(np.arange(data_rows, dtype=np.uint64), np.diff(words.first))
    head = np.minimum(words.ends, words.starts + HEAD)
    key = np.zeros(len(doc), np.uint64)
    for i in range(HEAD):
        at = words.starts + i
        inside = at < head
        key = key * np.uint64(257) + np.where(inside, words.bytes[np.minimum(at, max(len(words.bytes) - 1, 0))], 0).astype(np.uint64) + inside
    begin = T.mix(key) >> np.uint64(47)
    whole = (words.hash >> np.uint64(47)) | np.uint64(DIMS // 2)
    every = np.concatenate([(doc << np.uint64(18)) | whole, (doc << np.uint64(18)) | begin])
    unique, n = np.unique(every, return_counts=True)
    return (unique >> np.uint64(18)).astype(np.int64), (unique & np.uint64(DIMS - 1)).astype(np.int64), np.log2(1 + n)


class Rows:
    """A sparse matrix by rows."""

    def __init__(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray, dims: int):
        self.starts, self.index, self.value, self.dims = starts, index, value, dims
        self.row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index] * self.value, minlength=len(self.starts) - 1)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=r[self.row] * self.value, minlength=self.dims)

    def pick(self, rows: np.ndarray) -> Rows:
        take = np.concatenate([np.arange(self.starts[i], self.starts[i + 1]) for i in rows]) if len(rows) else np.zeros(0, np.int64)
        return Rows(np.concatenate([[0], np.cumsum(np.diff(self.starts)[rows])]), self.index[take], self.value[take], self.dims)


def fit(x: Rows, extra: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression with an L2 penalty, by limited-memory BFGS: features, extra columns, bias."""
    n, d, k = len(y), x.dims, extra.shape[1]
    w = np.zeros(d + k + 1)
    share = min(max(y.mean() if n else 0.0, 1e-6), 1 - 1e-6)
    w[-1] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return w

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w[:d]) + extra @ w[d:-1] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        grad = np.concatenate([x.back(p - y), extra.T @ (p - y), [(p - y).sum()]])
        grad[:-1] += L2 * w[:-1]
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + L2 / 2 * (w[:-1] ** 2).sum()), grad

    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, used = grad.copy(), []
        for s, t, rho in reversed(past):
            a = rho * (s @ q)
            q -= a * t
            used.append(a)
        if past:
            s, t, _ = past[-1]
            q *= (s @ t) / (t @ t)
        else:
            q /= max(np.abs(grad).max(), 1.0)
        for (s, t, rho), a in zip(past, reversed(used), strict=True):
            q += (a - rho * (t @ q)) * s
        slope, step = -(grad @ q), 1.0
        while step > 1e-6:
            new_value, new_grad = loss(w - step * q)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = -step * q, new_grad - grad
        if s @ t > 1e-10:
            past = [*past[-7:], (s, t, 1 / (s @ t))]
        done = value - new_value < 1e-6 * abs(value)
        w, value, grad = w - step * q, new_value, new_grad
        if done:
            break
    return w


class Chain:
    """A model per category, in order, and the threshold of the last one."""

    def __init__(self, categories: list[str]):
        self.categories, self.weights, self.threshold = categories, [np.concatenate([np.zeros(DIMS + i), [-35.0]]) for i in range(len(categories))], 0.5

    def train(self, x: Rows, labels: np.ndarray, fold: np.ndarray) -> None:
        used = np.flatnonzero(np.bincount(x.index, minlength=DIMS) >= MIN_DOCS)
        number = np.full(DIMS, -1)
        number[used] = np.arange(len(used))
        keep = number[x.index] >= 0
        x = Rows(np.concatenate([[0], np.cumsum(keep)])[x.starts], number[x.index[keep]], x.value[keep], len(used))
        d = len(used)
        extra, self.weights = np.zeros((len(labels), 0)), []
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(np.float64)
            out = np.zeros(len(y))
            for f in range(FOLDS):
                rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                w = fit(x.pick(rest), extra[rest], y[rest])
                out[own] = x.pick(own).dot(w[:d]) + extra[own] @ w[d:-1] + w[-1]
            w = fit(x, extra, y)
            whole = np.zeros(DIMS)
            whole[used] = w[:d]
            self.weights.append(np.concatenate([whole, w[d:]]))
            extra = np.column_stack([extra, np.clip(out, -10, 10)])
        best = -1.0
        odds, y = extra[:, -1], labels[:, -1]
        for cut in np.unique(np.quantile(odds, np.linspace(0.02, 0.98, 193))):
            hit = odds >= cut
            f1 = 2 * (hit & (y > 0)).sum() / max(hit.sum() + (y > 0).sum(), 1)
            if f1 > best:
                best, self.threshold = f1, float(1 / (1 + np.exp(-cut)))

    def odds(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, len(self.weights)))
        for c, w in enumerate(self.weights):
            z = np.bincount(row, weights=w[index] * value, minlength=rows) + np.clip(out[:, :c], -10, 10) @ w[DIMS:-1] + w[-1]
            out[:, c] = z
        return out


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], doc_id: str = "doc_id", text: str = "text", most: int = MAX_TRAIN) -> Chain:
    """A chain of the categories, SQL conditions on the labels by name, from a bounded sample of the labelled documents."""
    chain = Chain(list(categories))
    chosen = labels.select(F.col(doc_id).alias("id"), *[F.expr(c).cast("int").alias(f"c{i}") for i, c in enumerate(categories.values())]).na.drop().groupBy("id").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))]).orderBy(F.xxhash64("id"), "id").limit(most)
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).filter("id IS NOT NULL").join(F.broadcast(chosen), "id").select("id", "text", F.array(*[f"c{i}" for i in range(len(categories))]).alias("y"), F.pmod(F.xxhash64("id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.text_buffers(batch.column(1))
            for lo, hi in T.slices(off):
                row, index, value = features(T.Words(data, off[lo : hi + 1], T.NON_WORD), hi - lo)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                x = [index[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                v = [value[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(x, pa.binary()), pa.array(v, pa.binary())], names=["id", "y", "fold", "x", "v"])

    rows = sorted(sample.mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, y array<int>, fold int, x binary, v binary").collect(), key=lambda r: (r["id"], bytes(r["x"])))
    if rows:
        size = np.array([len(r["x"]) // 4 for r in rows])
        x = Rows(np.concatenate([[0], np.cumsum(size)]), np.concatenate([np.frombuffer(r["x"], np.int32) for r in rows]).astype(np.int64), np.concatenate([np.frombuffer(r["v"], np.float32) for r in rows]).astype(np.float64), DIMS)
        # Folds are dealt by a hash of the id, so copies of an id stay together.
        chain.train(x, np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows]))
    return chain


def predict(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_<category> .., toxic): probabilities, and whether the last reaches the threshold."""
    refuse_clash(doc_id, ["toxic", *(f"p_{c}" for c in chain.categories)])
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    src = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            data, off = T.text_buffers(batch.column(1))
            for lo, hi in T.slices(off):
                row, index, value = features(T.Words(data, off[lo : hi + 1], T.NON_WORD), hi - lo)
                p = 1 / (1 + np.exp(-np.clip(chain.odds(row, index, value, hi - lo), -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(p[:, -1] >= chain.threshold)], names=[doc_id, *names, "toxic"])

    return src.mapInArrow(run, f"`{doc_id}` {src.schema['id'].dataType.simpleString()}, {', '.join(f'{n} double' for n in names)}, toxic boolean")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: first low quality, then toxicity."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return predict(docs, train_chain(docs, labels, {"low_quality": "quality = 0", "toxic": "toxic = 1"}))
