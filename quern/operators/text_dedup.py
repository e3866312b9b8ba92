"""Removal of repeated texts from a frame: exact, or near by banded MinHash.

The near method works on sets of word n-grams. Rows meet in the band buckets that they
share, each bucket becomes a star around its least row, and connected components are
found by star contraction with lineage cut by checkpoints; the least row of a component
stays.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PRIME = np.uint64((1 << 61) - 1)
_SPLIT = re.compile(r"\W")


def exact(frame: DataFrame, column: str, order: str) -> DataFrame:
    """The first row of each text."""
    w = Window.partitionBy(F.md5(column), column).orderBy(order)
    return frame.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def bands(threshold: float, permutations: int, weight: float = 0.5) -> tuple[int, int]:
    """(bands, rows) with the least weighted area of false positives and negatives."""
    s = (np.arange(1000) + 0.5) / 1000
    best, out = np.inf, (1, permutations)
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            meet = 1 - (1 - s**r) ** b
            error = weight * meet[s < threshold].sum() + (1 - weight) * (1 - meet[s >= threshold]).sum()
            if error < best:
                best, out = error, (b, r)
    return out


def minhash(frame: DataFrame, column: str, order: str, threshold: float = 0.7, permutations: int = 128, ngrams: int = 5, min_length: int = 5, seed: int = 42) -> DataFrame:
    """One row of each component of near copies."""
    b, r = bands(threshold, permutations)
    rng = np.random.RandomState(seed)
    a, c = (rng.randint(1, (1 << 31) - 1, b * r, dtype=np.uint64) for _ in range(2))

    @F.pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = [w for w in _SPLIT.split((t or "").lower()) if w]
            grams = {" ".join(words[i : i + ngrams]) for i in range(len(words) - ngrams + 1)} if len(words) >= min_length else set()
            if not grams:
                out.append([])
                continue
            h = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams], np.uint64)
            sig = (((h[:, None] % _PRIME) * a + c) % _PRIME & np.uint64(0xFFFFFFFF)).min(axis=0)
            out.append([f"{i}:{hashlib.md5(sig[i * r : i * r + r].tobytes()).hexdigest()}" for i in range(b)])
        return pd.Series(out)

    met = frame.select(F.col(order).alias("id"), F.explode(keys(column)).alias("key"))
    hub = met.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    links = met.join(hub, "key").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    gone = components(links).filter("id <> component").select(F.col("id").alias(order))
    return frame.join(gone, order, "left_anti")


def components(links: DataFrame) -> DataFrame:
    """(id, component) by rounds of taking the least label of the neighbours and of the label's own label."""
    spark = links.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not folder:
            import tempfile

            folder = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(folder)
    both = links.union(links.select("b", "a")).toDF("a", "b").distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")).checkpoint()
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id").select("id", F.least("component", "near").alias("component"))
        jump = step.join(step.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component")).checkpoint()
        if jump.join(label.withColumnRenamed("component", "old"), "id").filter("component <> old").limit(1).count() == 0:
            return jump
        label = jump
