"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is an aggregation (combined before the shuffle) and a join on the node id, so
a hub with very many links is a hot join key that adaptive execution may split; no
component is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.lineage import stored


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node join the node's least neighbour; small star: those below do."""
    near = _both(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
    return out.filter("a <> b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100, rows: int | None = None) -> DataFrame:
    """(id, component) of every node that has a link to another one; component is the least id of the node's component.

    Nulls and loops are no links; an empty table gives no rows. `rows` is about the number of links, if known.
    """
    now = stored(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows=rows)
    rows, seal = now.count(), None
    for _ in range(most_rounds):
        now = stored(_star(_star(now, True), False), instead_of=now, rows=rows)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == seal:
            break
        rows, seal = row[0], tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
