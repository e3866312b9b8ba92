"""Every registered query with SQL gives the rows of its SQL; the others give rows."""

import pytest

from quern.plans import catalog
from tests.oracle import SMALL, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["distance_cosine", "distance_euclidean"])
def test_every_vector_asks_for_distances(spark, name):
    n = spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    assert catalog.QUERIES[name](spark, SMALL).count() == n * (n - 1)
