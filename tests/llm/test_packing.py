"""Packing of odd lengths against all choices of bounds."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.llm import packing


def least_padding(lengths, buckets):
    sizes = np.maximum(lengths, 1)
    own = np.unique(sizes)
    choices = (np.array([*chosen, own[-1]]) for k in range(min(buckets, len(own))) for chosen in combinations(own[:-1].tolist(), k))
    return min(int((edges[np.searchsorted(edges, sizes)] - lengths).sum()) for edges in choices)


@pytest.mark.parametrize("lengths", [[9] * 20, [0, 0, 1, 3, 3, 9, 11, 13, 13, 27, 9_001, 9_003, 9_077]])
def test_pack_has_the_least_padding(spark, lengths):
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    out = packing.pack(docs, F.col("n"), buckets=4, budget=20_000).toPandas()
    assert out.padding.sum() == least_padding(np.array(lengths), 4)


def test_bounds_by_halves_are_the_best():
    rng = np.random.default_rng(5)
    for buckets in (1, 2, 3, 5):
        for _ in range(20):
            lengths = np.sort(rng.choice(np.arange(1, 60), size=9, replace=False))
            counts = rng.integers(1, 50, 9)
            found = np.array(packing.bounds(lengths, counts, buckets))
            assert len(found) <= buckets and ((found[np.searchsorted(found, lengths)] - lengths) * counts).sum() == least_padding(np.repeat(lengths, counts), buckets)
