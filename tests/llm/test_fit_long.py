"""Budgets of long texts are fitted to the word."""

import numpy as np
import pytest

from millrace.llm import mixing


@pytest.mark.parametrize(
    ("lengths", "counts", "budget", "want"),
    [
        ([90_000], [2], 90_000, 90_000),
        ([70_000, 100_000], [2, 1], 140_000, 140_000),
        ([1_000, 250_000], [3, 9], 753_000, 753_000),
        ([31_000, 31_007, 90_001], [3, 3, 3], 152_008, 152_008),
    ],
)
def test_fit_long(lengths, counts, budget, want):
    lengths, counts = np.array(lengths), np.array(counts)
    take = mixing.fit(lengths, counts, budget, 1)
    assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == want


def test_mix_long(spark):
    docs = spark.createDataFrame([(1, "w " * 90_000, "a"), (2, "w " * 90_000, "a")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert got[0].target == 270_000 and sum(r.taken for r in got) == 270_000
