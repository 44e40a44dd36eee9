"""Ids that stand in rows with unlike texts, in the SimHash stage."""

import numpy as np

from loomgrid.llm import stages


def test_every_group_keeps_a_row(spark):
    rng = np.random.default_rng(8)
    unlike = [" ".join(f"v{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(24)]
    hot = [(5, t, "a") for t in unlike[:20]]  # one id, twenty groups
    rows = [*hot, (5, unlike[0], "b"), (9, unlike[1], "a"), (3, unlike[20], "a"), (3, unlike[20], "a"), (7, unlike[20], "a"), (7, unlike[21], "a"), (8, unlike[22], "a"), (None, unlike[22], "a"), (None, unlike[23], "a"), (None, unlike[23], "b")]
    kept = stages.keep_one_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = [*hot, (3, unlike[20], "a"), (7, unlike[21], "a"), (8, unlike[22], "a"), (None, unlike[23], "a")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)
