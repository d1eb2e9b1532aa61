"""Items of more tokens than one similarity matrix may hold."""

import inspect
import math

import numpy as np
import pytest

from __spark_entry__ import queries
from framewright.functions import compress as cp
from framewright.operators import media


def test_blocks_find_what_the_whole_matrix_finds(monkeypatch):
    r = np.random.default_rng(1)
    for n, tau, eps in ((150, 0.32, None), (150, 0.32, 0.05), (400, 0.35, 0.3), (400, 0.5, 0.3), (400, 0.5, None), (1, 0.5, 0.05)):
        x = r.normal(size=(n, 16))
        x[:: max(n // 3, 2)] = 0
        adj = cp.adjacency(x, tau)
        want = cp.components(adj)
        if eps:
            for c, group in enumerate(cp.sampled_components(adj, eps)):
                want[group] = c
        whole = cp.merge_back(x[:7], x)
        monkeypatch.setattr(cp, "BLOCK", 3 * n)
        assert (cp.token_labels(x, tau, eps) == want).all() and (cp.degrees(x, tau) == adj.sum(axis=1)).all()
        assert np.allclose(cp.merge_back(x[:7], x), whole)


@pytest.mark.parametrize("eps", [None, 0.05])
def test_large_items_are_compressed_too(spark, eps):
    n = 8200
    d = spark.range(n).selectExpr("1L AS item", "cast(id AS int) AS token_idx", "array(cos(id % 100), sin(id % 100)) AS embedding")
    assert media.compress_tokens(d, tau=0.99999, ratio=0.3, eps=eps).count() == math.ceil(n * 0.3)
    assert media.token_components(d, tau=0.99999, eps=eps).select("component").distinct().count() < 101


def test_exact_sizes_need_no_query_vector_and_count_missing_vectors(spark, tmp_path):
    """SQL counts every row of ``embeddings``: without a vec_id 0 nothing was returned, and a null vector stopped the job."""
    rows = [(5 + k, None if k % 11 == 3 else [float(k % 7), 1.0, float(k % 5)], None if k % 4 == 3 else k % 4) for k in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("c6_compress_exact", "c3_compress_sampled"):
        assert sorted((r.video if r.video is not None else -1, r.centers) for r in queries()[name](spark, str(tmp_path)).collect()) == [(k, math.ceil(30 * 0.3)) for k in (-1, 0, 1, 2)]


def test_no_size_leaves_an_item_as_it_is():
    for operator in (media.compress_tokens, media.token_components):
        assert "limit" not in inspect.signature(operator).parameters
