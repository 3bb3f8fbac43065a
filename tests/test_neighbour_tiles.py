"""Neighbour searches in tiles: products first, exact distances last, bounded tasks."""

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import forecast, neighbours


def plain(q, now, x, at, k, theiler, horizon):
    out = []
    for i, v in enumerate(q):
        d = neighbours.squares(v[None], x)[0]
        known = np.flatnonzero((at + horizon <= now[i]) & (np.abs(at - now[i]) > theiler))
        out += [(int(now[i]), int(at[j]), float(d[j])) for j in known[np.lexsort((at[known], d[known]))][:k]]
    return sorted(out)


def kinds(n=700):
    rng = np.random.default_rng(8)
    wide = rng.normal(size=(n, 12))
    yield "random", wide
    yield "far away", wide * 1e-3 + 1e4
    yield "one very common", np.where(rng.random((n, 1)) < 0.4, 0.5, wide)
    yield "all equal", np.ones((n, 3))
    yield "bits", rng.integers(0, 2, (n, 9)).astype(float)  # ties of different vectors


@pytest.mark.parametrize("name,x", list(kinds()), ids=[n for n, _ in kinds()])
@pytest.mark.parametrize("horizon", [12, 0, -40])
def test_products_give_the_rows_of_plain_distances(monkeypatch, name, x, horizon):
    monkeypatch.setattr(neighbours, "STRIP", 64)
    monkeypatch.setattr(neighbours, "CHUNK", 32)
    monkeypatch.setattr(neighbours, "MOST_PAIRS", 500)
    at = np.random.default_rng(2).permutation(len(x))
    want = plain(x[::5], at[::5], x, at, 6, 20, horizon)
    pivots = x[:8]
    cell = neighbours.squares(x, pivots).argmin(1)
    for args in ((), (pivots, cell)):
        r, c, d, taken = neighbours.nearest_known(x[::5], at[::5], x, at, 6, 20, horizon, *args)
        assert sorted(zip(at[::5][r].tolist(), at[c].tolist(), d.tolist(), strict=True)) == want
        assert 0 < taken <= len(x[::5]) * len(x)


def test_unusable_vectors_are_nobodys_neighbours():
    x = np.array([[0.0], [np.nan], [1.0], [np.inf], [3.0]])
    r, c, d, _ = neighbours.nearest_known(x, np.arange(5), x, np.arange(5), 9, 0, 1)
    assert sorted(zip(r.tolist(), c.tolist(), d.tolist(), strict=True)) == [(2, 0, 1.0), (4, 0, 9.0), (4, 2, 4.0)]


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(5).normal(size=(3000, 16))  # nothing to prune: every leaf stays open
    rows = [(i, v.tolist(), float(i % 5)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "idx long, vec array<double>, target double").repartition(4).cache()


def test_a_search_has_a_task_a_pair_of_blocks(vectors):
    """knn_topk and its kin: the shuffle's setting doesn't put many pairs of blocks into one task."""
    found = forecast.causal_neighbours(vectors, vectors, 3, 5, 2, block_rows=300, query_rows=250)
    before = vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")
    asked = neighbours.query_blocks(vectors, 250)
    blocks = vectors.selectExpr("idx DIV 300 AS b", "idx AS i", "vec AS v", "target AS t")
    low = blocks.groupBy("b").agg({"i": "min"}).withColumnRenamed("min(i)", "low")
    tiles = neighbours.tiled(asked, blocks, low, 2, lambda left, right: pd.DataFrame({"l": [len(left)], "r": [len(right)]}), "l long, r long")
    pairs = sum(300 * b + 2 <= 250 * q + 249 for b in range(10) for q in range(12))
    assert pairs > int(before) and tiles.rdd.getNumPartitions() == pairs
    sizes = [r for r in tiles.collect() if r["l"] and r["r"]]
    assert len(sizes) == pairs and max(r["l"] for r in sizes) == 250 and max(r["r"] for r in sizes) == 300
    whole = forecast.causal_neighbours(vectors, vectors, 3, 5, 2)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_an_open_index_sends_no_row_a_query_and_leaf(vectors, monkeypatch):
    """knn_indexed: vectors that no bound prunes travel once a bundle of leaves, not once a leaf."""
    index = neighbours.pivot_index(vectors, pivots=20, leaf_rows=50)
    bundles = len({leaf // 20 for leaf in index.leaves["leaf"]})
    assert bundles == 3 and len(index.leaves) == 60
    sent = []
    kept = neighbours.tiled

    def spy(asked, library, low, horizon, run, schema):
        tiles = kept(asked, library, low, horizon, lambda left, right: pd.DataFrame({"l": [len(left)]}), "l long")
        sent.append(tiles.agg({"l": "sum"}).first()[0])
        return kept(asked, library, low, horizon, run, schema)

    monkeypatch.setattr(neighbours, "tiled", spy)
    got = sorted(map(tuple, neighbours.indexed_neighbours(vectors, index, 4, 5, 2, query_rows=500).collect()))
    assert sent[0] <= bundles * 3000
    assert got == sorted(map(tuple, forecast.causal_neighbours(vectors, vectors, 4, 5, 2).collect()))
