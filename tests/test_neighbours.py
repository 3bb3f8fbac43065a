"""The pivot index and the grid of near pairs against brute force."""

import numpy as np
import pytest

from tidewater.operators import forecast, neighbours


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 6)) * 20
    points = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6))
    points[700:720] = points[700]  # ties
    rows = [(i, p.tolist(), float(i % 7)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "idx long, vec array<double>, target double").repartition(4).cache()


def test_index_gives_the_rows_of_the_plain_search(clustered):
    index = neighbours.pivot_index(clustered, pivots=60, leaf_rows=50)
    asked = clustered.filter("idx % 7 = 0")
    want = sorted(map(tuple, forecast.causal_neighbours(asked, clustered, 5, 10, 3, block_rows=1000).collect()))
    got = sorted(map(tuple, neighbours.indexed_neighbours(asked, index, 5, 10, 3).collect()))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_index_takes_under_a_fifth_of_the_distances(clustered):
    index = neighbours.pivot_index(clustered, pivots=60, leaf_rows=50)
    asked = clustered.filter("idx > 2000 AND idx % 7 = 0")
    brute = sum(max(0, r["idx"] - 3 + 1) for r in asked.select("idx").collect())
    assert neighbours.distances_taken(asked, index, 5, 10, 3) < brute / 5


def test_index_with_few_rows_and_none(spark, clustered):
    few = clustered.filter("idx < 4")
    got = neighbours.indexed_neighbours(few, neighbours.pivot_index(few), 3, 0, 1).collect()
    assert sorted((r["query_idx"], r["cand_idx"]) for r in got) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    none = clustered.limit(0)
    assert neighbours.indexed_neighbours(clustered, neighbours.pivot_index(none), 3, 0, 1).count() == 0


@pytest.mark.parametrize("eps", [0.07, 0.5, 2.5, 1000.0])
def test_near_pairs_equal_brute_force(spark, eps):
    rng = np.random.default_rng(9)
    x = np.concatenate([np.round(rng.normal(size=900) * 5, 2), np.full(300, 1.25), [-40.0, 77.7]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    want = int((np.abs(x[:, None] - x[None, :]) <= eps).sum())
    got = neighbours.near_pairs(df, eps)
    assert tuple(got.first()) == (len(x), want, want / len(x) ** 2)


def test_near_pairs_of_nothing_and_bad_eps(spark):
    assert neighbours.near_pairs(spark.createDataFrame([], "x double"), 1.0).first()["n"] == 0
    with pytest.raises(ValueError):
        neighbours.near_pairs(spark.createDataFrame([(1.0,)], "x double"), 0.0)


def test_epsilon_of_a_rate_is_that_of_the_plain_bisection(spark):
    from tidewater.operators import dynamics

    rng = np.random.default_rng(12)
    series = {"normal": rng.standard_normal(5000), "steps": rng.integers(0, 9, 4000).astype(float), "hot": np.where(rng.random(3000) < 0.34, 1.5, rng.standard_normal(3000) ** 3)}
    for name, x in series.items():
        want, rate = dynamics.recurrence_epsilon((x - x.mean()) / x.std(ddof=1))
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
        for block_rows in (100_000, 64):
            got = neighbours.epsilon_of_rate(df, block_rows=block_rows).first()
            assert got["n"] == len(x) and got["epsilon"] == pytest.approx(want, rel=1e-9), (name, block_rows)
            assert abs(got["rate"] - rate) <= 2 * len(x) / len(x) ** 2 or name == "steps"
            assert got["rate"] >= 0.05 - 1e-3
    assert tuple(neighbours.epsilon_of_rate(df.filter("false")).first())[:1] == (0,)
    flat = neighbours.epsilon_of_rate(spark.createDataFrame([(2.0,)] * 5, "x double")).first()
    assert (flat["n"], flat["epsilon"], flat["rate"]) == (5, 0.0, 1.0)


def test_blocks_settle_most_bisections(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in rng.standard_normal(6000)], "x double").cache()
    jobs = []
    plain = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: (jobs.append(1), plain(self, *a, **k))[1])
    neighbours.epsilon_of_rate(df, block_rows=100)
    df.unpersist()
    assert len(jobs) <= 1 + 10 + 1  # dealing, at most ten rounds of five bisections, the rate at the end


def test_tiles_give_the_dense_statistic(spark):
    from tidewater.operators import dynamics

    rng = np.random.default_rng(21)
    series = {"noise": rng.standard_normal(230), "walk": np.cumsum(rng.standard_normal(101)), "flat": np.ones(40), "ties": rng.integers(0, 4, 64).astype(float)}
    df = spark.createDataFrame([(k, 1000 + i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "window string, idx long, x double").repartition(3)
    for tile in (32, 1024):
        got = {(r["window"], r["dim"], r["factor"]): r for r in dynamics.bds_by(df, [2, 3, 5], [0.5, 1.0], tile=tile).collect()}
        assert len(got) == 4 * 3 * 2
        for name, x in series.items():
            for want in dynamics.bds(x, [2, 3, 5], [0.5, 1.0]):
                row = got[name, want["dim"], want["factor"]]
                for c in ("c1", "cm", "k", "variance", "statistic", "p_value"):
                    assert (None if np.isnan(want[c]) else pytest.approx(want[c], rel=1e-9, abs=1e-12)) == row[c], (tile, name, c)
    with pytest.raises(ValueError, match="dimension 6"):
        dynamics.bds_by(df.filter("idx < 1005"), [6], [1.0])
