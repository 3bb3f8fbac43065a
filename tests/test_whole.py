"""Queries cover their whole input, or the sizes of the published run."""

from pathlib import Path

import pytest

from tidewater import registry
from tidewater.plans import inputs as I

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: registry.queries()[name](spark, SF)


def test_dynamics_take_every_delay_vector(spark, run):
    n = I.daily(spark, SF).count() - 3
    pairs = (n - 10) * (n - 11) // 2
    assert 200 < n < 2500
    assert run("nearest_neighbours_all").count() == n
    assert run("pair_distances_all").count() == pairs
    assert {r["pairs"] for r in run("correlation_sums_all").collect()} == {pairs}
    assert {r["k"]: r["pairs"] for r in run("divergence_curve_all").collect()}[0] == n
    assert run("lyapunov_slope_all").first()["points"] == 6


def test_correlation_dimension_is_that_of_every_pair(spark, run):
    from tidewater.operators import dynamics, embedding

    whole = embedding.delay_embedding(I.daily(spark, SF).select("idx", "x"), 3, 2, "x")
    d = dynamics.pair_distances(whole, 10)
    want = dynamics.correlation_dimension(dynamics.correlation_sums(d, dynamics.radii(d, 24))).first()
    got = run("correlation_dimension").first()
    assert got["d2"] == pytest.approx(want["d2"], rel=1e-9) and got["points"] == want["points"]


def test_false_neighbours_and_surrogates_have_the_published_sizes(spark, run):
    from tidewater.plans.phases import Settings

    o, n = Settings(), I.series(spark, SF).count()
    rows = run("fnn_and_cao").collect()
    assert {r["dim"] for r in rows} == set(range(1, o.max_dim + 1))
    assert all(r["valid"] == min(o.fnn_sample, n - 3 * (o.max_dim + 1)) for r in rows)
    made = {(r["kind"], r["n_success"] + r["n_failures"]) for r in run("surrogate_replicates").collect()}
    assert made == set(zip(("shuffled", "phase", "aaft"), o.surrogate_counts, strict=True)) == {("shuffled", 50), ("phase", 39), ("aaft", 39)}


def test_thresholds_and_steps_are_the_published_ones():
    import numpy as np

    from tidewater.operators import embedding
    from tidewater.plans.phases import Settings

    o = Settings()
    assert (o.fnn_rtol, o.fnn_threshold, o.max_dim, o.lyap_steps, o.radii, o.k_grid, o.seed) == (10.0, 0.05, 15, 60, 32, (2, 3, 5, 10, 20, 50), 20260602)
    z = np.random.default_rng(1).standard_normal(600)
    places = np.arange(2, 600)
    who, d = embedding.nearest(z[places, None], places, 1)
    delta = np.abs(z[places - 1] - z[places[who] - 1])
    wrong = lambda r: int(((delta / np.maximum(d, 1e-12) > r) | (np.hypot(d, delta) / z.std(ddof=1) > 2)).sum())
    assert wrong(10) != wrong(15)
    assert embedding.false_neighbours(z, 1, 1, 10**6, 1, dims=[1])[0]["false"] == wrong(10)


def test_known_mean_takes_every_row_before_the_test(spark, run):
    from tidewater.operators import candles
    from tidewater.plans import forecast_queries as Q

    close = [r["close"] for r in I.bars(spark, SF).orderBy("idx").collect()]
    first = candles.split(I.bars(spark, SF), Q.TRAIN_END, Q.VALIDATION_END).filter("split = 'test'").agg({"idx": "min"}).first()[0]
    known = [close[i + 12] for i in range(len(close) - 12) if i + 12 <= first]
    r = run("known_mean_before_test").first()
    assert len(known) > 500 and r["n"] == len(known) and r["historical_mean"] == pytest.approx(sum(known) / len(known), abs=1e-6)


def test_the_choice_of_k_takes_every_vector_as_a_query(spark, run):
    import numpy as np

    rows = sorted(map(tuple, I.vectors(spark, SF).collect()))
    at, x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    errors = {k: [] for k in (1, 3, 10)}
    for i, now in enumerate(at):
        known = np.flatnonzero((at + 12 <= now) & (np.abs(at - now) > 20))
        near = known[np.argsort(((x[known] - x[i]) ** 2).sum(1), kind="stable")]
        for k in errors if len(near) else ():
            errors[k].append(y[near[:k]].mean() - y[i])
    assert {len(e) for e in errors.values()} == {len(at) - 21}
    rmse = {k: float(np.sqrt(np.mean(np.square(e)))) for k, e in errors.items()}
    got = run("knn_selection").first()
    assert got["k"] == min(rmse, key=lambda k: (rmse[k], k)) and got["rmse"] == pytest.approx(rmse[got["k"]], abs=1e-7)


def test_of_errors_that_round_alike_the_least_k_is_chosen(spark, tmp_path):
    import duckdb

    # three neighbours of 0.7 have a mean a bit below 0.7, so the error of k = 3 is less in its last digits
    rows = [(i, [float(i)], 0.7 if i < 21 else 0.5) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["knn_selection"]).fetchall()
    assert [tuple(r) for r in registry.queries()["knn_selection"](spark, str(tmp_path)).collect()] == want == [(1, 0.2)]


def test_logistic_map_gives_all_three_series(run):
    from tidewater.sources import synthetic

    rows = run("logistic_map_all").collect()
    want = {(name, i, x) for name, (values, _) in synthetic.bundle().items() for i, x in enumerate(values)}
    assert len(rows) == 33_000 and {tuple(r) for r in rows} == want and {r["series"] for r in rows} == {"clean", "small_noise", "moderate_noise"}


def test_false_neighbours_equal_plain_loops(spark):
    import math
    import random
    import statistics

    from tidewater.operators import embedding
    from tidewater.operators.ordering import evenly_spaced

    rng = random.Random(3)
    z = [math.sin(i / 3) + 0.2 * rng.gauss(0, 1) for i in range(400)]
    tau, top, size, apart, rtol, atol = 2, 3, 90, 4, 10.0, 2.0
    df = spark.createDataFrame(list(enumerate(z)), "idx bigint, z double")
    got = {r["dim"]: r for r in embedding.fnn_and_cao(df, tau, top, size, apart, rtol, atol).collect()}
    first, sigma, e, star = (top + 1) * tau, statistics.stdev(z), {}, {}
    places = evenly_spaced(len(z) - first, size, first)
    for m in range(1, top + 2):
        false, ups, moves = 0, [], []
        for p in places:
            d, q = min((math.dist([z[p - k * tau] for k in range(m)], [z[q - k * tau] for k in range(m)]), q) for q in places if abs(p - q) > apart)
            move = abs(z[p - m * tau] - z[q - m * tau])
            up = math.hypot(d, move)
            false += move / d > rtol or up / sigma > atol
            ups.append(up / d)
            moves.append(move)
        e[m], star[m] = statistics.fmean(ups), statistics.fmean(moves)
        if m <= top:
            assert (got[m]["false"], got[m]["valid"]) == (false, size)
    for m in range(1, top + 1):
        assert got[m]["E1"] == pytest.approx(e[m + 1] / e[m], rel=1e-9) and got[m]["E2"] == pytest.approx(star[m + 1] / star[m], rel=1e-9)


def test_the_elbow_of_a_flat_curve_is_the_first_lag():
    from tidewater.operators import embedding

    assert embedding.tau_from_ami([0.5] * 20) == 1
