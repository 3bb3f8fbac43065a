"""The synthetic control, whose published results need no other data."""

import numpy as np
import pytest

from tidewater.functions import special
from tidewater.operators import dynamics, embedding, forecast
from tidewater.plans import inputs  # noqa: F401
from tidewater.sources import synthetic


@pytest.fixture(scope="module")
def control(spark):
    return synthetic.bundle(), synthetic.series(spark).cache()


def test_noise_is_cut_as_published(control):
    assert len(control[0]["clean"][0]) == 11_000 and control[0]["small_noise"][1] == 371


def test_tau_of_the_clean_series(spark, control):
    clean = control[1].filter("series = 'clean'").select("idx", "x")
    train = clean.filter("idx < 6600")
    rows = embedding.mutual_information(embedding.discretised(train, 32), list(range(1, 31))).orderBy("tau").collect()
    assert embedding.tau_operational([r["ami"] for r in rows]) == 9


def test_forecasts_of_the_clean_series(spark, control):
    x = np.array(control[0]["clean"][0])
    n, tau, dim = len(x), 9, 5
    train_end, val_end = int(n * 0.6), int(n * 0.8)
    z = (x - x[:train_end].mean()) / x[:train_end].std(ddof=1)
    rows = [(i, [float(z[i - k * tau]) for k in range(dim)], float(x[i + 1]), float(x[i])) for i in range((dim - 1) * tau, n - 1)]
    df = spark.createDataFrame(rows, "idx long, vec array<double>, target double, x double").cache()
    queries = df.filter(f"idx >= {val_end}")
    assert queries.count() == 2199
    found = forecast.causal_neighbours(queries, df.filter(f"idx < {val_end}"), 5, tau * dim, 1).cache()
    truth = queries.selectExpr("idx AS query_idx", "target AS y", "x")
    rmse = lambda p: forecast.metrics(p.join(truth, "query_idx"), [], 0.0).first()["rmse"]
    assert rmse(forecast.neighbour_means(found, [5])) == pytest.approx(0.0981668957191, rel=1e-9)
    assert rmse(forecast.nearest_target(found)) == pytest.approx(0.127246950581, rel=1e-9)
    assert forecast.metrics(truth.withColumnRenamed("x", "prediction"), [], 0.0).first()["rmse"] == pytest.approx(0.499398850784, rel=1e-9)


def test_divergence_of_small_map_is_ln_two():
    x = np.array(synthetic.logistic_map(total=2500, burn_in=500))
    curve = dynamics.rosenstein(x, 1, 2, 5, 6)
    slope = special.line([r["k"] for r in curve[:6]], [r["mean_log_distance"] for r in curve[:6]])[0]
    assert slope == pytest.approx(np.log(2), abs=0.06)


def test_forecasts_of_the_control_as_published(spark):
    from tidewater.plans import phases

    t = phases.phase13(spark)
    made = {(r["series_name"], r["model"]): r for r in t["phase13_prediction_metrics"].collect()}
    published = {  # rmse of mean (and AR(0)), persistence, nearest, 5 neighbours
        "clean": (0.356522571238, 0.499398850784, 0.127246950581, 0.0981668957191),
        "small_noise": (0.356394767046, 0.49933641713, 0.179361478424, 0.130100736893),
        "moderate_noise": (0.355751018403, 0.498454543108, 0.139848614088, 0.107455493936),
    }
    for name, (mean, last, nearest, five) in published.items():
        for model, rmse in (("historical_mean", mean), ("ar_bic", mean), ("persistence", last), ("nearest_neighbor", nearest), ("knn_mean_k5", five)):
            r = made[name, model]
            assert r["n"] == 2199 and r["rmse"] == pytest.approx(rmse, rel=1e-9), (name, model)
        assert made[name, "ar_bic"]["ar_order"] == 0
    grid = {(r["series_name"], r["k"]): r for r in t["phase13_validation_k_selection"].collect()}
    assert grid["clean", 1]["n"] == 2200 and grid["clean", 1]["rmse"] == pytest.approx(0.135681851472, rel=1e-9) and len(grid) == 21
    orders = {r["p"]: r for r in t["phase13_ar_order_selection"].filter("series_name = 'clean'").collect()}
    assert len(orders) == 101 and orders[32]["bic"] == pytest.approx(263.523019603, rel=1e-9) and orders[0]["bic"] == pytest.approx(7.79474916279, rel=1e-9)
    chosen = {r["series_name"]: (r["tau_selected"], r["m_fnn"], r["m_cao"], r["m_selected"]) for r in t["phase13_selected_embedding_params"].collect()}
    assert chosen == {"clean": (9, 5, 10, 5), "small_noise": (9, 6, 10, 6), "moderate_noise": (5, 5, 10, 5)}
