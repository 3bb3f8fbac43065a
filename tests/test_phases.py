"""All phases on made-up candles: shapes, guards and no look ahead."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewater.plans import phases as P
from tidewater.sources import sinks

OPTIONS = P.Settings(
    train_end="2024-01-08 12:00:00", validation_end="2024-01-10 00:00:00", acf_lags=60, direct_lags=24, squared_marks=(12, 24), shuffle_lags=(1, 12), max_order=6, recurrence_width=300, test_width=300, ami_lags=12, ami_bins=8,
    max_dim=4, fnn_sample=200, corr_sample=120, radii=12, lyap_block=200, lyap_steps=10, lyap_fit=(1, 8), orders=(3, 4), surrogate_window=256, surrogate_counts=(3, 2, 2), queries=60, k_grid=(1, 5),
)


@pytest.fixture(scope="module")
def rows(spark):
    rng, level, vol, out = random.Random(3), 100.0, 0.001, []
    for i in range(3500):
        vol = math.exp(0.95 * math.log(vol) + 0.05 * math.log(0.001) + 0.1 * rng.gauss(0, 1))
        new = level * math.exp(rng.gauss(0, vol))
        out.append((1704067200 + 300 * i, level, max(level, new) * 1.0001, min(level, new) * 0.9999, new, 1.0 + rng.random(), rng.randrange(1, 50), rng.random()))
        level = new
    df = spark.createDataFrame(out, "s long, open double, high double, low double, close double, volume double, trades long, taker_buy_quote double")
    return P.indexed(df.withColumn("open_time", F.timestamp_seconds("s")).drop("s")).cache()


@pytest.fixture(scope="module")
def features(rows):
    return P.phase1(rows)[0].cache()


def filled(tables):
    for name, df in tables.items():
        assert df.count() > 0, name
    return tables


def test_quality_and_features(spark, rows, features):
    q = {r["check_name"]: r for r in P.phase0(rows)["phase0_quality_summary"].collect()}
    assert all(r["passed"] for r in q.values()) and q["rows"]["value"] == 3500
    t = filled(P.phase1(rows)[1])
    s = t["phase1_shape_summary"].first()
    assert (s["rows_in"], s["rows_out"], s["dropped_start"], s["dropped_end"]) == (3500, 3500 - 288 - 48, 288, 48)
    with pytest.raises(ValueError, match="positive"):
        P.phase1(rows.withColumn("open", F.lit(0.0)))
    with pytest.raises(ValueError, match="no row"):
        P.phase1(rows.filter("idx < 100"))


def test_descriptive_phases(features):
    filled(P.phase2(features))
    filled(P.phase3(features, OPTIONS, ("close", "r")))
    filled(P.phase4(features, OPTIONS, ("r", P.MAIN)))


def test_filter_and_nonlinearity(features, tmp_path):
    five = filled(P.phase5(features, OPTIONS))
    windows = five["phase5_selected_windows"].cache()
    left, coefficients, tables = P.phase6(features, windows, OPTIONS)
    filled({k: v for k, v in tables.items() if "recurrence" not in k})
    filled(P.phase7(left, windows, len(coefficients), OPTIONS))
    for wrong in ({"test_width": 5000}, {"squared_marks": (12, 48)}, {"arch_lags": (1, 25)}, {"shuffle_lags": (1, 300)}):
        with pytest.raises(ValueError):
            P.phase7(left, windows, len(coefficients), replace(OPTIONS, **wrong))
    with pytest.raises(ValueError, match="order 900"):
        P.phase6(features, windows, replace(OPTIONS, max_order=900))
    with pytest.raises(ValueError, match="surrogate window"):
        P.phase10(features, {"tau": 3, "dim": 3, "theiler": 9}, replace(OPTIONS, surrogate_window=4096))
    sinks.write_bundle({"w": windows}, str(tmp_path))
    assert left.sparkSession.read.option("header", True).csv(f"{tmp_path}/w.csv").count() == 4


def test_state_space(features):
    chosen, tables = P.phase8(features, OPTIONS)
    filled(tables)
    assert chosen["tau"] >= 1 and 2 <= chosen["dim"] <= 4
    small = {"tau": 2, "dim": 2, "theiler": 4}
    filled(P.phase9(features, small, OPTIONS))
    filled(P.phase10(features, small, OPTIONS, corr_sample=60, block=150, references=30, steps=6, fit=(1, 5)))


def test_forecasts_do_not_look_ahead(features):
    small = {"tau": 2, "dim": 2, "theiler": 4}
    t = filled(P.phase11(features, small, [0.5, 0.2], OPTIONS))
    assert t["phase11_alignment"].first()["max_abs_diff"] == 0.0
    rows = P.embedded(features, small, OPTIONS)
    from tidewater.operators import forecast

    found = forecast.causal_neighbours(rows.filter("idx % 50 = 0"), rows, 5, 4, 12, block_rows=500)
    assert found.filter("cand_idx + 12 > query_idx OR abs(cand_idx - query_idx) <= 4").count() == 0
    one = forecast.causal_neighbours(rows.filter("idx % 50 = 0"), rows, 5, 4, 12)
    assert found.exceptAll(one).count() == 0 and one.exceptAll(found).count() == 0
    filled(P.phase12(features, [small, {"tau": 1, "dim": 3, "theiler": 9}], [0.5], OPTIONS))


def test_model_export(features):
    artifact, tables = P.phase14(features, OPTIONS, recent_rows=600)
    filled(tables)
    from tidewater.operators import forecast

    assert len(forecast.model_of(artifact)["coefficient_vector"]) == 3


def test_control(spark):
    t = P.phase13(spark, P.Settings(max_dim=3, fnn_sample=150, ami_lags=12), total=2600, burn_in=600)
    assert filled(t)["phase13_lyapunov_summary"].count() == 3


def test_export_is_compared_on_both_samples(features):
    import numpy as np

    p = {"tau": 5, "dim": 2, "theiler": 10}
    _, t = P.phase14(features, OPTIONS, recent_rows=600, p=p, k=20)
    rows = {(r["split"], r["model"]): r for r in t["phase14_test_metrics"].collect()}
    (ar,) = {m for _, m in rows if m.startswith("ar")}
    four = {"har_logrv_compact", "persistence", "historical_mean", ar}
    sample = "test_knn_comparable_sample"
    assert set(rows) == {("test_full", m) for m in four} | {(sample, m) for m in four | {"knn_tau5_m2_k20"}}
    assert {r["n"] for (s, _), r in rows.items() if s == sample} == {60}
    assert {r["model"] for r in t["phase14_validation_metrics"].collect()} == four
    vectors = P.embedded(features, p, OPTIONS).orderBy("idx").collect()
    library = [v for v in vectors if v["split"] != "test"]
    test = [v for v in vectors if v["split"] == "test"]
    x, at, y = np.array([v["vec"] for v in library]), np.array([v["idx"] for v in library]), np.array([v["target"] for v in library])
    errors = []
    for i in range(60):
        q = test[round((len(test) - 1) * i / 59)]
        d = ((x - np.array(q["vec"])) ** 2).sum(axis=1)
        d[(at + 12 > q["idx"]) | (abs(at - q["idx"]) <= 10)] = np.inf
        errors.append(y[np.lexsort((at, d))[:20]].mean() - q["target"])
    assert rows[sample, "knn_tau5_m2_k20"]["rmse"] == pytest.approx(float(np.sqrt(np.mean(np.square(errors)))), rel=1e-9)
    assert t["phase14_model_comparison"].count() == 5
