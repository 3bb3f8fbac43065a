"""Autocorrelations by transforms of blocks against the transform of the whole series."""

import numpy as np
import pandas as pd
import pytest

from tidewater.functions import special
from tidewater.operators import series


def whole(x, max_lag):
    x = np.asarray(x, float) - np.mean(x)
    out = np.zeros(max_lag + 1)
    for k in range(min(max_lag + 1, len(x))):
        out[k] = x[k:] @ x[: len(x) - k]
    return out / out[0] if np.ptp(x) > 0 else np.eye(1, max_lag + 1)[0]


@pytest.mark.parametrize("block_rows", [64, 65_536])
@pytest.mark.parametrize("max_lag", [3, 48, 200])
def test_blocks_give_the_correlations_of_the_whole_series(spark, block_rows, max_lag):
    rng = np.random.default_rng(6)
    made = {"walk": np.cumsum(rng.normal(size=1000)), "noise": rng.normal(size=129) + 1e3, "short": rng.normal(size=5), "flat": np.full(300, 0.1), "one": np.ones(1)}
    # Places start anywhere and have gaps; only their order counts.
    rows = [(name, 1000 + 3 * i, float(v)) for name, x in made.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series string, idx long, x double").repartition(3)
    got = series.acf_fft(df, max_lag, block_rows=block_rows).toPandas().sort_values(["series", "lag"])
    for name, x in made.items():
        part = got[got["series"] == name]
        assert part["lag"].tolist() == list(range(max_lag + 1)) and set(part["n"]) == {len(x)}
        assert np.allclose(part["acf"], whole(x, max_lag), atol=1e-9), name


def test_no_task_is_given_the_whole_series(spark, monkeypatch, tmp_path):
    """acf_fft: no call has more than a block and the lags before it."""
    plain = special.lag_sums

    def lag_sums(own, seen, max_lag):
        (tmp_path / f"{id(seen)}-{np.random.default_rng().integers(1 << 60)}").write_text(str(len(seen)))
        return plain(own, seen, max_lag)

    monkeypatch.setattr(series, "special", type("S", (), {"lag_sums": staticmethod(lag_sums)}))
    df = spark.createDataFrame(pd.DataFrame({"series": "a", "idx": range(5000), "x": np.random.default_rng(1).normal(size=5000)}))
    assert series.acf_fft(df, 10, block_rows=500).count() == 11
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert len(sizes) >= 10 and max(sizes) == 510
