import io
import json
import zipfile

import numpy as np
import pytest

from tidewater.operators import candles, forecast
from tidewater.sources import readers, sinks
from tidewater.streaming.bars import stream_bars, stream_scores


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def line(t, price="1.5", trades="7"):
    return f"{t},{price},2,1,1.2,10,{t},5,{trades},1,2,0"


def test_archives_to_candles(spark, tmp_path):
    t = 1704067200000
    archive(tmp_path / "a.zip", {"b.csv": "\n".join([line(t), line(t + 300_000, "x"), line(t, "9.9")]), "z.csv": line(t + 900_000)})
    archive(tmp_path / "b.zip", {"c.csv": "\n".join([line((t + 600_000) * 1000), line("bad"), line("worse")])})
    archive(tmp_path / "c.zip", {"readme.txt": "no table"})
    (tmp_path / "d.zip").write_bytes(b"not an archive")
    raw = readers.read_zips(spark, str(tmp_path)).cache()
    assert {w["warning"].split(":")[0] for w in raw.filter("line IS NULL").collect()} == {"several csv", "no csv", "unreadable"}
    got = candles.clean_klines(raw.filter("line IS NOT NULL")).collect()
    assert [r["open"] for r in got] == [1.5, None, 1.5, 1.5] and [r["trades"] for r in got] == [7] * 4
    assert got[-1]["open_time"] is None and got[0].asDict().keys() == dict.fromkeys(candles.CANDLE_COLUMNS).keys()


def test_csv_round_trip_and_header_check(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS open_time, 1.5D AS open, 2D AS high, 1D AS low, 1/3D AS close, CAST(NULL AS DOUBLE) AS volume, 7L AS trades, 0D AS taker_buy_quote")
    sinks.write_csv(df, str(tmp_path / "c.csv"))
    back = readers.read_candles(spark, str(tmp_path / "c.csv")).first()
    assert back["close"] == 0.333333333333 and back["volume"] is None and back["trades"] == 7
    sinks.write_csv(df.drop("open"), str(tmp_path / "d.csv"))
    with pytest.raises(ValueError, match="expected the header"):
        readers.read_candles(spark, str(tmp_path / "d.csv"))
    with pytest.raises(ValueError, match="missing columns: nope"):
        readers.require(df, ["open", "nope"])
    sinks.write_csv(df.limit(0), str(tmp_path / "e.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e.csv")).count() == 0


def test_small_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"tau_selected": 9, "m_selected": 5, "theiler_window": 12}))
    assert readers.embedding_parameters(spark, str(tmp_path / "p.json")) == {"tau": 9, "dim": 5, "theiler": 45}
    assert readers.embedding_parameters(spark, str(tmp_path / "no.json"), fallback=True)["theiler"] == 685
    assert readers.read_table(spark, str(tmp_path / "no.csv"), "a int", optional=True).count() == 0
    assert readers.dense_coefficients(spark.createDataFrame([(2, 0.1), (1, 0.5)], "lag int, coefficient double")) == [0.5, 0.1]
    with pytest.raises(ValueError, match="holes"):
        readers.dense_coefficients(spark.createDataFrame([(3, 0.1), (1, 0.5)], "lag int, coefficient double"))
    pair = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01', 1D, 2D), (timestamp'2024-01-02', double('nan'), 2D), (timestamp'2024-01-03', 1D, double('inf')) AS t(open_time, log_rv_past_12, log_rv_future_12)")
    pair.write.parquet(str(tmp_path / "f.parquet"))
    assert readers.read_pair(spark, str(tmp_path / "f.parquet")).count() == 1


def test_sinks_for_arrays_and_json():
    data = sinks.npz_bytes(np.arange(6.0).reshape(3, 2), np.arange(3), {"tau": 2})
    with np.load(io.BytesIO(data)) as z:
        assert z["X"].shape == (3, 2) and z["indices"].dtype == np.int64
    assert json.loads(sinks.json_text({"a": float("nan"), "b": [1.0, float("inf")]})) == {"a": None, "b": [1.0, None]}


def test_model_artifact_round_trip():
    model = {"intercept": -1.0, "coefficient_vector": [0.5, 0.25, 0.1], "features": forecast.HAR_FEATURES, "target": forecast.HAR_TARGET, "n_train": 5, "ridge": 1e-8}
    text = forecast.artifact(model, "har", "1", "2024-01-01", {"rmse": float("nan")})
    assert json.loads(text)["metrics"]["rmse"] is None
    assert forecast.model_of(text)["coefficient_vector"] == [0.5, 0.25, 0.1]
    raw = json.loads(text)
    del raw["coefficient_vector"]
    assert forecast.model_of(json.dumps(raw))["coefficient_vector"] == [0.5, 0.25, 0.1]


def test_singular_regression_takes_the_ridge(spark):
    df = spark.createDataFrame([(float(i), float(i), 2.0 * i) for i in range(50)], "a double, b double, y double")
    model = forecast.fit_har(df, ["a", "b"], "y")
    assert sum(model["coefficient_vector"]) == pytest.approx(2.0, abs=1e-4)


def test_streamed_bars_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = stream_bars(stream).writeStream.format("memory").queryName("streamed_bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("streamed_bars")
    want = candles.bars(events).select(*got.columns)
    r = lambda d: sorted((x["open_time"], x["open"], x["close"], x["high"], x["low"], round(x["volume"], 6), x["trades"]) for x in d.collect())
    assert r(got) == r(want)


def test_scores_of_a_stream(spark, tmp_path):
    model = {"intercept": 1.0, "coefficient_vector": [2.0], "features": ["a"]}
    spark.createDataFrame([(3.0,), (None,)], "a double").write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema("a double").parquet(str(tmp_path / "f"))
    q = stream_scores(stream, model).writeStream.format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(str(r["forecast"]) for r in spark.table("scores").collect()) == ["7.0", "None"]
