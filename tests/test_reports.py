import xml.etree.ElementTree as ET

from tidewater.operators import reports
from tidewater.sources import charts


def test_summaries(spark):
    rows = spark.createDataFrame([("a", 2, 0.01, 3.0), ("a", 3, 0.2, -1.0), ("b", 2, None, None)], "window string, dim int, p_value double, statistic double")
    got = {r["window"]: (r["tests"], r["rejected"], r["max_statistic"]) for r in reports.bds_summary(rows, ["window"]).collect()}
    assert got == {"a": (2, 1, 3.0), "b": (1, 0, None)}
    rows = spark.createDataFrame([("a", 1, 0.4, 0.1, 1.0), ("a", 2, 0.2, 0.1, 0.5)], "window string, lag int, original double, mean double, percentile double")
    assert reports.shuffle_summary(rows, ["window"]).first()["above_95"] == 1
    assert reports.around(spark.range(20).withColumnRenamed("id", "tau"), 9).count() == 11
    assert reports.ar_equation([0.5, -0.25, 0.1], 2) == "z(t) = +0.5000 z(t-1) -0.2500 z(t-2) + ... + e(t)"
    p = spark.createDataFrame([(i, 1.0, 2.0) for i in range(10)], "idx long, y double, prediction double")
    assert reports.plot_rows(p, 10, 4).count() == 4


def test_charts_are_well_formed():
    for kind in ("line", "points", "bars"):
        svg = charts.chart({"a<b": [(0, 1), (1, float("nan")), (2, 3)], "c": []}, "t & u", "x", "y", kind, levels=[0.5])
        assert ET.fromstring(svg).tag.endswith("svg")
    assert ET.fromstring(charts.chart({"flat": [(1, 1)]})) is not None
    assert charts.ticks(0, 10) == [0, 2, 4, 6, 8, 10] and charts.ticks(3, 3) == [3]
