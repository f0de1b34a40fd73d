"""Column helpers: literal edge cases of the reference (bands, trends, coercion)."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import worklist as W


def _vals(spark, xs, fn, schema="x double"):
    df = spark.createDataFrame([(x,) for x in xs], schema)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_risk_band_edges(spark):
    assert _vals(spark, [0.0, 0.2999, 0.30, 0.5999, 0.60, 1.0], C.risk_band) == [
        "low", "low", "medium", "medium", "high", "high"
    ]


def test_norm_band(spark):
    assert _vals(spark, ["HIGH", "x", None], C.norm_band, "x string") == ["high", "low", "low"]


def test_trend_direction_dead_band(spark):
    assert _vals(spark, [0.96, 0.97, 1.0, 1.03, 1.04], C.trend_direction) == ["dn", "flat", "flat", "flat", "up"]


def test_trend_label(spark):
    assert _vals(spark, [0.62, 1.0, 0.0, 1.78], C.trend_label) == ["38%", "flat", "100%", "78%"]


def test_severity(spark):
    assert _vals(spark, [3.8, 3.7, 3.3, 3.29], C.severity) == ["high", "high", "medium", "low"]


def test_coerce_num(spark):
    assert _vals(spark, [None, "", "abc", "2.5", "NaN"], lambda c: C.coerce_num(c, 7.0), "x string") == [7.0, 7.0, 7.0, 2.5, 7.0]


def test_half_up_ratio_exact_ties(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (5, 2), (1, 3), (2, 3)], "n long, d long")
    assert [r[0] for r in df.select(C.half_up_ratio("n", "d")).collect()] == [1, 2, 3, 0, 1]


def test_exact_mean_tie(spark):
    # mean 0.36055 is a decimal tie at 4 dp: exact half-up gives 0.3606
    df = spark.createDataFrame([(0.721,), (0.0001,)], "x double")
    assert df.agg(C.exact_mean("x", 4, 4)).first()[0] == 0.3606


def test_clean_text(spark):
    out = _vals(spark, ["  **Churn** is   up.  It rose again! Third sentence.  "], C.clean_text, "x string")
    assert out == ["Churn is up. It rose again!"]


@pytest.mark.parametrize("n,expected", [(None, 100), (0, 1), (9999, 500), (2.9, 2), ("abc", 100), (float("nan"), 100)])
def test_limit_clamp(n, expected):
    assert W.coerce_limit(n) == expected


def test_worklist_rejects_unknown_band_and_geo():
    with pytest.raises(ValueError):
        W.worklist_filter(band="critical")
    with pytest.raises(ValueError):
        W.worklist_filter(geo="XX")


def test_reround_half_up_on_decimal_ties(spark):
    got = _vals(spark, [0.1235, 0.1225, 0.1234, 0.9995, 0.0], lambda c: W.reround(c, 4, 3))
    assert got == [0.124, 0.123, 0.123, 1.0, 0.0]
    assert _vals(spark, [1.005, 2.4950, 0.0049], lambda c: W.reround(c, 4, 2)) == [1.01, 2.5, 0.0]


def test_half_up_ratio_beyond_doubles_and_longs(spark):
    df = spark.createDataFrame([(72057594037927939, 1), (5, 0)], "n long, d long")
    assert [r[0] for r in df.select(C.half_up_ratio("n", "d")).collect()] == [72057594037927939, None]
    big = spark.range(1).select(C.half_up_ratio(F.lit("60000000000000000000").cast("decimal(36,0)"), F.lit(7)))
    assert big.first()[0] == 8571428571428571429


def test_exact_mean_of_large_sums(spark):
    df = spark.range(1000).selectExpr("900000000000000 + id AS v")  # sums to 9e19 hundredths
    assert df.agg(C.exact_mean(F.col("v"), 2, 2)).first()[0] == 900000000000499.5


def test_clean_text_rules(spark):
    cases = {
        "the user_id is 3 # points": "the user_id is 3 # points",
        "“__Bold__ and _soft_ and *x*”": "Bold and soft and x",
        "Churn rose to 4% across 12 rows shown.": "Churn rose to 4%.",
        "Churn rose , based on all 3 rows": "Churn rose",
        "One . Two ! Three ?": "One. Two!",
        None: "",
        "a" * 600: "a" * 520 + "…",
        "b" * 300 + ". " + "c" * 400: "b" * 300 + ".",
        "b" * 100 + ". " + "c" * 500: "b" * 100 + ". " + "c" * 418 + "…",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, y string")
    for r in df.select("x", "y", C.clean_text("x").alias("got")).collect():
        assert r.got == r.y, r.x
