"""Model helpers and the metric-view resolver."""

import datetime as dt

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import ml as M
from tidemark.plans.metrics import MetricView


def test_class_weights(spark):
    df = spark.createDataFrame([(False,)] * 95 + [(True,)] * 5, "churned boolean")
    w = {r.churned: r.weight for r in M.with_class_weight(df).distinct().collect()}
    assert w[True] == pytest.approx(19.0) and w[False] == 1.0
    df0 = spark.createDataFrame([(False,)] * 10, "churned boolean")
    assert {r.weight for r in M.with_class_weight(df0).collect()} == {1.0}


def test_temporal_split(spark):
    rows = [(dt.date(2025, m, 1), m) for m in (1, 2, 3, 3)]
    df = spark.createDataFrame(rows, "month_start date, v long")
    tr, va, hold = M.temporal_split(df)
    assert hold == dt.date(2025, 3, 1) and va.count() == 2 and tr.count() == 2
    assert tr.agg(F.max("month_start")).first()[0] < hold


def test_feature_contract():
    from pyspark.sql.types import StructField, StructType, DoubleType

    with pytest.raises(ValueError):
        M.assert_feature_contract(StructType([StructField("tenure_months", DoubleType())]))
    with pytest.raises(ValueError):
        M.assert_feature_contract(StructType([StructField(c, DoubleType()) for c in M.FEATURES]), M.FEATURES + ["churn_date"])


def test_metric_view_any_grouping(spark):
    df = spark.createDataFrame([("a", True, 10.0), ("a", False, 5.0), ("b", None, 7.0)], "g string, sub boolean, mrr double")
    mv = MetricView(df, {"G": F.col("g")}, {"Users": F.count(F.lit(1)), "MRR at risk": F.sum(F.when(F.col("sub"), F.col("mrr")))})
    assert mv.query(["Users", "MRR at risk"]).first().asDict() == {"Users": 3, "MRR at risk": 10.0}
    by = {r.G: r["MRR at risk"] for r in mv.query(["MRR at risk"], by=["G"]).collect()}
    assert by == {"a": 10.0, "b": None}  # NULL flag skipped (T6)
    with pytest.raises(KeyError):
        mv.query(["nope"])


def test_gbt_learns_signal(spark):
    import random

    rnd = random.Random(7)
    rows = []
    for u in range(400):
        for m in range(1, 7):
            low = rnd.random() < 0.3
            hours = rnd.uniform(0.1, 1.0) if low else rnd.uniform(3.0, 6.0)
            churn = low and rnd.random() < 0.7
            rows.append((u, dt.date(2025, m, 1), churn, m, 10, hours, 0.3, 2.0, 1.0 if not low else 0.5, 0, 1, 0, False))
    cols = ("user_id long, month_start date, churned boolean, tenure_months long, active_days long, avg_coding_hours double, "
            "avg_acceptance_rate double, avg_session_frequency double, coding_hours_trend_30d double, support_tickets_30d long, "
            "features_adopted long, crm_touches_30d long, is_power_user_month boolean")
    df = spark.createDataFrame(rows, cols)
    model, valid, _ = M.train(df, {"maxIter": 10})
    auc = M.evaluate(model, valid).first().roc_auc
    assert auc > 0.65
    scored = M.score_latest(model, df, 1)
    assert scored.count() == 400 and set(r.churn_risk_band for r in scored.collect()) <= {"high", "medium", "low"}


def test_score_areas_match_all_pairs(spark):
    import random

    from tidemark.operators import ml as M

    rng = random.Random(3)
    rows = [(round(rng.random() * 0.6 + 0.2 * y, 2), bool(y)) for y in (int(rng.random() < 0.3) for _ in range(400))] + [(None, True), (0.5, None)]
    got = M.score_areas(spark.createDataFrame(rows, "churn_score double, label boolean")).first()
    pos = [s for s, y in rows if y and s is not None]
    neg = [s for s, y in rows if y is False]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got.rows == len(pos) + len(neg) and got.positives == len(pos)
    assert got.roc_auc == pytest.approx(pairs / len(pos) / len(neg), abs=1e-12)
    area = sum(sum(q >= p for q in pos) / (sum(q >= p for q in pos) + sum(q >= p for q in neg)) for p in pos) / len(pos)
    assert got.pr_auc == pytest.approx(area, abs=1e-12)


def test_score_areas_of_one_class_and_of_nothing(spark):
    from tidemark.operators import ml as M

    one = M.score_areas(spark.createDataFrame([(0.1, False), (0.9, False)], "churn_score double, label boolean")).first()
    assert (one.rows, one.positives, one.roc_auc, one.pr_auc) == (2, 0, None, None)
    none = M.score_areas(spark.createDataFrame([], "churn_score double, label boolean")).first()
    assert (none.rows, none.roc_auc) == (0, None)
    with pytest.raises(ValueError):
        M.score_areas(spark.createDataFrame([], "churn_score double, label boolean"), digits=9)


def test_rows_of_equal_bins_train_as_one(spark):
    """The trees of the merged rows are those of all rows, at the weight of all."""
    rows = spark.range(6000).selectExpr(
        "id AS user_id", "DATE'2024-01-01' AS month_start", *[f"CAST(hash(id, {k}) % {3 + k} AS DOUBLE) AS {c}" for k, c in enumerate(M.NUMERIC_FEATURES)][:3],
        *[f"CAST(id % 2 AS DOUBLE) AS {c}" for c in M.NUMERIC_FEATURES[3:]], "id % 3 = 0 AS is_power_user_month", "hash(id, 1) % 4 + hash(id, 2) % 5 + hash(id, 9) % 3 > 2 AS churned",
    )
    rows = M.with_class_weight(M.prepare(rows)).withColumn("held", F.col("user_id") % 10 == 0)
    params = {"maxIter": 5}
    model = M.fit(rows, params, validation_col="held")
    seen = model.stages[:-1]
    df = rows
    for stage in seen:
        df = stage.transform(df)
    assert df.groupBy("features", "label", "held").count().count() < 2000
    gbt = GBTClassifier(labelCol="label", weightCol="weight", validationIndicatorCol="held", **(M.GBT_PARAMS | params))
    whole = gbt.fit(df)
    assert whole.totalNumNodes > 20 and model.stages[-1].totalNumNodes > 20  # leaves may differ where a split gains nothing
    both = whole.setProbabilityCol("p").setPredictionCol("q").setRawPredictionCol("r").transform(df)
    worst = both.select("user_id", F.col("p").alias("p")).join(M.positive_probability(model.transform(rows)).select("user_id", "churn_score"), "user_id")
    worst = worst.select(F.max(F.abs(vector_to_array("p")[1] - F.col("churn_score")))).first()[0]
    assert worst < 1e-6


def test_few_values_keep_a_bin_each(spark):
    df = spark.range(2000).selectExpr("CAST(IF(id < 1990, 0, id) AS DOUBLE) AS few", "CAST(id * 1.5 AS DOUBLE) AS many", "1.0D AS one")
    few, many, one = M.bin_borders(df, ["few", "many", "one"])
    assert few[1:3] == [995.0, 1990.5] and len(few) == 12 and 30 <= len(many) <= 33 and len(one) == 3
