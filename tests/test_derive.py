"""Derivation rules on literal frames (one frame per semantic trap)."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import derive as D
from tidemark.operators.sequence import ordered_neighbors, ordered_prefix_sum

d = dt.date


def test_mom_ratio_dense_gap_and_clip(spark):
    rows = [(1, d(2025, 1, 1), 2.0), (1, d(2025, 2, 1), 1.0), (1, d(2025, 3, 1), 0.0), (1, d(2025, 4, 1), 3.0),
            (2, d(2025, 1, 1), 0.1), (2, d(2025, 2, 1), 4.0)]
    df = spark.createDataFrame(rows, "user_id long, month_start date, v double")
    out = {(r.user_id, r.month_start): r.t for r in D.mom_ratio(df, "v", "t").collect()}
    assert [out[(1, d(2025, m, 1))] for m in (1, 2, 3, 4)] == [1.0, 0.5, 0.0, 1.0]
    assert out[(2, d(2025, 2, 1))] == 5.0  # raw ratio 40 clipped


def test_mom_ratio_missing_month_counts_as_zero(spark):
    rows = [(1, d(2025, 1, 1), 2.0), (1, d(2025, 3, 1), 3.0)]
    df = spark.createDataFrame(rows, "user_id long, month_start date, v double")
    out = {r.month_start: r.t for r in D.mom_ratio(df, "v", "t").collect()}
    assert out[d(2025, 3, 1)] == 1.0  # previous calendar month had no activity


def _usage(spark, days, hours=5.0, user=1):
    return spark.createDataFrame([(user, x, hours) for x in days], "user_id long, event_date date, coding_hours double")


def test_power_week_rules(spark):
    mon = d(2025, 3, 3)
    five = [mon + dt.timedelta(days=i) for i in range(5)]
    assert D.power_weeks(_usage(spark, five)).count() == 1
    assert D.power_weeks(_usage(spark, five[:4])).count() == 0
    split = [d(2025, 3, 6), d(2025, 3, 7), d(2025, 3, 8), d(2025, 3, 10), d(2025, 3, 11)]  # Thu..Tue
    assert D.power_weeks(_usage(spark, split)).count() == 0
    assert D.power_weeks(_usage(spark, five, hours=3.9)).count() == 0


def test_power_week_month_attribution(spark):
    days = [d(2025, 3, 31) + dt.timedelta(days=i) for i in range(5)]  # Mon 31 Mar .. Fri 4 Apr
    r = D.power_weeks(_usage(spark, days)).first()
    assert r.month_start == d(2025, 3, 1)


def test_sustained_flag(spark):
    pairs = [(1, 1), (2, 1), (3, 1), (3, 2), (4, 2), (4, 0)]
    df = spark.createDataFrame(pairs, "o long, q long")
    got = [r[0] for r in df.select(D.sustained_flag("o", "q")).collect()]
    assert got == [False, True, False, True, True, False]


def _terms(spark, rows):
    return spark.createDataFrame(rows, "user_id long, term_start_date date, term_end_date date, is_downgrade boolean")


def test_at_risk_signup_and_cancel(spark):
    terms = _terms(spark, [(1, d(2025, 3, 15), d(2025, 5, 1), False)])
    spine = D.user_month_spine(spark.createDataFrame([(1, d(2025, 3, 1), d(2025, 6, 1))], "user_id long, a date, b date"), "a", "b")
    got = sorted(r.month_start for r in D.at_risk_months(terms, spine).collect())
    assert got == [d(2025, 4, 1), d(2025, 5, 1)]


def test_at_risk_plan_change_on_first(spark):
    terms = _terms(spark, [(1, d(2025, 1, 10), d(2025, 2, 28), False), (1, d(2025, 3, 1), None, True)])
    spine = D.user_month_spine(spark.createDataFrame([(1, d(2025, 1, 1), d(2025, 4, 1))], "user_id long, a date, b date"), "a", "b")
    got = sorted(r.month_start for r in D.at_risk_months(terms, spine).collect())
    assert got == [d(2025, 2, 1), d(2025, 3, 1), d(2025, 4, 1)]


def test_at_risk_overlapping_and_same_month_terms(spark):
    terms = _terms(
        spark,
        [
            (1, d(2025, 1, 1), d(2025, 2, 1), False),  # February only: no change of plan on January 1st
            (1, d(2025, 1, 20), d(2025, 4, 2), False),  # overlaps
            (1, d(2025, 4, 5), d(2025, 4, 20), False),  # begins and ends inside a month: none
            (1, d(2024, 1, 1), d(2024, 3, 1), False),  # before the spine
            (2, d(2025, 2, 1), None, True),
        ],
    )
    bounds = spark.createDataFrame([(1, d(2025, 1, 1), d(2025, 6, 1)), (2, d(2025, 1, 1), d(2025, 3, 1)), (3, d(2025, 1, 1), d(2025, 2, 1))], "user_id long, a date, b date")
    got = sorted(map(tuple, D.at_risk_months(terms, D.user_month_spine(bounds, "a", "b")).collect()))
    assert got == [(1, d(2025, 2, 1)), (1, d(2025, 3, 1)), (1, d(2025, 4, 1)), (2, d(2025, 2, 1)), (2, d(2025, 3, 1))]


def test_at_risk_does_not_expand_terms(spark):
    rows = [(1, d(1900, 1, 15), d(2025, 3, 1), False), (1, d(1901, 1, 15), None, False)]
    deltas = D.cover_deltas(_terms(spark, rows)).collect()
    assert sorted(map(tuple, deltas)) == [(1, d(1900, 2, 1), 1), (1, d(1901, 2, 1), 1), (1, d(2025, 4, 1), -1)]


def test_dense_months(spark):
    rows = [
        (1, d(2024, 12, 1), 0, 1, 5), (1, d(2025, 1, 1), 2, 0, 0), (1, d(2025, 4, 1), 1, -1, 7), (1, d(2025, 9, 1), 0, 3, 9),
        (2, d(2025, 2, 1), 1, 0, 0), (3, d(2025, 2, 1), 0, 4, 0),
    ]
    df = spark.createDataFrame(rows, "user_id long, month_start date, n int, d int, v int")
    got = D.dense_months(df, "n", {"open": "d"}, ["n"], ["v"]).orderBy("user_id", "month_start").collect()
    assert [tuple(r) for r in got] == [
        (1, d(2025, 1, 1), 1, 2, 0, d(2025, 4, 1)), (1, d(2025, 2, 1), 1, 0, None, d(2025, 4, 1)), (1, d(2025, 3, 1), 1, 0, None, d(2025, 4, 1)),
        (1, d(2025, 4, 1), 0, 1, 7, d(2025, 4, 1)), (2, d(2025, 2, 1), 0, 1, 0, d(2025, 2, 1)),
    ]


def test_labels_read_orders_and_line_items_at_most_twice(spark):
    from conftest import SF_SMALL

    from tidemark.sources.fixtures import Tables

    plan = Tables(spark, SF_SMALL).churn_labels()._jdf.queryExecution().optimizedPlan().toString()
    # the ordered terms read their source twice, once for the summary per day
    assert plan.count("l_shipdate#") and plan.count("l_orderkey") and len([x for x in plan.splitlines() if "Relation" in x and "l_shipdate" in x]) == 1
    assert len([x for x in plan.splitlines() if "Relation" in x and "o_totalprice" in x]) <= 3


def test_latest_churn_is_of_at_risk_rows(spark, sf_small):
    from tidemark.plans import catalog

    trend = catalog.queries()["churn_trend"](spark, sf_small).collect()
    late = [r for r in trend if str(r.month) >= "2000-09-01"]
    assert late and any(r.churned_users > 0 for r in late)


def test_bill_terms(spark):
    t = spark.createDataFrame(
        [(1, d(2025, 1, 1), d(2025, 2, 14), 20.0, "monthly"), (2, d(2024, 1, 1), d(2025, 2, 3), 16.0, "annual")],
        "user_id long, term_start_date date, term_end_date date, mrr_usd double, billing_period string",
    )
    out = {r.user_id: r for r in D.bill_terms(t, d(2024, 1, 1), d(2025, 12, 31)).collect()}
    assert (out[1].billed_days, out[1].renewals_count, out[1].revenue_usd) == (45, 1, 30.0)
    assert (out[2].billed_days, out[2].renewals_count, out[2].revenue_usd) == (400, 1, 213.33)


def test_build_terms(spark):
    ev = spark.createDataFrame(
        [(1, d(2025, 1, 1), "signup", 1), (1, d(2025, 2, 1), "downgrade", 2), (1, d(2025, 3, 5), "cancel", 3),
         (1, d(2025, 5, 1), "reactivate", 4)],
        "user_id long, event_date date, event_type string, event_id long",
    )
    t = {r.term_index: r for r in D.build_terms(ev, tiebreak="event_id").collect()}
    assert (t[0].status, t[0].term_end_date) == ("downgraded", d(2025, 1, 31))
    assert (t[1].status, t[1].term_end_date, t[1].cancel_date) == ("canceled", d(2025, 3, 5), d(2025, 3, 5))
    assert (t[2].status, t[2].term_end_date, t[2].is_reactivation) == ("active", None, True)


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 5, "z")], "k long, o long, v string")
    assert sorted((r.k, r.v) for r in D.latest_per_key(df, "k", "o").collect()) == [(1, "c"), (2, "z")]


def test_ordered_neighbors_matches_window_with_hot_key(spark):
    # key 0 holds a third of the rows, spread over many days and several per day
    rows = [(0 if i % 3 == 0 else i % 17, d(2025, 1, 1) + dt.timedelta(days=i % 40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, day date, id long")
    got = ordered_neighbors(df, "k", ["day", "id"], F.col("day"), index="ix", lead={"nx": "id"}, lag={"pv": "id"}, count="n")
    w = Window.partitionBy("k").orderBy("day", "id")
    exp = df.select(
        "k", "id", (F.row_number().over(w) - 1).alias("ix"), F.lead("id").over(w).alias("nx"), F.lag("id").over(w).alias("pv"),
        F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n"),
    )
    key = lambda r: r.id
    a = sorted(got.select("k", "id", "ix", "nx", "pv", "n").collect(), key=key)
    b = sorted(exp.collect(), key=key)
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_ordered_prefix_sum(spark):
    rows = [(1, d(2025, 1, 1) + dt.timedelta(days=i // 3), i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, day date, id long, v long")
    got = sorted((r.id, r.s) for r in ordered_prefix_sum(df, "k", ["day", "id"], F.col("day"), "v", "s").collect())
    assert got == [(i, i + 1) for i in range(30)]


def test_dense_index_is_global_order(spark):
    df = spark.range(0, 5000).withColumn("g", (F.col("id") * 7919) % 5000)
    got = D.dense_index(df, ["g"], out="rn", start=1).select("g", "rn").collect()
    assert sorted((r.g + 1, r.rn) for r in got) == [(i, i) for i in range(1, 5001)]


def test_surrogate_keys_format(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "t long")
    assert sorted(r.surrogate_id for r in D.surrogate_keys(df, ["t"]).collect()) == ["TCK-000000001", "TCK-000000002", "TCK-000000003"]


def test_sample_users_keeps_whole_users(spark):
    df = spark.createDataFrame([(u, i) for u in range(200) for i in range(3)], "user_id long, i long")
    s = D.sample_users(df, num=1, den=4)
    counts = {r.user_id: r["count"] for r in s.groupBy("user_id").count().collect()}
    assert counts and all(c == 3 for c in counts.values()) and len(counts) < 200


def test_sample_users_md5_is_portable(spark):
    import hashlib

    df = spark.createDataFrame([(u,) for u in range(500)], "user_id long")
    got = {r.user_id for r in D.sample_users(df, num=1, den=10, seed=1729, hash="md5").collect()}
    want = {u for u in range(500) if int(hashlib.md5(f"{u}:1729".encode()).hexdigest()[:8], 16) % 10 < 1}
    assert got == want and 20 < len(got) < 80


def test_zscore_matches_numpy_population_std(spark):
    import numpy as np

    xs = [0.0, 0.05, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0]  # 0 and 0.05 both sit at the 0.1 floor
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, hours double")
    got = {r.i: r.hours_z for r in D.zscore(df, ["hours"]).collect()}
    v = np.log(np.maximum(np.array(xs), 0.1))
    want = np.round((v - v.mean()) / (v.std() + 1e-9), 4)  # numpy std is population (T21)
    assert [got[i] for i in range(len(xs))] == [float(w) for w in want]


@pytest.mark.parametrize("parts", ["4", "8"])
def test_dense_index_with_a_payload_column(spark, parts):
    # a payload that is no sort key, and more rows than the range sample holds
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(300_000).selectExpr("xxhash64(id) AS g", "id * 3 AS payload")
        got = D.dense_index(df, ["g"], out="rn")
        r = got.agg(F.countDistinct("rn").alias("d"), F.count("*").alias("n"), F.max("rn").alias("m"), F.min("rn").alias("lo")).first()
        assert (r.d, r.n, r.m, r.lo) == (300_000, 300_000, 300_000, 1)
        w = got.orderBy("rn").select("g").limit(1000).collect()
        assert [x.g for x in w] == sorted(x.g for x in w)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_feature_adoption_keeps_never_adopted_features(spark):
    d = dt.date
    spine = spark.createDataFrame([(1, d(2025, 1, 1)), (1, d(2025, 2, 1)), (2, d(2025, 2, 1))], "user_id long, month_start date")
    days = spark.createDataFrame([(1, "a", d(2025, 2, 3), 4), (2, "b", d(2025, 1, 5), 1)], "user_id long, feature_key string, date date, activations long")
    usage = spark.createDataFrame([(1, d(2025, 2, 3)), (1, d(2025, 2, 4))], "user_id long, event_date date")
    got = {(r.user_id, r.feature_key, r.month_start.month): (r.is_adopted, r.activation_count, r.depth_score) for r in D.feature_adoption(usage, spine, days).collect()}
    assert got == {
        (1, "a", 1): (False, 0, 0.0), (1, "b", 1): (False, 0, 0.0), (1, "a", 2): (True, 4, 0.5),
        (1, "b", 2): (False, 0, 0.0), (2, "a", 2): (False, 0, 0.0), (2, "b", 2): (True, 0, 0.0),
    }


def test_same_day_openings_merge_and_winback_churn(spark):
    d = dt.date
    rows = [(1, d(2025, 1, 1), "signup", 1), (1, d(2025, 1, 1), "downgrade", 2), (1, d(2025, 2, 1), "cancel", 3), (1, d(2025, 3, 1), "reactivate", 4), (1, d(2025, 3, 1), "cancel", 5)]
    ev = spark.createDataFrame(rows, "user_id long, event_date date, event_type string, n long")
    got = sorted((r.term_index, r.term_start_date, r.term_end_date, r.status) for r in D.build_terms(ev, tiebreak="n").collect())
    assert got == [(0, d(2025, 1, 1), d(2025, 2, 1), "canceled"), (1, d(2025, 3, 1), d(2025, 3, 1), "churned_after_reactivation")]


def test_opt_outs_close_a_channel_from_then_on(spark):
    rules = [("A", "at_risk", "email", "x > 0"), ("B", "any", "in_app", "true"), ("C", "big", "push", "x > 5")]
    features = spark.createDataFrame([(u, d(2025, m, 1), x) for u, x in ((1, 3), (2, 9), (3, None)) for m in (1, 2, 3)], "user_id long, month_start date, x int")
    outs = spark.createDataFrame([(1, "email", d(2025, 2, 1)), (1, "email", d(2025, 3, 5)), (2, "push", d(2025, 2, 2)), (2, "in_app", d(2025, 1, 1))], "user_id long, channel string, unsub_date date")
    got = D.segment_eligibility(features, rules, outs).collect()
    assert sorted((r.user_id, r.month_start.month, r.campaign_id) for r in got) == sorted(
        [(1, 1, "A"), *((2, m, "A") for m in (1, 2, 3)), *((u, m, "B") for u in (1, 2, 3) for m in (1, 2, 3)), (2, 1, "C"), (2, 2, "C")]
    )
    assert len(D.segment_eligibility(features, rules).collect()) == 6 + 9 + 3


def test_one_user_with_all_rows_on_one_day(spark):
    import statistics

    from tidemark.operators import sequence as SQ

    n, rows = 20_000, 1_000
    hot = spark.range(n).selectExpr("7L AS user_id", "DATE'2025-01-05' AS day", "xxhash64(id) AS tie", "id AS v")
    rest = spark.range(300).selectExpr("id % 3 AS user_id", "date_add(DATE'2025-01-01', CAST(id % 9 AS INT)) AS day", "id AS tie", "id AS v")
    df = hot.unionByName(rest).repartition(8)
    split = SQ.split_buckets(df, "user_id", F.col("day"), "tie", "b", rows)
    sizes = [r["count"] for r in split.where("user_id = 7").groupBy("user_id", "b").count().collect()]
    assert len(sizes) >= n // rows and max(sizes) <= 2 * statistics.median(sizes)
    got = SQ.ordered_neighbors(
        df, key="user_id", order=["day", "tie"], bucket=F.col("day"), index="i", lead={"nx": "v"}, lag={"pv": "v"}, count="n", split=rows
    ).collect()
    by_user = {}
    for r in df.collect():
        by_user.setdefault(r.user_id, []).append((r.day, r.tie, r.v))
    want = set()
    for user, own in by_user.items():
        own.sort()
        for i, (day, tie, v) in enumerate(own):
            want.add((user, day, tie, v, i, own[i + 1][2] if i + 1 < len(own) else None, own[i - 1][2] if i else None, len(own)))
    assert {(r.user_id, r.day, r.tie, r.v, r.i, r.nx, r.pv, r.n) for r in got} == want


def test_buckets_without_many_rows_stay_whole(spark):
    from tidemark.operators import sequence as SQ

    df = spark.range(50).selectExpr("id % 2 AS user_id", "DATE'2025-01-05' AS day", "id AS tie")
    assert {r.b.piece for r in SQ.split_buckets(df, "user_id", F.col("day"), "tie", "b", 25).collect()} == {0}
