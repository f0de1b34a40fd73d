"""Integrity checks with planted violations, and small builders / top-k
operators on literal frames (boundary cases)."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import derive as D
from tidemark.operators import quality as Q
from tidemark.operators import worklist as W
from tidemark.operators.ml import bands_by_capacity


def d(y, m, day):
    return dt.date(y, m, day)


TERMS = "user_id long, term_start_date date, term_end_date date, term_index int"


def test_term_overlaps_planted(spark):
    terms = spark.createDataFrame(
        [
            (1, d(2024, 1, 1), d(2024, 3, 31), 0),
            (1, d(2024, 3, 15), None, 1),  # overlap
            (2, d(2024, 1, 1), None, 0),  # open but not last
            (2, d(2024, 5, 1), None, 1),
            (3, d(2024, 1, 1), d(2024, 1, 31), 0),
            (3, d(2024, 2, 1), None, 1),
            (4, d(2024, 1, 1), d(2024, 2, 1), 0),  # end == next start is allowed
            (4, d(2024, 2, 1), None, 1),
        ],
        TERMS,
    )
    got = {(r.user_id, r.term_index, r.violation) for r in Q.term_overlaps(terms).collect()}
    assert got == {(1, 0, "overlap"), (2, 0, "open_not_last")}


def test_count_mismatch_both_sides(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    b = spark.createDataFrame([(1,), (1,), (3,)], "k long")
    got = {(r.k, r.a_count, r.b_count) for r in Q.count_mismatch(a, b, "k").collect()}
    assert got == {(2, 1, 0), (3, 0, 1)}


def test_outside_parent_dates(spark):
    users = spark.createDataFrame([(1, d(2024, 1, 10)), (2, d(2024, 1, 1))], "user_id long, signup_date date")
    events = spark.createDataFrame(
        [(1, d(2024, 1, 9)), (1, d(2024, 1, 10)), (2, d(2024, 1, 1)), (3, d(2020, 1, 1))], "user_id long, event_date date"
    )
    got = [(r.user_id, r.event_date) for r in Q.outside_parent_dates(events, users, "user_id", "event_date", "signup_date").collect()]
    assert got == [(1, d(2024, 1, 9))]  # the signup day itself is fine; unknown users are an FK matter

    camps = spark.createDataFrame([("c1", d(2024, 1, 1), d(2024, 1, 31))], "campaign_id string, start_date date, end_date date")
    touches = spark.createDataFrame(
        [("c1", d(2023, 12, 31)), ("c1", d(2024, 1, 1)), ("c1", d(2024, 1, 31)), ("c1", d(2024, 2, 1))], "campaign_id string, touch_date date"
    )
    bad = Q.outside_parent_dates(touches, camps, "campaign_id", "touch_date", "start_date", "end_date")
    assert sorted(r.touch_date for r in bad.collect()) == [d(2023, 12, 31), d(2024, 2, 1)]


def test_column_mismatch_equality_and_bound(spark):
    labels = spark.createDataFrame([(1, "EMEA"), (2, "AMER"), (3, None)], "user_id long, geo string")
    users = spark.createDataFrame([(1, "EMEA"), (2, "APAC"), (3, "AMER")], "user_id long, geo string")
    got = {r.user_id for r in Q.column_mismatch(labels, users, ["user_id"], "geo").collect()}
    assert got == {2, 3}  # a NULL against a value is a mismatch

    feat = spark.createDataFrame([(1, d(2024, 1, 1), 5), (1, d(2024, 2, 1), 9)], "user_id long, month_start date, active_days int")
    usage = spark.createDataFrame([(1, d(2024, 1, 1), 5), (1, d(2024, 2, 1), 8)], "user_id long, month_start date, active_days int")
    over = Q.column_mismatch(feat, usage, ["user_id", "month_start"], "active_days", op=">")
    assert [r.month_start for r in over.collect()] == [d(2024, 2, 1)]


def test_range_checks_and_rate_check(spark):
    df = spark.createDataFrame([(0.5, True), (1.5, False), (None, False), (0.0, False)], "rate double, churned boolean")
    rep = {r.check_name: (r.bad, r.total, r.ok) for r in Q.range_checks(df, {"rate_0_1": "rate BETWEEN 0 AND 1"}).collect()}
    assert rep == {"rate_0_1": (2, 4, False)}  # 1.5 and NULL
    r = Q.rate_check(df, "churned", target=0.25, tol=0.005).collect()[0]
    assert r.rate == 0.25 and r.ok
    r = Q.rate_check(df, "churned", target=0.30, tol=0.005).collect()[0]
    assert not r.ok


def test_in_term_boundaries(spark):
    terms = spark.createDataFrame(
        [(1, d(2024, 1, 1), d(2024, 1, 31), 0), (1, d(2024, 3, 1), None, 1)], TERMS
    )
    days = [d(2024, 1, 1), d(2024, 1, 31), d(2024, 2, 1), d(2024, 2, 29), d(2024, 3, 1), d(2030, 1, 1)]
    pts = spark.createDataFrame([(1, x) for x in days] + [(2, d(2024, 1, 5))], "user_id long, created_date date")
    got = {(r.user_id, r.created_date): r.in_term for r in D.in_term(pts, terms, "created_date").collect()}
    assert got == {
        (1, d(2024, 1, 1)): True,
        (1, d(2024, 1, 31)): True,  # end date inclusive
        (1, d(2024, 2, 1)): False,
        (1, d(2024, 2, 29)): False,
        (1, d(2024, 3, 1)): True,
        (1, d(2030, 1, 1)): True,  # open term
        (2, d(2024, 1, 5)): False,  # no terms
    }


def test_sweep_hot_day_keeps_every_row(spark):
    # one user with many rows on one day, overlapping terms; brute force in Python
    terms_rows = [
        (7, d(2024, 1, 1), d(2024, 1, 10), 0),
        (7, d(2024, 1, 5), d(2024, 1, 20), 1),
        (7, d(2024, 2, 1), None, 2),
        (8, d(2024, 1, 15), d(2024, 1, 15), 0),
    ]
    pts_rows = [(i, 7, d(2024, 1, 7)) for i in range(300)]
    pts_rows += [(1000 + i, 7, d(2024, 1, 1) + dt.timedelta(days=i)) for i in range(60)]
    pts_rows += [(2000, 8, d(2024, 1, 15)), (2001, 8, d(2024, 1, 16))]
    terms = spark.createDataFrame(terms_rows, TERMS)
    pts = spark.createDataFrame(pts_rows, "touch_id long, user_id long, touch_date date")

    def open_count(u, day):
        return sum(1 for tu, s, e, _ in terms_rows if tu == u and s <= day and (e is None or day <= e))

    got = {r.touch_id: r.open_intervals for r in Q.coverage_sweep(pts, terms).collect()}
    assert got == {tid: open_count(u, day) for tid, u, day in pts_rows}
    unc = {r.touch_id for r in Q.uncovered(pts, terms).collect()}
    assert unc == {tid for tid, u, day in pts_rows if open_count(u, day) == 0}


def test_keyset_pages_cover_the_sort_once(spark):
    rows = [(float(s), u) for u, s in enumerate([0.9, 0.5, 0.9, 0.1, 0.5, 0.7, 0.9, 0.3, 0.5, 0.2])]
    df = spark.createDataFrame(rows, "churn_score double, user_id long")
    order = [("churn_score", True), ("user_id", False)]
    full = [(r.churn_score, r.user_id) for r in df.orderBy(F.col("churn_score").desc(), "user_id").collect()]
    seen, after = [], None
    while True:
        pg = [(r.churn_score, r.user_id) for r in W.page(df, order, after, 3).collect()]
        if not pg:
            break
        seen += pg
        after = {"churn_score": pg[-1][0], "user_id": pg[-1][1]}
    assert seen == full


def test_bands_by_capacity_ties_by_key(spark):
    df = spark.createDataFrame([(u, s) for u, s in [(5, 0.9), (3, 0.9), (1, 0.8), (2, 0.8), (4, 0.1), (6, 0.05)]], "user_id long, churn_score double")
    got = {r.user_id: (r.score_rank, r.capacity_band) for r in bands_by_capacity(df, n_high=2, n_medium=3).collect()}
    assert got == {3: (1, "high"), 5: (2, "high"), 1: (3, "medium"), 2: (4, "medium"), 4: (5, "medium"), 6: (6, "low")}


def test_coding_history_last_n_ascending(spark):
    months = [d(2024, m, 1) for m in range(1, 8)]
    labels = spark.createDataFrame(
        [(1, m, float(i)) for i, m in enumerate(months)] + [(2, months[0], 9.0)], "user_id long, month_start date, avg_coding_hours double"
    )
    got = [(r.month, r.coding_hours) for r in W.coding_history(labels, user_id=1).collect()]
    assert got == [(months[4], 4.0), (months[5], 5.0), (months[6], 6.0)]  # default 3, oldest first
    assert len(W.coding_history(labels, user_id=1, months=100).collect()) == 7  # clamp to 24 keeps all 7
    assert len(W.coding_history(labels, user_id=1, months=0).collect()) == 1  # clamp to 1
    both = W.coding_history(labels, months=2).collect()
    assert sorted((r.user_id, r.month) for r in both) == [(1, months[5]), (1, months[6]), (2, months[0])]
    assert [r.month for r in both if r.user_id == 1] == [months[5], months[6]]  # ascending within the user


def test_alias_and_search(spark):
    df = spark.createDataFrame([("Europe",), ("emea",), ("APAC",)], "geo string")
    aliases = spark.createDataFrame([("europe", "EMEA")], "word string, canonical string")
    assert sorted(r.geo for r in W.alias_values(df, "geo", aliases).collect()) == ["APAC", "EMEA", "emea"]
    users = spark.createDataFrame([("USR-00123",), ("usr-99",), ("abc",)], "user_id string")
    assert sorted(r.user_id for r in W.search(users, "Usr").collect()) == ["USR-00123", "usr-99"]


def test_lapse_and_winback(spark):
    rows = [
        (d(2024, 1, 1), True, False, 0),
        (d(2024, 2, 1), True, True, 0),  # churns in Feb
        (d(2024, 3, 1), False, False, 0),
        (d(2024, 4, 1), False, False, 0),
        (d(2024, 5, 1), False, False, 0),
        (d(2024, 6, 1), False, False, 1),  # reactivates in June
        (d(2024, 7, 1), False, False, 0),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "user_id long, month_start date, at_risk boolean, churned boolean, reactivation_starts int")
    out = D.winback_eligible(D.lapse_state(df)).orderBy("month_start").collect()
    assert [r.lapsed for r in out] == [False, False, True, True, True, True, True]
    assert [r.winback_eligible for r in out] == [False, False, True, True, True, False, False]  # > 3 months, then reactivated


def test_campaign_dates(spark):
    defs = spark.createDataFrame([("a", 0, 3), ("b", 5, 3), ("c", 0, 1)], "campaign_id string, month_offset int, duration_months int")
    got = {
        r.campaign_id: (r.start_date, r.end_date, r.is_active_at_window_end)
        for r in D.campaign_dates(defs, d(2025, 1, 1), d(2025, 6, 15)).collect()
    }
    assert got == {
        "a": (d(2025, 1, 1), d(2025, 3, 31), False),
        "b": (d(2025, 6, 1), d(2025, 6, 15), True),
        "c": (d(2025, 1, 1), d(2025, 1, 31), False),
    }


def test_rolling_touches_window(spark):
    ts = dt.datetime
    log = spark.createDataFrame(
        [(1, ts(2024, 3, 31, 12)), (1, ts(2024, 3, 1, 12)), (1, ts(2024, 3, 1, 11)), (2, ts(2024, 1, 1))], "user_id long, logged_at timestamp"
    )
    got = {r.user_id: r.touches_30d for r in D.rolling_touches(log, ts(2024, 3, 31, 12)).collect()}
    assert got == {1: 2}  # 30 days back to 2024-03-01 12:00 inclusive
