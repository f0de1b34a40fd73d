"""Quality checks, sinks, sync and streaming (planted violations, restarts)."""

import datetime as dt
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators import reports as R
from tidemark.operators import worklist as W
from tidemark.plans import specs as S
from tidemark.sources import io as IO
from tidemark.streaming import ingest as I

d = dt.date


def _scratch():
    return tempfile.mkdtemp(prefix="tidemark-test-")


def test_expectation_null_is_violation(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 9.0)], "ticket_id long, csat_score double")
    rep = {r.rule: r for r in I.expectation_counts(
        df, {}, {"tolerant": "csat_score IS NULL OR csat_score BETWEEN 1 AND 5", "strict": "csat_score BETWEEN 1 AND 5"}
    ).collect()}
    assert (rep["tolerant"].passed, rep["tolerant"].failed) == (2, 1)
    assert (rep["strict"].passed, rep["strict"].failed) == (1, 2)


def test_drop_expectation_filters(spark):
    df = spark.createDataFrame([(1,), (None,)], "user_id long")
    assert I.apply_expectations(df, {"valid_user": "user_id IS NOT NULL"}, {}).count() == 1


def test_pk_and_fk(spark):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (9, "c")], "id long, v string")
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    assert Q.pk_duplicates(child, ["id"]).first().duplicate_rows == 1  # rows beyond the first per key
    r = Q.fk_orphans(child, parent, "id").first()
    assert (r.orphan_keys, r.child_keys) == (1, 3)


def test_uncovered_matches_brute_force(spark):
    terms = spark.createDataFrame(
        [(1, d(2025, 1, 1), d(2025, 1, 31)), (1, d(2025, 3, 1), None), (2, d(2025, 2, 1), d(2025, 2, 10)),
         (2, d(2025, 2, 5), d(2025, 2, 20))],
        "user_id long, term_start_date date, term_end_date date",
    )
    days = [d(2024, 12, 31), d(2025, 1, 1), d(2025, 1, 31), d(2025, 2, 1), d(2025, 2, 15), d(2025, 2, 21), d(2025, 3, 1), d(2026, 1, 1)]
    pts = spark.createDataFrame([(i, u, x) for i, (u, x) in enumerate((u, x) for u in (1, 2, 3) for x in days)],
                                "touch_id long, user_id long, touch_date date")
    got = {r.touch_id for r in Q.uncovered(pts, terms).collect()}
    tl = terms.collect()

    def covered(u, x):
        return any(t.user_id == u and t.term_start_date <= x and (t.term_end_date is None or x <= t.term_end_date) for t in tl)

    exp = {r.touch_id for r in pts.collect() if not covered(r.user_id, r.touch_date)}
    assert got == exp


def test_events_after_cancel_excludes_reactivated(spark):
    terms = spark.createDataFrame(
        [(1, d(2025, 1, 31), False), (2, d(2025, 1, 31), False), (2, None, True)],
        "user_id long, cancel_date date, is_reactivation boolean",
    )
    ev = spark.createDataFrame([(1, d(2025, 2, 1)), (1, d(2025, 1, 5)), (2, d(2025, 3, 1))], "user_id long, event_date date")
    assert [tuple(r) for r in Q.events_after_cancel(ev, terms).collect()] == [(1, d(2025, 2, 1))]


def test_conform(spark):
    spec = S.Table("t", "a BIGINT NOT NULL, b BOOLEAN NOT NULL, c STRING")
    ok = spark.createDataFrame([(1, None, None)], "a long, b boolean, c string")
    assert Q.conform(ok, spec).first().b is False  # NULL bool -> FALSE before the NOT NULL check
    with pytest.raises(Q.ConformError):
        Q.conform(spark.createDataFrame([(1, True)], "a long, b boolean"), spec)  # missing
    with pytest.raises(Q.ConformError):
        Q.conform(spark.createDataFrame([(1, True, "x", 1)], "a long, b boolean, c string, d int"), spec)  # extra
    with pytest.raises(Q.ConformError):
        Q.conform(spark.createDataFrame([(None, True, "x")], "a long, b boolean, c string"), spec)  # NULL in NOT NULL


def test_ddl_and_comment_coverage(spark):
    ddl = S.render_ddl()
    assert "CREATE TABLE IF NOT EXISTS retention.silver.churn_labels" in ddl and "PARTITIONED BY (month_start)" in ddl
    df = spark.createDataFrame([], S.LABELS.schema)
    r = Q.comment_coverage(df).first()
    assert r.commented == r.columns == len(S.LABELS.schema)


def test_highwater_append_cycle(spark):
    target = os.path.join(_scratch(), "t")
    src = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert IO.append_above_watermark(src, target) == 2
    src2 = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, v string")
    assert IO.append_above_watermark(src2, target) == 2
    assert IO.append_above_watermark(src2, target) == 0
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4]


def test_upsert_same_key_twice(spark):
    base = spark.createDataFrame([(1, "old", 1)], "k long, v string, ts long")
    upd = spark.createDataFrame([(1, "mid", 2), (1, "new", 3), (2, "x", 1)], "k long, v string, ts long")
    got = sorted(tuple(r) for r in IO.upsert_latest(base, upd, ["k"], "ts").collect())
    assert got == [(1, "new", 3), (2, "x", 1)]


def test_snapshot_publish_is_pointer_swap(spark):
    target = os.path.join(_scratch(), "snap")
    IO.publish_snapshot(spark.createDataFrame([(1, "a")], "k long, v string"), target, "k")
    IO.publish_snapshot(spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"), target, "k")
    assert sorted(tuple(r) for r in IO.read_snapshot(spark, target).collect()) == [(1, "b"), (2, "c")]
    with pytest.raises(ValueError):
        IO.publish_snapshot(spark.createDataFrame([(1, "b"), (1, "c")], "k long, v string"), target, "k")
    assert IO.read_snapshot(spark, target).count() == 2  # rejected publish left the old version


def test_digest_order_insensitive(spark):
    a = spark.range(100).withColumn("v", F.col("id") * 3)
    r = IO.compare_digests(IO.content_digest(a, "x"), IO.content_digest(a.orderBy(F.desc("id")).repartition(5), "x")).first()
    assert r.same is True
    r2 = IO.compare_digests(IO.content_digest(a, "x"), IO.content_digest(a.filter("id > 0"), "x")).first()
    assert r2.same is False


def test_streaming_rerun_adds_nothing(spark):
    from tidemark.streaming.tables import USAGE_EVENTS

    root = _scratch()
    land = f"{root}/landing"
    spark.createDataFrame(
        [(1, 5.0, 0.5, 3, d(2025, 1, 1)), (None, 1.0, 0.2, 1, d(2025, 1, 1)), (2, 30.0, 0.1, 2, d(2025, 1, 2))],
        "user_id long, coding_hours double, ai_suggestion_acceptance_rate double, session_frequency long, event_date date",
    ).write.partitionBy("event_date").parquet(land)
    I.run_pipeline(spark, USAGE_EVENTS, land, root)
    I.run_pipeline(spark, USAGE_EVENTS, land, root)
    silver = spark.read.parquet(f"{root}/silver/usage_events").drop("batch_id")
    assert silver.count() == 2  # NULL user dropped once, rerun added nothing
    assert set(silver.columns) == {"user_id", "event_date", "coding_hours", "ai_acceptance_rate", "session_frequency"}
    bronze = spark.read.parquet(f"{root}/bronze/usage_events")
    assert bronze.count() == 3 and "_source_file" in bronze.columns
    m = {r.rule: r.failed for r in spark.read.parquet(f"{root}/metrics/usage_events").collect()}
    assert m["valid_user"] == 1 and m["valid_hours"] == 1


def test_do_now_30_day_exclusion(spark):
    serving = spark.createDataFrame(
        [(u, "g", "p", "plan", 10.0 * u, True, 1.0, 0) for u in (1, 2, 3)],
        "user_id long, geo string, persona string, plan string, mrr_usd double, is_currently_subscribed boolean, "
        "coding_hours_trend_30d double, crm_touches_30d long",
    )
    pred = spark.createDataFrame([(u, 0.9, "high") for u in (1, 2, 3)], "user_id long, churn_score double, churn_risk_band string")
    now = dt.datetime(2025, 6, 30)
    log = spark.createDataFrame([(2, now - dt.timedelta(days=29)), (3, now - dt.timedelta(days=31))], "user_id long, logged_at timestamp_ntz")
    got = sorted(r.user_id for r in W.do_now(pred, serving, log=log, as_of=now).collect())
    assert got == [1, 3]


def test_trend_buckets_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 0.500001, 1.0, 1.25, 5.0, 11.0)], "t double")
    got = [r[0] for r in df.select(R.trend_bucket("t")).collect()]
    assert got == ["<=0.50 (collapsing)", "0.50-0.75 (steep decline)", "0.90-1.00 (flat/slight dip)", "1.00-1.25 (growing)",
                   ">1.25 (surging)", None]


def test_append_log_ids_are_dense_with_payload(spark):
    target = os.path.join(_scratch(), "log")
    for k in range(2):
        ev = spark.range(30_000).selectExpr("xxhash64(id) AS at", "id AS note")
        IO.append_log(ev, target, order=["at"])
    ids = spark.read.parquet(target).selectExpr("count(DISTINCT id) d", "count(*) n", "max(id) m").first()
    assert tuple(ids) == (60_000, 60_000, 60_000)


def test_labels_declaration_fits_the_table(spark, sf_small):
    from tidemark.sources.fixtures import Tables

    Q.conform(Tables.of(spark, sf_small).churn_labels(), S.LABELS)
