"""What one task holds does not follow the table: many short rows are dealt over as many tasks as their number asks for."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from tidemark.operators import derive as D
from tidemark.plans import catalog
from tidemark.sources import fixtures
from tidemark.sources.fixtures import Tables

ROWS = 4_000


@pytest.mark.parametrize("view", ["at_risk", "labels_enriched", "churn_labels", "monthly_state"])
def test_user_months_are_dealt_by_their_number(spark, monkeypatch, view):
    monkeypatch.setattr(fixtures, "TASK_ROWS", ROWS)
    df = getattr(Tables(spark, SF_CHECK), view)()
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) > 10 * ROWS and max(sizes) <= 2 * ROWS


def test_few_users_with_many_months_do_not_share_a_task(spark):
    users = spark.range(200).selectExpr("id AS user_id", "DATE'1925-01-01' AS a", "DATE'2024-12-01' AS b").coalesce(1)
    spine = D.user_month_spine(users, "a", "b", partitions=20)
    sizes = [r["count"] for r in spine.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200 * 1200 and max(sizes) < sum(sizes) // 5


def test_at_risk_months_are_the_same_in_any_number_of_tasks(spark):
    d = dt.date
    terms = spark.createDataFrame(
        [(u, d(2025, 1 + u % 3, 5), d(2025, 6, 5) if u % 2 else None, u % 5 == 0) for u in range(40)],
        "user_id long, term_start_date date, term_end_date date, is_downgrade boolean",
    )
    bounds = spark.createDataFrame([(u, d(2025, 1, 1), d(2025, 9, 1)) for u in range(40)], "user_id long, a date, b date")
    spine = D.user_month_spine(bounds, "a", "b")
    plain = sorted(map(tuple, D.at_risk_months(terms, spine.unionByName(spine)).collect()))
    assert plain and sorted(map(tuple, D.at_risk_months(terms, spine, partitions=7).collect())) == plain


def test_adoption_counts_from_before_the_spine_and_keeps_repeated_months(spark):
    d = dt.date
    spine = spark.createDataFrame([(u, d(2025, m, 1)) for u in (1, 2) for m in (1, 2, 3)] + [(1, d(2025, 1, 1))], "user_id long, month_start date")
    days = spark.createDataFrame(
        [(1, "a", d(2024, 12, 3), 4), (1, "b", d(2025, 2, 5), 1), (1, "b", d(2025, 2, 6), 2), (2, "c", d(2025, 4, 5), 1), (None, "a", d(2025, 1, 1), 1), (2, None, d(2025, 1, 1), 1), (2, "a", None, 1)],
        "user_id long, feature_key string, date date, activations long",
    )
    usage = spark.createDataFrame([(1, d(2025, 2, 5)), (1, d(2025, 2, 6)), (1, d(2025, 2, 7)), (2, None)], "user_id long, event_date date")
    df = D.feature_adoption(usage, spine, days, partitions=3)
    got = sorted((r.user_id, r.month_start.month, r.feature_key, r.is_adopted, r.first_activation_date, r.activation_count, r.active_days, r.depth_score) for r in df.where("user_id = 1").collect())
    dec, feb = d(2024, 12, 1), d(2025, 2, 1)
    a = [(1, m, "a", True, dec, 0, 0, 0.0) for m in (1, 1, 2, 3)]
    b = [(1, 1, "b", False, None, 0, 0, 0.0)] * 2 + [(1, 2, "b", True, feb, 3, 2, 0.6667), (1, 3, "b", True, feb, 0, 0, 0.0)]
    assert [g for g in got if g[2] != "c"] == sorted(a + b)
    assert df.where("user_id = 2 AND NOT is_adopted").count() == df.where("user_id = 2").count() == 9


def test_the_feature_grid_is_never_shuffled(spark):
    df = Tables(spark, SF_CHECK).feature_adoption()
    plan = df._jdf.queryExecution().executedPlan().toString()
    top = plan.split("Generate posexplode")[0]
    assert "Generate posexplode" in plan and "Exchange" not in top and "Join" not in top


def test_active_days_are_those_with_any_feature(spark):
    d = dt.date
    spine = spark.createDataFrame([(1, d(2025, m, 1)) for m in (1, 2)], "user_id long, month_start date")
    rows = [(1, "a", d(2025, 1, 1), 2), (1, "a", d(2025, 1, 31), 1), (1, "b", d(2025, 1, 31), 5), (1, None, d(2025, 1, 9), 1), (1, "c", None, 1), (2, "b", d(2025, 2, 1), 1)]
    days = spark.createDataFrame(rows, "user_id long, feature_key string, date date, activations long")
    got = {(r.month_start.month, r.feature_key): (r.is_adopted, r.activation_count, r.active_days, r.depth_score) for r in D.feature_adoption(None, spine, days).collect()}
    none = (False, 0, 0, 0.0)
    assert got == {
        (1, "a"): (True, 3, 2, 0.6667), (1, "b"): (True, 5, 1, 0.3333), (1, "c"): none,
        (2, "a"): (True, 0, 0, 0.0), (2, "b"): (True, 0, 0, 0.0), (2, "c"): none,
    }


def test_all_plans_of_the_feature_grid_read_the_same_touches(spark, capsys):
    Tables(spark, SF_CHECK).feature_adoption().explain("formatted")
    plan = capsys.readouterr().out.split("\n")
    scans = [k for k, x in enumerate(plan) if "lineitem.parquet]" in x]
    read = {tuple(x for x in plan[k : k + 3] if x.startswith(("PushedFilters", "ReadSchema"))) for k in scans}
    assert len(scans) > 1 and len(read) == 1


def test_tables_that_refer_by_their_key_are_counted_in_place(spark):
    from tidemark.operators.integrity import Checked, integrity_report

    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    rows = [(1, "a", True), (1, "a", None), (1, "b", False), (3, "a", True), (None, "a", True), (None, "a", False)]
    held = spark.createDataFrame(rows, "user_id long, f string, good boolean")

    def tables(more):
        return [Checked("users", users, ["user_id"]), Checked("held", held, ["user_id", "f"], {"user_id": "users"}, {"good": "good"}, **more)]

    df = integrity_report(tables({}))
    got = {r.check_name: (r.bad, r.total) for r in df.collect()}
    assert got == {"fk held.user_id -> users.user_id": (1, 2), "pk users(user_id)": (0, 2), "pk held(user_id, f)": (2, 6), "good": (3, 6)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [user_id" in plan  # by key, below the records


def test_records_are_made_per_reference_not_per_key(spark):
    from tidemark.operators.integrity import Checked, integrity_report

    users = spark.createDataFrame([(u,) for u in range(5)], "user_id long")
    held = spark.range(5_000).selectExpr("id % 5 AS user_id", "id DIV 5 AS place", "id % 7 > 0 AS good")
    df = integrity_report([Checked("users", users, ["user_id"]), Checked("held", held.unionByName(held.where("place = 0 AND user_id < 3")), ["user_id", "place"], {"user_id": "users"}, {"good": "good"})])
    got = {r.check_name: (r.bad, r.total) for r in df.collect()}
    broken = sum(k % 7 == 0 for k in range(5_000)) + 1
    assert got == {"fk held.user_id -> users.user_id": (0, 5), "pk users(user_id)": (0, 5), "pk held(user_id, place)": (3, 5_003), "good": (broken, 5_003)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[user_id#\d+L\],", plan)  # the keys of a user, below the records
    assert "lambdafunction" not in plan  # records are made by compiled code


def test_score_areas_keeps_the_dealing_of_the_user_months(spark):
    # a join by user and month would deal them anew, into the session's fixed number of tasks
    plan = catalog.queries()["score_areas"](spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert not re.findall(r"hashpartitioning\(user_id#\d+L?, (?:month_start|as_of_month)#\d+, \d+\), ENSURE_REQUIREMENTS", plan)
