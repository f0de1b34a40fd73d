"""The shared-scan integrity report on planted violations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.integrity import Checked, integrity_report

D = lambda day: dt.date(2025, 1, day)


def tables(spark):
    users = spark.createDataFrame([(1,), (2,), (3,), (3,)], "user_id long")
    terms = spark.createDataFrame(
        [
            (10, 1, D(1), D(5), D(5), False), (11, 1, D(5), None, None, True), (12, 2, D(3), D(6), D(6), False), (13, 9, D(1), None, None, False),
            (14, None, D(1), None, None, False),
        ],
        "term_id long, user_id long, s date, e date, c date, react boolean",
    )
    usage = spark.createDataFrame(
        [(1, D(9), 1.0), (2, D(6), 1.0), (2, D(7), 1.0), (2, D(8), 99.0), (2, D(8), None), (3, D(1), 1.0)], "user_id long, day date, hours double"
    )
    tickets = spark.createDataFrame([("a", 1, D(5)), ("b", 2, D(2)), ("c", 2, D(6)), ("c", 2, D(7)), ("d", 3, D(1))], "ticket string, user_id long, day date")
    touches = spark.createDataFrame([(1, 1, "x", True), (2, 1, "x", True), (3, 2, "y", False), (4, 8, None, None)], "touch long, user_id long, brand string, back boolean")
    brands = spark.createDataFrame([("x",)], "brand string")
    user = {"user_id": "users"}
    return [
        Checked("users", users, ["user_id"]),
        Checked("terms", terms, ["term_id"], user, dated=[{"day": "s", "starts": F.lit(1), "cancel": "c", "reactivations": "react"}, {"day": "e", "ends": "e IS NOT NULL"}]),
        Checked("usage", usage, ["user_id", "day"], user, {"hours": "hours BETWEEN 0 AND 16"}, dated=[{"day": "day", "usage": F.lit(1)}]),
        Checked("tickets", tickets, ["ticket"], user, dated=[{"day": "day", "tickets": F.lit(1)}]),
        Checked("touches", touches, ["touch"], {**user, "brand": "brands"}, rate=("back rate", "back", 0.5, 0.1), dated=[{"day": F.lit(D(1)), "reactivated": "back"}]),
        Checked("brands", brands, ["brand"]),
    ]


def test_planted_violations(spark):
    got = {r.check_name: (r.bad, r.total, r.ok) for r in integrity_report(tables(spark)).collect()}
    assert got == {
        "fk terms.user_id -> users.user_id": (1, 3, False),  # 9; the null refers to nothing
        "fk usage.user_id -> users.user_id": (0, 3, True),
        "fk tickets.user_id -> users.user_id": (0, 3, True),
        "fk touches.user_id -> users.user_id": (1, 3, False),
        "fk touches.brand -> brands.brand": (1, 2, False),
        "pk users(user_id)": (1, 4, False),
        "pk terms(term_id)": (0, 5, True),
        "pk usage(user_id, day)": (1, 6, False),
        "pk tickets(ticket)": (1, 5, False),
        "pk touches(touch)": (0, 4, True),
        "pk brands(brand)": (0, 1, True),
        "hours": (2, 6, False),
        "back rate": (0, 4, True),
        "usage after the last cancel": (3, 4, False),  # user 2 on the 7th and 8th; user 1 came back
        "tickets inside a term": (3, 5, False),  # b, the second c, and d
        "reactivated touches = reactivation terms": (1, 2, False),
        "reactivations per user <= 1": (1, 1, False),
    }


def test_empty_tables(spark):
    empty = [Checked(t.name, t.df.limit(0), t.keys, t.refs, t.rules, t.rate, t.dated) for t in tables(spark)]
    assert integrity_report(empty).collect() == []  # nothing to count


def test_wide_and_mixed_keys(spark):
    rows = [(1, 2, "a"), (1, 2, "a"), (1, 3, "a"), (1, None, "a"), (1, None, "a")]
    t = Checked("pairs", spark.createDataFrame(rows, "a long, b long, c string"), ["a", "b", "c"])
    assert [tuple(r) for r in integrity_report([t]).collect()] == [("pk pairs(a, b, c)", 2, 5, False)]
    with pytest.raises(ValueError):
        integrity_report([Checked("pairs", t.df, ["a"], rules={str(i): "true" for i in range(4)})])


def test_each_table_is_scanned_once(spark, tmp_path):
    checked = []
    for t in tables(spark):
        t.df.write.parquet(f"{tmp_path}/{t.name}")
        checked.append(Checked(t.name, spark.read.parquet(f"{tmp_path}/{t.name}"), t.keys, t.refs, t.rules, t.rate, t.dated))
    plan = integrity_report(checked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(checked)
