"""Eight-table ingest: rules, observed counts, restarts, bounded micro-batches."""

import datetime as dt

from tidemark.plans import specs as S
from tidemark.streaming import ingest as I
from tidemark.streaming import tables as IT


def test_specs_cover_the_declared_tables(spark):
    assert {s.name for s in IT.INGEST_SPECS} == set(S.TABLES)
    for t in S.TABLES.values():
        assert [(n, k.lower(), c) for n, k, c in t.columns] == [(f.name, f.dataType.simpleString(), f.metadata["comment"]) for f in t.schema]
    assert sum(len(s.expect_drop) for s in IT.INGEST_SPECS) == 8
    assert sum(len(s.expect_keep) for s in IT.INGEST_SPECS) >= 15
    for spec in IT.INGEST_SPECS:
        assert all(f.metadata.get("comment") for f in spec.silver_schema().fields), spec.name


def tickets(spark, rows):
    fields = "ticket_id long, user_id long, created_date date, channel string, category string, chat_message_count long, resolution_hours double, is_escalated boolean, csat_score double"
    return spark.createDataFrame(rows, fields)


def row(ticket, channel="email", hours=1.0, csat=3.0):
    return (ticket, 7, dt.date(2025, 1, 1), channel, "billing", 1, hours, False, csat)


def metrics(spark, paths):
    rows = spark.read.parquet(f"{paths['metrics']}/batch_id=*").groupBy("rule").sum("passed", "failed").collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def test_rules_are_counted_over_many_batches_and_restarts(spark, tmp_path):
    spec, root, landing = IT.SUPPORT_TICKETS, str(tmp_path), f"{tmp_path}/landing"
    rows = [row(1), row(None, csat=9.0), row(2, csat=None), row(3, channel="fax"), row(4, hours=-1.0), row(5, hours=None)]
    for r in rows:
        tickets(spark, [r]).coalesce(1).write.mode("append").parquet(landing)
    bronze, silver, found = (f"{root}/{x}" for x in ("bronze", "silver", "metrics"))
    I.start_bronze(spark, spec, landing, bronze, f"{root}/c1").awaitTermination()
    I.start_silver(spark, spec, bronze, silver, f"{root}/c2", found, max_bytes=1).awaitTermination()
    batches = {r[0] for r in spark.read.parquet(silver).select("batch_id").distinct().collect()}
    assert len(batches) > 1
    want = {"valid_ticket": (5, 1), "valid_csat": (5, 1), "valid_resolution": (4, 2), "csat_answered": (4, 2), "valid_channel": (5, 1)}
    assert metrics(spark, {"metrics": found}) == want
    # new files, and a restart without any
    tickets(spark, [row(6), row(None)]).coalesce(1).write.mode("append").parquet(landing)
    for _ in range(2):
        I.start_bronze(spark, spec, landing, bronze, f"{root}/c1").awaitTermination()
        I.start_silver(spark, spec, bronze, silver, f"{root}/c2", found).awaitTermination()
    got = sorted(r[0] for r in spark.read.parquet(silver).select("ticket_id").collect())
    assert got == [1, 2, 3, 4, 5, 6]
    assert metrics(spark, {"metrics": found})["valid_ticket"] == (6, 2)


def test_a_replayed_batch_replaces_its_own(spark, tmp_path):
    spec = IT.SUPPORT_TICKETS
    df = tickets(spark, [row(1), row(None)]).selectExpr(*spec.projection())
    for _ in range(2):
        I.write_observed(df, spec, f"{tmp_path}/silver", f"{tmp_path}/metrics", 4)
    assert spark.read.parquet(f"{tmp_path}/silver").count() == 1
    assert metrics(spark, {"metrics": f"{tmp_path}/metrics"})["valid_ticket"] == (1, 1)


def test_batch_and_stream_specs_side_by_side(spark, tmp_path):
    landing = {IT.SUPPORT_TICKETS: f"{tmp_path}/l/t", IT.CRM_CAMPAIGNS: f"{tmp_path}/l/c"}
    tickets(spark, [row(1), row(2)]).write.parquet(landing[IT.SUPPORT_TICKETS])
    spark.createDataFrame([("a", "winback", 3, 1.0), (None, "x", 1, -1.0)], "campaign_id string, objective string, offers long, budget_usd double").write.parquet(
        landing[IT.CRM_CAMPAIGNS]
    )
    assert IT.CRM_CAMPAIGNS.mode == "batch"
    for _ in range(2):
        paths = I.run_pipelines(spark, landing, str(tmp_path))
    assert spark.read.parquet(paths["support_tickets"]["silver"]).count() == 2
    assert [r.campaign_id for r in spark.read.parquet(paths["crm_campaigns"]["silver"]).collect()] == ["a"]
    assert metrics(spark, paths["crm_campaigns"]) == {"valid_campaign": (1, 1), "valid_budget": (1, 1), "valid_objective": (1, 1)}
    bronze = spark.read.parquet(paths["crm_campaigns"]["bronze"])
    assert bronze.where("_source_file IS NOT NULL AND _ingested_at IS NOT NULL").count() == 2


def test_an_empty_batch_counts_nothing(spark, tmp_path):
    spec = IT.SUPPORT_TICKETS
    I.write_observed(tickets(spark, []).selectExpr(*spec.projection()), spec, f"{tmp_path}/s", f"{tmp_path}/m", 0)
    assert metrics(spark, {"metrics": f"{tmp_path}/m"})["valid_ticket"] == (0, 0)


def test_outcomes(spark):
    rows = [(False, True, True, True, True), (True, True, True, True, False), (True, True, False, False, True), (True, True, False, False, False), (True, False, False, False, False)]
    df = spark.createDataFrame(rows, "delivered boolean, opened boolean, clicked boolean, reactivated boolean, unsubscribed boolean")
    assert [r[0] for r in df.selectExpr(IT.OUTCOME).collect()] == ["no_response", "reactivated", "unsubscribed", "engaged_no_conversion", "no_response"]


# ---------------------------------------------------------------- keyed table


def files(path):
    import os

    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def updates(spark, rows):
    return spark.createDataFrame(rows, "user_id long, last_touch long, note string")


def contents(table, spark):
    return sorted(map(tuple, table.read(spark).select("user_id", "last_touch", "note").collect()))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    from tidemark.streaming.keyed import KeyedTable

    table = KeyedTable(f"{tmp_path}/t", buckets=4)
    assert table.read(spark) is None
    table.merge(updates(spark, [(i, 10, "a") for i in range(40)] + [(None, 99, "x")]), 0)
    before = files(table.path)
    touched = table.merge(updates(spark, [(7, 20, "b"), (7, 15, "c"), (100, 1, "new")]), 1)
    assert 0 < len(touched) < 4
    kept = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert kept and kept <= files(table.path)
    rewritten = files(table.path) - before
    assert all("v=1/" in f and any(f"bucket={b}/" in f for b in touched) for f in rewritten)
    assert contents(table, spark) == sorted([(i, 10, "a") for i in range(40) if i != 7] + [(7, 20, "b"), (100, 1, "new")])


def test_replays_older_updates_and_expiry(spark, tmp_path):
    from tidemark.streaming.keyed import KeyedTable

    table = KeyedTable(f"{tmp_path}/t", buckets=2, keep=2)
    for batch in range(6):
        table.merge(updates(spark, [(i, 10 + batch, "a") for i in range(20)]), batch)
        assert table.merge(updates(spark, [(1, 999, "replayed")]), batch) == []
    table.merge(updates(spark, [(3, 1, "late")]), 6)
    table.merge(updates(spark, []), 7)
    assert contents(table, spark) == [(i, 15, "a") for i in range(20)]
    versions = {f.split("/v=")[1].split("/")[0] for f in files(table.path)}
    assert versions <= {"5", "6"}  # all earlier ones were replaced twice over
    # a batch that failed before its manifest leaves a folder, which is written anew
    updates(spark, [(1, 5, "half")]).write.parquet(f"{table.path}/v=8/bucket=0")
    table.merge(updates(spark, [(1, 50, "z")]), 8)
    assert contents(table, spark)[1] == (1, 50, "z") and len(contents(table, spark)) == 20


def test_equal_times_have_one_winner(spark, tmp_path):
    from tidemark.streaming.keyed import KeyedTable

    for n, rows in enumerate(([(1, 5, "a"), (1, 5, "b")], [(1, 5, "b"), (1, 5, "a")])):
        table = KeyedTable(f"{tmp_path}/{n}", buckets=1)
        table.merge(updates(spark, rows).repartition(2), 0)
        assert contents(table, spark) == [(1, 5, "b")]


def test_a_stream_restarts_where_it_was(spark, tmp_path):
    from tidemark.streaming.keyed import KeyedTable, start_upserts

    table = KeyedTable(f"{tmp_path}/t", buckets=2)
    for batch in range(3):
        updates(spark, [(i, batch, "s") for i in range(5 + batch)]).write.parquet(f"{tmp_path}/in/{batch}")
        stream = spark.readStream.schema("user_id long, last_touch long, note string").parquet(f"{tmp_path}/in/*")
        start_upserts(stream, table, f"{tmp_path}/c").awaitTermination()
    start_upserts(stream, table, f"{tmp_path}/c").awaitTermination()
    assert contents(table, spark) == [(i, 2, "s") for i in range(7)]
