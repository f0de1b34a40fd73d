"""What lands is made once, and its exchanges do not stay on disk."""

import os

from conftest import SF_SMALL
from tidemark.plans import queries_ops as Q
from tidemark.session import shuffles_dropped
from tidemark.sources.fixtures import Tables

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_views_read_the_touches_that_landed(spark, tmp_path, capsys):
    plain, t = Tables(spark, SF_SMALL), Tables(spark, SF_SMALL)
    for name in ("touches", "subscriptions"):
        getattr(plain, name)().write.parquet(f"{tmp_path}/{name}")
        t.written(name, f"{tmp_path}/{name}")
    for view in ("feature_adoption", "churn_labels"):
        a, b = getattr(plain, view)(), getattr(t, view)()
        b.explain("formatted")
        assert "lineitem.parquet" not in capsys.readouterr().out
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.schema == b.schema


def test_landing_drops_its_exchanges(spark, tmp_path, monkeypatch):
    during = []
    monkeypatch.setattr(Q, "_land_usage", lambda s, sf, to: during.append(s.conf.get(KEY)))
    before = spark.conf.get(KEY, None)
    folders = Q._land_all(spark, SF_SMALL, str(tmp_path))
    assert during == ["true"] and spark.conf.get(KEY, None) == before
    for spec, folder in folders.items():
        if spec.name != "usage_events":
            assert any(f.endswith(".zstd.parquet") for f in os.listdir(folder)), spec.name


def test_the_setting_is_put_back_after_a_failure(spark):
    for value in ("false", "true"):
        spark.conf.set(KEY, value)
        try:
            with shuffles_dropped(spark):
                assert spark.conf.get(KEY) == "true"
                raise ValueError
        except ValueError:
            pass
        assert spark.conf.get(KEY) == value
    spark.conf.unset(KEY)


def test_bronze_leaves_the_long_path_to_the_codec(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from tidemark.streaming import ingest
    from tidemark.streaming.tables import USERS

    spark.range(5_000).selectExpr("id % 5 AS user_id", "'ASIA' AS geo").write.parquet(f"{tmp_path}/in")
    keys = ("parquet.page.row.count.limit", "parquet.size.statistics.enabled", "parquet.enable.dictionary#_source_file", "parquet.column.statistics.enabled#_source_file")
    before = [spark.conf.get(k, None) for k in keys]
    ingest.start_bronze(spark, USERS, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    assert [spark.conf.get(k, None) for k in keys] == before
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.user_id, r["count"]) for r in found.where("geo = 'ASIA'").groupBy("user_id").count().collect()) == [(u, 1_000) for u in range(5)]
    assert found.where("_source_file IS NULL OR _ingested_at IS NULL").isEmpty()
    for file in glob.glob(f"{tmp_path}/out/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert all(c.compression == "ZSTD" for c in columns.values())
        assert not any("DICTIONARY" in e for e in columns["_source_file"].encodings) and columns["user_id"].has_dictionary_page


def test_the_check_report_reads_written_touches_and_terms(spark, capsys):
    from tidemark.plans import catalog

    before = spark.conf.get(KEY, None)
    catalog.queries()["check_report"](spark, SF_SMALL).explain("formatted")
    plan = capsys.readouterr().out
    assert "lineitem.parquet" not in plan and "/touches" in plan and "/terms" in plan and spark.conf.get(KEY, None) == before
