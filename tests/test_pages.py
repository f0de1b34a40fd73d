"""Both pages of the worklist come from one written worklist, and its exchanges do not stay on disk."""

from conftest import SF_SMALL
from tidemark.operators import worklist as wl
from tidemark.plans import catalog
from tidemark.plans import queries_core as Q
from tidemark.sources.fixtures import Tables

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_views_read_the_written_months_and_latest_labels(spark, tmp_path, capsys):
    plain, t = Tables(spark, SF_SMALL), Tables(spark, SF_SMALL)
    for view in ("terms", "touch_months", "latest_labels"):
        getattr(t, view)().write.parquet(f"{tmp_path}/{view}")
        t.written(view, f"{tmp_path}/{view}")
    for view in ("predictions", "serving", "labels_enriched"):
        a, b = getattr(plain, view)(), getattr(t, view)()
        b.explain("formatted")
        assert "lineitem.parquet" not in capsys.readouterr().out
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.schema == b.schema


def test_pages_read_one_written_worklist(spark, monkeypatch, capsys):
    during = []
    rows = wl.worklist_rows

    def seen(*args, **more):
        during.append(spark.conf.get(KEY, None))
        return rows(*args, **more)

    monkeypatch.setattr(wl, "worklist_rows", seen)
    before = spark.conf.get(KEY, None)
    page = catalog.queries()["worklist_page"](spark, SF_SMALL)
    assert during == ["true"] and spark.conf.get(KEY, None) == before
    page.explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "orders.parquet" not in plan
    t = Tables(spark, SF_SMALL)
    whole = rows(t.predictions(), t.serving()).orderBy(Q.F.col("score").desc(), "user_id").collect()
    assert page.collect() == whole[50:100] and len(whole) > 50
