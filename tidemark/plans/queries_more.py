"""Entries of single operators that other queries use inside larger answers
(P6-P9, M4, M8, M10, S5, S8, U3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.columns import coerce_num, norm_band, severity, trend_direction, trend_label
from tidemark.operators import ml as M
from tidemark.plans import specs as S
from tidemark.plans.catalog import register
from tidemark.plans.metrics import current_view, monthly_view
from tidemark.plans.oracle import xm
from tidemark.sources import io as IO
from tidemark.sources.fixtures import Tables


def _t(spark, sf):
    return Tables.of(spark, sf)


def _scratch(spark, name):
    from tidemark.session import scratch_path

    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


# Bands as they come from outside: other case, unknown words, missing ones.
_LOOSE_BAND = "CASE user_id % 5 WHEN 0 THEN upper(churn_risk_band) WHEN 1 THEN 'unknown' WHEN 2 THEN NULL ELSE churn_risk_band END"


@register(
    "band_normalisation",
    f"""SELECT user_id, CASE WHEN lower(b) IN ('high', 'medium', 'low') THEN lower(b) ELSE 'low' END AS band
       FROM (SELECT user_id, {_LOOSE_BAND} AS b FROM fx_predictions) z""",
)
def band_normalisation(spark, sf):
    """P6."""
    return _t(spark, sf).predictions().select("user_id", norm_band(F.expr(_LOOSE_BAND)).alias("band"))


# Numbers as they come from outside: empty, words, blanks.
_LOOSE_NUMBER = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL ELSE regexp_extract(props, '[0-9]+', 0) END"


@register(
    "number_coercion",
    f"SELECT event_id, coalesce(try_cast(x AS DOUBLE), CAST(-1 AS DOUBLE)) AS number FROM (SELECT event_id, {_LOOSE_NUMBER} AS x FROM events) z",
)
def number_coercion(spark, sf):
    """P7, over every event."""
    return _t(spark, sf).raw("events").select("event_id", coerce_num(F.expr(_LOOSE_NUMBER), -1).alias("number"))


@register(
    "trend_markers",
    """SELECT user_id, month_start, CASE WHEN r < 0.97 THEN 'dn' WHEN r > 1.03 THEN 'up' ELSE 'flat' END AS direction,
              CASE WHEN r BETWEEN 0.97 AND 1.03 THEN 'flat' ELSE CAST(CAST(abs(round((r - 1.0) * 100)) AS BIGINT) AS VARCHAR) || '%' END AS magnitude
       FROM (SELECT user_id, month_start, CAST(coding_hours_trend_30d AS DOUBLE) AS r FROM fx_labels_e) z""",
)
def trend_markers(spark, sf):
    """P8."""
    r = "coding_hours_trend_30d"
    return _t(spark, sf).labels_enriched().select("user_id", "month_start", trend_direction(r).alias("direction"), trend_label(r).alias("magnitude"))


@register(
    "region_severity",
    """SELECT geo, churn_pct, CASE WHEN churn_pct >= 3.7 THEN 'high' WHEN churn_pct >= 3.3 THEN 'medium' ELSE 'low' END AS severity
       FROM (SELECT geo, ((2 * 10000 * count_if(churned) + count(*)) // (2 * count(*))) / 100.0 AS churn_pct FROM fx_cl GROUP BY geo) z""",
)
def region_severity(spark, sf):
    """Churn percent of a region's at-risk months, exact half-up."""
    from tidemark.functions.columns import half_up_ratio

    pct = half_up_ratio(F.count_if("churned") * 10_000, F.count(F.lit(1))) / F.lit(100.0)
    return _t(spark, sf).churn_labels().groupBy("geo").agg(pct.alias("churn_pct")).withColumn("severity", severity("churn_pct"))


@register(
    "monthly_engagement",
    f"""SELECT month_start AS month, is_power_user_month, {xm("avg_coding_hours", 3)} AS avg_coding_hours,
              {xm("coding_hours_trend_30d", 4)} AS avg_coding_trend, {xm("avg_acceptance_rate", 4)} AS avg_acceptance_rate
       FROM fx_cl GROUP BY month_start, is_power_user_month""",
)
def monthly_engagement(spark, sf):
    """M4 through the metric view, with its power-user dimension."""
    measures = {"Avg coding hours": "avg_coding_hours", "Avg coding hours trend": "avg_coding_trend", "Avg acceptance rate": "avg_acceptance_rate"}
    return monthly_view(_t(spark, sf).churn_labels()).query(measures, by={"Month": "month", "Is power user month": "is_power_user_month"})


@register(
    "current_averages",
    f"""SELECT geo, round(sum(mrr_usd), 2) AS total_mrr, {xm("churn_score", 4)} AS avg_churn_score, {xm("coding_hours_trend_30d", 4)} AS avg_coding_trend,
              {xm("avg_acceptance_rate", 4)} AS avg_acceptance_rate, {xm("avg_session_frequency", 3)} AS avg_sessions
       FROM fx_current GROUP BY geo""",
)
def current_averages(spark, sf):
    """M8 and M10 through the current metric view, per region."""
    t = _t(spark, sf)
    measures = {
        "Total MRR": "total_mrr", "Avg churn score": "avg_churn_score", "Avg coding hours trend": "avg_coding_trend",
        "Avg acceptance rate": "avg_acceptance_rate", "Avg session frequency": "avg_sessions",
    }
    out = current_view(t.serving(), t.predictions()).query(measures, by={"Geo": "geo"})
    return out.withColumn("total_mrr", F.round("total_mrr", 2))


@register("table_scan", "SELECT touch_id, user_id, touch_date, cost_usd FROM fx_touches")
def table_scan(spark, sf):
    """A written table read with its declared schema, four of its columns."""
    path = _scratch(spark, "touches")
    _t(spark, sf).touches().write.parquet(path)
    return IO.read_table(spark, path, S.TOUCHES, ["touch_id", "user_id", "touch_date", "cost_usd"])


@register("table_overwrite", "SELECT campaign_id, objective, budget_usd, offers > 40 AS is_large FROM fx_campaigns")
def table_overwrite(spark, sf):
    """A table is replaced by one with other columns; readers see only the new schema."""
    path = _scratch(spark, "campaigns")
    c = _t(spark, sf).campaigns()
    IO.overwrite(c, path)
    IO.overwrite(c.select("campaign_id", "objective", "budget_usd", (F.col("offers") > 40).alias("is_large")), path)
    return spark.read.parquet(path)


@register(
    "feature_contract",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(count({f}) AS BIGINT) AS present, CAST(count(*) AS BIGINT) AS rows FROM fx_cl" for f in M.FEATURES),
)
def feature_contract(spark, sf):
    """The model's features, all of them in the labels and none a leakage column, with how many rows have each."""
    labels = _t(spark, sf).churn_labels()
    M.assert_feature_contract(labels.schema)
    one = labels.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f).alias(f) for f in M.FEATURES])
    found = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("present")) for f in M.FEATURES])
    return one.select("rows", F.explode(found).alias("x")).select("x.feature", "x.present", "rows")
