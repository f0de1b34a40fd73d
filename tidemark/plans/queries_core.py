"""Serving snapshot, certified metrics (G1-G10, G25), worklists and table
functions (U1, U2, K1-K3, P2-P4)."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from tidemark.operators import worklist as wl
from tidemark.plans.catalog import register
from tidemark.plans.oracle import xm
from tidemark.functions.columns import clean_text, exact_mean
from tidemark.plans.metrics import current_view, kpi_header, latest_period, monthly_view
from tidemark.session import scratch_path, shuffles_dropped
from tidemark.sources.fixtures import Tables

# Fixed parameters of the registered queries.
TPCH_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _t(spark, sf):
    return Tables.of(spark, sf)


# --------------------------------------------------------------------- D16


@register("serving_snapshot", "SELECT * FROM fx_serving")
def serving_snapshot(spark, sf):
    return _t(spark, sf).serving()


# ------------------------------------------------------------- G1 .. G3


@register(
    "churn_rate_latest",
    f"""SELECT {xm("CAST(churned AS INT)", 0)} AS churn_rate,
              CAST(count(*) AS BIGINT) AS at_risk_users
       FROM fx_cl WHERE month_start = (SELECT max(month_start) FROM fx_cl)""",
)
def churn_rate_latest(spark, sf):
    mv = monthly_view(_t(spark, sf).churn_labels())
    latest = monthly_view(latest_period(mv.source, "month_start"))
    return latest.query({"Churn rate": "churn_rate", "At risk users": "at_risk_users"}).select(
        F.round("churn_rate", 4).alias("churn_rate"), F.col("at_risk_users").cast("bigint")
    )


@register(
    "churn_trend",
    f"""SELECT month_start AS month, {xm("CAST(churned AS INT)", 0)} AS churn_rate,
              CAST(count_if(churned) AS BIGINT) AS churned_users, CAST(count(*) AS BIGINT) AS at_risk_users
       FROM fx_cl GROUP BY month_start""",
)
def churn_trend(spark, sf):
    mv = monthly_view(_t(spark, sf).churn_labels())
    q = mv.query({"Churn rate": "churn_rate", "Churned users": "churned_users", "At risk users": "at_risk_users"}, by={"Month": "month"})
    return q.select(
        "month", F.round("churn_rate", 4).alias("churn_rate"), F.col("churned_users").cast("bigint"), F.col("at_risk_users").cast("bigint")
    ).orderBy("month")


@register(
    "churn_by_geo_latest",
    f"""SELECT geo, {xm("CAST(churned AS INT)", 0)} AS churn_rate
       FROM fx_cl WHERE month_start = (SELECT max(month_start) FROM fx_cl) GROUP BY geo""",
)
def churn_by_geo_latest(spark, sf):
    mv = monthly_view(latest_period(_t(spark, sf).churn_labels(), "month_start"))
    q = mv.query({"Churn rate": "churn_rate"}, by={"Geo": "geo"})
    return q.select("geo", F.round("churn_rate", 4).alias("churn_rate")).orderBy(F.col("churn_rate").desc(), "geo")


# ------------------------------------------------------------- G4 .. G8


@register(
    "users_by_band",
    f"""SELECT churn_risk_band, CAST(count(*) AS BIGINT) AS users, {xm("churn_score", 4, 3)} AS avg_score
       FROM fx_predictions GROUP BY churn_risk_band""",
)
def users_by_band(spark, sf):
    p = _t(spark, sf).predictions()
    return (
        p.groupBy("churn_risk_band")
        .agg(F.count(F.lit(1)).cast("bigint").alias("users"), exact_mean(F.col("churn_score"), 4, 3).alias("avg_score"))
        .orderBy(F.col("avg_score").desc())
    )


def _current(spark, sf):
    t = _t(spark, sf)
    return current_view(t.serving(), t.predictions())


@register(
    "mrr_at_risk_by_band",
    """SELECT churn_risk_band, round(sum(mrr_usd) FILTER (WHERE is_currently_subscribed), 2) AS mrr_at_risk
       FROM fx_current GROUP BY churn_risk_band""",
)
def mrr_at_risk_by_band(spark, sf):
    q = _current(spark, sf).query({"MRR at risk": "mrr_at_risk"}, by={"Risk band": "churn_risk_band"})
    return q.select("churn_risk_band", F.round("mrr_at_risk", 2).alias("mrr_at_risk")).orderBy(F.col("mrr_at_risk").desc())


@register(
    "trend_by_band",
    f"""SELECT churn_risk_band, {xm("coding_hours_trend_30d", 4)} AS avg_coding_trend
       FROM fx_current GROUP BY churn_risk_band""",
)
def trend_by_band(spark, sf):
    q = _current(spark, sf).query({"Avg coding hours trend": "avg_coding_trend"}, by={"Risk band": "churn_risk_band"})
    return q.select("churn_risk_band", F.round("avg_coding_trend", 4).alias("avg_coding_trend")).orderBy("avg_coding_trend")


@register(
    "persona_plan_risk",
    """SELECT persona, tier, CAST(count(*) AS BIGINT) AS users,
              CAST(sum(CASE WHEN churn_risk_band = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_users
       FROM fx_current WHERE is_currently_subscribed = TRUE GROUP BY persona, tier""",
)
def persona_plan_risk(spark, sf):
    q = _current(spark, sf).query(
        {"Users": "users", "High risk users": "high_risk_users"},
        by={"Persona": "persona", "Tier": "tier"},
        where=F.col("is_currently_subscribed") == F.lit(True),
    )
    return q.select("persona", "tier", F.col("users").cast("bigint"), F.col("high_risk_users").cast("bigint")).orderBy(
        F.col("high_risk_users").desc()
    )


@register(
    "score_by_power",
    f"""SELECT power_user_flag, {xm("churn_score", 4)} AS avg_churn_score, CAST(count(*) AS BIGINT) AS users
       FROM fx_current GROUP BY power_user_flag""",
)
def score_by_power(spark, sf):
    q = _current(spark, sf).query({"Avg churn score": "avg_churn_score", "Users": "users"}, by={"Is power user": "power_user_flag"})
    return q.select("power_user_flag", F.round("avg_churn_score", 4).alias("avg_churn_score"), F.col("users").cast("bigint"))


@register(
    "engagement_by_band",
    f"""SELECT churn_risk_band, {xm("coding_hours_trend_30d", 4)} AS avg_coding_trend,
              {xm("avg_acceptance_rate", 4)} AS avg_acceptance_rate, CAST(count(*) AS BIGINT) AS users
       FROM fx_current GROUP BY churn_risk_band""",
)
def engagement_by_band(spark, sf):
    q = _current(spark, sf).query(
        {"Avg coding hours trend": "avg_coding_trend", "Avg acceptance rate": "avg_acceptance_rate", "Users": "users"},
        by={"Risk band": "churn_risk_band"},
    )
    return q.select(
        "churn_risk_band",
        F.round("avg_coding_trend", 4).alias("avg_coding_trend"),
        F.round("avg_acceptance_rate", 4).alias("avg_acceptance_rate"),
        F.col("users").cast("bigint"),
    )


# ------------------------------------------------------------------ G9 / G10


@register(
    "kpi_header",
    """SELECT * FROM
       (SELECT ((2 * 10000 * count_if(churned) + count(*)) // (2 * count(*))) / 100.0 AS churn_rate_pct FROM fx_cl
        WHERE month_start = (SELECT max(month_start) FROM fx_cl)) a,
       (SELECT round(coalesce(sum(mrr_usd) FILTER (WHERE is_currently_subscribed), 0.0), 2) AS mrr_at_risk_total,
               round(coalesce(sum(mrr_usd) FILTER (WHERE is_currently_subscribed AND churn_risk_band = 'high'), 0.0), 2) AS mrr_at_risk_high,
               round(coalesce(sum(mrr_usd) FILTER (WHERE is_currently_subscribed AND churn_risk_band = 'medium'), 0.0), 2) AS mrr_at_risk_medium,
               round(coalesce(sum(mrr_usd) FILTER (WHERE is_currently_subscribed AND churn_risk_band = 'low'), 0.0), 2) AS mrr_at_risk_low,
               CAST(count_if(is_currently_subscribed) AS BIGINT) AS active_subscribers
        FROM fx_current) b""",
)
def kpi_header_q(spark, sf):
    t = _t(spark, sf)
    return kpi_header(current_view(t.serving(), t.predictions()), monthly_view(t.churn_labels()))


@register(
    "do_now_count",
    """SELECT CAST(count(*) AS BIGINT) AS n FROM fx_current
       WHERE churn_risk_band = 'high' AND is_currently_subscribed = TRUE AND crm_touches_30d = 0""",
)
def do_now_count(spark, sf):
    t = _t(spark, sf)
    return wl.do_now_count(t.predictions(), t.serving())


# ------------------------------------------------------------ K2 / J3 / W8


@register(
    "do_now_queue",
    """SELECT c.user_id, c.geo, c.persona, c.plan, c.mrr_usd AS mrr, c.churn_score AS score, c.churn_risk_band AS band,
              c.coding_hours_trend_30d AS coding_trend, c.crm_touches_30d AS crm_touches
       FROM fx_current c
       LEFT JOIN (SELECT user_id, max(CAST(touch_date AS TIMESTAMP)) AS last_touch FROM fx_touches GROUP BY user_id) o
              ON o.user_id = c.user_id
       WHERE c.churn_risk_band = 'high' AND c.is_currently_subscribed = TRUE AND c.crm_touches_30d = 0
         AND (o.last_touch IS NULL OR o.last_touch < (SELECT max(CAST(touch_date AS TIMESTAMP)) FROM fx_touches) - INTERVAL 30 DAY)
       ORDER BY c.mrr_usd DESC NULLS LAST, c.user_id LIMIT 100""",
)
def do_now_queue(spark, sf):
    t = _t(spark, sf)
    log = t.touches().select("user_id", F.col("touch_date").cast("timestamp_ntz").alias("logged_at"))
    return wl.do_now(t.predictions(), t.serving(), log=log, as_of="latest", limit=100)


# ------------------------------------------------------------------ U1 / U2


@register(
    "at_risk_users",
    """SELECT user_id, churn_score, churn_risk_band, geo, persona, tier, mrr_usd, coding_hours_trend_30d, crm_touches_30d
       FROM fx_current WHERE is_currently_subscribed = TRUE AND churn_score >= 0.6""",
)
def at_risk_users(spark, sf):
    t = _t(spark, sf)
    # 0.6 (the high-band edge): the fixture's subscribed scores stay below 0.7
    return wl.at_risk_users(t.predictions(), t.serving(), min_score=0.6)


@register(
    "untouched_at_risk",
    """SELECT user_id, churn_score, geo, persona, mrr_usd FROM fx_current
       WHERE churn_risk_band = 'high' AND is_currently_subscribed = TRUE AND crm_touches_30d = 0""",
)
def untouched_at_risk(spark, sf):
    t = _t(spark, sf)
    return wl.untouched_at_risk_users(t.predictions(), t.serving(), band="high")


# ------------------------------------------------------------- P3 / K1 / P4


@register(
    "worklist_filtered",
    """SELECT user_id, geo, persona, plan, mrr_usd AS mrr, churn_score AS score, churn_risk_band AS band,
              coding_hours_trend_30d AS coding_trend, crm_touches_30d AS crm_touches
       FROM fx_current
       WHERE is_currently_subscribed = TRUE AND churn_risk_band = 'medium' AND geo = 'EUROPE' AND churn_score >= 0.35
       ORDER BY churn_score DESC, user_id LIMIT 100""",
)
def worklist_filtered(spark, sf):
    t = _t(spark, sf)
    return wl.worklist(t.predictions(), t.serving(), band="medium", geo="EUROPE", min_score=0.35, limit=100, geos=TPCH_REGIONS)


@register(
    "user_detail",
    """SELECT user_id, geo, persona, plan, mrr_usd AS mrr, churn_score AS score, churn_risk_band AS band,
              coding_hours_trend_30d AS coding_trend, crm_touches_30d AS crm_touches,
              avg_acceptance_rate, avg_session_frequency, support_tickets_30d AS support_tickets,
              tenure_months, is_currently_subscribed
       FROM fx_current""",
)
def user_detail(spark, sf):
    t = _t(spark, sf)
    return wl.user_detail_all(t.predictions(), t.serving())


@register(
    "user_lookup",
    """SELECT user_id, geo, persona, plan, mrr_usd AS mrr, churn_score AS score, churn_risk_band AS band,
              coding_hours_trend_30d AS coding_trend, crm_touches_30d AS crm_touches,
              avg_acceptance_rate, avg_session_frequency, support_tickets_30d AS support_tickets,
              tenure_months, is_currently_subscribed
       FROM fx_current WHERE user_id = (SELECT min(user_id) FROM fx_current WHERE churn_risk_band = 'high')""",
)
def user_lookup(spark, sf):
    """The detail row of one user, by key: the first of the high band."""
    t = _t(spark, sf)
    user = t.predictions().where("churn_risk_band = 'high'").agg(F.min("user_id")).first()[0]
    return wl.user_detail(t.predictions(), t.serving(), user)


@register(
    "coding_history",
    """SELECT user_id, month_start AS month, avg_coding_hours AS coding_hours
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month_start DESC) AS rk FROM fx_labels_e) z
       WHERE rk <= 3""",
)
def coding_history(spark, sf):
    return wl.coding_history(_t(spark, sf).labels_enriched(), None, 3)


# --------------------------------------------------------------- P2 / U11


@register(
    "risk_bands",
    """SELECT churn_risk_band, CAST(count(*) AS BIGINT) AS users, min(churn_score) AS min_score, max(churn_score) AS max_score
       FROM fx_predictions GROUP BY churn_risk_band""",
)
def risk_bands(spark, sf):
    p = _t(spark, sf).predictions()
    return p.groupBy("churn_risk_band").agg(
        F.count(F.lit(1)).cast("bigint").alias("users"), F.min("churn_score").alias("min_score"), F.max("churn_score").alias("max_score")
    )


@register(
    "user_search",
    """SELECT user_id, geo, persona, plan FROM fx_users WHERE contains(lower(CAST(user_id AS VARCHAR)), '12')""",
)
def user_search(spark, sf):
    """Case-insensitive substring search on the user id."""
    return wl.search(_t(spark, sf).users().select("user_id", "geo", "persona", "plan"), "12")


@register(
    "worklist_page",
    """SELECT user_id, geo, persona, plan, mrr, score, band, coding_trend, crm_touches FROM (
         SELECT user_id, geo, persona, plan, mrr_usd AS mrr, churn_score AS score, churn_risk_band AS band,
                coding_hours_trend_30d AS coding_trend, crm_touches_30d AS crm_touches,
                row_number() OVER (ORDER BY churn_score DESC, user_id) AS rn
         FROM fx_current WHERE is_currently_subscribed = TRUE) z
       WHERE rn > 50 AND rn <= 100""",
)
def worklist_page(spark, sf):
    """K6: second page of the subscribed worklist by key-based pagination:
    rows strictly after page one's last (score, user_id), next 50.

    Both pages read the written worklist.  What it is made from is written before
    it, also as predictions and serving both start from the latest labels; each
    write drops its exchanges, so the largest one's are what lies on disk at most."""
    root = scratch_path(spark, f"worklist-{uuid.uuid4().hex[:12]}")
    t = Tables(spark, sf)
    with shuffles_dropped(spark):
        for view in ("terms", "touch_months", "latest_labels"):
            getattr(t, view)().write.option("compression", "zstd").parquet(f"{root}/{view}")
            t.written(view, f"{root}/{view}")
        wl.worklist_rows(t.predictions(), t.serving()).write.option("compression", "zstd").parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")
    first = wl.page(rows, [("score", True), ("user_id", False)], None, 50)
    last = first.orderBy(F.col("score").asc(), F.col("user_id").desc()).limit(1).collect()  # the cursor: one row
    after = {"score": last[0]["score"], "user_id": last[0]["user_id"]} if last else None
    return wl.page(rows, [("score", True), ("user_id", False)], after, 50)


@register(
    "answer_cleanup",
    r"""WITH a AS (
         SELECT conv_id, turn, length(text) AS raw_chars, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t
         FROM conversations WHERE role = 'assistant'),
       b AS (SELECT conv_id, turn, raw_chars, trim(regexp_replace(t, '^["''“”‘’]+|["''“”‘’]+$', '', 'g')) AS t FROM a),
       c AS (SELECT conv_id, turn, raw_chars, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
               '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '_(.+?)_', '\1', 'g') AS t FROM b),
       d AS (SELECT conv_id, turn, raw_chars, trim(regexp_replace(regexp_replace(t,
               '[,;]?\s*(?:across|in|based on|over|from)\s+(?:all\s+)?[0-9]+\s+rows?(?:\s+\w+){0,2}(\.?)\s*$', '\1', 'i'),
               '\s+([.!?])', '\1', 'g')) AS t FROM c),
       e AS (SELECT conv_id, turn, raw_chars, t, regexp_extract_all(t, '[^.!?]+[.!?]+') AS s FROM d),
       f AS (SELECT conv_id, turn, raw_chars, CASE WHEN len(s) > 2 THEN trim(s[1]) || ' ' || trim(s[2]) ELSE t END AS t FROM e),
       g AS (SELECT conv_id, turn, raw_chars, t, substr(t, 1, 520) AS cut, reverse(substr(t, 1, 520)) AS back FROM f),
       h AS (SELECT *, greatest(CASE WHEN instr(back, ' .') > 0 THEN length(cut) - instr(back, ' .') ELSE 0 END,
                                CASE WHEN instr(back, ' !') > 0 THEN length(cut) - instr(back, ' !') ELSE 0 END,
                                CASE WHEN instr(back, ' ?') > 0 THEN length(cut) - instr(back, ' ?') ELSE 0 END) AS stop FROM g)
       SELECT conv_id, turn, raw_chars,
              CASE WHEN length(t) > 520 THEN CASE WHEN stop > 209 THEN substr(cut, 1, stop) ELSE rtrim(cut) || '…' END ELSE t END AS answer
       FROM h""",
)
def answer_cleanup(spark, sf):
    """TX1: display clean-up of every assistant answer (whitespace collapse,
    markdown/quote strip, first two sentences, length cap).  A row-level
    column expression: runs inside the scan's codegen stage, no shuffle."""
    conv = spark.read.parquet(f"{sf}/conversations.parquet").filter(F.col("role") == "assistant")
    return conv.select("conv_id", "turn", F.length("text").alias("raw_chars"), clean_text("text").alias("answer"))


@register(
    "highest_risk_top50",
    """SELECT user_id, ((2 * CAST(round(churn_score * 10000) AS BIGINT) + 10) // 20) / 1000.0 AS churn_score,
              geo, persona, tier, mrr_usd,
              ((2 * CAST(round(coding_hours_trend_30d * 10000) AS BIGINT) + 100) // 200) / 100.0 AS coding_hours_trend_30d,
              crm_touches_30d
       FROM fx_current WHERE churn_risk_band = 'high' AND is_currently_subscribed = TRUE
       ORDER BY fx_current.churn_score DESC, user_id LIMIT 50""",
)
def highest_risk_top50(spark, sf):
    """K4: highest-risk subscribers to contact now (a top-k report)."""
    t = _t(spark, sf)
    return wl.highest_risk(t.predictions(), t.serving(), 50)
