"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reports as R
from tidemark.plans.catalog import register
from tidemark.sources.fixtures import Tables

# Fixed parameters of the annual-impact formula (G26): prevented share of
# at-risk MRR and the lifetime multiple in months.
PREVENTION_RATE = 0.10
LTV_MONTHS = 24


def _t(spark, sf):
    return Tables.of(spark, sf)


def xm(col: str, s: int) -> str:
    """SQL text of the exact half-up 4-dp mean (mirror of ``exact_mean``)."""
    return f"((2 * {10 ** (4 - s)} * sum(CAST(round({col} * {10 ** s}) AS BIGINT)) + count({col})) // (2 * count({col}))) / 10000.0"


def rate(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN ((2 * 10000 * ({num}) + ({den})) // (2 * ({den}))) / 10000.0 END"


CH = "CAST(churned AS INT)"


@register(
    "monthly_summary",
    f"""SELECT month_start, CAST(count(*) AS BIGINT) AS at_risk_users, CAST(count_if(churned) AS BIGINT) AS churn_events,
              {xm(CH, 0)} AS monthly_churn_rate, {xm('avg_coding_hours', 3)} AS avg_coding_hours,
              {xm('avg_acceptance_rate', 4)} AS avg_acceptance_rate, {xm('avg_session_frequency', 3)} AS avg_session_frequency,
              CAST(count_if(is_power_user_month) AS BIGINT) AS power_user_months
       FROM fx_cl GROUP BY month_start""",
)
def monthly_summary(spark, sf):
    return R.monthly_summary(_t(spark, sf).churn_labels())


@register(
    "geo_summary",
    f"""SELECT c.geo, c.users, c.power_users,
              CAST(coalesce(g.at_risk_user_months, 0) AS BIGINT) AS at_risk_user_months,
              CAST(coalesce(g.churn_events, 0) AS BIGINT) AS churn_events,
              coalesce(g.monthly_churn_rate, 0.0) AS monthly_churn_rate, coalesce(g.avg_coding_hours, 0.0) AS avg_coding_hours,
              coalesce(g.avg_acceptance_rate, 0.0) AS avg_acceptance_rate, coalesce(g.avg_session_frequency, 0.0) AS avg_session_frequency,
              coalesce({rate('c.power_users', 'c.users')}, 0.0) AS power_user_share
       FROM (SELECT geo, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count_if(power_user_flag) AS BIGINT) AS power_users
             FROM fx_users_p GROUP BY geo) c
       LEFT JOIN (SELECT geo, count(*) AS at_risk_user_months, count_if(churned) AS churn_events,
                         {xm(CH, 0)} AS monthly_churn_rate, {xm('avg_coding_hours', 3)} AS avg_coding_hours,
                         {xm('avg_acceptance_rate', 4)} AS avg_acceptance_rate, {xm('avg_session_frequency', 3)} AS avg_session_frequency
                  FROM fx_cl GROUP BY geo) g ON g.geo = c.geo""",
)
def geo_summary(spark, sf):
    t = _t(spark, sf)
    return R.geo_summary(t.churn_labels(), t.users_profile())


@register(
    "churn_signal",
    f"""SELECT CASE WHEN ever = 1 THEN 'churned' ELSE 'retained' END AS cohort, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
              {xm('avg_coding_hours', 3)} AS avg_coding_hours, {xm('avg_acceptance_rate', 4)} AS avg_acceptance_rate,
              {xm('avg_session_frequency', 3)} AS avg_session_frequency, {xm('active_days', 0)} AS avg_active_days,
              {xm('coding_hours_trend_30d', 4)} AS avg_coding_hours_trend, {xm('support_tickets_30d', 0)} AS avg_support_tickets
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month_start DESC) - 1 AS from_end,
                    max(CAST(churned AS INT)) OVER (PARTITION BY user_id) AS ever FROM fx_cl) z
       WHERE from_end < 3 GROUP BY 1""",
)
def churn_signal(spark, sf):
    return R.churn_signal(_t(spark, sf).churn_labels(), late=3)


def _bucket_sql(col):
    parts = []
    for lo, hi, lab in zip(R.TREND_EDGES[:-1], R.TREND_EDGES[1:], R.TREND_LABELS):
        parts.append(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


@register(
    "trend_buckets",
    f"""SELECT trend_bucket, CAST(count(*) AS BIGINT) AS user_months, {xm(CH, 0)} AS churn_rate,
              {xm('avg_coding_hours', 3)} AS avg_coding_hours, {xm('avg_acceptance_rate', 4)} AS avg_acceptance_rate,
              {xm('avg_session_frequency', 3)} AS avg_session_frequency
       FROM (SELECT *, {_bucket_sql('coding_hours_trend_30d')} AS trend_bucket FROM fx_cl) z
       WHERE trend_bucket IS NOT NULL GROUP BY trend_bucket""",
)
def trend_buckets(spark, sf):
    return R.trend_buckets(_t(spark, sf).churn_labels())


@register(
    "feature_correlations",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(corr(CAST({f} AS DOUBLE), CAST(churned AS DOUBLE)), 4) AS pearson_r_with_churned FROM fx_cl"
        for f in R.CORR_FEATURES
    ),
)
def feature_correlations(spark, sf):
    return R.correlations(_t(spark, sf).churn_labels())


PROFILE_COLS = [
    "coding_hours", "ai_acceptance_rate", "session_frequency", "suggestions_shown",
    "suggestions_accepted", "lines_of_code_written", "files_touched", "ai_requests",
]


@register(
    "numeric_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, round(avg(CAST({c} AS DOUBLE)), 4) AS mean,
                   round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, min(CAST({c} AS DOUBLE)) AS min,
                   round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50,
                   round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, max(CAST({c} AS DOUBLE)) AS max FROM fx_usage"""
        for c in PROFILE_COLS
    ),
)
def numeric_profile(spark, sf):
    return R.profile(_t(spark, sf).usage(), PROFILE_COLS)


@register(
    "category_counts",
    """SELECT 'geo' AS dimension, CAST(geo AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM fx_users GROUP BY geo
       UNION ALL SELECT 'persona', persona, count(*) FROM fx_users GROUP BY persona
       UNION ALL SELECT 'plan', plan, count(*) FROM fx_users GROUP BY plan
       UNION ALL SELECT 'status', status, count(*) FROM fx_subscriptions GROUP BY status
       UNION ALL SELECT 'channel', channel, count(*) FROM fx_tickets GROUP BY channel
       UNION ALL SELECT 'cancel_reason', cancel_reason, count(*) FROM fx_subscriptions WHERE cancel_reason IS NOT NULL GROUP BY cancel_reason
       UNION ALL SELECT 'outcome', CASE WHEN NOT delivered THEN 'no_response' WHEN reactivated THEN 'reactivated' WHEN unsubscribed THEN 'unsubscribed'
                                        WHEN opened OR clicked THEN 'engaged_no_conversion' ELSE 'no_response' END, count(*) FROM fx_touches_u GROUP BY 2
       UNION ALL SELECT 'user_state_at_touch', coalesce(s.user_state, 'not_subscribed'), count(*)
                 FROM fx_touches t LEFT JOIN fx_state s ON s.user_id = t.user_id AND s.month_start = date_trunc('month', t.touch_date) GROUP BY 2""",
)
def category_counts(spark, sf):
    """Eight categorical distributions, the largest value of each first."""
    from tidemark.operators.derive import touch_outcome

    t = _t(spark, sf)
    u = t.users()
    parts = [
        R.category_counts(u, "geo"),
        R.category_counts(u, "persona"),
        R.category_counts(u, "plan"),
        R.category_counts(t.subscriptions(), "status"),
        R.category_counts(t.tickets(), "channel"),
        R.category_counts(t.subscriptions().where("cancel_reason IS NOT NULL"), "cancel_reason"),
        R.category_counts(touch_outcome(t.touches_with_optout()), "outcome"),
        R.state_at_touch(t.touches(), t.monthly_state()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # one row per dimension and value
    return out.orderBy("dimension", F.col("n").desc(), "value")


@register(
    "subscription_mix",
    """SELECT t.terms, t.downgrade_terms, t.reactivation_terms, t.total_revenue_usd, u.users,
              ((2 * 1000 * t.terms + u.users) // (2 * u.users)) / 1000.0 AS terms_per_user
       FROM (SELECT CAST(count(*) AS BIGINT) AS terms, CAST(count_if(is_downgrade) AS BIGINT) AS downgrade_terms,
                    CAST(count_if(is_reactivation) AS BIGINT) AS reactivation_terms,
                    sum(CAST(round(revenue_usd * 100) AS BIGINT)) / 100.0 AS total_revenue_usd
             FROM (SELECT *, ((2 * CAST(round(mrr_usd * 100) AS BIGINT) * billed_days + 30) // 60) / 100.0 AS revenue_usd
                   FROM (SELECT *, CAST(greatest(datediff('day', greatest(term_start_date, DATE '1995-01-01'),
                                                 coalesce(term_end_date, DATE '2001-08-31')) + 1, 0) AS BIGINT) AS billed_days
                         FROM fx_subscriptions) b) r) t,
            (SELECT CAST(count(*) AS BIGINT) AS users FROM fx_users) u""",
)
def subscription_mix(spark, sf):
    from tidemark.operators.derive import bill_terms
    from tidemark.plans.queries_derive import WINDOW_END, WINDOW_START

    t = _t(spark, sf)
    return R.subscription_mix(bill_terms(t.subscriptions(), WINDOW_START, WINDOW_END), t.users())


@register(
    "support_by_channel",
    f"""SELECT channel, CAST(count(*) AS BIGINT) AS tickets, {xm('chat_message_count', 0)} AS avg_chat_messages,
              {xm('csat_score', 0)} AS avg_csat, {xm('CAST(is_escalated AS INT)', 0)} AS escalation_rate
       FROM fx_tickets GROUP BY channel""",
)
def support_by_channel(spark, sf):
    return R.support_summary(_t(spark, sf).tickets(), "channel")


@register(
    "support_by_category",
    f"""SELECT category, CAST(count(*) AS BIGINT) AS tickets, {xm('chat_message_count', 0)} AS avg_chat_messages,
              {xm('csat_score', 0)} AS avg_csat, {xm('CAST(is_escalated AS INT)', 0)} AS escalation_rate
       FROM fx_tickets GROUP BY category""",
)
def support_by_category(spark, sf):
    return R.support_summary(_t(spark, sf).tickets(), "category")


@register(
    "support_overall",
    f"""SELECT {xm('csat_score', 0)} AS avg_csat, {rate('count(csat_score)', 'count(*)')} AS response_rate,
              CAST(sum(chat_message_count) AS BIGINT) AS total_chat_messages FROM fx_tickets""",
)
def support_overall(spark, sf):
    return R.support_overall(_t(spark, sf).tickets())


@register(
    "campaign_funnel",
    f"""SELECT campaign_id, CAST(count(*) AS BIGINT) AS touches, {xm('CAST(delivered AS INT)', 0)} AS delivered_rate,
              {xm('CAST(opened AS INT)', 0)} AS open_rate, {xm('CAST(clicked AS INT)', 0)} AS click_rate,
              {xm('CAST(reactivated AS INT)', 0)} AS reactivation_rate, round(sum(cost_usd), 2) AS cost_usd
       FROM fx_touches GROUP BY campaign_id""",
)
def campaign_funnel(spark, sf):
    return R.campaign_funnel(_t(spark, sf).touches())


@register(
    "reactivation_kpi",
    f"""SELECT CAST(count_if(reactivated) AS BIGINT) AS reactivated, CAST(count(*) AS BIGINT) AS delivered_winback_touches,
              {rate('count_if(reactivated)', 'count(*)')} AS reactivation_rate
       FROM fx_touches WHERE delivered AND campaign_id IN (SELECT campaign_id FROM fx_campaigns WHERE objective = 'winback')""",
)
def reactivation_kpi(spark, sf):
    t = _t(spark, sf)
    return R.reactivation_kpi(t.touches(), t.campaigns())


@register(
    "kpi_fractions",
    f"""SELECT kpi, num, den, {rate('num', 'den')} AS rate FROM (
         SELECT 'monthly_churn' AS kpi, CAST(count_if(churned) AS BIGINT) AS num, CAST(count(*) AS BIGINT) AS den FROM fx_cl
         UNION ALL SELECT 'power_user_share', CAST(count_if(power_user_flag) AS BIGINT), CAST(count(*) AS BIGINT) FROM fx_users_p
         UNION ALL SELECT 'ever_churned_share', CAST(count(DISTINCT CASE WHEN churned THEN user_id END) AS BIGINT),
                          CAST(count(DISTINCT user_id) AS BIGINT) FROM fx_cl
         UNION ALL SELECT 'event_density', CAST(count(*) AS BIGINT),
                          CAST(count(DISTINCT user_id) * (datediff('day', min(event_date), max(event_date)) + 1) AS BIGINT) FROM fx_usage) k""",
)
def kpi_fractions(spark, sf):
    t = _t(spark, sf)
    cl = t.churn_labels()
    u = t.users_profile()
    us = t.usage()
    parts = [
        ("monthly_churn", cl.agg(F.count_if("churned").alias("num"), F.count(F.lit(1)).alias("den"))),
        ("power_user_share", u.agg(F.count_if("power_user_flag").alias("num"), F.count(F.lit(1)).alias("den"))),
        (
            "ever_churned_share",
            cl.agg(F.count_distinct(F.when(F.col("churned"), F.col("user_id"))).alias("num"), F.count_distinct("user_id").alias("den")),
        ),
        (
            "event_density",
            us.agg(
                F.count(F.lit(1)).alias("num"),
                (F.count_distinct("user_id") * (F.datediff(F.max("event_date"), F.min("event_date")) + 1)).alias("den"),
            ),
        ),
    ]
    return R.kpi_fractions(parts)


@register(
    "trend_contrast",
    f"""SELECT CASE WHEN coding_hours_trend_30d < 0.75 THEN 'declining' ELSE 'growing' END AS cohort,
              CAST(count(*) AS BIGINT) AS user_months, {xm(CH, 0)} AS churn_rate
       FROM fx_cl WHERE coding_hours_trend_30d < 0.75 OR coding_hours_trend_30d >= 1.0 GROUP BY 1
       UNION ALL
       SELECT CASE WHEN u.power_user_flag THEN 'power' ELSE 'rest' END, CAST(count(*) AS BIGINT), {xm('CAST(l.churned AS INT)', 0)}
       FROM fx_cl l JOIN fx_users_p u ON u.user_id = l.user_id GROUP BY 1""",
)
def trend_contrast(spark, sf):
    t = _t(spark, sf)
    return R.trend_contrast(t.churn_labels(), t.users_profile())


@register(
    "ingest_summary",
    """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
              min(event_date) AS first_day, max(event_date) AS last_day FROM fx_usage""",
)
def ingest_summary(spark, sf):
    return R.ingest_summary(_t(spark, sf).usage())


@register(
    "annual_impact",
    f"""SELECT round(arr, 2) AS arr_usd, round(arr * nrr_pct / 100.0 + prevented * ltv, 2) AS annual_impact_usd
       FROM (SELECT sum(mrr_usd) FILTER (WHERE is_currently_subscribed) * 12 AS arr,
                    100.0 - 100.0 * avg(CAST(churned_latest_month AS INT)) AS nrr_pct,
                    {PREVENTION_RATE} * count_if(churn_risk_band = 'high' AND is_currently_subscribed) AS prevented,
                    avg(mrr_usd) FILTER (WHERE is_currently_subscribed) * {LTV_MONTHS} AS ltv
             FROM fx_current) a""",
)
def annual_impact(spark, sf):
    """``ARR x NRR% + prevention x base x LTV`` over the current state."""
    from tidemark.plans.metrics import annual_impact as formula
    from tidemark.plans.metrics import current_source

    t = _t(spark, sf)
    src = current_source(t.serving(), t.predictions())
    sub = F.col("is_currently_subscribed")
    a = src.agg(
        (F.sum(F.when(sub, F.col("mrr_usd"))) * 12).alias("arr"),
        (F.lit(100.0) - F.lit(100.0) * F.avg(F.col("churned_latest_month").cast("int"))).alias("nrr_pct"),
        F.count_if((F.col("churn_risk_band") == "high") & sub).alias("base"),
        (F.avg(F.when(sub, F.col("mrr_usd"))) * LTV_MONTHS).alias("ltv"),
    )
    return a.select(
        F.round("arr", 2).alias("arr_usd"),
        F.round(formula(F.col("arr"), F.col("nrr_pct"), F.lit(PREVENTION_RATE), F.col("base"), F.col("ltv")), 2).alias("annual_impact_usd"),
    )


@register(
    "feature_stickiness",
    f"""SELECT feature_key, CAST(count(*) AS BIGINT) AS rows, {xm('CAST(is_adopted AS INT)', 0)} AS adoption_rate,
              {xm('activation_count', 0)} AS avg_activations, {xm('depth_score', 4)} AS avg_depth
       FROM fx_feature_adoption GROUP BY feature_key""",
)
def feature_stickiness(spark, sf):
    return R.feature_stickiness(_t(spark, sf).feature_adoption())
