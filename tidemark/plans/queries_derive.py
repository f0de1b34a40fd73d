"""Derived-table queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from tidemark.functions.columns import exact_mean, half_up_ratio, scaled_int
from tidemark.operators import derive as D
from tidemark.plans.catalog import register
from tidemark.sources.fixtures import Tables

# Fixed parameters: the order window of the driver tables and the five
# campaign segment rules of the reference (campaign, segment, channel, rule).
WINDOW_START = _dt.date(1995, 1, 1)
WINDOW_END = _dt.date(2001, 8, 31)
SEGMENT_RULES = [
    ("CMP-001", "declining_engagement_active", "email", "at_risk AND decline_ratio < 0.92"),
    ("CMP-002", "declining_engagement_power_user", "in_app", "at_risk AND decline_ratio < 0.92 AND power_user_flag"),
    ("CMP-003", "lapsed_within_90d", "email", "winback_eligible"),
    ("CMP-004", "low_feature_adoption_active", "in_app", "at_risk AND features_adopted <= 2"),
    ("CMP-005", "engaged_monthly_billers", "push", "at_risk AND decline_ratio >= 0.92 AND plan IN ('pro_monthly', 'pro_team_monthly')"),
]
# Lifecycle event mapping of the driver's ``events`` (signup / cancel / reactivate / downgrade).
LIFECYCLE_KINDS = {"signup": "signup", "error": "cancel", "purchase": "reactivate", "click": "downgrade"}


def _t(spark, sf):
    return Tables.of(spark, sf)


def _r4(*cols):
    return [F.round(c, 4).alias(c) for c in cols]


@register(
    "monthly_usage",
    """SELECT user_id, CAST(date_trunc('month', event_date) AS DATE) AS month_start, CAST(count(*) AS BIGINT) AS active_days,
              ((2 * 10 * sum(CAST(round(coding_hours * 1000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000.0 AS avg_coding_hours,
              ((2 * sum(CAST(round(ai_acceptance_rate * 10000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000.0 AS avg_acceptance_rate,
              ((2 * 10000 * sum(CAST(session_frequency AS BIGINT)) + count(*)) // (2 * count(*))) / 10000.0 AS avg_session_frequency
       FROM fx_usage GROUP BY 1, 2""",
)
def monthly_usage(spark, sf):
    """D1 with means rounded half-up to 4 dp exactly (see ``exact_mean``)."""
    u = _t(spark, sf).usage()
    return u.groupBy("user_id", F.trunc("event_date", "month").alias("month_start")).agg(
        F.count(F.lit(1)).cast("bigint").alias("active_days"),
        exact_mean("coding_hours", 3).alias("avg_coding_hours"),
        exact_mean("ai_acceptance_rate", 4).alias("avg_acceptance_rate"),
        exact_mean("session_frequency", 0).alias("avg_session_frequency"),
    )


@register("power_weeks", "SELECT * FROM fx_power_weeks")
def power_weeks(spark, sf):
    return D.power_weeks(_t(spark, sf).usage())


@register("power_user_flag", "SELECT user_id, observed_months, qualifying_months, power_user_flag FROM fx_power")
def power_user_flag(spark, sf):
    return _t(spark, sf).power().select("user_id", "observed_months", "qualifying_months", "power_user_flag")


@register("ever_power_user", "SELECT user_id, ever_power_user FROM fx_power")
def ever_power_user(spark, sf):
    return _t(spark, sf).power().select("user_id", "ever_power_user")


@register("mom_trend", "SELECT user_id, month_start, avg_coding_hours, coding_hours_trend_30d FROM fx_labels_e")
def mom_trend(spark, sf):
    return _t(spark, sf).labels_enriched().select("user_id", "month_start", "avg_coding_hours", "coding_hours_trend_30d")


@register("user_month_spine", "SELECT * FROM fx_spine")
def user_month_spine(spark, sf):
    return _t(spark, sf).spine()


@register("at_risk_months", "SELECT * FROM fx_at_risk")
def at_risk_months(spark, sf):
    return _t(spark, sf).at_risk()


@register("churn_labels", "SELECT * FROM fx_cl")
def churn_labels(spark, sf):
    return _t(spark, sf).churn_labels()


@register(
    "touches_per_month",
    """SELECT user_id, CAST(date_trunc('month', touch_date) AS DATE) AS month_start, CAST(count(*) AS BIGINT) AS crm_touches
       FROM fx_touches GROUP BY 1, 2""",
)
def touches_per_month(spark, sf):
    return D.counts_per_month(_t(spark, sf).touches(), "touch_date", "crm_touches")


@register(
    "tickets_per_month",
    """WITH sp AS (SELECT user_id, CAST(unnest(generate_series(m0, m1, INTERVAL 1 MONTH)) AS DATE) AS month_start
                   FROM (SELECT user_id, CAST(date_trunc('month', min(created_date)) AS DATE) AS m0,
                                CAST(date_trunc('month', max(created_date)) AS DATE) AS m1 FROM fx_tickets GROUP BY user_id) u)
       SELECT sp.user_id, sp.month_start, CAST(coalesce(c.n, 0) AS BIGINT) AS support_tickets
       FROM sp LEFT JOIN (SELECT user_id, CAST(date_trunc('month', created_date) AS DATE) AS m, count(*) AS n FROM fx_tickets GROUP BY 1, 2) c
              ON c.user_id = sp.user_id AND c.m = sp.month_start""",
)
def tickets_per_month(spark, sf):
    tk = _t(spark, sf).tickets()
    span = tk.groupBy("user_id").agg(F.min("created_date").alias("a"), F.max("created_date").alias("b"))
    spine = D.user_month_spine(span, "a", "b")
    return D.counts_per_month(tk, "created_date", "support_tickets", spine=spine)


@register("features_adopted", "SELECT * FROM fx_fa")
def features_adopted(spark, sf):
    t = _t(spark, sf)
    return D.features_adopted(t.feature_days(), t.spine(), date="date").select("user_id", "month_start", "features_adopted")


@register(
    "stickiness",
    """SELECT s.user_id, s.month_start, round(coalesce(sum(w.weight), 0.0), 4) AS stickiness
       FROM fx_spine s
       LEFT JOIN fx_feat_first f ON f.user_id = s.user_id AND f.first_month <= s.month_start
       LEFT JOIN (SELECT p_brand AS feature_key, ((2 * sum(CAST(round(p_retailprice * 100) AS BIGINT)) + 10 * count(*)) // (20 * count(*))) / 10000.0 AS weight
                  FROM part GROUP BY p_brand) w
              ON w.feature_key = f.feature_key
       GROUP BY s.user_id, s.month_start""",
)
def stickiness(spark, sf):
    t = _t(spark, sf)
    r = D.features_adopted(t.feature_days(), t.spine(), date="date", weights=t.feature_weights(), out="stickiness")
    return r.select("user_id", "month_start", F.round(F.coalesce("stickiness", F.lit(0.0)), 4).alias("stickiness"))


@register("feature_adoption", "SELECT * FROM fx_feature_adoption")
def feature_adoption(spark, sf):
    return _t(spark, sf).feature_adoption()


@register(
    "subscription_terms",
    """WITH ev AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id,
                          CASE event_type WHEN 'signup' THEN 'signup' WHEN 'error' THEN 'cancel'
                                          WHEN 'purchase' THEN 'reactivate' WHEN 'click' THEN 'downgrade' END AS k
                   FROM events WHERE event_type IN ('signup', 'error', 'purchase', 'click')),
            s AS (SELECT *, lead(d) OVER w AS nd, lead(k) OVER w AS nk
                  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY d, CASE WHEN k = 'cancel' THEN 1 ELSE 0 END, event_id))
       SELECT user_id, d AS term_start_date,
              CASE WHEN nk = 'cancel' THEN nd WHEN nd IS NOT NULL THEN CAST(nd - INTERVAL 1 DAY AS DATE) END AS term_end_date,
              CASE WHEN nk = 'cancel' AND k = 'reactivate' THEN 'churned_after_reactivation'
                   WHEN nk = 'cancel' THEN 'canceled' WHEN nd IS NOT NULL THEN 'downgraded' ELSE 'active' END AS status,
              k = 'downgrade' AS is_downgrade, k = 'reactivate' AS is_reactivation,
              CASE WHEN nk = 'cancel' THEN nd END AS cancel_date, event_id,
              CAST(row_number() OVER (PARTITION BY user_id ORDER BY d, event_id) - 1 AS BIGINT) AS term_index
       FROM s WHERE k <> 'cancel' AND NOT coalesce(nk <> 'cancel' AND nd = d, FALSE)""",
)
def subscription_terms(spark, sf):
    e = _t(spark, sf).raw("events").filter(F.col("event_type").isin(*LIFECYCLE_KINDS))
    kind = F.create_map(*[F.lit(x) for kv in LIFECYCLE_KINDS.items() for x in kv])[F.col("event_type")]
    ev = e.select("user_id", F.col("ts").cast("date").alias("event_date"), kind.alias("event_type"), "event_id")
    return D.build_terms(ev, tiebreak="event_id")


@register(
    "term_billing",
    """SELECT subscription_id, user_id, billing_period, mrr_usd, billed_days,
              CAST(floor(billed_days / CASE WHEN billing_period = 'annual' THEN 365 ELSE 30 END) AS BIGINT) AS renewals_count,
              ((2 * CAST(round(mrr_usd * 100) AS BIGINT) * billed_days + 30) // 60) / 100.0 AS revenue_usd
       FROM (SELECT *, CAST(greatest(datediff('day', greatest(term_start_date, DATE '1995-01-01'),
                                              coalesce(term_end_date, DATE '2001-08-31')) + 1, 0) AS BIGINT) AS billed_days
             FROM fx_subscriptions) s""",
)
def term_billing(spark, sf):
    b = D.bill_terms(_t(spark, sf).subscriptions(), WINDOW_START, WINDOW_END)
    return b.select("subscription_id", "user_id", "billing_period", "mrr_usd", "billed_days", "renewals_count", "revenue_usd")


@register("decline_features", "SELECT user_id, month_start, decline_1m, decline_3m, decline_ratio FROM fx_state")
def decline_features(spark, sf):
    return _t(spark, sf).monthly_state().select("user_id", "month_start", "decline_1m", "decline_3m", "decline_ratio")


@register(
    "zscores",
    """SELECT user_id, month_start,
              round((ln(greatest(avg_coding_hours, 0.1)) - avg(ln(greatest(avg_coding_hours, 0.1))) OVER ())
                    / (stddev_pop(ln(greatest(avg_coding_hours, 0.1))) OVER () + 1e-9), 4) AS avg_coding_hours_z,
              round((ln(greatest(avg_session_frequency, 0.1)) - avg(ln(greatest(avg_session_frequency, 0.1))) OVER ())
                    / (stddev_pop(ln(greatest(avg_session_frequency, 0.1))) OVER () + 1e-9), 4) AS avg_session_frequency_z,
              round((avg_acceptance_rate - 0.35) / 0.10, 4) AS acceptance_z,
              round(ln(1 + tenure_months) / ln(13.0), 4) AS tenure_term
       FROM fx_labels_e""",
)
def zscores(spark, sf):
    lab = _t(spark, sf).labels_enriched()
    z = D.zscore(lab, ["avg_coding_hours", "avg_session_frequency"])
    return z.select(
        "user_id", "month_start", "avg_coding_hours_z", "avg_session_frequency_z",
        F.round(D.fixed_z("avg_acceptance_rate", 0.35, 0.10), 4).alias("acceptance_z"),
        F.round(D.tenure_term("tenure_months"), 4).alias("tenure_term"),
    )


def _rules_sql():
    parts = []
    for cid, seg, ch, cond in SEGMENT_RULES:
        parts.append(
            f"SELECT user_id, month_start, '{cid}' AS campaign_id, '{seg}' AS target_segment, '{ch}' AS channel FROM fx_state WHERE {cond}"
        )
    return " UNION ALL ".join(parts)


@register("segment_eligibility", _rules_sql())
def segment_eligibility(spark, sf):
    st = _t(spark, sf).monthly_state()
    return D.segment_eligibility(st, SEGMENT_RULES).select("user_id", "month_start", "campaign_id", "target_segment", "channel")


@register(
    "segment_suppression",
    f"""SELECT e.*, u.closed IS NOT NULL AS opted_out_later
       FROM ({_rules_sql()}) e
       LEFT JOIN (SELECT user_id, channel, min(touch_date) AS closed FROM fx_touches_u WHERE unsubscribed GROUP BY user_id, channel) u
              ON u.user_id = e.user_id AND u.channel = e.channel AND e.channel IN ('email', 'push')
       WHERE u.closed IS NULL OR u.closed > e.month_start""",
)
def segment_suppression(spark, sf):
    """D22 with opt-outs: eligible user-months whose channel the user has not closed by then."""
    t = _t(spark, sf)
    outs = t.touches_with_optout().where("unsubscribed").select("user_id", "channel", F.col("touch_date").alias("unsub_date"))
    found = D.segment_eligibility(t.monthly_state(), SEGMENT_RULES, outs)
    ever = outs.where(F.col("channel").isin(*D.OPTOUT_CHANNELS)).select("user_id", "channel").distinct().withColumn("opted_out_later", F.lit(True))
    columns = ["user_id", "month_start", "campaign_id", "target_segment", "channel"]
    return found.join(ever, ["user_id", "channel"], "left").select(*columns, F.coalesce("opted_out_later", F.lit(False)).alias("opted_out_later"))


@register("user_state", "SELECT user_id, month_start, user_state FROM fx_state")
def user_state(spark, sf):
    return _t(spark, sf).monthly_state().select("user_id", "month_start", "user_state")


@register(
    "winback_eligible",
    "SELECT user_id, month_start, last_churn_month, reactivations, months_since_churn, winback_eligible FROM fx_state",
)
def winback_eligible(spark, sf):
    return _t(spark, sf).monthly_state().select(
        "user_id", "month_start", "last_churn_month", "reactivations", "months_since_churn", "winback_eligible"
    )


@register(
    "touch_outcome",
    """SELECT touch_id, user_id, touch_date,
              CASE WHEN NOT delivered THEN 'no_response' WHEN reactivated AND opened AND clicked THEN 'reactivated'
                   WHEN unsubscribed THEN 'unsubscribed' WHEN opened OR clicked THEN 'engaged_no_conversion' ELSE 'no_response' END AS outcome
       FROM fx_touches_u""",
)
def touch_outcome(spark, sf):
    return D.touch_outcome(_t(spark, sf).touches_with_optout()).select("touch_id", "user_id", "touch_date", "outcome")


@register(
    "outreach_30d",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS touches_30d, max(CAST(touch_date AS TIMESTAMP)) AS last_touch
       FROM fx_touches
       WHERE CAST(touch_date AS TIMESTAMP) >= (SELECT max(CAST(touch_date AS TIMESTAMP)) FROM fx_touches) - INTERVAL 30 DAY
       GROUP BY user_id""",
)
def outreach_30d(spark, sf):
    log = _t(spark, sf).touches().select("user_id", F.col("touch_date").cast("timestamp_ntz").alias("logged_at"))
    now = log.agg(F.max("logged_at")).scalar()  # the log's own "now", a scalar subquery
    return D.rolling_touches(log, now, days=30)


@register(
    "surrogate_keys",
    """SELECT ticket_id, printf('TCK-%09d', row_number() OVER (ORDER BY created_date, ticket_id)) AS surrogate_id
       FROM fx_tickets""",
)
def surrogate_keys(spark, sf):
    tk = _t(spark, sf).tickets().select("ticket_id", "created_date")
    return D.surrogate_keys(tk, ["created_date", "ticket_id"]).select("ticket_id", "surrogate_id")


@register(
    "user_sample",
    """SELECT * FROM fx_subscriptions
       WHERE user_id IN (SELECT user_id FROM fx_users
                         WHERE ('0x' || substr(md5(CAST(user_id AS VARCHAR) || ':1729'), 1, 8))::BIGINT % 10 < 1)""",
)
def user_sample(spark, sf):
    """Every term of ~10% of users; the portable md5 hash is computed on
    the users table and the terms follow by semi join."""
    t = _t(spark, sf)
    users = D.sample_users(t.users(), num=1, den=10, hash="md5")
    return t.subscriptions().join(users.select("user_id"), "user_id", "left_semi")


@register(
    "campaign_dates",
    """SELECT campaign_id, objective, month_offset, duration_months,
              CAST(DATE '1995-01-01' + to_months(month_offset) AS DATE) AS start_date,
              greatest(least(last_day(CAST(DATE '1995-01-01' + to_months(month_offset + duration_months - 1) AS DATE)), DATE '2001-08-31'),
                       CAST(DATE '1995-01-01' + to_months(month_offset) AS DATE)) AS end_date,
              CAST(DATE '1995-01-01' + to_months(month_offset) AS DATE) <= DATE '2001-08-31'
                AND DATE '2001-08-31' <= greatest(least(last_day(CAST(DATE '1995-01-01' + to_months(month_offset + duration_months - 1) AS DATE)), DATE '2001-08-31'),
                                                  CAST(DATE '1995-01-01' + to_months(month_offset) AS DATE)) AS is_active_at_window_end
       FROM (SELECT campaign_id, objective, CAST(offers % 12 AS INT) AS month_offset, CAST(6 + offers % 80 AS INT) AS duration_months
             FROM fx_campaigns) d""",
)
def campaign_dates(spark, sf):
    c = _t(spark, sf).campaigns().select(
        "campaign_id", "objective",
        (F.col("offers") % 12).cast("int").alias("month_offset"), (F.lit(6) + F.col("offers") % 80).cast("int").alias("duration_months"),
    )
    return D.campaign_dates(c, WINDOW_START, WINDOW_END)
