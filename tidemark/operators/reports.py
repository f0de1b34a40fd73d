"""Named reports (G11-G27).  Each is one or two aggregates with map-side
partials; results are small (one row per month / geo / cohort / campaign).

Means of fixed-decimal columns are rounded half-up exactly (``exact_mean``)
when the column's decimal scale is known, so reports are reproducible across
engines; otherwise ``round(avg, 4)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import exact_mean, half_up_ratio

# Decimal scales of the label columns (used for exact 4-dp means).
LABEL_SCALES = {
    "churned": 0,
    "avg_coding_hours": 3,
    "avg_acceptance_rate": 4,
    "avg_session_frequency": 3,
    "active_days": 0,
    "coding_hours_trend_30d": 4,
    "support_tickets_30d": 0,
}
# Coding-trend bucket edges (right-closed) and their labels.
TREND_EDGES = (-0.01, 0.5, 0.75, 0.9, 1.0, 1.25, 10.0)
TREND_LABELS = (
    "<=0.50 (collapsing)",
    "0.50-0.75 (steep decline)",
    "0.75-0.90 (declining)",
    "0.90-1.00 (flat/slight dip)",
    "1.00-1.25 (growing)",
    ">1.25 (surging)",
)
CORR_FEATURES = (
    "avg_coding_hours",
    "avg_acceptance_rate",
    "avg_session_frequency",
    "coding_hours_trend_30d",
    "active_days",
    "support_tickets_30d",
    "features_adopted",
    "tenure_months",
)


def mean4(col: str, scales: Mapping[str, int] = LABEL_SCALES) -> Column:
    """4-dp mean: exact half-up for known fixed-decimal columns."""
    c = F.col(col).cast("int") if col == "churned" else F.col(col)
    if col in scales:
        return exact_mean(c, scales[col], 4)
    return F.round(F.avg(c), 4)


def rate4(num: Column, den: Column) -> Column:
    """``round(num / den, 4)`` half-up on exact integers (NULL when den = 0)."""
    return F.when(den > 0, half_up_ratio(num * F.lit(10_000), den) / F.lit(10_000.0))


# ------------------------------------------------------------------------ G11


def monthly_summary(labels: DataFrame, month: str = "month_start") -> DataFrame:
    """At-risk users, churn events and rate, engagement means per month."""
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("at_risk_users"),
        F.count_if("churned").cast("bigint").alias("churn_events"),
        mean4("churned").alias("monthly_churn_rate"),
        mean4("avg_coding_hours").alias("avg_coding_hours"),
        mean4("avg_acceptance_rate").alias("avg_acceptance_rate"),
        mean4("avg_session_frequency").alias("avg_session_frequency"),
    ]
    if "is_power_user_month" in labels.columns:
        aggs.append(F.count_if("is_power_user_month").cast("bigint").alias("power_user_months"))
    return labels.groupBy(month).agg(*aggs).orderBy(month)


# ------------------------------------------------------------------------ G12


def geo_summary(labels: DataFrame, users: DataFrame) -> DataFrame:
    """Users and power users per geo (users table) left-joined to label
    aggregates per geo with zero fill (J12); power share = power / users."""
    counts = users.groupBy("geo").agg(
        F.count_distinct("user_id").cast("bigint").alias("users"),
        F.count_if(F.col("power_user_flag")).cast("bigint").alias("power_users"),
    )
    per_geo = labels.groupBy("geo").agg(
        F.count(F.lit(1)).cast("bigint").alias("at_risk_user_months"),
        F.count_if("churned").cast("bigint").alias("churn_events"),
        mean4("churned").alias("monthly_churn_rate"),
        mean4("avg_coding_hours").alias("avg_coding_hours"),
        mean4("avg_acceptance_rate").alias("avg_acceptance_rate"),
        mean4("avg_session_frequency").alias("avg_session_frequency"),
    )
    out = counts.join(per_geo, "geo", "left")
    zero_l = ["at_risk_user_months", "churn_events"]
    zero_d = ["monthly_churn_rate", "avg_coding_hours", "avg_acceptance_rate", "avg_session_frequency"]
    out = out.fillna(0, zero_l).fillna(0.0, zero_d)
    return out.withColumn("power_user_share", F.coalesce(rate4(F.col("power_users"), F.col("users")), F.lit(0.0))).orderBy(
        F.col("users").desc(), "geo"
    )


# ------------------------------------------------------------------------ G13


def churn_signal(labels: DataFrame, late: int = 3, key: str = "user_id", month: str = "month_start") -> DataFrame:
    """G13 (W4, W5): last ``late`` at-risk months of each user, churned vs
    retained cohort (ever churned), distinct users and six means.

    Position-from-end and ever-churned are windows over a user's label rows
    (bounded by the calendar span in months)."""
    w_desc = Window.partitionBy(key).orderBy(F.col(month).desc())
    w_all = Window.partitionBy(key)
    x = labels.withColumns(
        {"_from_end": F.row_number().over(w_desc) - 1, "_ever": F.max(F.col("churned").cast("int")).over(w_all)}
    ).filter(F.col("_from_end") < late)
    cohort = F.when(F.col("_ever") == 1, "churned").otherwise("retained")
    return x.groupBy(cohort.alias("cohort")).agg(
        F.count_distinct(key).cast("bigint").alias("users"),
        mean4("avg_coding_hours").alias("avg_coding_hours"),
        mean4("avg_acceptance_rate").alias("avg_acceptance_rate"),
        mean4("avg_session_frequency").alias("avg_session_frequency"),
        mean4("active_days").alias("avg_active_days"),
        mean4("coding_hours_trend_30d").alias("avg_coding_hours_trend"),
        mean4("support_tickets_30d").alias("avg_support_tickets"),
    )


# ------------------------------------------------------------------------ G14


def trend_bucket(col: str | Column, edges: Sequence[float] = TREND_EDGES, labels: Sequence[str] = TREND_LABELS) -> Column:
    """Right-closed buckets ``(e_i, e_{i+1}]``; values outside are NULL."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def trend_buckets(labels: DataFrame, col: str = "coding_hours_trend_30d") -> DataFrame:
    """Churn by coding-trend bucket; unmatched rows dropped."""
    b = labels.withColumn("trend_bucket", trend_bucket(col)).filter(F.col("trend_bucket").isNotNull())
    return b.groupBy("trend_bucket").agg(
        F.count(F.lit(1)).cast("bigint").alias("user_months"),
        mean4("churned").alias("churn_rate"),
        mean4("avg_coding_hours").alias("avg_coding_hours"),
        mean4("avg_acceptance_rate").alias("avg_acceptance_rate"),
        mean4("avg_session_frequency").alias("avg_session_frequency"),
    )


# ------------------------------------------------------------------------ G15


def correlations(df: DataFrame, features: Sequence[str] = CORR_FEATURES, target: str = "churned") -> DataFrame:
    """Pearson r of each feature with the target, in one pass, as rows."""
    y = F.col(target).cast("double")
    one = df.agg(*[F.corr(F.col(f).cast("double"), y).alias(f) for f in features])
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    return one.selectExpr(f"stack({len(features)}, {pairs}) AS (feature, r)").select(
        "feature", F.round("r", 4).alias("pearson_r_with_churned")
    )


# ------------------------------------------------------------------------ G16


def profile(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per column.

    ``exact=True`` uses ``percentile`` (linear interpolation) whose partial
    state is a value->count map, i.e. bounded by the number of *distinct*
    values (fine for rounded measures); ``exact=False`` uses
    ``percentile_approx`` with bounded memory for continuous columns."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        q = F.percentile(x, [0.25, 0.5, 0.75]) if exact else F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000)
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(x).cast("bigint").alias("count"),
                F.round(F.avg(x), 4).alias("mean"),
                F.round(F.stddev_samp(x), 4).alias("std"),
                F.min(x).alias("min"),
                q.alias("_q"),
                F.max(x).alias("max"),
            ).alias(c)
        )
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("r")).select("r.*")
    return rows.select(
        "column_name", "count", "mean", "std", "min",
        F.round(F.col("_q")[0], 4).alias("p25"), F.round(F.col("_q")[1], 4).alias("p50"), F.round(F.col("_q")[2], 4).alias("p75"),
        "max",
    )


# ------------------------------------------------------------------ G17 / G18


def category_counts(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Rows per category value, largest first."""
    return (
        df.groupBy(F.col(col).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
        .select(F.lit(name or col).alias("dimension"), "value", "n")
    )


def state_at_touch(touches: DataFrame, states: DataFrame, key: str = "user_id", date: str = "touch_date", month: str = "month_start") -> DataFrame:
    """Touches per state of the user in the touch's month.

    Touches are counted per user and month first, so the join has one row per
    user-month on both sides; months without a state count as not subscribed.
    """
    counts = touches.groupBy(F.col(key), F.trunc(date, "month").alias(month)).agg(F.count(F.lit(1)).alias("_n"))
    state = F.coalesce(F.col("user_state"), F.lit("not_subscribed")).alias("value")
    found = counts.join(states.select(key, month, "user_state"), [key, month], "left").groupBy(state).agg(F.sum("_n").cast("bigint").alias("n"))
    return found.select(F.lit("user_state_at_touch").alias("dimension"), "value", "n")


def subscription_mix(terms: DataFrame, users: DataFrame) -> DataFrame:
    """Terms, users, terms per user, downgrade/reactivation terms and
    total revenue (exact cents) in one row."""
    t = terms.agg(
        F.count(F.lit(1)).cast("bigint").alias("terms"),
        F.count_if("is_downgrade").cast("bigint").alias("downgrade_terms"),
        F.count_if("is_reactivation").cast("bigint").alias("reactivation_terms"),
        (F.sum(F.round(F.col("revenue_usd") * 100, 0).cast("bigint")) / F.lit(100.0)).alias("total_revenue_usd"),
    )
    u = users.agg(F.count(F.lit(1)).cast("bigint")).scalar()
    return t.withColumn("users", u).withColumn(
        "terms_per_user", half_up_ratio(F.col("terms") * F.lit(1000), F.col("users")) / F.lit(1000.0)
    )


# ------------------------------------------------------------------------ G19


def feature_stickiness(fa: DataFrame) -> DataFrame:
    """Rows, adoption rate, mean activations and depth per feature."""
    return fa.groupBy("feature_key").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        exact_mean(F.col("is_adopted").cast("int"), 0).alias("adoption_rate"),
        exact_mean(F.col("activation_count"), 0).alias("avg_activations"),
        exact_mean(F.col("depth_score"), 4).alias("avg_depth"),
    )


# ------------------------------------------------------------------------ G20


def support_summary(tickets: DataFrame, by: str = "channel") -> DataFrame:
    """Tickets, mean chat messages, mean CSAT (NULLs skipped) and
    escalation rate per ``by``."""
    return tickets.groupBy(by).agg(
        F.count(F.lit(1)).cast("bigint").alias("tickets"),
        exact_mean(F.col("chat_message_count"), 0).alias("avg_chat_messages"),
        exact_mean(F.col("csat_score"), 0).alias("avg_csat"),
        exact_mean(F.col("is_escalated").cast("int"), 0).alias("escalation_rate"),
    )


def support_overall(tickets: DataFrame) -> DataFrame:
    """Overall CSAT, CSAT response rate, total chat messages."""
    return tickets.agg(
        exact_mean(F.col("csat_score"), 0).alias("avg_csat"),
        rate4(F.count("csat_score"), F.count(F.lit(1))).alias("response_rate"),
        F.sum("chat_message_count").cast("bigint").alias("total_chat_messages"),
    )


# ------------------------------------------------------------------ G21 / G22


def campaign_funnel(touches: DataFrame) -> DataFrame:
    """Per campaign touches and delivered/open/click/reactivation rates, cost."""
    r = lambda c: exact_mean(F.col(c).cast("int"), 0)
    return touches.groupBy("campaign_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("touches"),
        r("delivered").alias("delivered_rate"),
        r("opened").alias("open_rate"),
        r("clicked").alias("click_rate"),
        r("reactivated").alias("reactivation_rate"),
        F.round(F.sum("cost_usd"), 2).alias("cost_usd"),
    )


def reactivation_kpi(touches: DataFrame, campaigns: DataFrame) -> DataFrame:
    """G22 (J8): reactivation rate over *delivered* touches of winback
    campaigns (semi join on the small campaign table), with num/den (T15)."""
    wb = campaigns.filter(F.col("objective") == "winback").select("campaign_id")
    t = touches.join(wb, "campaign_id", "left_semi").filter(F.col("delivered"))
    return t.agg(
        F.count_if("reactivated").cast("bigint").alias("reactivated"),
        F.count(F.lit(1)).cast("bigint").alias("delivered_winback_touches"),
    ).withColumn("reactivation_rate", rate4(F.col("reactivated"), F.col("delivered_winback_touches")))


# ------------------------------------------------------------------------ G23


def kpi_fractions(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``[(kpi, one-row df with num, den), ...]`` -> (kpi, num, den, rate)."""
    out = None
    for name, df in parts:
        r = df.select(F.lit(name).alias("kpi"), F.col("num").cast("bigint"), F.col("den").cast("bigint"))
        out = r if out is None else out.unionByName(r)
    return out.withColumn("rate", rate4(F.col("num"), F.col("den")))


# ------------------------------------------------------------------------ G24


def trend_contrast(labels: DataFrame, users: DataFrame, low: float = 0.75, high: float = 1.0) -> DataFrame:
    """G24 (J13): churn where trend < low vs >= high; power users vs the rest."""
    j = labels.join(users.select("user_id", "power_user_flag"), "user_id")
    tr = F.col("coding_hours_trend_30d")
    cohort = F.when(tr < F.lit(low), "declining").when(tr >= F.lit(high), "growing")
    a = j.filter(cohort.isNotNull()).groupBy(cohort.alias("cohort"))
    b = j.groupBy(F.when(F.col("power_user_flag"), "power").otherwise("rest").alias("cohort"))
    aggs = [F.count(F.lit(1)).cast("bigint").alias("user_months"), mean4("churned").alias("churn_rate")]
    return a.agg(*aggs).unionByName(b.agg(*aggs))


# ------------------------------------------------------------------------ G27


def ingest_summary(df: DataFrame, key: str = "user_id", date: str = "event_date") -> DataFrame:
    """Rows, distinct keys, first and last day, in one global aggregate."""
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.count_distinct(key).cast("bigint").alias("users"),
        F.min(date).alias("first_day"),
        F.max(date).alias("last_day"),
    )
