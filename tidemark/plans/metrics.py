"""Semantic layer: declare measures once, evaluate at any grouping.

Spark 4.1 has no ``MEASURE()``/metric views, so a :class:`MetricView` keeps a
mapping ``name -> Column`` for dimensions and measures and compiles a query to
``filter -> groupBy(dims) -> agg(measures)``; Catalyst then does pushdown,
partial aggregation and column pruning as for any DataFrame query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import exact_mean, half_up_ratio


@dataclass
class MetricView:
    source: DataFrame
    dimensions: Mapping[str, Column] = field(default_factory=dict)
    measures: Mapping[str, Column] = field(default_factory=dict)

    def dim(self, name: str) -> Column:
        if name not in self.dimensions:
            raise KeyError(f"unknown dimension {name!r}; have {sorted(self.dimensions)}")
        return self.dimensions[name]

    def query(
        self,
        measures: Sequence[str] | Mapping[str, str],
        by: Sequence[str] | Mapping[str, str] = (),
        where: Column | None = None,
        order_by: Sequence[Column] | None = None,
    ) -> DataFrame:
        """Evaluate ``measures`` grouped by dimensions ``by``.

        ``measures``/``by`` may be lists of names or ``{name: output_alias}``.
        With no ``by`` the result is one row (global aggregate).
        """
        mmap = dict(measures) if isinstance(measures, Mapping) else {m: m for m in measures}
        bmap = dict(by) if isinstance(by, Mapping) else {b: b for b in by}
        for m in mmap:
            if m not in self.measures:
                raise KeyError(f"unknown measure {m!r}; have {sorted(self.measures)}")
        df = self.source
        if where is not None:
            df = df.filter(where)
        aggs = [self.measures[m].alias(a) for m, a in mmap.items()]
        if bmap:
            out = df.groupBy(*[self.dim(b).alias(a) for b, a in bmap.items()]).agg(*aggs)
        else:
            out = df.agg(*aggs)
        if order_by:
            out = out.orderBy(*order_by)
        return out


def latest_period(df: DataFrame, col: str) -> DataFrame:
    """P5: rows of the latest period, ``col = (SELECT max(col))``.

    The max is a one-row aggregate joined back by broadcast (one row, bounded).
    """
    mx = df.agg(F.max(col).alias("_max_period"))
    return df.join(F.broadcast(mx), F.col(col) == F.col("_max_period"), "left_semi")


def monthly_view(labels: DataFrame) -> MetricView:
    """Certified monthly measures over one row per at-risk user-month (T5)."""
    # Averages are exact half-up 4-dp means of the fixed-decimal label columns
    # (scale 0 for the churn flag, 3 for hours, 4 for rates and trends).
    measures = {
        "At risk users": F.count(F.lit(1)),
        "Churned users": F.count_if(F.col("churned")),
        "Churn rate": exact_mean(F.col("churned").cast("int"), 0),
        "Avg coding hours": exact_mean(F.col("avg_coding_hours"), 3),
        "Avg acceptance rate": exact_mean(F.col("avg_acceptance_rate"), 4),
    }
    if "coding_hours_trend_30d" in labels.columns:
        measures["Avg coding hours trend"] = exact_mean(F.col("coding_hours_trend_30d"), 4)
    dims = {"Month": F.col("month_start"), "Geo": F.col("geo")}
    if "is_power_user_month" in labels.columns:
        dims["Is power user month"] = F.col("is_power_user_month")
    return MetricView(labels, dims, measures)


def current_source(serving: DataFrame, predictions: DataFrame, key: str = "user_id") -> DataFrame:
    """Serving inner join predictions on the user key (1:1)."""
    p = predictions.select(key, "churn_risk_band", "churn_score")
    return serving.join(p, key, "inner")


def current_view(serving: DataFrame, predictions: DataFrame) -> MetricView:
    """Certified current-state measures (one row per user)."""
    src = current_source(serving, predictions)
    sub = F.col("is_currently_subscribed")
    measures = {
        "Users": F.count(F.lit(1)),
        "Currently subscribed users": F.count_if(sub),
        "High risk users": F.count_if(F.col("churn_risk_band") == "high"),
        "Total MRR": F.sum("mrr_usd"),
        # SUM(mrr) FILTER (WHERE subscribed): NULL flags are skipped
        "MRR at risk": F.sum(F.when(sub, F.col("mrr_usd"))),
        "Avg churn score": exact_mean(F.col("churn_score"), 4),
        "Avg coding hours trend": exact_mean(F.col("coding_hours_trend_30d"), 4),
        "Avg acceptance rate": exact_mean(F.col("avg_acceptance_rate"), 4),
        "Avg session frequency": exact_mean(F.col("avg_session_frequency"), 3),
    }
    dims = {
        "Geo": F.col("geo"),
        "Persona": F.col("persona"),
        "Tier": F.col("tier"),
        "Plan": F.col("plan"),
        "Risk band": F.col("churn_risk_band"),
        "Subscription status": F.col("subscription_status"),
        "Is currently subscribed": sub,
    }
    if "power_user_flag" in src.columns:
        dims["Is power user"] = F.col("power_user_flag")
    return MetricView(src, dims, measures)


def kpi_header(current: MetricView, monthly: MetricView) -> DataFrame:
    """One record: latest churn %, MRR at risk total and per band, subscribers.

    Three one-row aggregates combined; the per-band figures are a pivot over
    the three known bands (so the output schema is fixed)."""
    lm =monthly.source.agg(F.max("month_start").alias("_m"))
    latest = (
        monthly.source.join(F.broadcast(lm), F.col("month_start") == F.col("_m"), "left_semi")
        .agg((half_up_ratio(F.count_if("churned") * 10_000, F.count(F.lit(1))) / F.lit(100.0)).alias("churn_rate_pct"))
    )
    sub = F.col("is_currently_subscribed")
    mrr = F.when(sub, F.col("mrr_usd"))
    band = F.col("churn_risk_band")
    money = current.source.agg(
        F.round(F.coalesce(F.sum(mrr), F.lit(0.0)), 2).alias("mrr_at_risk_total"),
        F.round(F.coalesce(F.sum(F.when(band == "high", mrr)), F.lit(0.0)), 2).alias("mrr_at_risk_high"),
        F.round(F.coalesce(F.sum(F.when(band == "medium", mrr)), F.lit(0.0)), 2).alias("mrr_at_risk_medium"),
        F.round(F.coalesce(F.sum(F.when(band == "low", mrr)), F.lit(0.0)), 2).alias("mrr_at_risk_low"),
        F.count_if(sub).cast("bigint").alias("active_subscribers"),
    )
    # one-row aggregates side by side: scalar subqueries (merged into one pass)
    return latest.select("*", *[money.select(c).scalar().alias(c) for c in money.columns])


# Fixed constants of the annual-impact formula.
def annual_impact(arr: Column, nrr_pct: Column, prevented: Column, base: Column, ltv: Column) -> Column:
    """``ARR x NRR% + prevention x base x LTV``."""
    return arr * nrr_pct / F.lit(100.0) + prevented * base * ltv
