"""Operational worklists, lookups and table functions.

Ranked lists are ``orderBy(...).limit(n)`` (TakeOrderedAndProject: each task
keeps its top n, the driver merges n x tasks rows) with the key as a
tiebreak (T19).  Filters are validated against allow-lists before use.
"""

from __future__ import annotations

import re
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import GEOS, RISK_BANDS, USER_ID_PATTERN, half_up_ratio, scaled_int
from tidemark.plans.metrics import current_source

# Limits of the reference's lists.
DEFAULT_LIMIT = 100
MAX_LIMIT = 500
DEFAULT_HISTORY_MONTHS = 3
MAX_HISTORY_MONTHS = 24
DO_NOW_DAYS = 30

WORKLIST_COLS = {
    "user_id": "user_id",
    "geo": "geo",
    "persona": "persona",
    "plan": "plan",
    "mrr": "mrr_usd",
    "score": "churn_score",
    "band": "churn_risk_band",
    "coding_trend": "coding_hours_trend_30d",
    "crm_touches": "crm_touches_30d",
}


def coerce_limit(n, default: int = DEFAULT_LIMIT, maximum: int = MAX_LIMIT) -> int:
    """K1: floor, then clamp to [1, max]; missing or non-numeric -> default."""
    try:
        v = float(n) if n is not None and n != "" else float(default)
    except (TypeError, ValueError):
        v = float(default)
    if not math.isfinite(v):
        v = float(default)
    return int(min(max(math.floor(v), 1), maximum))


def coerce_score(x, default: float = 0.0) -> float:
    try:
        v = float(x) if x is not None and x != "" else default
    except (TypeError, ValueError):
        return default
    return v if math.isfinite(v) else default


def _project(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(src).alias(out) for out, src in cols.items()])


def worklist_filter(
    band: str | None = None,
    geo: str | None = None,
    no_crm: bool = False,
    min_score=None,
    geos: Sequence[str] = GEOS,
) -> Column:
    """Subscribed AND optional band / geo / no-CRM / min score."""
    cond = F.col("is_currently_subscribed") == F.lit(True)
    if band:
        if band not in RISK_BANDS:
            raise ValueError(f"invalid band: {band}")
        cond = cond & (F.col("churn_risk_band") == band)
    if geo:
        if geo not in geos:
            raise ValueError(f"invalid geo: {geo}")
        cond = cond & (F.col("geo") == geo)
    if no_crm:
        cond = cond & (F.col("crm_touches_30d") == 0)
    if min_score is not None:
        cond = cond & (F.col("churn_score") >= F.lit(coerce_score(min_score)))
    return cond


def worklist_rows(
    predictions: DataFrame,
    serving: DataFrame,
    band: str | None = None,
    geo: str | None = None,
    no_crm: bool = False,
    min_score=None,
    geos: Sequence[str] = GEOS,
) -> DataFrame:
    """The whole filtered worklist, unordered and uncapped (for bulk callers and :func:`page`)."""
    return _project(current_source(serving, predictions).filter(worklist_filter(band, geo, no_crm, min_score, geos)), WORKLIST_COLS)


def worklist(
    predictions: DataFrame,
    serving: DataFrame,
    band: str | None = None,
    geo: str | None = None,
    no_crm: bool = False,
    min_score=None,
    limit=None,
    geos: Sequence[str] = GEOS,
    maximum: int = MAX_LIMIT,
) -> DataFrame:
    """The top of the filtered worklist, score desc (user_id tiebreak).

    ``limit`` is the user's request, clamped to ``maximum`` rows (the screen's
    500 by default); bulk callers pass their own maximum, or take
    :func:`worklist_rows`."""
    rows = worklist_rows(predictions, serving, band, geo, no_crm, min_score, geos)
    return rows.orderBy(F.col("score").desc(), F.col("user_id")).limit(coerce_limit(limit, maximum=maximum))


def last_touch(log: DataFrame, key: str = "user_id", ts: str = "logged_at") -> DataFrame:
    """Latest outreach per user (partial aggregate before the join)."""
    return log.groupBy(key).agg(F.max(ts).alias("last_touch"))


def do_now(
    predictions: DataFrame,
    serving: DataFrame,
    log: DataFrame | None = None,
    as_of=None,
    limit=None,
    days: int = DO_NOW_DAYS,
    maximum: int = MAX_LIMIT,
) -> DataFrame:
    """High-risk subscribers with no CRM touch, by MRR desc.

    With an outreach log, users logged within ``days`` of ``as_of`` are
    excluded (``last_touch`` pre-aggregated, then a left join: never touched or
    touched earlier than the cut-off are kept).  ``as_of`` defaults to the
    current time; ``"latest"`` uses the newest log entry.  Without a log it is the
    fallback form (T18).  ``limit`` is clamped to ``maximum`` rows."""
    src = current_source(serving, predictions).filter(
        (F.col("churn_risk_band") == "high") & (F.col("is_currently_subscribed") == F.lit(True)) & (F.col("crm_touches_30d") == 0)
    )
    if log is not None:
        lt = last_touch(log)
        src = src.join(lt, "user_id", "left")
        if isinstance(as_of, str) and as_of == "latest":
            # the log's own "now": newest entry (a scalar subquery, computed once)
            now_c = log.agg(F.max("logged_at")).scalar()
        else:
            now_c = F.lit(as_of) if as_of is not None else F.current_timestamp()
        cutoff = now_c - F.expr(f"INTERVAL {int(days)} DAYS")
        src = src.filter(F.col("last_touch").isNull() | (F.col("last_touch") < cutoff))
    n = coerce_limit(limit, maximum=maximum)
    return _project(src.orderBy(F.col("mrr_usd").desc_nulls_last(), F.col("user_id")).limit(n), WORKLIST_COLS)


def do_now_count(predictions: DataFrame, serving: DataFrame) -> DataFrame:
    """Uncapped count of the do-now cohort (no-log form)."""
    src = current_source(serving, predictions)
    return src.filter(
        (F.col("churn_risk_band") == "high") & (F.col("is_currently_subscribed") == F.lit(True)) & (F.col("crm_touches_30d") == 0)
    ).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


#: columns of a user's detail row besides those of the worklist
DETAIL_COLS = {
    "avg_acceptance_rate": "avg_acceptance_rate",
    "avg_session_frequency": "avg_session_frequency",
    "support_tickets": "support_tickets_30d",
    "tenure_months": "tenure_months",
    "is_currently_subscribed": "is_currently_subscribed",
}


def user_detail(predictions: DataFrame, serving: DataFrame, user_id) -> DataFrame:
    """One user's joined detail row; the key filter reaches both scans.

    Over gold tables it reads one bucket of each, and of its files the row
    groups whose Bloom filter and bounds may hold the key."""
    if isinstance(user_id, str) and not re.match(USER_ID_PATTERN, user_id):
        raise ValueError(f"invalid user id: {user_id}")
    p = predictions.filter(F.col("user_id") == F.lit(user_id))
    s = serving.filter(F.col("user_id") == F.lit(user_id))
    return _project(current_source(s, p), dict(WORKLIST_COLS) | DETAIL_COLS)


def user_detail_all(predictions: DataFrame, serving: DataFrame) -> DataFrame:
    """P4 for every user (the same projection, used as a bulk export)."""
    return _project(current_source(serving, predictions), dict(WORKLIST_COLS) | DETAIL_COLS)


def coding_history(labels: DataFrame, user_id=None, months=None, key: str = "user_id") -> DataFrame:
    """K3: a user's last N months (clamp 1..24, default 3) of avg coding hours,
    returned oldest first.  With ``user_id=None`` every user's last N months
    are returned (rank over the user's bounded month spine)."""
    from pyspark.sql import Window

    n = coerce_limit(months, DEFAULT_HISTORY_MONTHS, MAX_HISTORY_MONTHS)
    df = labels
    if user_id is not None:
        df = df.filter(F.col(key) == F.lit(user_id))
    w = Window.partitionBy(key).orderBy(F.col("month_start").desc())
    out = df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n)
    out = out.select(key, F.col("month_start").alias("month"), F.col("avg_coding_hours").alias("coding_hours"))
    if user_id is not None:
        return out.orderBy(key, "month")  # at most 24 rows
    # every user: rows are already hash-partitioned by user after the window,
    # so each user's months come out ascending without a global range sort
    return out.sortWithinPartitions(key, "month")


def page(df: DataFrame, order: Sequence[tuple[str, bool]], after: dict | None, n: int) -> DataFrame:
    """K6: key-based page: rows strictly after the last seen sort key, first n.

    ``order`` is ``[(col, descending), ...]`` ending in a unique key."""
    sort = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    if after:
        cond = None
        eq = F.lit(True)
        for c, d in order:
            v = F.lit(after[c])
            step = (F.col(c) < v) if d else (F.col(c) > v)
            term = eq & step
            cond = term if cond is None else cond | term
            eq = eq & (F.col(c) == v)
        df = df.filter(cond)
    return df.orderBy(*sort).limit(int(n))


def at_risk_users(predictions: DataFrame, serving: DataFrame, min_score: float = 0.8) -> DataFrame:
    """Subscribed users with score >= min_score, profile and MRR, score desc."""
    src = current_source(serving, predictions).filter(
        (F.col("is_currently_subscribed") == F.lit(True)) & (F.col("churn_score") >= F.lit(float(min_score)))
    )
    return src.select(
        "user_id", "churn_score", "churn_risk_band", "geo", "persona", "tier", "mrr_usd", "coding_hours_trend_30d", "crm_touches_30d"
    ).orderBy(F.col("churn_score").desc(), "user_id")


def reround(col, digits_in: int, digits_out: int) -> Column:
    """P10: present a non-negative ``digits_in``-decimal value at ``digits_out``
    decimals, half-up on exact integers (a decimal tie such as 0.1235 -> 0.124
    rounds the same on every engine)."""
    step = 10 ** (digits_in - digits_out)
    return half_up_ratio(scaled_int(col, digits_in), F.lit(step)) / F.lit(float(10**digits_out))


def highest_risk(predictions: DataFrame, serving: DataFrame, n: int = 50) -> DataFrame:
    """K4: the top ``n`` high-band subscribers by score (ties by user id), with
    profile, MRR, trend and touches; score shown at 3 dp, trend at 2 dp."""
    src = current_source(serving, predictions).filter(
        (F.col("churn_risk_band") == "high") & (F.col("is_currently_subscribed") == F.lit(True))
    )
    top = src.orderBy(F.col("churn_score").desc(), F.col("user_id")).limit(coerce_limit(n, 50))
    return top.select(
        "user_id",
        reround(F.col("churn_score"), 4, 3).alias("churn_score"),
        "geo", "persona", "tier", "mrr_usd",
        reround(F.col("coding_hours_trend_30d"), 4, 2).alias("coding_hours_trend_30d"),
        "crm_touches_30d",
    )


def untouched_at_risk_users(predictions: DataFrame, serving: DataFrame, band: str = "high") -> DataFrame:
    """Subscribed users of a band with zero CRM touches, MRR desc."""
    if band not in RISK_BANDS:
        raise ValueError(f"invalid band: {band}")
    src = current_source(serving, predictions).filter(
        (F.col("churn_risk_band") == band) & (F.col("is_currently_subscribed") == F.lit(True)) & (F.col("crm_touches_30d") == 0)
    )
    return src.select("user_id", "churn_score", "geo", "persona", "mrr_usd").orderBy(F.col("mrr_usd").desc_nulls_last(), "user_id")


def search(df: DataFrame, q: str, col: str = "user_id") -> DataFrame:
    """Case-insensitive substring match on an id column."""
    return df.filter(F.lower(F.col(col).cast("string")).contains(q.lower()))


def alias_values(df: DataFrame, col: str, aliases: DataFrame, out: str | None = None) -> DataFrame:
    """Business-word aliasing: ``lower(word)`` equi left join to a small
    (word, canonical) table, falling back to the word itself."""
    a = aliases.select(F.lower("word").alias("_w"), F.col("canonical").alias("_canon"))
    j = df.join(a, F.lower(F.col(col)) == F.col("_w"), "left")
    return j.withColumn(out or col, F.coalesce(F.col("_canon"), F.col(col))).drop("_w", "_canon")
