"""Derived-table builders (D1-D29) and window helpers.

Grains are *user* and *user x month*.  Per-user windows here run only over
month spines or term lists whose length is bounded by the calendar span, never
over a user's raw events; raw events are aggregated first (map-side combine).
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import half_up_ratio, is_subscribed, scaled_int
from tidemark.session import checkpoint_dir

# Fixed values of the reference's derivation rules.
POWER_USER_HOURS = 4.0  # a qualifying day has >= 4.0 coding hours
POWER_USER_DAYS = 5  # a power week has >= 5 qualifying days
POWER_USER_MONTH_SHARE = 0.5  # qualifying months >= ceil(0.5 x observed months)
POWER_USER_MIN_MONTHS = 2  # at least 2 observed months
TREND_LO, TREND_HI = 0.0, 5.0  # month-over-month ratio clip
AT_RISK_RATIO = 0.92  # user-state threshold on the 3-month decline ratio
WINBACK_MONTHS = 3  # lapsed at most 3 months ago
WINBACK_MAX_REACTIVATIONS = 1  # fewer than one prior reactivation
DECLINE_CLIP_1M = (-1.0, 2.0)
DECLINE_CLIP_3M = (-1.0, 2.5)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ W1 / W2


def latest_per_key(df: DataFrame, key: str | Sequence[str], order_col: str) -> DataFrame:
    """The row with the greatest ``order_col`` per key.

    ``max_by(struct(row), order)`` is a plain aggregate with a map-side partial,
    so no sort of a key's rows and no single-task gathering of a hot key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(order_col)).alias("_latest"))
        .select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in rest])
    )


# ------------------------------------------------------------------- D6 / D9


def user_month_spine(df: DataFrame, start: str, end: str, key: str = "user_id", out: str = "month_start", partitions: int | None = None) -> DataFrame:
    """One row per key per calendar month from ``start`` to ``end`` (inclusive).

    partitions: deal the keys to so many tasks first; their few short rows
    may all lie in one, which would then hold the months of all of them."""
    m0 = F.trunc(_c(start).cast("date"), "month")
    m1 = F.trunc(_c(end).cast("date"), "month")
    if partitions:
        df = df.repartition(partitions, key)
    return df.select(F.col(key), F.explode(F.sequence(m0, m1, F.expr("INTERVAL 1 MONTH"))).alias(out))


def tenure_months(df: DataFrame, start: str, at: str, out: str = "tenure_months") -> DataFrame:
    """Whole months from the start month to ``at``'s month, clamped at 0."""
    m = F.months_between(F.trunc(_c(at).cast("date"), "month"), F.trunc(_c(start).cast("date"), "month"))
    return df.withColumn(out, F.greatest(F.round(m, 0).cast("bigint"), F.lit(0).cast("bigint")))


def tenure_days(df: DataFrame, start: str, as_of, out: str = "tenure_days_at_window_end") -> DataFrame:
    """Days from ``start`` to ``as_of``, clamped at 0."""
    as_of_c = F.lit(as_of) if isinstance(as_of, _dt.date) else _c(as_of)
    return df.withColumn(out, F.greatest(F.datediff(as_of_c, _c(start)), F.lit(0)).cast("bigint"))


# ------------------------------------------------------------------------ D5


def mom_ratio(
    df: DataFrame,
    value: str,
    out: str,
    key: str = "user_id",
    month: str = "month_start",
    lo: float = TREND_LO,
    hi: float = TREND_HI,
    digits: int = 4,
    value_digits: int | None = None,
) -> DataFrame:
    """``value / previous calendar month's value`` on a user x month spine.

    A missing previous month counts as zero activity (T2); the first month, a
    previous value <= 0 and non-finite ratios give 1.0 (T3); the ratio is
    clipped to ``[lo, hi]`` and rounded.  The per-user window is bounded by
    the number of months in the span.
    """
    w = Window.partitionBy(key).orderBy(month)
    prev_m = F.lag(month).over(w)
    prev_v = F.lag(value).over(w)
    prev = F.when(prev_m == F.add_months(F.col(month), -1), prev_v).otherwise(F.lit(0.0))
    if value_digits is not None and lo <= 0:
        # fixed-decimal values: exact half-up ratio (non-negative), then the upper clip
        num = scaled_int(F.col(value), value_digits) * F.lit(10**digits)
        q = half_up_ratio(num, scaled_int(prev, value_digits)) / F.lit(float(10**digits))
        return df.withColumn(out, F.when(prev > 0, F.least(q, F.lit(hi))).otherwise(F.lit(1.0)))
    ratio = F.try_divide(F.col(value).cast("double"), prev.cast("double"))
    ratio = F.when((prev > 0) & ratio.isNotNull() & ~F.isnan(ratio), ratio).otherwise(F.lit(1.0))
    return df.withColumn(out, F.round(F.least(F.greatest(ratio, F.lit(lo)), F.lit(hi)), digits))


# ------------------------------------------------------------------------ D1


def monthly_usage(
    events: DataFrame,
    key: str = "user_id",
    date: str = "event_date",
    hours: str = "coding_hours",
    acceptance: str = "ai_acceptance_rate",
    sessions: str = "session_frequency",
) -> DataFrame:
    """Active days and per-active-day means per user x calendar month."""
    return events.groupBy(F.col(key), F.trunc(_c(date), "month").alias("month_start")).agg(
        F.count(F.lit(1)).cast("bigint").alias("active_days"),
        F.avg(hours).alias("avg_coding_hours"),
        F.avg(acceptance).alias("avg_acceptance_rate"),
        F.avg(F.col(sessions).cast("double")).alias("avg_session_frequency"),
    )


# ------------------------------------------------------------------ D2 / D3


def power_weeks(
    events: DataFrame,
    window_start: _dt.date | None = None,
    min_hours: float = POWER_USER_HOURS,
    min_days: int = POWER_USER_DAYS,
    key: str = "user_id",
    date: str = "event_date",
    hours: str = "coding_hours",
) -> DataFrame:
    """Monday weeks with >= ``min_days`` days of >= ``min_hours`` hours.

    A week is attributed to the month of its first in-window day:
    ``month(greatest(monday, window_start))`` (T9).  Output: one row per
    user x month with ``power_weeks`` > 0.
    """
    week = F.date_trunc("week", _c(date)).cast("date")
    q = events.filter(F.col(hours) >= F.lit(min_hours)).groupBy(F.col(key), week.alias("week_start")).agg(
        F.count(F.lit(1)).alias("qualifying_days")
    )
    q = q.filter(F.col("qualifying_days") >= min_days)
    first_day = F.col("week_start")
    if window_start is not None:
        first_day = F.greatest(first_day, F.lit(window_start))
    return q.groupBy(F.col(key), F.trunc(first_day, "month").alias("month_start")).agg(
        F.count(F.lit(1)).cast("bigint").alias("power_weeks")
    )


def power_user_flag(
    events: DataFrame,
    window_start: _dt.date | None = None,
    share: float = POWER_USER_MONTH_SHARE,
    min_months: int = POWER_USER_MIN_MONTHS,
    key: str = "user_id",
    date: str = "event_date",
    hours: str = "coding_hours",
    min_hours: float = POWER_USER_HOURS,
    min_days: int = POWER_USER_DAYS,
) -> DataFrame:
    """D3 (sustained) and D4 (ever) power-user flags per user.

    observed = months with activity; qualifying = months with a power week.
    Sustained: observed >= ``min_months`` and qualifying >= ceil(share x
    max(observed, 1)) and qualifying > 0.
    """
    observed = events.groupBy(key).agg(
        F.count_distinct(F.trunc(_c(date), "month")).cast("bigint").alias("observed_months")
    )
    pw = power_weeks(events, window_start, min_hours, min_days, key, date, hours)
    qualifying = pw.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("qualifying_months"))
    j = observed.join(qualifying, key, "full").fillna(0, ["observed_months", "qualifying_months"])
    return j.select(
        key,
        "observed_months",
        "qualifying_months",
        sustained_flag("observed_months", "qualifying_months", share, min_months).alias("power_user_flag"),
        (F.col("qualifying_months") > 0).alias("ever_power_user"),
    )


def sustained_flag(observed, qualifying, share: float = POWER_USER_MONTH_SHARE, min_months: int = POWER_USER_MIN_MONTHS) -> Column:
    """D3 predicate: observed >= min_months, qualifying >= ceil(share x
    max(observed, 1)) and qualifying > 0."""
    o, q = _c(observed), _c(qualifying)
    need = F.ceil(F.lit(share) * F.greatest(o, F.lit(1)))
    return (o >= min_months) & (q >= need) & (q > 0)


# ------------------------------------------------------------------ D7 / D8


def cover_deltas(terms: DataFrame, key: str = "user_id", month: str = "month_start", out: str = "delta") -> DataFrame:
    """D7's terms as differences: +1 in the first month a term covers, -1 in the month after its last.

    A term covers month ``m`` when it started before ``m`` (or on ``m`` as a
    plan change, T23) and has no end or ends on/after ``m``; the signup month
    itself is therefore not at risk.  At most two rows per term, however long
    it runs; an open term has no -1.
    """
    return terms.select(F.col(key), F.explode(F.array(*cover_events())).alias("_e")).select(
        F.col(key), F.col("_e.month").alias(month), F.col("_e.delta").alias(out)
    ).where(F.col(month).isNotNull())


def cover_events() -> tuple[Column, Column]:
    """(month, delta) of a term's first covered month and of the month after its last; a null month where there is none."""
    m0 = F.trunc(F.col("term_start_date"), "month")
    first = F.when(F.col("is_downgrade") & (F.col("term_start_date") == m0), m0).otherwise(F.add_months(m0, 1))
    end = F.trunc(F.col("term_end_date"), "month")
    covers = end.isNull() | (first <= end)
    begins = F.struct(F.when(covers, first).alias("month"), F.lit(1).alias("delta"))
    over = F.struct(F.when(covers, F.add_months(end, 1)).alias("month"), F.lit(-1).alias("delta"))
    return begins, over


def at_risk_months(terms: DataFrame, spine: DataFrame, key: str = "user_id", month: str = "month_start", partitions: int | None = None) -> DataFrame:
    """User-months of ``spine`` where the user is a subscriber on the 1st.

    The union of a user's terms comes from counted starts and ends
    (:func:`cover_deltas`): one row per user and month with a change or in the
    spine, and a running sum over them, which is bounded by the calendar span.
    No term is expanded into its months.

    partitions: count changes per user and month, and run the sums, in so many
    tasks; without it Spark's setting holds.
    """
    changes = cover_deltas(terms, key, month, "_d")
    if partitions:
        changes = changes.repartition(partitions, key, month)
    changes = changes.groupBy(key, month).agg(F.sum("_d").alias("_d")).withColumn("_spine", F.lit(False))
    marked = spine.select(key, month).withColumns({"_d": F.lit(0).cast("long"), "_spine": F.lit(True)})
    rows = marked.unionByName(changes)
    if partitions:
        rows = rows.repartition(partitions, key)
    rows = rows.groupBy(key, month).agg(F.sum("_d").alias("_d"), F.max("_spine").alias("_spine"))
    run = Window.partitionBy(key).orderBy(month).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_open", F.sum("_d").over(run)).where((F.col("_open") > 0) & F.col("_spine")).select(key, month)


def dense_months(
    rows: DataFrame,
    present: str,
    running: dict[str, str],
    sums: list[str],
    keep: list[str] = (),
    key: str = "user_id",
    month: str = "month_start",
) -> DataFrame:
    """Every month from a user's first to last row with ``present`` > 0, from one row per user and month with any event.

    ``running`` (out -> column) are sums over all months so far, also those
    before the first; ``sums`` are the month's own values, 0 in months without
    events; ``keep`` are the month's own values too, null there.  Months in
    between are generated from the row before them, so the rows are read once:
    one window per user, bounded by the calendar span.
    """
    own = Window.partitionBy(key)
    order = own.orderBy(month)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.when(F.col(present) > 0, F.col(month))
    wide = rows.withColumns(
        {
            **{out: F.coalesce(F.sum(c).over(run), F.lit(0)) for out, c in running.items()},
            "_m0": F.min(seen).over(own),
            "_m1": F.max(seen).over(own),
            "_till": F.add_months(F.lead(month).over(order), -1),
        }
    )
    begin = F.greatest(month, "_m0")
    end = F.least(F.coalesce("_till", "_m1"), F.col("_m1"))
    filled = wide.where(begin <= end).withColumn("_m", F.explode(F.sequence(begin, end, F.expr("INTERVAL 1 MONTH"))))
    here = F.col("_m") == F.col(month)
    columns = [F.coalesce(F.when(here, F.col(c)), F.lit(0)).alias(c) for c in sums] + [F.when(here, F.col(c)).alias(c) for c in keep]
    return filled.select(key, F.col("_m").alias(month), *running, *columns, F.col("_m1").alias("last_month"))


# ----------------------------------------------------------------- D10 / D11


def counts_per_month(
    df: DataFrame, date_col: str, out: str, spine: DataFrame | None = None, key: str = "user_id", month: str = "month_start"
) -> DataFrame:
    """Rows per user x calendar month (T1: calendar month, not rolling),
    optionally left-joined onto a spine with zero fill."""
    c = df.groupBy(F.col(key), F.trunc(_c(date_col), "month").alias(month)).agg(F.count(F.lit(1)).cast("bigint").alias(out))
    if spine is None:
        return c
    return spine.join(c, [key, month], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("bigint")))


# ----------------------------------------------------------------- D12 / D13


def features_adopted(
    activations: DataFrame,
    spine: DataFrame,
    feature: str = "feature_key",
    date: str = "activation_date",
    key: str = "user_id",
    month: str = "month_start",
    weights: DataFrame | None = None,
    out: str = "features_adopted",
) -> DataFrame:
    """D12/W7 (and D13 with ``weights``): cumulative distinct features whose
    first-activation month is <= the spine month.

    First month per (user, feature) is an aggregate; the running sum runs over
    the user's month spine (bounded by the calendar span).
    """
    first = activations.groupBy(key, feature).agg(F.trunc(F.min(_c(date)), "month").alias("_first"))
    if weights is not None:
        first = first.join(weights, feature, "left")
        val = F.coalesce(F.col("weight"), F.lit(0.0))
    else:
        val = F.lit(1)
    # A feature first seen before the user's first spine month counts from that
    # month on: clamp to the user's spine start (one row per user), so a single
    # pass over the activations feeds the running sum.
    m0 = spine.groupBy(key).agg(F.min(month).alias("_m0"))
    per_month = (
        first.join(m0, key)
        .groupBy(F.col(key), F.greatest(F.col("_first"), F.col("_m0")).alias(month))
        .agg(F.sum(val).alias("_new"))
    )
    w = Window.partitionBy(key).orderBy(month).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(F.coalesce(F.col("_new"), F.lit(0))).over(w)
    j = spine.join(per_month, [key, month], "left")
    res = running.cast("bigint") if weights is None else F.round(running, 4)
    return j.withColumn(out, res).drop("_new")


def day_bits(day):
    """A bit per day of the month that a row of the group has: ``bit_count`` of it, also of several joined by ``bit_or``, counts days once."""
    return F.bit_or(F.expr(f"shiftleft(1, day({day}) - 1)"))


def feature_adoption(
    usage: DataFrame | None,
    spine: DataFrame,
    feature_days: DataFrame,
    key: str = "user_id",
    month: str = "month_start",
    feature: str = "feature_key",
    partitions: int | None = None,
) -> DataFrame:
    """One row per user x feature x spine month, never adopted features too.

    ``usage`` has the user's active days; None: those with a row in
    ``feature_days``, whatever its feature.
    ``feature_days`` has (user, feature, date, activations) usage rows; the
    features are its distinct keys (a catalogue, one value each), exploded per
    spine row, so the size is the result's own.
    is_adopted = first activation month <= month; first_activation_date = the
    first day of the first month (NULL until adopted); activation_count and
    active_days for the month; depth = clip(feature_days / user active days,
    0, 1) rounded to 4 (0 when the user had no active days).

    What is known of a user and month meets in one row, with a map of the
    month's features and one of those adopted so far (by their place in the
    catalogue).  Features are exploded last: the result is never shuffled or
    sorted.  The rows are dealt by user; partitions: into so many tasks.
    """
    by_month = feature_days.groupBy(F.col(key), F.col(feature), F.trunc("date", "month").alias(month)).agg(
        day_bits("date").alias("_bits"), F.sum("activations").cast("bigint").alias("_acts")
    )
    # a condition that every row meets: it keeps the dates in the catalogue's plan, so that it reads the rows' exchange
    catalogue = by_month.where("coalesce(_bits, 0) >= 0").select(feature).distinct().agg(F.sort_array(F.collect_set(feature))).scalar()
    fm = by_month.where("_bits IS NOT NULL")
    first = F.min(month).over(Window.partitionBy(key, feature))
    place = (F.array_position("_features", F.col(feature)) - 1).cast("int")
    fm = fm.withColumn("_first", F.col(month) == first).withColumn("_features", catalogue)
    rows = fm.select(key, month, place.alias("_place"), "_bits", "_acts", "_first")
    if usage is not None:
        days = usage.where(F.col(key).isNotNull() & F.col("event_date").isNotNull())
        rows = rows.unionByName(days.select(F.col(key), F.trunc("event_date", "month").alias(month), F.lit(1).alias("_day")), allowMissingColumns=True)
    rows = rows.unionByName(spine.select(key, month, F.lit(1).alias("_spine")), allowMissingColumns=True)
    if partitions:
        rows = rows.repartition(partitions, key)
    used = F.when(F.col("_place").isNotNull(), F.struct("_place", F.struct(F.bit_count("_bits").cast("bigint").alias("_fdays"), "_acts")))
    new = F.when(F.col("_first") & F.col("_place").isNotNull(), F.struct("_place", F.col(month)))
    udays = F.bit_count(F.bit_or("_bits")) if usage is None else F.sum("_day")
    per_month = rows.groupBy(key, month).agg(
        F.sum("_spine").alias("_spine"),
        udays.cast("bigint").alias("_udays"),
        F.map_from_entries(F.collect_list(used)).alias("_used"),
        F.collect_list(new).alias("_new"),
    )
    so_far = Window.partitionBy(key).orderBy(month).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adoptions = F.collect_list(F.when(F.size("_new") > 0, F.col("_new"))).over(so_far)
    every = per_month.withColumn("_adopted", F.map_from_entries(F.flatten(adoptions))).where("_spine > 0").withColumn("_features", catalogue)
    copies = F.array_repeat(F.lit(True), F.col("_spine").cast("int"))
    every = every.withColumn("_copy", F.explode(copies)).select(key, month, "_udays", "_used", "_adopted", F.posexplode("_features").alias("_place", feature))
    j = every.withColumns({"_first": F.element_at("_adopted", F.col("_place")), "_u": F.element_at("_used", F.col("_place"))})
    adopted = F.col("_first").isNotNull()
    fdays = F.coalesce(F.col("_u._fdays"), F.lit(0)).cast("bigint")
    udays = F.coalesce(F.col("_udays"), F.lit(0))
    depth = F.when(udays > 0, F.least(F.greatest(F.try_divide(fdays.cast("double"), udays.cast("double")), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return j.select(
        F.col(month),
        F.col(key),
        F.col(feature),
        adopted.alias("is_adopted"),
        F.col("_first").alias("first_activation_date"),
        F.coalesce(F.col("_u._acts"), F.lit(0)).cast("bigint").alias("activation_count"),
        fdays.alias("active_days"),
        F.round(depth, 4).alias("depth_score"),
    )


# ------------------------------------------------------------------------ D15


def churn_labels(behaviour: DataFrame, at_risk: str = "at_risk") -> DataFrame:
    """The rows of at-risk user-months, of behaviour columns computed on
    the dense spine (so trends see zero months)."""
    return behaviour.where(at_risk)


# ------------------------------------------------------------------------ D16


def serving_snapshot(
    users: DataFrame,
    labels: DataFrame,
    terms: DataFrame,
    key: str = "user_id",
    label_order: str = "month_start",
    term_order: str = "term_index",
) -> DataFrame:
    """One row per user with the latest label and latest term.

    Latest rows are ``max_by`` aggregates (W1/W2); both come out hash
    partitioned on the user key, so the two left joins with users add one
    exchange for users only.
    """
    ll = latest_per_key(labels, key, label_order)
    ls = latest_per_key(terms, key, term_order)
    ucols = [c for c in ("geo", "plan", "tier", "persona", "power_user_flag", "signup_date", "tenure_days_at_window_end") if c in users.columns]
    lmap = [
        (label_order, "as_of_month"),
        ("churned", "churned_latest_month"),
        ("tenure_months", "tenure_months"),
        ("is_power_user_month", "is_power_user_month"),
        ("active_days", "active_days"),
        ("avg_coding_hours", "avg_coding_hours"),
        ("avg_acceptance_rate", "avg_acceptance_rate"),
        ("avg_session_frequency", "avg_session_frequency"),
        ("coding_hours_trend_30d", "coding_hours_trend_30d"),
        ("support_tickets_30d", "support_tickets_30d"),
        ("features_adopted", "features_adopted"),
        ("crm_touches_30d", "crm_touches_30d"),
    ]
    lsel = [F.col(f"ll.{a}").alias(b) for a, b in lmap if a in ll.columns]
    tsel = [F.col("ls.status").alias("subscription_status"), is_subscribed(F.col("ls.status")).alias("is_currently_subscribed")]
    tsel += [F.col(f"ls.{c}").alias(c) for c in ("billing_period", "mrr_usd") if c in ls.columns]
    return (
        users.alias("u")
        .join(ll.alias("ll"), F.col(f"u.{key}") == F.col(f"ll.{key}"), "left")
        .join(ls.alias("ls"), F.col(f"u.{key}") == F.col(f"ls.{key}"), "left")
        .select(F.col(f"u.{key}").alias(key), *[F.col(f"u.{c}").alias(c) for c in ucols], *tsel, *lsel)
    )


# ------------------------------------------------------------------ D17 / D18


def build_terms(
    events: DataFrame, key: str = "user_id", date: str = "event_date", kind: str = "event_type", tiebreak: str | None = None
) -> DataFrame:
    """Subscription terms from lifecycle events.

    Each ``signup``/``downgrade``/``reactivate`` opens a term; the user's next
    event closes it: a ``cancel`` ends it that day (status canceled), any
    other event ends it the day before (status downgraded, a plan change);
    the last term stays open (active); a canceled winback has status
    churned_after_reactivation.  Same-day order: openings before a cancel, then
    ``tiebreak``; of several openings on one day the last one counts, so no
    term ends before it starts.  ``term_index`` is the 0-based order of the
    user's opening events.  Sequencing uses :func:`ordered_neighbors`, so a
    user with a huge event history is still split over many tasks.
    """
    from tidemark.operators.sequence import ordered_neighbors

    extra = [tiebreak] if tiebreak else []
    ev = events.select(F.col(key), F.col(date).alias("_d"), F.col(kind).alias("_k"), *extra)
    ev = ev.withColumn("_rank", F.when(F.col("_k") == "cancel", 1).otherwise(0))
    seq = ordered_neighbors(
        ev, key=key, order=["_d", "_rank", *extra], bucket=F.col("_d"), lead={"_next_d": "_d", "_next_k": "_k"}
    )
    canceled = F.col("_next_k") == "cancel"
    replaced = F.coalesce(~canceled & (F.col("_next_d") == F.col("_d")), F.lit(False))
    opening = seq.filter((F.col("_k") != "cancel") & ~replaced)
    end = F.when(canceled, F.col("_next_d")).when(F.col("_next_d").isNotNull(), F.date_sub(F.col("_next_d"), 1))
    status = F.when(canceled & (F.col("_k") == "reactivate"), "churned_after_reactivation").when(canceled, "canceled").when(F.col("_next_d").isNotNull(), "downgraded").otherwise("active")
    terms = opening.select(
        F.col(key),
        F.col("_d").alias("term_start_date"),
        end.alias("term_end_date"),
        status.alias("status"),
        (F.col("_k") == "downgrade").alias("is_downgrade"),
        (F.col("_k") == "reactivate").alias("is_reactivation"),
        F.when(canceled, F.col("_next_d")).alias("cancel_date"),
        *extra,
    )
    return ordered_neighbors(
        terms, key=key, order=["term_start_date", *extra], bucket=F.col("term_start_date"), index="term_index"
    )


def bill_terms(
    terms: DataFrame,
    window_start: _dt.date,
    window_end: _dt.date,
    mrr: str = "mrr_usd",
    period: str = "billing_period",
) -> DataFrame:
    """Billed days inside the window, renewals and revenue.

    billed_days = max(end_or_window_end - max(start, window_start) + 1, 0);
    renewals = floor(days / 365) for annual, floor(days / 30) otherwise;
    revenue = round(mrr x days / 30, 2).
    """
    end = F.coalesce(F.col("term_end_date"), F.lit(window_end))
    start = F.greatest(F.col("term_start_date"), F.lit(window_start))
    days = F.greatest(F.datediff(end, start) + 1, F.lit(0)).cast("bigint")
    return terms.withColumn("billed_days", days).withColumns(
        {
            "renewals_count": F.when(F.col(period) == "annual", F.floor(F.col("billed_days") / 365))
            .otherwise(F.floor(F.col("billed_days") / 30))
            .cast("bigint"),
            # round(mrr x days / 30, 2), half-up on exact cents (no binary tie flips)
            "revenue_usd": half_up_ratio(scaled_int(F.col(mrr), 2) * F.col("billed_days"), F.lit(30)) / F.lit(100.0),
        }
    )


# ------------------------------------------------------------------------ D19


def in_term(days: DataFrame, terms: DataFrame, date: str, key: str = "user_id", out: str = "in_term") -> DataFrame:
    """Subscribed-day test (see :func:`tidemark.operators.quality.in_term`:
    a sweep over starts/points/ends, no range join)."""
    from tidemark.operators.quality import in_term as _in_term

    return _in_term(days, terms, date, key, out)


# ------------------------------------------------------------------------ D20


def decline_features(
    df: DataFrame, value: str, key: str = "user_id", month: str = "month_start", prefix: str = "", value_digits: int | None = None
) -> DataFrame:
    """Log declines and the month-over-month ratio of an index.

    prev_n = value n months back, the first month's value standing in for
    missing history; decline_n = clip(-ln(v / max(prev_n, 1e-6))) to [-1, 2]
    (1 month) and [-1, 2.5] (3 months), a zero index counting as the upper
    clip; ratio = v / max(prev_1, 1e-6).  Rows must be a dense month spine;
    the window is bounded by the user's months."""
    w = Window.partitionBy(key).orderBy(month)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    v = F.col(value).cast("double")
    prev1 = F.coalesce(F.lag(value, 1).over(w), first).cast("double")
    prev3 = F.coalesce(F.lag(value, 3).over(w), first).cast("double")
    eps = F.lit(1e-6)

    def decline(prev, lo, hi):
        raw = -F.ln(v / F.greatest(prev, eps))
        return F.when(v <= 0, F.lit(hi)).otherwise(F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)))

    ratio = F.round(v / F.greatest(prev1, eps), 4)
    if value_digits is not None:
        # fixed-decimal index: exact half-up when the previous value is positive
        exact = half_up_ratio(scaled_int(v, value_digits) * F.lit(10_000), scaled_int(prev1, value_digits)) / F.lit(10_000.0)
        ratio = F.when(prev1 > 0, exact).otherwise(ratio)
    return df.withColumns(
        {
            # "+ 0.0" turns -0.0 (from -ln(1)) into 0.0
            f"{prefix}decline_1m": F.round(decline(prev1, *DECLINE_CLIP_1M), 4) + F.lit(0.0),
            f"{prefix}decline_3m": F.round(decline(prev3, *DECLINE_CLIP_3M), 4) + F.lit(0.0),
            f"{prefix}decline_ratio": ratio,
        }
    )


# ------------------------------------------------------------------------ D21


def zscore(df: DataFrame, cols: Sequence[str], floor: float = 0.1, eps: float = 1e-9, suffix: str = "_z") -> DataFrame:
    """Population z-scores (``stddev_pop``, as numpy) of ``ln(max(x, floor))``.

    The global mean/std are scalar subqueries over one aggregate (Spark
    merges them into a single pass), not a join."""
    src = {c: F.ln(F.greatest(F.col(c).cast("double"), F.lit(floor))) for c in cols}
    stats = df.agg(*[F.avg(e).alias(f"_m_{c}") for c, e in src.items()], *[F.stddev_pop(e).alias(f"_s_{c}") for c, e in src.items()])
    out = {
        f"{c}{suffix}": F.round((e - stats.select(f"_m_{c}").scalar()) / (stats.select(f"_s_{c}").scalar() + F.lit(eps)), 4)
        for c, e in src.items()
    }
    return df.withColumns(out)


def fixed_z(col, centre: float, scale: float) -> Column:
    """Fixed-centre z, e.g. acceptance (x - 0.35) / 0.10."""
    return (_c(col) - F.lit(centre)) / F.lit(scale)


def tenure_term(col) -> Column:
    """``log1p(tenure_months) / ln 13``."""
    return F.log1p(_c(col)) / F.lit(math.log(13.0))


# ------------------------------------------------------------------ D22-D25


def user_state(df: DataFrame, ratio: str, subscribed: str, lapsed: str, threshold: float = AT_RISK_RATIO, out: str = "user_state") -> DataFrame:
    """at_risk (subscribed and ratio < threshold) / active / lapsed / not_subscribed."""
    st = (
        F.when(F.col(subscribed) & (F.col(ratio) < F.lit(threshold)), "at_risk")
        .when(F.col(subscribed), "active")
        .when(F.col(lapsed), "lapsed")
        .otherwise("not_subscribed")
    )
    return df.withColumn(out, st)


def lapse_state(
    df: DataFrame,
    subscribed: str = "at_risk",
    churned: str = "churned",
    reactivation_starts: str = "reactivation_starts",
    key: str = "user_id",
    month: str = "month_start",
) -> DataFrame:
    """Per spine month: last churn month before it, reactivations so far and
    the lapsed flag (not subscribed, churned earlier).  Running aggregates
    over the user's month spine (bounded by the calendar span)."""
    before = Window.partitionBy(key).orderBy(month).rowsBetween(Window.unboundedPreceding, -1)
    last_churn = F.max(F.when(F.col(churned), F.col(month))).over(before)
    reacts = F.coalesce(F.sum(F.coalesce(F.col(reactivation_starts), F.lit(0))).over(before), F.lit(0)).cast("bigint")
    df = df.withColumns({"last_churn_month": last_churn, "reactivations": reacts})
    return df.withColumn("lapsed", ~F.col(subscribed) & F.col("last_churn_month").isNotNull())


def winback_eligible(
    df: DataFrame,
    month: str = "month_start",
    months: int = WINBACK_MONTHS,
    cap: int = WINBACK_MAX_REACTIVATIONS,
    out: str = "winback_eligible",
) -> DataFrame:
    """Lapsed, churned at most ``months`` months ago, fewer than ``cap``
    reactivations so far (columns from :func:`lapse_state`)."""
    since = F.months_between(F.col(month), F.col("last_churn_month")).cast("bigint")
    ok = F.col("lapsed") & (since <= months) & (F.col("reactivations") < cap)
    return df.withColumn("months_since_churn", since).withColumn(out, F.coalesce(ok, F.lit(False)))


#: channels that an opt-out closes
OPTOUT_CHANNELS = ("email", "push")


def segment_eligibility(
    features: DataFrame,
    rules: Sequence[tuple[str, str, str, str]],
    unsubscribes: DataFrame | None = None,
    key: str = "user_id",
    month: str = "month_start",
) -> DataFrame:
    """User-months eligible per campaign segment.

    ``rules`` are (campaign_id, target_segment, channel, condition), the
    condition a SQL predicate over ``features``; a row gives a campaign row for
    each rule that it meets, in one pass.  ``unsubscribes`` (key, channel,
    unsub_date): a user who opted out of a channel by mail or push on or before
    the month's first day gets nothing more on it.  That is decided by the first
    opt-out per user and channel: an aggregate and an equi join, whatever the
    number of opt-outs.
    """
    met = [F.when(F.expr(condition), F.struct(*[F.lit(x).alias(n) for x, n in zip(rule, ("campaign_id", "target_segment", "channel"))])) for *rule, condition in rules]
    out = features.withColumn("_rule", F.explode(F.filter(F.array(*met), lambda r: r.isNotNull()))).select("*", "_rule.*").drop("_rule")
    if unsubscribes is None:
        return out
    first = unsubscribes.where(F.col("channel").isin(*OPTOUT_CHANNELS)).groupBy(key, "channel").agg(F.min("unsub_date").alias("_closed"))
    return out.join(first, [key, "channel"], "left").where(F.col("_closed").isNull() | (F.col("_closed") > F.col(month))).drop("_closed")


def touch_outcome(df: DataFrame, out: str = "outcome") -> DataFrame:
    """Reactivated / unsubscribed / engaged_no_conversion / no_response,
    with the invariants converted => opened & clicked, undelivered => no_response."""
    d, o, c, r = (F.col(x) for x in ("delivered", "opened", "clicked", "reactivated"))
    unsub = F.col("unsubscribed") if "unsubscribed" in df.columns else F.lit(False)
    res = (
        F.when(~d, "no_response")
        .when(r & o & c, "reactivated")
        .when(unsub, "unsubscribed")
        .when(o | c, "engaged_no_conversion")
        .otherwise("no_response")
    )
    return df.withColumn(out, res)


# ------------------------------------------------------------------------ D26


def rolling_touches(log: DataFrame, as_of, days: int = 30, key: str = "user_id", ts: str = "logged_at", out: str = "touches_30d") -> DataFrame:
    """Events per user in the ``days`` days before ``as_of`` (a filter then
    an aggregate: pushes into the scan, one partial aggregate per user)."""
    as_of_c = F.lit(as_of) if not isinstance(as_of, Column) else as_of
    lo = as_of_c - F.expr(f"INTERVAL {int(days)} DAYS")
    return (
        log.filter((F.col(ts) >= lo) & (F.col(ts) <= as_of_c))
        .groupBy(key)
        .agg(F.count(F.lit(1)).cast("bigint").alias(out), F.max(ts).alias("last_touch"))
    )


# ------------------------------------------------------------------------ D27


def dense_index(df: DataFrame, order: Sequence[str], out: str = "row_no", start: int = 1) -> DataFrame:
    """Dense 0..n-1 (+start) position in a global order without a single-task window.

    Range-partition and sort by ``order``, number rows inside each partition,
    and add the number of rows in all earlier partitions (a table with one row
    per partition, so bounded by the partition count).  The partitioned rows
    are checkpointed first: numbers and partition sizes must come from one and
    the same partitioning, and Spark samples each range exchange anew.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n_parts, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    # monotonically_increasing_id = (partition << 33) + position in partition
    placed = ordered.withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    tagged = placed.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_pid", "_off")
    # offsets has one row per partition, so the broadcast is bounded by the partition count
    res = tagged.join(F.broadcast(offsets), "_pid").withColumn(out, (F.col("_off") + F.col("_pos") + F.lit(start)).cast("bigint"))
    return res.drop("_pid", "_mid", "_pos", "_off")


def surrogate_keys(df: DataFrame, order: Sequence[str], fmt: str = "TCK-%09d", out: str = "surrogate_id") -> DataFrame:
    """Ordered surrogate keys like ``TCK-000000001`` after a sort."""
    return dense_index(df, order, out="_k", start=1).withColumn(out, F.format_string(fmt, F.col("_k"))).drop("_k")


# ------------------------------------------------------------------------ D28


def sample_users(
    df: DataFrame, key: str = "user_id", num: int = 1, den: int = 10, seed: int = 1729, hash: str = "xxhash64"
) -> DataFrame:
    """Deterministic user-level sample: all rows of a sampled user are kept
    (``pmod(h(key, seed), den) < num``); children follow by semi join.

    ``hash="xxhash64"`` is Spark's fast built-in; ``hash="md5"`` takes the
    first 32 bits of ``md5('<key>:<seed>')``, which any SQL engine can
    reproduce (the same users are sampled everywhere).  Hash the key table
    (one row per user), not the children."""
    if hash == "xxhash64":
        h = F.xxhash64(F.col(key), F.lit(seed))
    elif hash == "md5":
        text = F.concat(F.col(key).cast("string"), F.lit(f":{int(seed)}"))
        h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    else:
        raise ValueError(f"unknown hash: {hash}")
    return df.filter(F.pmod(h, F.lit(den)) < F.lit(num))


# ------------------------------------------------------------------------ D29


def campaign_dates(defs: DataFrame, window_start: _dt.date, window_end: _dt.date) -> DataFrame:
    """start = window start + offset months; end = min(last day of the last
    month, window end), never before start; active on the window's last day."""
    start = F.add_months(F.lit(window_start), F.col("month_offset").cast("int"))
    last_month = F.add_months(start, F.col("duration_months").cast("int") - 1)
    end = F.greatest(F.least(F.last_day(last_month), F.lit(window_end)), start)
    return defs.withColumn("start_date", start).withColumn("end_date", end).withColumn(
        "is_active_at_window_end", (F.col("start_date") <= F.lit(window_end)) & (F.lit(window_end) <= F.col("end_date"))
    )
