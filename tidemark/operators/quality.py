"""Data-quality and governance operators.

Each check is a Spark aggregate that returns a small DataFrame (one row per
check/edge/rule), so nothing but the report itself reaches the driver.
Checks that compare rows of two tables use anti/semi joins or aggregates, never
a join that emits all pairs inside a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidemark.operators.sequence import ordered_neighbors


# ------------------------------------------------------------------------ Q4


class ConformError(ValueError):
    pass


def conform(df: DataFrame, spec) -> DataFrame:
    """Q4: exact columns of ``spec`` (missing/extra -> error), spec order, cast,
    NULL booleans -> FALSE (before the NOT NULL check, T22), NOT NULL assert.

    The NOT NULL check is one aggregate over all required columns; it runs
    eagerly so a bad table fails here, as in the reference."""
    names = spec.schema.names
    missing = [n for n in names if n not in df.columns]
    extra = [n for n in df.columns if n not in names]
    if missing or extra:
        raise ConformError(f"{spec.name}: missing {missing}, extra {extra}")
    cols = []
    for c in spec.schema:
        e = F.col(c.name).cast(c.dataType)
        if isinstance(c.dataType, BooleanType):
            e = F.coalesce(e, F.lit(False))
        cols.append(e.alias(c.name))
    out = df.select(*cols)
    required = [c.name for c in spec.schema if not c.nullable]
    if required:
        nulls = out.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in required]).first().asDict()
        bad = {k: v for k, v in nulls.items() if v}
        if bad:
            raise ConformError(f"{spec.name}: NULLs in NOT NULL columns {bad}")
    return out


# ------------------------------------------------------------------ Q5 / J4


def pk_duplicates(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """Q5: rows beyond the first per key = count(*) - count(distinct keys)."""
    k = F.struct(*[F.col(c) for c in keys])
    return df.agg(
        F.lit(name).alias("table_name"),
        F.lit(",".join(keys)).alias("key_cols"),
        F.count(F.lit(1)).cast("bigint").alias("total_rows"),
        (F.count(F.lit(1)) - F.count_distinct(k)).cast("bigint").alias("duplicate_rows"),
    )


def fk_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None, edge: str | None = None) -> DataFrame:
    """Distinct child keys with no parent row.

    Both sides are reduced to distinct keys first (partial aggregates), then a
    left-anti join; one output row per edge: orphan and distinct child keys."""
    pk = parent_key or key
    ck = child.select(F.col(key).alias("_k")).distinct()
    pp = parent.select(F.col(pk).alias("_k")).distinct()
    orphans = ck.join(pp, "_k", "left_anti")
    o = orphans.agg(F.count(F.lit(1)).cast("bigint").alias("orphan_keys"))
    c = ck.agg(F.count(F.lit(1)).cast("bigint")).scalar()
    return o.select(F.lit(edge or f"{key}->{pk}").alias("edge"), "orphan_keys", c.alias("child_keys"))


def fk_report(edges: Sequence[tuple[str, DataFrame, DataFrame, str, str]]) -> DataFrame:
    """Q6: ``[(edge, child, parent, key, parent_key), ...]`` -> one row per edge."""
    out = None
    for edge, child, parent, key, pkey in edges:
        r = fk_orphans(child, parent, key, pkey, edge)
        out = r if out is None else out.unionByName(r)
    return out.withColumn("ok", F.col("orphan_keys") == 0)


# ----------------------------------------------------------------- Q7 / Q10


def range_checks(df: DataFrame, rules: Mapping[str, Column | str], name: str = "table") -> DataFrame:
    """Q7/Q10: one pass, ``count_if(NOT coalesce(rule, false))`` per rule, as
    long-form rows (check, bad, total, ok).  A NULL predicate is a violation (T4)."""
    exprs = {k: (F.expr(v) if isinstance(v, str) else v) for k, v in rules.items()}
    agg = df.agg(
        F.count(F.lit(1)).cast("bigint").alias("_total"),
        *[F.count_if(~F.coalesce(e, F.lit(False))).cast("bigint").alias(f"_bad{i}") for i, e in enumerate(exprs.values())],
    )
    rows = F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(f"_bad{i}").alias("bad")) for i, k in enumerate(exprs)])
    out = agg.select(F.col("_total").alias("total"), F.explode(rows).alias("_r"))
    return out.select(
        F.lit(name).alias("table_name"), F.col("_r.check_name").alias("check_name"), F.col("_r.bad").alias("bad"), "total",
        (F.col("_r.bad") == 0).alias("ok"),
    )


def rate_check(df: DataFrame, flag: str, target: float, tol: float = 0.005, name: str = "rate") -> DataFrame:
    """Q8: ``avg(flag)`` within ``tol`` of ``target``."""
    return df.agg(F.avg(F.col(flag).cast("double")).alias("rate")).select(
        F.lit(name).alias("check_name"), F.round("rate", 4).alias("rate"), F.lit(target).alias("target"),
        (F.abs(F.col("rate") - F.lit(target)) <= F.lit(tol)).alias("ok"),
    )


# ------------------------------------------------------------------------ J5


def coverage_sweep(
    points: DataFrame,
    intervals: DataFrame,
    on: str = "user_id",
    at: str = "touch_date",
    start: str = "term_start_date",
    end: str = "term_end_date",
    out: str = "open_intervals",
) -> DataFrame:
    """Number of the key's intervals ``[start, end]`` (``end`` NULL = open)
    that contain each point's date, without a range join.

    Point days, interval starts and interval ends are reduced to one row per
    ``(key, day)`` (starts that day, ends that day, any point that day) by a
    map-side combined aggregate, so a key with millions of rows on one day
    adds one row.  The open count on a point day is the starts that day plus
    the running ``starts - ends`` of the key's earlier days (ends are
    inclusive): one running window per key, bounded by its distinct days.
    The count goes back to the points by an equi join on ``(key, day)`` (one
    row per day on that side, so a hot day is a plain skewed join that AQE
    can split)."""
    day = F.col(at).cast("date")
    zero = F.lit(0).cast("bigint")
    p = points.select(F.col(on).alias("_k"), day.alias("_d"), zero.alias("_s"), zero.alias("_e"), F.lit(True).alias("_p"))
    s = intervals.select(F.col(on).alias("_k"), F.col(start).cast("date").alias("_d"), F.lit(1).cast("bigint").alias("_s"), zero.alias("_e"), F.lit(False).alias("_p"))
    e = intervals.filter(F.col(end).isNotNull()).select(
        F.col(on).alias("_k"), F.col(end).cast("date").alias("_d"), zero.alias("_s"), F.lit(1).cast("bigint").alias("_e"), F.lit(False).alias("_p")
    )
    days = p.unionByName(s).unionByName(e).groupBy("_k", "_d").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"), F.max("_p").alias("_p"))
    before = Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    open_now = F.coalesce(F.sum(F.col("_s") - F.col("_e")).over(before), zero) + F.col("_s")
    per_day = days.withColumn(out, F.greatest(open_now, zero)).filter(F.col("_p")).select("_k", "_d", out)
    j = points.withColumn("_pd", day).join(per_day, (F.col(on) == F.col("_k")) & (F.col("_pd") == F.col("_d")), "left")
    return j.withColumn(out, F.coalesce(F.col(out), zero)).drop("_k", "_d", "_pd")


def uncovered(
    points: DataFrame,
    intervals: DataFrame,
    on: str = "user_id",
    at: str = "touch_date",
    start: str = "term_start_date",
    end: str = "term_end_date",
) -> DataFrame:
    """Rows of ``points`` whose date lies in none of the key's intervals."""
    swept = coverage_sweep(points, intervals, on, at, start, end, out="_open")
    return swept.filter(F.col("_open") <= 0).drop("_open")


def in_term(points: DataFrame, terms: DataFrame, date: str, key: str = "user_id", out: str = "in_term") -> DataFrame:
    """Flag each row whose date falls inside any of the user's terms."""
    swept = coverage_sweep(points, terms, key, date, out="_open")
    return swept.withColumn(out, F.col("_open") > 0).drop("_open")


# ------------------------------------------------------------------------ J6


def events_after_cancel(
    events: DataFrame, terms: DataFrame, key: str = "user_id", date: str = "event_date"
) -> DataFrame:
    """Events dated after the user's last cancel, for users with no
    reactivation term.  Last cancel is a ``max`` aggregate; reactivated users
    are removed by ``left_anti``; one equi join on the user."""
    last_cancel = terms.filter(F.col("cancel_date").isNotNull()).groupBy(key).agg(F.max("cancel_date").alias("_last_cancel"))
    react = terms.filter(F.col("is_reactivation")).select(key).distinct()
    j = events.join(last_cancel, key).join(react, key, "left_anti")
    return j.filter(F.col(date) > F.col("_last_cancel")).drop("_last_cancel")


# ------------------------------------------------------------------------ W6


def term_overlaps(terms: DataFrame, key: str = "user_id") -> DataFrame:
    """Terms that end after the next term starts, or are open but not last.

    The next start comes from :func:`ordered_neighbors` (skew-safe lead)."""
    seq = ordered_neighbors(
        terms, key=key, order=["term_start_date", "term_index"], bucket=F.col("term_start_date"),
        lead={"next_start": "term_start_date"},
    )
    bad_overlap = F.col("next_start").isNotNull() & F.col("term_end_date").isNotNull() & (F.col("term_end_date") > F.col("next_start"))
    open_not_last = F.col("next_start").isNotNull() & F.col("term_end_date").isNull()
    return seq.filter(bad_overlap | open_not_last).withColumn(
        "violation", F.when(open_not_last, "open_not_last").otherwise("overlap")
    )


# ------------------------------------------------------------------------ E2


def count_mismatch(a: DataFrame, b: DataFrame, key: str, a_name: str = "a_count", b_name: str = "b_count") -> DataFrame:
    """Per-key count equality between two tables (full outer join of two
    partial-aggregated counts; rows where the counts differ)."""
    ca = a.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias(a_name))
    cb = b.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias(b_name))
    j = ca.join(cb, key, "full").fillna(0, [a_name, b_name])
    return j.filter(F.col(a_name) != F.col(b_name))


# ----------------------------------------------------------------- J7 / J10


def outside_parent_dates(
    child: DataFrame, parent: DataFrame, key: str, date: str, start: str, end: str | None = None
) -> DataFrame:
    """Child rows dated before the parent's start (or after its end).

    The parent is one row per key, so the equi join does not fan out."""
    pcols = [F.col(key), F.col(start).alias("_ps")] + ([F.col(end).alias("_pe")] if end else [])
    j = child.join(parent.select(*pcols), key)
    bad = F.col(date) < F.col("_ps")
    if end:
        bad = bad | (F.col(date) > F.col("_pe"))
    return j.filter(bad).drop("_ps", *(["_pe"] if end else []))


def column_mismatch(a: DataFrame, b: DataFrame, on: Sequence[str], col: str, b_col: str | None = None, op: str = "!=") -> DataFrame:
    """Rows of ``a`` whose ``col`` disagrees with ``b`` on the same key
    (``op`` '!=' for equality rules, '>' for 'a <= b' rules).

    For '>' only rows above the least value of ``b`` meet the join; no others can disagree."""
    bc = b_col or col
    if op == ">":
        a = a.where(F.col(col) > b.agg(F.min(bc)).scalar())
    j = a.join(b.select(*on, F.col(bc).alias("_b")), list(on))
    cond = {"!=": ~F.col(col).eqNullSafe(F.col("_b")), ">": F.col(col) > F.col("_b")}[op]
    return j.filter(cond).drop("_b")


# ------------------------------------------------------------------------ Q12


def comment_coverage(df: DataFrame) -> DataFrame:
    """Q12: columns with a non-empty ``comment`` in their metadata, n/n."""
    fields = df.schema.fields
    n = len(fields)
    k = sum(1 for f in fields if (f.metadata or {}).get("comment"))
    return df.sparkSession.createDataFrame([(k, n)], "commented int, columns int")
