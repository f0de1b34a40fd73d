"""Skew-safe ordered neighbours: position, previous and next row within a key.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to
one task.  If one user holds a third of the rows, that task holds a third of
the data.  Here the key is split into ordered *buckets* (for dated rows: the
day), so the heavy work is a window over ``(key, bucket)``; only one summary
row per ``(key, bucket)`` is then windowed per key, which is bounded by the
number of buckets (days in the data span), not by the key's row count.

The bucket expression must be monotone in the order columns (rows of an
earlier bucket sort before rows of a later one) and the order columns must be
a total order within the key.

A bucket that alone holds very many rows (one user with all rows on one day)
is cut again, by ranges of the last order column: see :func:`split_buckets`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir, task_count


#: a bucket with more rows is cut, and with more than one in MOST of all rows at any size
SPLIT_ROWS = 2_000_000
MOST = 4096
#: rows per task where the rows are counted
TASK_ROWS = 400_000


def split_buckets(df: DataFrame, key: str, bucket: Column, tie: str, out: str, rows: int = SPLIT_ROWS) -> DataFrame:
    """Add ``out``: the bucket, and the piece of it that a row is in.

    Buckets of more than ``rows`` rows (but never more than ``MOST`` of them:
    the bound grows with the table) are cut at quantiles of ``tie``, which must
    order the rows of a bucket.  The cuts are written to the checkpoint folder,
    so that every evaluation and every retried task sees the same ones; where
    there are none nothing is written.
    """
    day = "_sb_bucket"
    df = df.withColumn(day, bucket)
    limit = max(rows, df.count() // MOST)
    sizes = df.groupBy(key, day).agg(F.count(F.lit(1)).alias("_sb_n")).where(F.col("_sb_n") > limit)
    largest = sizes.agg(F.max("_sb_n")).first()[0]
    if largest is None:
        return df.withColumn(out, F.struct(F.col(day).alias("bucket"), F.lit(0).alias("piece"))).drop(day)
    checkpoint_dir(df.sparkSession)
    pieces = -(-largest // limit)
    marked = df.join(F.broadcast(sizes), [key, day], "left_semi")
    at = F.percentile_approx(tie, [k / pieces for k in range(1, pieces)], 50 * pieces)
    # at most MOST rows
    cuts = marked.groupBy(key, day).agg(at.alias("_sb_cuts")).checkpoint()
    cut = df.join(F.broadcast(cuts), [key, day], "left")
    piece = F.coalesce(F.size(F.filter("_sb_cuts", lambda c: c < F.col(tie))), F.lit(0))
    piece = F.when(F.col("_sb_cuts").isNull(), F.lit(0)).otherwise(piece)
    return cut.withColumn(out, F.struct(F.col(day).alias("bucket"), piece.alias("piece"))).drop(day, "_sb_cuts")


def ordered_neighbors(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    bucket: Column,
    *,
    index: str | None = None,
    lead: Mapping[str, str] | None = None,
    lag: Mapping[str, str] | None = None,
    count: str | None = None,
    split: int | None = None,
) -> DataFrame:
    """Add ``index`` (0-based position in key order), ``lead``/``lag`` values
    (``{out_col: src_col}``) and optionally the key's row ``count``.

    split: cut buckets of more than so many rows by the last order column,
    which must then order the rows of a bucket by itself.  The rows are counted
    for that, and both windows and their join run in tasks of ``TASK_ROWS``.
    """
    lead = dict(lead or {})
    lag = dict(lag or {})
    b = "_nb_bucket"
    df = split_buckets(df, key, bucket, order[-1], b, split) if split else df.withColumn(b, bucket)
    parts = task_count(df.sparkSession, df.count(), TASK_ROWS) if split else None

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(parts, *by) if parts else rows

    df = dealt(df, key, b)
    w_in = Window.partitionBy(key, b).orderBy(*order)
    cols = {"_nb_rn": F.row_number().over(w_in)}
    for out, src in lead.items():
        cols[f"_nb_ld_{out}"] = F.lead(src).over(w_in)
    for out, src in lag.items():
        cols[f"_nb_lg_{out}"] = F.lag(src).over(w_in)
    local = df.withColumns(cols)

    # One summary row per (key, bucket): size, first-row and last-row values.
    # Aggregated straight from the source (partial aggregation, no second
    # sort/window pass over the rows).
    ordering = F.struct(*[F.col(c) for c in order])
    aggs = [F.count(F.lit(1)).alias("_nb_n")]
    for out, src in lead.items():
        aggs.append(F.min_by(F.col(src), ordering).alias(f"_nb_first_{out}"))
    for out, src in lag.items():
        aggs.append(F.max_by(F.col(src), ordering).alias(f"_nb_last_{out}"))
    summary = df.groupBy(key, b).agg(*aggs)
    w_key = Window.partitionBy(key).orderBy(b)
    scols = {
        "_nb_before": F.coalesce(
            F.sum("_nb_n").over(w_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
    }
    for out in lead:
        scols[f"_nb_next_{out}"] = F.lead(f"_nb_first_{out}").over(w_key)
    for out in lag:
        scols[f"_nb_prev_{out}"] = F.lag(f"_nb_last_{out}").over(w_key)
    if count:
        scols["_nb_total"] = F.sum("_nb_n").over(Window.partitionBy(key))
    summary = dealt(dealt(summary, key).withColumns(scols), key, b)

    out = local.join(summary, [key, b], "inner")
    result = {}
    if index:
        result[index] = (F.col("_nb_before") + F.col("_nb_rn") - 1).cast("bigint")
    for o in lead:
        result[o] = F.when(F.col("_nb_rn") == F.col("_nb_n"), F.col(f"_nb_next_{o}")).otherwise(
            F.col(f"_nb_ld_{o}")
        )
    for o in lag:
        result[o] = F.when(F.col("_nb_rn") == 1, F.col(f"_nb_prev_{o}")).otherwise(F.col(f"_nb_lg_{o}"))
    if count:
        result[count] = F.col("_nb_total").cast("bigint")
    out = out.withColumns(result)
    return out.drop(*[c for c in out.columns if c.startswith("_nb_")])


def ordered_prefix_sum(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    bucket: Column,
    value: str,
    out: str,
) -> DataFrame:
    """Running sum of ``value`` in key order (inclusive of the current row).

    Same two-level split as :func:`ordered_neighbors`: a window over
    ``(key, bucket)`` for the in-bucket running sum, plus the exclusive prefix
    of earlier buckets from one summary row per ``(key, bucket)``.  Rows that
    tie on ``order`` get an arbitrary relative order, so give tied rows a
    zero ``value`` (or make ``order`` total) when the sum at a row matters.
    """
    b = "_ps_bucket"
    df = df.withColumn(b, bucket)
    w_in = Window.partitionBy(key, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn("_ps_run", F.sum(value).over(w_in))
    totals = df.groupBy(key, b).agg(F.sum(value).alias("_ps_tot"))
    w_key = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ps_before", F.coalesce(F.sum("_ps_tot").over(w_key), F.lit(0)))
    res = local.join(totals.select(key, b, "_ps_before"), [key, b], "inner")
    return res.withColumn(out, F.col("_ps_before") + F.col("_ps_run")).drop(b, "_ps_run", "_ps_before")
