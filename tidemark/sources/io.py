"""Readers, writers and sync operators.

Nothing here moves table data through the driver: counts, maxima and digests
are Spark aggregates; snapshot publish writes a new version folder from the
executors and then flips a one-line pointer file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------- helpers


def _jvm_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(hconf), p, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _jvm_fs(spark, path)
    return bool(fs.exists(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small text file through Hadoop's file systems (works on shared storage).

    The text goes to a file of its own that is then renamed over the old one,
    so a reader sees the old text or the new one, never a part."""
    fs, p, jvm = _jvm_fs(spark, path)
    own = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(own, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    p = fs.makeQualified(p)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), fs.getConf()).rename(fs.makeQualified(own), p, over)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p, jvm = _jvm_fs(spark, path)
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


# ------------------------------------------------------------------ S5 / S6


def read_table(spark: SparkSession, path: str, spec=None, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan with an explicit schema (from a declared table) and column pruning."""
    reader = spark.read
    if spec is not None:
        reader = reader.schema(spec.schema)
    df = reader.parquet(path)
    if columns:
        df = df.select(*columns)
    return df


def write_partitioned(
    df: DataFrame,
    path: str,
    by: Sequence[str] = (),
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Hive ``col=value`` layout in parquet (snappy), csv, or ``both``.

    Rows are rebalanced by the partition columns (``REBALANCE`` hint) so each
    task writes few files; AQE splits the partition of a hot value into
    several tasks and merges small ones from runtime sizes, so one value never
    lands whole in one task and no sampling pass is needed.
    """
    if by:
        df = df.hint("rebalance", *by)
    formats = ["parquet", "csv"] if fmt == "both" else [fmt]
    for f in formats:
        target = path if len(formats) == 1 else f"{path.rstrip('/')}/{f}"
        w = df.write.mode(mode)
        if by:
            w = w.partitionBy(*by)
        if f == "parquet":
            w.option("compression", "snappy").parquet(target)
        elif f == "csv":
            w.option("header", "true").csv(target)
        else:
            raise ValueError(f"unknown format {f!r}")


def overwrite(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Replace a table, schema included (parquet overwrite rewrites the schema)."""
    write_partitioned(df, path, by=by, fmt="parquet", mode="overwrite")


# ------------------------------------------------------------------------ S7


def manifest(spark: SparkSession, tables: Mapping[str, str], partition_by: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per-table rows, columns, files and bytes, computed by Spark.

    ``_metadata.file_path/file_size`` come from the scan; distinct files are
    aggregated per table, so nothing but the final summary reaches the driver.
    """
    partition_by = partition_by or {}
    parts = []
    for name, path in tables.items():
        df = spark.read.parquet(path)
        cols = ",".join(df.columns)
        per_file = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
            F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("bytes")
        )
        parts.append(
            per_file.agg(
                F.sum("rows").cast("bigint").alias("rows"),
                F.count(F.lit(1)).cast("bigint").alias("files"),
                F.sum("bytes").cast("bigint").alias("bytes"),
            ).select(
                F.lit(name).alias("table_name"),
                "rows",
                F.lit(cols).alias("columns"),
                F.lit(",".join(partition_by.get(name, ()))).alias("partition_by"),
                "files",
                "bytes",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def manifest_json(summary: DataFrame) -> str:
    """Render a (small, one row per table) manifest DataFrame as JSON."""
    rows = [r.asDict() for r in summary.collect()]
    return json.dumps({"tables": rows, "total_rows": sum(r["rows"] or 0 for r in rows)}, indent=2, default=str)


# ------------------------------------------------------------------------ S9


def publish_snapshot(df: DataFrame, target: str, pk: str | Sequence[str]) -> dict:
    """Full-snapshot publish, readers see the old or the new version.

    The executors write ``target/_v=<id>``, counting the source's rows as they
    pass; the written rows must be as many, with unique keys, before the small
    pointer file ``target/_CURRENT`` is replaced.  ``read_snapshot`` follows the pointer.
    """
    spark = df.sparkSession
    keys = [pk] if isinstance(pk, str) else list(pk)
    version = uuid.uuid4().hex
    vpath = f"{target.rstrip('/')}/_v={version}"
    sent = Observation()
    df.observe(sent, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(vpath)
    written = spark.read.parquet(vpath)
    stats = written.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.struct(*[F.col(k) for k in keys])).alias("k"),
        F.count_if(F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()).alias(
            "null_keys"
        ),
    ).first()
    if stats["n"] != sent.get["rows"]:
        raise ValueError(f"snapshot rejected: {sent.get['rows']} rows sent, {stats['n']} written")
    if stats["n"] != stats["k"] or stats["null_keys"]:
        raise ValueError(f"snapshot rejected: {stats['n']} rows, {stats['k']} distinct keys, {stats['null_keys']} null keys")
    write_text(spark, f"{target.rstrip('/')}/_CURRENT", version)
    return {"version": version, "rows": int(stats["n"]), "path": vpath}


def read_snapshot(spark: SparkSession, target: str) -> DataFrame:
    version = read_text(spark, f"{target.rstrip('/')}/_CURRENT").strip()
    return spark.read.parquet(f"{target.rstrip('/')}/_v={version}")


# ----------------------------------------------------------------- S10 / S11


def high_watermark(spark: SparkSession, target: str, id_col: str = "id") -> int | None:
    """``MAX(id)`` of the target (one aggregate over its id column); None when the
    target does not exist yet or is empty (then everything is new)."""
    if not path_exists(spark, target):
        return None
    hi = spark.read.parquet(target).agg(F.max(id_col).alias("hi")).first()["hi"]
    return int(hi) if hi is not None else None


def append_above_watermark(source: DataFrame, target: str, id_col: str = "id") -> int:
    """S10/ST5: append rows of ``source`` with ``id > max(target.id)``.

    The ``id > hi`` filter is pushed into the source scan (parquet row-group
    skipping, or a JDBC ``WHERE``).  Returns the number of appended rows, counted
    as they are written, so the source runs once.
    """
    spark = source.sparkSession
    hi = high_watermark(spark, target, id_col)
    new = source if hi is None else source.filter(F.col(id_col) > F.lit(hi))
    sent = Observation()
    new.observe(sent, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(target)
    return int(sent.get["rows"])


def append_log(events: DataFrame, target: str, id_col: str = "id", order: Sequence[str] = ()) -> int:
    """Append events to a log, assigning ids ``max(id) + 1, +2, ...``.

    Ids are dense and follow ``order``; they are assigned with
    :func:`tidemark.operators.derive.dense_index` (range-partitioned, no
    single-task window).
    """
    from tidemark.operators.derive import dense_index

    spark = events.sparkSession
    hi = high_watermark(spark, target, id_col) or 0
    order = list(order) or list(events.columns)
    with_ids = dense_index(events, order, out=id_col, start=hi + 1)
    with_ids = with_ids.select(id_col, *[c for c in events.columns if c != id_col])
    with_ids.write.mode("append").parquet(target)
    return hi


# ------------------------------------------------------------------------ S12


def upsert_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], order_col: str | None = None) -> DataFrame:
    """Insert, and on key conflict replace all columns with the newest row.

    Newest = highest ``order_col``; rows from ``updates`` win ties (and win
    outright when ``order_col`` is None).  One aggregate per key with map-side
    combine (``max_by``), so a hot key never gathers in one task.
    """
    cols = [c for c in base.columns]
    tagged = base.select(*cols, F.lit(0).alias("_src")).unionByName(updates.select(*cols, F.lit(1).alias("_src")))
    rank = F.struct(F.col(order_col), F.col("_src")) if order_col else F.col("_src")
    payload = F.struct(*[F.col(c) for c in cols if c not in keys])
    agg = tagged.groupBy(*keys).agg(F.max_by(payload, rank).alias("_row"))
    return agg.select(*keys, "_row.*").select(*cols)


# ------------------------------------------------------------------------ S13


def content_digest(df: DataFrame, name: str = "table") -> DataFrame:
    """Order-insensitive digest of a table's logical content.

    Each row hashes to 64 bits (``xxhash64`` over all columns, NULL-aware);
    the table digest is the DECIMAL sum and the XOR of row hashes plus the row
    count, so it is independent of partitioning and row order.
    """
    h = F.xxhash64(*[F.col(c) for c in df.columns], F.lit(",".join(df.columns)))
    return df.select(h.alias("h")).agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("digest_sum"),
        F.bit_xor("h").alias("digest_xor"),
    )


def compare_digests(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two digests by table name; ``same`` is true when content matches."""
    x = a.alias("a")
    y = b.alias("b")
    return x.join(y, "table_name", "full").select(
        "table_name",
        F.coalesce(F.col("a.rows"), F.col("b.rows")).alias("rows"),
        (
            (F.col("a.rows") == F.col("b.rows"))
            & (F.col("a.digest_sum") == F.col("b.digest_sum"))
            & (F.col("a.digest_xor") == F.col("b.digest_xor"))
        ).alias("same"),
    )


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Concatenate frames by column name."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

