"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a record batch that a task holds as Python objects at a time
SLICE_ROWS = 256
#: rows of a record batch, where the session leaves Spark's default
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) that names none gets one of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the table read back.

    The table cuts the lineage: what follows reads files that any executor
    sees, so a lost executor never repeats the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batched(df: DataFrame) -> DataFrame:
    """``df``, its session sending Python workers ``BATCH_ROWS`` rows at a time unless it says otherwise.

    Spark's default of 10,000 rows is made for narrow rows; whole texts of
    that many rows fill an executor's memory outside the heap.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def lazy(spark: SparkSession, build: Callable, *args) -> Broadcast:
    """Broadcast how to build a value that each Python worker makes once: see ``made``.

    The builder travels by value, as bytes in a plain dict, so that a worker
    needs no copy of this package on its path.
    """
    return spark.sparkContext.broadcast({"how": cloudpickle.dumps((build, args))})


def made(how: Broadcast):
    """The value of ``lazy`` in this worker, kept with the broadcast from task to task."""
    kept = how.value
    if "made" not in kept:
        build, args = pickle.loads(kept["how"])
        kept["made"] = build(*args)
    return kept["made"]


#: parts that a join's rows are thought of in: a key with more rows than one is dealt out
PIECES = 2048


def dealt_join(rows: DataFrame, classes: DataFrame, keys: list[str], counted: str, place: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``classes``, which has one row per key and in ``counted`` how many rows have it.

    A key that holds more than one in ``PIECES`` of the ``total`` rows would
    meet in one task.  There are at most ``PIECES`` such keys, so their list is
    broadcast; their rows are dealt by a hash of ``place`` over as many pieces
    as they are too many, and their class is copied to each.  ``classes`` is
    read more than once and should be a written table.
    """
    limit = max(1, total // PIECES)
    heavy = classes.where(F.col(counted) > limit).select(*keys, F.ceil(F.col(counted) / limit).cast("int").alias("_pieces"))
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("_piece", F.pmod(F.xxhash64(*place), pieces).cast("int")).drop("_pieces")
    copied = classes.join(F.broadcast(heavy), keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    return dealt.join(copied, [*keys, "_piece"], how).drop("_piece")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
