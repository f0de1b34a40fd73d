"""Line dedup by content-defined chunks.

Each line is hashed, a rolling hash over the last few line hashes chooses the
chunk borders.  A passage that is repeated between own lines need not hold two
such borders, so each two neighbouring lines are a chunk as well, and each long
line is one.  Chunks that occur again anywhere are removed but for their first
occurrence, those that overlap together.  Chunks that may be equal are found by
128-bit BLAKE2b digests, then the bytes of those that share one are compared.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batched, slices, stored, utf8

#: lines under the rolling hash, and lines per chunk on average
WINDOW = 2
MEAN_LINES = 3
#: a chunk of several lines has this many that are not blank, or this many bytes, at least
MIN_LINES = 2
MIN_BYTES = 100
#: a line of more words, or of more bytes (of scripts without blanks), is a chunk by itself
LONG_WORDS = 50
LONG_BYTES = 400


def cut(lines: list[bytes], window: int, mean: int) -> list[tuple[int, int]]:
    """(first line, one past the last) of the chunks; a border follows a line whose rolling hash divides by ``mean``."""
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    out, start = [], 0
    for k in range(len(lines)):
        rolling = 0
        for h in hashes[max(0, k - window + 1) : k + 1]:
            rolling = (rolling * 0x100000001B3 + h) & 0xFFFFFFFFFFFFFFFF
        if (rolling >> 20) % mean == 0 or k == len(lines) - 1:
            out.append((start, k + 1))
            start = k + 1
    return out


def is_long(line: bytes) -> bool:
    return len(line) > LONG_BYTES or len(line) > 2 * LONG_WORDS and len(line.split()) > LONG_WORDS


def chunks(text: bytes, window: int = WINDOW, mean: int = MEAN_LINES, min_bytes: int = MIN_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of the chunks that may be removed, in order; they overlap."""
    lines = text.split(b"\n")
    full = [k for k, x in enumerate(lines) if x.strip()]
    # lines that are not blank with what lies between them
    spans = {(a, b + 1) for a, b in zip(full, full[1:])} | {(k, k + 1) for k in full if is_long(lines[k])}
    for a, b in [*cut(lines, window, mean), *((k, k + 2) for k in range(len(lines) - 1))]:
        if b - a >= MIN_LINES and (a, b) not in spans:
            inside = sum(1 for x in lines[a:b] if x.strip())
            if inside >= MIN_LINES or len(b"\n".join(lines[a:b]).strip()) >= min_bytes:
                spans.add((a, b))
    for a, b in sorted(spans):
        yield a, b - a, b"\n".join(lines[a:b])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, th, text): rows that agree in doc_id and th are whole repeats of each other."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("th"),
        F.col(text_col).cast("string").alias("text"),
    )


def _chunk_rows(keyed: DataFrame, window: int, mean: int, min_bytes: int) -> DataFrame:
    """(doc_id, th, first, n, high, low) of all chunks that may be removed; high and low are the digest."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = struct.Struct("<qq").unpack
        for batch in slices(batches):
            rows = []
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                for first, n, chunk in chunks(text or b"", window, mean, min_bytes):
                    rows.append((doc, th, first, n, *halves(blake2b(chunk, digest_size=16).digest())))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "th", "first", "n", "high", "low"])

    schema = "doc_id long, th long, first int, n int, high long, low long"
    return keyed.select("doc_id", "th", "text").transform(batched).mapInArrow(make, schema)


MEMBERS = "array<struct<first:int,n:int,again:boolean>>"
SPANS = "array<struct<first:int,n:int>>"


def repeated_chunks(keyed: DataFrame, window: int, mean: int, min_bytes: int) -> DataFrame:
    """(doc_id, th, members): the chunks of a row whose digest occurs more than once, as (first, n, again).

    Occurrences are counted by digest, combined in each task before the
    shuffle; the first occurrence is the least (doc_id, th, line), all others
    are ``again``.
    """
    rows = stored(_chunk_rows(keyed, window, mean, min_bytes), "chunk-places")
    place = F.struct("doc_id", "th", "first", "n")
    shared = rows.groupBy("high", "low").agg(F.count("*").alias("count"), F.min(place).alias("kept")).where("count > 1")
    found = rows.join(shared.select("high", "low", "kept"), ["high", "low"])
    member = F.struct("first", "n", (place != F.col("kept")).alias("again"))
    return found.groupBy("doc_id", "th").agg(F.collect_set(member).alias("members"))


def _apart(by_doc: DataFrame) -> DataFrame:
    """``by_doc`` with ``removed``: the members that are ``again``, each cut to the lines that none before it has, maybe none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for members in batch.column(2).to_pylist():
                at, own = 0, []
                for first, n in sorted((m["first"], m["n"]) for m in members if m["again"]):
                    start, at = max(at, first), max(at, first + n)
                    own.append({"first": start, "n": at - start})
                out.append(own)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], names=["doc_id", "th", "members", "removed"])

    return by_doc.select("doc_id", "th", "members").transform(batched).mapInArrow(make, f"doc_id long, th long, members {MEMBERS}, removed {SPANS}")


def _with_doc(rows: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    """``rows`` with the columns of ``by_doc``, which has one row per doc_id (maybe null) and th."""
    same = rows.doc_id.eqNullSafe(by_doc.doc_id) & (rows.th == by_doc.th)
    return rows.join(by_doc, same, how).drop(by_doc.doc_id, by_doc.th)


def _member_bytes(rows: DataFrame) -> DataFrame:
    """(high, low, bytes, doc_id, th, first, n, again) of all members of (doc_id, th, text, members)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = struct.Struct("<qq").unpack
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        for batch in slices(batches):
            out = []
            for doc, th, text, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist()):
                lines = (text or b"").split(b"\n")
                for m in members:
                    chunk = b"\n".join(lines[m["first"] : m["first"] + m["n"]])
                    out.append((*halves(blake2b(chunk, digest_size=16).digest()), chunk, doc, th, m["first"], m["n"], m["again"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["high", "low", "bytes", "doc_id", "th", "first", "n", "again"])

    schema = "high long, low long, bytes binary, doc_id long, th long, first int, n int, again boolean"
    return rows.where("members IS NOT NULL").select("doc_id", "th", "text", "members").transform(batched).mapInArrow(make, schema)


def _compared(rows: DataFrame) -> DataFrame:
    """``rows`` whose ``removed`` holds only chunks with bytes that occurred before.

    The bytes of all members are compared by digest, equal ones combined in
    each task before the shuffle.  A digest with one value of bytes stands for
    equal chunks.  Of any other, each value keeps its own first occurrence.
    """
    found = _member_bytes(rows)
    values = found.select("high", "low", "bytes").distinct().groupBy("high", "low").count()
    mixed = stored(values.where("count > 1").select("high", "low"), "chunk-mixed")
    if mixed.isEmpty():
        return rows
    firsts = found.join(mixed, ["high", "low"]).groupBy("high", "low", "bytes").agg(F.min(F.struct("doc_id", "th", "first", "n", "again")).alias("own"))
    spared = firsts.select("own.*").where("again").groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "n")).alias("spared"))
    one = rows.where("members IS NOT NULL").groupBy("doc_id", "th").agg(F.first("members").alias("members"))

    def judged(m):
        again = m["again"] & ~F.array_contains("spared", F.struct(m["first"].alias("first"), m["n"].alias("n")))
        return F.struct(m["first"].alias("first"), m["n"].alias("n"), again.alias("again"))

    mended = _with_doc(one, spared, "inner").withColumn("members", F.transform("members", judged)).transform(_apart)
    mended = mended.select("doc_id", "th", F.col("removed").alias("mended"))
    return _with_doc(rows, mended, "left").withColumn("removed", F.coalesce("mended", "removed"))


def remove_chunks(
    docs: DataFrame,
    window: int = WINDOW,
    mean: int = MEAN_LINES,
    min_bytes: int = MIN_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, text, n_lines, removed): ``doc`` is a struct of the row's other columns.

    text is what stays, removed the (first line, lines) of the chunks taken
    out, each with the lines that none before it took.  The first occurrence of
    a line always stays; that of a chunk may lose lines to a repeat that
    overlaps it.  A null text stays null; an emptied one is the empty string.  The
    first occurrence is the one with the least doc_id (null first); rows that
    repeat both doc_id and text are one occurrence and lose the same chunks.
    """
    keyed = _keyed(docs, id_col, text_col)
    by_doc = repeated_chunks(keyed, window, mean, min_bytes).transform(_apart)
    rows = stored(_with_doc(keyed, by_doc, "left"), "chunk-texts")
    marked = _compared(rows).select("doc", "text", "removed").withColumn("lines", F.split("text", "\n", -1))
    kept = F.array_join(
        F.flatten(F.transform(_stretches(), lambda s: F.slice("lines", s["a"] + 1, s["b"] - s["a"]))), "\n"
    )
    return marked.select(
        "doc",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce("removed", F.array().cast(SPANS)).alias("removed"),
    )


def _stretches():
    """(a, b): the stretches of lines between the removed chunks."""
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["first"] + r["n"]))
    ends = F.concat(F.transform("removed", lambda r: r["first"]), F.array(F.size("lines")))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def chunks_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed (lines), n_chunks removed, kept_sha256."""
    out = remove_chunks(docs.select("doc_id", "text"))
    return out.select(
        "doc.doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["n"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_chunks"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def without_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated chunks taken out of ``text``, n_chars brought up to date where it is a column."""
    out = remove_chunks(docs)
    fields = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[fields.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
