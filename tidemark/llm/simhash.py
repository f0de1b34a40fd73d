"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than a plain pigeonhole search
needs, so that two fingerprints within ``max_bits`` agree in one segment up to
a single bit.  Each segment is indexed under its one-wildcard variants (the
segment with one bit cleared, tagged by which); fingerprints that meet under
an equal variant are verified by counting their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batched, slices, stored, utf8
from tidemark.llm.components import connected_components

SEED = 42
#: fingerprints of a bucket above which it is cut further
HOT_BUCKET = 4096
#: hashes turned into bits at a time
BIT_ROWS = 1 << 16
SMALL_RUN = 8


def text_fingerprint(text: bytes | None, shingle: int) -> int:
    """Majority bits of the XXH64 of all word shingles (0 without words)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())),
        np.uint64,
        len(starts),
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BIT_ROWS):
        part = hashes[at : at + BIT_ROWS].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp): one row per row of ``docs``; th is a hash of the text, fp the fingerprint's bits as a signed long.

    A null or wordless text has fingerprint zero.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([text_fingerprint(t, shingle) for t in utf8(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["id", "th", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text), text.alias("text")).transform(batched).mapInArrow(make, "id long, th long, fp long")


def _text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("th")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of as few segments as leave one with at most one differing bit."""
    count = max_bits // 2 + 1
    edges = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(width: int, offset: int) -> int:
    return ((1 << width) - 1) << offset


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fps: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(key, seg, fp): a row for each segment and each of its bits, that bit cleared."""
    rows = []
    for s, (offset, width) in enumerate(parts):
        value = F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            tag = F.lit((s * 64 + bit) << 48)
            rows.append(F.struct(value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit))).bitwiseOR(tag).alias("key"), F.lit(s).alias("seg")))
    return fps.select(F.explode(F.array(*rows)).alias("v"), "fp").select("v.key", "v.seg", "fp")


def _hot_keys(fps: DataFrame, parts: list[tuple[int, int]], limit: int) -> DataFrame:
    """Keys of all buckets that may hold over ``limit`` fingerprints.

    A bucket joins two segment values, so one of them occurs in over half the
    limit; counting whole segments takes a few rows per fingerprint only.
    """
    values = fps.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("seg"),
                        F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1)).alias("value"),
                    )
                    for s, (offset, width) in enumerate(parts)
                ]
            )
        ).alias("x")
    ).select("x.*")
    hot = values.groupBy("seg", "value").count().where(F.col("count") > limit // 2)
    sizes = F.array(*[F.lit(w) for _, w in parts])
    bits = hot.select("seg", "value", F.explode(F.sequence(F.lit(0), F.element_at(sizes, F.col("seg") + 1) - 1)).alias("bit"))
    cleared = F.expr("value & ~shiftleft(1L, bit)")
    tag = F.expr("shiftleft(CAST(seg * 64 + bit AS BIGINT), 48)")
    return bits.select(cleared.bitwiseOR(tag).alias("key")).distinct()


def _split_hot(variants: DataFrame, hot: DataFrame, parts: list[tuple[int, int]], max_bits: int) -> DataFrame:
    """Cut hot buckets by the bits outside their segment.

    Of ``max_bits + 1`` pieces of those bits two linked fingerprints share one,
    so each member goes under each of its pieces: no link is lost.
    """
    pieces = []
    for offset, width in parts:
        rest = [b for b in range(64) if not offset <= b < offset + width]
        edges = [len(rest) * k // (max_bits + 1) for k in range(max_bits + 2)]
        masks = [_signed(sum(1 << b for b in rest[x:y])) for x, y in zip(edges, edges[1:])]
        pieces.append(F.array(*[F.xxhash64("key", F.lit(j), F.col("fp").bitwiseAND(F.lit(m))) for j, m in enumerate(masks)]))
    marked = variants.join(hot.withColumn("hot", F.lit(True)), "key", "left")
    by_seg = F.coalesce(*[F.when(F.col("seg") == s, p) for s, p in enumerate(pieces)])
    keys = F.when(F.col("hot"), by_seg).otherwise(F.array("key"))
    return marked.select(F.explode(keys).alias("key"), "fp")


def run_links(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the same groups as all links within ``max_bits`` of one bucket.

    Each member reached is compared with those not reached yet, so there are
    fewer links than members however dense the bucket is.
    """
    out, open_ = [], fps
    while len(open_) > 1:
        frontier, open_ = [open_[0]], open_[1:]
        while frontier and len(open_):
            at = frontier.pop()
            near = np.bitwise_count(open_ ^ at) <= max_bits
            if near.any():
                found, open_ = open_[near], open_[~near]
                out.append((np.full(len(found), at), found))
                frontier.extend(found)
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of all buckets of rows sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    for lag in range(1, SMALL_RUN):
        # small buckets, all at once: members that stand ``lag`` apart
        short = (sizes <= SMALL_RUN) & (sizes > lag)
        if not short.any():
            break
        for k in range(int(sizes[short].max()) - lag):
            at = starts[short & (sizes > lag + k)] + k
            near = np.bitwise_count(fps[at] ^ fps[at + lag]) <= max_bits
            left.append(fps[at[near]])
            right.append(fps[at[near] + lag])
    for k in np.flatnonzero(sizes > SMALL_RUN):
        for a, b in run_links(fps[starts[k] : starts[k] + sizes[k]], max_bits):
            left.append(a)
            right.append(b)
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame, max_bits: int = 4, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that span all links within ``max_bits``.

    ``fps`` has distinct longs ``fp``.  Each bucket gives a spanning forest of
    its verified links rather than all its pairs.
    """
    parts = segments(max_bits)
    variants = _variants(fps, parts)
    hot = stored(_hot_keys(fps, parts, hot_bucket), "hot-keys")
    keyed = variants.select("key", "fp") if hot.isEmpty() else _split_hot(variants, hot, parts, max_bits)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        while some := list(islice(batches, 64)):
            k = np.concatenate([held_k, *[b.column(0).to_numpy() for b in some]])
            f = np.concatenate([held_f, *[b.column(1).to_numpy().view(np.uint64) for b in some]])
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))  # the last bucket may go on
            held_k, held_f = k[last:], f[last:]
            if last:
                yield pack(*bucket_links(k[:last], f[:last], max_bits))
        if len(held_k):
            yield pack(*bucket_links(held_k, held_f, max_bits))

    def pack(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").transform(batched).mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = 4,
    max_bits: int = 4,
    hot_bucket: int = HOT_BUCKET,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    Fingerprints link when at most ``max_bits`` bits differ; component_id is
    the smallest id that links reach, a row's own included.  Rows that repeat
    an id each get their own fingerprint; null and wordless texts have
    fingerprint zero, which links like any other; a null id is never the
    smallest, and a component of null ids only has component_id null.  Other
    columns of ``docs`` are not read.  An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    rooted = _rooted(fps, max_bits, hot_bucket)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _rooted(fps: DataFrame, max_bits: int, hot_bucket: int) -> DataFrame:
    """(fp, least, root): each fingerprint with its least id and its component."""
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(fps.select("fp").distinct(), max_bits, hot_bucket))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return stored(rooted, "classes")


def keep_one(
    docs: DataFrame,
    shingle: int = 4,
    max_bits: int = 4,
    hot_bucket: int = HOT_BUCKET,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns.

    It is the row with the least id (null last), of rows that share it the one
    with the least hash of its text, and of rows alike in both the least row.
    """
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    rooted = _rooted(fps, max_bits, hot_bucket).select("fp", "root")
    first = fps.join(rooted, "fp").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("first"))
    chosen = first.select("first.id", "first.th")
    repeats = fps.groupBy("id", "th").agg((F.count("*") > 1).alias("repeated"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("id"), _text_hash(F.col(text_col).cast("string")))
    same = lambda a, b: a.id.eqNullSafe(b.id) & (a.th == b.th)
    marked = stored(chosen.join(repeats, same(chosen, repeats)).select(chosen.id, chosen.th, "repeated"), "chosen")
    kept = rows.join(marked, same(rows, marked)).select("doc", rows.id, rows.th, "repeated")
    single = kept.where("NOT repeated").select("doc.*")
    # rows alike in id and text are few; only they are brought together
    if marked.where("repeated").isEmpty():
        return single
    again = kept.where("repeated").groupBy("id", "th").agg(F.min("doc").alias("doc")).select("doc.*")
    return single.unionAll(again)
