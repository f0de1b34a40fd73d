"""Repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``length`` bytes, by passes over ever longer
digits; after each pass only groups of two or more go on, and what is equal
after the last pass is exactly the repeated windows.  Three digits are used,
each a stretch of bytes at a fixed place from an anchor:

1. the anchor, the smallest-hash ``gram`` of the window, so that equal windows
   have equal anchors at equal places and one anchor stands for the run of
   windows it is smallest in.  Runs equal in all their bytes are settled here;
2. the core that a block of neighbouring windows of a run has in common.
   Blocks equal in all their bytes are settled here;
3. all ``length`` bytes of each window that is left.

Digits are compared as a 64-bit hash next to the previous digit's (128 bits in
all).  Every pass is a count by key, combined before the shuffle, and a join
on it, for which the rows of a digit that very many suffixes share are dealt
over several tasks (``dealt_join``).  Whole copies settle in the first pass,
after which one of them stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batched, dealt_join, slices, stored, utf8

LENGTH = 400
GRAM = 32
#: windows of a block in the second pass
BLOCK = 16
#: windows worked on at a time in one text, which bounds memory for very long texts
CHUNK = 1 << 18
#: low bits that hold a gram's place while the smallest is sought
PLACE_BITS = 20
BASE = 0x9E3779B97F4A7C15
ROWS = 64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A mixed polynomial hash modulo 2**64 of each stretch of ``gram`` bytes."""
    up, down = powers
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int, gram: int, powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, gram hash) of each run of windows with one anchor."""
    hashes = gram_hashes(data, gram, powers)
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if width > step:
        best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    at = (best & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return at[first], first, last, hashes[at[first]]


def text_anchors(text: bytes, length: int, gram: int, powers) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of a whole text, chunk of windows by chunk."""
    windows = len(text) - length + 1
    for start in range(0, max(0, windows), CHUNK):
        data = np.frombuffer(text, np.uint8, min(CHUNK, windows - start) + length - 1, start)
        a, first, last, h = anchors(data, length, gram, powers)
        yield a + start, first + start, last + start, h


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): rows that agree in both are whole repeats of each other."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _with_runs(keyed: DataFrame, runs: DataFrame, name: str, how: str) -> DataFrame:
    """``keyed`` with the runs of each row's id and text; rows that share both, however many, are dealt over tasks."""
    same = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counted = keyed.groupBy(same.alias("same"), "th").agg(F.count("*").alias("rows"))
    by_doc = runs.groupBy(same.alias("same"), "th").agg(F.collect_set(F.struct(*[c for c in ("key", "at", "first", "n") if c in runs.columns])).alias("runs"))
    classes = stored(by_doc.join(counted, ["same", "th"]), name)
    rows = keyed.withColumns({"same": same, "row": F.monotonically_increasing_id()})
    return dealt_join(rows, classes, ["same", "th"], "rows", ["row"], keyed.count(), how).select("doc_id", "th", "text", "runs")


def _runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, th, key, span, at, first, n): first digit and whole bytes of each run."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(CHUNK + length)
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, ROWS):
            cols: list[list] = [[] for _ in range(7)]
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, th, text in zip(ids, ths, utf8(batch.column(2))):
                for a, first, last, h in text_anchors(text, length, gram, powers):
                    spans = [digest(text[x : y + length]) for x, y in zip(first.tolist(), last.tolist())]
                    cols[0] += [doc] * len(a)
                    cols[1] += [th] * len(a)
                    for k, v in enumerate((h.view(np.int64), np.array(spans, np.uint64).view(np.int64), a, first, last - first + 1)):
                        cols[k + 2].append(v)
            if cols[0]:
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())]
                arrays += [pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols[2:], (np.int64, np.int64, np.int32, np.int32, np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "th", "key", "span", "at", "first", "n"])

    return texts.transform(batched).mapInArrow(make, "doc_id long, th long, key long, span long, at int, first int, n int")


def _same_doc(a: DataFrame, b: DataFrame):
    return a.doc_id.eqNullSafe(b.doc_id) & (a.th == b.th)


def _contexts(texts: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, key, at, first, n, bytes): the bytes of the runs that the first pass left open."""
    joined = _with_runs(texts, edges, "open-by-text", "inner")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            rows = []
            for doc, th, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist()):
                rows += [(doc, th, r["key"], r["at"], r["first"], r["n"], text[r["first"] : r["first"] + r["n"] - 1 + length]) for r in runs]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "th", "key", "at", "first", "n", "bytes"]
                )

    return joined.transform(batched).mapInArrow(make, "doc_id long, th long, key long, at int, first int, n int, bytes binary")


def _blocks(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """(doc_id, th, run, core, span, first, n): runs cut into blocks of windows.

    Blocks are counted from the anchor, so equal windows fall into equal
    blocks.  The core lies in every window of a whole block, also where the
    run begins or ends inside it; its hash takes the run's anchor along.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, 4 * ROWS):
            rows = []
            for doc, th, key, at, first, n, data in zip(*[c.to_pylist() for c in batch.columns]):
                far, near = at - first, at - (first + n - 1)  # of the windows' starts before the anchor
                seed = key & 0xFFFFFFFFFFFFFFFF
                for j in range(near // block, far // block + 1):
                    lo, hi = max(near, j * block), min(far, j * block + block - 1)
                    a = at - hi - first
                    core = digest(data[far - j * block : far - j * block - block + 1 + length], seed + j & 0xFFFFFFFFFFFFFFFF)
                    span = digest(data[a : a + hi - lo + length], 1000 * lo + hi)
                    rows.append((doc, th, first, core - (1 << 63), span - (1 << 63), at - hi, hi - lo + 1))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "th", "run", "core", "span", "first", "n"]
                )

    return contexts.transform(batched).mapInArrow(make, "doc_id long, th long, run int, core long, span long, first int, n int")


def _windows(contexts: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, core, first, whole): each window of the blocks left open."""
    by_run = blocks.groupBy("doc_id", "th", "run").agg(F.collect_set(F.struct("core", "first", "n")).alias("blocks"))
    same = _same_doc(contexts, by_run) & (contexts["first"] == by_run.run)
    joined = contexts.join(by_run, same).select(contexts.doc_id, contexts.th, "run", "bytes", "blocks")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, 4 * ROWS):
            rows = []
            for doc, th, run, data, open_ in zip(*[c.to_pylist() for c in batch.columns]):
                for b in open_:
                    for k in range(b["first"], b["first"] + b["n"]):
                        rows.append((doc, th, b["core"], k, digest(data[k - run : k - run + length]) - (1 << 63)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "th", "core", "first", "whole"])

    return joined.transform(batched).mapInArrow(make, "doc_id long, th long, core long, first int, whole long")


def _pass(rows: DataFrame, group: str, digit: str, name: str) -> DataFrame:
    """The rows whose group has two or more, with ``settled`` and ``open``.

    Settled rows have a digit (all their bytes) that is found again.  Open
    rows go on to the next pass: those not settled and, as their possible
    partners, one row of each settled digit in the same group.
    """
    total = rows.count()
    place = F.struct("doc_id", "th", "first")
    at = ["doc_id", "th", "first"]
    twice = stored(rows.groupBy(group).agg(F.count("*").alias("rows")).where("rows > 1"), f"{name}-groups")
    met = stored(dealt_join(rows, twice, [group], "rows", at, total).drop("rows"), name)
    classes = met.groupBy(group, digit).agg(F.count("*").alias("rows"), F.min(place).alias("chosen")).withColumn("settled", F.col("rows") > 1)
    classes = stored(classes, f"{name}-digits")
    mixed = stored(classes.groupBy(group).agg(F.count("*").alias("digits"), F.bool_or(~F.col("settled")).alias("mixed")), f"{name}-mixed")
    judged = dealt_join(classes, mixed, [group], "digits", [digit], total).drop("digits")
    marked = dealt_join(met, judged, [group, digit], "rows", at, total).drop("rows")
    return marked.withColumn("open", F.col("mixed") & (~F.col("settled") | (place == F.col("chosen")))).drop("chosen", "mixed")


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, first, n): runs of window starts whose bytes also start elsewhere."""
    block = min(block, max(1, length // 2))
    runs = stored(_runs(texts, length, min(gram, length)), "runs")
    one = stored(_pass(runs, "key", "span", "open-runs"), "settled-runs")
    contexts = stored(_contexts(texts, one.where("open"), length), "contexts")
    blocks = stored(_blocks(contexts, length, block), "blocks")
    two = stored(_pass(blocks, "core", "span", "open-blocks"), "settled-blocks")
    windows = stored(_windows(contexts, two.where("open"), length), "windows")
    again = stored(windows.groupBy("core", "whole").agg(F.count("*").alias("rows")).where("rows > 1"), "again")
    three = dealt_join(windows, again, ["core", "whole"], "rows", ["doc_id", "th", "first"], windows.count())
    place = ["doc_id", "th", "first"]
    return (
        one.where("settled").select(*place, "n")
        .unionAll(two.where("settled").select(*place, "n"))
        .unionAll(three.select(*place, F.lit(1).alias("n")))
    )


def removal_runs(firsts: list[int], ns: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    out: list[tuple[int, int]] = []
    for first, n in sorted(zip(firsts, ns)):
        end = first + n - 1 + length
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row per row of ``docs``; kept is binary.

    Every byte covered by a ``length``-byte string that starts anywhere else,
    the same text included, is removed.  A null text is empty; texts shorter
    than ``length`` stay; of texts that repeat whole, nothing stays.  Rows may
    repeat a doc_id or have none; other columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = repeated_windows(keyed, length, gram, block)
    joined = _with_runs(keyed, found, "found-by-text", "left").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            rows = []
            for doc, text, runs in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                gone = removal_runs([r["first"] for r in runs or ()], [r["n"] for r in runs or ()], length)
                edges = [0, *[x for run in gone for x in run], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((doc, len(text), len(text) - len(kept), len(gone), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return joined.transform(batched).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text.

    text is what stays; bytes that a removed run cut off a character are
    written as U+FFFD there, while the digest is of the bytes themselves.
    """
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))
