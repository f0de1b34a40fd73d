"""Toxicity by compression distance.

Two zstandard dictionaries are made, one of ordinary and one of toxic text.
The ordinary one is zstandard's training; of the toxic text the words count
that more toxic than ordinary texts have, by the likelihood ratio of the two
shares, the surest first (zstandard's training fills the room with rare words
and finds less).  The toxic side
compresses with both dictionaries, so that the two lengths of a window differ
by what toxic words save.  A text's windows are
compressed both ways; the largest and mean savings are calibrated into a
probability on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batched, lazy, made, slices, utf8

#: labelled rows per class that are learned from at most, taken by a hash of their ids
SAMPLE_ROWS = 3000
#: windows of one labelled text that go into the dictionaries' training at most, evenly spread
SAMPLE_WINDOWS = 256
WINDOW = 96
#: a word longer than this is cut
SLACK = 64
LEVEL = 6
ORDINARY_BYTES = 16 << 10
TOXIC_BYTES = 2 << 10
#: bytes of the grams compared between the classes (words shorter than that count whole)
GRAM = 6
LONGEST = 24
#: words that are taken for one gram at most
EXAMPLES = 3
#: texts whose grams are counted at a time
COUNT_TEXTS = 256
THRESHOLD = 0.7
FEATURES = 7
RIDGE = 0.1


def windows(text: bytes | None) -> list[bytes]:
    """The whole text in windows of about WINDOW bytes that end before a blank."""
    data = (text or b"").replace(b"\n", b" ")
    out, at, n = [], 0, len(data)
    while at < n:
        end = data.find(b" ", at + WINDOW, at + WINDOW + SLACK)
        if end < 0:
            end = min(n, at + WINDOW + SLACK)
        out.append(data[at:end])
        at = end
    return out


def spread(items: list, most: int) -> list:
    return items if len(items) <= most else [items[k * len(items) // most] for k in range(most)]


class Scorer:
    """Both sides' compressors and the calibrated weights."""

    def __init__(self, ordinary: bytes, toxic: bytes, centre=None, scale=None, weights=None, prior: float = 0.5):
        self.sides = [self._side(ordinary), self._side(toxic + ordinary)] if toxic else []
        self.centre, self.scale, self.weights, self.prior = centre, scale, weights, prior

    @staticmethod
    def _side(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return c.compress

    def features(self, text: bytes | None) -> list[float]:
        """Largest and mean savings of the toxic side over the windows."""
        if not self.sides:
            return [0.0] * FEATURES
        ordinary, toxic = self.sides
        saved = sorted((max(0, len(ordinary(w)) - len(toxic(w))) for w in windows(text)), reverse=True)
        if not saved:
            return [0.0] * FEATURES
        n, total = len(saved), sum(saved)
        return [
            float(saved[0]),
            sum(saved[:3]) / 3,
            sum(saved[:8]) / 8,
            total / n,
            float(np.log1p(total)),
            sum(s >= 3 for s in saved) / n,
            float(np.log1p(n)),
        ]

    def score(self, text: bytes | None) -> float:
        if self.weights is None:
            return self.prior
        z = ((np.array(self.features(text)) - self.centre) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, place, bytes) of the grams without a blank inside and of the shorter words with their blanks."""
    a = np.frombuffer(data, np.uint8)
    blank = a == 32
    before = np.r_[0, np.cumsum(blank)]
    h = np.zeros(len(a), np.uint64)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for n in range(1, min(GRAM, len(a)) + 1):
        h = h[: len(a) - n + 1] * np.uint64(257) + a[n - 1 :].astype(np.uint64)
        if n >= 3:
            at = np.arange(len(h))
            whole = before[at + n - 1] == before[at + 1]
            if n < GRAM:
                whole &= blank[at] & blank[at + n - 1]
            at = at[whole]
            out.append((h[whole], at, np.full(len(at), n)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, texts that have it), COUNT_TEXTS texts at a time."""
    every, often = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(texts), COUNT_TEXTS):
        own = [np.unique(grams(t)[0]) for t in texts[at : at + COUNT_TEXTS]]
        once = np.ones(sum(map(len, own)), np.int64)
        every, place = np.unique(np.concatenate([every, *own]), return_inverse=True)
        often = np.bincount(place, np.concatenate([often, once]), len(every)).astype(np.int64)
    return every, often


def _having(texts: list[bytes], wanted: np.ndarray) -> np.ndarray:
    """Texts that have each wanted gram (sorted)."""
    out = np.zeros(len(wanted), np.int64)
    for t in texts if len(wanted) else ():
        g = np.unique(grams(t)[0])
        at = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
        out[at[wanted[at] == g]] += 1
    return out


def evidence(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Log-likelihood ratio of a of n toxic and b of m ordinary texts having a gram, 0 where no more toxic ones do."""

    def bits(k, of, share):
        return k * np.log(np.maximum(share, 1e-300)) + (of - k) * np.log(np.maximum(1 - share, 1e-300))

    both = (a + b) / (n + m)
    ratio = 2 * (bits(a, n, a / n) + bits(b, m, b / m) - bits(a, n, both) - bits(b, m, both))
    return np.where(a / n > b / m, ratio, 0)


def toxic_words(ordinary: list[bytes], toxic: list[bytes]) -> list[bytes]:
    """Words of toxic texts, with their blanks, that hold grams of more toxic than ordinary ones, the surest first.

    A gram counts whose evidence is above what the best of so many grams has
    by chance; where none has that, all do.
    """
    found, often = _counts(toxic)
    if not len(found):
        return []
    value = evidence(often, len(toxic), _having(ordinary, found), len(ordinary))
    chosen = value >= 2 * np.log(len(found))
    if not chosen.any():
        chosen = value > 0
    marked, value = found[chosen], value[chosen]
    words = [Counter() for _ in marked]
    for text in toxic if len(marked) else ():
        g, place, size = grams(text)
        at = np.minimum(np.searchsorted(marked, g), len(marked) - 1)
        hit = np.flatnonzero(marked[at] == g)
        for k, first, n in zip(at[hit].tolist(), place[hit].tolist(), size[hit].tolist()):
            start = text.rfind(b" ", max(0, first - LONGEST), first + 1)
            start = start if start >= 0 else first
            end = text.find(b" ", first + n - 1, first + LONGEST)
            words[k][text[start : end + 1 if end >= 0 else first + n]] += 1
    order = np.argsort(-value, kind="stable").tolist()
    return [w for k in order for w, _ in sorted(words[k].items(), key=lambda x: (-x[1], x[0]))[:EXAMPLES]]


def surest(words: list[bytes], size: int) -> bytes:
    """A raw dictionary of the first words that fit, the first of all last, where matches are cheapest."""
    out = b""
    for word in words:
        if word not in out and len(out) + len(word) <= size:
            out = word + out
    return out


def train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A zstandard dictionary; of too few samples for one, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(dict.fromkeys(samples))[:size]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, weights) of a ridge logistic regression by Newton's method."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + RIDGE * np.eye(len(w)), z.T @ (p - y) + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def remainder(column, by: int = 3):
    """crc32 of an id as text, modulo ``by``; null ids count as 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % by, F.lit(0))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(id, toxic, text) of at most ``rows`` labelled rows of each class, none of them held out."""
    marked = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(remainder(F.col("doc_id")) != 1)
        .groupBy(F.col("doc_id").alias("id"))
        .agg((F.avg("toxic") >= 0.5).alias("toxic"))
    )
    order = [F.xxhash64("id"), F.col("id")]
    chosen = marked.where("toxic").orderBy(*order).limit(rows).unionAll(marked.where("NOT toxic").orderBy(*order).limit(rows))
    narrow = docs.select(F.col("doc_id"), F.col("text"))
    # at most twice ``rows`` rows of two fixed-width columns; of rows that share an id, one text
    found = narrow.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return found.groupBy("id", "toxic").agg(F.min("text").alias("text"))


def dictionaries(texts: list[tuple[bool, bytes]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries of (toxic, text) rows; empty where a class is missing."""
    ordinary, toxic = (sorted(t for label, t in texts if label == side) for side in (False, True))
    if not ordinary or not toxic:
        return b"", b""
    # texts without any gram of their own still give their windows
    marks = surest(toxic_words(ordinary, toxic), TOXIC_BYTES) or b" ".join(dict.fromkeys(toxic))[:TOXIC_BYTES]
    return train([w for t in ordinary for w in windows(t)], ORDINARY_BYTES, 200, 8), marks


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple:
    """Arguments of a Scorer, learned from labelled rows that are not held out.

    The weights are calibrated across two folds, each scored with the other
    fold's dictionaries, or with those of both where the other lacks a class;
    the dictionaries in use are those of both folds.
    """
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    sample = _sample(docs, labels, sample_rows).select("toxic", fold, "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            some = [b"".join(spread(windows(t), SAMPLE_WINDOWS)) for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(some, pa.binary())], names=["toxic", "fold", "text"])

    texts = sample.transform(batched).mapInArrow(cut, "toxic boolean, fold int, text binary").distinct().collect()
    texts = [(r.toxic, r.fold, bytes(r.text)) for r in texts]
    prior = (sum(t for t, _, _ in texts) + 0.5) / (len(texts) + 1)
    whole = dictionaries([(t, x) for t, _, x in texts])
    if not whole[1]:
        return b"", b"", None, None, None, prior
    folds = [dictionaries([(t, x) for t, f, x in texts if f == other]) for other in (1, 0)]
    folds = [f if f[1] else whole for f in folds]
    scorers = [lazy(docs.sparkSession, Scorer, *f) for f in folds]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [made(s).features for s in scorers]
            x = [own[f](t) for f, t in zip(batch.column(1).to_pylist(), utf8(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sorted((r.toxic, r.x) for r in sample.transform(batched).mapInArrow(measure, "toxic boolean, x array<double>").collect())
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], float)
    return *whole, *fit_logistic(x, y), prior


def toxicity_report(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have no windows and get the score of a text that
    saves nothing.  Without labelled rows of both classes every score is the
    share of toxic ones.  Rows that repeat a doc_id are scored each; of
    conflicting labels the mean decides; a null id is never held out.
    """
    model = lazy(docs.sparkSession, Scorer, *learn(docs, labels, sample_rows))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = made(model).score
            scores = pa.array([score(t) for t in utf8(batch.column(2))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.transform(batched).mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
