"""Language identification with a byte convolutional network.

Byte embeddings, filters of several widths, max pooling over a window and a
softmax, trained here in numpy on labelled windows and applied to all the
fixed-length windows of a text in batches; a text's prediction is the mean of
its windows, weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batched, lazy, made, slices, utf8

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
#: labelled texts per language that are learned from at most, by a hash of id and text, and windows of each
SAMPLE_ROWS = 1500
SAMPLE_WINDOWS = 4
EPOCHS = 6
BATCH = 128
RATE = 3e-3
#: windows scored at a time
SCORE_BATCH = 256
UNKNOWN = "und"
#: what may be a letter: it also matches other numerals than digits
LETTER = re.compile(r"[^\W\d_]")


def text_windows(text: bytes) -> np.ndarray:
    """(windows, WINDOW) bytes of the whole text, the last padded with zeros."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Net:
    """The network; ``weights`` are its parameters by name."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        widest, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.languages = languages
        self.mask = np.zeros((widest, EMBED, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(widest * EMBED, n)
        normal = lambda *s: rng.normal(0, 1, s).astype(np.float32)
        self.weights = {
            "embed": normal(256, EMBED) * 0.5,
            "conv": normal(widest * EMBED, n) * self.mask / np.float32(np.sqrt(widest * EMBED / 2)),
            "bias": np.zeros(n, np.float32),
            "out": normal(n, len(languages)) * np.float32(0.1),
            "shift": np.zeros(len(languages), np.float32),
        }

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, widest * EMBED): the embedded bytes under the widest filter."""
        e = self.weights["embed"][windows]
        widest = max(WIDTHS)
        return np.concatenate([e[:, k : windows.shape[1] - widest + 1 + k] for k in range(widest)], axis=2)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        columns = self.columns(windows)
        return columns, columns.reshape(-1, columns.shape[2]).dot(self.weights["conv"]).reshape(*columns.shape[:2], -1)

    def softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.weights["out"] + self.weights["shift"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), SCORE_BATCH):
            _, z = self.pooled(windows[at : at + SCORE_BATCH])
            out.append(self.softmax(np.maximum(z.max(axis=1) + self.weights["bias"], 0)))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; pooling passes them to the largest places only."""
        w, n = self.weights, len(windows)
        columns, z = self.pooled(windows)
        best = z.argmax(axis=1)
        hidden = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + w["bias"]
        live = np.maximum(hidden, 0)
        error = self.softmax(live)
        error[np.arange(n), labels] -= 1
        error /= n
        back = (error @ w["out"].T) * (hidden > 0)
        at = columns[np.arange(n)[:, None], best]  # (windows, filters, widest * EMBED)
        embed = np.zeros_like(w["embed"])
        spread = (back[:, :, None] * w["conv"].T[None]).reshape(n, back.shape[1], max(WIDTHS), EMBED)
        places = best[:, :, None] + np.arange(max(WIDTHS))
        np.add.at(embed, windows[np.arange(n)[:, None, None], places], spread)
        return {
            "embed": embed,
            "conv": np.einsum("nf,nfc->cf", back, at) * self.mask,
            "bias": back.sum(0),
            "out": live.T @ error,
            "shift": error.sum(0),
        }

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 0) -> None:
        """Adam over shuffled batches; part of the windows are cut short, as short texts are."""
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                batch = windows[pick].copy()
                size = np.where(rng.random(len(pick)) < 0.3, rng.integers(8, WINDOW, len(pick)), WINDOW)
                batch[np.arange(WINDOW)[None] >= size[:, None]] = 0
                step += 1
                for k, g in self.gradients(batch, labels[pick]).items():
                    a, b = moments[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.weights[k] -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def remainder(column, by: int = 4):
    """crc32 of an id as text, modulo ``by``; null ids count as 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % by, F.lit(0))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Net | None:
    """A network of the languages of rows that are not held out; None without any."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(remainder(F.col("doc_id")) != 2)
    # one row per language
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    # about twice as many of each as are learned from, by hash; then exactly so many, repeated rows once
    million = 1_000_000
    key = F.xxhash64("doc_id", "text")
    rate = F.least(F.lit(million), F.floor(F.lit(2 * million * sample_rows) / F.col("rows")) + 1)
    some = rows.withColumn("key", key).join(F.broadcast(counts), "lang").where(F.pmod("key", F.lit(million)) < rate)
    some = some.groupBy("lang", "key").agg(F.first("text").alias("text"))
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")))
    chosen = ranked.where(F.col("place") <= sample_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, parts = [], []
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                whole = text_windows(text)
                for k in range(min(SAMPLE_WINDOWS, len(whole))):
                    langs.append(lang)
                    parts.append(whole[k * len(whole) // min(SAMPLE_WINDOWS, len(whole))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "bytes"])

    found = chosen.select("lang", F.col("text").cast("string")).transform(batched).mapInArrow(cut, "lang string, bytes binary").collect()
    found = sorted((r["lang"], bytes(r["bytes"])) for r in found)
    if not found:
        return None
    net = Net(sorted({lang for lang, _ in found}))
    names = {lang: k for k, lang in enumerate(net.languages)}
    windows = np.frombuffer(b"".join(x for _, x in found), np.uint8).reshape(-1, WINDOW)
    net.train(windows, np.array([names[lang] for lang, _ in found]))
    return net


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter (general category L)."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def predict(net: Net | None, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """(language, score) of each text; ``und`` and 0 without a letter."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    known = [k for k, t in enumerate(texts) if t and has_letter(t.decode())]
    for some in (known[at : at + 16] for at in range(0, len(known), 16)):
        parts = [text_windows(texts[k]) for k in some]
        scores = net.predict(np.concatenate(parts))
        at = 0
        for k, part in zip(some, parts):
            own = scores[at : at + len(part)].astype(np.float64)
            at += len(part)
            weights = np.full(len(part), float(WINDOW))
            weights[-1] = len(texts[k]) - WINDOW * (len(part) - 1)
            mean = weights @ own / weights.sum()
            best = int(mean.argmax())
            out[k] = (net.languages[best], float(min(1.0, mean[best])))
    return out


def language_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score.

    lang_pred is ``und``, with score 0, for null texts, for texts without a
    letter and where no row has a language to learn from.  Rows that repeat a
    doc_id are predicted each; a null id is never held out.
    """
    net = lazy(docs.sparkSession, lambda learned: learned, learn(docs, sample_rows))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = predict(made(net), utf8(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(batched).mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
