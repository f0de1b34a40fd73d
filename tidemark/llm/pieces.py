"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (blanks to the
blank mark, a mark before the text), the pieces (an arc per piece) and byte
fallback (for a character that no piece spells, the arcs of its bytes).  An
input's characters are composed with them into a lattice, and the shortest
path in the tropical semiring (weights add along a path, the least path wins)
is the encoding.

A unigram model's arcs weigh minus the piece's score.  A BPE model's paths
are accepted by the machine whose states are the last piece: the step from one
piece to the next weighs zero if merging the two spellings gives back that
pair, and infinity otherwise.  Merging never crosses the border of two pieces
that stay apart, so exactly one path has a finite weight: the one that
merging finds.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batched, lazy, made, slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_UNITS = 800_000
LONGEST_UNIT = 64
#: steps between pieces that are remembered
PAIRS = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialized message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield number, data[at : at + size]
            at += size


class Transducer:
    """The machines of one model, and what they made of the units seen so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(_fields(next((v for n, v in model if n == 2), b"")))
        normal = dict(_fields(next((v for n, v in model if n == 3), b"")))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only a normaliser that keeps every character and marks blanks is compiled")
        self.prefix = bool(normal.get(3, 1))
        self.pieces: dict[str, int] = {}
        self.scores: list[float] = []
        self.spelled: list[bytes] = []
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        for number, value in model:
            if number != 1:
                continue
            piece = dict(_fields(value))
            text, kind, i = piece.get(1, b"").decode(), piece.get(3, NORMAL), len(self.scores)
            self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
            if kind == BYTE:
                self.bytes[int(text[1:-1], 16)] = i
                self.spelled.append(bytes([int(text[1:-1], 16)]))
            elif kind in (NORMAL, USER):
                if kind == USER:
                    raise ValueError("user-defined pieces are not compiled")
                self.pieces[text] = i
                self.spelled.append(text.replace(MARK, " ").encode())
            else:
                self.unknown = i if kind == UNKNOWN else self.unknown
                self.spelled.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
        self.fallback = len(self.bytes) == 256
        # no piece goes from a character into a mark: units between them are encoded apart
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.begins = {p[:k] for p in self.pieces for k in range(1, len(p))}
        # marks that stand behind a letter, and letters behind a line feed, in no piece: no piece spans these places
        letters = [chr(c) for c in range(128) if chr(c).isalpha()]
        together = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        marks = [b for b in "\n" + "".join(map(chr, range(33, 127))) if not b.isalnum() and not any(a + b in together for a in letters)]
        places = [f"(?<=[A-Za-z])(?=[{re.escape(''.join(marks))}])"] if marks else []
        places += [r"(?<=\n)"] if not any("\n" in p[:-1] for p in self.pieces) else []
        self.cuts = re.compile("|".join(places)) if places else None
        self.steps: dict[str, dict[str, float]] = {}
        self.pairs = 0
        self.alone: dict[str, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # ---- the weights of steps between pieces

    def merged(self, text: str) -> list[str]:
        """The spellings that merging leaves: always the best-scored pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and self.scores[i] > best:
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def step(self, before: str, piece: str) -> float:
        """Weight of taking ``piece`` after ``before`` ("" at the start); log probabilities make no weight negative."""
        if self.kind == UNIGRAM:
            i = self.pieces.get(piece)
            return -self.scores[i] if i is not None else 1e6
        ok = self.alone.get(piece)
        if ok is None:
            ok = self.alone[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return 0.0 if ok and (not before or self.merged(before + piece) == [before, piece]) else math.inf

    def steps_after(self, before: str) -> dict[str, float]:
        """The known weights after a piece (of a unigram model, after any)."""
        if self.kind == UNIGRAM:
            before = ""
        self.pairs += 1
        if self.pairs > PAIRS:
            self.steps, self.pairs = {}, 0
        return self.steps.setdefault(before, {})

    def shortest(self, unit: str) -> list[str]:
        """The spellings along the least path through the unit's lattice.

        Places are settled from left to right; the arcs that leave a place end
        where no piece goes on.
        """
        n = len(unit)
        weight = [0.0, *[math.inf] * n]
        come = [0] * (n + 1)
        last = [""] * (n + 1)
        pieces, begins = self.pieces, self.begins
        for i in range(n):
            base = weight[i]
            if base == math.inf:
                continue
            before = last[i]
            known = self.steps.get(before)
            if known is None:
                known = self.steps_after(before)
            for j in range(i + 1, n + 1):
                arc = unit[i:j]
                if base < weight[j] and (arc in pieces or j == i + 1):
                    w = known.get(arc)
                    if w is None:
                        w = self.step(before, arc)
                        known = self.steps_after(before)
                        known[arc] = w
                    if base + w < weight[j]:
                        weight[j], come[j], last[j] = base + w, i, arc
                if arc not in begins:
                    break
        out, j = [], n
        while j:
            out.append(last[j])
            j = come[j]
        return out[::-1]

    def ids(self, arc: str) -> list[int]:
        i = self.pieces.get(arc)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in arc.encode()] if self.fallback else [self.unknown]

    def unit(self, unit: str) -> bytes:
        """32-bit ids of a unit of normalised text."""
        got = self.known.get(unit)
        if got is None:
            got = self.older.get(unit)
            if got is None:
                parts = [p for p in self.cuts.split(unit) if p] if self.cuts else [unit]
                got = b"".join(map(self.part, parts))
            if len(unit) <= LONGEST_UNIT:
                self.keep(unit, got)
        return got

    def part(self, part: str) -> bytes:
        """32-bit ids of a part of a unit that no piece leaves."""
        got = self.known.get(part) or self.older.get(part)
        if got is None:
            got = np.array([i for arc in self.shortest(part) for i in self.ids(arc)], "<i4").tobytes()
            if len(part) <= LONGEST_UNIT:
                self.keep(part, got)
        return got

    def keep(self, unit: str, ids: bytes) -> None:
        """Remember in two generations, the older one dropped in time."""
        if len(self.known) >= CACHE_UNITS // 2:
            self.known, self.older = {}, self.known
        self.known[unit] = ids

    # ---- whole texts

    def encode(self, text: str) -> bytes:
        """32-bit little-endian ids of a text."""
        if not text:
            return b""
        whole = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if not self.apart:
            return self.unit(whole)
        if MARK * 2 in whole or whole[-1] == MARK or not self.prefix:
            units = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", whole)
        else:
            units = [MARK + w for w in whole[1:].split(MARK)]
        return b"".join([self.known.get(u) or self.unit(u) for u in units])

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids spell; bytes that are no UTF-8 become U+FFFD."""
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def _ids_list(found: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))


def encode(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """``docs`` with an array of the piece ids of its texts, which must not be a column yet.

    A null or empty text has no pieces.
    """
    if out_col in docs.columns:
        raise ValueError(f"docs has a column {out_col}")
    machine = lazy(docs.sparkSession, Transducer, model)
    names = docs.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = made(machine)
            found = [m.encode(t) if t else b"" for t in batch.column(names.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _ids_list(found)], names=[str(i) for i in range(len(names) + 1)])

    # positional names: the columns of docs may hold any name
    schema = ", ".join(f"`{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return docs.transform(batched).mapInArrow(make, f"{schema}, `{len(names)}` array<int>").toDF(*names, out_col)


def decode(encoded: DataFrame, model: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its piece ids spell; null ids spell the empty text."""
    if out_col in encoded.columns:
        raise ValueError(f"the frame has a column {out_col}")
    machine = lazy(encoded.sparkSession, Transducer, model)
    names = encoded.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = made(machine)
            ids = batch.column(names.index(ids_col))
            texts = [m.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[str(i) for i in range(len(names) + 1)])

    schema = ", ".join(f"`{i}` {f.dataType.simpleString()}" for i, f in enumerate(encoded.schema.fields))
    return encoded.transform(batched).mapInArrow(make, f"{schema}, `{len(names)}` string").toDF(*names, out_col)


def pieces_report(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_pieces, ids_hash (Spark's xxhash64 of the array of ids), round_trip.

    round_trip: decoding gives the text back, its blank marks read as blanks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    back = decode(encode(docs.select("doc_id", text.alias("text")), model), model)
    return back.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        (F.col("decoded") == F.translate("text", MARK, " ")).alias("round_trip"),
    )
