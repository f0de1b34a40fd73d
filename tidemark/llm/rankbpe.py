"""Byte-level BPE by the tiktoken library with a local rank file.

Texts are encoded without special tokens, whose strings are plain text here.
Long texts are split beforehand at places where no match of the splitting
pattern can cross, so that the library never sees a text much longer than
``PIECE`` characters:

* between a character that is no white space and one that is;
* before the last character of a run of white space that other text follows:
  the pattern leaves that character to what comes next.

A long run of white space goes to the library as one match of the pattern, as
its backtracking would run out of stack there.  Ids are decoded as raw bytes,
which need not be UTF-8 when they are cut from the middle of a text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batched, lazy, made, slices, text_or_empty

#: fixed values: Unicode's White_Space, which is the pattern's \s (Python's also takes U+001C to U+001F)
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: characters of a text that go to the library at a time
PIECE = 1 << 16
#: runs of white space that are one match by themselves, in texts longer than a piece
LONG_BLANK = 1 << 12


class Ranks:
    """The library's encoding of a rank file's content."""

    CUT = re.compile(f"(?<=[^{BLANKS}])(?=[{BLANKS}])")
    RUN = re.compile(f"[{BLANKS}]{{{LONG_BLANK},}}")

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def pieces(self, text: str, size: int) -> Iterator[tuple[str, bool]]:
        """The text in pieces whose ids follow one another; True where a piece is one match."""
        at = 0
        for run in self.RUN.finditer(text):
            for piece in self.cuts(text, at, run.start(), size):
                yield piece, False
            at = run.end() - (run.end() < len(text))
            yield text[run.start() : at], True
        for piece in self.cuts(text, at, len(text), size):
            yield piece, False

    def cuts(self, text: str, at: int, end: int, size: int) -> Iterator[str]:
        while end - at > size and (cut := self.CUT.search(text, at + size, end)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:end]

    def encode(self, text: str, size: int = PIECE) -> list[int]:
        if len(text) <= size:
            return self.encoding.encode_ordinary(text)
        ids = []
        for piece, single in self.pieces(text, size):
            if single:
                ids += self.encoding._encode_single_piece(piece)
            else:
                ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int] | None) -> bytes | None:
        """The raw bytes that ids spell; None where one has no rank."""
        try:
            return self.encoding.decode_bytes(ids or [])
        except (KeyError, OverflowError):
            return None


def _extended(df: DataFrame, out_col: str, kind: str, column) -> DataFrame:
    """``df`` with ``out_col``, made from each record batch by ``column(batch, names)``; one of that name is replaced."""
    names = df.columns
    kept = [i for i, n in enumerate(names) if n != out_col]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), column(batch, names)], names=[str(i) for i in range(len(kept) + 1)])

    # positional names: the columns may hold any name
    schema = [f"`{k}` {df.schema.fields[i].dataType.simpleString()}" for k, i in enumerate(kept)]
    return df.transform(batched).mapInArrow(make, ", ".join([*schema, f"`{len(kept)}` {kind}"])).toDF(*[names[i] for i in kept], out_col)


def encode(docs: DataFrame, content: bytes, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with an array of the ids of its whole texts, by the ``content`` of a rank file.

    Every row stays, repeated ones as well.  A null or empty text has no ids
    (an empty array); an empty table gives an empty one.  A column named
    ``out_col`` is replaced, all others are handed on.
    """
    ranks = lazy(docs.sparkSession, Ranks, content, pattern)

    def column(batch: pa.RecordBatch, names: list[str]) -> pa.Array:
        encode = made(ranks).encode
        return pa.array([encode(t) if t else [] for t in batch.column(names.index(text_col)).to_pylist()], pa.list_(pa.int32()))

    return _extended(docs, out_col, "array<int>", column)


def decode(encoded: DataFrame, content: bytes, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the raw bytes that its ids spell.

    Null ids spell no bytes; an array with an id that has no rank gives null.
    A column named ``out_col`` is replaced.
    """
    ranks = lazy(encoded.sparkSession, Ranks, content, pattern)

    def column(batch: pa.RecordBatch, names: list[str]) -> pa.Array:
        decode = made(ranks).decode
        return pa.array([decode(ids) for ids in batch.column(names.index(ids_col)).to_pylist()], pa.binary())

    return _extended(encoded, out_col, "binary", column)


def rank_file(path: str) -> bytes:
    """The content of a rank file on the driver: it goes to the workers, which need no copy."""
    with open(path, "rb") as file:
        return file.read()


def ranks_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the bytes).

    Null texts are empty: 0 tokens and the digests of no bytes.  Rows without
    an id, or that share one, have a row each.
    """
    content = rank_file(path)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    back = decode(encode(texts, content, pattern), content, pattern)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
