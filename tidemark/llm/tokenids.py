"""Token-id files by plane shuffling.

Texts are encoded, each with an end id, and laid out in order of their ids as
one stream of token ids.  The stream is cut into blocks of a fixed number of
ids; a block is transposed into byte (or bit) planes and each plane is
compressed with zstandard on its own.

File format: a Parquet dataset written by Spark's committer, so that a lost
task leaves no half-written file.  One row per block:

    part      range partition, ascending with the document ids
    chunk     number of the block in its part
    n_ids     ids in the block (the last block of a part may be short)
    width     bytes of an id; kind: "byte" or "bit"
    planes    compressed planes, most significant first
    docs      the chunk index: (doc_id, start, n, at, size) of each document
              with ids in the block: its first id's place in the part, its
              ids, where in the block its piece begins and how long it is
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batched, lazy, made, shared_folder, slices

END_ID = 2
BLOCK_IDS = 1 << 16
LEVEL = 3
#: units whose ids a worker remembers, and the longest of them
CACHE_UNITS = 1_600_000
LONGEST_UNIT = 64
#: bytes of texts whose distinct units are looked up together: more texts repeat more units
GATHERED = 4 << 20

CHUNK = (
    "part int, chunk int, n_ids int, width int, kind string, planes array<binary>, "
    "docs array<struct<doc_id:bigint,start:bigint,n:bigint,at:int,size:int>>"
)
CHUNK_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("chunk", pa.int32()),
        ("n_ids", pa.int32()),
        ("width", pa.int32()),
        ("kind", pa.string()),
        ("planes", pa.list_(pa.binary())),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("size", pa.int32())]))),
    ]
)


class Encoder:
    """The tokenizer's ids of whole texts, remembered unit by unit.

    A byte-level BPE's pre-tokens always end before a blank, and before and
    after a line feed, that no white space follows.  Texts are cut there into
    units, a word with the blank or line feed before it, and each distinct unit
    goes through the tokenizer once.  Unknown units go through together, as a
    text of their own, whose ids are dealt back by the bytes that they spell.
    """

    ODD = re.compile(r"[ \n](?:\s|\Z)")
    CUT = re.compile(r"(?=[ \n]\S)")
    OTHER = re.compile(r"[^\S \n]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spelled = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has a character per byte
        for token, i in vocab.items():
            self.spelled[i] = len(token)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.line = len(self.ids("\n")) * self.width
        # units by their word, the blank before it left out; two generations, the older one dropped in time
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def learn(self, new: list[str]) -> None:
        """Put the ids of unknown units among the known."""
        sizes = np.array([u[0] != "\n" for u in new], np.int64) + pc.binary_length(pa.array(new, pa.large_string())).to_numpy()
        for at in range(0, len(new), 256):
            units = new[at : at + 256]
            text = (" " + " ".join(units)).replace(" \n", "\n")  # no unit holds a blank
            if self.OTHER.search(text) or any(a in text for a in self.added):
                # white space inside or after a unit, or an added token: neighbours could matter
                for u in units:
                    self.known[u] = self.ids(u if u[0] == "\n" else " " + u).tobytes()
                continue
            found = self.ids(text)
            borders = np.searchsorted(np.cumsum(self.spelled[found]), np.cumsum(sizes[at : at + 256])) + 1
            data, ends = found.tobytes(), (borders * self.width).tolist()
            self.known.update(zip(units, map(data.__getitem__, map(slice, [0, *ends], ends))))

    def remembered(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units, unknown ones put among the known first."""
        if len(self.known) > CACHE_UNITS // 2:
            self.known, self.older = {}, self.known
        out = list(map(self.known.get, units))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missing:
            ids = self.older.get(units[i])
            if ids is None:
                new.append(units[i])
            else:
                self.known[units[i]] = ids
        self.learn(new)
        for i in missing:
            out[i] = self.known[units[i]]
        for u in new:
            if len(u) > LONGEST_UNIT:
                del self.known[u]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``width`` bytes.

        The units of all texts are numbered by Arrow; each distinct one is
        looked up once, and the texts' ids are taken from those by numbers.
        """
        whole = ["\n" + t for t in texts]
        even = [self.ODD.search(t) is None for t in whole]
        out: list[bytes] = []
        cut = pc.split_pattern(pc.replace_substring(pa.array([t for t, e in zip(whole, even) if e], pa.large_string()), "\n", " \n"), " ")
        # a blank stands before each text's first unit: an empty unit, without ids
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary  # the empty one first; none holds a blank
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), pa.scalar(" ", distinct.type))[0].as_py().split(" ")
        ids = [b"", *self.remembered(names[1:])]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        at = np.cumsum(sizes) - sizes
        number = coded.indices.to_numpy()
        n = sizes[number]
        ends = np.cumsum(n)
        take = np.repeat(at[number] - (ends - n), n)
        take += np.arange(len(take))
        data = np.frombuffer(b"".join(ids), self.type)[take].tobytes()
        edges = np.append(0, ends)[cut.offsets.to_numpy()] * self.width
        spans = zip(edges[:-1].tolist(), edges[1:].tolist())
        for text, e in zip(texts, even):
            if e:
                start, end = next(spans)
                out.append(data[start + self.line : end])
            else:
                out.append(b"".join([self.ids(part).tobytes() for part in self.pieces(text)]))
        return out

    def pieces(self, text: str) -> list[str]:
        """A text with odd white space in pieces of some thousand characters, cut before a blank that a word follows."""
        parts = [p for p in self.CUT.split(text) if p]
        out: list[list[str]] = [[]]
        size = 0
        for p in parts:
            if size > 4096 and p[0] == " ":
                out.append([])
                size = 0
            out[-1].append(p)
            size += len(p)
        return ["".join(x) for x in out]


def to_planes(ids: np.ndarray, kind: str, level: int = LEVEL) -> list[bytes]:
    """Compressed planes of a block of unsigned little-endian ids, most significant first."""
    rows = np.ascontiguousarray(ids.astype(ids.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1), axis=0)
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(np.ascontiguousarray(plane).tobytes()) for plane in rows.T]


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    """The ids (little-endian, ``width`` bytes) of a block."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes], axis=1)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=0, count=n), axis=1)
    return np.ascontiguousarray(rows).view(f">u{width}").reshape(-1).astype(f"<u{width}")


class _Blocks:
    """Cuts a stream of documents into block rows."""

    def __init__(self, part: int, width: int, block: int, kind: str):
        self.part, self.width, self.block, self.kind = part, width, block, kind
        self.data, self.docs, self.at, self.chunk, self.start = bytearray(), [], 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // self.width
        begin, done = self.start, 0
        while done < n:
            size = min(n - done, self.block - self.at)
            self.docs.append({"doc_id": doc_id, "start": begin, "n": n, "at": self.at, "size": size})
            self.data += ids[done * self.width : (done + size) * self.width]
            self.at += size
            done += size
            if self.at == self.block:
                yield self.close()
        self.start += n

    def close(self) -> tuple:
        ids = np.frombuffer(bytes(self.data), f"<u{self.width}")
        row = (self.part, self.chunk, len(ids), self.width, self.kind, to_planes(ids, self.kind), self.docs)
        self.data, self.docs, self.at, self.chunk = bytearray(), [], 0, self.chunk + 1
        return row


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """The two columns of neighbouring batches, as lists, once their bytes come to ``GATHERED``."""
    first, second, size = [], [], 0
    for batch in batches:
        first += batch.column(0).to_pylist()
        second += batch.column(1).to_pylist()
        size += batch.nbytes
        if size >= GATHERED:
            yield first, second
            first, second, size = [], [], 0
    if first:
        yield first, second


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNK_ARROW)], schema=CHUNK_ARROW)


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    block: int = BLOCK_IDS,
    kind: str = "byte",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts and write their ids to ``path`` in ascending order of ``id_col``.

    Null texts are empty and give the end id alone.  Rows without an id come
    first; rows that share one are ordered by a hash of their text.  Other
    columns are not read.
    """
    encoder = lazy(docs.sparkSession, Encoder, tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = made(encoder)
        end = np.array([end_id], e.type).tobytes()
        out = _Blocks(TaskContext.get().partitionId(), e.width, block, kind)
        for doc_ids, texts in gathered(slices(batches)):
            for doc_id, ids in zip(doc_ids, e.encode(texts)):
                for row in out.add(doc_id, ids + end):
                    yield _rows([row])
        if out.at:
            yield _rows([out.close()])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("row")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").transform(batched).mapInArrow(encode, CHUNK).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document of the files; ids are little-endian 32-bit.

    Ids are not shuffled, but for the pieces of documents that lie over a
    block's edge: each row of blocks gets the number of ids before its part
    (one row per part, as many as the write had tasks), and whole documents
    leave the decoder as they are.
    """
    blocks = spark.read.schema(CHUNK).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(parts), "part").select("base", "chunk", "n_ids", "width", "kind", "planes", "docs").transform(batched)

    def decoder(whole: bool):
        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 4):
                rows = []
                for b in batch.to_pylist():
                    ids = from_planes(b["planes"], b["n_ids"], b["width"], b["kind"]).astype("<u4").tobytes()
                    rows += [(b["chunk"], d["doc_id"], b["base"] + d["start"], d["n"], ids[4 * d["at"] : 4 * (d["at"] + d["size"])]) for d in b["docs"]]
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["chunk", "doc_id", "start", "n", "ids"])

        own = F.filter("docs", lambda d: (d["size"] == d["n"]) == F.lit(whole))
        return placed.withColumn("docs", own).where(F.size("docs") > 0).mapInArrow(decode, "chunk int, doc_id long, start long, n long, ids binary")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            ids = [b"".join([piece["ids"] for piece in pieces]) for pieces in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    # no two documents begin at one place: each has its end id
    pieces = decoder(False).groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("pieces"))
    result = "doc_id long, start long, n_tokens long, ids binary"
    joined = pieces.select("doc_id", "start", "n", "pieces").mapInArrow(join, result)
    return decoder(True).select("doc_id", "start", F.col("n").alias("n_tokens"), "ids").unionAll(joined)


def ids_report(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block: int = BLOCK_IDS, kind: str = "byte") -> DataFrame:
    """Write the ids of ``docs``, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/llm-token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id, block, kind)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
