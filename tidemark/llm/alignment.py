"""Alignment of two tokenizers' tokens on the bytes of the texts.

A byte-level BPE of the tokenizers library (A) reads a blank and the text, a
SentencePiece model (B) the text, to which it adds the blank itself; so both
spell the same bytes.  The libraries' own spans, character offsets for A and
the proto's byte spans for B, are the coarse cuts; tokens that share a
character with their neighbour, and byte-fallback tokens, are cut within it by
the bytes that they decode to.  Offsets where tokens of both end cut them into
groups; tokens of A and B whose bytes overlap are linked.

No token of either crosses from a character that is no white space to a blank
or a line feed (B: its vocabulary is looked through for that, else whole texts
are units), so texts are cut there into units and each distinct unit is aligned
once per worker, for as long as its caches keep it.

Link counts over all texts: tasks write blocks of documents with their links,
and a dictionary of the distinct links of each block, with counts.  Only the
dictionaries are grouped and joined by link, so a link that is in every
document is one row per block there, and comes back to its block by number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batched, lazy, made, slices, stored, text_or_empty

MARK = "\u2581"
#: fixed values: white space of any of the libraries
BLANKS = "\\s\x1c-\x1f\x85\u180e\u200b\ufeff"
#: units that a worker remembers, in two generations, and the longest of them
CACHE_UNITS = 600_000
LONGEST_UNIT = 64
#: marks that are looked for at the end of units
MARKS = ".,;:!?"
#: unknown units that go through the libraries at a time
TOGETHER = 256
#: links of the documents of a block, counted once per document
BLOCK_LINKS = 1 << 20


def byte_values() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for.

    Printable Latin-1 characters stand for themselves, the other bytes in
    ascending order for the characters from U+0100 on.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Aligner:
    """Groups and links of whole texts."""

    CUT = re.compile(f"(?<=[^{BLANKS}])(?=\n| [^{BLANKS}])")
    INNER = re.compile(f"(?: [^{BLANKS}]|\n)(?:.*[^{BLANKS}])?\\Z", re.DOTALL)

    def __init__(self, tokenizer: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizer)
        self.a.encode_special_tokens = True
        values = byte_values()  # of the entries' characters
        self.a_bytes = {i: bytes(map(values.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if byte else p.replace(MARK, " ").encode() for p, byte in zip(pieces, self.is_byte.tolist())]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(t) for t in self.a_bytes.values()]
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.mark_id = self.b.piece_to_id(MARK)
        self.apart = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.marks = self.lone_marks(pieces) if self.apart else {}
        # unit -> (groups, links, ids of A), None where the bytes differ
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def lone_marks(self, pieces: list[str]) -> dict[str, tuple[str, bytes]]:
        """Marks after an ASCII letter that both sides keep apart from it: their group and link.

        A's splitting pattern does so always; of B, no piece may hold a letter
        and the mark.
        """
        out = {}
        for mark in MARKS:
            if any(re.search(f"[A-Za-z]{re.escape(mark)}", p) for p in pieces):
                continue
            a, b = self.a_spans(f" x{mark}", f" x{mark}".encode()), self.b_spans(f" x{mark}", f" x{mark}".encode())
            if a and b and a[1].tolist() == b[1].tolist() == [2, 3]:
                a_id, b_id = int(a[0][1]), int(b[0][1])
                out[mark] = (f";{a_id}|{b_id}", np.array([a_id << 32 | b_id], "<i8").tobytes())
        return out

    # ---- spans

    @staticmethod
    def refined(coarse: np.ndarray, sure: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Byte ends: a library's own where they are sure, from there on by the tokens' decoded bytes."""
        done = np.cumsum(sizes)
        at = np.where(sure, np.arange(len(coarse)), -1)
        last = np.maximum.accumulate(at)  # the last sure cut so far
        ends = np.where(last >= 0, coarse[last] + done - done[last], done)
        # a span that the decoded bytes contradict
        return ends if np.array_equal(ends, done) else done

    def a_spans(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and the byte at which each ends; None where they do not spell ``data``."""
        found = self.a.encode(text, add_special_tokens=False)
        ids, spans = found.ids, np.fromiter(chain.from_iterable(found.offsets), np.int64).reshape(-1, 2)
        if not ids or b"".join(map(self.a_bytes.__getitem__, ids)) != data:
            return None
        ids = np.array(ids, np.int64)
        coarse = spans[:, 1]
        if len(text) != len(data):
            coarse = np.concatenate([[0], np.cumsum([len(c.encode("utf-8")) for c in text])])[coarse]
        # a token that shares a character with the next one ends inside it
        sure = np.append(spans[1:, 0] >= spans[:-1, 1], True)
        return ids, self.refined(coarse, sure, self.a_sizes[ids])

    def b_spans(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of B and the byte of ``text`` at which each ends; None where they do not spell ``data``."""
        blank = text[0] == " "  # the one that B adds; without it, B's mark is no part of the text
        pieces = [(p.id, p.end) for p in self.b.encode(text[blank:], return_type="proto").pieces]
        if not blank and (not pieces or pieces.pop(0)[0] != self.mark_id):
            return None
        if not pieces:
            return None
        ids, coarse = zip(*pieces)
        if b"".join(map(self.b_bytes.__getitem__, ids)) != data:
            return None
        ids = np.array(ids, np.int64)
        return ids, self.refined(np.array(coarse, np.int64) + blank, ~self.is_byte[ids], self.b_sizes[ids])

    def align(self, units: list[str]) -> list[tuple] | None:
        """(groups as text, links as packed pairs of ids, number of A's ids) of units that follow one another; None where bytes differ."""
        text = "".join(units)
        data = text.encode("utf-8")
        a, b = self.a_spans(text, data), self.b_spans(text, data)
        if a is None or b is None:
            return None
        (a_ids, a_ends), (b_ids, b_ends) = a, b
        # between two neighbouring ends lies one token of either side: a link
        ends = np.union1d(a_ends, b_ends)
        links = (a_ids[np.searchsorted(a_ends, ends)] << 32 | b_ids[np.searchsorted(b_ends, ends)]).astype("<i8").tobytes()
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_to, b_to = np.searchsorted(a_ends, common) + 1, np.searchsorted(b_ends, common) + 1
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        groups, i, k = [], 0, 0
        for j, n in zip(a_to.tolist(), b_to.tolist()):
            groups.append((a_text[i] if j == i + 1 else ",".join(a_text[i:j])) + "|" + (b_text[k] if n == k + 1 else ",".join(b_text[k:n])))
            i, k = j, n
        borders = np.cumsum([len(u) for u in units] if len(text) == len(data) else [len(u.encode("utf-8")) for u in units])
        group_to = np.searchsorted(common, borders) + 1
        if not np.array_equal(common[group_to - 1], borders):
            return None
        link_to = (np.searchsorted(ends, borders) + 1) * 8
        counts = np.diff(a_to[group_to - 1], prepend=0)
        out, g, at = [], 0, 0
        for g_to, to, n_a in zip(group_to.tolist(), link_to.tolist(), counts.tolist()):
            out.append((";".join(groups[g:g_to]), links[at:to], n_a))
            g, at = g_to, to
        return out

    # ---- whole texts

    def units(self, text: str) -> list[str]:
        whole = " " + text
        return self.CUT.split(whole) if self.apart else [whole]

    def learn(self, new: list[str]) -> None:
        """Align unknown units, many at a time where one may follow another.

        Those end without white space and begin as units inside a text do.
        """
        plain = [u for u in new if self.INNER.match(u) and MARK not in u] if self.apart else []
        # ended by a mark that is a token of its own in both: aligned without it
        ended = [u for u in plain if u[-1] in self.marks and u[-2].isascii() and u[-2].isalpha()]
        if ended:
            plain = list(set(plain).difference(ended).union(u[:-1] for u in ended).difference(self.known))
        # B adds a blank to the first one, so that begins with one; characters of several bytes come last
        plain.sort(key=lambda u: (u[0] != " ", not u.isascii()))
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            found = self.align(some)
            if found:
                self.known.update(zip(some, found))
        for u in ended:
            stem = self.known.get(u[:-1])
            if stem:
                groups, link = self.marks[u[-1]]
                self.known[u] = (stem[0] + groups, stem[1] + link, stem[2] + 1)
        for u in new:
            if u not in self.known:
                found = self.align([u])
                self.known[u] = found[0] if found else None

    def lines(self, texts: list[str]) -> list[tuple | None]:
        """(groups, links, how many groups, ids of A, ids of B) of each text; None for empty texts and where bytes differ."""
        if len(self.known) > CACHE_UNITS // 2:
            self.known, self.older = {}, self.known
        cut = [self.units(t) if t else [] for t in texts]
        known, new = self.known, []
        for u in set().union(*cut) - known.keys():
            if u in self.older:
                known[u] = self.older[u]
            else:
                new.append(u)
        self.learn(new)
        out = []
        for units in cut:
            found = [known[u] for u in units]
            if not found or None in found:
                out.append(None)
            else:
                groups, links, a = zip(*found)
                text, packed, n_a = ";".join(groups), b"".join(links), sum(a)
                # ends of either side that are not common make one link more than there are groups
                n_groups = text.count(";") + 1
                out.append((text, packed, n_groups, n_a, len(packed) // 8 + n_groups - n_a))
        for u in new:
            if len(u) > LONGEST_UNIT:
                del known[u]
        return out


ROW = {
    "block": pa.int64(),
    "doc": pa.bool_(),
    "doc_id": pa.int64(),
    "n_a": pa.int64(),
    "n_b": pa.int64(),
    "n_groups": pa.int64(),
    "n_links": pa.int64(),
    "groups": pa.string(),
    "links": pa.list_(pa.int64()),
    "places": pa.binary(),
    "times": pa.list_(pa.int64()),
}
SCHEMA = (
    "block long, doc boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups string, links array<long>, places binary, times array<long>"
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(ROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROW.values())], names=list(ROW))


def blocks(docs: DataFrame, tokenizer: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents and dictionaries, in blocks of about ``BLOCK_LINKS`` links.

    doc: true for a document: its number of ids, groups and links, its groups
    (``a1,a2|b1;a3|b2,b3``), and as ``places`` pairs of 32-bit integers, the
    place of each of its distinct links in the dictionary and how often it has
    it.  False for the one row of a block that is its dictionary: the distinct
    ``links`` (A's id times 2^32 and B's) and how often the block has each.
    """
    aligner = lazy(docs.sparkSession, Aligner, tokenizer, model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        kept: list[tuple] = []  # documents of the block: columns, distinct links, their times
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            if not kept:
                return
            lengths = [len(x) for _, x, _ in kept]
            links, places = np.unique(np.concatenate([x for _, x, _ in kept]), return_inverse=True)
            times = np.concatenate([t for _, _, t in kept])
            total = np.bincount(places, times, len(links)).astype(np.int64)
            pairs = np.stack([places, times], axis=1).astype("<i4")
            at, rows = 0, []
            for (columns, _, _), n in zip(kept, lengths):
                rows.append((number, True, *columns, None, pairs[at : at + n].tobytes(), None))
                at += n
            for k in range(0, len(rows), 1024):
                yield _batch(rows[k : k + 1024])
            yield _batch([(number, False, None, None, None, None, None, None, links, None, total)])

        for batch in slices(batches):
            for doc_id, line in zip(batch.column(0).to_pylist(), made(aligner).lines(batch.column(1).to_pylist())):
                groups, found, n_groups, a, b = line or (None, b"", 0, 0, 0)
                links, times = np.unique(np.frombuffer(found, "<i8"), return_counts=True)
                kept.append(((doc_id, a, b, n_groups, len(found) // 8, groups), links, times))
                size += len(links) + (len(groups) if groups else 0) // 16
            if size >= BLOCK_LINKS:
                yield from close()
                number, kept, size = number + 1, [], 0
        yield from close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.transform(batched).mapInArrow(make, SCHEMA)


def align_tokens(docs: DataFrame, tokenizer: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups): the alignment of each row's whole text.

    groups: ``a1,a2|b1;a3|b2,b3``, the ids of both sides in order, None for
    texts without tokens: null and empty ones, and those that either side does
    not spell byte for byte.
    """
    return blocks(docs, tokenizer, model, id_col, text_col).where("doc").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def link_counts(rows: DataFrame) -> DataFrame:
    """(link, a, b, count, best): how many links of all texts hold each pair of ids, and whether no pair of B's id is held by more."""
    counts = (
        rows.where("NOT doc")
        .select(F.explode(F.arrays_zip("links", "times")).alias("x"))
        .groupBy(F.col("x.links").alias("link"))
        .agg(F.sum("x.times").alias("count"))
        .withColumn("b", F.col("link").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    )
    # at most a row per id of B's vocabulary
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("link", F.shiftright("link", 32).cast("int").alias("a"), "b", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame) -> DataFrame:
    """The documents of ``blocks``, stored before, with n_best and count_sum over their links."""
    counts = link_counts(rows).select("link", "count", "best")
    numbered = rows.where("NOT doc").select(F.col("block").alias("of_block"), F.posexplode("links").alias("place", "link"))
    dictionary = numbered.join(counts, "link").select("of_block", "place", "count", "best")
    documents = rows.where("doc").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "places")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def add(own: pa.Table, counted: pa.Table) -> pa.Table:
        count = np.zeros(counted.num_rows, np.int64)
        best = np.zeros(counted.num_rows, bool)
        place = counted.column("place").to_numpy()
        count[place], best[place] = counted.column("count").to_numpy(), counted.column("best").to_numpy()
        data = [x.as_py() for x in own.column("places")]
        pairs = np.frombuffer(b"".join(data), "<i4").reshape(-1, 2)
        ends = np.cumsum([0, *(len(x) // 8 for x in data)])
        # running sums of whole numbers: each document's are a difference
        run = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        n_best, total = run(pairs[:, 1] * best[pairs[:, 0]]), run(pairs[:, 1] * count[pairs[:, 0]])
        sums = [pa.array(x[ends[1:]] - x[ends[:-1]], pa.int64()) for x in (n_best, total)]
        return pa.Table.from_arrays([*(own.column(c) for c in names), *sums], names=[*names, "n_best", "count_sum"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return documents.groupBy("block").cogroup(dictionary.groupBy("of_block")).applyInArrow(add, schema)


def alignment_report(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts without tokens (null, empty, or not spelled byte for byte by both
    sides) have zeros and an empty groups_sha256.  Rows that repeat a doc_id or
    have none keep a row each, and their links count each time; an empty table
    gives an empty one.  Other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as a, open(model, "rb") as b:
        rows = blocks(docs, a.read(), b.read())
    # digests in place of the groups before the blocks are written
    digest = F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.when(F.col("doc"), F.lit("")))
    rows = stored(rows.withColumn("groups", digest), "alignment")
    return with_counts(rows).withColumnRenamed("groups", "groups_sha256")
