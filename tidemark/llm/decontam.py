"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton's alphabet is the benchmark's vocabulary: its patterns are the
windows of normalised item words, and each text is scanned once, word by word.
Hits are mapped back to code point offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batched, lazy, made, slices, stored, utf8

WINDOW = 10
#: benchmark text that one automaton holds; a larger benchmark takes several scans
BLOCK_BYTES = 8 << 20
#: normalisation: A-Z to a-z; digits, a-z and all beyond ASCII stay; the rest separates
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = "struct<n_words:bigint,items:array<string>,word_runs:array<struct<start:bigint,end:bigint>>,spans:array<struct<start:bigint,end:bigint>>>"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT_ARROW = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("word_runs", RUNS), ("spans", RUNS)])


def words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def item_windows(text: bytes | None, window: int) -> set[tuple[bytes, ...]]:
    """All runs of ``window`` words; a shorter item that has words is one window."""
    w = words(text)
    return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


class Windows:
    """The automaton over the windows of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for w in item_windows(text, window):
                key = tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in w)
                owners.setdefault(key, set()).update(() if item is None else (item,))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in owners.items():
            self.automaton.add_word(key, (len(key), tuple(own)))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def find(self, w: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal runs of hit words, and the items whose windows occur."""
        runs: list[list[int]] = []
        items: set[str] = set()
        if self.any and w:
            ids = self.ids.get
            for last, (size, own) in self.automaton.iter(tuple([ids(x, 0) for x in w])):
                items.update(own)
                start = last + 1 - size
                while runs and runs[-1][1] >= start:  # a longer window may end later and begin earlier
                    start = min(start, runs.pop()[0])
                runs.append([start, last + 1])
        return runs, items


def merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def char_spans(text: str, runs: list[list[int]]) -> list[list[int]]:
    """Offsets in the original text of runs of its normalised words."""
    if not runs:
        return []
    out, k = [], 0
    for n, m in enumerate(WORD.finditer(text)):
        if n == runs[k][0]:
            start = m.start()
        if n == runs[k][1] - 1:
            out.append([start, m.end()])
            k += 1
            if k == len(runs):
                break
    return out


def _scan(docs: DataFrame, block: DataFrame, window: int, text_col: str, out_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = [(r.item, r.text.encode()) for r in block.toLocalIterator()]
    index = lazy(spark, Windows, rows, window)
    names = docs.columns
    earlier = out_col in names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = made(index).find
        for batch in slices(batches):
            n_words, found = [], []
            texts = utf8(batch.column(names.index(text_col)))
            before = batch.column(names.index(out_col)).to_pylist() if earlier else [None] * len(texts)
            for text, old in zip(texts, before):
                w = words(text)
                runs, items = find(w)
                if old:
                    items |= set(old["items"])
                    runs = merged(runs + [[r["start"], r["end"]] for r in old["word_runs"]])
                pairs = [{"start": a, "end": b} for a, b in runs]
                spans = [{"start": a, "end": b} for a, b in char_spans(text.decode(), runs)] if runs else []
                found.append({"n_words": len(w), "items": sorted(items), "word_runs": pairs, "spans": spans})
            columns = [c for n, c in zip(names, batch.columns) if n != out_col]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, RESULT_ARROW)], names=[str(i) for i in range(len(columns) + 1)]
            )

    kept = [c for c in names if c != out_col]
    # positional names: the columns of docs may hold any name
    schema = ", ".join(f"`{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    out = docs.transform(batched).mapInArrow(scan, f"{schema}, `{len(kept)}` {RESULT}")
    return out.toDF(*kept, out_col)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "item_id",
    text_col: str = "text",
    out_col: str = "contamination",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct: n_words, items, word_runs and spans (code points) hit by benchmark windows.

    ``out_col`` must not be a column of ``docs``.  The benchmark is read whole:
    its items are dealt into blocks of about ``block_bytes`` by a hash and the
    texts are scanned once for each block (one for all usual benchmarks), so
    the broadcast automaton stays bounded.  Null texts have no words; an item
    without an id hits words but is no item of the list; repeated ids are one
    item.
    """
    if out_col in docs.columns:
        raise ValueError(f"docs has a column {out_col}")
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        # by the text: of equal texts any block finds the same words, under all their ids
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) if blocks > 1 else items
        docs = _scan(docs, block, window, text_col, out_col)
        if k < blocks - 1:
            docs = stored(docs, "scanned")
    return docs


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    c = find_contamination(narrow, benchmark, window)
    hit = F.aggregate("contamination.word_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return c.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("contamination.items")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, with all their columns."""
    name = "contamination"
    while name in docs.columns:
        name += "_"
    found = find_contamination(docs, benchmark, window, out_col=name)
    return found.where(F.size(F.col(name)["word_runs"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


#: the report in DuckDB SQL, windows of each length that items have
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bp),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n),
h AS (SELECT dp.doc_id, dp.i, dp.n, bw.item_id FROM dp JOIN bw ON bw.n = dp.n AND bw.s = array_to_string(dp.w[dp.i:dp.i + dp.n - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
