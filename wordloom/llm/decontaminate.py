"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of what they find."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import slices
from .word_hash import Spans

#: Words of the test items that one pass over the documents looks for; more items take more passes.
BLOCK_WORDS = 1_000_000
SHORTEST, LONGEST = 3, 8
#: A seed may be expected by chance at so many of the words of the documents, however many these are.
CHANCE = 1e-8
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.4
SLICE = 6 << 20
FILTER_BITS = 22
_MASK = np.uint64((1 << FILTER_BITS) - 1)


def normal_words(words: pa.Array) -> pa.Array:
    """Lower case, without what is neither letter nor digit."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "")


@dataclass
class Items:
    """One block of test items: their word hashes, end to end."""

    ids: list
    first: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Items:
        spans = Spans(pa.array(texts, pa.large_string()), normal_words)
        return cls(ids, spans.first, spans.hashes)


def word_counts(docs: DataFrame, wanted: np.ndarray) -> tuple[dict[int, int], int]:
    """How often each wanted word hash occurs in all texts, and the number of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(len(wanted), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes = Spans(part.column("text"), normal_words).hashes
                at = np.minimum(np.searchsorted(wanted, hashes), max(0, len(wanted) - 1))
                held += np.bincount(at[wanted[at] == hashes], minlength=len(wanted)) if len(wanted) else 0
                total += len(hashes)
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(held[seen], total))], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return {int(wanted[w]): n for w, n in found.items() if w >= 0}, found.get(-1, 0)


@dataclass
class Seeds:
    """Sorted seed hashes of each length, and (item, word of the item) behind each."""

    hashes: dict[int, np.ndarray]
    items: dict[int, np.ndarray]
    places: dict[int, np.ndarray]

    @classmethod
    def of(cls, items: Items, counts: dict[int, int], total: int) -> Seeds:
        """From each word of an item on, the shortest n-gram that chance would put at less than ``CHANCE`` of the
        documents' words, were these independent. An item without any takes its n-grams of ``LONGEST`` words, or all its
        words if they are fewer, however frequent."""
        log_p = np.array([math.log(max(1, counts.get(int(h), 0)) / max(1, total)) for h in items.hashes])
        sums = np.concatenate(([0.0], np.cumsum(log_p)))
        limit = math.log(CHANCE)
        spans = object.__new__(Spans)
        spans.first, spans.hashes = items.first, items.hashes
        spans._sums, spans._back = _prefix(items.hashes)
        owner = np.repeat(np.arange(len(items.ids)), np.diff(items.first))
        open_, seeded = np.ones(len(items.hashes), bool), np.zeros(len(items.ids), bool)
        chosen = {}
        for n in range(SHORTEST, LONGEST + 1):
            at = spans.starts(n)
            chosen[n] = at[open_[at] & (sums[at + n] - sums[at] <= limit)]
            open_[chosen[n]] = False
            seeded[owner[chosen[n]]] = True
        longest = np.minimum(np.diff(items.first), LONGEST)
        out: dict[int, tuple] = {}
        for n, rare in chosen.items():
            at = spans.starts(n)
            at = np.union1d(rare, at[~seeded[owner[at]] & (longest[owner[at]] == n)])
            h = spans.span(at, n)
            order = np.argsort(h, kind="stable")
            out[n] = h[order], owner[at][order], (at - items.first[owner[at]])[order]
        return cls({n: x[0] for n, x in out.items()}, {n: x[1] for n, x in out.items()}, {n: x[2] for n, x in out.items()})


def _prefix(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from .word_hash import BASE, INVERSE, _powers

    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(BASE, len(hashes)), dtype=np.uint64))), _powers(INVERSE, len(hashes) + 1)


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(score, end in text) of the best local alignment of two hash arrays, with linear gaps.

    One row of the matrix at a time: gaps along the row are a running maximum of score plus gap cost.
    """
    slope = np.arange(len(text)) * -GAP
    row = np.zeros(len(text), np.int64)
    best, end = 0, 0
    for h in item:
        down = np.concatenate(([0], row[:-1])) + np.where(text == h, MATCH, MISMATCH)
        row = np.maximum(0, np.maximum(down, row + GAP))
        row = np.maximum(row, np.maximum.accumulate(row + slope) - slope)
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top + 1
    return best, end


def _clusters(places: list[int], reach: int) -> Iterator[tuple[int, int]]:
    places.sort()
    low = high = places[0]
    for p in places[1:]:
        if p - high > reach:
            yield low, high
            low = p
        high = p
    yield low, high


class Finder:
    """Finds one block of items in slices of texts."""

    def __init__(self, items: Items, seeds: Seeds, least: float):
        self.items, self.seeds, self.least = items, seeds, least
        self.quick = {}
        for n, h in seeds.hashes.items():
            self.quick[n] = np.zeros(1 << FILTER_BITS, bool)
            self.quick[n][(h & _MASK).astype(np.int64)] = True

    def find(self, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score, seeds found, word where the best alignment ends) of every pair that reaches ``least``."""
        spans = Spans(texts, normal_words)
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, table in self.seeds.hashes.items():
            if not len(table):
                continue
            grams = spans.every(n)
            at = np.flatnonzero(self.quick[n][(grams & _MASK).astype(np.int64)])
            low, high = np.searchsorted(table, grams[at], "left"), np.searchsorted(table, grams[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            doc = spans.text_of(at)
            inside = at + n <= spans.first[doc + 1]
            for a, d, lo, hi in zip(at[inside].tolist(), doc[inside].tolist(), low[inside].tolist(), high[inside].tolist()):
                for s in range(lo, hi):
                    hits[d, int(self.seeds.items[n][s])].append(a - int(self.seeds.places[n][s]))
        rows = []
        for (d, i), starts in hits.items():
            item = self.items.hashes[self.items.first[i] : self.items.first[i + 1]]
            best, end = 0.0, 0
            for low, high in _clusters(starts, len(item)):
                a = max(int(spans.first[d]), low - len(item) // 2 - 1)
                b = min(int(spans.first[d + 1]), high + len(item) + len(item) // 2 + 1)
                score, stop = smith_waterman(item, spans.hashes[a:b])
                if score / (MATCH * len(item)) > best:
                    best, end = score / (MATCH * len(item)), a + stop - int(spans.first[d])
            if best >= self.least:
                rows.append((d, i, best, len(starts), end))
        return rows


def _finders(docs: DataFrame, tests: DataFrame, least: float) -> Iterator[Finder]:
    """docs with a column text, tests (item_id, text): one finder for each block of items."""
    tests = tests.where(F.col("text").isNotNull())
    words = tests.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-words // BLOCK_WORDS))
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items.of([r["item_id"] for r in rows], [r["text"] for r in rows])
        counts, total = word_counts(docs, np.unique(items.hashes))
        yield Finder(items, Seeds.of(items, counts, total), least)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """Documents that hold a test item, whole or edited: (id, item id, score, n_seeds, word_end), one row for each pair.

    score is the best local alignment of the item's words, case and punctuation aside, in the whole
    document, as a share of a full match; pairs below ``least`` are left out. Word frequencies, which
    decide the seeds, cover all documents. Items without a rare n-gram of 3 to 8 words are looked for by
    their frequent ones of 8, or whole if shorter; items of fewer than 3 words, and null or empty items and texts, find nothing. Repeated document rows come out once each, null
    ids are kept, a repeated item id may come out twice. Empty tables give an empty result; other
    columns are not read.

    Two scans of the documents for each ``BLOCK_WORDS`` words of items, without any shuffle but counts:
    what goes to the executors is a block of items, whose size that limit bounds.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tests = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    kind = T.StructType([base.schema["id"], T.StructField("item_id", tests.schema["item_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_seeds", T.LongType()), T.StructField("word_end", T.LongType())])
    out = None
    for finder in _finders(base, tests, least):
        pairs = base.mapInArrow(_pairs_of(finder, kind), kind)
        out = pairs if out is None else out.unionByName(pairs)
    return out.withColumnsRenamed({"id": id_col, "item_id": item_col})


def _pairs_of(finder: Finder, kind: T.StructType):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = finder.find(part.column("text"))
                if rows:
                    doc, item, score, seeds, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), pa.array([finder.items.ids[i] for i in item]), pa.array(score, pa.float64()), pa.array(seeds, pa.int64()), pa.array(end, pa.int64())], kind.names)

    return pairs


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows that hold a test item, all columns kept; what holds for ``contaminated`` holds here."""
    tests = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    out = docs
    for finder in _finders(docs.select(F.col(text_col).alias("text")), tests, least):
        out = out.mapInArrow(_clean_of(finder, text_col), docs.schema)
    return out


def _clean_of(finder: Finder, text_col: str):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                kept = np.ones(part.num_rows, bool)
                kept[[row[0] for row in finder.find(part.column(text_col))]] = False
                yield part.filter(pa.array(kept))

    return clean
