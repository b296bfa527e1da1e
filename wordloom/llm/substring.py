"""Substring dedup: repeated word spans by a compacted De Bruijn graph.

Edges of the graph are windows of ``window`` consecutive words (token k-mers, between nodes of one
word less). The graph is never written out edge by edge:

1. Every window belongs to the anchor that its least ``ANCHOR`` word hash marks, so equal windows have
   equal anchors, and consecutive windows of a text with one anchor form a path. A task writes paths,
   about one for every fourteen windows.
2. Paths meet at their anchor. If all paths at a repeated anchor are equal, none branches: they compact
   into one path whose every window repeats, and a join on the anchor finds its occurrences.
3. At an anchor where paths differ the graph branches. Equal paths compact first, by a join on anchor
   and path; one of each kind is opened into its windows, at its source coordinates, and a window that
   lies in two kinds repeats.
   Paths and windows are equal only if digests of the source words at their coordinates are, too.
4. The coordinates of all repeated windows are gathered per document and joined to the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .skew import join_keys
from .tokens import ragged, slices, split_words
from .word_hash import Spans

WINDOW = 35
#: Words of an anchor; windows shorter than this cannot be asked for.
ANCHOR = 8
SLICE = 6 << 20

_LONG = T.LongType()


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _LONG) for n in names]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


@dataclass(frozen=True)
class Keyed:
    """Documents as (id, th, text): th, a hash of the text, tells rows apart that share an id."""

    frame: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> Keyed:
        """With ``carry``, a struct row holds the columns of the input by their places, but for the text, and missing
        tells whether that is null."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        fields = [F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]]
        whole = [F.struct(*fields).alias("row"), F.col(text_col).isNull().alias("missing")] if carry else []
        return cls(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), *whole))


def _digests(words: pa.Array, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest of the letters of each range of words, beside their span hashes, which tell where words end."""
    _, offsets, letters = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset :]
    raw = memoryview(letters)
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at[begin].tolist(), at[end].tolist())), np.uint64, len(begin))


def anchored_paths(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, path, source, id, th, start, windows) of (id, th, text); source is a digest of the words at the path's coordinates."""
    kind = T.StructType([*_fields("anchor", "path", "source"), docs.schema["id"], *_fields("th", "start", "windows")])
    width = window - ANCHOR + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                spans = Spans(part.column("text"))
                at = spans.starts(window)
                if not len(at):
                    continue
                marks = spans.every(ANCHOR)
                least = np.lib.stride_tricks.sliding_window_view(marks, width).argmin(axis=1)
                anchor = at + least[at]
                head = np.flatnonzero(np.concatenate(([True], np.diff(anchor) != 0)))
                count = np.diff(np.append(head, len(at)))
                start = at[head]
                doc = spans.text_of(start)
                yield pa.RecordBatch.from_arrays([_signed(marks[anchor[head]]), _signed(spans.span(start, count + window - 1)), _signed(_digests(spans.words, start, start + count + window - 1)), part.column("id").take(pa.array(doc)), part.column("th").take(pa.array(doc)), pa.array(start - spans.first[doc]), pa.array(count)], kind.names)

    return docs.mapInArrow(find, kind)


def _opened(kinds: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(anchor, hash, source, id, th, start, times) of each window of the given paths, read off the texts at their coordinates."""
    per_doc = kinds.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "start", "windows", "times")).alias("paths"))
    joined = _with_docs(docs, per_doc, "paths", "inner")
    kind = T.StructType([*_fields("anchor", "hash", "source"), docs.schema["id"], *_fields("th", "start", "times")])

    def open_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                spans = Spans(part.column("text"))
                lists = part.column("paths")
                flat = lists.flatten()
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                anchor, start, count, times = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                which = np.repeat(np.arange(len(doc)), count)
                inside = ragged(start, count).astype(np.int64)
                doc = doc[which]
                at = spans.first[doc] + inside
                yield pa.RecordBatch.from_arrays([pa.array(anchor[which]), _signed(spans.span(at, window)), _signed(_digests(spans.words, at, at + window)), part.column("id").take(pa.array(doc)), part.column("th").take(pa.array(doc)), pa.array(inside), pa.array(times[which])], kind.names)

    return joined.mapInArrow(open_paths, kind)


def _with_docs(docs: DataFrame, extra: DataFrame, column: str, how: str) -> DataFrame:
    d, e = docs.alias("d"), extra.alias("e")
    return d.join(e, F.col("d.id").eqNullSafe(F.col("e.id")) & (F.col("d.th") == F.col("e.th")), how).select("d.*", f"e.{column}")


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(id, th, runs): per distinct row its runs of windows, (start, windows), whose word sequence starts anywhere else
    too; runs may overlap. Rows that repeat have the same runs, which are gathered once."""
    paths = scratch.keep(anchored_paths(docs, window), "paths")
    anchors = scratch.keep(paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), ((F.min("path") != F.max("path")) | (F.min("source") != F.max("source"))).alias("branches")).where("n > 1"), "anchors")
    repeated = scratch.keep(join_keys(paths, anchors, ["anchor"], "n").drop("n"), "repeated")
    scratch.drop("paths", "anchors")
    plain = repeated.where(~F.col("branches")).select("id", "th", "start", "windows")
    branching = repeated.where("branches").drop("branches")
    path, edge = ["anchor", "path", "source"], ["anchor", "hash", "source"]
    kinds = branching.groupBy(*path).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "th", "start", "windows")).alias("one")).select(*path, "times", "one.*")
    kinds = scratch.keep(kinds, "kinds")
    equal = join_keys(branching, kinds.where("times > 1").select(*path, "times"), path, "times").select("id", "th", "start", "windows")
    opened = scratch.keep(_opened(kinds, docs, window), "opened")
    shared = scratch.keep(opened.groupBy(*edge).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    single = join_keys(opened.where("times = 1"), shared, edge, "n").select("id", "th", "start", F.lit(1).cast("long").alias("windows"))
    runs = plain.unionByName(equal).unionByName(single).groupBy("id", "th").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    return scratch.result(runs, "substring-runs")


def _covered(first: np.ndarray, n: int, lists: pa.Array, window: int) -> np.ndarray:
    """Which of n words the runs of windows of each text cover."""
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    edge = np.zeros(n + 1, np.int64)
    if len(doc):
        begin = first[doc] + flat.field(0).to_numpy(zero_copy_only=False)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + flat.field(1).to_numpy(zero_copy_only=False) + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


class _Cut:
    """What the runs of a batch of texts leave: gone by word, first word of each text, and the kept texts."""

    def __init__(self, part: pa.RecordBatch, window: int):
        self.first, words = split_words(part.column("text"))
        self.gone = _covered(self.first, len(words), part.column("runs"), window)
        kept_before = np.concatenate(([0], np.cumsum(~self.gone)))[self.first]
        kept = pa.ListArray.from_arrays(pa.array(kept_before.astype(np.int32)), words.filter(pa.array(~self.gone)))
        self.texts = pc.binary_join(kept, pa.scalar(" ", pa.large_string()))
        self.n_words, self.n_kept = np.diff(self.first), np.diff(kept_before)

    def spans(self) -> pa.Array:
        """(start, length) of what went, in order, for each text."""
        step = np.zeros(len(self.gone) + 1, bool)
        step[self.first[:-1]] = True  # a span ends with its text
        begins = np.flatnonzero(self.gone & (step[:-1] | ~np.concatenate(([False], self.gone[:-1]))))
        stops = np.flatnonzero(self.gone & (np.append(step[1:-1], True)[: len(self.gone)] | ~np.concatenate((self.gone[1:], [False])))) + 1 if len(self.gone) else begins
        owner = np.searchsorted(self.first, begins, side="right") - 1
        counts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(self.n_words)))))
        parts = pa.StructArray.from_arrays([pa.array(begins - self.first[owner]), pa.array(stops - begins)], ["start", "length"])
        return pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), parts)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Remove every word that a repeated window covers, windows being judged on the input.

    Columns: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and with
    ``keep_text`` th (a hash of the input text), kept_text and spans (start and length of what went).
    Null and empty texts have no words. Rows that repeat, with or without their id, repeat each
    other's windows, so their text goes; null ids are kept. Empty input gives an empty result; other
    columns are not read. Texts of any length are handled whole. Windows are told apart by
    the hashes of their anchor and of their words, and by a digest of the source at their coordinates, 64 bits each.

    Exchanges: paths on their anchor (partial counts first; hot anchors go to their paths instead), texts
    twice on the document key. A hot passage adds a row per document, and its windows are opened once.
    Intermediate tables go as soon as the runs, which the result reads, are written.
    """
    if window <= ANCHOR:
        raise ValueError(f"a window has more than {ANCHOR} words")
    scratch = Scratch(docs.sparkSession, "substring")
    keyed = Keyed.of(docs, id_col, text_col).frame
    runs = repeated_windows(keyed, scratch, window)
    kind = T.StructType([keyed.schema["id"], *_fields("n_words", "n_removed"), T.StructField("kept_sha256", T.StringType())])
    if keep_text:
        span = T.ArrayType(T.StructType(_fields("start", "length")))
        kind = T.StructType([*kind.fields, *_fields("th"), T.StructField("kept_text", T.StringType()), T.StructField("spans", span)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = _Cut(part, window)
                digests = [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in found.texts.cast(pa.large_binary())]
                columns = [part.column("id"), pa.array(found.n_words), pa.array(found.n_words - found.n_kept), pa.array(digests)]
                if keep_text:
                    columns += [part.column("th"), found.texts.cast(pa.string()), found.spans()]
                yield pa.RecordBatch.from_arrays(columns, kind.names)

    return _with_docs(keyed, runs, "runs", "left").mapInArrow(cut, kind).withColumnRenamed("id", id_col)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the words of repeated windows cut out of the text, all rows and columns kept.

    A text that loses nothing is left as it is, nulls too; of others the kept words are joined by one
    space, and where a column n_chars goes with the text it is counted again. Other columns may have any
    names. What holds for ``remove_repeats`` of empty tables, null ids, repeated rows and long texts holds here.
    """
    runs = repeated_windows(Keyed.of(docs, id_col, text_col).frame, Scratch(docs.sparkSession, "substring"), window)
    joined = _with_docs(Keyed.of(docs, id_col, text_col, carry=True).frame, runs, "runs", "left")
    kind = T.StructType([joined.schema["row"], joined.schema["missing"], T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = _Cut(part, window)
                whole = pa.array(found.n_kept == found.n_words)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("missing"), pc.if_else(whole, part.column("text").cast(pa.string()), found.texts.cast(pa.string()))], kind.names)

    out = joined.mapInArrow(cut, kind)
    text = F.when(~F.col("missing"), F.col("text"))
    place = {c: F.col("row").getField(f"c{i}") for i, c in enumerate(docs.columns)}
    if "n_chars" in place and text_col == "text":
        place["n_chars"] = F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), place["n_chars"])
    return out.select(*[(text if c == text_col else place[c]).alias(c) for c in docs.columns])
