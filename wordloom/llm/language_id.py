"""Language identification by interpolated Kneser-Ney character models, one for each language.

A model predicts each letter of a word, and its end, from the ``ORDER`` - 1 characters before it inside
the word. Counts of the longest n-grams are gathered from every training text; the shorter orders hold
Kneser-Ney continuation counts, and below the shortest lies one uniform share, the same for all languages,
over the letters of all of them and one for any other letter. An n-gram is counted as its whole code points.

Models are fitted by grouped aggregations and written as sorted arrays of 64-bit hashes in a folder that all
executors share: a hash's highest bits name its part, and all languages stand in the same arrays, so an n-gram is
looked up once for all of them. Tasks map the files into memory; the driver and the tasks' functions hold only their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import Scratch
from .tokens import ragged, slices, split_words
from .toxicity import learned_from
from .word_hash import mix

ORDER = 5
#: Bits of a code point. Of an n-gram's characters the last three stand in one integer, the others in a second.
BITS, LOW = 21, 3
LETTER = (1 << BITS) - 1
#: One in so many training texts sets the limits of rejection and is not counted.
HELD_BACK = 16
#: Highest bits of a hash that name its part.
PART_BITS = 5
#: Letters beyond which a text counts as no surer.
SURE_LETTERS = 20
UNKNOWN = "und"
SLICE = 2 << 20


def letters_only(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", "")


@dataclass
class Grams:
    """N-grams by their characters: low holds the last three, high those before; 0 pads before a word, 1 ends it."""

    high: np.ndarray
    low: np.ndarray

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, which: np.ndarray) -> Grams:
        return Grams(self.high[which], self.low[which])

    def last(self, n: int) -> Grams:
        """Their last n characters."""
        if n <= LOW:
            return Grams(np.zeros_like(self.high), self.low & ((1 << BITS * n) - 1))
        return Grams(self.high & ((1 << BITS * (n - LOW)) - 1), self.low)

    def context(self, n: int) -> Grams:
        """What stands before the last character of n-grams."""
        return Grams(self.high >> BITS, (self.low >> BITS) | ((self.high & LETTER) << (2 * BITS))).last(n - 1)

    def keys(self) -> np.ndarray:
        return mix(self.low.astype(np.uint64) ^ mix(self.high.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _ngrams(words: list[str]) -> tuple[np.ndarray, Grams]:
    """(first n-gram of each word and the end, n-grams): one for each letter and one for the end of a word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(size + 1)))
    chars = np.ones(int(bounds[-1]), np.int64)
    inside = np.ones(len(chars), bool)
    inside[bounds[1:] - 1] = False
    chars[inside] = np.maximum(points, 2)
    place = np.arange(len(chars)) - np.repeat(bounds[:-1], size + 1)
    halves = [np.zeros(len(chars), np.int64), chars.copy()]
    for back in range(1, ORDER):
        shifted = np.concatenate((np.zeros(min(back, len(chars)), np.int64), chars[: max(0, len(chars) - back)]))
        halves[back < LOW] |= np.where(place >= back, shifted, 0) << (BITS * (back % LOW))
    return bounds, Grams(*halves)


class _Words:
    """Distinct words of a slice of texts, letters only, and where they stand."""

    def __init__(self, texts: pa.Array):
        self.first, flat = split_words(texts)
        coded = flat.dictionary_encode()
        normal = letters_only(coded.dictionary).dictionary_encode()
        self.words = normal.dictionary.to_pylist()
        self.which = normal.indices.to_numpy()[coded.indices.to_numpy()] if len(flat) else np.empty(0, np.int64)
        self.full = np.fromiter(map(bool, self.words), bool, len(self.words))


@dataclass
class _Counts:
    """Counts of n-grams that grow: new ones are kept apart until there are as many as there are old ones."""

    grams: Grams
    n: np.ndarray
    waiting: list[tuple[Grams, np.ndarray]]
    held: int = 0

    def add(self, grams: Grams, n: np.ndarray) -> None:
        self.waiting.append((grams, n))
        self.held += len(n)
        if self.held > max(len(self.n), 1 << 18):
            self.settle()

    def settle(self) -> None:
        parts = [(self.grams, self.n), *self.waiting]
        self.grams, self.n = summed(Grams(*[np.concatenate([getattr(g, c) for g, _ in parts]) for c in ("high", "low")]), np.concatenate([n for _, n in parts]))
        self.waiting, self.held = [], 0


def summed(grams: Grams, n: np.ndarray) -> tuple[Grams, np.ndarray]:
    """Distinct n-grams and the sums of their numbers."""
    _, one, where = np.unique(grams.keys(), return_index=True, return_inverse=True)
    return grams[one], np.bincount(where, n, len(one)).astype(np.int64)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, high, low, n) of (lang, text): a task adds up its whole partition before it emits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Counts] = {}
        none = np.empty(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = _Words(part.column("text"))
                bounds, grams = _ngrams(words.words)
                sizes = np.diff(bounds)
                langs = part.column("lang").dictionary_encode()
                owner = np.repeat(langs.indices.to_numpy(), np.diff(words.first))
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    times = np.bincount(words.which[owner == k], minlength=len(words.words)) * words.full
                    weight = np.repeat(times, sizes)
                    used = weight > 0
                    held.setdefault(lang, _Counts(Grams(none, none), none, [])).add(*summed(grams[used], weight[used]))
        for lang, counts in held.items():
            counts.settle()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts.n), pa.string()), pa.array(counts.grams.high), pa.array(counts.grams.low), pa.array(counts.n)], ["lang", "high", "low", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, high long, low long, n long").groupBy("lang", "high", "low").agg(F.sum("n").alias("n"))


ENTRY = np.dtype([("lang", "<i4"), ("value", "<f4")])
#: Of every order there are two tables: discounted shares of n-grams, and what contexts leave to the order below.
SHARES, LEFTS = 0, 1


def _last(high: Column, low: Column, n: int) -> tuple[Column, Column]:
    """``Grams.last`` in columns."""
    if n <= LOW:
        return F.lit(0).cast("long"), low.bitwiseAND(F.lit((1 << BITS * n) - 1))
    return high.bitwiseAND(F.lit((1 << BITS * (n - LOW)) - 1)), low


def _context(high: Column, low: Column, n: int) -> tuple[Column, Column]:
    """``Grams.context`` in columns."""
    carried = F.shiftleft(high.bitwiseAND(F.lit(LETTER)), (LOW - 1) * BITS)
    return _last(F.shiftright(high, BITS), F.shiftright(low, BITS).bitwiseOR(carried), n - 1)


def shorter(counts: DataFrame, n: int) -> DataFrame:
    """Continuation counts of n-grams: in how many contexts they go on, from the counts of the order above."""
    high, low = _last(F.col("high"), F.col("low"), n)
    return counts.select("lang", high.alias("high"), low.alias("low")).groupBy("lang", "high", "low").agg(F.count(F.lit(1)).alias("n"))


def smoothed(counts: DataFrame, n: int) -> DataFrame:
    """Entries (table, high, low, lang, value) of one order from its (lang, high, low, n). A context has as many rows as
    letters follow it, so a window over one is no larger than an alphabet; discounts are one row per language."""
    ones, twos = (F.sum((F.col("n") == k).cast("long")) for k in (1, 2))
    discounts = counts.groupBy("lang").agg(ones.alias("ones"), twos.alias("twos"))
    discount = F.when((F.col("ones") > 0) & (F.col("twos") > 0), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5)
    head_high, head_low = _context(F.col("high"), F.col("low"), n)
    heads = counts.withColumns({"head_high": head_high, "head_low": head_low})
    same = Window.partitionBy("lang", "head_high", "head_low")
    first = F.row_number().over(same.orderBy("high", "low")) == 1
    sums = heads.select("*", F.sum("n").over(same).alias("total"), F.count(F.lit(1)).over(same).alias("kinds"), first.alias("first"))
    sums = sums.join(F.broadcast(discounts.select("lang", discount.alias("discount"))), "lang")
    entry = lambda table, high, low, value: F.struct(F.lit(2 * n + table).alias("table"), F.col(high).alias("high"), F.col(low).alias("low"), value.cast("float").alias("value"))
    share = entry(SHARES, "high", "low", (F.col("n") - F.col("discount")) / F.col("total"))
    left = entry(LEFTS, "head_high", "head_low", F.col("discount") * F.col("kinds") / F.col("total"))
    return sums.select("lang", F.explode(F.when(F.col("first"), F.array(share, left)).otherwise(F.array(share))).alias("e")).select("e.table", "e.high", "e.low", "lang", "e.value")


def write_tables(entries: DataFrame, root: str, bits: int = PART_BITS) -> Tables:
    """Write entries by part, table, hash and language, as one file of hashes and one of values for each task.

    A task names its files anew, so those of a task that was lost or run twice are never looked at.
    """
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = Grams(batch.column("high").to_numpy(), batch.column("low").to_numpy()).keys()
            part = (keys >> np.uint64(64 - bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("table"), pa.array(keys.view(np.int64)), batch.column("lang"), batch.column("value")], ["part", "table", "key", "lang", "value"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(root)
        name, at, runs = uuid.uuid4().hex, 0, {}
        with ExitStack() as files:
            out: list[pa.NativeFile] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not out:
                    out = [files.enter_context(store.open_output_stream(f"{folder}/{name}.{end}")) for end in ("keys", "values")]
                values = np.empty(batch.num_rows, ENTRY)
                values["lang"], values["value"] = batch.column("lang").to_numpy(), batch.column("value").to_numpy()
                out[0].write(batch.column("key").to_numpy().astype("<i8").tobytes())
                out[1].write(values.tobytes())
                run = batch.column("part").to_numpy().astype(np.int64) << 8 | batch.column("table").to_numpy()
                for key, first, n in zip(*np.unique(run, return_index=True, return_counts=True), strict=True):
                    start, held = runs.get(int(key), (at + int(first), 0))
                    runs[int(key)] = (start, held + int(n))
                at += batch.num_rows
        rows = [(name, key >> 8, key & 255, start, n) for key, (start, n) in runs.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])] if rows else [pa.array([], k) for k in (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())], ["file", "part", "table", "start", "n"])

    keyed = entries.mapInArrow(hashed, "part int, table int, key long, lang int, value float")
    sorted_ = keyed.repartition(1 << bits, "part").sortWithinPartitions("part", "table", "key", "lang")
    places = sorted_.mapInArrow(write, "file string, part int, table int, start long, n long").collect()
    return Tables(root, bits, {(r["part"], r["table"]): (r["file"], r["start"], r["n"]) for r in places})


@dataclass
class Tables:
    """Where the entries of each part and table lie. Files are mapped where the folder is a mounted one, else read."""

    root: str
    bits: int
    places: dict[tuple[int, int], tuple[str, int, int]]
    _open: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"root": self.root, "bits": self.bits, "places": self.places, "_open": {}}

    def _array(self, name: str, kind: np.dtype) -> np.ndarray:
        if name not in self._open:
            fs, base = pafs.FileSystem.from_uri(self.root)
            local = isinstance(fs, pafs.LocalFileSystem)
            with pa.memory_map(f"{base}/{name}") if local else fs.open_input_file(f"{base}/{name}") as file:
                self._open[name] = np.frombuffer(file.read_buffer(), kind)
        return self._open[name]

    def find(self, table: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted distinct hashes: (place of the hash, entry), ordered by the entry's language."""
        bounds = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).tolist() + [len(keys)]
        which, entries = [np.empty(0, np.int64)], [np.empty(0, ENTRY)]
        for part in range(1 << self.bits):
            first, end = bounds[part], bounds[part + 1]
            if first == end or (part, table) not in self.places:
                continue
            file, start, n = self.places[part, table]
            held = self._array(f"{file}.keys", np.dtype("<u8"))[start : start + n]
            low = np.searchsorted(held, keys[first:end])
            counts = np.searchsorted(held, keys[first:end], "right") - low
            which.append(np.repeat(np.arange(first, end), counts))
            entries.append(self._array(f"{file}.values", ENTRY)[start : start + n][ragged(low, counts)])
        place, entry = np.concatenate(which), np.concatenate(entries)
        order = np.argsort(entry["lang"], kind="stable")
        return place[order], entry[order]


@dataclass
class LanguageModel:
    langs: list[str]
    tables: Tables | None = None
    #: The share of a letter that no model knows.
    uniform: float = 1.0
    #: Per language, the cross-entropy above which a text is not accepted as that language.
    limits: np.ndarray | None = None

    def log_p(self, grams: Grams) -> Iterator[np.ndarray]:
        """Of n-grams, for one language after the other."""
        found = []
        for n in range(1, ORDER + 1):
            for table, part in ((LEFTS, grams.context(n)), (SHARES, grams.last(n))):
                keys, where = np.unique(part.keys(), return_inverse=True)
                place, entry = self.tables.find(2 * n + table, keys)
                bounds = np.searchsorted(entry["lang"], np.arange(len(self.langs) + 1))
                found.append((len(keys), where, place, entry["value"], bounds, table == LEFTS))
        for k in range(len(self.langs)):
            p = np.full(len(grams), self.uniform)
            for size, where, place, value, bounds, is_left in found:
                mine = slice(bounds[k], bounds[k + 1])
                dense = np.full(size, float(is_left))
                dense[place[mine]] = value[mine]
                p = dense[where] * p if is_left else dense[where] + p
            yield np.log(p)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy of each text under each language, predicted characters of each text)."""
        words = _Words(texts)
        bounds, grams = _ngrams(words.words)
        _, one, where = np.unique(grams.keys(), return_index=True, return_inverse=True)
        sizes = np.diff(bounds)
        n_texts = len(words.first) - 1
        length = _sums((sizes * words.full)[words.which], words.first)
        entropy = np.zeros((n_texts, len(self.langs)))
        for k, log_p in enumerate(self.log_p(grams[one]) if self.langs else ()):
            per_word = _sums(log_p[where], bounds) * words.full
            entropy[:, k] = -_sums(per_word[words.which], words.first) / np.maximum(length, 1)
        return entropy, length

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, accepted, least cross-entropy)."""
        entropy, length = self.read(texts)
        if not self.langs:
            return [UNKNOWN] * len(length), np.zeros(len(length)), np.zeros(len(length), bool), np.zeros(len(length))
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        sure = np.clip(length, 1, SURE_LETTERS)
        weight = np.exp(-(entropy - least[:, None]) * sure[:, None])
        known = length > 0
        limits = np.full(len(self.langs), np.inf) if self.limits is None else self.limits
        # Beside the languages stands none of them, at the limit of the best one.
        none = np.exp(np.minimum((least - limits[best]) * sure, 500.0))
        langs = [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        return langs, np.where(known, 1 / (weight.sum(axis=1) + none), 0.0), known & (least <= limits[best]), np.where(known, least, 0.0)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def fit_languages(docs: DataFrame, scratch: Scratch, *, held_back: int = HELD_BACK, accept: float = 0.999) -> LanguageModel:
    """docs (id, lang, text). Every row that ``learned_from`` admits and whose lang is not null is counted, but for one
    in ``held_back`` by a hash of the id (0: none): these set the rejection limits. A language's limit comes from a
    quantile of the cross-entropies of its held-back texts, or of those of all languages where that is higher or
    it has none. A language all of whose texts fall among the held back is counted whole.

    The number of jobs does not depend on the number of languages. Counts of each order are written to scratch, and the tables.
    """
    training = docs.where(learned_from(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(held_back)) == 0 if held_back else F.lit(False)
    if held_back:
        spared = [r["lang"] for r in training.groupBy("lang").agg(F.min(held).alias("all")).where("all").collect()]
        held = held & ~F.col("lang").isin(spared)
    counts = scratch.keep(count_ngrams(training.where(~held)), "counts")
    model = LanguageModel(sorted(r["lang"] for r in counts.select("lang").distinct().collect()))
    if not model.langs:
        return model
    # One row per language.
    numbers = docs.sparkSession.createDataFrame(list(enumerate(model.langs)), "number int, lang string")
    order = counts.join(F.broadcast(numbers), "lang").select(F.col("number").alias("lang"), "high", "low", "n")
    entries = smoothed(order, ORDER)
    for n in range(ORDER - 1, 0, -1):
        order = scratch.keep(shorter(order, n), f"order{n}")
        entries = entries.unionByName(smoothed(order, n))
    model.uniform = 1 / (order.agg(F.count_distinct("low")).first()[0] + 1)
    model.tables = write_tables(entries, scratch.path("tables"))
    if not held_back:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                langs, _, _, entropy = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(langs), pa.array(entropy)], ["lang", "found", "entropy"])

    measured = training.where(held).select("lang", "text").mapInArrow(measure, "lang string, found string, entropy double").where("lang = found")
    quantiles = {r["lang"]: r["q"] for r in measured.rollup("lang").agg(F.percentile_approx("entropy", accept, 10_000).alias("q")).collect()}
    pooled = quantiles.get(None)
    model.limits = np.array([np.inf if pooled is None else 1.05 * max(pooled, quantiles.get(x, 0.0)) for x in model.langs])
    return model


def identify_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of every whole text: (id, held_out, lang_pred, score, accepted, cross_entropy).

    score, 0 to 1, is the share of the best language, among all and none of them, if the cross-entropies are
    taken as evidence of up to ``SURE_LETTERS`` letters; none of them stands at the best one's limit of rejection. lang_pred is ``und``, with score 0, where text is null, empty or without a
    letter, or where nothing could be learned. accepted is false for those and for texts that the best
    language predicts worse than nearly all of its own texts held back. Null ids are held out; repeated
    rows come out once each; ties go to the first language by name; other columns are not read.

    Counting is one scan with partial sums per task, then exchanges of n-grams; scoring is a scan whose tasks map the
    tables of the models from the shared folder. The driver holds the languages' names and limits and the files' names.
    The result is written, and the tables are removed.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "languages")
    model = fit_languages(base, scratch)
    kind = T.StructType([base.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType()), T.StructField("cross_entropy", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                langs, score, accepted, entropy = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score), pa.array(accepted), pa.array(entropy)], kind.names)

    scored = base.select("id", (~learned_from(F.col("id"))).alias("held_out"), "text").mapInArrow(predict, kind)
    return scratch.result(scored, "languages-found").withColumnRenamed("id", id_col)
