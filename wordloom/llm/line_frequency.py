"""Quality rules by cross-document line frequency, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .native import GAP, ascii_lower, let, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Limits. A line goes if more documents of its host hold it than both ``min_docs`` and
    ``host_share`` of the host's documents; a document is depleted if less than ``min_left`` of its
    words stay."""

    min_docs: int = 20
    host_share: float = 0.01
    min_left: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def normal_line(line: Column) -> Column:
    """A-Z lower-cased, digit runs as 0, separator runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_lower(line), GAP, " "), "[0-9]+", "0"))


def repeat_words(word_array: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array.

    Windows are hashed and sorted with their positions; equal neighbours are repeats, and a fold
    over their ascending positions adds up the words they cover. O(n log n) for n words.
    """

    def windows(w: Column) -> Column:
        at = lambda i, k: F.get(w, i + k)
        return F.when(F.size(w) > 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).alias("h"), i.alias("p")))))

    def repeated(s: Column) -> Column:
        other = lambda i: F.get(s, i).getField("h")
        marked = F.transform(s, lambda x, i: F.when((x["h"] == F.when(i > 0, other(i - 1))) | (x["h"] == other(i + 1)), x["p"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(positions, start, step, lambda a: a["n"])

    return F.coalesce(covered(let(let(word_array, windows), repeated)), F.lit(0).cast("long"))


def base_signals(text: Column) -> Column:
    """A struct of the per-document counts."""

    def of(t: Column) -> Column:
        def lines(kept: Column) -> Column:
            return F.size(kept) - F.size(F.array_distinct(kept))

        with_word = F.filter(F.split(t, "\n", -1), has_word)
        return let(
            words(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.regexp_replace(t, GAP, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(with_word, lines).cast("long").alias("n_dup_lines"),
                repeat_words(w).alias("n_repeat_words"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def line_frequency(docs: DataFrame, rules: LineRules = LineRules(), *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document the base counts, the words that frequent lines take, and the verdict.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_frequent_words. Lines are hashed after ``normal_line``; a document counts once for a line
    however often it repeats it, and equal rows (same id, host and text) count once. Null and empty
    texts have no words, so they fail the base rules; a null host is a host of its own; null ids are
    kept as they are. Other columns of the input are not looked at, whatever their names. Empty
    input gives an empty result. Line hashes have 64 bits within one host.

    Plan: documents are exploded once into (host, line hash, words), a small table in the shared folder; the count is
    a partial then final aggregate on (host, hash), so a hot host or line adds one row per task. The
    lines above their limit meet the exploded lines in an inner join that adaptive execution can
    split, and the few documents that hold any meet the base rows on id and text hash.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    key = ["id", "host", "th"]
    with_word = F.filter(F.split("text", "\n", -1), has_word)
    hashed = F.transform(with_word, lambda x: F.struct(F.xxhash64(normal_line(x)).alias("lh"), F.size(words(x)).cast("int").alias("nw")))
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(base.select(*key, F.posexplode(hashed).alias("pos", "l")).select(*key, "pos", "l.lh", "l.nw"), "lines")
    # Lines bound documents from above; only those that pass this test are counted exactly.
    likely = lines.groupBy("host", "lh").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > rules.min_docs).select("host", "lh")
    holders = lines.select(*key, "lh").join(likely, ["host", "lh"], "left_semi").distinct().groupBy("host", "lh").agg(F.count(F.lit(1)).alias("holders"))
    sizes = base.select(*key).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    frequent = holders.join(sizes, "host").where((F.col("holders") > rules.min_docs) & (F.col("holders") > F.col("docs") * rules.host_share)).select("host", "lh")
    taken = lines.join(frequent, ["host", "lh"]).dropDuplicates([*key, "pos"]).groupBy(*key).agg(F.sum("nw").alias("taken")).alias("x")
    signals = base.select(*key, base_signals(F.col("text")).alias("s")).alias("s0")
    joined = signals.join(taken, on=F.col("s0.id").eqNullSafe(F.col("x.id")) & (F.col("s0.host") == F.col("x.host")) & (F.col("s0.th") == F.col("x.th")), how="left")
    n, rep, gone = F.col("s0.s.n_words"), F.col("s0.s.n_repeat_words"), F.coalesce(F.col("x.taken"), F.lit(0)).cast("long")
    failed = (n < rules.min_words) | (100 * rep > rules.max_repeat_percent * n)
    return joined.select(F.col("s0.id").alias(id_col), *[F.col(f"s0.s.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), (~failed & ((n - gone) >= n * rules.min_left)).alias("kept"), gone.alias("n_frequent_words"))
