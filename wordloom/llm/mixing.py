"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .native import words
from .scan import running
from .skew import join_keys

WEIGHTS = (5, 2, 1)
#: Times that a document may be taken.
EPOCHS = 3
SEED = 13
#: A source: whether it is null, and its name or an empty string.
SOURCE = ["mix_null", "mix_source"]


def source_targets(sizes: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(mix_null, mix_source, source_size, docs, weight, target) of sources (mix_null, mix_source, source_size, docs).

    Sources take the weights in turn, by code point and null last. Targets share the sum of all sizes by weight; none is
    above ``epochs`` times its source's size, and what such a source cannot take is shared among the others, until none
    is above. The sources that stop are those of the least size for their weight, a prefix in that order, so prefix sums
    find them at once, however many sources there are.
    """
    if any(w * 1_000_000 < 1 for w in weights):
        raise ValueError("weights must be at least one millionth")
    one = F.lit(1).cast("long")
    ranked = running(sizes.withColumn("one", one), scratch, "ranked", [], SOURCE, {"place": "one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * epochs
    rows = ranked.withColumns({"weight": weight, "cap": cap}).withColumns({"ratio": F.col("cap") / F.col("weight"), "micro": F.round(F.col("weight") * 1_000_000).cast("long")})
    rows = running(rows.drop("one", "place"), scratch, "filled", [], ["ratio", *SOURCE], {"cap_before": "cap", "micro_before": "micro"})
    rows = scratch.keep(rows, "levels")
    whole = rows.agg(F.sum("source_size").alias("words"), F.sum("micro").alias("micros")).first()
    if not whole.words:
        return rows.select(*SOURCE, "source_size", "docs", "weight", F.lit(0.0).alias("target"))
    level = (F.lit(whole.words) - F.col("cap_before")) / ((F.lit(whole.micros) - F.col("micro_before")) / F.lit(1e6))
    stops = F.col("ratio") <= level
    stopped = rows.agg(F.coalesce(F.sum(F.when(stops, F.col("cap"))), F.lit(0)).alias("cap"), F.coalesce(F.sum(F.when(stops, F.col("micro"))), F.lit(0)).alias("micro")).first()
    rest = whole.micros - stopped.micro
    last = (whole.words - stopped.cap) / (rest / 1e6) if rest else 0.0
    return rows.select(*SOURCE, "source_size", "docs", "weight", F.when(stops, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(last)).alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, cut, taken), a row for each document.

    size is its number of words; target the words wanted of its source (see ``source_targets``); copies how often the mix
    takes it whole, cut how many of its first words it takes once more, and taken the words in all. Documents of a source
    stand in an order hashed from seed, id and text, and each source gives exactly its target, rounded to a word: whole
    epochs, then documents in that order until the budget is spent, the last of them in part.

    Null and empty texts have size 0 and are taken 0 words; a null source is a source of its own, as is the empty string.
    Repeated rows are documents of their own and stand beside each other; of equal rows, which one is cut is all one, and
    the result is the same in every run. Sources of size 0, and tables without a word, have targets of 0; an empty table
    gives no rows. Texts are read once, and only sizes and hashes are exchanged.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.col(source_col).isNull().alias(SOURCE[0]), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias(SOURCE[1]),
        F.coalesce(F.size(words(F.col(text_col))), F.lit(0)).cast("long").alias("size"),
        F.unhex(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit(""))).cast("binary"))).alias("draw"),
    )
    rows = scratch.keep(rows.withColumn("size", F.when(F.col("size") > 0, F.col("size")).otherwise(0).cast("long")), "sized")
    sizes = scratch.keep(rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "sizes")
    targets = scratch.keep(source_targets(sizes, scratch, weights, epochs), "targets")
    placed = running(rows, scratch, "placed", SOURCE, ["draw", "doc_id"], {"before": "size"})
    joined = join_keys(placed, targets, SOURCE, "docs")
    budget = F.round("target").cast("long")
    copies = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div greatest(source_size, 1)")).otherwise(0)
    left = budget - F.col("copies") * F.col("source_size") - F.col("before")
    cut = F.greatest(F.lit(0), F.least("size", left)).cast("long")
    out = joined.withColumn("copies", copies.cast("long")).withColumn("cut", cut)
    out = out.select("doc_id", "source", "size", "source_size", "target", "copies", "cut", (F.col("copies") * F.col("size") + F.col("cut")).alias("taken"))
    return scratch.result(out, "mixed")


def mixed_texts(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: the documents' columns with epoch, a row for each time a document is taken, the last one perhaps
    cut after its first words. ids must be unique and not null: rows whose id is null are left out."""
    plan = mixed.where("taken > 0").select(F.col("doc_id").alias(id_col), F.col("copies").alias("__mix_copies"), F.col("cut").alias("__mix_cut"), F.col("size").alias("__mix_size"))
    rows = docs.join(plan, id_col)
    times = F.col("__mix_copies") + F.when(F.col("__mix_cut") > 0, 1).otherwise(0)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    part = (F.col("epoch") > F.col("__mix_copies")) & (F.col("__mix_cut") < F.col("__mix_size"))
    first = F.array_join(F.slice(words(F.col(text_col)), F.lit(1), F.col("__mix_cut").cast("int")), " ")
    return rows.withColumn(text_col, F.when(part, first).otherwise(F.col(text_col))).drop("__mix_copies", "__mix_cut", "__mix_size")
