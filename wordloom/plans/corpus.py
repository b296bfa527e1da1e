"""Whole plans: aligned documents to window rows, window rows to training rows, texts to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encode as E
from ..operators import entities, evaluation, segments, selection, tags, windows
from ..operators.entities import Tagger
from ..session import Scratch, dealt
from ..sources.transcripts import flattened


def build_chunks(parsed: DataFrame, *, left: int = windows.LEFT, mid: int = windows.MID, right: int = windows.RIGHT, strict: bool = False, tagger: Tagger | None = None, keep_tail: bool = False) -> DataFrame:
    """Documents of chunks (filename, chunks) from parsed documents.

    Documents are parsed once and dealt by document for offsets, entities and sections; texts and words of windows are
    shuffled on document and block. Documents, entities, tagged tokens and cut windows, which are read more than once, are
    written to the scratch folder. Documents without a chunk give no row.
    """
    scratch = Scratch(parsed.sparkSession, "tokens")
    docs = dealt(scratch.keep(flattened(parsed), "documents"), "doc")
    chunks = windows.chunks(windows.word_sections(windows.timed_words(docs), left, mid, right, strict=strict))
    pairs = docs.select("doc", F.posexplode(F.arrays_zip("ntoks", "ptoks")).alias("pos", "t")).select("doc", "pos", F.col("t.ntoks").alias("ntok"), F.col("t.ptoks").alias("ptok"))
    tokens = entities.with_offsets(pairs)
    found = scratch.keep(entities.tag_all(tokens, tagger), "entities")
    tagged = scratch.keep(entities.embed_tags(tokens, found), "tagged")
    # Numbering reads its rows several times, first for bounds.
    numbered = windows.number_chunks(scratch.keep(segments.segment_texts(scratch.keep(chunks, "chunks"), tagged, found, keep_tail=keep_tail), "texts"))
    spoken = docs.select("doc", F.posexplode("words").alias("idx", "word"))
    rows = windows.with_section_tokens(numbered, spoken)
    chunk = F.struct("left", "mid", "right", "puncted_text", "segmented_puncted_text", "global_chunk_number", F.col("doc").alias("filename"))
    rows = rows.select("doc", "k", chunk.alias("chunk"))
    return rows.groupBy(F.col("doc").alias("filename")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "chunk"))), lambda x: x["chunk"]).alias("chunks"))


def split_rows(docs: DataFrame, names: DataFrame, key: str = "filename") -> DataFrame:
    """Flat chunk rows of the listed documents: listing, dictionary and lookup as one plan with one semi-join."""
    return selection.flatten_chunks(selection.of_listed(docs, names, key))


def training_rows(rows: DataFrame, *, windowed: bool = True, most: int = E.MAX_LABELS) -> DataFrame:
    """Flat chunk rows with their encoded text and label ids (hashed; put a tokenizer's ids in their place)."""
    c = F.col
    rows = rows.where(E.is_windowed(c("text")))
    text = E.windowed_text(c("text"), c("start_time"), c("lend_time"), c("mstart_time"), c("mend_time"), c("rstart_time"), c("rend_time")) if windowed else E.plain_text(c("text"), c("start_time"), c("end_time"), c("mstart_time"), c("rstart_time"))
    ids = E.truncate(E.hashed_ids(F.col("encoded")), most)
    return rows.withColumn("encoded", text).withColumn("labels", E.drop_for_windowed(ids) if windowed else E.drop_for_plain(ids))


def evaluate(refs: DataFrame, hyps: DataFrame, *by: str, tagged: bool = True) -> dict[str, DataFrame]:
    """The tables of a report on (doc, text) pairs: errors, case, marks, and for tagged hypotheses spans; labels.

    by is doc for rows of each document and nothing for totals.
    """
    prepared = evaluation.prepared_pairs(refs, hyps)
    rows = evaluation.aligned(prepared)
    positions = evaluation.exploded(rows)
    pairs = evaluation.label_pairs(evaluation.with_bio(positions)) if tagged else evaluation.span_text_pairs(positions)
    side = lambda s: evaluation.bio_spans(tags.bio_labels(positions, s))
    sums = ["hits", "substitutions", "deletions", "insertions", "char_errors", "chars"]
    errors = evaluation.error_counts(evaluation.cut_pairs(prepared)).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    out = {
        "errors": errors.withColumn("wer", evaluation.word_error_rate(*[F.col(c) for c in sums[:4]])),
        "case": evaluation.rates(evaluation.case_counts(positions, *by)),
        "marks": evaluation.rates(evaluation.mark_counts(positions, *by)),
        "labels": evaluation.label_similarity(pairs, *by).withColumn("mean", F.col("total") / F.col("pairs")),
    }
    if tagged:
        out["spans"] = evaluation.rates(evaluation.span_counts(side("ref"), side("hyp"), *by, "label"))
    return out


def sweep(refs: DataFrame, systems: dict[str, DataFrame]) -> DataFrame:
    """Word errors and places of several systems, a row for each. Their texts are one table with the system as a key."""
    hyps = None
    for name, texts in systems.items():
        one = texts.select(F.lit(name).alias("system"), "doc", "text")
        hyps = one if hyps is None else hyps.unionByName(one)
    return evaluation.rated_systems(evaluation.prepared_systems(refs, hyps))
