"""License scans: canonical digests of entire texts, looked up by a hash join. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import KNOWN_TEXTS
from .native import ascii_lower

#: A line with a copyright statement, also after comment marks.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright\b(?:[^\n]*(?:\(c\)|©|[0-9]{4}))|\(c\)|©|all rights reserved)[^\n]*$"
#: Equivalent spellings, (pattern, one spelling), on lower-case words with single spaces.
SPELLINGS: list[tuple[str, str]] = [
    (r"licence(s|d)?\b", r"license"),
    (r"\bsub license\b", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bper cent\b", "percent"),
    (r"\backnowledgement\b", "acknowledgment"),
    (r"\bfavour\b", "favor"),
    (r"\bhttps\b", "http"),
]


def canonical(text: Column) -> Column:
    """Lower-case A-Z, drop copyright lines, turn all but ASCII letters, digits and non-ASCII characters into single spaces, unify spellings."""
    return F.trim(_spelled(text, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"))


def canonical_lines(text: Column) -> Column:
    """The distinct ``canonical`` forms of the lines of a text, without empty ones, made in one pass over the text."""
    lines = F.split(_spelled(text, r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"), "\n", -1)
    return F.filter(F.array_distinct(F.transform(lines, lambda x: F.trim(x))), lambda x: x != "")


def _spelled(text: Column, gaps: str) -> Column:
    out = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, gaps, " ")
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling.replace("license", "license$1") if "(" in pattern else spelling)
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN_TEXTS) -> DataFrame:
    """(digest, license_id), one row per digest; the first id wins where two texts agree."""
    rows = [(i, name, body) for i, (name, body) in enumerate(texts)]
    table = spark.createDataFrame(rows, "rank int, license_id string, body string")
    return table.select(digest(F.col("body")).alias("digest"), "license_id", "rank").groupBy("digest").agg(F.min_by("license_id", "rank").alias("license_id"))


def licenses_in(spark: SparkSession, path: str) -> DataFrame:
    """(digest, license_id) of a folder of licence texts, a file each, named by its id, such as a system's own collection.

    An ending like .txt is no part of the id; the first id in order wins where two texts agree. For licences that the
    built-in list has no whole text of; ``license_scan`` takes it, or its union with ``known_digests``, as ``known``.
    """
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\.(txt|md)$", "")
    files = spark.read.text(path, wholetext=True).select(name.alias("license_id"), digest(F.col("value")).alias("digest"))
    return files.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the digest of its whole canonical text, the licence that has it, and the licences of its lines.

    Columns: id, digest, license_id (null if no known text is equal), notice_ids (sorted, distinct ids
    of known texts that a line of the document equals; empty array if none). Null and empty texts,
    and texts of separators only, have the digest of the empty string and match nothing. Null ids
    and repeated rows pass through, one row out per row in; extra columns are not read.

    ``known`` has (digest, license_id) of any length; Spark broadcasts it only where its size is
    below the session's threshold, else both sides are shuffled on the digest. Every line that has more than
    separators is looked up.
    """
    spark = docs.sparkSession
    known = known_digests(spark) if known is None else known.select("digest", "license_id")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    known = known.where(F.col("digest") != empty)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digests = base.select("id", F.xxhash64("text").alias("th"), digest(F.col("text")).alias("digest"))
    whole = digests.join(known, "digest", "left")
    lines = base.select("id", F.xxhash64("text").alias("th"), F.explode(canonical_lines(F.col("text"))).alias("line"))
    found = lines.select("id", "th", F.sha2(F.col("line").cast("binary"), 256).alias("digest")).join(known, "digest").groupBy("id", "th").agg(F.array_sort(F.collect_set("license_id")).alias("notice_ids"))
    w, f = whole.alias("w"), found.alias("f")
    return w.join(f, F.col("w.id").eqNullSafe(F.col("f.id")) & (F.col("w.th") == F.col("f.th")), "left").select(F.col("w.id").alias(id_col), F.col("w.digest").alias("digest"), F.col("w.license_id").alias("license_id"), F.coalesce("f.notice_ids", F.array().cast("array<string>")).alias("notice_ids"))
