"""Readers and writers of the corpus: aligned XML, chunk lines, lists, transcripts and features."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "struct<tokens:array<string>,start_time:bigint,end_time:bigint,start_index:bigint,end_index:bigint>"
CHUNK = f"struct<left:{SECTION},mid:{SECTION},right:{SECTION},puncted_text:string,segmented_puncted_text:string,global_chunk_number:bigint,filename:string>"
DOCUMENT = f"filename string, chunks array<{CHUNK}>"
PARSED = "doc {doc}, sentences array<struct<ptoks:array<string>,ntoks:array<string>,times:array<struct<start:bigint,end:bigint>>>>"
#: Fixed value: marks that no sentence begins with and no space stands before.
NO_SPACE_BEFORE = ".,;:?!)"


class _Sentences:
    """Sentences of documents as flat columns with offsets, as Arrow holds nested lists."""

    def __init__(self) -> None:
        self.ptoks: list[str] = []
        self.ntoks: list[str] = []
        self.starts: list[int | None] = []
        self.ends: list[int | None] = []
        self.tokens, self.times, self.documents = [0], [0], [0]

    def add(self, node: ET.Element) -> None:
        """Add a sentence, unless any part of it is not as it should be: a token without text, a leading mark, a word
        without pronunciation or with a time that is no integer."""
        written, spoken, starts, ends = [], [], [], []
        for token in node:  # not by findall, which costs more than the rest
            if token.tag != "t":
                continue
            if token.text is None:
                return
            text = token.text.strip()
            if text in NO_SPACE_BEFORE:
                if not written:
                    return
                written[-1] = written[-1].rstrip()
            elif text == "$":
                continue
            phrase = None
            for n in token:
                if n.tag != "n":
                    continue
                said, start, end = n.get("pronunciation"), n.get("start"), n.get("end")
                if said is None:
                    return
                said = said.lstrip("_")
                phrase = said if phrase is None else f"{phrase} {said}"
                try:
                    starts.append(None if start is None else int(start))
                    ends.append(None if end is None else int(end))
                except ValueError:
                    return
            if phrase and phrase.endswith((" dollar", " dollars")) and "$" not in text:
                text = "$" + text
            written.append(text if text == "(" else text + " ")
            spoken.append(phrase or "")
        if not written:
            return
        written[-1] = written[-1].strip()
        self.ptoks += written
        self.ntoks += spoken
        self.starts += starts
        self.ends += ends
        self.tokens.append(len(self.ptoks))
        self.times.append(len(self.starts))

    def add_document(self, xml: str | None) -> None:
        """Add the sentences of every ``p`` at any depth; none if the XML does not parse."""
        try:
            root = ET.fromstring(xml or "")
        except ET.ParseError:
            root = None
        for p in root.iter("p") if root is not None else ():
            for s in p:
                if s.tag == "s":
                    self.add(s)
        self.documents.append(len(self.tokens) - 1)

    def column(self) -> pa.Array:
        offsets = lambda at: pa.array(at, pa.int32())
        words = lambda values: pa.ListArray.from_arrays(offsets(self.tokens), pa.array(values, pa.string()))
        times = pa.StructArray.from_arrays([pa.array(self.starts, pa.int64()), pa.array(self.ends, pa.int64())], ["start", "end"])
        parts = [words(self.ptoks), words(self.ntoks), pa.ListArray.from_arrays(offsets(self.times), times)]
        return pa.ListArray.from_arrays(offsets(self.documents), pa.StructArray.from_arrays(parts, ["ptoks", "ntoks", "times"]))


#: Characters of XML whose sentences are held as lists at a time.
PARSED_AT_ONCE = 4 << 20


def parse_document(xml: str) -> list[dict]:
    """Sentences that parse, of one document."""
    found = _Sentences()
    found.add_document(xml)
    return found.column()[0].as_py()


def parse_aligned(files: DataFrame) -> DataFrame:
    """(doc, sentences) of (doc, xml). Sentences go out in parts of about ``PARSED_AT_ONCE`` characters of XML."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, found = 0, 0, _Sentences()
            for i, xml in enumerate(batch.column("xml"), 1):
                text = xml.as_py()
                found.add_document(text)
                held += len(text or "")
                if held >= PARSED_AT_ONCE or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc").slice(first, i - first), found.column()], ["doc", "sentences"])
                    first, held, found = i, 0, _Sentences()

    return files.select("doc", "xml").mapInArrow(parse, PARSED.format(doc=files.schema["doc"].dataType.simpleString()))


def read_aligned(spark: SparkSession, path: str, name: str = "aligned.swc") -> DataFrame:
    """Parsed documents of every file of that name below path; the folder is the document's name. One row per file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True)
    return parse_aligned(files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("doc"), F.col("value").alias("xml")))


def flattened(parsed: DataFrame) -> DataFrame:
    """(doc, ptoks, ntoks, words, times): sentences end to end; words are the spoken words, phrases split."""
    flat = lambda part: F.flatten(F.transform("sentences", lambda s: s[part]))
    ntoks = flat("ntoks")
    words = F.flatten(F.transform(F.filter(ntoks, lambda n: n != ""), lambda n: F.split(n, " ", -1)))
    return parsed.select("doc", flat("ptoks").alias("ptoks"), ntoks.alias("ntoks"), words.alias("words"), flat("times").alias("times"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path)


def write_chunks(docs: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON line per document. Modes are Spark's: overwrite for a new run, append to go on."""
    docs.write.mode(mode).json(path)


def unfinished(docs: DataFrame, finished: DataFrame, key: str = "doc") -> DataFrame:
    """Documents that are not among the finished ones."""
    return docs.join(finished.select(key), key, "left_anti")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines that are not empty."""
    return spark.read.text(path).where("value <> ''")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text): one document for each text file, named after it, white space at its ends cut."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("doc"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, features array<float>) from Parquet."""
    return spark.read.schema("chunk_id string, features array<float>").parquet(path)


def write_features(rows: DataFrame, path: str, mode: str = "append") -> None:
    """(chunk_id, features array<float>) as Parquet, what ``read_features`` reads."""
    rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("features").cast("array<float>").alias("features")).write.mode(mode).parquet(path)


def write_log(rows: DataFrame, path: str, run: str, first: int = 0) -> None:
    """Training measures (step, measure, value) of a run from step ``first`` on, in a table of runs.

    A range of steps is a partition, which a write replaces: a retry, or a run that goes on again from the same step, leaves
    its rows once. Other runs and ranges stay as they are.
    """
    columns = [F.col("step").cast("long").alias("step"), F.col("measure").cast("string").alias("measure"), F.col("value").cast("double").alias("value")]
    kept = rows.where(F.col("step") >= first).select(*columns, F.lit(run).alias("run"), F.lit(first).cast("long").alias("first"))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "first").parquet(path)


def with_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Rows with their features, and whether there are any."""
    return rows.join(features, "chunk_id", "left").withColumn("has_features", F.col("features").isNotNull())


def read_audio(spark: SparkSession, path: str, glob: str = "*.ogg") -> DataFrame:
    """(doc, path, length, content) of audio files; decoding them is left to the caller."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("doc"), "path", "length", "content")


def sample_ranges(chunks: DataFrame, rate: int = 16_000) -> DataFrame:
    """Flat chunks with the first and last audio sample of each."""
    from ..functions.encode import sample_index

    return chunks.withColumns({"first_sample": sample_index(F.col("start_time"), rate), "last_sample": sample_index(F.col("end_time"), rate)})


def write_report(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report as CSV with a header, doubles with two decimals."""
    shown = [F.format_string("%.2f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).write.mode(mode).option("header", "true").csv(path)
