"""Token ids in binary shards, with a minimal perfect hash index from document key to shard offset.

File formats, all little-endian:

- ``shard-NNNNNNN.ids``: magic ``WLIDS001``, uint64 bytes per id (2 or 4), then the ids of its documents, end to end.
- ``index-NNNNNNN.mph``: magic ``WLMPH001``; uint64 number of keys, of levels and of left-over keys; uint64 bits of
  each level; the levels' bits, level after level, as uint64 words; uint32 rank before each word; left-over key
  hashes, sorted; then by slot: uint64 fingerprint, uint32 shard, uint64 offset in ids, uint64 number of ids.
- ``manifest.json``: buckets, and for each shard its ids and the ids before it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import END_ID, WordEncoder, slices

SHARD_MAGIC, INDEX_MAGIC = b"WLIDS001", b"WLMPH001"
SHARD_HEAD = 16
#: Keys in an index bucket on average; a bucket is built and read by one task.
BUCKET_KEYS = 200_000
LEVELS = 24
SLICE = 4 << 20
#: Text bytes of a shard on average, and the most shards, whose bounds go to the executors.
SHARD_BYTES, MAX_SHARDS = 32 << 20, 10_000
#: Characters of a text that order rows of one id before its hash does.
HEAD = 64
#: Copies of an id that one row of ``document_keys`` is opened into.
KEY_BLOCK = 10_000
READ_BYTES = 8 << 20


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _write(root: str, name: str, chunks: Iterator[bytes]) -> None:
    """Write under a name of this attempt, then move: a retried or doubled task leaves one whole file."""
    fs, base = _store(root)
    part = f"{base}/{name}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    # A rename need not replace: where another attempt was first, its file, which is the same, stays.
    try:
        fs.move(part, f"{base}/{name}")
    except OSError:
        if fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
            raise
        fs.delete_file(part)


def _read(root: str, name: str) -> bytes:
    fs, base = _store(root)
    with fs.open_input_file(f"{base}/{name}") as file:
        return file.read()


# ---- minimal perfect hash -------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slot(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (_mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(bits)).astype(np.int64)


@dataclass
class PerfectHash:
    """Levels of bit arrays: a key takes the first level at which no other key of that level shares its bit; its number
    is the rank of that bit. Keys that share a bit at every level are listed, sorted, behind the others."""

    bits: list[int]
    words: np.ndarray
    ranks: np.ndarray
    rest: np.ndarray
    n: int

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, bits, arrays = np.asarray(hashes, np.uint64), [], []
        while len(left) and len(bits) < LEVELS:
            size = max(64, -(-2 * len(left) // 64) * 64)
            slot = _slot(left, len(bits), size)
            alone = np.bincount(slot, minlength=size) == 1
            arrays.append(np.packbits(alone, bitorder="little").view("<u8"))
            bits.append(size)
            left = left[~alone[slot]]
        words = np.concatenate(arrays) if arrays else np.empty(0, "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(bits, words, (np.cumsum(counts) - counts).astype("<u4"), np.sort(left), len(hashes))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each key, in [0, n) for keys of the set; keys outside it get any number, or -1."""
        hashes = np.asarray(hashes, np.uint64)
        out, left, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        for level, size in enumerate(self.bits):
            at = _slot(hashes[left], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[at >> 6] + below)[hit]
            left, base = left[~hit], base + size
        if len(self.rest) and len(left):
            at = np.searchsorted(self.rest, hashes[left])
            same = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == hashes[left])
            out[left[same]] = self.n - len(self.rest) + at[same]
        return out


ENTRY = np.dtype([("print", "<u8"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])


def _pack_index(hashes: np.ndarray, prints: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    mph = PerfectHash.build(hashes)
    entries = np.zeros(len(hashes), ENTRY)
    slot = mph.find(hashes)
    for name, values in (("print", prints), ("shard", shard), ("at", at), ("n", n)):
        entries[name][slot] = values
    head = np.array([mph.n, len(mph.bits), len(mph.rest), *mph.bits], "<u8")
    return b"".join((INDEX_MAGIC, head.tobytes(), mph.words.tobytes(), mph.ranks.tobytes(), mph.rest.astype("<u8").tobytes(), entries.tobytes()))


def _open_index(raw: bytes) -> tuple[PerfectHash, np.ndarray]:
    if raw[:8] != INDEX_MAGIC:
        raise ValueError("not an index file")
    n, levels, rest = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
    bits = [int(x) for x in np.frombuffer(raw, "<u8", levels, 32)]
    at, words = 32 + 8 * levels, sum(bits) // 64
    table = np.frombuffer(raw, "<u8", words, at)
    ranks = np.frombuffer(raw, "<u4", words, at + 8 * words)
    left = np.frombuffer(raw, "<u8", rest, at + 12 * words)
    return PerfectHash(bits, table, ranks, left, n), np.frombuffer(raw, ENTRY, n, at + 12 * words + 8 * rest)


# ---- keys ------------------------------------------------------------------------------------------------------------


def key_of(doc_id: Column, copy: Column) -> Column:
    """The key as text: the id (a null id has no digits) and the number of the row among rows of that id."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("\u0000")), F.lit("#"), copy.cast("string"))


def _hashes(frame: DataFrame, buckets: int) -> DataFrame:
    h = F.xxhash64("key")
    return frame.withColumns({"bucket": F.pmod(h, F.lit(buckets)), "h": F.xxhash64("key", F.lit(1)), "p": F.xxhash64("key", F.lit(2))})


def _key_hashes(key: str) -> tuple[int, int, int]:
    """What ``_hashes`` gives, for one key in Python: XXH64 with the columns' hashes as seeds in turn."""
    h = xxhash.xxh64_intdigest(key.encode(), 42)
    return h, *(xxhash.xxh64_intdigest(i.to_bytes(4, "little"), h) for i in (1, 2))


# ---- writer ----------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, head, th, text): id, head and th give the order of rows in the shards."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("th"), "text")


def _bounds(rows: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first key of each shard but the first, for shards of about equally many rows; text is read for its size and keys only."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, min(MAX_SHARDS, -(-size // shard_bytes)))
    keys = rows.select("id", "head", "th").repartitionByRange(shards, *_order())
    first = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("id", "head", "th")).alias("key")).collect()
    return sorted(_comparable(*r["key"]) for r in first)[1:]


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where the shard changes, each with its shard."""
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield int(shard[a]), batch.slice(a, b - a)


def _order() -> list[Column]:
    return [F.col("id").asc_nulls_first(), F.col("head"), F.col("th")]


def _comparable(key, head: str, th: int) -> tuple:
    """Orders as Spark does: null ids first, texts by code point."""
    return key is not None, 0 if key is None else key, head, th


def _lanes(spark: SparkSession, shards: int) -> np.ndarray:
    """For each shard a value that Spark's hash puts into a partition of its own; a shared one would do no harm."""
    values = spark.range(40 * shards).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(shards)).alias("p")).agg(F.min("v").alias("v"))
    found = {r["p"]: r["v"] for r in values.collect()}
    return np.array([found.get(p, p) for p in range(shards)], np.int32)


def _encoded(rows: DataFrame, tokenizer: str, end_id: int, id_bytes: int, bounds: list[tuple]) -> DataFrame:
    """(lane, shard, id, head, th, ids) of (id, head, th, text): ids are the bytes of the ids."""
    lanes = _lanes(rows.sparkSession, len(bounds) + 1)
    kind = T.StructType([T.StructField("lane", T.IntegerType()), T.StructField("shard", T.IntegerType()), rows.schema["id"], rows.schema["head"], T.StructField("th", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ends, ids = encoder.encode(part.column("text"), end_id)
                if id_bytes == 2 and len(ids) and int(ids.max()) > 0xFFFF:
                    raise OverflowError("an id needs more than 2 bytes")
                offsets = pa.py_buffer((ends * id_bytes).astype(np.int32))
                raw = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, pa.py_buffer(ids.astype(f"<u{id_bytes}"))])
                key = [part.column(c) for c in ("id", "head", "th")]
                shard = np.array([bisect_right(bounds, _comparable(*k)) for k in zip(*[c.to_pylist() for c in key])], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lanes[shard]), pa.array(shard), *key, raw], kind.names)

    return rows.mapInArrow(encode, kind)


def write_shards(docs: DataFrame, root: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, id_bytes: int = 2, bucket_keys: int = BUCKET_KEYS, shard_bytes: int = SHARD_BYTES) -> TokenStore:
    """Encode every text, append ``end_id`` and write the ids in ascending id order under ``root``, with their index.

    ``root`` is a URI that every executor can write (spark.checkpoint.dir's file system, or any that
    pyarrow opens), and holds no store yet. Null ids come first; null and empty texts have the end id
    alone; rows that share an id follow each other by the first ``HEAD`` characters of the text, then by
    a hash of it, and are numbered from 0. Ids of 2 bytes need a vocabulary below 65,536; a larger id
    raises. Empty input gives a store without shards; other columns are not read.

    Shards are ranges of rows in that order, about one for each ``shard_bytes`` of text up to
    ``MAX_SHARDS``; their bounds come from an exchange of keys. As the order takes the text in, an id with
    many texts is spread over shards. Texts are encoded where they lie, once, and only ids are exchanged;
    a writer streams. Only one row per shard and per bucket reaches the driver. Tasks rename whole
    files into place, so a task that runs twice does no harm.
    """
    spark = docs.sparkSession
    fs, base = _store(root)
    if fs.get_file_info(f"{base}/manifest.json").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{root} holds a store already")
    fs.create_dir(base, recursive=True)
    keyed = _keyed(docs, id_col, text_col)
    bounds = _bounds(keyed, shard_bytes)
    ordered = _encoded(keyed, tokenizer, end_id, id_bytes, bounds).repartition(len(bounds) + 1, "lane").sortWithinPartitions("shard", *_order()).select("shard", "id", "ids")
    id_type = ordered.schema["id"].dataType
    rows_type = T.StructType([T.StructField("id", id_type), T.StructField("copy", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []

        def payload(shard: int, parts: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[bytes]:
            yield SHARD_MAGIC + np.uint64(id_bytes).astype("<u8").tobytes()
            at, last, copy = 0, object(), 0
            for _, part in parts:
                sizes = pc.binary_length(part.column("ids")).to_numpy().astype(np.int64) // id_bytes
                copies = []
                for doc in part.column("id").to_pylist():
                    copy, last = (copy + 1 if doc == last else 0), doc
                    copies.append(copy)
                ends = np.cumsum(sizes) + at
                rows.append(pa.RecordBatch.from_arrays([part.column("id"), pa.array(copies, pa.int32()), part.column("shard"), pa.array(ends - sizes), pa.array(sizes)], rows_type.names))
                at = int(ends[-1])
                yield b"".join(part.column("ids").to_pylist())

        for shard, parts in groupby(_shards_of(batches), key=lambda x: x[0]):
            _write(root, f"shard-{shard:07d}.ids", payload(shard, parts))
            yield from rows
            rows.clear()

    entries_at = f"{root}/entries"
    ordered.mapInArrow(write, rows_type).write.mode("overwrite").parquet(entries_at)
    entries = spark.read.schema(rows_type).parquet(entries_at)
    ends = entries.groupBy("shard").agg(F.sum("n").alias("ids"), F.count(F.lit(1)).alias("docs"), F.min_by("id", "at").alias("first"), F.max_by("id", "at").alias("last"), F.max_by("copy", "at").alias("copies"))
    sizes = sorted(ends.collect(), key=lambda r: r["shard"])
    shards, before, carried, known, last = [], 0, [], 0, object()
    for r in sizes:
        known = known if r["first"] == last else 0
        carried.append((r["shard"], known))
        # Rows of its last id up to the end of this shard, which the next one may go on with.
        known, last = r["copies"] + 1 + (known if r["first"] == r["last"] else 0), r["last"]
        shards.append({"shard": r["shard"], "ids": r["ids"], "before": before})
        before += r["ids"]
    buckets = max(1, -(-sum(r["docs"] for r in sizes) // bucket_keys))
    going_on = [(r["shard"], r["first"], n) for r, (_, n) in zip(sizes, carried) if n]
    if going_on:
        more = spark.createDataFrame(going_on, T.StructType([rows_type["shard"], T.StructField("begun", id_type), T.StructField("known", T.IntegerType())]))
        number = F.when(F.col("id").eqNullSafe(F.col("begun")), F.col("copy") + F.col("known")).otherwise(F.col("copy"))
        entries = entries.join(F.broadcast(more), "shard", "left").withColumn("copy", F.coalesce(number, "copy"))

    def build(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        h, p, at, n = (table.column(c).to_numpy() for c in ("h", "p", "at", "n"))
        _write(root, f"index-{bucket:07d}.mph", iter([_pack_index(h.view(np.uint64), p.view(np.uint64), table.column("shard").to_numpy(), at, n)]))
        return pa.table({"bucket": [bucket], "keys": [table.num_rows]})

    keyed = _hashes(entries.select(key_of(F.col("id"), F.col("copy")).alias("key"), "shard", "at", "n"), buckets)
    built = keyed.select("bucket", "h", "p", "shard", "at", "n").groupBy("bucket").applyInArrow(build, "bucket long, keys long").agg(F.sum("keys").alias("keys")).collect()
    manifest = {"ids": before, "keys": built[0]["keys"] or 0, "buckets": buckets, "id_bytes": id_bytes, "shards": shards}
    _write(root, "manifest.json", iter([json.dumps(manifest).encode()]))
    return TokenStore(root)


# ---- reader ----------------------------------------------------------------------------------------------------------


class TokenStore:
    """Reads what ``write_shards`` wrote."""

    def __init__(self, root: str):
        self.root = root
        self.manifest = json.loads(_read(root, "manifest.json"))
        self.before = {s["shard"]: s["before"] for s in self.manifest["shards"]}

    def get(self, doc_id, copy: int = 0) -> np.ndarray | None:
        """The ids of one document, by one index bucket and one read of a shard; None for an unknown key."""
        whole, h, p = _key_hashes(f"{chr(0) if doc_id is None else doc_id}#{copy}")
        signed = whole - (1 << 64) if whole >> 63 else whole
        name = f"index-{signed % self.manifest['buckets']:07d}.mph"
        fs, base = _store(self.root)
        if fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
            return None
        mph, entries = _open_index(_read(self.root, name))
        slot = int(mph.find(np.array([h], np.uint64))[0])
        if slot < 0 or int(entries["print"][slot]) != p:
            return None
        width, e = self.manifest["id_bytes"], entries[slot]
        with fs.open_input_file(f"{base}/shard-{int(e['shard']):07d}.ids") as file:
            return np.frombuffer(file.read_at(int(e["n"]) * width, SHARD_HEAD + int(e["at"]) * width), f"<u{width}").astype(np.uint32)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(id, copy) rows to (id, copy, shard, at, n): keys go to their buckets, one task opens a bucket's index; unknown keys drop out."""
        root = self.root
        id_type = keys.schema["id"].dataType
        out = T.StructType([T.StructField("id", id_type), T.StructField("copy", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])

        def find(table: pa.Table) -> pa.Table:
            mph, entries = _open_index(_read(root, f"index-{table.column('bucket')[0].as_py():07d}.mph"))
            slot = mph.find(table.column("h").to_numpy().view(np.uint64))
            known = slot >= 0
            known[known] = entries["print"][slot[known]] == table.column("p").to_numpy().view(np.uint64)[known]
            e = entries[slot[known]]
            kept = table.filter(pa.array(known))
            return pa.table({"id": kept.column("id"), "copy": kept.column("copy"), "shard": e["shard"].astype(np.int32), "at": e["at"].astype(np.int64), "n": e["n"].astype(np.int64)})

        hashed = _hashes(keys.select("id", F.col("copy").cast("int").alias("copy"), key_of(F.col("id"), F.col("copy")).alias("key")), self.manifest["buckets"])
        return hashed.drop("key").groupBy("bucket").applyInArrow(find, out)

    def digests(self, keys: DataFrame) -> DataFrame:
        """(id, copy, start, n_tokens, ids_crc32) of the payload that the index points to, each shard read once, in order."""
        root, before, width = self.root, self.before, self.manifest["id_bytes"]
        found = self.lookup(keys)
        out = T.StructType([T.StructField("id", found.schema["id"].dataType), T.StructField("copy", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

        def read(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            shard = table.column("shard")[0].as_py()
            fs, base = _store(root)
            crcs, held, held_at = [], b"", 0
            with fs.open_input_file(f"{base}/shard-{shard:07d}.ids") as file:
                if file.read_at(8, 0) != SHARD_MAGIC:
                    raise ValueError("not a shard file")
                for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist()):
                    a, b = SHARD_HEAD + at * width, SHARD_HEAD + (at + n) * width
                    if b > held_at + len(held) or a < held_at:
                        held, held_at = file.read_at(max(READ_BYTES, b - a), a), a
                    crcs.append(zlib.crc32(np.frombuffer(held, f"<u{width}", n, a - held_at).astype("<u4").tobytes()))
            return pa.table({"id": table.column("id"), "copy": table.column("copy"), "start": pa.array(table.column("at").to_numpy() + before[shard]), "n_tokens": table.column("n"), "ids_crc32": pa.array(crcs, pa.int64())})

        return found.groupBy("shard").applyInArrow(read, out)


def document_keys(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, copy) of every row. Counts of an id are opened in blocks, so no array grows with them."""
    counts = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    blocks = counts.select("id", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(KEY_BLOCK).cast("long"))).alias("low"))
    return blocks.select("id", F.explode(F.sequence("low", F.least(F.col("low") + KEY_BLOCK, "rows") - 1)).alias("copy")).withColumn("copy", F.col("copy").cast("int"))
