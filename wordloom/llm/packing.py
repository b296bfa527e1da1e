"""Best-fit packing of documents into sequences of bounded length, improved by a swap-based local search."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .tokens import END_ID, WordEncoder, slices

#: Pieces that one task packs, on average.
GROUP_PIECES = 30_000
#: Bins below this share of the capacity meet in another round, across groups.
FULL_SHARE = 0.995
#: Rounds at most; what is loose after the last one stays in its bins. The number is part of sequence ids.
ROUNDS = 100


# ---- one group -------------------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with room. Gaps are bits of one integer."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = {}
    gaps = 0
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        room = gaps >> n
        if room:
            gap = n + (room & -room).bit_length() - 1
            stack = by_gap[gap]
            which = stack.pop()
            if not stack:
                gaps ^= 1 << gap
        else:
            gap, which = capacity, len(bins)
            bins.append([])
        bins[which].append(item)
        if gap > n:
            stack = by_gap.setdefault(gap - n, [])
            if not stack:
                gaps |= 1 << (gap - n)
            stack.append(which)
    return bins


def _exchange(a: list[int], b: list[int], lengths: list[int], gap: int, least: int) -> tuple[int, list[int], list[int]] | None:
    """What to take from a and give back from b so that b gains most, at least ``least`` and at most ``gap``: a move,
    one for one or two for one."""
    best, found = least - 1, None
    sizes = sorted((lengths[i], i) for i in b)
    only = [n for n, _ in sizes]

    def consider(n: int, out: list[int]) -> None:
        nonlocal best, found
        if best < n <= gap:
            best, found = n, (n, out, [])
        k = bisect.bisect_left(only, n - gap)
        if k < len(only) and n - only[k] > best:
            best, found = n - only[k], (n - only[k], out, [sizes[k][1]])

    for x, i in enumerate(a):
        consider(lengths[i], [i])
        if best == gap:
            return found
    for x, i in enumerate(a):
        for j in a[x + 1 :]:
            consider(lengths[i] + lengths[j], [i, j])
            if best == gap:
                return found
    return found


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, partners: int = 64) -> list[list[int]]:
    """Exchange items between underfull bins while the sum of squared fills grows; bins that empty go.

    The emptiest bin gives to the fullest underfull ones; each exchange that leaves the receiver
    fuller than the giver was raises the sum, which is an integer with an upper bound, so the search
    ends. A giver tries up to ``partners`` receivers in a pass and is closed when none can gain.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_bins = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    while len(open_bins) > 1:
        giver = open_bins.pop(0)
        stuck = False
        while bins[giver] and not stuck:
            stuck = True
            for receiver in open_bins[-1 : -partners - 1 : -1] + open_bins[:partners]:
                gap = capacity - fill[receiver]
                least = max(1, fill[giver] - fill[receiver] + 1)
                if gap < least:
                    continue
                found = _exchange(bins[giver], bins[receiver], lengths, gap, least)
                if found is None:
                    continue
                gain, out, back = found
                bins[giver] = [i for i in bins[giver] if i not in out] + back
                bins[receiver] = [i for i in bins[receiver] if i not in back] + out
                fill[giver] -= gain
                fill[receiver] += gain
                stuck = False
                open_bins.remove(receiver)
                if fill[receiver] < capacity:
                    bisect.insort(open_bins, receiver, key=lambda b: fill[b])
                break
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


# ---- the corpus ------------------------------------------------------------------------------------------------------


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and end id; only longer documents are cut."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = T.StructType([rows.schema["id"], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                bounds, ids = encoder.encode(part.column("text"), end_id)
                counts = -(-np.diff(bounds) // capacity)
                doc = np.repeat(np.arange(part.num_rows), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(bounds)[doc] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                first = bounds[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, kind)


def _packed(pieces: DataFrame, groups: int, round_: int, capacity: int) -> DataFrame:
    kind = T.StructType([*[f for f in pieces.schema.fields if f.name in ("id", "piece", "start", "length", "ids_crc32", "salt")], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType())])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["part"].iloc[0])
        frame = frame.sort_values(["length", "ids_crc32", "start"], kind="stable").reset_index(drop=True)
        lengths = frame["length"].tolist()
        which, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for number, items in enumerate(pack(lengths, capacity)):
            at = 0
            for i in items:
                which[i], offset[i] = number, at
                at += lengths[i]
            fill[items] = at
        return frame[["id", "piece", "start", "length", "ids_crc32", "salt"]].assign(sequence_id=(round_ << 56) + (group << 28) + which, offset=offset, fill=fill)

    part = F.pmod(F.xxhash64("salt", F.lit(round_)), F.lit(groups))
    return pieces.withColumn("part", part).groupBy("part").applyInPandas(one, kind)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Columns, per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts
    hold the end id alone. Repeated rows are packed once each. Empty input gives an empty result;
    other columns are not read.

    Texts are encoded once, in place; only six numbers per piece are shuffled, into groups of about
    ``group_pieces`` by a hash of a number that the piece's row got when it was written, so equal rows go to
    different groups. Groups are packed apart;
    then the pieces of bins that are not full meet in fewer groups and are packed again, until one
    group is left or the number of groups stops shrinking.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = cut_pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col, end_id=end_id)
    left = scratch.keep(pieces.withColumn("salt", F.monotonically_increasing_id()), "pieces")
    done: DataFrame | None = None
    groups = max(1, -(-left.count() // group_pieces))
    for round_ in range(ROUNDS):
        packed = scratch.keep(_packed(left, groups, round_, capacity), f"round{round_}")
        loose = packed.where(F.col("fill") < int(capacity * FULL_SHARE))
        fewer = max(1, -(-loose.count() // group_pieces)) if groups > 1 else groups
        last = fewer >= groups or round_ + 1 == ROUNDS
        kept = packed if last else packed.where(F.col("fill") >= int(capacity * FULL_SHARE))
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        left, groups = loose.drop("sequence_id", "offset", "fill"), fewer
    return done.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
