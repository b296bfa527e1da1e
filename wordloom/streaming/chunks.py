"""Finished chunks of a stream of timed words: left, mid and right together, once the watermark has passed their window."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import LEFT, MID, RIGHT, memberships
from ..session import Scratch

SIDES = ("left", "mid", "right")
#: Windows of a document that share a keyed state.
GROUP = 32
#: The state store that keeps lists and timers; Spark's default one does not.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"

_WORD = T.StructType([T.StructField("side", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("word", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
#: Words as they are kept: columns of up to ``HELD`` words, as a row of the state store costs far more than a word.
HELD = 1000
_HELD = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in (T.StructField("k", T.LongType()), *_WORD.fields)])
_SECTION = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), *[T.StructField(n, T.LongType()) for n in ("start_time", "end_time", "start_index", "end_index")]])


def section_of(words: list[tuple]) -> tuple | None:
    """(tokens, start_time, end_time, start_index, end_index) of words (idx, word, start, end), by index; None without any."""
    if not words:
        return None
    words = sorted(words, key=lambda w: (w[0], w[2], w[3], w[1] or ""))
    return [w[1] for w in words], words[0][2], words[-1][3], words[0][0], words[-1][0] + 1


def packed(words: list[tuple]) -> list[tuple]:
    """Rows of ``_HELD`` of words (k, side, idx, word, start, end)."""
    return [tuple(map(list, zip(*words[i : i + HELD]))) for i in range(0, len(words), HELD)]


class _Windows(StatefulProcessor):
    """The words of the open windows of a run of ``GROUP`` windows of one document. A timer, at the end of the first that is
    open, lets out all windows that have closed by then, so calls of the state store go by run and batch, not by window. A
    batch registers a timer for the first of its own windows, which may find nothing left to do."""

    def __init__(self, mid: int, right: int):
        self.mid, self.right = mid, right

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.words = handle.getListState("words", _HELD)

    def closes(self, origin: int, k: int) -> int:
        return origin + (k + 1) * self.mid + self.right

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        doc, origin, _ = key
        now, held, late = timerValues.getCurrentWatermarkInMs(), [], []
        for r in rows:
            if now >= self.closes(origin, r.k):
                late.append(Row(doc=doc, origin=origin, k=r.k, is_late=True, left=None, mid=None, right=None, text=None, word=Row(**{n: r[n] for n in _WORD.names})))
            else:
                held.append((r.k, r.side, r.idx, r.word, r.start, r.end))
        if held:
            self.handle.registerTimer(self.closes(origin, min(h[0] for h in held)))
            self.words.appendList(packed(held))
        yield from late

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        doc, origin, _ = key
        now, still = timerValues.getCurrentWatermarkInMs(), []
        closed: dict[int, dict[str, list[tuple]]] = {}
        for columns in self.words.get():
            for k, side, *word in zip(*columns):
                if now >= self.closes(origin, k):
                    closed.setdefault(k, {s: [] for s in SIDES})[side].append(tuple(word))
                else:
                    still.append((k, side, *word))
        if still:
            self.words.put(packed(still))
            self.handle.registerTimer(self.closes(origin, min(h[0] for h in still)))
        else:
            self.words.clear()
        for k, held in sorted(closed.items()):
            left, mid, right = (section_of(held[s]) for s in SIDES)
            if mid and mid[1] and mid[2]:
                text = "|".join(" ".join(w or "" for w in s[0]) if s else "" for s in (left, mid, right))
                left, mid, right = (Row(**dict(zip(_SECTION.names, s))) if s else None for s in (left, mid, right))
                yield Row(doc=doc, origin=origin, k=k, is_late=False, left=left, mid=mid, right=right, text=text, word=None)

    def close(self) -> None:
        pass


def stream_chunks(words: DataFrame, *, left: int = LEFT, mid: int = MID, right: int = RIGHT, late: str = "10 minutes") -> DataFrame:
    """(doc, origin, k, is_late, left, mid, right, text, word) of streamed words (doc, origin, idx, word, start, end).

    origin is a document's beginning in milliseconds from the epoch, start and end of a word are milliseconds from there,
    so a word's event time is origin + start. Words may arrive in any order. A word goes to the windows that it is mid,
    left or right context of, three at most, and each ``GROUP`` windows of a document are a keyed state: a window's words are
    kept until the watermark, ``late`` behind the newest word, passes the end of its right context. Then the chunk comes out
    once, with the sections and the text ``left|mid|right``, and its state goes. Windows without a word in the middle, or
    whose middle begins or ends at 0, give no chunk, as in ``operators.windows.chunks``. A word that comes after its window
    has closed comes out by itself, is_late and ``word`` set, so nothing is dropped in silence: filter on is_late for a
    side output. Words without doc, origin, start or end are left out. Contexts may be no longer than ``mid``.

    Needs the state store ``STORE`` (``STORE_KEY``).
    """
    if max(left, right) > mid:
        raise ValueError("a context is longer than its window")
    if words.sparkSession.conf.get(STORE_KEY, "") != STORE:
        raise ValueError(f"set {STORE_KEY} to {STORE}")
    if not words.isStreaming:
        raise ValueError("timers need a stream: see finished_chunks")
    known = words.where("doc is not null and origin is not null and start is not null and `end` is not null")
    timed = known.withColumn("at", F.timestamp_millis(F.col("origin") + F.col("start"))).withWatermark("at", late)
    # The time column stays behind: with it Spark would drop late rows before they could be told.
    rows = timed.select("doc", "origin", F.explode(memberships(F.col("start"), left, mid, right)).alias("m"), F.col("idx").cast("long").alias("idx"), "word", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    rows = rows.select("doc", F.col("origin").cast("long").alias("origin"), "m.k", "m.side", "idx", "word", "start", "end")
    fields = [rows.schema["doc"], T.StructField("origin", T.LongType()), T.StructField("k", T.LongType()), T.StructField("is_late", T.BooleanType()), *[T.StructField(s, _SECTION) for s in SIDES], T.StructField("text", T.StringType()), T.StructField("word", _WORD)]
    rows = rows.withColumn("run", F.expr(f"k div {GROUP}"))
    return rows.groupBy("doc", "origin", "run").transformWithState(statefulProcessor=_Windows(mid, right), outputStructType=T.StructType(fields), outputMode="Append", timeMode="EventTime")


#: The first millisecond of 2100: a word at that time closes all windows before it.
END_OF_TIME = 4_102_444_800_000


def finished_chunks(words: DataFrame, *, files: int = 1000, late: str = "36500 days", **options) -> DataFrame:
    """``stream_chunks`` of a finished table, replayed as a stream of ``files`` files at a time, with the session's state
    store set meanwhile. ``late`` is wide, so words may come in any order and none is late; a word at ``END_OF_TIME`` plus
    that delay, written last, closes all windows but its own, which stays open. Words must lie before that time."""
    spark = words.sparkSession
    scratch = Scratch(spark, "stream")
    words.write.parquet(scratch.path("words"))
    delay = F.unix_millis(F.lit("1970-01-01 00:00:00").cast("timestamp_ltz") + F.expr(f"interval {late}"))
    closing = words.where("doc is not null").limit(1).select("doc", (F.lit(END_OF_TIME) + delay).alias("origin"), F.lit(0).alias("idx"), F.lit("").alias("word"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    closing.select(*[F.col(f.name).cast(f.dataType) for f in words.schema]).coalesce(1).write.mode("append").parquet(scratch.path("words"))
    before = spark.conf.get(STORE_KEY)
    spark.conf.set(STORE_KEY, STORE)
    try:
        source = spark.readStream.schema(words.schema).option("maxFilesPerTrigger", files).parquet(scratch.path("words"))
        chunks = stream_chunks(source, late=late, **options)
        chunks.writeStream.format("parquet").option("checkpointLocation", scratch.path("state")).trigger(availableNow=True).start(scratch.path("chunks")).awaitTermination()
    finally:
        spark.conf.set(STORE_KEY, before)
    return spark.read.schema(chunks.schema).parquet(scratch.path("chunks"))
