"""Chunks of a stream against those of the finished recordings."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wordloom.operators import windows
from wordloom.streaming.chunks import STORE, STORE_KEY, finished_chunks, stream_chunks

KIND = "doc string, origin long, idx long, word string, start long, end long"


@pytest.fixture
def store(spark):
    before = spark.conf.get(STORE_KEY)
    spark.conf.set(STORE_KEY, STORE)
    yield
    spark.conf.set(STORE_KEY, before)


def recordings(rng):
    rows = []
    for d in range(8):
        at = rng.randrange(1, 3000)
        for i in range(rng.randrange(1, 120)):
            at += rng.randrange(900)
            rows.append((f"d{d}", 1_000_000 * d, i, f"w{i}", at, at + rng.randrange(1, 800)))
    return rows


def batch_chunks(spark, rows):
    """The same by the batch operators: sections, chunks and their tokens."""
    words = spark.createDataFrame(rows, KIND)
    chunks = windows.chunks(windows.sections(windows.window_members(words)))
    out = windows.with_section_tokens(chunks, words)
    part = lambda s: tuple(s) if s and s.start_index is not None else None
    return sorted((r.doc, r.k, part(r.left), part(r.mid), part(r.right)) for r in out.collect())


def parts(r):
    return (r.doc, r.k, *[tuple(x) if x else None for x in (r.left, r.mid, r.right)])


def run(spark, source, name, **options):
    stream = stream_chunks(source, **options).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.table(name).collect()


def test_stream_equals_batch_on_shuffled_arrival(spark, tmp_path: Path, store):
    rng = random.Random(6)
    rows = recordings(rng)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for i in range(4):
        spark.createDataFrame(shuffled[i::4], KIND).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    spark.createDataFrame([("end", 10**12, 0, "x", 0, 1)], KIND).coalesce(1).write.parquet(str(tmp_path / "part8"))
    spark.createDataFrame([("end", 10**12, 1, "y", 1, 2)], KIND).coalesce(1).write.parquet(str(tmp_path / "part9"))
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
    out = run(spark, source, "chunks", late="20000 days")
    assert not out  # nothing is final while words that old may still come
    out = run(spark, spark.readStream.schema(KIND).option("maxFilesPerTrigger", 6).parquet(str(tmp_path / "part[0-8]")), "chunks_more", late="10 seconds")
    want = batch_chunks(spark, rows)
    got = [r for r in out if r.doc != "end"]
    assert sorted(map(parts, got), key=repr) == sorted(want, key=repr) and not any(r.is_late for r in got)
    assert all(r.text == "|".join(" ".join(s.tokens) if s else "" for s in (r.left, r.mid, r.right)) for r in got)
    finished = finished_chunks(spark.createDataFrame(shuffled, KIND)).collect()
    assert sorted(map(parts, finished), key=repr) == sorted(want, key=repr) and spark.conf.get(STORE_KEY) == STORE


def test_late_words_come_out_by_themselves(spark, tmp_path: Path, store):
    """The second file moves the watermark past the first window; a word for it comes after that."""
    files = [[(0, 1000), (1, 18_000), (2, 21_000)], [(9, 95_000)], [(10, 97_000)], [(3, 19_500), (11, 98_000)], [(12, 300_000)], [(13, 301_000)]]
    for i, words in enumerate(files):
        spark.createDataFrame([("d", 0, idx, f"w{idx}", at, at + 400) for idx, at in words], KIND).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
    out = run(spark, source, "late_chunks", late="10 seconds")
    chunks = {r.k: r.text for r in out if not r.is_late}
    assert chunks[0] == "|w0 w1|w2" and chunks[1] == "w1|w2|" and chunks[4] == "|w9 w10 w11|"
    assert {(r.k, r.word.side, r.word.word) for r in out if r.is_late} == {(0, "mid", "w3"), (1, "left", "w3")}


def test_odd_words(spark, store):
    rows = [("d", 0, 0, "a", 0, 10), ("d", 0, 1, "b", 500, None), (None, 0, 1, "c", 5, 6), ("d", None, 1, "c", 5, 6), ("e", 0, 0, None, 5, 6), ("e", 0, 1, "", 7, 8)]
    got = finished_chunks(spark.createDataFrame(rows, KIND)).collect()
    assert [(r.doc, r.mid.tokens) for r in got] == [("e", [None, ""])]
    assert finished_chunks(spark.createDataFrame([], KIND)).count() == 0
    with pytest.raises(ValueError, match="stream"):
        stream_chunks(spark.createDataFrame(rows, KIND))
    with pytest.raises(ValueError, match="longer"):
        stream_chunks(spark.createDataFrame(rows, KIND), left=30_000)
    spark.conf.set(STORE_KEY, "other")
    with pytest.raises(ValueError, match="stateStore"):
        stream_chunks(spark.createDataFrame(rows, KIND))


def test_a_run_of_windows_shares_one_timer(spark, tmp_path: Path, store, monkeypatch):
    """Windows of one run close one by one as the stream goes on, and all at once where it ends; a run's end is no gap. A
    word for an earlier window than the one that the timer waits for brings the timer forward."""
    from wordloom.streaming import chunks as C

    files = [[(1, 45_000)], [(0, 1000)], [(2, 61_000), (3, 100_000)], [(i, 20_000 * i + 500) for i in range(6, 80)], [(99, 9_000_000)], [(100, 9_000_001)]]
    for i, words in enumerate(files):
        spark.createDataFrame([("d", 0, idx, f"w{idx}", at, at + 400) for idx, at in words], KIND).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
    out = run(spark, source, "timed_chunks", late="50 seconds")
    text = {r.k: r.text for r in out if not r.is_late}
    assert not any(r.is_late for r in out) and len(text) == sum(not r.is_late for r in out)
    assert text[0] == "|w0|" and text[2] == "|w1|w2" and text[5] == "|w3|w6"
    assert {k: t for k, t in text.items() if 6 <= k < 79} == {k: f"|w{k}|w{k + 1}" for k in range(6, 79)}
    assert C.GROUP < 79


def test_state_is_called_by_run_not_by_window():
    """Forty windows that come and close together cost as many calls of the state store as one."""
    from pyspark.sql import Row
    from wordloom.streaming.chunks import _Windows

    calls, timers = [], set()

    class Handle:
        def registerTimer(self, at):
            calls.append(at)
            timers.add(at)

        def deleteTimer(self, at):
            calls.append(at)
            timers.discard(at)

        def getListState(self, *_):
            return Kept([])

        def getValueState(self, *_):
            return Kept(None)

    class Kept:
        def __init__(self, value):
            self.value = value

        def get(self):
            calls.append("get")
            return self.value

        def appendList(self, rows):
            calls.append("append")
            self.value = self.value + rows

        def update(self, value):
            calls.append("update")
            self.value = value

        put = update

        def clear(self):
            calls.append("clear")
            self.value = [] if isinstance(self.value, list) else None

    class At:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    windows_ = _Windows(20_000, 5_000)
    windows_.init(Handle())
    rows = [Row(k=k, side="mid", idx=k, word=f"w{k}", start=20_000 * k + 1, end=20_000 * k + 2) for k in range(40)]
    assert not list(windows_.handleInputRows(("d", 0, 0), iter(rows), At(0))) and timers == {25_000} and len(calls) <= 4
    calls.clear()
    timers.clear()
    assert [r.k for r in windows_.handleExpiredTimer(("d", 0, 0), At(745_000), None)] == list(range(37)) and timers == {765_000} and len(calls) <= 4 and len(windows_.words.value) == 1
    calls.clear()
    assert [r.k for r in windows_.handleInputRows(("d", 0, 0), iter(rows[:1]), At(745_000)) if r.is_late] == [0] and not calls
    assert [r.text for r in windows_.handleExpiredTimer(("d", 0, 0), At(10**9), None)] == [f"|w{k}|" for k in (37, 38, 39)] and len(calls) <= 3
