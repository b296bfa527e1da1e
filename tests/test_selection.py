"""Columns of any name in selections, and limits that refuse instead of guessing."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions.sequence import word_distance
from wordloom.operators import collate, selection, windows
from wordloom.sources.transcripts import write_log


def test_clashing_names(spark):
    kind = "p int, ok boolean, _known string, _row string, _spare string, before int, inside int, `a.b` string"
    rows = spark.createDataFrame([(0, True, "k", "r", "s", 1, 2, "x"), (1, False, "k1", "r1", "s1", 3, 4, "y")], kind)
    ids = spark.createDataFrame([(1,), (1,)], "value int")
    assert [r["_known"] for r in selection.select_ids(rows, ids, "p", strict=True).collect()] == ["k1", "k1"]
    assert {(r["_row"], r["a.b"]) for r in selection.last_wins(rows, "ok", "p").collect()} == {("r", "x"), ("r1", "y")}
    assert {(r.p, r.used, r["_spare"], r["a.b"]) for r in selection.substitute(rows, "p", "ok", 30).collect()} == {(0, 0, "s", "x"), (1, 0, "s", "x")}
    with pytest.raises(ValueError, match="column"):
        selection.substitute(rows, "p", "ok", used="before")
    assert {(r.p, r.before) for r in selection.whole_batches(rows, "p", 1, 1).collect()} == {(0, 1), (1, 3)}
    assert {(r.p, r.inside, r.global_chunk_number) for r in windows.number_chunks(rows, doc="p", order="ok").collect()} == {(0, 2, 0), (1, 4, 1)}


def test_word_distance_refuses_too_many_words(spark):
    rows = spark.range(1).select(F.sequence(F.lit(1), F.lit(60_000)).cast("array<string>").alias("a"), F.array(F.lit("x")).alias("b"))
    with pytest.raises(Exception, match="distinct words"):
        rows.select(word_distance(F.col("a"), F.col("b"))).collect()
    few = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("a"), F.array(F.lit("b")).alias("b"))
    assert few.select(word_distance(F.col("a"), F.col("b")).alias("d")).first().d == 1


def test_collation(spark):
    rows = spark.createDataFrame([(i, [9] * (i % 3 == 0 or i > 6) + list(range(i)), i) for i in range(12)], "k int, ids array<int>, width int")
    got = {r.k: r for r in collate.collated(collate.length_batches(rows.drop("width"), "k", "ids", 5), "ids", 9, multiple=4, pad_id=7).collect()}
    assert [got[k].batch for k in (1, 0, 2, 4, 3)] == [0] * 5 and not got[0].cut and got[0].labels == [9, -100, -100, -100]
    last = [r for r in got.values() if r.batch == 2]
    assert all(r.cut and r.width == len(r.labels) == len(r.decoder_input_ids) == 11 for r in last)
    assert got[10].labels == [*range(10), -100] and got[10].decoder_input_ids == [9, *range(10)] and got[11].labels == list(range(11))
    assert collate.collated(collate.length_batches(rows.where("k < 0").drop("width"), "k", "ids", 5), "ids", 9).count() == 0
    odd = spark.createDataFrame([(1, [], 0), (2, [], 0)], "k int, ids array<int>, batch int")
    assert {(tuple(r.labels), tuple(r.decoder_input_ids)) for r in collate.collated(odd, "ids", 9).collect()} == {((), ())}


def test_log_is_written_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, "loss", float(i)) for i in range(10)], "step int, measure string, value double")
    write_log(rows, path, "a")
    write_log(rows, path, "a")
    write_log(rows.limit(2), path, "b")
    write_log(rows.withColumn("step", F.col("step") + 10), path, "a", first=10)
    write_log(rows.withColumn("step", F.col("step") + 10), path, "a", first=10)
    got = sorted((r.run, r.step) for r in spark.read.parquet(path).collect())
    assert got == [("a", i) for i in range(20)] + [("b", 0), ("b", 1)]
