"""Windows, entities, segments, sources and plans on small documents."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import entities, evaluation, selection, windows
from wordloom.plans.corpus import build_chunks, evaluate, split_rows, sweep, training_rows
from wordloom.sources import transcripts as T
from wordloom.streaming.windows import stream_sections


def words_frame(spark, rows):
    return spark.createDataFrame(rows, "doc string, idx int, word string, start long, end long")


def test_window_golden(spark):
    spans = [(10100, 10400), (15000, 15200), (19900, 20100), (20000, 20300), (25000, 25100)]
    words = words_frame(spark, [("d", i, f"w{i}", s, e) for i, (s, e) in enumerate(spans)])
    got = {(r.word, r.k, r.side) for r in windows.window_members(words).collect()}
    assert got == {("w0", 0, "mid"), ("w1", 0, "mid"), ("w1", 1, "left"), ("w2", 0, "mid"), ("w2", 1, "left"), ("w3", 1, "mid"), ("w3", 0, "right"), ("w4", 1, "mid")}
    strict = {(r.word, r.k, r.side) for r in windows.window_members(words, strict=True).collect()}
    assert strict == got - {("w2", 0, "mid"), ("w2", 1, "left")}
    assert windows.chunks(windows.sections(windows.window_members(words))).count() == 2
    moved = words.withColumn("start", F.when(F.col("idx") == 0, 0).otherwise(F.col("start")))
    assert [r.k for r in windows.chunks(windows.sections(windows.window_members(moved))).collect()] == [1]


@pytest.mark.parametrize(("left", "mid", "right"), [(5, 20, 5), (7, 7, 7), (30, 8, 45), (0, 10, 0)])
def test_windows_match_scan(spark, left, mid, right):
    rng = random.Random(left)
    rows = []
    for d in range(40):
        at = rng.randrange(30)
        for i in range(rng.randrange(1, 25)):
            at += rng.randrange(9)
            rows.append((f"d{d}", i, "w", at, at + rng.randrange(4)))
    want = set()
    for d in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == d)
        own.sort(key=lambda r: r[1])
        k = 0
        while k * mid < own[-1][4]:
            for side, low, high in (("left", max(0, k * mid - left), k * mid), ("mid", k * mid, (k + 1) * mid), ("right", (k + 1) * mid, (k + 1) * mid + right)):
                want |= {(d, k, side, r[1]) for r in own if low <= r[3] < high}
            k += 1
    got = {(r.doc, r.k, r.side, r.idx) for r in windows.window_members(words_frame(spark, rows), left, mid, right).collect()}
    assert got == want


def test_rules(spark):
    rows = [("555-123-4567", "x", "PHONE_NUM"), ("123-4567-ext", "x", "PHONE_NUM"), ("10AM", "x", "TIME"), ("AMD64", "x", "TIME"), ("a@b.com", "x", "EMAIL"), ("www.x.org", "x", "URL"), ("0-19-852663-6", "ISBN", "ISBN"), ("0-19-852663-6", "ISBN ", None), ("hello", None, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string, want string")
    assert all(r.got == r.want for r in frame.select("want", entities.rule_label(F.col("t"), F.col("p")).alias("got")).collect())


def token_rows(spark, pairs, doc="d"):
    return entities.with_offsets(spark.createDataFrame([(doc, i, n, p) for i, (n, p) in enumerate(pairs)], "doc string, pos int, ntok string, ptok string"))


def test_entities_and_tags(spark):
    pairs = [("call", "call "), ("", "+1 "), ("five five five one two three four", "555-1234 "), ("at", "at "), ("ten a m", "10AM "), ("twenty", "20"), ("", ".")]
    tokens = token_rows(spark, pairs)
    assert [(r.nstart, r.nend) for r in tokens.orderBy("pos").collect()] == [(0, 1), (1, 1), (1, 8), (8, 9), (9, 12), (12, 13), (13, 13)]

    def tagger(frame):
        import pandas as pd

        return pd.DataFrame({"val": ["at 10AM"], "label": ["TIME"], "puncted_start": [3], "puncted_end": [5]})

    found = entities.tag_all(tokens, tagger)
    assert [(r.label, r.puncted_start, r.puncted_end, r.nstart, r.nend) for r in found.orderBy("ord").collect()] == [("PHONE_NUM", 1, 3, -1, 8), ("TIME", 3, 5, 8, 12), ("NUMERIC", 5, 6, 12, 13)]
    tagged = [r.tagged for r in entities.embed_tags(tokens, found).orderBy("pos").collect()]
    assert tagged == ["call ", "<PHONE_NUM>+1 ", "555-1234</PHONE_NUM> ", "<TIME>at ", "10AM</TIME> ", "<NUMERIC>20</NUMERIC>", "."]


def test_spans_of_a_model(spark):
    """Characters are code points; spans inside tokens, across an empty one, beyond the text and before it."""
    spans = [("5", "MONEY", 3, 4), ("5 %", "PERCENT", 5, 8), ("a", "ORG", 1, 2), ("x", "ORG", -1, 2), ("é😀 $5", "ORG", 0, 5), ("z", "DATE", 5, 90), ("$5", "DATE", 2, 2), ("5", "MONEY", 0, 2)]
    docs = spark.createDataFrame([(1, ["é😀", "$5", "", " 5% ", "z"]), (2, []), (3, None), (None, ["z"])], "doc int, ptoks array<string>")
    found = entities.span_entities(docs, lambda ptoks: tuple(zip(*spans)) if len(ptoks) == 5 else (["z"] * len(ptoks), ["X"] * len(ptoks), [0] * len(ptoks), [1] * len(ptoks)))
    got = sorted(tuple(r) for r in found.where("doc is not null").collect())
    assert got == [(1, "$5", "MONEY", 1, 2), (1, "5", "MONEY", 0, 1)]
    assert [tuple(r) for r in found.where("doc is null").collect()] == [(None, "z", "X", 0, 1)]


def test_span_tokens_match_plain():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 1, 2, 5]) for _ in range(rng.randrange(9))]
        stops = [sum(sizes[: i + 1]) for i in range(len(sizes))]
        spans = [(rng.randrange(-2, 20), rng.randrange(-2, 20)) for _ in range(40)]
        begins = {e - n: i for i, (e, n) in enumerate(zip(stops, sizes)) if n}
        ends = {at: i + 1 for i, (e, n) in reversed(list(enumerate(zip(stops, sizes)))) if n for at in (e, e - 1)}
        want = [(begins[a], ends[b]) if a in begins and b in ends and ends[b] > begins[a] else (0, 0) for a, b in spans]
        first, last = entities.span_tokens(np.array(sizes, np.int64), *(np.array(x, np.int64) for x in zip(*spans)))
        assert list(zip(first.tolist(), last.tolist())) == want


def test_merge_keeps_other_overlaps(spark):
    one = spark.createDataFrame([("d", "a", "", "TIME", 0, 2, 0, 2, 1), ("d", "b", "", "DATE", 1, 3, 0, 2, 2)], "doc string, val string, normalized_val string, label string, puncted_start int, puncted_end int, nstart int, nend int, ord long")
    two = spark.createDataFrame([("d", "c", "", "TIME", 1, 4, 0, 2, 1), ("d", "e", "", "TIME", 0, 1, 0, 2, 2), ("d", "f", "", "TIME", 8, 9, 0, 2, 3)], one.schema)
    assert [r.val for r in entities.merge_overlapping(one, two).orderBy("rank").collect()] == ["c", "a", "b", "f"]


def xml_of(sentences):
    body = ""
    for sentence in sentences:
        tokens = "".join(f"<t>{text}" + "".join(f'<n pronunciation="{w}"' + (f' start="{s}" end="{e}"' if s is not None else "") + "/>" for w, s, e in words) + "</t>" for text, words in sentence)
        body += f"<s>{tokens}</s>"
    return f"<article><d><p>{body}</p></d></article>"


def test_xml(spark, tmp_path: Path):
    good = [("He", [("he", 100, 200)]), ("paid", [("_paid", 200, 300)]), ("$", [("x", 1, 2)]), ("5", [("five", 300, 400), ("dollars", None, None)]), (".", [])]
    bad_first, bad_time = [(",", [])], [("x", [("x", "a", 2)])]
    folder = tmp_path / "Some_Doc"
    folder.mkdir()
    (folder / "aligned.swc").write_text(xml_of([good, bad_first, bad_time, [("(", []), ("ok", [("ok", 500, 600)])]]))
    (tmp_path / "Broken").mkdir()
    (tmp_path / "Broken" / "aligned.swc").write_text("<article><p>")
    parsed = {r.doc: r for r in T.read_aligned(spark, str(tmp_path)).collect()}
    assert parsed["Broken"].sentences == []
    first, second = parsed["Some_Doc"].sentences
    assert first.ptoks == ["He ", "paid ", "$5", "."] or first.ptoks == ["He ", "paid ", "$5", "."]
    assert first.ntoks == ["he", "paid", "five dollars", ""] and len(first.times) == 4 and first.times[3].start is None
    assert second.ptoks == ["(", "ok"] and second.ntoks == ["", "ok"]


def test_build_chunks(spark, tmp_path: Path):
    """Sixty one-second words with a two-word token over a boundary, an entity there, and a word without a time."""
    sentence, at = [], 500
    for i in range(60):
        if i == 19:
            sentence.append(("555-1234", [("five", at, at + 900), ("four", at + 1000, at + 1900)]))
            at += 2000
        else:
            sentence.append((f"w{i}", [(f"w{i}", None if i == 10 else at, None if i == 10 else at + 900)]))
            at += 1000
    files = spark.createDataFrame([("doc", xml_of([sentence])), ("empty", xml_of([[("x", [])]]))], "doc string, xml string")
    parsed = T.parse_aligned(files)
    docs = build_chunks(parsed).cache()
    rows = docs.collect()
    assert [r.filename for r in rows] == ["doc"]
    chunks = rows[0].chunks
    assert [c.global_chunk_number for c in chunks] == list(range(len(chunks))) and len(chunks) == 2
    for c in chunks:
        left, mid, right = c.segmented_puncted_text.split("|")
        assert " ".join(f"{left} {mid} {right}".split()) == " ".join(c.puncted_text.split())
    assert "w10" in chunks[0].mid.tokens and "<PHONE_NUM>555-1234</PHONE_NUM>" in chunks[0].puncted_text
    assert chunks[0].left.start_index is None and chunks[0].segmented_puncted_text.startswith("|w0")
    tail = build_chunks(parsed, keep_tail=True).first().chunks
    assert len(tail) > len(chunks) and tail[-1].segmented_puncted_text.split("|")[1].endswith("w59")
    T.write_chunks(docs, str(tmp_path / "chunks"))
    again = T.read_chunks(spark, str(tmp_path / "chunks"))
    assert [r.asDict(True) for r in again.collect()] == [r.asDict(True) for r in rows]
    flat = split_rows(again, spark.createDataFrame([("doc",), ("doc",)], "value string").withColumnRenamed("value", "value"), "filename")
    encoded = training_rows(flat).orderBy("chunk_id").collect()
    assert len(encoded) == 2 and encoded[0].encoded.startswith("<|left|><|0.00|> <|0.00|><|0.00|><|mid|>")
    assert training_rows(flat, windowed=False).count() == 2
    assert selection.chunk_dictionary(again.unionByName(again)).count() == 2
    assert T.unfinished(parsed, docs.withColumnRenamed("filename", "doc")).count() == 1


def test_numbering_spans_documents(spark):
    rows = spark.createDataFrame([(f"d{d:03}", k) for d in range(40) for k in range(d % 4)], "doc string, k int")
    got = [r.global_chunk_number for r in windows.number_chunks(rows).orderBy("doc", "k").collect()]
    assert got == list(range(len(got))) and len(got) == rows.count()


def test_selection(spark):
    rows = spark.createDataFrame([(0, True, "a"), (1, False, "b"), (31, False, "c"), (60, True, "d"), (61, False, "e"), (2, None, "f")], "p int, ok boolean, v string")
    got = {(r.p, r.used, r.v) for r in selection.substitute(rows, "p", "ok", 30).collect()}
    assert got == {(0, 0, "a"), (60, 60, "d"), (1, 0, "a"), (31, 1, "b"), (61, 2, "f"), (2, 0, "a")}
    ids = spark.createDataFrame([(1,), (1,), (99,)], "value int")
    assert selection.select_ids(rows, ids, "p").count() == 2
    with pytest.raises(Exception, match="unknown id 99"):
        selection.select_ids(rows, ids, "p", strict=True).collect()


def test_evaluation(spark):
    refs = spark.createDataFrame([("a", "<PERSON>Ann Lee</PERSON> went there."), ("b", "You go there.")], "doc string, text string")
    hyps = spark.createDataFrame([("a", "[PERSON]Ann lee[/PERSON] goes there,"), ("b", "You went there yaaa!"), ("c", "x")], "doc string, text string")
    out = evaluate(refs, hyps, "doc")
    errors = {r.doc: r for r in out["errors"].collect()}
    assert (errors["b"].hits, errors["b"].substitutions, errors["b"].deletions, errors["b"].insertions) == (2, 1, 0, 1)
    assert round(errors["b"].wer, 6) == round(2 / 3, 6)
    assert {(r.doc, r.label, r.tp, r.fp, r.fn) for r in out["spans"].collect()} == {("a", "PERSON", 1, 0, 0)}
    case = {r.doc: r for r in out["case"].collect()}
    assert (case["a"].tp, case["a"].fn, case["a"].tn) == (2, 1, 1)
    marks = {(r.doc, r.mark): (r.tp, r.fp, r.fn) for r in out["marks"].collect()}
    assert marks["a", "."] == (0, 0, 1) and ("a", ",") not in marks and marks["b", "."] == (0, 0, 1)
    assert out["labels"].where("label = 'PERSON'").first()["mean"] < 1
    assert sweep(refs, {"one": hyps, "two": refs}).count() == 2
    untagged = evaluate(refs, hyps.withColumn("text", F.regexp_replace("text", r"\[/?[A-Z]+\]", "")), tagged=False)
    assert untagged["labels"].first()["label"] == "PERSON" and "spans" not in untagged


def test_long_deletion_cuts(spark):
    ref = " ".join(f"w{i}" for i in range(60))
    pairs = spark.createDataFrame([("cut", ref, "w0 w1 w2"), ("whole", ref, "none")], "doc string, ref string, hyp string")
    got = {r.doc: r for r in evaluation.aligned(pairs).collect()}
    assert len(got["cut"].tokens) == 3 and got["cut"].ref == "w0 w1 w2"
    assert len(got["whole"].tokens) in (60, 61)


def test_stream_equals_batch(spark, tmp_path: Path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    sizes = {"left_s": 21600, "mid_s": 86400, "right_s": 21600, "late": "4000 days"}
    stream = stream_sections(source, **sizes).writeStream.outputMode("complete").format("memory").queryName("sections").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    key = ["user_id", "k", "side", "n", "first_ts", "last_ts"]
    got = sorted(tuple(r) for r in spark.table("sections").select(key).collect())
    assert got == sorted(tuple(r) for r in stream_sections(events, **sizes).select(key).collect())


def test_stream_drops_late_rows(spark, tmp_path: Path):
    """Windows of 20 s: the second file moves the watermark on, the fourth has a row for a window that has closed by then."""
    files = [[1, 18, 21], [95], [97], [3, 96], [200]]
    for i, seconds in enumerate(files):
        rows = spark.createDataFrame([(1, s) for s in seconds], "user_id int, s int").select("user_id", F.timestamp_seconds("s").alias("ts"))
        rows.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    from pyspark.sql.types import IntegerType, StructField, StructType, TimestampType

    source = spark.readStream.schema(StructType([StructField("user_id", IntegerType()), StructField("ts", TimestampType())])).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
    stream = stream_sections(source, late="10 seconds").writeStream.outputMode("append").format("memory").queryName("late").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    got = {(r.k, r.side): r.n for r in spark.table("late").collect()}
    assert got == {(0, "mid"): 2, (1, "left"): 1, (0, "right"): 1, (1, "mid"): 1, (4, "mid"): 3, (5, "left"): 3}
    with pytest.raises(ValueError, match="longer"):
        stream_sections(source, left_s=21)


def test_config_and_sinks(spark, tmp_path: Path):
    from wordloom.plans.config import CorpusConfig, TrainingConfig

    assert CorpusConfig.of({"mid": 1000}).mid == 1000 and TrainingConfig.of({"pad_to": 8}).padded(17) == 24
    for cls, bad in ((CorpusConfig, {"mid": 0}), (CorpusConfig, {"wide": 1}), (TrainingConfig, {"smoothing": 1.0})):
        with pytest.raises(ValueError):
            cls.of(bad)
    rows = spark.createDataFrame([("1", [0.5, 1.0]), ("2", [])], "chunk_id string, features array<double>")
    T.write_features(rows, str(tmp_path / "features"))
    chunks = spark.createDataFrame([("1",), ("3",)], "chunk_id string")
    got = T.with_features(chunks, T.read_features(spark, str(tmp_path / "features"))).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.features, r.has_features) for r in got] == [("1", [0.5, 1.0], True), ("3", None, False)]
    log = spark.createDataFrame([(1, "loss", 2.5), (2, "loss", 1.5)], "step int, measure string, value double")
    T.write_log(log, str(tmp_path / "log"), "a")
    T.write_log(log, str(tmp_path / "log"), "b")
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("run").count().count() == 2


def test_shuffled(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("before"))
    one, same, other = (([r.k for r in selection.shuffled(rows, "k", s).collect()]) for s in (1, 1, 2))
    assert one == same != other and sorted(one) == list(range(100))
    batches = selection.whole_batches(rows.select("k"), "k", 1, 30).collect()
    assert sorted(r.batch for r in batches) == sorted([0, 1, 2] * 30)
    assert [r.k for r in sorted(batches, key=lambda r: one.index(r.k))][:30] != list(range(30))
