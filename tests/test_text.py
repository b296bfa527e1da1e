"""Goldens and brute force of the text and sequence functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wordloom.functions import encode as E
from wordloom.functions import sequence as S
from wordloom.functions import text as X
from wordloom.operators import tags


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, "n int, t string").orderBy("n").select(*columns).collect()]


def listed(texts):
    return list(enumerate(texts))


def test_decompose(spark):
    tokens = ["[PERSON]Bob", "Dylan[/PERSON],", "[DATE]Q1[/DATE].", "word,[/DATE]", "a..", "[DATE][PERSON]x", "[NOPE]x", "", "x\ny."]
    got = values(spark, listed(tokens), X.decompose(F.col("t")).alias("d"))
    assert [tuple(r[0]) for r in got] == [("[PERSON]", "Bob", "", ""), ("", "Dylan", "[/PERSON]", ","), ("[DATE]", "Q1", "[/DATE]", "."), ("", "word,", "[/DATE]", ""), ("", "a.", "", "."), ("[DATE]", "[PERSON]x", "", ""), ("", "[NOPE]x", "", ""), ("", "", "", ""), ("", "x\ny", "", ".")]


def test_cleaning(spark):
    texts = ["a *| b", "it's (50 %) — fine", "[DATE] May 5 [/DATE] x", "[DATE][TIME]now[/TIME][/DATE] . ,. !", "x² naïve· y", "[PERSON] , q", None]
    got = [r[0] for r in values(spark, listed(texts), X.preclean(F.col("t")))]
    assert got == ["a b", "it s 50% fine", "[DATE]May 5[/DATE] x", "[TIME]now[/TIME] ,.", "x² naïve y", "q", None]
    assert [r[0] for r in values(spark, listed(["<DATE>x</DATE> a<PERSON>b", "<WORK_OF_ART>x"]), X.correct_tags(F.col("t")))] == ["[DATE]x[/DATE] a[PERSON]b", "<WORK_OF_ART>x"]
    assert [r[0] for r in values(spark, listed(["[DATE]x.[/DATE]. , ..", "a b\x1cc"]), X.normalize_text(F.col("t")))] == ["x. .", "a b c"]
    assert [r[0] for r in values(spark, listed(["[DATE]x.[/DATE] # * y,"]), X.normalize_entity(F.col("t")))] == ["x. y,"]
    assert [r[0] for r in values(spark, listed(["[DATE]X[/DATE]. Y"]), X.lower_keeping_tags(F.col("t")))] == ["[DATE]x[/DATE]. y"]
    assert [r[0] for r in values(spark, listed(["].x", "a.b c,d"]), X.clean_mark_mistakes(F.col("t")))] == ["]. x", "a b c d"]


@pytest.mark.parametrize(("text", "want"), [
    ("[DATE]a b[/DATE] c", "[DATE]a b[/DATE] c"),
    ("[DATE]a [TIME]b[/TIME]", "a [TIME]b[/TIME]"),
    ("[DATE]a b[/TIME] c", "a b c"),
    ("a[/DATE] b", "a b"),
    ("[DATE]a[/DATE] b[/TIME].", "[DATE]a[/DATE] b."),
    ("[DATE]a b c d e f g[/DATE]", "[DATE]a b c d e f g[/DATE]"),
    ("x [DATE]a", "x a"),
    ("[DATE]a[/TIME], b[/DATE]", "a, b[/DATE]"),
])
def test_tag_repair(spark, text, want):
    docs = spark.createDataFrame([("d", text), ("null", None), ("none", " ")], "doc string, text string")
    assert {r.doc: r.text for r in tags.repair_tags(docs).collect()} == {"d": want, "null": None, "none": ""}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_alignment_is_least_cost(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for _ in range(300)]
    for a, b in pairs:
        out = S.align_tokens(a, b)
        assert [r for r, _, o in out if o != "insert"] == a and [h for _, h, o in out if o != "delete"] == b
        assert sum(o != "equal" for *_, o in out) == distance(a, b)
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = frame.orderBy("i").select(S.word_distance(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [distance(a, b) for a, b in pairs]


def test_char_distance(spark):
    rng = random.Random(6)
    pairs = [("".join(rng.choice("abé漢") for _ in range(rng.randrange(90))), "".join(rng.choice("abé漢") for _ in range(rng.randrange(90)))) for _ in range(200)]
    assert [S.edit_distance(a, b) for a, b in pairs] == [distance(a, b) for a, b in pairs]
    frame = spark.createDataFrame([*((i, a, b) for i, (a, b) in enumerate(pairs)), (200, None, "x")], "i int, a string, b string")
    got = [r[0] for r in frame.orderBy("i").select(S.char_distance(F.col("a"), F.col("b"), 500)).collect()]
    assert got == [*(distance(a, b) for a, b in pairs), None]


def test_word_distance_of_many_words(spark):
    a, b = [f"w{i}" for i in range(1500)], [f"w{i}" for i in range(1500) if i % 9]
    assert spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(S.word_distance(F.col("a"), F.col("b"))).first()[0] == len(a) - len(b)


def test_jaro_winkler():
    assert round(S.jaro_winkler_of("MARTHA", "MARHTA"), 4) == 0.9611
    assert S.jaro_winkler_of("", "") == S.jaro_winkler_of(None, "x") == 0.0
    assert round(S.jaro_winkler_of("DIXON", "DICKSONX"), 4) == 0.8133


def bio_of(spark, *docs):
    rows = [(d, i, t) for d, tokens in enumerate(docs) for i, t in enumerate(tokens)]
    out = [[] for _ in docs]
    for r in tags.bio_labels(spark.createDataFrame(rows, "doc int, pos int, tok string")).orderBy("doc", "pos").collect():
        assert r.pos == len(out[r.doc])
        out[r.doc].append(r.bio)
    return out


def test_bio(spark):
    assert bio_of(spark, ["[DATE]May", "5[/DATE],", "x", "#"], ["[DATE]May", "*", "5[/DATE]"], ["[DATE]May", "[TIME]x", "y"], ["[DATE]", "x"], ["a", "=", "[/DATE]", "[LOC]b[/LOC]", "[LOC]c"]) == [
        ["B-DATE", "I-DATE", "O", "O"], ["B-DATE", "O", "B-DATE"], ["B-DATE", "I-DATE", "I-DATE"], ["B-DATE"], ["O", "O", "B-LOC", "B-LOC"],
    ]


def test_entity_texts(spark):
    ref, rb = "I spent $100.000 . Bryan Adams".split(), ["O", "O", "B-MONEY", "O", "B-PERSON", "I-PERSON"]
    hyp = "I spent $100000 . Bryan Adams".split()
    cases = [([*ref, "="], [*hyp, "Getty"], [*rb, "O"], [*rb, "I-PERSON"]), (ref, hyp, rb, rb), (ref, [*hyp[:5], "*"], rb, [*rb[:5], "O"]), (ref, [*hyp[:4], "*", "*"], rb, [*rb[:4], "O", "O"])]
    rows = [(d, i, *x) for d, case in enumerate(cases) for i, x in enumerate(zip(*case))]
    found = tags.entity_texts(spark.createDataFrame(rows, "doc int, pos int, ref string, hyp string, ref_bio string, hyp_bio string")).orderBy("doc", "start").collect()
    assert [(r.doc, r.ref, r.hyp, r.label) for r in found] == [x for d, text in enumerate(["Bryan Adams Getty", "Bryan Adams", "Bryan", ""]) for x in ((d, "$100.000", "$100000", "MONEY"), (d, "Bryan Adams", text, "PERSON"))]


def test_time_tokens(spark):
    ms = [580, 940, 1140, 10000, 10090, 14780]
    got = spark.createDataFrame([(m,) for m in ms], "ms int").select(E.round_down_02(F.col("ms") / 1000)).collect()
    assert [r[0] for r in got] == [0.56, 0.92, 1.12, 10.0, 10.08, 14.78]


def test_windowed_text(spark):
    row = spark.createDataFrame([("|A|B", 10100, None, 10100, 20100, 20190, 24880)], "t string, s long, le long, ms long, me long, rs long, re long")
    got = row.select(E.windowed_text(*[F.col(c) for c in row.columns])).first()[0]
    assert got == "<|left|><|0.00|> <|0.00|><|0.00|><|mid|><|startoftranscript|><|notimestamps|><|0.00|><|0.00|>A <|10.00|><|10.00|><|endoftext|><|right|><|10.08|><|10.08|>B<|14.78|><|14.78|>"


def test_label_arrays(spark):
    one = spark.createDataFrame([([1, 2, 3, -100], [5, 51908, 7, 51907], [9, 51908, 8, 8], [4])], "a array<int>, m array<int>, n array<int>, s array<int>")
    got = one.select(E.shift_right(F.col("a"), 7), E.pad_labels(F.col("s"), F.lit(3)), E.mid_mask(F.col("m")), E.mid_mask(F.col("n")), E.drop_for_windowed(F.col("a")), E.drop_for_plain(F.col("a")), E.drop_for_windowed(F.col("s"))).first()
    assert list(map(list, got)) == [[7, 1, 2, 3], [4, -100, -100], [False, True, True, False], [False] * 4, [3], [1, 3, -100], []]


def test_fixed_lists():
    assert len(X.OPENING) == len(X.CLOSING) == 21 and len(X.ANGLE_LABELS) == 20
    assert re.fullmatch(r"[!-~]{32}", X.PUNCTUATION)
