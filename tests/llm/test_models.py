"""Toxicity and language identification, by held-out accuracy and on odd inputs."""

import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.llm.language_id import LEFTS, ORDER, SHARES, Grams, LanguageModel, _ngrams, fit_languages, identify_language, letters_only, summed
from wordloom.llm.toxicity import CLEAN, SILENT, TOXIC, LabelModel, drop_toxic, learned_from, score_toxicity
from wordloom.session import Scratch

SF = "/root/testdata/sf0.01"
ODD = [(900001, None), (900002, ""), (900003, "12 34 !!"), (None, "some words here"), (900004, "you stupid worthless idiot, you pathetic moron"), (900004, "you stupid worthless idiot, you pathetic moron"), (900005, "und " * 60_000)]


def with_odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(i, t, None) for i, t in ODD], "doc_id long, text string, lang string")
    return docs.unionByName(odd).withColumns({"score": F.lit("x"), "predicted": F.lit("y"), "label": F.lit(3)})


def test_split_is_of_the_id():
    from wordloom.session import build_session

    spark = build_session(4, "tests")
    rows = spark.range(50).select("id", learned_from(F.col("id")).alias("learn")).collect()
    assert all(r.learn == (zlib.crc32(str(r.id).encode()) % 4 != 2) for r in rows)


def test_toxicity(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = with_odd(spark)
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[900004].predicted == 1 and by[900001].predicted == by[900002].predicted == by[900003].predicted == 0
    assert by[900001].score == by[900002].score
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(by[d].predicted, y) for d, y in known.items() if by[d].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    assert score_toxicity(docs.where("false"), labels).count() == 0
    assert score_toxicity(docs, labels.where("false")).where("doc_id = 900004").first().predicted == 1


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    votes = np.full((4000, 5), SILENT, np.int8)
    for v, (hit, noise) in enumerate([(0.9, 0.02), (0.7, 0.05), (0.6, 0.01)]):
        said = np.where(truth, rng.random(4000) < hit, rng.random(4000) < noise)
        votes[said, v] = TOXIC
    votes[votes[:, 0] == TOXIC, 3] = TOXIC  # an echo of the first voter
    votes[(votes[:, :3] != TOXIC).all(axis=1), 4] = CLEAN
    model = LabelModel.fit(votes)
    assert any({0, 3} <= set(c) for c in model.cliques)
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.95


def test_languages(spark):
    docs = with_odd(spark)
    rows = identify_language(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and not by[i].accepted for i in (900001, 900002, 900003))
    held = [(by[r.doc_id].lang_pred, r.lang) for r in docs.where("lang is not null").collect() if by[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert identify_language(docs.where("false")).count() == 0
    assert {r.lang_pred for r in identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_models_hold_every_ngram(spark):
    rng = np.random.default_rng(5)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (60_000, 6))]
    rows = [(i, "aa", " ".join(words[i::60])) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, lang string, text string")
    learned = [t for (t,) in docs.where(learned_from(F.col("id"))).select("text").collect()]
    grams, counts = counted(" ".join(learned).split())
    assert len(grams) > 130_000
    scratch = Scratch(spark, "test-languages")
    tables = fit_languages(docs, scratch, held_back=0).tables
    for n in range(ORDER, 0, -1):
        discount = (counts == 1).sum() / ((counts == 1).sum() + 2 * (counts == 2).sum()) if (counts == 1).any() and (counts == 2).any() else 0.5
        heads, where = np.unique(grams.context(n).keys(), return_inverse=True)
        total, kinds = np.bincount(where, counts), np.bincount(where)
        for table, keys, values in ((SHARES, grams.keys(), (counts - discount) / total[where]), (LEFTS, heads, discount * kinds / total)):
            order = np.argsort(keys)
            place, entry = tables.find(2 * n + table, keys[order])
            by = np.argsort(place)
            assert np.array_equal(place[by], np.arange(len(keys))) and np.array_equal(entry["value"][by], values[order].astype(np.float32))
            assert sum(k for (_, t), (_, _, k) in tables.places.items() if t == 2 * n + table) == len(keys)
        grams, counts = summed(grams.last(n - 1), np.ones(len(grams))) if n > 1 else (grams, counts)
    scratch.close()


def counted(words):
    grams = _ngrams(words)[1]
    return summed(grams, np.ones(len(grams)))


WORDS = "abab abba baab cab abc ca ab ab 一帀 一b ۡabcab bca cabba abab šabca".split()


def plain_p(words, context, letter):
    """Interpolated Kneser-Ney by its definition: words padded with 0, ended by 1."""
    grams = Counter()
    for w in words:
        points = [0] * 4 + [ord(c) for c in w] + [1]
        grams.update(tuple(points[i : i + 5]) for i in range(len(points) - 4))
    tables = {5: grams}
    for n in (4, 3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    p = 1 / (len(tables[1]) + 1)
    for n in range(1, 6):
        table, head = tables[n], (context + (letter,))[-n:][:-1]
        ones, twos = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = [c for g, c in table.items() if g[:-1] == head]
        if own:
            p = max(table[head + (letter,)] - discount, 0) / sum(own) * (head + (letter,) in table) + discount * len(own) / sum(own) * p
    return p


def gram_of(context, letter):
    codes = [*context, letter]
    pack = lambda part: sum(c << 21 * i for i, c in enumerate(reversed(part)))
    return Grams(np.array([pack(codes[:2])]), np.array([pack(codes[2:])]))


def fitted(spark, *texts):
    """A model of each text, the languages named a, b and so on."""
    ids = [i for i in range(4 * len(texts) + 8) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, chr(97 + k), t) for k, (i, t) in enumerate(zip(ids, texts))]
    return fit_languages(spark.createDataFrame(rows, "id long, lang string, text string"), Scratch(spark, "test-languages"), held_back=0)


def test_kneser_ney_matches_plain_and_sums_to_one(spark):
    """Two languages in the same tables; each is as if it were alone, but for the letters that all know."""
    model = fitted(spark, " ".join(WORDS), "bab abba ca")
    words = letters_only(pa.array(WORDS)).to_pylist()
    letters = sorted({ord(c) for w in words for c in w}) + [1, ord("?")]
    contexts = {tuple(([0] * 4 + [ord(c) for c in w])[i : i + 4]) for w in words for i in range(len(w) + 1)} | {(0, 0, 0, 120), (97, 98, 99, 100)}
    for context in contexts:
        got = np.array([np.exp(next(model.log_p(gram_of(context, x))))[0] for x in letters])
        assert np.allclose(got, [plain_p(words, context, x) for x in letters], rtol=1e-5)
        assert abs(got.sum() - 1) < 1e-5
    assert ORDER == 5


def test_letters_of_other_scripts(spark):
    """Letters that share their low bits are told apart, and a script that nobody learned is no sure guess."""
    rng = np.random.default_rng(3)
    text = lambda first, n: " ".join("".join(chr(first + int(c)) for c in rng.integers(0, 8, 5)) for _ in range(n))
    rows = [(i, lang, text(first, 40)) for i in range(0, 600, 2) for lang, first in (("one", 0x4E00), ("two", 0x5E00))]
    asked = [(10_001, None, text(0x4E00, 9)), (10_003, None, text(0x5E00, 9)), (10_005, None, text(0x1041, 9)), (10_007, None, text(0xAC00, 40))]
    docs = spark.createDataFrame([(i + (lang == "two"), lang, t) for i, lang, t in rows] + asked, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in identify_language(docs).where("doc_id > 10000").collect()}
    assert (got[10_001].lang_pred, got[10_003].lang_pred) == ("one", "two") and got[10_001].score > 0.9 and got[10_001].accepted
    assert all(got[i].score < 0.1 and not got[i].accepted for i in (10_005, 10_007))


@pytest.mark.parametrize("text", ["", None, "  ", "x" * 100_000])
def test_ngrams_of_odd_words(spark, text):
    model = fitted(spark, "ab ba")
    langs, score, accepted, entropy = model.predict(pa.array([text], pa.string()))
    assert len(langs) == len(score) == len(accepted) == len(entropy) == 1


def test_equal_languages_and_dirty_names(spark):
    """Equal models tie and go to the first by name; many names of one text each all get a model, and a limit."""
    model = fitted(spark, "ab ba abba", "ab ba abba")
    assert model.predict(pa.array(["abba"]))[0] == ["a"] and len(pickle.dumps(model)) < 20_000
    rows = [(i, f"name {i}", "".join(chr(97 + (i * k) % 26) for k in range(1, 9)) + " " + chr(0x4E00 + i)) for i in range(150)]
    docs = spark.createDataFrame([*rows, (1000, None, chr(0x4E00)), (1001, "", "plain words")], "doc_id long, lang string, text string")
    got = identify_language(docs).collect()
    learned = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(got) == 152 and {r.lang_pred for r in got} <= {f"name {i}" for i in learned} | {""}
    by = {r.doc_id: r.lang_pred for r in got}
    assert np.mean([by[i] == f"name {i}" for i in learned]) > 0.9


def test_language_without_partners_is_whole(spark):
    assert LanguageModel([]).predict(pa.array(["x", None]))[0] == ["und", "und"]
