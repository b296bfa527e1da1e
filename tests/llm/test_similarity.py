"""Substring dedup, near-duplicates, components, decontamination."""

import time
import random

from pyspark.sql import functions as F

from tests.llm import plain
from wordloom.llm.components import components
from wordloom.llm.decontaminate import contaminated, drop_contaminated, smith_waterman
from wordloom.llm.near_dup import drop_near_duplicates, near_duplicates
from wordloom.llm.substring import dedup_substrings, remove_repeats
from wordloom.session import Scratch


def words(rng, n, vocabulary=3000):
    return [f"v{rng.randrange(vocabulary)}" for _ in range(n)]


def substring_rows():
    rng = random.Random(3)
    shared, edge = words(rng, 60), words(rng, 35)
    rows = [(i, " ".join(words(rng, 80) + shared[: 30 + i] + words(rng, 40))) for i in range(12)]
    rows += [(20, " ".join(edge)), (21, " ".join(["x", *edge])), (22, " ".join(edge[:34])), (23, "For " * 200), (24, "a b c " * 60), (25, None), (26, ""), (27, " \n")]
    copy = " ".join(words(rng, 90))
    rows += [(30, copy), (31, copy.replace(" ", "\n")), (32, copy), (32, copy), (None, copy), (33, " ".join(copy.split()[:50] + ["new"] + copy.split()[50:]))]
    many = words(rng, 3000, 50)
    rows += [(40, " ".join(many)), (41, " ".join(many[:1500] + ["cut"] + many[1500:]))]
    return rows


def test_substring_matches_plain(spark):
    rows = substring_rows()
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, n_words int, path string")
    got = sorted((tuple(r) for r in remove_repeats(docs).collect()), key=repr)
    assert got == sorted(((i, *r[:3]) for (i, _), r in zip(rows, plain.cut_repeats([t for _, t in rows]))), key=repr)
    kept = remove_repeats(docs, keep_text=True).collect()
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in kept)
    assert remove_repeats(docs.where("false")).count() == 0


def test_substring_stage(spark):
    rows = substring_rows()
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = sorted((tuple(r) for r in dedup_substrings(docs).collect()), key=repr)
    want = [(i, t if r[1] == 0 else r[3]) for (i, t), r in zip(rows, plain.cut_repeats([t for _, t in rows]))]
    assert got == sorted(((i, t, len(t or "")) for i, t in want), key=repr)


def near_rows():
    rng = random.Random(9)
    rows, doc = [], 100
    passage = words(rng, 60)
    for family in range(12):
        base = words(rng, 150)
        for _ in range(1 + family % 4):
            edited = list(base)
            for _ in range(rng.randrange(8)):
                edited[rng.randrange(len(edited))] = "edit"
            rows.append((doc, " ".join(edited)))
            doc += 1
    rows += [(doc + i, " ".join(words(rng, 100) + passage)) for i in range(40)]
    crowd = words(rng, 120)  # a large group of near copies, with members at the edge of the threshold
    for i in range(150):
        edited = list(crowd)
        for _ in range(rng.randrange(9)):
            edited[rng.randrange(len(edited))] = f"e{i}_{rng.randrange(99)}"
        rows.append((1000 + i, " ".join(edited)))
    rows += [(2, "Three Short words"), (1, "three short  WORDS"), (3, "three short word"), (4, None), (5, ""), (6, " "), (7, rows[0][1].upper()), (7, rows[0][1].upper()), (None, rows[0][1]), (None, "lonely words of no id stand here")]
    return rows


def test_near_duplicates_match_plain(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, n_shingles int, kept boolean")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=repr)
    want = [(i, n, i if n == 0 else c, i == (i if n == 0 else c)) for (i, _), (n, c) in zip(rows, plain.near_components(rows))]
    assert got == sorted(want, key=repr)
    assert near_duplicates(docs.where("false")).count() == 0


def test_near_duplicate_stage(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = {(c, n > 0) for (n, c) in plain.near_components(rows) if n}
    bare = sum(not plain.shingles(t) for _, t in rows)
    assert kept.count() == len(groups) + bare


def test_near_duplicates_in_a_crowd_below_the_threshold(spark):
    rng = random.Random(12)
    shared, rows = words(rng, 104), []
    for i in range(700):  # 100 shared shingles and 19 of each: 0.725 to each other
        rows.append((i, " ".join(shared + [f"t{i}_{k}" for k in range(19)])))
    for i in range(0, 200, 2):  # 102 of 136 to 104 of 134 between the two of a pair
        rows[i + 1] = (i + 1, " ".join(shared + [f"t{i}_{k}" for k in range(2 + i % 3)] + [f"t{i + 1}_{k}" for k in range(17 - i % 3)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(rows, plain.near_components(rows))}
    assert len(set(got.values())) == 600


def test_stages_keep_columns_of_any_name(spark):
    """Names that the operators use themselves, nulls, repeated rows, a very long text."""
    rng = random.Random(5)
    names = ["bare", "kid", "kth", "_text_hash", "_nth", "_missing", "missing", "row", "id", "th", "nth", "runs", "c0", "n", "sid", "root"]
    long = " ".join(words(rng, 40_000, 1_000_000))
    texts = [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "x y"), (6, long), (7, long + " end")]
    docs = spark.createDataFrame([(i, t, *[f"{k}{n}" for n in names]) for k, (i, t) in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = sorted((tuple(r) for r in kept.collect()), key=repr)
    assert set(rows) <= {tuple(r) for r in docs.collect()}
    assert sorted(repr(r[0]) for r in rows) == sorted(map(repr, [1, 3, 3, 4, 5, None, 6]))
    cut = dedup_substrings(docs)
    assert cut.columns == docs.columns
    got = {r["bare"]: r for r in cut.collect()}
    for r in docs.collect():
        assert got[r["bare"]][2:] == r[2:] and got[r["bare"]][0] == r[0]
        assert got[r["bare"]][1] == {6: "", 7: "end"}.get(r[0], r[1])
    assert drop_near_duplicates(docs.where("false")).count() == dedup_substrings(docs.where("false")).count() == 0


def test_many_equal_rows(spark):
    """Rows that repeat gather their runs once, not once for each other."""
    rng = random.Random(6)
    text = " ".join(words(rng, 400))
    docs = spark.createDataFrame([(1, text)] * 4000 + [(2, "other " + text)], "doc_id long, text string")
    rows = remove_repeats(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {(r[0], r[1], r[2]) for r in rows} == {(1, 400, 4000), (2, 400, 1)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7), (3, 2), (500, 501)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(frame, Scratch(spark, "test"), "c").collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(frame.where("false"), Scratch(spark, "test"), "e").count() == 0


def local_score(item, text):
    best = 0
    row = [0] * (len(text) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        best, row = max(best, *new), new
    return best


def test_smith_waterman_matches_plain():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(1, 12))], [rng.randrange(5) for _ in range(rng.randrange(1, 25))]
        assert smith_waterman(np.array(a), np.array(b))[0] == local_score(a, b)


def test_contaminated(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 30, 100_000))) for i in range(20)] + [(30, None), (31, ""), (32, "two words")]
    docs = [(i, " ".join(words(rng, 120, 100_000)), i) for i in range(40)]
    want = set()
    for k, (item, text) in enumerate(items[:20]):
        w = text.split()
        if k % 3 == 1:  # edited: every seventh word another, case and marks changed
            w = [x.upper() + "," if j % 7 else "other" for j, x in enumerate(w)]
        if k % 3 == 2:
            w = w[:12] + ["inserted", "words"] + w[13:]
        host = " ".join(words(rng, 50, 100_000))
        docs.append((100 + k, f"{host} {' '.join(w)} {host}", 0))
        want.add((100 + k, item))
    docs += [(200, None, 0), (201, "", 0), (None, items[0][1], 0), (202, items[1][1] * 3 + " z" * 50_000, 0), (100, docs[40][1], 0)]
    want |= {(None, 0), (202, 1)}
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = contaminated(frame, tests).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert len(rows) == len(want) + 1  # the repeated row comes out twice
    clean = drop_contaminated(frame, tests)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == [*range(40), 200, 201]
    assert contaminated(frame.where("false"), tests).count() == 0
    assert contaminated(frame, tests.where("false")).count() == 0
    assert drop_contaminated(frame, tests.where("false")).where(F.col("doc_id") < 40).count() == 40


def test_texts_are_exchanged_once_to_drop_copies(spark):
    """Null ids and repeated rows are decided where the join put them, without another exchange."""
    from pyspark.sql import Window
    from wordloom.llm.near_dup import _same_rows

    rows = spark.createDataFrame([(None, 5, "a"), (None, 5, "b"), (1, 5, "c"), (2, 6, "d"), (2, 7, "e")], "id long, th long, row string")
    keys = spark.createDataFrame([(None, 5, True), (2, 7, False), (3, 5, True)], "id long, th long, bare boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = _same_rows(rows, keys).withColumn("nth", F.row_number().over(Window.partitionBy("place", "th", "id").orderBy("row")))
        plan = first._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan and "Window" in plan
        assert sorted((r.id, r.row, r.bare, r.nth) for r in first.collect() if r.id) == [(2, "e", False, 1)]
        assert sorted((r.row, r.nth) for r in first.collect() if r.id is None) == [("a", 1), ("b", 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_kept_tables_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    from wordloom.session import CLEANUP, Scratch

    monkeypatch.setattr("wordloom.session.scratch_root", lambda spark: f"file://{tmp_path}")
    stored = lambda: sum(1 for r in spark.sparkContext._jvm.java.io.File(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).listFiles() for f in r.listFiles() or [] if f.getName().startswith("shuffle_"))
    before, held = spark.conf.get(CLEANUP, None), stored()
    kept = Scratch(spark, "kept").keep(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "rows")
    deadline = time.time() + 10
    while stored() > held and time.time() < deadline:
        time.sleep(0.1)
    assert stored() <= held and kept.count() == 7 and spark.conf.get(CLEANUP, None) == before
