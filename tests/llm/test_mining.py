"""Hard negatives, prefix tries and mixtures against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from wordloom.llm import hard_negatives as H
from wordloom.llm.mixing import mix_sources, mixed_texts
from wordloom.llm.prefix_trie import prefix_trie, rebuilt_trie
from wordloom.llm.queries import ORACLE_SQL, QUERIES
from wordloom.llm.scan import running
from wordloom.session import Scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_prefix_trie", "op13_source_mix"])
def test_query_equals_sql(spark, name):
    assert oracle.compare_with(spark, name, SF, QUERIES[name], ORACLE_SQL[name]).startswith("equal")


# ---- running sums ----------------------------------------------------------------------------------------------------


def test_running_sums_across_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None, ""]), rng.choice([None, *range(40)]), rng.randrange(9)) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "k string, o int, v long").repartition(13)
    got = [tuple(r) for r in running(frame, Scratch(spark, "test"), "x", ["k"], ["o"], {"before": "v"}).collect()]
    by_key = defaultdict(list)
    for k, o, v, before in got:
        by_key[k].append((before, v, -1 if o is None else o))
    assert Counter(r[:3] for r in got) == Counter(rows)
    for own in by_key.values():
        own.sort()
        assert [b for b, _, _ in own] == [sum(v for _, v, _ in own[:i]) for i in range(len(own))] or all(a[0] + a[1] <= b[0] or a[1] == 0 for a, b in zip(own, own[1:]))
        assert own[-1][0] + own[-1][1] == sum(v for _, v, _ in own)
        places = sorted((o, b, v) for b, v, o in own)
        assert all(x[1] <= y[1] for x, y in zip(places, places[1:]) if x[0] < y[0])
    assert running(frame.where("false"), Scratch(spark, "test"), "x", [], ["o"], {"before": "v"}).count() == 0


# ---- hard negatives --------------------------------------------------------------------------------------------------


def plain_negatives(rows, every=50, n_pos=5, n_neg=3):
    known = {}
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        item = (label, [math.floor(256 * x) for x in vector])
        known[i] = min(known.get(i, item), item)
    out = []
    for a in [i for i in known if i % every == 0]:
        label, v = known[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, (m, w) in known.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fits[:n_neg], 1)]
    return sorted(out)


def vector_rows(n=1500, dim=12):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), [rng.gauss(0.2, 1) for _ in range(dim)]) for i in range(n)]
    common = [rng.gauss(0.2, 1) for _ in range(dim)]
    rows += [(n + i, i % 3, common) for i in range(700)]
    rows += [(5000, 1, common), (5000, 0, common), (5000, 1, common), (5050, 2, [0.0] * dim), (5100, 2, [1.0, 2.0]), (5101, 2, [1.0, 1.5]), (5102, 1, [0.9, 1.2]), (5150, 1, []), (5151, 1, []), (5152, 2, [])]
    return rows + [(None, 1, common), (5200, None, common), (5250, 1, None), (5300, 1, [None] * dim), (5350, 1, [math.nan] * dim), (5400, 1, [math.inf] * dim)]


def test_hard_negatives_match_all_pairs(spark, monkeypatch):
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, score string, id int").repartition(3)
    want = plain_negatives(rows)
    assert len(want) > 100
    got = lambda **kw: sorted(tuple(r) for r in H.hard_negatives(H.usable_vectors(frame), **kw).collect())
    assert got() == want
    assert got(anchor_bytes=2000) == want
    assert got(every=1, positives=2, negatives=5) == plain_negatives(rows, 1, 2, 5)
    assert H.hard_negatives(H.usable_vectors(frame.where("false"))).count() == 0
    with pytest.raises(ValueError, match="too large"):
        H.hard_negatives(H.usable_vectors(spark.createDataFrame([(0, 1, [1e9, 1.0])], "vec_id long, label int, embedding array<double>")))


def test_small_forests_and_trees_lose_nothing():
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.normal(20, 60, (3000, 16)))
    ids = rng.permutation(3000)
    tree = H.Tree.of(ids, vectors, 16)
    anchors = vectors[:40]
    low, high = np.full(40, -1e9), np.full(40, 40_000.0)
    search = H.Search(anchors, np.arange(40), low, high, 7, ids[:40])
    evaluated = []
    leaf = search._leaf
    search._leaf = lambda t, which, q: (evaluated.append(len(q)), leaf(t, which, q))
    search.run(tree, np.arange(40))
    for a in range(40):
        s = vectors @ anchors[a]
        order = [i for i in np.lexsort((ids, -s)) if s[i] <= 40_000 and ids[i] != ids[a]][:7]
        assert list(search.ids[a]) == list(ids[order]) and list(search.scores[a]) == [int(s[i]) for i in order]
    assert sum(evaluated) < 40 * (tree.child < 0).sum()  # nodes were pruned


# ---- prefix trie -----------------------------------------------------------------------------------------------------


def plain_paths(rows, rebuilt):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    if not rebuilt:
        return convs
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
    return {c: convs.get(c - int(math.fmod(c, 100)), [])[: h[c]] + ts[h[c] :] for c, ts in convs.items()}


def plain_trie(rows, rebuilt=True):
    paths = plain_paths(rows, rebuilt)
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    ids = lambda p: ",".join(str(c) for c in members[p] if len(paths[c]) == len(p))
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ids(p).encode()).hexdigest()) for p, m in members.items()), key=repr)


def conversation_rows():
    rng = random.Random(8)
    rows = []
    for c in [*range(60), *range(195, 260), 400, 401]:
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "so", "é" * rng.randrange(4)])) for t in range(rng.randrange(1, 7))]
    common = [("user", "same"), ("assistant", "words"), ("user", None)]
    rows += [(c, t, *x) for c in range(1000, 1400) for t, x in enumerate(common)]
    rows += [(500, t, "user", f"long {t % 7}") for t in range(9000)] + [(505, t, "user", f"long {t % 7}") for t in range(9000)] + [(506, t, "user", f"long {t % 7}") for t in range(8500)]
    rows += [(700, None, "user", "first"), (700, 0, None, None), (700, 0, "user", "tie"), (700, 0, "user", "tie"), (700, 0, "a", "b"), (None, 0, "user", "lost"), (702, 0, "user", "alone"), (-5, 0, "user", "x")]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, p1 int").repartition(5)


def test_trie_matches_plain(spark):
    rows = conversation_rows()
    short = [r for r in rows if r[0] not in (500, 505, 506)]
    for rebuilt, build in ((True, rebuilt_trie), (False, prefix_trie)):
        got = sorted((tuple(r) for r in build(frame_of(spark, short)).collect()), key=repr)
        assert got == plain_trie(short, rebuilt)
    assert rebuilt_trie(frame_of(spark, rows).where("false")).count() == 0


def test_trie_of_long_conversations(spark):
    rows = [r for r in conversation_rows() if r[0] in (500, 505, 506)]
    got = prefix_trie(frame_of(spark, rows)).groupBy("n_convs").agg(F.count(F.lit(1)).alias("n"), F.max("saved_tokens").alias("saved")).collect()
    sizes = [len(t) for _, _, _, t in rows if _ is not None]
    assert sum(r.n for r in got) == 9001 and {r.n_convs: r.n for r in got} == {3: 8501, 2: 500}
    tokens = [len(t) for c, _, _, t in rows if c == 505]
    assert max(r.saved for r in got) == 2 * sum(tokens[:8500]) + sum(tokens[8500:]) and len(sizes) == 26500


# ---- mixtures --------------------------------------------------------------------------------------------------------


def mix_frame(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(60))), rng.choice(["big", "big", "big", "mid", "tiny" if i % 40 == 0 else "mid", None, ""])) for i in range(600)]
    rows += [(900, "one two", "same")] * 30 + [(901, None, "none"), (902, "", "none"), (None, "a b c", "big"), (None, "a b c", "big"), (903, " ".join(["long"] * 4000), "huge")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(7)


def test_mix_meets_targets(spark):
    rows, frame = mix_frame(spark)
    got = mix_sources(frame)
    assert sorted(got.collect(), key=repr) == sorted(mix_sources(frame.repartition(3)).collect(), key=repr)
    sizes, taken = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(sizes)
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in sizes if s not in open_)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3 * sizes[s] for s in sizes}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        open_ -= over
    out = got.collect()
    assert len(out) == len(rows) and any(r.copies for r in out) and any(0 < r.cut < r.size for r in out)
    for r in out:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.cut and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert mix_sources(frame.where("false")).count() == 0 and mix_sources(frame.where("source = 'none'")).agg(F.sum("taken")).first()[0] == 0


def test_mixed_texts_hold_what_was_taken(spark):
    rows, frame = mix_frame(spark)
    frame = frame.where("doc_id < 600 or doc_id > 900")
    mixed = mix_sources(frame)
    texts = Counter()
    for r in mixed_texts(frame, mixed).collect():
        texts[r.doc_id] += len(r.text.split())
    assert texts == {r.doc_id: r.taken for r in mixed.collect() if r.taken}
    other = mix_sources(frame, weights=[1.0], epochs=1)
    assert other.agg(F.sum("taken")).first()[0] == other.agg(F.sum("size")).first()[0]
