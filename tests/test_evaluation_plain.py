"""Every table of an evaluation against plain Python, on texts with missing, changed and added words."""

import random
from collections import Counter

from wordloom.plans.corpus import evaluate, sweep

MARKS = ".!;,?"


def aligned(ref, hyp):
    """Least-cost word pairs: common beginnings aside, then back from the end, diagonal before deletion before insertion."""
    head = 0
    while head < min(len(ref), len(hyp)) and ref[head] == hyp[head]:
        head += 1
    a, b = ref[head:], hyp[head:]
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((a[i], "*"))
        else:
            j -= 1
            out.append(("#", b[j]))
    return [(w, w) for w in ref[:head]] + out[::-1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def bare(word):
    return word[:-1] if word[-1] in MARKS else word


def texts(rng, n):
    out = []
    for doc in range(n):
        ref = [rng.choice(["Ann", "ann", "went", "Home", "home", "and", "Lee", "said", "no"]) + rng.choice(["", "", "", ".", ",", "?"]) for _ in range(rng.randrange(1, 45))]
        hyp = []
        for w in ref:
            r = rng.random()
            if r < 0.1:
                continue
            hyp.append("other" if r < 0.2 else w.lower() if r < 0.35 else bare(w) if r < 0.5 else w)
            if r > 0.93:
                hyp.append("added,")
        out.append((f"d{doc}", " ".join(ref), " ".join(hyp) or "x"))
    return out


def test_tables_match_plain(spark):
    rows = texts(random.Random(12), 25)
    refs = spark.createDataFrame([(d, r) for d, r, _ in rows], "doc string, text string")
    hyps = spark.createDataFrame([(d, h) for d, _, h in rows], "doc string, text string")
    errors, case, marks = {}, Counter(), Counter()
    for doc, ref, hyp in rows:
        pairs = aligned(ref.split(), hyp.split())
        for r, h in pairs:
            if r == "#" or h == "*":
                continue
            same = bare(r).lower() == bare(h).lower()
            case[doc, "tn" if not same else "tp" if bare(r) == bare(h) else "fn"] += 1
            mine, theirs = (x[-1] if x[-1] in MARKS else None for x in (r, h))
            if mine or theirs:
                marks[doc, mine or theirs, "fp" if not mine else "tp" if mine == theirs else "fn"] += 1
        r, h = [bare(w) for w in ref.split()], [bare(w) for w in hyp.split()]
        steps = aligned(r, h)
        ops = Counter("hit" if x == y else "insert" if x == "#" else "delete" if y == "*" else "change" for x, y in steps)
        errors[doc] = (ops["hit"], ops["change"], ops["delete"], ops["insert"], distance(" ".join(r), " ".join(h)), len(" ".join(r)))
    assert sum(e[1] for e in errors.values()) > 10 and sum(e[3] for e in errors.values()) > 10
    out = evaluate(refs, hyps, "doc")
    got = {r.doc: (r.hits, r.substitutions, r.deletions, r.insertions, r.char_errors, r.chars) for r in out["errors"].collect()}
    assert got == errors
    assert all(abs(r.wer - sum(errors[r.doc][1:4]) / sum(errors[r.doc][:3])) < 1e-12 for r in out["errors"].collect())
    assert {(r.doc, k): r[k] for r in out["case"].collect() for k in ("tp", "fp", "fn", "tn") if r[k]} == dict(case)
    assert {(r.doc, r.mark, k): r[k] for r in out["marks"].collect() for k in ("tp", "fp", "fn", "tn") if r[k]} == dict(marks)
    assert out["labels"].count() == 0 and out["spans"].count() == 0
    rated = sweep(refs, {"as said": hyps, "perfect": refs, "again": hyps}).collect()
    places = {r.system: (r.place, r.docs, r.hits) for r in rated}
    assert places["perfect"][0] == 1 and places["as said"] == places["again"] and places["as said"][0] == 2
    assert places["as said"][2] == sum(e[0] for e in errors.values()) and places["perfect"][1] == len(rows)
