"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def cut_repeats(texts, window=35):
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(rows):
    """{position: least id} by all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(len(sets[i]), least.get(root(i))) for i in range(len(rows))]


def line_verdicts(rows, min_docs=20, share=0.01, min_left=0.5):
    """rows (id, host, text) to base counts and verdicts."""

    def normal(line):
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.translate(LOWER))).strip(" ")

    rows = [(i, h, t or "") for i, h, t in rows]
    docs, holders = defaultdict(set), defaultdict(set)
    for i, h, t in rows:
        docs[h].add((i, t))
        for line in t.split("\n"):
            if WORD.search(line):
                holders[h, normal(line)].add((i, t))
    out = []
    for i, h, t in rows:
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        taken = sum(len(WORD.findall(x)) for x in lines if (n := len(holders[h, normal(x)])) > min_docs and n > share * len(docs[h]))
        trip = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + d for k in range(len(words) - 2) if trip[tuple(words[k : k + 3])] > 1 for d in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and len(words) - taken >= min_left * len(words)))
    return out


def judged(url, rules):
    """rules {rule: action}."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [r for r in rules if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    best = max(fits, key=len, default=None)
    return host, path, best, rules[best] if best else "allow"
