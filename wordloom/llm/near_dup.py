"""MinHash near-dedup: a chosen-path set similarity join over word shingles.

Each of ``TREES`` independent trees branches the distinct shingle sets by one minwise shingle a level. A
node of at most ``NODE`` sets is compared exhaustively; a larger one branches again, down to ``DEPTH``
levels. Two sets of similarity s share a branch with probability s, so at 0.75 a pair is missed by all
trees with probability 0.25**20 where nodes stay small. Crowds that share a passage but little else part
in a few levels. Nodes that are large at level ``OWN`` are not left to deeper levels, where a pair of a
crowd just below 0.75 seldom stays together: each set there is tied to one of its node first; then sets
that met a component, the main one of a large node, and are not in it, are compared with all of that
component; then what lies outside the main component of such a node is compared with each other, all in
blocks and as far as components differ. So a pair at 0.75 is missed with probability (1 - 0.75**3)**20,
2e-5, in any crowd whose nodes are large at that level, and in none with more. Pairs that meet but share few
of all minwise values are set aside before their sets are read; one at the threshold is among these with a
probability below 1e-9. All ties are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .components import components
from .skew import join_keys
from .tokens import slices
from .word_hash import Spans

SHINGLE = 5
TREES, DEPTH, NODE = 20, 8, 16
#: Pairs at the threshold that the sketches of their minwise values may turn away.
LIKELY = 1e-9
#: Levels that a tree has minwise shingles of its own for; deeper ones take those of the next trees.
OWN = 3  # two of them are packed into one column below
#: Sets on each side of a block of comparisons with a component.
BLOCK = 256
#: Shingles of a block that are counted at a time.
COLUMNS = 4096
SLICE = 6 << 20


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one for a text of fewer words; none for a text without words."""
    spans = Spans(pc.ascii_lower(texts.cast(pa.large_string())))
    grams, out = spans.every(shingle), []
    for a, b in zip(spans.first[:-1].tolist(), spans.first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        else:
            out.append(spans.span(np.array([a]), b - a) if b > a else grams[:0])
    return out


def signatures(docs: DataFrame, values: int, shingle: int = SHINGLE) -> DataFrame:
    """(id, th, sid, n, sig) of (id, th, text): sid is a 128-bit digest of the set, n its size, sig its minwise shingles."""
    kind = T.StructType([docs.schema["id"], T.StructField("th", T.LongType()), T.StructField("sid", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))])
    by = _multipliers(values)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = _sets(part.column("text"), shingle)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                first = (np.cumsum(size) - size)[full]
                sig = np.zeros((len(sets), values), np.uint64)
                for i in range(values if len(full) else 0):
                    sig[full, i] = np.minimum.reduceat(flat * by[i], first)
                ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values * len(sets) + 1, values, dtype=np.int32)), pa.array(sig.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(ids, pa.binary()), pa.array(size), lists], kind.names)

    return docs.mapInArrow(sign, kind)


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(sid, shingles) of (sid, text)."""
    kind = T.StructType([T.StructField("sid", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = _sets(part.column("text"), shingle)
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("sid"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets).view(np.int64)))], kind.names)

    return docs.mapInArrow(read, kind)


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b of the sets that share a node, if their sizes allow the similarity."""
    x, y = members.alias("x"), members.alias("y")
    fits = (F.col("x.sid") < F.col("y.sid")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    return x.join(y, (F.col("x.node") == F.col("y.node")) & fits).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))


def _grow(sets: DataFrame, scratch: Scratch, trees: int, depth: int, node: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Members (node, sid, n) of the small nodes of each level; members (node, sid, first) of the large nodes of each
    level from ``OWN`` shared shingles on, first for those of just ``OWN``.

    Rows of the first levels carry 32 bits of each of their tree's own minwise shingles; the few that branch on fetch the
    signature.
    """
    own = lambda t, d: F.element_at("sig", t * OWN + d + 1)
    low = lambda x: F.shiftrightunsigned(F.shiftleft(x, 32), 32)
    deeper = lambda t: F.shiftleft(own(t, 1), 32).bitwiseOR(low(own(t, 2)))
    paths = F.array(*[F.struct(F.lit(t).cast("short").alias("tree"), own(t, 0).alias("k0"), deeper(t).alias("ks")) for t in range(trees)])
    rows = sets.select("sid", "n", F.explode(paths).alias("p")).select("sid", "n", "p.tree", F.xxhash64("p.tree", "p.k0").alias("node"), "p.ks")
    small, crowds = [], []
    for level in range(depth):
        sizes = scratch.keep(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"sizes{level}")
        rows = scratch.keep(join_keys(rows, sizes, ["node"], "size"), f"level{level}")
        scratch.drop(f"sizes{level}")
        small.append(rows.where(F.col("size") <= node).select("node", "sid", "n"))
        large = rows.where(F.col("size") > node).drop("size")
        if level + 1 >= OWN:
            crowds.append(large.select("node", "sid", F.lit(level + 1 == OWN).alias("first")))
        if level + 1 == depth or large.isEmpty():
            break
        if level + 1 < OWN:
            rows = large.withColumn("node", F.xxhash64("node", F.shiftright("ks", 32) if level == 0 else low(F.col("ks"))))
        else:
            if level + 1 == OWN:
                # Written, as the next level reads it twice.
                large = scratch.keep(large.drop("ks").join(sets.select("sid", "sig"), "sid"), "deep")
            place = ((F.col("tree") + (level + 1) // OWN) % trees) * OWN + (level + 1) % OWN + 1
            rows = large.withColumn("node", F.xxhash64("node", F.element_at("sig", place.cast("int"))))
    return small, crowds


def least_agreement(values: int, percent: int, missed: float = LIKELY) -> int:
    """Equal minwise values, of so many, below which a pair of that similarity falls with probability ``missed`` at most."""
    p, below = percent / 100, 0.0
    for n in range(values + 1):
        below += math.comb(values, n) * p**n * (1 - p) ** (values - n)
        if below > missed:
            return n
    return values


def _likely(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """The pairs whose sketches (sid, marks) agree in ``least`` places, before their sets are read."""
    a = sketches.select(F.col("sid").alias("a"), F.col("marks").alias("ma"))
    b = sketches.select(F.col("sid").alias("b"), F.col("marks").alias("mb"))
    equal = F.size(F.filter(F.zip_with("ma", "mb", lambda x, y: x == y), lambda same: same))
    return pairs.join(a, "a").join(b, "b").where(equal >= least).drop("ma", "mb")


def _confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    a = shingles.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    b = shingles.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u")).where(f"100 * i >= {percent} * u").select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, node: int = NODE) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Columns: id, th (a hash of the text), n_shingles, component_id (the least id of the component), kept
    (id equals component_id), chosen (kept, and the first by text hash among rows of that id). A-Z are lower-cased first. Null and empty texts, and texts without words,
    have no shingles and form components of their own. Documents with equal sets are linked through
    their set, so copies cost a row each and no pairs; repeated rows come out as often as they went in.
    Null ids take part but never name a component unless all its ids are null. Empty input gives an
    empty result; other columns are not read.

    A set is signed once and written. Node sizes are partial counts; pairs come from nodes of at most
    ``node`` sets. Of its candidates a set first confirms the one it shares most nodes with; components
    of those ties then make most other pairs needless, and the pairs that remain between components
    are confirmed after that. Shingle sets are read again for candidates only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("th"), "text")
    signed = scratch.keep(signatures(base, trees * OWN, shingle), "signed")
    rows = scratch.keep(signed.select("id", "th", "sid", "n"), "rows")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    sets = signed.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(order).alias("own"), F.count(F.lit(1)).alias("size"))
    # From here on a set goes by a number that its written row has, as digests are long and cannot be compressed.
    sets = scratch.keep(sets.withColumnRenamed("sid", "key").withColumn("sid", F.monotonically_increasing_id()), "sets")
    per_set = scratch.keep(sets.select("key", "sid", "own", "size"), "per_set")
    sketches = scratch.keep(sets.select("sid", F.transform("sig", lambda x: x.bitwiseAND(127).cast("tinyint")).alias("marks")), "sketches")
    scratch.drop("signed")
    small, crowds = _grow(sets, scratch, trees, depth, node)
    crowd = reduce(DataFrame.unionByName, crowds) if crowds else sets.select(F.lit(0).cast("long").alias("node"), "sid", F.lit(False).alias("first")).where("false")
    crowd = scratch.keep(crowd, "crowd")
    pairs = _pairs(small[0], percent)
    for level in small[1:]:
        pairs = pairs.unionByName(_pairs(level, percent))
    hubs = crowd.groupBy("node").agg(F.min_by("sid", F.xxhash64("sid", "node")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = scratch.keep(hubs, "hubs")
    spokes = join_keys(crowd, hubs, ["node"], "size").where("sid <> hub").select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b"))
    pairs = scratch.keep(pairs.unionByName(spokes).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), "pairs")
    scratch.drop("sets", "hubs", "deep", *[f"level{i}" for i in range(len(small))])
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).unionByName(crowd.select("sid")).distinct()
    places = per_set.join(wanted, "sid", "left_semi").select("sid", "own.id", "own.th")
    texts = _same_rows(base, places).select("place", "th", "sid", "text").dropDuplicates(["place", "th", "sid"])
    shingles = scratch.keep(shingle_sets(texts.select("sid", "text"), shingle), "shingles")

    # Each set's most likely tie first, then what still lies between components; sketches first, then sets.
    agree = least_agreement(trees * OWN, percent)
    tied = lambda some: _confirmed(_likely(some, sketches, agree), shingles, percent)
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    best = best.unionByName(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")).select("a", "b")).distinct()
    ties = scratch.keep(tied(best), "ties0")
    roots = scratch.keep(components(ties, scratch, "first"), "roots0")
    more = scratch.keep(tied(_between(pairs, roots)), "ties1")
    if not more.isEmpty():
        ties = ties.unionByName(more)
        roots = scratch.keep(components(_joined_ties(roots, more), scratch, "second"), "roots1")
    # Large nodes: what lies in different components of one node.
    placed = scratch.keep(crowd.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "placed")
    shares = placed.groupBy("node", "root").agg(F.count(F.lit(1)).alias("held"))
    mains = shares.groupBy("node").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.count(F.lit(1)).alias("kinds"), F.sum("held").alias("size")).where("kinds > 1")
    mains = scratch.keep(mains.drop("kinds"), "mains")
    strays = scratch.keep(join_keys(placed, mains, ["node"], "size").drop("size").where("root <> main"), "strays")
    scratch.drop("placed", "mains", "crowd", "pairs", "sketches")
    asked = strays.select("sid", F.col("main").alias("root")).distinct()
    asked = scratch.keep(asked, "asked")
    if not asked.isEmpty():
        more = scratch.keep(_against_components(asked, roots, shingles, percent), "ties2")
        roots = scratch.keep(components(_joined_ties(roots, more), scratch, "third"), "roots2")
        # And what lies outside of the main components, with each other; nodes of deeper levels are parts of these.
        rest = strays.where("first").select("node", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        more = scratch.keep(_among_strays(rest, shingles, percent), "ties3")
        if not more.isEmpty():
            roots = scratch.keep(components(_joined_ties(roots, more), scratch, "fourth"), "roots3")

    # Names go from rows to sets to components and back, so copies and large components meet their names unexchanged.
    rooted = scratch.keep(per_set.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted")
    least = scratch.keep(rooted.groupBy("root").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("sets")), "least")
    named = scratch.keep(join_keys(rooted, least, ["root"], "sets").select(F.col("key").alias("sid"), "least", "size"), "named")
    full = join_keys(rows.where("n > 0"), named, ["sid"], "size").select("id", "th", "n", F.col("least.id").alias("component"), (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("th") == F.col("least.th"))).alias("chosen"))
    bare = rows.where("n = 0").select("id", "th", "n", F.col("id").alias("component"), F.lit(True).alias("chosen"))
    found = full.unionByName(bare).select("id", "th", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"), "chosen")
    return scratch.result(found, "neardup-found").withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``near_duplicates``, the first by id and text hash, all columns kept.

    Rows without shingles (null and empty texts, texts without words) all stay. Of several rows with that id and
    text the first by a hash of all its columns stays. Other columns may have any names; an empty table stays empty.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    packed = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    keys = found.where("chosen").select(F.col(id_col).alias("id"), "th", (F.col("n_shingles") == 0).alias("bare")).distinct()
    kept = _same_rows(packed, keys)
    nth = F.row_number().over(Window.partitionBy("place", "th", "id").orderBy(F.xxhash64(F.to_json("row"))))
    once = kept.withColumn("nth", nth).where("nth = 1 or bare")
    return once.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _same_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (id, th, ..) with the other columns of their key (id, th, ..), and place, a hash of the id, which may be null.

    Joined on place and th, so what groups by these and more exchanges no texts again, which a null-safe key would not allow.
    """
    placed = rows.withColumn("place", F.xxhash64("id"))
    own = keys.select(F.xxhash64("id").alias("place"), "th", F.col("id").alias("key_id"), *[c for c in keys.columns if c not in ("id", "th")])
    # Said so that Spark does not take it for a key.
    same = F.coalesce(F.col("id") == F.col("key_id"), F.col("id").isNull() & F.col("key_id").isNull())
    return placed.join(own, ["place", "th"]).where(same).drop("key_id")


def _against_components(asked: DataFrame, roots: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) of asked sets (sid, root) to any set of the component of that root: blocks of up to about ``BLOCK``
    asked sets meet blocks of as many members, on full sets, and only ties come out."""
    members = roots.select(F.col("node").alias("sid"), "root").join(asked.select("root").distinct(), "root", "left_semi")
    alone = asked.select(F.col("root").alias("sid"), "root").distinct().join(members, "root", "left_anti")
    members = members.unionByName(alone.select("sid", "root"))
    blocks = lambda rows, name: rows.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    counts = blocks(members, "m").join(blocks(asked, "q"), "root")
    own = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(counts, "root").select("root", "sid", own("m").alias("mb"), all_("q").alias("qb"), F.lit(False).alias("asks"))
    right = asked.join(counts, "root").select("root", "sid", all_("m").alias("mb"), own("q").alias("qb"), F.lit(True).alias("asks"))
    dealt = left.unionByName(right).join(shingles, "sid")

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        return _block_ties(table, np.flatnonzero(asks), np.flatnonzero(~asks), percent)

    return dealt.groupBy("root", "mb", "qb").applyInArrow(compare, "a long, b long")


def _among_strays(strays: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) between the sets (node, sid, root) of a node that have different roots: all blocks of a node meet each
    other, on full sets, and a row goes once to each pair of blocks."""
    nodes = strays.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    own = strays.join(nodes.select("node", "q"), "node").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("q")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    dealt = met.select("node", "sid", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(shingles, "sid")

    def compare(table: pa.Table) -> pa.Table:
        i, j, block = (table.column(c).to_numpy() for c in ("i", "j", "own"))
        return _block_ties(table, np.flatnonzero(block == i), np.flatnonzero(block == j), percent)

    return dealt.groupBy("node", "i", "j").applyInArrow(compare, "a long, b long")


def _block_ties(table: pa.Table, left: np.ndarray, right: np.ndarray, percent: int) -> pa.Table:
    """Ties (a, b) between rows left and right of (sid, shingles), of different root where table has roots of each;
    ties that follow from others of the block are left out."""
    sids = table.column("sid").to_pylist()
    roots = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy() if "own" in table.column_names else np.arange(len(sids))
    lists = table.column("shingles").combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    _, kind = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    row = np.repeat(np.arange(len(sids)), size)
    seat = np.full((2, len(sids)), -1)
    seat[0, left], seat[1, right] = np.arange(len(left)), np.arange(len(right))
    inside = [seat[side][row] >= 0 for side in (0, 1)]
    kinds = int(kind.max()) + 1 if len(kind) else 0
    common = np.flatnonzero((np.bincount(kind[inside[0]], minlength=kinds) > 0) & (np.bincount(kind[inside[1]], minlength=kinds) > 0))
    place = np.full(kinds, -1)
    place[common] = np.arange(len(common))
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), COLUMNS):
        held = []
        for side, rows in enumerate((left, right)):
            here = inside[side] & (place[kind] >= at) & (place[kind] < at + COLUMNS)
            marks = np.zeros((len(rows), COLUMNS), np.float32)
            marks[seat[side][row[here]], place[kind[here]] - at] = 1
            held.append(marks)
        both += held[0] @ held[1].T
    union = size[left][:, None] + size[right][None, :] - both
    near = (100 * both.astype(np.int64) >= percent * union.astype(np.int64)) & (roots[left][:, None] != roots[right][None, :])
    parent = list(range(len(sids)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        x, y = top(int(left[i])), top(int(right[j]))
        if x != y:
            parent[x] = y
            if sids[left[i]] != sids[right[j]]:
                out.append((sids[left[i]], sids[right[j]]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _joined_ties(roots: DataFrame, ties: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(ties.select("a", "b"))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sets lie in different components."""
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")

