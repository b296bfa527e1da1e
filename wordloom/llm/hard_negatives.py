"""Hard negatives by ball trees: bounds of inner products from above and below prune whole nodes.

Every task builds ball trees, one for each label, over a bounded number of its own vectors at a time and searches them
for all anchors of a block at once. A ball of centre c and radius r holds inner products with an anchor a between
<a, c> - r|a| and <a, c> + r|a|: a node is left out if that range misses the anchor's score window or lies strictly
beneath the score of its current k-th row. What a task has found so far prunes its next trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Vectors in a leaf, at most.
LEAF = 128
#: Bytes of vectors that a task holds as trees at once.
FOREST_BYTES = 32 << 20
#: Bytes of anchors that are sent to the executors at once.
ANCHOR_BYTES = 8 << 20

NONE = np.iinfo(np.int64).min


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Tree:
    """Rows in the order of the leaves; a node is a run of rows with a centre and a radius."""

    ids: np.ndarray
    vectors: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray  # of the left child, the right one follows; -1 for leaves
    centre: np.ndarray
    radius: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(ids))
        nodes: list[list] = [[0, len(ids), -1]]
        centres, radii, at = [], [], 0
        while at < len(nodes):
            lo, hi, _ = nodes[at]
            own = vectors[order[lo:hi]]
            centre = own.mean(axis=0)
            apart = ((own - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(np.sqrt(apart.max()))
            if hi - lo > leaf and apart.max() > 0:
                # The two poles: the row farthest from the centre, and the one farthest from that.
                pole = own[apart.argmax()]
                other = own[((own - pole) ** 2).sum(axis=1).argmax()]
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own @ (other - pole), half)]
                nodes[at][2] = len(nodes)
                nodes += [[lo, lo + half, -1], [lo + half, hi, -1]]
            elif hi - lo > leaf:
                # Copies of one vector: for every query all but the least ids come after as many better rows.
                order[lo:hi] = order[lo:hi][np.argsort(ids[order[lo:hi]])]
                nodes[at][1] = lo + leaf
            at += 1
        first, last, child = (np.array(x) for x in zip(*nodes))
        return Tree(ids[order], vectors[order], first, last, child, np.array(centres), np.array(radii))


class Search:
    """The best ``k`` rows so far of each query: an anchor's vector and a window of scores."""

    def __init__(self, vectors: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, own: np.ndarray | None = None):
        """anchor is each query's row of ``vectors``; own, if given, each query's id that it does not take."""
        self.vectors, self.anchor, self.low, self.high, self.k, self.own = vectors, anchor, low.astype(np.float64), high.astype(np.float64), k, own
        self.norm = np.sqrt((vectors**2).sum(axis=1))[anchor]
        self.scores = np.full((len(anchor), k), NONE, np.int64)
        self.ids = np.zeros((len(anchor), k), np.int64)

    def _alive(self, tree: Tree, node: np.ndarray, query: np.ndarray) -> np.ndarray:
        middle = np.einsum("ij,ij->i", self.vectors[self.anchor[query]], tree.centre[node])
        reach = tree.radius[node] * self.norm[query]
        # Rounding of the bounds must not lose a row at the edge.
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        upper, lower = middle + reach + slack, middle - reach - slack
        return (upper >= np.maximum(self.low[query], self.scores[query, -1])) & (lower <= self.high[query])

    def run(self, tree: Tree, queries: np.ndarray) -> None:
        """Levels go down together, the leaves in the order of their bounds, so that good rows prune the rest early."""
        node, query = np.zeros(len(queries), np.int64), queries
        leaves: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            alive = self._alive(tree, node, query)
            node, query = node[alive], query[alive]
            inner = tree.child[node] >= 0
            leaves.append((node[~inner], query[~inner]))
            down = tree.child[node[inner]]
            node, query = np.concatenate((down, down + 1)), np.concatenate((query[inner], query[inner]))
        node, query = (np.concatenate(x) for x in zip(*leaves)) if leaves else (node, query)
        if not len(node):
            return
        middle = np.einsum("ij,ij->i", self.vectors[self.anchor[query]], tree.centre[node])
        bound = middle + tree.radius[node] * self.norm[query]
        best = np.full(len(tree.first), -np.inf)
        np.maximum.at(best, node, bound)
        by_leaf = np.argsort(node, kind="stable")
        starts = np.searchsorted(node[by_leaf], np.arange(len(tree.first) + 1))
        for leaf in np.argsort(-best, kind="stable"):
            if best[leaf] == -np.inf:
                break
            waiting = query[by_leaf[starts[leaf] : starts[leaf + 1]]]
            waiting = waiting[self._alive(tree, np.full(len(waiting), leaf), waiting)]
            for start in range(0, len(waiting), 4096):
                self._leaf(tree, leaf, waiting[start : start + 4096])

    def _leaf(self, tree: Tree, leaf: int, query: np.ndarray) -> None:
        rows = slice(tree.first[leaf], tree.last[leaf])
        anchors, back = np.unique(self.anchor[query], return_inverse=True)
        products = (self.vectors[anchors] @ tree.vectors[rows].T)[back]
        ids = np.broadcast_to(tree.ids[rows], products.shape)
        fits = (products >= np.maximum(self.low[query], self.scores[query, -1])[:, None]) & (products <= self.high[query][:, None])
        if self.own is not None:
            fits &= ids != self.own[query][:, None]
        some = fits.any(axis=1)
        if not some.any():
            return
        query, fits = query[some], fits[some]
        found = np.where(fits, products[some], NONE).astype(np.int64)
        scores = np.concatenate((self.scores[query], found), axis=1)
        ids = np.concatenate((self.ids[query], ids[some]), axis=1)
        order = np.lexsort((ids, -np.maximum(scores, NONE + 1)), axis=1)[:, : self.k]
        self.scores[query], self.ids[query] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _forests(batches: Iterator[pa.RecordBatch], most: int = FOREST_BYTES) -> Iterator[tuple[int, dict[int, Tree]]]:
    """(length of vectors, {label: tree}) over a bounded number of rows at a time."""
    held: dict[int, list] = {}
    size: dict[int, int] = {}

    def grown(dim: int) -> tuple[int, dict[int, Tree]]:
        ids, labels, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
        size.pop(dim)
        return dim, {int(x): Tree.of(ids[labels == x], vectors[labels == x]) for x in np.unique(labels)}

    for batch in batches:
        ids, labels = (batch.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        values, offsets = rows_of(batch.column("vector"))
        lengths = np.diff(offsets)
        for dim in np.unique(lengths):
            here = lengths == dim
            at = (offsets[:-1][here][:, None] + np.arange(dim)[None, :]).astype(np.int64)
            held.setdefault(int(dim), []).append((ids[here], labels[here], values[at]))
            size[int(dim)] = size.get(int(dim), 0) + int(here.sum()) * (8 * int(dim) + 16)
            if size[int(dim)] > most:
                yield grown(int(dim))
    for dim in list(held):
        yield grown(dim)


def _packed(search: Search, names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows found, a batch for some thousand queries."""
    for start in range(0, len(search.anchor), 8192):
        cut = slice(start, start + 8192)
        query, place = np.nonzero(search.scores[cut] > NONE)
        query += start
        if len(query):
            yield pa.RecordBatch.from_arrays([*[pa.array(c[query]) for c in columns], pa.array(search.ids[query, place]), pa.array(search.scores[query, place])], names=names)


def _search_block(vectors: DataFrame, block: pa.Table, schema: str, names: list[str], k: int, same: bool) -> DataFrame:
    """Candidates of a block of anchors (id, label, vector, and low, high, positive, positive_score for negatives)."""
    block = block.combine_chunks()
    ids, labels = (block.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
    values, offsets = rows_of(block.column("vector").combine_chunks())
    lengths = np.diff(offsets)
    extra = [] if same else [block.column(c).to_numpy().astype(np.int64) for c in ("positive_id", "positive_score")]
    low, high = (np.full(len(ids), -np.inf), np.full(len(ids), np.inf)) if same else (block.column(c).to_numpy().astype(np.float64) for c in ("low", "high"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, tuple[Search, np.ndarray]] = {}
        for dim, forest in _forests(batches):
            mine = np.flatnonzero(lengths == dim)
            if not len(mine):
                continue
            if dim not in searches:
                # An anchor's vector once, however many windows it has.
                least, where = np.unique(ids[mine], return_index=True)
                at = offsets[:-1][mine[where]][:, None] + np.arange(dim)[None, :]
                searches[dim] = Search(values[at.astype(np.int64)].astype(np.float64), np.searchsorted(least, ids[mine]), low[mine], high[mine], k, ids[mine]), mine
            search, mine = searches[dim]
            for label, tree in forest.items():
                search.run(tree, np.flatnonzero((labels[mine] == label) == same))
        for search, mine in searches.values():
            yield from _packed(search, names, ids[mine], *[e[mine] for e in extra])

    return vectors.mapInArrow(task, schema)


def _blocks(rows: DataFrame, scratch: Scratch, name: str, row_bytes: int, most: int) -> Iterator[pa.Table]:
    """Rows in blocks of a bounded number of bytes, one at a time."""
    rows = scratch.keep(rows, name)
    count = rows.count()
    blocks = -(-count * row_bytes // most)
    for block in range(blocks):
        yield rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()


def _searched(vectors: DataFrame, anchors: DataFrame, scratch: Scratch, name: str, k: int, same: bool, most: int) -> DataFrame:
    schema = "anchor_id long, id long, score long" if same else "anchor_id long, positive_id long, positive_score long, id long, score long"
    names = [x.split()[0] for x in schema.split(", ")]
    by = names[:-2]
    longest = anchors.agg(F.max(F.size("vector"))).first()[0] or 0
    parts = []
    for i, block in enumerate(_blocks(anchors, scratch, f"{name}-anchors", 8 * longest + 48, most)):
        found = _search_block(vectors, block, schema, names, k, same)
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        parts.append(scratch.keep(found.withColumn("place", place).where(F.col("place") <= k), f"{name}{i}"))
    out = parts[0] if parts else vectors.sparkSession.createDataFrame([], f"{schema}, place int")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def usable_vectors(rows: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, vector): components x as floor(scale * x), a row for each id.

    Rows without id, label or vector, and those with a null or non-finite component, drop out. Of rows that repeat an id
    the least by label and vector stays.
    """
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    floored = F.transform(vector, lambda x: F.floor(x * scale).cast("double"))
    one = F.min(F.struct(F.col(label_col).cast("long").alias("label"), floored.alias("vector"))).alias("row")
    return clean.groupBy(F.col(id_col).cast("long").alias("id")).agg(one).select("id", "row.label", "row.vector")


def hard_negatives(rows: DataFrame, *, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (id, label, vector) by inner product.

    Anchors are the ids divisible by ``every``. An anchor's positives are its best ``positives`` other rows of its label;
    for each, its negatives are the best ``negatives`` rows of other labels whose score lies between low and high percent
    of the positive's. Higher scores come first, ties go by id; a negative positive's score has an empty window. Scores
    are exact: components are integers, and a table whose scores could pass 2**53 is refused. Only vectors of equal
    length meet. Without rows, anchors or positives there are no rows.

    Vectors stay where they are, in even partitions; anchors are sent to them in blocks of ``anchor_bytes`` at most, and
    each task returns ``positives`` (``negatives``) rows of each query at most.
    """
    if max(positives, negatives) >= LEAF:
        raise ValueError(f"fewer than {LEAF} positives and negatives")
    scratch = Scratch(rows.sparkSession, "negatives")
    vectors = scratch.keep(rows, "vectors")
    peak = vectors.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if peak[0] and peak[1] and peak[0] * peak[1] ** 2 >= 2**53:
        raise ValueError("components are too large for exact scores")
    anchors = vectors.where(F.col("id") % every == 0)
    near = _searched(vectors, anchors, scratch, "positives", positives, True, anchor_bytes)
    windows = near.select(F.col("anchor_id").alias("id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = windows.where("positive_score >= 0").withColumns({"low": F.expr(f"(positive_score * {low} + 99) div 100"), "high": F.expr(f"(positive_score * {high}) div 100")}).where("low <= high")
    queries = anchors.join(windows, "id")
    far = _searched(vectors, queries, scratch, "negatives", negatives, False, anchor_bytes)
    out = far.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return scratch.result(out, "mined")
