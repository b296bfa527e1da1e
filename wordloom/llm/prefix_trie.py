"""The prefix trie of conversations, by ownership of the smallest member.

A node is a distinct sequence of first turns, and the conversation of the smallest id that begins with it owns it. Fewer
conversations reach a deeper node, so what a conversation owns is a suffix of its path: it is known by the depth at which
that begins and the tokens before it. A node's saved tokens are then a plain sum over the conversations through it, of
the tokens that lie between the node and what each owns, and its children and leaves are sums of flags.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .scan import running
from .skew import join_keys

#: Turns of a conversation whose prefix hashes one task computes.
BLOCK = 4096
#: Bytes of ids that are joined before they go to the task that hashes a node's list.
CHUNK_BYTES = 64 << 10

KEY = ["p1", "p2", "depth"]


def numbered_turns(turns: DataFrame, scratch: Scratch, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, digest, tokens): each turn's place from 1, the digest of role and text, the text's code points.

    Null roles and texts are empty; turns go by ``turn``, nulls first, and among equal ones by digest; turns without a
    conversation drop out. Texts are digested before the exchange, and a conversation of any length is spread over tasks.
    """
    role_, text_ = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary")))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(text_).cast("long").alias("tokens"), F.lit(1).cast("long").alias("one"))
    return running(rows, scratch, "numbered", ["conv_id"], ["turn", "digest"], {"before": "one"}).select("conv_id", (F.col("before") + 1).alias("at"), "digest", "tokens")


def shared_heads(numbered: DataFrame, scratch: Scratch, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their block: (turns, conversations).

    A conversation c begins with the first h turns of conversation c - c % block (all if it has fewer, none if it is not
    there), h being crc32 of c in decimal modulo ``heads``, and goes on with its own turns after its first h. The turns
    are numbered anew; conversations are (conv_id, rows), those without a turn included.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    numbered = scratch.keep(numbered, "turns")
    first = numbered.where((c % block == 0) & (F.col("at") < heads)).groupBy(c.alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", "tokens"))).alias("head"))
    convs = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")).withColumns({"base": c - c % block, "h": h})
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<at:bigint,digest:binary,tokens:bigint>>")), F.lit(1), F.col("h"))
    convs = scratch.keep(convs.join(first, "base", "left").select("conv_id", "rows", "h", head.alias("head")).withColumn("taken", F.size("head")), "convs")
    own = join_keys(numbered, convs.select("conv_id", "h", "taken", "rows"), ["conv_id"], "rows").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "tokens")
    lead = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.at", "x.digest", "x.tokens")
    return own.unionByName(lead), convs.select("conv_id", "rows")


def _paths(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, p1, p2, depth, q1, q2, tokens, before), a row for each conversation and node on its path, the root too.

    The key of a prefix is 128 bits, the exclusive or of hashes of each turn with its depth; q is that of the parent, and
    before the tokens of the turns before the last.
    """
    depth = F.col("at")
    rows = turns.select("conv_id", depth.alias("depth"), "tokens", F.xxhash64(F.lit(1), depth, "digest").alias("x1"), F.xxhash64("digest", F.lit(2), depth).alias("x2"), F.expr(f"(at - 1) div {BLOCK}").alias("blk"))
    along = Window.partitionBy("conv_id", "blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"p1": F.bit_xor("x1").over(along), "p2": F.bit_xor("x2").over(along), "before": F.sum("tokens").over(along) - F.col("tokens")})
    rows = scratch.keep(rows, "blocks")
    ends = rows.groupBy("conv_id", "blk").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.sum("tokens").alias("bt"))
    if not rows.where("blk > 0").isEmpty():
        earlier = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("conv_id", "blk", *[f(c).over(earlier).alias(c) for f, c in ((F.bit_xor, "b1"), (F.bit_xor, "b2"), (F.sum, "bt"))]).where("blk > 0")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        rows = rows.join(carried, ["conv_id", "blk"], "left")
        rows = rows.withColumns({"p1": F.col("p1").bitwiseXOR(zero("b1")), "p2": F.col("p2").bitwiseXOR(zero("b2")), "before": F.col("before") + zero("bt")})
    rows = rows.select("conv_id", *KEY, F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "tokens", "before")
    zero = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    return scratch.keep(rows.unionByName(convs.select("conv_id", *zero(*KEY, "q1", "q2", "tokens", "before"))), "paths")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id to pieces of each key's comma-joined list of ids."""
    key, ids, size, seq = None, [], 0, 0
    rows: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], names=[*KEY, "seq", "ids"])

    for batch in batches:
        for *k, part, conv in zip(*[batch.column(c).to_pylist() for c in (*KEY, "part", "conv_id")]):
            if k != key or size >= CHUNK_BYTES:
                if ids:
                    rows.append((*key, (seq_part << 32) + seq, ",".join(ids)))
                seq = seq + 1 if k == key else 0
                key, ids, size, seq_part = k, [], 0, part
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(rows) > 1000:
            yield flushed()
    if ids:
        rows.append((*key, (seq_part << 32) + seq, ",".join(ids)))
    if rows:
        yield flushed()


def _hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and place to a SHA-256 of each key's whole list; only the hash's state is held."""
    key, state = None, None
    for batch in batches:
        rows: list[tuple] = []
        for *k, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")]):
            if k != key:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if rows:
            yield _digest_batch(rows)
    if key is not None:
        yield _digest_batch([(*key, state.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])


def _end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id). Ids are sorted and joined in ranges; SHA-256 takes a list in order, so one
    task reads the joined pieces of a node, a row for each 64 KB of its ids."""
    ranged = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    pieces = ranged.mapInArrow(_joined_ids, "p1 long, p2 long, depth long, seq long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "seq").mapInArrow(_hashed_lists, "p1 long, p2 long, depth long, ends_sha256 string")


def trie_nodes(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of numbered turns (conv_id, at, digest, tokens) of the conversations (conv_id), a row for each.

    conv_id is the smallest member, depth the number of turns, parent_conv_id the parent's smallest member, null for the
    root; n_convs, n_children and n_leaves (childless nodes below, itself included) are counts; saved_tokens is the sum,
    over all nodes below and itself, of the tokens of its last turn for each member but one; ends_sha256 digests the ids
    of the members that end there, ascending, joined by commas. Without conversations there are no rows.
    """
    paths = _paths(turns, convs, scratch)
    # Marks owned nodes. The filter lets Spark keep the first of each key inside every map task before it is exchanged.
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("conv_id"))
    owned = scratch.keep(paths.withColumn("nth", first).where("nth = 1").drop("nth", "tokens"), "owned")
    least = lambda c: F.min_by(c, "depth").alias(c)
    mine = scratch.keep(owned.groupBy("conv_id").agg(F.min("depth").alias("from"), least("before"), least("q1"), least("q2")), "mine")
    # The parent of a conversation's first owned node is another's; all its other nodes have parents of its own.
    upward = mine.where("from > 0").select("conv_id", F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("from") - 1).alias("depth"))
    parents = upward.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).join(owned.select(*KEY, F.col("conv_id").alias("up")), KEY)
    parents = scratch.keep(parents, "parents")
    up = join_keys(upward, parents, KEY, "size").select("conv_id", "up")

    ends = paths.groupBy("conv_id").agg(F.max("depth").alias("n"), F.sum("tokens").alias("total"), F.max_by("p1", "depth").alias("p1"), F.max_by("p2", "depth").alias("p2"))
    facts = ends.join(mine.select("conv_id", "from", "before"), "conv_id", "left").join(up, "conv_id", "left")
    branching = parents.select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.col("depth").alias("cd"))
    owns_end = F.col("from").isNotNull()
    met = owns_end & (F.col("p1") == F.col("c1")) & (F.col("p2") == F.col("c2")) & (F.col("n") == F.col("cd"))
    facts = facts.join(branching, met, "left").select(
        "conv_id", "n", F.col("p1").alias("e1"), F.col("p2").alias("e2"), "up", (F.col("n") + 1).alias("size"),
        F.coalesce("from", F.col("n") + 1).alias("from"),
        F.coalesce("before", "total").alias("unowned"),
        (owns_end & F.col("cd").isNull()).cast("long").alias("leaf"),
    )
    facts = scratch.keep(facts, "facts")

    rows = join_keys(paths.select("conv_id", *KEY, "before"), facts.drop("e1", "e2"), ["conv_id"], "size")
    child = (F.col("from") <= F.col("depth") + 1) & (F.col("n") > F.col("depth"))
    parent = F.when(F.col("from") < F.col("depth"), F.col("conv_id")).when(F.col("from") == F.col("depth"), F.col("up"))
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.max(parent).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("unowned") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    digests = _end_digests(facts.select(F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.col("n").alias("depth"), "conv_id"))
    out = nodes.join(digests, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return scratch.result(out, "trie")


def prefix_trie(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes (see ``trie_nodes``) of conversations as they stand."""
    scratch = Scratch(turns.sparkSession, "trie")
    numbered = scratch.keep(numbered_turns(turns, scratch, conv=conv, turn=turn, role=role, text=text), "turns")
    return trie_nodes(numbered, numbered.select("conv_id").distinct(), scratch)


def rebuilt_trie(turns: DataFrame, *, block: int = 100, heads: int = 6) -> DataFrame:
    """The nodes of conversations that begin like the first of their block (see ``shared_heads``)."""
    scratch = Scratch(turns.sparkSession, "trie")
    return trie_nodes(*shared_heads(numbered_turns(turns, scratch), scratch, block, heads), scratch)
