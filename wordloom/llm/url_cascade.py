"""URL filters: a Bloom filter cascade that answers list membership exactly and without joins."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import UPPER, let

#: One level may hold so many bits (1 MB); above it ``BloomCascade.build`` refuses, and keys are dealt over more cascades.
MAX_BITS = 1 << 23
MOST_PARTS = 4096


@dataclass(frozen=True)
class Level:
    """One Bloom filter: n_bits in 64-bit words, n_hashes probes by double hashing with a level seed."""

    seed: int
    n_bits: int
    n_hashes: int
    words: tuple[int, ...]

    def probes(self, key: Column) -> list[Column]:
        return _probes(key, self.seed, self.n_bits, self.n_hashes)

    def holds(self, key: Column) -> Column:
        table = F.array(*[F.lit(w) for w in self.words]) if len(self.words) <= 64 else F.lit(list(self.words))
        hit = F.lit(True)
        for bit in self.probes(key):
            word = F.get(table, F.floor(bit / F.lit(64)).cast("int"))
            hit = hit & F.getbit(word, (bit % 64).cast("int")).eqNullSafe(F.lit(1))
        return hit


def _probes(key: Column, seed: int, n_bits: int, n_hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(n_bits).cast("long")) for i in range(n_hashes)]


@dataclass(frozen=True)
class BloomCascade:
    """Levels 1, 3, 5 ... encode listed keys, levels 2, 4, 6 ... the other keys of the universe that the
    level before wrongly passes. A key is listed if the first level that rejects it is an even one,
    or if it passes all of an odd number of levels. Exact for every key of the universe."""

    levels: tuple[Level, ...] = field(default=())

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[depth].holds(key), answer).otherwise(F.lit(depth % 2 == 1))
        return F.coalesce(answer, F.lit(False)) if self.levels else F.lit(False)

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, *, max_bits: int = MAX_BITS, first_rate: float = 1 / 64, rate: float = 0.5) -> BloomCascade:
        """listed and universe: one string column each; nulls and repeats are dropped.

        The universe is scanned once, through level 1, and is never shuffled whole: only the keys
        that level 1 passes are made distinct and flagged, by a partial aggregate. Later levels see
        that remnant. What reaches the driver are filters, whose size ``max_bits`` bounds. An empty
        list gives a cascade without levels, which contains nothing.
        """
        listed = listed.toDF("key").where("key is not null").distinct()
        n = listed.count()
        if not n:
            return cls()
        levels = [_fill(listed, 1, _bits(n, first_rate), _hashes(first_rate), max_bits)]
        passed = universe.toDF("key").where(F.col("key").isNotNull() & levels[0].holds(F.col("key"))).select("key", F.lit(0).alias("on_list"))
        rest = passed.unionByName(listed.select("key", F.lit(1).alias("on_list"))).groupBy("key").agg(F.max("on_list").alias("on_list")).persist()
        try:
            while True:
                depth = len(levels)
                encodes_listed = depth % 2 == 0
                pending = rest.where(F.col("on_list") == int(encodes_listed))
                for level in levels[1:]:
                    pending = pending.where(level.holds(F.col("key")))
                left = pending.count()
                if not left:
                    return cls(tuple(levels))
                levels.append(_fill(pending.select("key"), depth + 1, _bits(left, rate), _hashes(rate), max_bits))
        finally:
            rest.unpersist()


@dataclass(frozen=True)
class CascadeSet:
    """Cascades over parts of the keys by a hash: as many as keep every level within its bound, one for most lists."""

    parts: tuple[BloomCascade, ...]

    @staticmethod
    def part(key: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(n)).cast("int")

    def contains(self, key: Column) -> Column:
        answer = self.parts[0].contains(key)
        for i, cascade in enumerate(self.parts[1:], 1):
            answer = F.when(self.part(key, len(self.parts)) == i, cascade.contains(key)).otherwise(answer)
        return answer

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, *, max_bits: int = MAX_BITS) -> CascadeSet:
        """As ``BloomCascade.build``, with a scan of the universe for each part; parts double until all levels fit."""
        n, key = 1, F.col("key")
        while True:
            try:
                return cls(tuple(BloomCascade.build(listed.where(cls.part(key, n) == i), universe.where(cls.part(key, n) == i), max_bits=max(64, max_bits)) for i in range(n)))
            except OverflowError:
                if 2 * n > MOST_PARTS:
                    raise
                n *= 2


def _bits(n: int, rate: float) -> int:
    return max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))


def _hashes(rate: float) -> int:
    return max(1, round(-math.log2(rate)))


def _fill(keys: DataFrame, seed: int, n_bits: int, n_hashes: int, max_bits: int) -> Level:
    if n_bits > max_bits:
        raise OverflowError(f"level {seed} needs {n_bits} bits, more than {max_bits}")
    bits = keys.select(F.explode(F.array(*_probes(F.col("key"), seed, n_bits, n_hashes))).alias("bit"))
    rows = bits.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("value")).collect()
    table = [0] * (n_bits // 64)
    for row in rows:
        table[row["word"]] = row["value"]
    return Level(seed, n_bits, n_hashes, tuple(table))


def host_and_path(url: Column) -> Column:
    """A struct of host (A-Z lower-cased) and path; both empty where url is null or has no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.struct(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule that could fit: each suffix of the host at a label, joined to each path prefix of a listed length."""

    def suffixes(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return let(prefixes, lambda ps: F.flatten(F.transform(let(F.split(host, r"\.", -1), suffixes), lambda h: F.transform(ps, lambda p: F.concat(h, p)))))


def judge_urls(pages: DataFrame, block: list[str], allow: list[str], *, id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """Block or allow every url by host and path rules like ``example.net/en/``.

    Columns: id, host, path, rule, verdict. A rule fits its host and the host's subdomains where the
    url's path starts with the rule's path; the longest fitting rule wins, block before allow if one
    rule stands in both lists. A url that no rule fits has a null rule and the cascades' verdict on
    an unlisted key: allow. Null urls, and urls without ``://``, have an empty host and path, so no
    rule fits. Repeated rows, null ids and empty tables pass through; other columns are not read.

    Two cascades, one per action, over the candidate keys of all urls. A list too long for filters of
    ``max_bits`` is dealt over several cascades by a hash of the key; there is no join at any length.
    """
    spark = pages.sparkSession
    rules = {**{r: "allow" for r in allow}, **{r: "block" for r in block}}
    lengths = sorted({len(r) - r.index("/") for r in rules})
    parts = pages.select(F.col(id_col).alias("id"), host_and_path(F.col(url_col)).alias("u"))
    keyed = parts.select("id", "u", candidate_keys(F.col("u.host"), F.col("u.path"), lengths).alias("keys")) if rules else parts.withColumn("keys", F.array().cast("array<string>"))
    universe = keyed.select(F.explode("keys").alias("key"))
    blocks, allows = (CascadeSet.build(_list(spark, [r for r, a in rules.items() if a == action]), universe, max_bits=max_bits) for action in ("block", "allow"))
    labelled = F.transform("keys", lambda k: F.struct(k.alias("key"), F.when(blocks.contains(k), "block").when(allows.contains(k), "allow").alias("action")))
    fitting = keyed.select("id", "u", F.filter(labelled, lambda x: x["action"].isNotNull()).alias("fits"))
    longest = F.aggregate(F.col("fits"), F.lit(None).cast("struct<key:string,action:string>"), lambda a, x: F.when(a.isNull() | (F.length(x["key"]) > F.length(a["key"])), x).otherwise(a))
    return fitting.select("id", "u", longest.alias("best")).select(F.col("id").alias(id_col), F.col("u.host").alias("host"), F.col("u.path").alias("path"), F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))


def _list(spark: SparkSession, rules: list[str]) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rules], "key string")
