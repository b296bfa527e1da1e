"""Selection and substitution: what looks like loops over lists are joins here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_else


def of_listed(rows: DataFrame, names: DataFrame, key: str, name: str = "value") -> DataFrame:
    """Rows whose key is listed; repeated names do not repeat rows."""
    return rows.join(names.select(F.col(name).alias(key)), key, "left_semi")


def select_ids(rows: DataFrame, ids: DataFrame, key: str, id_: str = "value", *, strict: bool = False) -> DataFrame:
    """A row for each listed id, repeated ids included. With ``strict`` an unknown id is an error when the row is read."""
    wanted = ids.select(F.col(id_).alias(key))
    if not strict:
        return wanted.join(rows, key)
    marked = wanted.join(rows.withColumn("__select_known", F.lit(True)), key, "left")
    check = F.when(F.col("__select_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("unknown id "), F.col(key).cast("string"))).cast(rows.schema[key].dataType))
    return marked.withColumn(key, check).drop("__select_known")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order: an aggregate with partial steps, no sort of a key's rows."""
    others = [c for c in rows.columns if c != key]
    last = F.col("__select_row")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.col(order)).alias("__select_row")).select(key, *[last.getField(c).alias(c) for c in others])


def substitute(rows: DataFrame, position: str, valid: str, divisor: int = 3000, used: str = "used") -> DataFrame:
    """Rows where an invalid one takes the values of the row at ``position div divisor``, valid or not; adds that position
    in a column of the name ``used``, which rows must not have."""
    if used in rows.columns:
        raise ValueError(f"rows have a column {used} already")
    others = [c for c in rows.columns if c not in (position, valid)]
    whole = F.struct(*[F.col(f"`{c}`") for c in others]).alias("__select_row")
    good = F.coalesce(F.col(valid), F.lit(False))
    kept = rows.where(good).select(position, F.col(position).alias(used), whole)
    wanted = rows.where(~good).select(position, F.expr(f"`{position}` div {divisor}").alias(used))
    replaced = wanted.join(rows.select(F.col(position).alias(used), whole), used).select(position, used, "__select_row")
    return kept.unionByName(replaced).select(position, used, *[F.col("__select_row").getField(c).alias(c) for c in others])


def leaked(first: DataFrame, second: DataFrame) -> DataFrame:
    """Names in both lists."""
    return first.intersect(second)


def id_prefix(rows: DataFrame, key: str, digits: str) -> DataFrame:
    """Rows whose id, as text, begins with one of the digits."""
    return rows.where(F.col(key).cast("string").rlike(f"^[{digits}]"))


def _draw(key: str, seed: int) -> Column:
    """A place in a seeded order: the MD5 of seed and key in hexadecimal, then the key."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")), F.lit(":"), text)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows in an order that the seed and the key alone decide; rows of one key stand together."""
    return rows.orderBy(_draw(key, seed))


def whole_batches(rows: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """Shuffled rows with batch, from 0; what does not fill a last batch is left out. Keys are distinct. Places are prefix
    sums over ranges of the shuffled keys, not a sort in one task."""
    from .windows import running_before

    placed = rows.withColumn("__select_place", _draw(key, seed))
    before = running_before(placed.select("__select_place", F.lit(1).alias("one")), "__select_place", "one").withColumnRenamed("before", "__select_before")
    total = rows.count()
    found = placed.join(before, "__select_place").where(F.col("__select_before") < total // size * size)
    return found.withColumn("batch", F.floor(F.col("__select_before") / size)).drop("__select_place", "__select_before")


def flatten_chunks(docs: DataFrame) -> DataFrame:
    """A row for each chunk of documents of chunks (filename, chunks), with its times as one flat row."""
    c = docs.select(F.explode("chunks").alias("c")).select("c.*")
    t = lambda s, w: F.col(f"{s}.{w}_time")
    return c.select(
        F.col("global_chunk_number").cast("string").alias("chunk_id"),
        F.col("segmented_puncted_text").alias("text"),
        or_else(t("left", "start"), t("mid", "start")).alias("start_time"),
        or_else(t("right", "end"), t("mid", "end")).alias("end_time"),
        *[t(s, w).alias(f"{s[0]}{w}_time") for s in ("left", "mid", "right") for w in ("start", "end")],
        "filename",
    )


def chunk_dictionary(docs: DataFrame) -> DataFrame:
    """Flat chunks, one for each id, the last in order of file and place."""
    placed = docs.select("filename", F.posexplode("chunks").alias("place", "c"))
    one = placed.groupBy(F.col("c.global_chunk_number").alias("id")).agg(F.max_by("c", F.struct("filename", "place")).alias("c"))
    return flatten_chunks(one.select(F.array("c").alias("chunks")))
