"""Running sums along an order inside each key, whatever share of the rows a key holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch

PART, ROW, SALT = "__scan_part", "__scan_row", "__scan_salt"


def _changes(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Whether the key of each row but the first differs from that of the row before; nulls are equal."""
    n = batch.num_rows
    out = np.zeros(max(n - 1, 0), bool)
    for name in by:
        column = batch.column(name)
        a, b = column.slice(0, n - 1), column.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out |= differ.to_numpy(zero_copy_only=False)
    return out


def _local(batches: Iterator[pa.RecordBatch], by: list[str], sums: dict[str, str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    last, carry, place = None, dict.fromkeys(sums, 0), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = [batch.column(c)[0].as_py() for c in by]
        new = np.concatenate(([key != last], _changes(batch, by)))
        starts, segment = np.flatnonzero(new), np.cumsum(new) - 1
        columns = dict(zip(batch.schema.names, batch.columns))
        for name, value in sums.items():
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            base = before[starts][np.maximum(segment, 0)] if len(starts) else np.zeros(n, np.int64)
            before = np.where(segment >= 0, before - base, before + carry[name])
            carry[name] = int(before[-1] + v[-1])
            columns[name] = pa.array(before)
        columns[ROW] = pa.array(np.arange(place, place + n))
        last, place = [batch.column(c)[n - 1].as_py() for c in by], place + n
        yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)


def running(rows: DataFrame, scratch: Scratch, name: str, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with, for each new column in ``sums``, the sum of its value over the rows before in the same key.

    Values are longs without nulls; keys and order may be null, nulls come first; rows equal in key and order come in any
    order. All rows are range-partitioned by key and order, so a key that holds a third of them is spread over a third of
    the tasks; sums run inside a partition, and what earlier partitions hold of a partition's first key is added
    afterwards: a row for each partition at most, which is what is broadcast. No rows give no rows.
    """
    salted = rows.withColumn(SALT, F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*by, *order, SALT).sortWithinPartitions(*by, *order, SALT).drop(SALT)
    ranged = ranged.withColumn(PART, F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, *[T.StructField(c, T.LongType()) for c in (*sums, ROW)]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    kept = scratch.keep(ranged.mapInArrow(lambda batches: _local(batches, by, sums, arrow), schema), name)

    keys = [f"__scan_key{i}" for i in range(len(by))]
    key = F.struct(*[F.col(c).alias(k) for c, k in zip(by, keys)])
    so_far = F.struct(*[(F.col(c) + F.col(v)).alias(c) for c, v in sums.items()])
    edges = kept.groupBy(PART).agg(F.min_by(key, ROW).alias("first"), F.max_by(key, ROW).alias("last"), F.max_by(so_far, ROW).alias("total"))
    ends = edges.select(PART, "last.*", *[F.col("total")[c].alias(c) for c in sums], F.lit(1).alias("kind"))
    starts = edges.select(PART, "first.*", *[F.lit(0).cast("long").alias(c) for c in sums], F.lit(0).alias("kind"))
    earlier = Window.partitionBy(*keys).orderBy(PART, "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(starts).select(PART, *keys, "kind", *[F.sum(c).over(earlier).alias(f"__scan_{c}") for c in sums]).where("kind = 0").drop("kind")
    carried = carried.where(" OR ".join(f"`__scan_{c}` IS NOT NULL" for c in sums)).withColumnRenamed(PART, "__scan_at")
    same = F.col(PART) == F.col("__scan_at")
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    joined = kept.join(F.broadcast(carried), same, "left")
    return joined.select(*rows.columns, *[(F.col(c) + F.coalesce(f"__scan_{c}", F.lit(0))).alias(c) for c in sums])
