"""Training batches of label rows of about equal length, padded batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode as E
from .windows import running_before


def length_batches(rows: DataFrame, key: str, ids: str, size: int) -> DataFrame:
    """rows with batch, from 0: runs of ``size`` rows in order of the length of ``ids``, then of the key as text; the last
    may be smaller. Keys are distinct. Places are prefix sums over ranges of lengths, not a sort in one task, so rows of
    one batch differ little in length and take little padding."""
    place, before = "__collate_place", "__collate_before"
    placed = rows.withColumn(place, F.concat(F.lpad(F.size(ids).cast("string"), 10, "0"), F.lit(":"), F.col(key).cast("string")))
    earlier = running_before(placed.select(place, F.lit(1).alias("one")), place, "one").withColumnRenamed("before", before)
    return placed.join(earlier, place).withColumn("batch", F.expr(f"cast({before} as bigint) div {size}")).drop(place, before)


def collated(rows: DataFrame, ids: str, start_id: int, *, batch: str = "batch", multiple: int = 1, pad_id: int = 0) -> DataFrame:
    """rows with width, cut, labels and decoder_input_ids, padded to the longest of their batch.

    Where all rows of a batch begin with the start id it is cut from all of them (cut), as the decoder's input puts it there
    anyway; a batch in which one row does not keeps every row's first id. Labels beyond a row's own are ignored in losses; in
    the decoder's input they are ``pad_id``. width, after the cut, is a multiple of ``multiple`` before it.
    """
    whole = Window.partitionBy(batch)
    longest = F.ceil(F.max(F.size(ids)).over(whole) / multiple) * multiple
    starts = F.min(F.coalesce(F.get(ids, F.lit(0)) == start_id, F.lit(False))).over(whole)
    rows = rows.withColumns({"width": longest, "cut": starts}).withColumn("width", F.greatest(F.col("width") - F.col("cut").cast("int"), F.lit(0)).cast("int"))
    own = F.when(F.col("cut"), F.slice(ids, 2, F.greatest(F.size(ids), F.lit(1)))).otherwise(F.col(ids))
    labels = E.pad_labels(own, F.col("width"))
    return rows.withColumn("labels", labels).withColumn("decoder_input_ids", F.when(F.col("width") > 0, E.shift_right(F.col("labels"), start_id, pad_id=pad_id)).otherwise(F.array().cast("array<int>")))
