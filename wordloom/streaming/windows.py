"""Context windows over a stream of timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import memberships


def stream_sections(events: DataFrame, *, ts: str = "ts", key: str = "user_id", left_s: int = 5, mid_s: int = 20, right_s: int = 5, late: str = "10 minutes") -> DataFrame:
    """(key, k, side, n, first_ts, last_ts) of streamed or finished events: a word goes to its mid window and, by
    membership, to its neighbours' contexts before the aggregation, so one keyed state per section is all that is held.

    k counts windows of ``mid_s`` from the epoch. A section closes when the watermark passes the end of the window in
    which its words lie, so a right context closes with the window that it is the beginning of. Words later than
    ``late`` behind the newest are left out. Contexts may be no longer than ``mid_s``.
    """
    if max(left_s, right_s) > mid_s:
        raise ValueError("a context is longer than its window")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    spread = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(F.col(key).alias(key), F.col(ts).alias(ts), F.explode(memberships(micros, left_s * 1_000_000, mid_s * 1_000_000, right_s * 1_000_000)).alias("m"))
    rows = spread.select(key, ts, F.window(ts, f"{mid_s} seconds").alias("own"), "m.k", "m.side")
    return rows.groupBy(key, "own", "k", "side").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(key, "k", "side", "n", "first_ts", "last_ts")
