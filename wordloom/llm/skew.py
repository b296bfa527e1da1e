"""Equi-joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of all rows, so fewer than ``1 / HOT_SHARE`` keys are.
HOT_SHARE = 1 / 1000


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows with the columns of keys, which holds one row for each key and in ``size`` its number of rows.

    Rows of hot keys stay where they are: their keys, under a thousand by what hot means, are sent to them. All others
    are exchanged. Keys without rows, and rows whose key is not in keys, drop out. keys is read four times, so it
    should be a written table.
    """
    total = keys.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) > total * HOT_SHARE
    hot, others = keys.where(is_hot), keys.where(~is_hot)
    if total * HOT_SHARE < 1 or hot.isEmpty():
        return rows.join(keys, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(others, on)
    return rest.unionByName(rows.join(F.broadcast(hot), on))
