"""Helpers that keep jobs even and recoverable: shared tables in place of lineage, joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dropped, shared_folder, written

#: A key counts as hot above this share of all rows, so at most 1 / HOT_SHARE keys are hot, and only above HOT_ROWS rows.
HOT_SHARE = 1e-3
HOT_ROWS = 10_000

def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """The keys that hold over HOT_SHARE of the rows with their counts: 1 / HOT_SHARE rows at most, whatever the input."""
    total = rows.count() if total is None else total
    return rows.groupBy(key).count().filter(F.col("count") > max(HOT_ROWS, int(total * HOT_SHARE)))


def joined(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined to facts, which has one narrow row a key, when a few keys may hold most of the rows.

    The facts of hot keys are broadcast (1 / HOT_SHARE rows of fixed width at most); all others are shuffled.
    """
    hot = hot_keys(rows, key, total).select(key).collect()
    if not hot:
        return rows.join(facts, key, how)
    values = [r[0] for r in hot]
    is_hot = F.col(key).isin(values)
    few = facts.filter(is_hot)
    return rows.filter(is_hot).join(F.broadcast(few), key, how).unionByName(rows.filter(~F.coalesce(is_hot, F.lit(False))).join(facts, key, how))


__all__ = ["HOT_ROWS", "HOT_SHARE", "dropped", "hot_keys", "joined", "shared_folder", "written"]
