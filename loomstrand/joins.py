"""Joins that hold whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a broadcast side, at most; more rows take a shuffle join.
BROADCAST_ROWS = 200_000
#: A key with more than this share of all rows is hot; there are at most as
#: many hot keys as its inverse says, so these can be broadcast at any scale.
HOT_SHARE = 1 / 1000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` lacks, near the given ones."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small, else as it is.

    Give it stored tables: the count is a job of its own.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", listed: bool = False) -> DataFrame:
    """Join each row to its group, whatever share of the rows one group holds.

    ``groups`` has one row for each key with the number of its rows in
    ``size``. Groups over ``HOT_SHARE`` of ``total`` are broadcast, so their
    rows stay where they are; the others meet by a shuffle whose largest key
    is bounded by that share.

    With ``listed``, for stored groups, the hashes of the hot keys are read in
    a job of its own and both sides are parted by that list, so that no join
    passes on every row just to mark it.
    """
    least = max(1000, int(total * HOT_SHARE))
    if total < least:
        return rows.join(groups, keys, how)
    if listed:
        own = F.xxhash64(*[F.col(k).cast(rows.schema[k].dataType) for k in keys])
        found = [r[0] for r in groups.where(F.col(size) >= least).select(own).distinct().collect()]
        if not found:
            return rows.join(groups, keys, how)
        hot = own.isin(found)
        return rows.where(hot).join(F.broadcast(groups.where(hot)), keys, how).unionByName(rows.where(~hot).join(groups.where(~hot), keys, how))
    hot = groups.where(F.col(size) >= least)
    cold = groups.where(F.col(size) < least)
    mark = fresh(rows, "is_hot")[0]
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias(mark))), keys, "left")
    warm = marked.where(F.col(mark)).drop(mark).join(F.broadcast(hot), keys, "inner")
    rest = marked.where(F.col(mark).isNull()).drop(mark).join(cold, keys, how)
    return warm.unionByName(rest)
