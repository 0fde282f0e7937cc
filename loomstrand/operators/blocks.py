"""Every pair of rows once, without a cross join: blocks of rows meet blocks.

Rows are dealt to blocks by a hash; a row goes to the pairs of blocks that its
own block is in. One task holds two blocks at a time and sends on only what
its kernel keeps.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 512


def dealt(key: str, n: int, block_rows: int) -> tuple[int, Column]:
    """How many blocks ``n`` rows have, and the block of a row."""
    blocks = max(1, -(-n // block_rows))
    return blocks, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def block_pairs(rows: DataFrame, n: int, key: str, kernel: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """kernel(left, right, same) for each pair of blocks; with ``same`` both are one block."""
    blocks, own = dealt(key, n, block_rows)
    met = rows.withColumn("own_block", own).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.withColumn("low_block", F.least("own_block", "other_block")).withColumn("high_block", F.greatest("own_block", "other_block")).drop("other_block")

    def run(group: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        low, high = group["low_block"][0].as_py(), group["high_block"][0].as_py()
        return kernel(group.filter(pc.equal(group["own_block"], low)), group.filter(pc.equal(group["own_block"], high)), low == high)

    return met.groupBy("low_block", "high_block").applyInArrow(lambda g: run(g), schema)
