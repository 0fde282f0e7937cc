"""Connected components by alternating stars (Kiveris et al., 2014), all as joins.

Links live in tables, never on the driver; rounds grow with the logarithm of
the longest chain. A hub's links stay spread out: its smallest neighbour is
found by partial aggregates and joined back as a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..joins import BROADCAST_ROWS, hot_join
from ..scratch import Scratch


def _alone(links: DataFrame, run: Callable[[list, list], tuple[list, list]], name: str) -> DataFrame:
    """(node, name) by run(a, b) of all links (a, b) in one task; for links counted to be few."""
    kind = links.schema["a"].dataType.simpleString()

    def batches(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in held:
            a.extend(batch.column(0).to_pylist())
            b.extend(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(x, kept) for x in run(a, b)], ["node", name])

    kept = to_arrow_type(links.schema["a"].dataType)
    return links.coalesce(1).mapInArrow(lambda held: batches(held), f"node {kind}, {name} {kind}")


def _united(a: list, b: list) -> tuple[list, list]:
    of: dict = {}

    def root(x):
        while of.setdefault(x, x) != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        of[max(x, y)] = min(x, y)
    return list(of), [root(x) for x in of]


def _led(a: list, b: list) -> tuple[list, list]:
    later: dict = {}
    for x, y in zip(a, b, strict=True):
        later.setdefault(min(x, y), []).append(max(x, y))
        later.setdefault(max(x, y), [])
    of: dict = {}
    for x in sorted(later):
        if of.setdefault(x, x) == x:
            for y in later[x]:
                of.setdefault(y, x)
    return list(of), list(of.values())


def sized_components(scratch: Scratch, links: DataFrame, tag: str = "links") -> DataFrame:
    """``components``; of few links in one task, without a round of joins."""
    links = scratch.write(links.select("a", "b").where("a <> b").distinct(), f"{tag}-all")
    if links.count() > BROADCAST_ROWS:
        return components(scratch, links, tag)
    return scratch.write(_alone(links, _united, "root"), f"{tag}-alone")


def sized_leaders(scratch: Scratch, links: DataFrame, tag: str = "leaders") -> DataFrame:
    """``leaders`` of stored links; of few in one task, without a round of joins."""
    if links.count() > BROADCAST_ROWS:
        return leaders(scratch, links, tag)
    return scratch.write(_alone(links.select("a", "b").where("a <> b"), _led, "leader"), f"{tag}-alone")


def _smallest(links: DataFrame, total: int) -> DataFrame:
    """Each link (u, v) with m: the smallest of u and its neighbours."""
    m = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).withColumn("m", F.least("m", "u"))
    return hot_join(links, m, ["u"], "size", total).select("u", "v", "m")


def _stars(links: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on another node."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(scratch: Scratch, links: DataFrame, tag: str = "links") -> DataFrame:
    """(node, root) of every node in links (a, b); root is the smallest node of its component."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, turn = scratch.write(now, f"{tag}-0"), 0
    while not _stars(now):
        n = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large, f"{tag}-large-{turn}", small=n <= BROADCAST_ROWS)
        small = _smallest(large, n)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        now = scratch.write(small, f"{tag}-{turn}", small=n <= BROADCAST_ROWS)
        scratch.drop(f"{tag}-{turn - 1}", f"{tag}-large-{turn - 1}")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def leaders(scratch: Scratch, links: DataFrame, tag: str = "leaders") -> DataFrame:
    """(node, leader): in order of node, each node not yet taken leads and takes its linked later nodes.

    The same result as walking the nodes one by one, in rounds: a node leads
    once all smaller linked nodes have been taken by others, and is taken by
    the smallest linked node that leads.
    """
    both = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("before")).where("node <> before").distinct()
    nodes = both.select("node").union(both.select("before")).distinct()
    both = scratch.write(both, f"{tag}-links")
    state = scratch.write(nodes.select("node", F.lit(None).cast(nodes.schema["node"].dataType).alias("leader")), f"{tag}-0")
    turn = 0
    while not state.where("leader is null").isEmpty():
        of = state.select(F.col("node").alias("before"), F.col("leader").alias("before_leader"))
        seen = both.join(of, "before").groupBy("node").agg(
            F.min(F.when(F.col("before_leader") == F.col("before"), F.col("before"))).alias("taker"),
            F.max(F.when(F.col("before_leader").isNull(), F.col("before"))).alias("open"),
            F.min(F.when(F.col("before_leader").isNull(), F.col("before"))).alias("first_open"),
        )
        joined = state.join(seen, "node", "left")
        # a smaller node that may still lead goes first
        taken = F.when(F.col("taker").isNotNull() & (F.col("first_open").isNull() | (F.col("taker") < F.col("first_open"))), F.col("taker"))
        free = F.when(F.col("taker").isNull() & F.col("open").isNull(), F.col("node"))
        turn += 1
        state = scratch.write(joined.select("node", F.coalesce("leader", taken, free).alias("leader")), f"{tag}-{turn}")
        scratch.drop(f"{tag}-{turn - 1}")
    return state
