"""Connected components of a graph that is a DataFrame of links.

Every task first unites the links that it has (union-find over its own nodes),
so that each node is left with one link a task. If what is left is at most
``LINKS_AT_ONCE`` rows, one more union-find ends the work. Else alternate star
contractions hang every node below the least node that its neighbours know,
until nothing moves: each step aggregates before it shuffles, joins in a way
that AQE may split, and is written to the shared folder, so a star of any size
and a lost executor are both harmless. Either way gives the same components.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored


#: Links, some 10 MB, that one task may unite.
LINKS_AT_ONCE = 250_000


def united(batches):
    """Arrow batches of (node, its least known node) from batches of links (u, v): union-find with path halving."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            above.setdefault(u, u)
            above.setdefault(v, v)
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for start in range(0, len(nodes), 100_000):
        part = nodes[start : start + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], names=["u", "v"])


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, least): each directed link with the least of u and what u is linked to."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "least").alias("least"))


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    starred = _star(links)
    return starred.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(starred.select("u", F.col("least").alias("v")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0))).head())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (a, b) touches; component: the least node that it reaches."""
    schema = "u bigint, v bigint"
    pairs = stored(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(lean(united), schema))
    if pairs.count() <= LINKS_AT_ONCE:
        return pairs.coalesce(1).mapInArrow(lean(united), schema).select(F.col("u").alias("node"), F.col("v").alias("component"))
    pairs = stored(pairs.where("u <> v").distinct())
    state = _state(pairs)
    while True:
        pairs = stored(_small(_large(pairs).distinct()).where("u <> v").distinct())
        now = _state(pairs)
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
