"""Connected components of an edge table: few edges in one task, more by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import dropped, record_batch, stored

EDGES = 500_000  # distinct edges, of 16 bytes each, that one task joins

_NODES = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), ascending, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    to = list(range(len(nodes)))  # a node's own index or a smaller one of its component
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        while to[a] != a:
            to[a] = a = to[to[a]]
        while to[b] != b:
            to[b] = b = to[to[b]]
        to[max(a, b)] = min(a, b)
    for i, x in enumerate(to):
        to[i] = to[x]
    return nodes, nodes[np.array(to, dtype=np.int64)]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if len(b)]
    if parts:
        yield record_batch(_NODES, smallest_reachable(*(np.concatenate(side) for side in zip(*parts, strict=True))))


def connected_components(edges: DataFrame, few: int = EDGES) -> DataFrame:
    """node and component (its smallest node) for every node of edges (a, b).

    Nodes are longs; edges from a node to itself or without a node count for nothing, and
    no edges give no rows. At most few distinct edges are joined in one task. Of more, each
    round lets every node point its larger neighbours, then its smaller ones, at the
    smallest; edges go through the shared folder between rounds, which cost the driver
    many plans, tasks and broadcasts. Only counts and a checksum reach the driver.
    """
    spark = edges.sparkSession
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= few:
        found = stored(now.repartition(1).mapInArrow(_in_one_task, "node long, component long"), "components")
        dropped(spark, now)
        return found
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = stored(small, "edges")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, now)
        now = new
        if seen == mark:
            break
        mark = seen
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
