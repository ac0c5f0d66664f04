"""Connected components by alternating star contractions, all in the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeline.llm.arrow import bound_batches, materialise


#: So many edges, a few megabytes, are joined in one task.
FEW = 1 << 16


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to rows of every node but the smallest of its component, and that smallest one."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), schema.field(0).type), pa.array([root(x) for x in up], schema.field(1).type)], schema=schema)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a").select("a", "b", F.least("m", "a").alias("m"))
    return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    to_least = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to_least.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def settled(edges: DataFrame) -> bool:
    """Whether edges (a, b) with a > b are stars: no a has two b, and no b is an a. Exact, without digests."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    held = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return held.where("up > 1 or up = 1 and down = 1").isEmpty()


def smallest_reachable(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """For each node of ``edges`` (columns a, b of one orderable type) that isn't the smallest of its component, that smallest node.

    Returns (a, b): node, smallest reachable node. Up to FEW edges, by count, are
    joined in one task. More are contracted in rounds, which end when the edges
    are stars, after about the logarithm of the largest component's diameter;
    RuntimeError beyond ``rounds``. An empty input gives an empty result. Every
    round is written to the shared checkpoint folder.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = materialise(pairs)
    if pairs.count() <= FEW:
        bound_batches(pairs.sparkSession)
        return materialise(pairs.coalesce(1).mapInArrow(_joined, pairs.schema))
    for _ in range(rounds):
        if settled(pairs):
            return pairs
        pairs = materialise(_small_star(_large_star(pairs)))
    raise RuntimeError("components did not settle")
