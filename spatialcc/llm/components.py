"""Connected components on the executors: by alternating large-star and small-star steps, or in one task for few edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialcc.llm.common import land, remove, work_dir


#: Edges up to which one task joins them; their number is counted first. Beyond, steps over all executors do.
SMALL = 200_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and components of all edges of one task; sets are named by their smallest node."""
    up: dict = {}

    def find(x):
        path = []
        while (above := up.setdefault(x, x)) != x:
            path.append(x)
            x = above
        for node in path:
            up[node] = x
        return x

    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, steps: int = 100, small: int | None = None) -> DataFrame:
    """(node, component) for every node that an edge (a, b) links to another; the component is its smallest node.

    Up to `small` edges (SMALL, if not given) are joined by one task. Of more, each step's edges are written to the shared folder and read again; a step moves at most two rows for each edge.
    The number of steps grows with the logarithm of a component's size; if `steps` don't do, an error says so.
    """
    spark = edges.sparkSession
    place = work_dir(spark, "components")
    now = land(edges.select("a", "b").filter("a <> b").distinct(), f"{place}/0")
    if now.count() <= (SMALL if small is None else small):
        kind = now.schema["a"].dataType.simpleString()
        found = land(now.coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}"), f"{place}/found")
        remove(spark, f"{place}/0")
        return found
    said = None
    for step in range(1, steps + 1):
        now = land(_small_star(_large_star(now)), f"{place}/{step}")
        print_of = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, f"{place}/{step - 1}")
        if print_of == said:
            break
        said = print_of
    else:
        raise RuntimeError(f"components are not settled after {steps} steps")
    # All that remains are stars: each node is linked with the smallest of its component.
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = land(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads), f"{place}/found")
    remove(spark, f"{place}/{step}")
    return found
