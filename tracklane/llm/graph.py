"""Connected components of links between integer ids, without gathering them anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import staged


class Forest:
    """Union-find over arbitrary ids; a tree's root is its least id."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.parent
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root and x != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


    def fresh(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """Those of the links (a, b) that join what was apart."""
        kept = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if self.join(x, y)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], names=["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's links as one star per component: the least id, and the others."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = np.fromiter(forest.parent, dtype=np.int64, count=len(forest.parent))
    roots = np.fromiter((forest.find(x) for x in nodes.tolist()), dtype=np.int64, count=len(nodes))
    apart = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(roots[apart])], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every id with a link; root is the least id of its component, and its own root.

    links: two columns of ids (long), in any order and number. Partitions first
    contract their own links; then, until nothing changes, every node keeps its
    least parent, its other parents are hung below that one, and parents are
    replaced by their own parents. All steps are joins and pre-aggregated
    minima on keys; each round is written to the shared folder.
    """
    a, b = links.columns
    apart = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = staged(apart.mapInArrow(_stars, "node long, root long").distinct(), "stars")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "root")).alias("x")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        least = edges.groupBy("node").agg(F.min("root").alias("least"))
        with_least = edges.join(least, "node")
        hung = with_least.select(F.explode(F.array(F.struct("node", F.col("least").alias("root")), F.struct(F.col("root").alias("node"), F.col("least").alias("root")))).alias("e")).select("e.*").where("node <> root").distinct()
        above = hung.groupBy("node").agg(F.min("root").alias("up")).withColumnRenamed("node", "root")
        edges = staged(hung.join(above, "root", "left").select("node", F.coalesce("up", "root").alias("root")).union(above.select(F.col("root").alias("node"), F.col("up").alias("root"))).distinct(), "stars")
    roots = edges.select("root").distinct()
    return edges.union(roots.select(F.col("root").alias("node"), "root"))
