"""Connected components of links as DataFrame joins.

Random contraction: every round each node takes the smallest of itself and its neighbours in
an order drawn anew, links are rewritten to these, and the rest is fewer nodes by a constant
factor on average, so rounds grow with the logarithm of the largest component.  Nodes with
very many links only meet partial aggregates and joins whose large side Spark can split.
Once at most ``FINISH`` links are left, one task of that bounded size ends the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.shared import cut_lineage

#: Links that one task may still join; more are contracted by further rounds.
FINISH = 100_000


def join_nodes(links) -> dict[int, int]:
    """Smallest node reachable, for every node of the given links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in links:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links: list[tuple[int, int]] = []
    for batch in batches:
        links += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    roots = join_nodes(links)
    if roots:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())], names=["node", "root"]
        )


def components(links: DataFrame, finish: int = FINISH) -> DataFrame:
    """node, root of every node in ``links`` (a long, b long); equal roots mean one component.

    Loops (a = b) are allowed; an empty frame gives an empty result.
    """
    edges = cut_lineage(links.select("a", "b").filter("a <> b"))
    steps: list[DataFrame] = []
    number = 0
    while True:
        n = edges.count()
        if n <= finish:
            break
        number += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def order(name: str, seed: int = number):
            return F.struct(F.xxhash64(F.col(name), F.lit(seed)).alias("h"), F.col(name).alias("n"))

        nearest = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = cut_lineage(nearest.select(F.col("a").alias("node"), F.least("m", order("a"))["n"].alias("next")))
        steps.append(step)
        to = step.select("node", "next")
        edges = cut_lineage(
            edges.join(to.select(F.col("node").alias("a"), F.col("next").alias("x")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("next").alias("y")), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
    ends = edges.coalesce(1).mapInArrow(_finish, "node long, root long")
    for step in reversed(steps):
        known = ends
        here = step.join(known.withColumnRenamed("node", "next"), "next", "left").select(
            "node", F.coalesce("root", "next").alias("root")
        )
        ends = cut_lineage(here)
    return ends
