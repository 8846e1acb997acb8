"""Connected components by distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import stage, unstage


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of a graph held in memory; vectorised hooking and pointer jumping."""
    nodes, idx = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = idx[: len(u)], idx[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        pa, pb = parent[a], parent[b]
        lo, hi = np.minimum(pa, pb), np.maximum(pa, pb)
        if (lo == hi).all():
            break
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return nodes, nodes[parent]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's edges, reduced batch by batch to a spanning forest of stars: memory is bounded by its nodes."""
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for pdf in batches:
        u, v = local_forest(np.concatenate([u, pdf["u"].to_numpy()]), np.concatenate([v, pdf["v"].to_numpy()]))
    if len(u):
        yield pd.DataFrame({"u": v, "v": u})  # root, node


#: Ties that one task may hold while forests are merged, and how many forests are merged at a level.
TASK_TIES, FAN_IN, SALTS = 4_000_000, 8, 32


def _tagged_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    for pdf in _forest(batches):
        yield pdf.assign(task=TaskContext.get().partitionId())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of an edge list of bigint ids; component is the smallest node of the component.

    Edges are spread over tasks and each task reduces its share to a local forest of stars. Forests are merged level by level,
    FAN_IN at a time, while a task's share stays within TASK_TIES; a graph that small ends as one forest. A larger one goes on in rounds: every
    tie moves to the least root known for its node and for its root, ties are exchanged by node, never by root, and
    reduced again, until each node has one root. A component of most nodes is thus spread over all tasks at every step; the roots' own moves
    are joined on a salted key. Nulls and loops: edges with a null end are dropped, a loop makes its node a component
    of one. Nothing reaches the driver but numbers of rows.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    stars = stage(e.mapInPandas(_tagged_forest, "u long, v long, task int"), "forest")
    ties, parts = (stars.agg(F.count("*"), F.countDistinct("task")).first())
    while parts > 1 and ties * FAN_IN <= TASK_TIES * parts or 1 < parts <= FAN_IN and ties <= TASK_TIES:
        merged = -(-parts // FAN_IN)
        at = stars.select("u", "v", F.floor(F.col("task") / F.lit(FAN_IN)).alias("task"))
        up = stage(at.repartition(merged, "task").mapInPandas(_tagged_forest, "u long, v long, task int"), "forest")
        unstage(stars)
        stars, parts = up, merged
        if parts > 1:
            ties, parts = stars.agg(F.count("*"), F.countDistinct("task")).first()
    if parts <= 1:
        return stars.select(F.col("v").alias("node"), F.col("u").alias("component"))
    stars = stars.select("u", "v")
    for _ in range(max_rounds):
        least = stage(stars.groupBy("v").agg(F.min("u").alias("least"), F.max("u").alias("most")), "least")
        if least.where("least <> most").isEmpty():
            return least.select(F.col("v").alias("node"), F.col("least").alias("component"))
        roots = stars.select(F.col("u").alias("v")).distinct()
        moving = least.where("least < v").join(roots, "v", "left_semi").select(F.col("v").alias("u"), F.col("least").alias("above"))
        salted = moving.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        moved = stars.join(least.drop("most"), "v").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        moved = moved.join(salted, ["u", "salt"], "left").withColumn("to", F.least("least", F.coalesce("above", "u")))
        ties = moved.select(F.col("to").alias("u"), F.explode(F.array("u", "v")).alias("v")).distinct()
        up = stage(ties.repartition("v").mapInPandas(_forest, "u long, v long"), "forest")
        stars = up
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
