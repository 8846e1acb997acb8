"""Splits that keep related records together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.spellings import model_key
from corpusmill.operators.graph import connected_components
from corpusmill.runtime import running_total, stage


def related_groups(df: DataFrame, row: str, ties: dict[str, F.Column]) -> DataFrame:
    """(row, group): rows that share a value of any of the tie columns, or are linked by a chain of such, have one group.

    `ties` names and gives the tie keys; null keys tie nothing, and a row without any key is a group of its own. Rows
    with repeated `row` values are one row. The graph's nodes are the keys, not the rows: a key that a third of all
    rows share is one node, and the edges are the distinct pairs of keys, so hot keys cost nothing extra.
    """
    names = list(ties)
    node = lambda n, c: F.when(c.isNotNull(), F.xxhash64(F.lit(n), c))
    keyed = stage(df.select(F.col(row).alias("row"), *[node(n, c).alias(f"k{i}") for i, (n, c) in enumerate(ties.items())]), "tie-keys")
    first = F.coalesce(*[F.col(f"k{i}") for i in range(len(names))])
    edges = None
    for i in range(len(names)):
        e = keyed.select(first.alias("u"), F.col(f"k{i}").alias("v")).where("v is not null").distinct()
        edges = e if edges is None else edges.unionByName(e)
    comp = connected_components(edges)
    lone = F.xxhash64(F.lit("row"), F.col("row"))
    return keyed.withColumn("node", first).join(comp, "node", "left").select("row", F.coalesce("component", lone).alias("group")).distinct()


def fill_levels(deficits: list[float], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each split gets when every next group goes to the split furthest below its target."""
    got = [0] * len(deficits)
    lo, hi = min(deficits) - size * (count + 1), max(deficits) + size
    need = lambda level: [max(0, math.floor((d - level) / size)) for d in deficits]
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(need(mid)) >= count:
            lo = mid
        else:
            hi = mid
    got = need(hi)
    rest = count - sum(got)
    for _ in range(max(0, rest)):
        k = max(range(len(deficits)), key=lambda j: (deficits[j] - got[j] * size, -j))
        got[k] += 1
    return got


def grouped_split(groups: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(row, group, split) for (row, group): every group whole in one split, splits near their shares of the rows.

    Groups go largest first to the split furthest below its target. Groups of equal size are alike, so the choice is made on
    the histogram of sizes, of which there are at most sqrt(2 * rows); the groups of a size take their split by rank.
    """
    if abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("shares must be non-negative and sum to 1")
    spark = groups.sparkSession
    sized = stage(groups.groupBy("group").agg(F.count("*").alias("size")), "group-sizes")
    histogram = sized.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()  # bounded by sqrt(2 * rows)
    total = sum(r["size"] * r["n"] for r in histogram)
    names = list(shares)
    left = [shares[s] * total for s in names]
    ranges = []
    for r in histogram:
        at = 0
        for k, c in enumerate(fill_levels(left, r["size"], r["n"])):
            if c:
                ranges.append((r["size"], at, at + c, names[k]))
                left[k] -= c * r["size"]
                at += c
    schema = T.StructType([T.StructField("size", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("split", T.StringType())])
    plan = spark.createDataFrame(ranges, schema)
    ranked = running_total(sized.withColumn("_h", F.xxhash64(F.lit(seed), "group")), ["_h", "group"], "_r", by="size")
    # the plan has at most 3 rows for each size and a split: within sqrt(18 * rows) rows, 14 MB for 1e10 rows
    assigned = ranked.join(F.broadcast(plan), "size").where("_r >= lo and _r < hi").select("group", "split")
    return groups.join(assigned, "group").select("row", "group", "split")


def split_shares(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(split, target_share, n_rows, n_groups, share_reached) of grouped_split()'s rows; a split without rows is reported with 0."""
    goal = assigned.sparkSession.createDataFrame(list(shares.items()), "split string, target_share double")
    got = assigned.groupBy("split", "group").agg(F.count("*").alias("m")).groupBy("split").agg(F.sum("m").alias("n_rows"), F.count("*").alias("n_groups"))
    all_ = got.agg(F.sum("n_rows").alias("total"))
    j = goal.join(got, "split", "left").crossJoin(F.broadcast(all_))  # one row on the right
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select("split", "target_share", z("n_rows").alias("n_rows"), z("n_groups").alias("n_groups"), F.coalesce(F.col("n_rows") / F.col("total"), F.lit(0.0)).alias("share_reached"))


def model_ties(df: DataFrame) -> dict[str, F.Column]:
    return {"model": model_key(F.col("model")), "id": F.nullif(F.trim("id"), F.lit(""))}


def tied_models(df: DataFrame, row: str = "rec_no") -> DataFrame:
    """(model_a < model_b): values of `model`, as they stand in the field, whose rows lie in one group of related_groups()."""
    from corpusmill.operators.blocks import pairs_within

    groups = related_groups(df, row, model_ties(df))
    named = df.where(model_key(F.col("model")).isNotNull()).select(F.col(row).alias("row"), "model")
    values = groups.join(named, "row").select("group", "model").distinct()
    return pairs_within(values, ["group"], "model", block=512).select(F.col("a").alias("model_a"), F.col("b").alias("model_b")).distinct()
