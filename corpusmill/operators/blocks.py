"""All pairs within groups, where a group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A group of more members is joined to its size by broadcast: there are at most rows / HEAVY such groups.
HEAVY = 1 << 16


def pairs_within(df: DataFrame, group: list[str], member: str, block: int = 128, keep: list[str] | None = None, where=None) -> DataFrame:
    """Pairs (group, left member < right member) as columns *group, a, b and, for each column of keep, <name>_a and <name>_b.

    Members are distinct within a group. Rows of a group are split into chunks of about `block` members by hash; each pair of chunks is joined by a key of
    its own, so a group of m rows is spread over (m/block)^2/2 tasks' worth of keys and no task holds the group.
    `where(left, right)` gives a condition on the pair, applied while joining.
    """
    keep = keep or []
    rows = df.select(*group, member, *keep)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_m")).where("_m > 1")
    heavy = sizes.where(F.col("_m") > HEAVY)
    # a group of a third of all rows would meet its size in one task: such groups are few and small to send, the others are joined as usual
    sized = rows.join(F.broadcast(heavy), group).unionByName(rows.join(sizes.where(F.col("_m") <= HEAVY), group))
    k = F.ceil(F.col("_m") / F.lit(block))
    chunked = sized.withColumn("_c", F.pmod(F.xxhash64(member), k)).withColumn("_k", k)
    left = chunked.withColumn("_d", F.explode(F.sequence("_c", F.col("_k") - 1)))
    right = chunked.withColumn("_d", F.col("_c")).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c"))))
    right = right.select(*group, "_c", "_d", F.col(member).alias("_r"), *[F.col(x).alias(f"{x}_r") for x in keep])
    left = left.select(*group, "_c", "_d", F.col(member).alias("_l"), *[F.col(x).alias(f"{x}_l") for x in keep])
    cond = F.when(F.col("_c") == F.col("_d"), F.col("_l") < F.col("_r")).otherwise(F.col("_l") != F.col("_r"))
    j = left.join(right, [*group, "_c", "_d"]).where(cond)
    if where is not None:
        j = j.where(where(lambda x: F.col(f"{x}_l"), lambda x: F.col(f"{x}_r")))
    flip = F.col("_l") > F.col("_r")
    side = lambda l, r, n: F.when(flip, F.col(r)).otherwise(F.col(l)).alias(n)
    return j.select(*group, side("_l", "_r", "a"), side("_r", "_l", "b"), *[s for x in keep for s in (side(f"{x}_l", f"{x}_r", f"{x}_a"), side(f"{x}_r", f"{x}_l", f"{x}_b"))])
