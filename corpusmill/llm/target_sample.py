"""A sample that matches target proportions over several category margins."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.spellings import LABELS, aliases, facet_key
from corpusmill.runtime import hash_unit, stage

FACETS = list(LABELS)


def canonical_facets(df: DataFrame, label_space: DataFrame, row_id: str = "id") -> DataFrame:
    """(id, facet, category), each once: the clean terms that the rows of an id have, whatever their spelling.

    Null ids, null and empty fields, and values that are no term of the label space give nothing.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), facet_key(f).alias("key")) for f in FACETS])).alias("x")
    long = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), stacked).select("id", "x.facet", "x.key").where("key is not null")
    terms = aliases(label_space).withColumnRenamed("term", "category")  # bounded: a few spellings for each term
    return long.join(F.broadcast(terms), ["facet", "key"]).select("id", "facet", "category").distinct()


def smallest(df: DataFrame, key: Column, k: int) -> DataFrame:
    """The k rows of smallest positive key (a double; ties by all of it), found by radix selection: counts by ever finer bucket, no global sort."""
    if k <= 0:
        return df.limit(0)
    # the logarithm of any positive double lies within; a power of two moves the point only, so finer buckets lie in coarser ones to the last bit
    rest = (F.ln(F.greatest(key, F.lit(1e-300))) + F.lit(1024.0)) / F.lit(2048.0)
    below, inside, left = F.lit(False), F.lit(True), k
    for _ in range(4):
        at = F.floor(rest * 4096.0)
        counts = df.where(inside).groupBy(at.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # at most 4096
        for r in counts:
            if r["n"] >= left:
                break
            left -= r["n"]
        else:
            return df
        below, inside = below | (inside & (at < r["b"])), inside & (at == r["b"])
        rest = rest * 4096.0 - at
        if r["n"] == left:
            return df.where(below | inside)
    edge = df.where(inside).orderBy(key, *df.columns).limit(left)
    return df.where(below).unionByName(edge)


#: Part of what is still wanted that each drawing takes; the last one takes all of it.
DRAWINGS = (0.8, 0.8, 0.8, 1.0)


def rake(cells: pd.DataFrame, goals: dict[str, dict[str, float]], rounds: int, tol: float) -> np.ndarray:
    """Mass of each cell after iterative proportional fitting to the goals of all facets: starts in proportion to what is left in it, never above it.

    Cells without a category of a facet follow their other facets, unless there is a goal for "" too; categories without a goal get nothing.
    """
    stock = cells["left"].to_numpy(float)
    size = max((sum(g.values()) for g in goals.values()), default=0.0)
    mass = stock / max(stock.sum(), 1.0) * size
    margins = []
    for f, goal in goals.items():
        codes, names = pd.factorize(cells[f].astype(object).where(cells[f].notna(), ""))
        margins.append((codes, np.array([goal.get(x, 0.0 if x else np.nan) for x in names])))
    for _ in range(rounds):
        worst = 0.0
        for codes, goal in margins:
            have = np.bincount(codes, mass, len(goal))
            free = np.isnan(goal)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(free | (have <= 0), 1.0, goal / have)
            worst = max(worst, float(np.abs(np.where(free, 0.0, have - goal)).max(initial=0.0)) / max(size, 1.0))
            mass = np.minimum(mass * ratio[codes], stock)
        if worst < tol:
            break
    return mass


def _drawn(spark, ids: DataFrame, cells: pd.DataFrame, rates: np.ndarray, seed: int) -> DataFrame:
    """ids with their weighted exponential key -ln(u) / rate; a key of at most 1 has the probability 1 - exp(-rate)."""
    table = cells[FACETS].astype(object).where(cells[FACETS].notna(), None).assign(rate=rates)
    weights = spark.createDataFrame(table[rates > 0], ", ".join([*(f"{f} string" for f in FACETS), "rate double"]))
    same = reduce(and_, [F.col(f"i.{f}").eqNullSafe(F.col(f"w.{f}")) for f in FACETS])
    # a row for each cell: at most the product of the facets' sizes, whatever the data's
    return ids.alias("i").join(F.broadcast(weights.alias("w")), same).select("i.*", (-F.ln(hash_unit(F.col("i.id"), seed=seed)) / F.col("w.rate")).alias("key"))


def target_sample(df: DataFrame, label_space: DataFrame, targets: DataFrame, seed: int = 0, rounds: int = 200, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """A sample of distinct ids near the target counts of every facet, and the report of residual gaps by category.

    `targets` is (facet, category, target_share, min_records, sample_fraction); a category wants max(share * fraction * n, minimum) ids.
    An id counts for every category that one of its rows has; its cell is the least category of each facet. The ids are counted by cell
    (at most the product of the margins' sizes, whatever the data's) and the cells' masses are raked to all margins at
    once by iterative proportional fitting. Each id gets the weighted exponential key -ln(u) / -ln(1 - mass / stock), which is at most 1
    with the probability that raking gave its cell. The draw goes in steps: most of what is wanted first, then the cells that
    are left are raked to what each category still lacks, so chance misses of one step are made up in the next; the
    last step takes the ids of smallest keys. Then every category below its minimum gets its next ids by key. Ids that lack a
    category of some facet are drawn by their other facets; as they count for fewer categories, the sample may be larger than fraction * n by their number.
    Report: available, wanted, sampled, share reached, gap, can_be_met = available >= wanted. Empty tables give an empty sample; a category
    without rows is reported with 0.
    """
    spark = df.sparkSession
    n = df.where("id is not null").select("id").distinct().count()
    goals = targets.groupBy("facet", "category").agg(F.max("target_share").alias("target_share"), F.max("min_records").alias("min_records"), F.max("sample_fraction").alias("sample_fraction"))
    goal_rows = goals.collect()  # one row for each category of the label space
    has = stage(canonical_facets(df, label_space), "facets")
    cell = has.groupBy("id").agg(*[F.min(F.when(F.col("facet") == f, F.col("category"))).alias(f) for f in FACETS])
    ids = stage(df.where("id is not null").select("id").distinct().join(cell, "id", "left"), "ids")
    cells = ids.groupBy(*FACETS).agg(F.count("*").alias("left")).toPandas()  # cells: bounded by the product of the facets' sizes
    wanted = {f: {r["category"]: (r["target_share"] or 0.0) * (r["sample_fraction"] or 0.0) * n for r in goal_rows if r["facet"] == f} for f in FACETS}
    wanted = {f: g for f, g in wanted.items() if sum(g.values()) > 0}
    drawn, rest = None, ids
    for step, part in enumerate(DRAWINGS if wanted else ()):
        mass = rake(cells, wanted, rounds, tol)
        if not step:  # from here on the plan is what raking gave each category, ids without one among them: it agrees over all facets
            wanted = {f: pd.Series(mass).groupby(cells[f].fillna("").to_numpy()).sum().to_dict() for f in wanted}
        mass = mass * part
        with np.errstate(divide="ignore"):
            rates = np.minimum(-np.log1p(-np.minimum(mass / np.maximum(cells["left"].to_numpy(float), 1), 1.0)), 1e12)
        keyed = _drawn(spark, rest, cells, rates, seed + step)
        if part < 1:
            now = stage(keyed.where("key <= 1").drop("key"), "drawn")
        else:
            now = stage(smallest(stage(keyed, "keys"), F.col("key"), int(round(mass.sum()))).drop("key"), "drawn")
        took = now.groupBy(*FACETS).agg(F.count("*").alias("took")).toPandas()
        cells = cells.merge(took, on=FACETS, how="left").fillna({"took": 0})
        for f, g in wanted.items():
            got = cells.groupby(cells[f].fillna(""))["took"].sum()
            wanted[f] = {c: max(0.0, w - got.get(c, 0)) for c, w in g.items()}
        cells = cells.assign(left=cells["left"] - cells["took"]).drop(columns="took")
        drawn = now if drawn is None else drawn.unionByName(now)
        if part < 1:
            rest = stage(rest.join(now.select("id"), "id", "left_anti"), "rest")
    drawn = (ids.limit(0) if drawn is None else drawn).select("id", F.lit("drawn").alias("why"))
    got = has.join(drawn, "id").groupBy("facet", "category").agg(F.count("*").alias("sampled"))
    short = goals.join(got, ["facet", "category"], "left").select("facet", "category", (F.col("min_records") - F.coalesce("sampled", F.lit(0))).alias("need")).where("need > 0")
    spare = has.join(F.broadcast(short), ["facet", "category"]).join(drawn, "id", "left_anti").withColumn("key", hash_unit(F.col("id"), seed=seed))  # a row for each category
    order = Window.partitionBy("facet", "category").orderBy("key", "id")  # row_number below a bound: each task keeps only its first few
    most = max([r["min_records"] or 0 for r in goal_rows], default=0)
    extra = spare.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).where("r <= need").select("id", F.lit("minimum").alias("why")).distinct()
    sample = stage(drawn.unionByName(extra), "sample")
    size = max(sample.count(), 1)
    available = has.groupBy("facet", "category").agg(F.count("*").alias("available"))
    reached = has.join(sample, "id").groupBy("facet", "category").agg(F.count("*").alias("sampled"))
    report = goals.join(available, ["facet", "category"], "left").join(reached, ["facet", "category"], "left")
    want = F.greatest(F.col("target_share") * F.col("sample_fraction") * F.lit(n), F.col("min_records").cast("double"))
    report = report.select("facet", "category", "target_share", "min_records", F.coalesce("available", F.lit(0)).alias("available"), want.alias("wanted"), F.coalesce("sampled", F.lit(0)).alias("sampled"))
    report = report.withColumn("share_reached", F.col("sampled") / F.lit(size)).withColumn("gap", F.col("sampled") - F.col("wanted")).withColumn("can_be_met", F.col("available") >= F.col("wanted"))
    return sample.join(ids, "id"), report
