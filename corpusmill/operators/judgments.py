"""Graded and instruction relevance judgments from counts by facet; the lists of relevant documents are never made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import stage

#: Gains by axis for the closest to the farthest tier.
GAINS = {"class": (3.0, 2.0, 1.0), "form": (3.0, 1.0), "category": (3.0, 2.0)}
#: Instructions as (facet that must agree, facet that must not).
INSTRUCTIONS = {"same_class_other_form": ("cls", "form"), "same_form_other_class": ("form", "cls"), "same_topic_other_class": ("topics", "cls"), "same_audience_other_register": ("aud", "reg")}


def discount(k: Column, cut: int) -> Column:
    """The sum of 1 / log2(i + 1) for i from 1 to least(k, cut), from a table of cut + 1 values."""
    import math

    sums = [0.0]
    for i in range(1, cut + 1):
        sums.append(sums[-1] + 1 / math.log2(i + 1))
    return F.element_at(F.array(*[F.lit(x) for x in sums]), (F.least(F.greatest(k, F.lit(0)), F.lit(cut)) + 1).cast("int"))


def ideal_dcg(tiers: list[tuple[float, Column]], cut: int) -> Column:
    """The best DCG at `cut` of tiers (gain, number of documents), best first."""
    total, seen = F.lit(0.0), F.lit(0)
    for gain, n in tiers:
        upto = seen + F.greatest(n, F.lit(0))
        total = total + F.lit(gain) * (discount(upto, cut) - discount(seen, cut))
        seen = upto
    return total


def matches(f: str, a: Column, b: Column) -> Column:
    """Whether two documents agree in a facet; a missing one never agrees, topics agree in one at least."""
    return F.coalesce(F.arrays_overlap(a, b) if f == "topics" else a == b, F.lit(False))


def counts_by(docs: DataFrame, on: list[str]) -> DataFrame:
    """(*on, n): documents by facets, all of them known."""
    cond = " and ".join(f"{c} is not null" for c in on)
    return docs.where(cond).groupBy(*on).agg(F.count("*").alias("n"))


#: Sets of more topics than this are compared one by one: a set of n has 2^n - 1 subsets.
FEW = 8


def subsets(topics: Column) -> Column:
    """Every subset of an array but the empty one, each in the array's order."""
    none = F.array(F.array().cast("array<string>"))
    return F.filter(F.aggregate(topics, none, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x))))), lambda s: F.size(s) > 0)


def sets_that_meet(q: DataFrame, d: DataFrame) -> DataFrame:
    """Pairs of a row of q (qt, ...) and one of d (topics, ...) that share a topic, where a set of more than FEW topics is among the two, with `overlap`, how many they share."""
    few_q, few_d = F.size("qt") <= FEW, F.size("topics") <= FEW
    out = None
    for left, right in ((q, d.where(~few_d)), (q.where(~few_q), d.where(few_d))):
        met = left.select("*", F.explode("qt").alias("t")).join(right.select("*", F.explode("topics").alias("t")).hint("merge"), "t")  # files of sets say little of their size in memory: never sent to all
        # a pair meets at each topic that it shares; only the first of them counts
        met = met.withColumn("both", F.array_intersect("qt", "topics")).where(F.col("t") == F.col("both")[0]).withColumn("overlap", F.size("both").cast("long")).drop("t", "both")
        out = met if out is None else out.unionByName(met)
    return out


def topic_counts(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(topics, cls, shared, shared_same): for each set of topics and class of the queries the documents with a topic of the set, and those of the same class among them.

    topics must be sorted, each once. Documents are counted by subset of their topics, and a query's subsets of one topic add, those of two subtract, and so
    on: a document that shares k topics with it is counted once in all. So the work is by sets, never by pairs of sets that share a hot topic.
    """
    d = docs.where(F.size("topics") > 0).groupBy("topics", "cls").agg(F.count("*").alias("n"))
    q = queries.where(F.size("topics") > 0).select(F.col("topics").alias("qt"), F.col("cls").alias("qc")).distinct()
    by_class = stage(d.where(F.size("topics") <= FEW).select(F.explode(subsets(F.col("topics"))).alias("s"), "cls", "n").groupBy("s", "cls").agg(F.sum("n").alias("n")), "subsets")
    every = by_class.groupBy("s").agg(F.sum("n").alias("n"))
    of = q.where(F.size("qt") <= FEW).select("qt", "qc", F.explode(subsets(F.col("qt"))).alias("s"))
    sign = F.when(F.size("s") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    same = by_class.select("s", F.col("cls").alias("qc"), F.col("n").alias("n_same"))
    few = of.join(every, "s").join(same, ["s", "qc"], "left").select("qt", "qc", (sign * F.col("n")).alias("n"), (sign * F.coalesce("n_same", F.lit(0))).alias("n_same"))
    many = sets_that_meet(q, d).select("qt", "qc", "n", F.when(F.coalesce(F.col("cls") == F.col("qc"), F.lit(False)), F.col("n")).otherwise(0).alias("n_same"))
    return few.unionByName(many).groupBy(F.col("qt").alias("topics"), F.col("qc").alias("cls")).agg(F.sum("n").alias("shared"), F.sum("n_same").alias("shared_same"))
