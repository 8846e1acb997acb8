"""Multilabel metrics from the cells that are true, predicted or scored; all other cells are counted, never made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def cells(truth: DataFrame, scored: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(id, label, y, p, score) for ids on both sides: cells with a true label, or with a score (predicted where it reaches `least`). Labels outside the space are ignored."""
    t = truth.join(F.broadcast(labels), "label", "left_semi").select("id", "label", F.lit(1).alias("y")).distinct()  # the label space is a small table
    s = scored.join(F.broadcast(labels), "label", "left_semi").groupBy("id", "label").agg(F.max("score").alias("score"))
    ids = truth.select("id").distinct().join(scored.select("id").distinct(), "id")
    j = t.join(s, ["id", "label"], "full").join(ids, "id", "left_semi")
    score = F.coalesce("score", F.lit(0.0))
    return j.select("id", "label", F.coalesce("y", F.lit(0)).alias("y"), (score >= least).cast("int").alias("p"), score.alias("score"))


def per_label(c: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support, num_predicted) for each label of the space."""
    g = c.groupBy("label").agg(F.sum("y").alias("support"), F.sum("p").alias("num_predicted"), F.sum(F.col("y") * F.col("p")).alias("tp"))
    j = labels.join(g, "label", "left").fillna(0)
    return j.select("label", _div(F.col("tp"), F.col("num_predicted")).alias("precision"), _div(F.col("tp"), F.col("support")).alias("recall"), _div(2 * F.col("tp"), F.col("support") + F.col("num_predicted")).alias("f1"), "support", "num_predicted")


def bundle(c: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: n, micro, macro, weighted and samples F1, subset accuracy and Hamming loss."""
    n_labels = labels.agg(F.count("*").alias("n_labels"))
    row = c.groupBy("id").agg(F.sum("y").alias("t"), F.sum("p").alias("k"), F.sum(F.col("y") * F.col("p")).alias("tp"))
    r = row.agg(
        F.count("*").alias("n"), F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("k").alias("k"), F.avg(_div(2 * F.col("tp"), F.col("t") + F.col("k"))).alias("f1_samples"),
        F.avg(F.when((F.col("t") == F.col("tp")) & (F.col("k") == F.col("tp")), 1.0).otherwise(0.0)).alias("subset_accuracy"),
    )
    lab = per_label(c, labels).agg(F.avg("f1").alias("f1_macro"), _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))
    j = r.crossJoin(lab).crossJoin(n_labels)  # rows of one
    loss = (F.col("t") + F.col("k") - 2 * F.col("tp")) / (F.col("n").cast("double") * F.col("n_labels"))
    return j.select("n", _div(2 * F.col("tp"), F.col("t") + F.col("k")).alias("f1_micro"), "f1_macro", "f1_weighted", "f1_samples", "subset_accuracy", loss.alias("hamming_loss"))


def ranking(c: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: lrap and coverage_error over ids with a true label; rank of a label: how many have at least its score, unscored ones at 0."""
    n_labels = F.broadcast(labels.agg(F.count("*").alias("n_labels")))  # one row
    w = Window.partitionBy("id").orderBy(F.desc("score"))  # the labels of one id
    r = c.withColumn("at_least", F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("true_at_least", F.sum("y").over(w.rangeBetween(Window.unboundedPreceding, 0))).where("y = 1").crossJoin(n_labels)
    rank = F.when(F.col("score") > 0, F.col("at_least")).otherwise(F.col("n_labels"))
    by = r.groupBy("id").agg(F.avg(F.col("true_at_least") / rank).alias("lrap"), F.max(rank).alias("depth"))
    return by.agg(F.coalesce(F.avg("lrap"), F.lit(0.0)).alias("lrap"), F.coalesce(F.avg("depth"), F.lit(0.0)).alias("coverage_error"))


def mean_average_precision(c: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (map_micro, map_macro): recall steps times precision at distinct scores; cells without a score form the last step. Labels without a positive are left out of the macro mean."""
    n = c.agg(F.countDistinct("id").alias("n"))

    def ap(by: list[str], cells_each: Column, extra: DataFrame) -> DataFrame:
        g = c.where("score > 0").groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.count("*").alias("m"))
        all_pos = c.groupBy(*by).agg(F.sum("y").alias("all_pos"))
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        w = w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct score
        step = g.withColumn("step", F.col("pos") * F.sum("pos").over(w) / F.sum("m").over(w))
        s = step.groupBy(*by).agg(F.sum("step").alias("s"), F.sum("pos").alias("found"))
        j = (all_pos.join(s, by, "left") if by else all_pos.crossJoin(s)).crossJoin(F.broadcast(extra)).fillna(0, ["s", "found"])
        left = F.col("all_pos") - F.col("found")
        return j.where("all_pos > 0").select((F.col("s") + left * F.col("all_pos") / cells_each).alias("s"), "all_pos").select((F.col("s") / F.col("all_pos")).alias("ap"))

    size = n.crossJoin(labels.agg(F.count("*").alias("n_labels")))  # rows of one
    macro = ap(["label"], F.col("n"), size).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map_macro"))
    micro = ap([], F.col("n").cast("double") * F.col("n_labels"), size).agg(F.coalesce(F.max("ap"), F.lit(0.0)).alias("map_micro"))
    return micro.crossJoin(macro)
