"""Retrieval, classification, pair and clustering metrics, all from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg, rr, recall, precision, ap) at k for queries with a relevant document; ranking(query, doc, rank), qrels(query, doc, gain > 0).

    Precision divides by the number returned within k, average precision by all relevant. A query with no returned document scores 0.
    """
    w = Window.partitionBy("query").orderBy(F.desc("gain"), "doc")
    ideal = qrels.withColumn("i", F.row_number().over(w)).groupBy("query").agg(F.sum(F.when(F.col("i") <= k, F.col("gain") / F.log2(F.col("i") + 1))).alias("idcg"), F.count("*").alias("n_rel"))
    got = ranking.where(F.col("rank") <= k).join(qrels, ["query", "doc"], "left")
    hit = F.when(F.col("gain") > 0, 1).otherwise(0)
    run = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumn("hit", hit).withColumn("cum", F.sum("hit").over(run))
    per = got.groupBy("query").agg(
        F.sum(F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum("hit").alias("hits"), F.count("*").alias("returned"), F.sum(F.col("hit") * F.col("cum") / F.col("rank")).alias("psum"),
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(per, "query", "left").select("query", z(F.col("dcg") / F.col("idcg")).alias("ndcg"), z(1 / F.col("first")).alias("rr"), z(F.col("hits") / F.col("n_rel")).alias("recall"), z(F.col("hits") / F.col("returned")).alias("precision"), z(F.col("psum") / F.col("n_rel")).alias("ap"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(truth, pred, n)."""
    return pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def class_metrics(conf: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) for each label of the declared space; a denominator of 0 gives 0."""
    tp = conf.where("truth = pred").select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    pre = conf.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    j = labels.join(tp, "label", "left").join(sup, "label", "left").join(pre, "label", "left").fillna(0)
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return j.select("label", div(F.col("tp"), F.col("predicted")).alias("precision"), div(F.col("tp"), F.col("support")).alias("recall"), div(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support")


def auc(scored: DataFrame) -> DataFrame:
    """One row (auc, n_pos, n_neg) for scored(score, y): rank statistic with ties at their average; 0.5 with one class only.

    Ranks come from counts by distinct score, so no global sort of the rows is needed.
    """
    by = scored.groupBy("score").agg(F.sum("y").alias("pos"), (F.count("*") - F.sum("y")).alias("neg"))
    below = F.sum("neg").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    u = by.withColumn("below", F.coalesce(below, F.lit(0)))
    s = u.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return s.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).otherwise(F.lit(0.5)).alias("auc"), "n_pos", "n_neg")


def average_precision(scored: DataFrame) -> DataFrame:
    """One row (ap): sum of recall steps times precision at distinct scores; 0 with no positives."""
    by = scored.groupBy("score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = by.withColumn("tp", F.sum("pos").over(w)).withColumn("m", F.sum("n").over(w))
    s = c.agg(F.sum(F.col("pos") * F.col("tp") / F.col("m")).alias("s"), F.sum("pos").alias("p"))
    return s.select(F.when(F.col("p") > 0, F.col("s") / F.col("p")).otherwise(F.lit(0.0)).alias("ap"))


def clustering_metrics(pairs: DataFrame) -> DataFrame:
    """One row (homogeneity, completeness, v_measure, nmi, ari, n) for pairs(truth, pred), from the contingency table; entropy 0 gives 1."""
    cell = pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    n = cell.agg(F.sum("n").alias("total"))
    t, p = cell.groupBy("truth").agg(F.sum("n").alias("nt")), cell.groupBy("pred").agg(F.sum("n").alias("np"))
    c2 = lambda x: x.cast("double") * (x - 1) / 2.0
    ent = lambda d, c: d.crossJoin(n).agg(F.sum(-(F.col(c) / F.col("total")) * F.ln(F.col(c) / F.col("total"))).alias(f"h_{c}"), F.sum(c2(F.col(c))).alias(f"s_{c}"))
    mi = cell.join(t, "truth").join(p, "pred").crossJoin(n).agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nt").cast("double") * F.col("np")))).alias("mi"), F.sum(c2(F.col("n"))).alias("s_n"), F.max("total").alias("total"))
    x = mi.crossJoin(ent(t, "nt")).crossJoin(ent(p, "np"))  # rows of one
    h = F.when(F.col("h_nt") <= 0, 1.0).otherwise(F.col("mi") / F.col("h_nt"))
    c = F.when(F.col("h_np") <= 0, 1.0).otherwise(F.col("mi") / F.col("h_np"))
    x = x.withColumn("homogeneity", h).withColumn("completeness", c)
    expected = F.try_divide(F.col("s_nt") * F.col("s_np"), c2(F.col("total")))
    v = F.when(F.col("homogeneity") + F.col("completeness") > 0, 2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness"))).otherwise(F.lit(0.0))
    nmi = F.when(F.col("h_nt") + F.col("h_np") > 0, 2 * F.col("mi") / (F.col("h_nt") + F.col("h_np"))).otherwise(F.lit(1.0))
    ari = F.try_divide(F.col("s_n") - expected, (F.col("s_nt") + F.col("s_np")) / 2 - expected)
    return x.select("homogeneity", "completeness", v.alias("v_measure"), nmi.alias("nmi"), ari.alias("ari"), F.col("total").alias("n"))


def clustering_by(rows: DataFrame, group: str) -> DataFrame:
    """(group, homogeneity, completeness, nmi, n) for rows(group, truth, pred): the contingency tables of all groups in one aggregation."""
    cell = rows.groupBy(group, "truth", "pred").agg(F.count("*").alias("n"))
    n = cell.groupBy(group).agg(F.sum("n").alias("total"))
    side = lambda c, out: cell.groupBy(group, c).agg(F.sum("n").alias(out))
    part = lambda c: F.sum(-(F.col(c) / F.col("total")) * F.ln(F.col(c) / F.col("total")))
    t, p = side("truth", "nt"), side("pred", "np")
    h = t.join(n, group).groupBy(group).agg(part("nt").alias("ht")).join(p.join(n, group).groupBy(group).agg(part("np").alias("hp")), group)
    mi = cell.join(t, [group, "truth"]).join(p, [group, "pred"]).join(n, group).groupBy(group).agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nt").cast("double") * F.col("np")))).alias("mi"), F.max("total").alias("n"))
    one = lambda e: F.when(e <= 0, 1.0).otherwise(F.col("mi") / e)
    nmi = F.when(F.col("ht") + F.col("hp") > 0, 2 * F.col("mi") / (F.col("ht") + F.col("hp"))).otherwise(F.lit(1.0))
    return h.join(mi, group).select(group, one(F.col("ht")).alias("homogeneity"), one(F.col("hp")).alias("completeness"), nmi.alias("nmi"), "n")


def discovery(rows: DataFrame, noise: int = -1) -> DataFrame:
    """clustering_metrics() of rows(truth, pred) without noise, and noise, noise_ratio, clusters_pred, clusters_true, k_error. Where all rows are noise, they are one cluster."""
    s = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("pred") == noise).alias("noise"), F.countDistinct(F.when(F.col("pred") != noise, F.col("pred"))).alias("clusters_pred"), F.countDistinct("truth").alias("clusters_true"))
    kept = rows.crossJoin(F.broadcast(s.select("rows", F.col("noise").alias("_n")))).where((F.col("pred") != noise) | (F.col("_n") == F.col("rows"))).select("truth", "pred")  # one row on the right
    k_error = F.try_divide(F.abs(F.col("clusters_pred") - F.col("clusters_true")), "clusters_true")
    return clustering_metrics(kept).crossJoin(s).withColumn("noise_ratio", F.try_divide("noise", "rows")).withColumn("k_error", k_error)
