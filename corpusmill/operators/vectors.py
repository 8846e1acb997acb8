"""Vectors: checks of norms, singular values of term weights, clusters and classifier heads on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import lexical
from corpusmill.operators.graph import connected_components
from corpusmill.runtime import stage


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v divided by its norm; the zero vector stays as it is."""
    bound = F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double"))))
    return bound[0]


def pair_dot(pairs: DataFrame, weights: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, dot) for listed pairs over sparse weights(doc, term, weight): only the pairs' documents are joined, by term within the pair."""
    left = pairs.join(weights.select(F.col("doc").alias(a), "term", F.col("weight").alias("wa")), a)
    right = weights.select(F.col("doc").alias(b), "term", F.col("weight").alias("wb"))
    dots = left.join(right, [b, "term"]).groupBy(a, b).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.join(dots, [a, b], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))


def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for pdf in batches:
        if len(pdf):
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pd.DataFrame({"row": np.arange(len(total)), "g": list(total)})


def svd_basis(vectors: DataFrame, k: int) -> np.ndarray:
    """The first k right singular vectors of vectors(doc, v), from the sum of the tasks' Gram matrices: width x width numbers, whatever the rows. Signs: the largest entry of each is positive."""
    rows = vectors.select("v").mapInPandas(gram, "row long, g array<double>")
    flat = rows.select("row", F.posexplode("g").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x")).collect()  # width squared
    n = max((r["row"] for r in flat), default=-1) + 1
    if not n:
        return np.zeros((0, 0))
    g = np.zeros((n, n))
    for r in flat:
        g[r["row"], r["col"]] = r["x"]
    w, v = np.linalg.eigh(g)
    basis = v[:, np.argsort(w)[::-1][:k]]
    return basis * np.where(np.abs(basis).max(0) == basis.max(0), 1, -1)


def term_vectors(table: DataFrame, vocab: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(doc, v): counts of the vocabulary's terms in rows of token_table(), log-damped and weighted, as dense rows of its width."""
    at = {w: i for i, w in enumerate(vocab)}
    idf = np.array([1.0 if weights is None else weights[w] for w in vocab])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ts in pdf["ts"]:
                i = [at[w] for w in ts if w in at]
                v = np.log1p(np.bincount(i, minlength=len(at))) * idf if i else np.zeros(len(at))
                size = np.sqrt((v * v).sum())
                out.append(v / size if size else v)
            yield pd.DataFrame({"doc": pdf["doc"], "v": out})

    return table.mapInPandas(run, f"doc {table.schema['doc'].dataType.simpleString()}, v array<double>")


def embed_texts(docs: DataFrame, doc: str, text: str, features: int = 512, dim: int = 32, use_idf: bool = True) -> DataFrame:
    """(doc, v): texts as `dim` numbers by term weights and their first singular vectors, of unit length; no more numbers than terms."""
    table = lexical.token_table(docs, doc, text)
    df = lexical.document_frequencies(table)
    top = df.orderBy(F.desc("df"), "term").limit(features).collect()  # as many as features
    n = table.where("dl > 0").count()
    weights = {r["term"]: float(np.log((n + 1) / (r["df"] + 1)) + 1) for r in top} if use_idf else None
    vectors = stage(term_vectors(table, [r["term"] for r in top], weights), "vectors")
    basis = svd_basis(vectors, min(dim, len(top)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()) @ basis if len(pdf) and basis.size else np.zeros((len(pdf), basis.shape[1]))
            size = np.sqrt((x * x).sum(1, keepdims=True))
            yield pd.DataFrame({"doc": pdf["doc"], "v": list(np.divide(x, size, out=np.zeros_like(x), where=size > 0))})

    return vectors.mapInPandas(run, vectors.schema)


def linked_clusters(vectors: DataFrame, least: float, neighbours: int = 10) -> DataFrame:
    """(doc, cluster): components of the links between each vector and its `neighbours` nearest ones of cosine `least` or more (single linkage cut at that height, over nearest neighbours)."""
    near = lexical.dense_top(vectors, vectors, neighbours).where(F.col("score") >= least).select(F.col("query").alias("u"), F.col("doc").alias("v"))
    every = vectors.select(F.col("doc").alias("u"), F.col("doc").alias("v"))
    return connected_components(near.unionByName(every)).select(F.col("node").alias("doc"), F.col("component").alias("cluster"))


def kmeans(vectors: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(doc, cluster) by k-means over unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select("doc", array_to_vector(unit(F.col("v"))).alias("features"))
    if vectors.isEmpty():
        return vectors.select("doc", F.lit(0).alias("cluster"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x).select("doc", F.col("prediction").alias("cluster"))


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with `weight`: all classes weigh the same together."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    t = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    w = n.crossJoin(F.broadcast(t)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one row on the right
    return rows.join(F.broadcast(w), label)  # a row for each class


def head(train: DataFrame, test: DataFrame, kind: str = "linear", seed: int = 7) -> DataFrame:
    """(doc, truth, pred) of a classifier fitted on train(doc, v, label) with balanced classes: logistic regression or a forest."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    as_rows = lambda df: df.select("doc", "label", array_to_vector(unit(F.col("v"))).alias("features"))
    if train.isEmpty() or test.isEmpty():
        return test.limit(0).select("doc", F.col("label").alias("truth"), F.lit(0).alias("pred"))
    model = LogisticRegression(weightCol="weight", maxIter=50, regParam=0.01) if kind == "linear" else RandomForestClassifier(weightCol="weight", numTrees=40, maxDepth=8, seed=seed)
    fitted = model.setLabelCol("label").fit(balanced(as_rows(train)))
    return fitted.transform(as_rows(test)).select("doc", F.col("label").alias("truth"), F.col("prediction").cast("int").alias("pred"))
