"""Lexical statistics and retrieval: postings, vocabulary, idf, TF-IDF, BM25, top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import tokens
from corpusmill.runtime import running_total, spread, stage


#: Terms of queries up to which token arrays are cut by a set held in the plan; more are cut by a join.
PLAN_TERMS = 20_000


def token_table(docs: DataFrame, doc: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(doc, dl, ts), staged: every row's tokens once, cut to `terms` (a column `term`) where given; dl counts all tokens. Each row is a document."""
    t = spread(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))).select("doc", tokens(F.col("text")).alias("ts"))
    if terms is not None:
        few = [r[0] for r in terms.select("term").distinct().limit(PLAN_TERMS + 1).collect()]
        if len(few) <= PLAN_TERMS:
            bound = F.transform(F.array("ts"), lambda x: F.struct(F.size(x).cast("long").alias("dl"), F.filter(x, lambda w: w.isin(few)).alias("ts")))[0]
            return stage(t.select("doc", bound.alias("x")).select("doc", "x.dl", "x.ts"), "tokens")
    return stage(t.select("doc", F.size("ts").cast("long").alias("dl"), "ts"), "tokens")


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf, dl): one row for each term of a document; dl counts all its tokens."""
    return postings_of(token_table(docs, doc, text))


def postings_of(table: DataFrame) -> DataFrame:
    one = table.select("doc", "dl", F.explode("ts").alias("term"))
    return one.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def document_frequencies(table: DataFrame) -> DataFrame:
    """(term, df, cf) of token_table(): counted by term at once, in memory before the shuffle, without a row for each term of a document."""
    both = F.concat(F.transform(F.array_distinct("ts"), lambda w: F.struct(w.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))), F.transform("ts", lambda w: F.struct(w.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))))
    return table.select(F.explode(both).alias("x")).groupBy("x.term").agg(F.sum("x.d").alias("df"), F.sum("x.c").alias("cf"))


def fit_vocabulary(table: DataFrame, min_df: float = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, id) of token_table(): terms of min_df to max_df documents (a whole number counts, a fraction is a share cut to one), the max_features of highest df, ties by term, numbered by name."""
    n = table.count()
    bound = lambda x: int(x * n) if isinstance(x, float) else x
    v = document_frequencies(table).select("term", "df").where((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df)))
    v = v if max_features is None else v.orderBy(F.desc("df"), "term").limit(max_features)
    return running_total(v, ["term"], "id")


def idf(df: Column, n: Column, kind: str) -> Column:
    if kind == "smooth":
        return F.ln((n + 1) / (df + 1)) + 1
    if kind == "standard":
        return F.ln(n / F.greatest(df, F.lit(1))) + 1
    if kind == "bm25":
        return F.ln((n - df + 0.5) / (df + 0.5))
    if kind == "probabilistic":
        return F.when(n > df, F.ln((n - df) / F.greatest(df, F.lit(1))))
    raise ValueError(kind)


def tfidf_top(table: DataFrame, k: int, digits=lambda c: c) -> DataFrame:
    """(doc, term, weight, rank): the k terms of highest weight of each row of token_table(), ties by term. Norm and order come from one grouping by document."""
    n = table.where(F.size("ts") > 0).count()
    df = document_frequencies(table).select("term", idf(F.col("df"), F.lit(n), "smooth").alias("idf"))
    w = postings_of(table).join(df, "term").select("doc", "term", (F.log1p("tf") * F.col("idf")).alias("w"))
    g = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("w", "term")).alias("ws"))  # the terms of one document
    best = F.array_sort(F.transform("ws", lambda x: F.struct((-digits(x["w"] / F.col("norm"))).alias("w"), x["term"].alias("term"))))
    return g.select("doc", F.posexplode(F.slice(best, 1, k)).alias("p", "x")).select("doc", "x.term", (-F.col("x.w")).alias("weight"), (F.col("p") + 1).cast("long").alias("rank"))


def _bm25(q: DataFrame, wanted: DataFrame, lengths: DataFrame, k1: float, b: float) -> DataFrame:
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    hit = wanted.join(df, "term").join(q, "term").crossJoin(F.broadcast(stats))  # one row on the right
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query", "doc").agg(F.sum(F.col("qtf") * idf(F.col("df"), F.col("n"), "bm25") * tf).alias("score"))


def bm25(queries: DataFrame, post: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score) for documents with a query term; queries(query, term) with repeats counting repeatedly.

    The unfloored idf ln((n - df + 0.5) / (df + 0.5)) is negative for terms of more than half of the documents. Postings are cut to
    the queries' terms before they are joined; query terms are few, and the optimiser broadcasts them if they are small.
    """
    q = queries.groupBy("query", "term").agg(F.count("*").alias("qtf"))
    return _bm25(q, post.join(q.select("term").distinct(), "term", "left_semi"), post.groupBy("doc").agg(F.max("dl").alias("dl")), k1, b)


def bm25_of_texts(queries: DataFrame, docs: DataFrame, doc: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """bm25() of texts that are read and cut into tokens once, of which only the queries' terms are kept."""
    q = queries.groupBy("query", "term").agg(F.count("*").alias("qtf"))
    table = token_table(docs, doc, text, q)
    wanted = postings_of(table).join(q.select("term").distinct(), "term", "left_semi")
    return _bm25(q, wanted, table.where("dl > 0"), k1, b)


def top_k(scores: DataFrame, k: int, by: str = "query", order: list | None = None) -> DataFrame:
    """The k best rows of each group with their rank; ties by document."""
    w = Window.partitionBy(by).orderBy(*(order or [F.desc("score"), F.col("doc")]))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf[at : at + size]
                v = np.stack(part["v"].to_numpy()).astype(np.float64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    v = v / np.sqrt((v * v).sum(1))[:, None]
                yield pd.DataFrame({"ids": [part["doc"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()], "dim": [v.shape[1]]})

    return run


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query, doc, score, rank): the k vectors of highest cosine, to six digits, for each query, itself aside; ties by doc.

    vectors(doc, v), queries(doc, v). Both sides become blocks of unit vectors; each pair of blocks is one matrix product, of which a
    task keeps each query's k best, and the blocks' best are merged. No pair of vectors is a row.
    """
    schema = "ids binary, vectors binary, dim int"
    left = vectors.select("doc", "v").mapInPandas(_blocks(block), schema)
    right = queries.select("doc", "v").mapInPandas(_blocks(block), schema).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "dim")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                doc, query = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                s = np.frombuffer(r.q_vectors).reshape(-1, r.q_dim) @ np.frombuffer(r.vectors).reshape(-1, r.dim).T
                s = np.floor(s * 1e6 + 0.5) / 1e6
                s[np.isnan(s) | (query[:, None] == doc[None, :])] = -np.inf
                least = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
                i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))  # ties at the end are kept
                yield pd.DataFrame({"query": query[i], "doc": doc[j], "score": s[i, j]})

    scores = left.crossJoin(right).mapInPandas(run, "query long, doc long, score double")  # blocks by blocks
    return top_k(scores, k)
