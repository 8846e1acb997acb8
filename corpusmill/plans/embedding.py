"""Embeddings, pair similarities, clusters and heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.expr import r6
from corpusmill.operators import lexical, metrics, pairs, vectors
from corpusmill.plans.pairing import QUOTAS, facets, mine_sql
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6, TOK
from corpusmill.runtime import stage
from corpusmill.sources.tables import table

PP = f"""{mine_sql(QUOTAS)}, tk as (select id as doc, {TOK.replace('{}', 'body')} as ts from fx), po as (select doc, term, count(*) as tf, max(dl) as dl from (select doc, len(ts) as dl, unnest(ts) as term from tk) group by 1, 2), dd as (select term, count(*) as df from po group by 1), nn as (select count(*) as n, avg(dl) as avgdl from (select doc, max(dl) as dl from po group by 1))"""


def _pairs_and_tokens(spark, d):
    f = facets(spark, d, True)
    p = stage(pairs.mine_pairs(f, QUOTAS).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "stratum"), "pairs")
    return p, lexical.token_table(f, "id", "body")


@query(f"""{PP}, w as (select doc, term, ln(1 + tf) * (ln((n + 1.0) / (df + 1)) + 1) as w from po join dd using (term) cross join nn), u as (select doc, term, w / sqrt(sum(w * w) over (partition by doc)) as w from w)
select m.a as doc_a, m.b as doc_b, stratum, {R6.format('coalesce((select sum(x.w * y.w) from u x join u y on x.term = y.term where x.doc = m.a and y.doc = m.b), 0)')} as cosine from mined m""")
def pair_cosine(spark, d):
    """TF-IDF cosine of mined pairs; weights are made for the pairs' documents only, frequencies come from all."""
    p, t = _pairs_and_tokens(spark, d)
    n = t.where("dl > 0").agg(F.count("*").alias("n"))
    df = lexical.document_frequencies(t).select("term", "df")
    ids = p.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    post = lexical.postings_of(t.join(ids, "doc", "left_semi")).join(df, "term").crossJoin(F.broadcast(n))  # one row on the right
    w = post.withColumn("w", F.log1p("tf") * lexical.idf(F.col("df"), F.col("n"), "smooth"))
    size = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s"))
    unit = w.join(size, "doc").select("doc", "term", (F.col("w") / F.col("s")).alias("weight"))
    return vectors.pair_dot(p, unit).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "stratum", r6(F.col("dot")).alias("cosine"))


BM = "sum(q.tf * ln((n - df + 0.5) / (df + 0.5)) * (x.tf * 2.5 / (x.tf + 1.5 * (0.25 + 0.75 * x.dl / avgdl))))"


@query(f"""{PP}, s as (select m.a, m.b, coalesce((select {BM} from po q join po x on q.term = x.term join dd on dd.term = q.term cross join nn where q.doc = m.a and x.doc = m.b), 0) + coalesce((select {BM} from po q join po x on q.term = x.term join dd on dd.term = q.term cross join nn where q.doc = m.b and x.doc = m.a), 0) as s2 from mined m)
select a as doc_a, b as doc_b, {R6.format('s2 / 2')} as score, {R6.format('(s2 - min(s2) over ()) / (max(s2) over () - min(s2) over ())')} as scaled from s""")
def pair_bm25(spark, d):
    """Mean of both directions' BM25 of mined pairs, and the same scaled to between 0 and 1."""
    p, t = _pairs_and_tokens(spark, d)
    stats = t.where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = lexical.document_frequencies(t).select("term", "df")
    ids = p.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    post = lexical.postings_of(t.join(ids, "doc", "left_semi")).join(df, "term").crossJoin(F.broadcast(stats))  # one row on the right
    both = p.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("q"), F.col("b").alias("x")), F.struct(F.col("b").alias("q"), F.col("a").alias("x")))).alias("d")).select("a", "b", "d.*")
    j = both.join(post.select(F.col("doc").alias("q"), "term", F.col("tf").alias("qtf")), "q").join(post.withColumnRenamed("doc", "x"), ["x", "term"])
    tf = F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    s = p.join(j.groupBy("a", "b").agg(F.sum(F.col("qtf") * lexical.idf(F.col("df"), F.col("n"), "bm25") * tf).alias("s")), ["a", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    ends = s.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return s.crossJoin(F.broadcast(ends)).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), r6(F.col("s") / 2).alias("score"), r6((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("scaled"))  # one row on the right


@query(f"with n as (select len(embedding) as dim, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings) select count(*) as vectors, min(dim)::bigint as least_dim, max(dim)::bigint as most_dim, {R6.format('min(n)')} as least, {R6.format('max(n)')} as most, {R6.format('stddev_pop(n)')} as sd, count(*) filter (where abs(n - 1) <= 0.01) as unit_length from n")
def embedding_checks(spark, d):
    """Dimensions and norms of all vectors, and how many are of unit length."""
    e = table(spark, d, "embeddings").select(F.size("embedding").cast("long").alias("dim"), vectors.norm(F.col("embedding")).alias("n"))
    return e.agg(F.count("*").alias("vectors"), F.min("dim").alias("least_dim"), F.max("dim").alias("most_dim"), r6(F.min("n")).alias("least"), r6(F.max("n")).alias("most"), r6(F.stddev_pop("n")).alias("sd"), F.count_if(F.abs(F.col("n") - 1) <= 0.01).alias("unit_length"))


@query("select vec_id, list_sum(list_transform(embedding::double[], lambda x: x * x / list_dot_product(embedding::double[], embedding::double[]))) > 0.999999 as is_unit from embeddings")
def unit_vectors(spark, d):
    """Vectors scaled to unit length."""
    return table(spark, d, "embeddings").select("vec_id", (vectors.norm(vectors.unit(F.col("embedding"))) > 0.999999).alias("is_unit"))


def _embeddings(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"), "label")


def _scores_of(assigned, e):
    m = metrics.clustering_metrics(assigned.join(e.select("doc", F.col("label").alias("truth")), "doc").select("truth", F.col("cluster").alias("pred")))
    return m.select(*[r6(F.col(c)).alias(c) for c in ("homogeneity", "completeness", "v_measure", "nmi", "ari")], "n")


@query()
def kmeans_clusters(spark, d):
    """Ten clusters by k-means, against the labels."""
    e = _embeddings(spark, d)
    return _scores_of(vectors.kmeans(e, 10), e)


@query()
def linked_clusters(spark, d):
    """Clusters by links to near neighbours, against the labels."""
    e = _embeddings(spark, d)
    return _scores_of(vectors.linked_clusters(e, 0.3), e)


def _parts(e, n=5):
    h = F.pmod(F.xxhash64(F.lit("part"), "doc"), F.lit(n))
    return e.where(h != 0), e.where(h == 0)


def _accuracy(p, name):
    return p.agg(F.lit(name).alias("head"), F.count("*").alias("n"), r6(F.avg((F.col("truth") == F.col("pred")).cast("int"))).alias("accuracy"))


def _labelled_texts(spark, d):
    """Embedded documents with their class as a number."""
    classes = F.array(*[F.lit(chr(c)) for c in range(ord("A"), ord("Z") + 1)])
    docs = table(spark, d, "documents").where("lcc_code is not null and trim(text) <> ''")
    v = vectors.embed_texts(docs, "doc_id", "text", features=1024, dim=64)
    label = (F.array_position(classes, F.col("lcc_code")) - 1).cast("int").alias("label")
    return stage(v.join(docs.select(F.col("doc_id").alias("doc"), label, "source", "lang"), "doc"), "labelled")


@query()
def classifier_heads(spark, d):
    """A linear head and a forest on embedded documents, four fifths to fit and one to test their classes."""
    train, test = _parts(_labelled_texts(spark, d))
    return _accuracy(vectors.head(train, test, "linear"), "linear").unionByName(_accuracy(vectors.head(train, test, "forest"), "forest"))


@query()
def transfer_matrix(spark, d):
    """Accuracy of a linear head fitted on one of three groups of sources and tested on each, held-out rows where they are the same."""
    e = _labelled_texts(spark, d).withColumn("corpus", F.pmod(F.xxhash64(F.lit("corpus"), "source"), F.lit(3)))
    out = None
    for a in range(3):
        train, own = _parts(e.where(F.col("corpus") == a))
        tests = own.unionByName(e.where(F.col("corpus") != a)).select("doc", "v", "label", "corpus")
        p = vectors.head(train, tests, "linear").join(tests.select("doc", "corpus"), "doc")
        one = p.groupBy(F.col("corpus").alias("tested")).agg(F.count("*").alias("n"), r6(F.avg((F.col("truth") == F.col("pred")).cast("int"))).alias("accuracy")).withColumn("fitted", F.lit(a).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out.select("fitted", "tested", "n", "accuracy")


@query()
def text_embeddings(spark, d):
    """Texts as 32 numbers by term weights and singular vectors."""
    return vectors.embed_texts(table(spark, d, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id"), "v")
