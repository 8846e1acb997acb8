"""Lexical and dense retrieval over documents, judged by their facets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import ACCENTED, PLAIN, r6, tokens
from corpusmill.operators import lexical, metrics
from corpusmill.operators.labels import class_truth
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table

R6 = "floor(({}) * 1e6 + 0.5) / 1e6"
TOK = "regexp_extract_all(translate(lower(coalesce({}, '')), '" + ACCENTED + "', '" + PLAIN + "'), '[\\p{L}\\p{N}_]+')"
POST = f"""post as (select doc, term, count(*) as tf, max(dl) as dl from (
  select doc_id as doc, len(ts) as dl, unnest(ts) as term from (select doc_id, {TOK.replace('{}', 'text')} as ts from documents)) group by doc, term)"""
QS = f"""qs as (select facet || ':' || term as query, facet, term as label, case facet when 'lcc_code' then broader else term end as qtext from label_space where facet in ('lcc_code', 'lcgft_form')),
qt as (select query, unnest({TOK.replace('{}', 'qtext')}) as term from qs),
qrels as (select query, doc_id as doc, 1.0 as gain from qs join documents on (facet = 'lcc_code' and lcc_code = label) or (facet = 'lcgft_form' and lcgft_form = label))"""
BM25 = f"""{POST}, {QS},
q as (select query, term, count(*) as qtf from qt group by 1, 2),
st as (select count(*) as n, avg(dl) as avgdl from (select doc, max(dl) as dl from post group by doc)),
dfs as (select term, count(*) as df from post group by term),
scores as (select query, doc, sum(qtf * ln((n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) as score
  from q join post using (term) join dfs using (term) cross join st group by 1, 2),
ranked as (select query, doc, score, row_number() over (partition by query order by floor(score * 1e6 + 0.5) / 1e6 desc, doc) as rank from scores)"""


def _queries(spark, d):
    q = table(spark, d, "label_space").where(F.col("facet").isin("lcc_code", "lcgft_form"))
    return q.select(F.concat_ws(":", "facet", "term").alias("query"), "facet", F.col("term").alias("label"), F.when(F.col("facet") == "lcc_code", F.col("broader")).otherwise(F.col("term")).alias("qtext"))


def _ranked(spark, d, k):
    docs = table(spark, d, "documents")
    terms = _queries(spark, d).select("query", F.explode(tokens(F.col("qtext"))).alias("term"))
    return lexical.top_k(lexical.bm25_of_texts(terms, docs, "doc_id", "text"), k, order=[r6(F.col("score")).desc(), F.col("doc")])


def _qrels(spark, d):
    docs = table(spark, d, "documents")
    long = docs.select(F.col("doc_id").alias("doc"), F.explode(F.array(F.struct(F.lit("lcc_code").alias("facet"), F.col("lcc_code").alias("label")), F.struct(F.lit("lcgft_form").alias("facet"), F.col("lcgft_form").alias("label")))).alias("x")).select("doc", "x.*")
    return long.join(_queries(spark, d), ["facet", "label"]).select("query", "doc", F.lit(1.0).alias("gain"))


@query(f"with {BM25} select query, doc, {R6.format('score')} as score, rank from ranked where rank <= 10")
def bm25_topk(spark, d):
    return _ranked(spark, d, 10).select("query", "doc", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


METRICS = f"""with {BM25}, top as (select * from ranked where rank <= 10),
ideal as (select query, sum(1.0 / log2(i + 1)) filter (where i <= 10) as idcg, count(*) as n_rel from (select query, row_number() over (partition by query order by doc) as i from qrels) group by query),
got as (select t.query, t.rank, coalesce(gain, 0) as gain, case when gain > 0 then 1 else 0 end as hit from top t left join qrels r on t.query = r.query and t.doc = r.doc),
cum as (select *, sum(hit) over (partition by query order by rank) as cum from got),
per as (select query, sum(gain / log2(rank + 1)) as dcg, min(case when hit = 1 then rank end) as first, sum(hit) as hits, count(*) as returned, sum(hit * cum / rank) as psum from cum group by query),
m as (select query, coalesce(dcg / idcg, 0) as ndcg, coalesce(1.0 / first, 0) as rr, coalesce(hits / n_rel, 0) as recall, coalesce(hits / returned, 0) as precision, coalesce(psum / n_rel, 0) as ap from ideal left join per using (query))"""


def _metrics(spark, d):
    return metrics.ranking_metrics(_ranked(spark, d, 10), _qrels(spark, d), 10)


@query(f"{METRICS} select count(*) as n_queries, {R6.format('avg(ndcg)')} as ndcg_10, {R6.format('avg(rr)')} as mrr, {R6.format('avg(recall)')} as recall_10, {R6.format('avg(precision)')} as precision_10, {R6.format('avg(ap)')} as map_10 from m")
def bm25_retrieval_metrics(spark, d):
    a = lambda c, n: r6(F.avg(c)).alias(n)
    return _metrics(spark, d).agg(F.count("*").alias("n_queries"), a("ndcg", "ndcg_10"), a("rr", "mrr"), a("recall", "recall_10"), a("precision", "precision_10"), a("ap", "map_10"))


@query(f"{METRICS} select query, {R6.format('ndcg')} as ndcg, {R6.format('rr')} as rr, {R6.format('ap')} as ap from m")
def bm25_per_query(spark, d):
    return _metrics(spark, d).select("query", *[r6(F.col(c)).alias(c) for c in ("ndcg", "rr", "ap")])


@query(f"with {POST} select term, count(*) as df, sum(tf)::bigint as cf from post group by term having count(*) >= 2")
def vocab_df(spark, d):
    return lexical.document_frequencies(lexical.token_table(table(spark, d, "documents"), "doc_id", "text")).where("df >= 2")


@query(f"""with {POST}, v as (select term, count(*) as df from post group by term), n as (select count(distinct doc) as n from post)
select term, df, {R6.format('ln((n + 1.0) / (df + 1)) + 1')} as smooth, {R6.format('ln(n * 1.0 / df) + 1')} as standard, {R6.format('ln((n - df + 0.5) / (df + 0.5))')} as bm25, case when n > df then {R6.format('ln((n - df) * 1.0 / df)')} end as probabilistic from v cross join n""")
def idf_variants(spark, d):
    t = lexical.token_table(table(spark, d, "documents"), "doc_id", "text")
    v = lexical.document_frequencies(t).crossJoin(F.broadcast(t.where(F.size("ts") > 0).agg(F.count("*").alias("n"))))  # one row on the right
    return v.select("term", "df", *[r6(lexical.idf(F.col("df"), F.col("n"), k)).alias(k) for k in ("smooth", "standard", "bm25", "probabilistic")])


@query(f"""with {POST}, v as (select term, count(*) as df from post group by term), n as (select count(distinct doc) as n from post),
w as (select doc, term, ln(1 + tf) * (ln((n + 1.0) / (df + 1)) + 1) as w from post join v using (term) cross join n),
u as (select doc, term, w / sqrt(sum(w * w) over (partition by doc)) as weight from w),
r as (select doc, term, {R6.format('weight')} as weight, row_number() over (partition by doc order by {R6.format('weight')} desc, term) as rank from u)
select doc, term, weight, rank from r where rank <= 3""")
def tfidf_top_terms(spark, d):
    return lexical.tfidf_top(lexical.token_table(table(spark, d, "documents"), "doc_id", "text"), 3, r6)


@query(f"""with q as (select vec_id as query, embedding as u from embeddings where vec_id % 20 = 0),
s as (select query, vec_id as doc, {R6.format('list_cosine_similarity(u::double[], embedding::double[])')} as score from q join embeddings on query <> vec_id),
r as (select *, row_number() over (partition by query order by score desc, doc) as rank from s) select query, doc, rank from r where rank <= 5""")
def dense_topk(spark, d):
    """Every vector whose id is divisible by 20 is a query, against all vectors, in blocks of queries."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    return lexical.dense_top(e, e.where("doc % 20 = 0"), 5).select("query", "doc", F.col("rank").cast("long").alias("rank"))


@query(f"select label, count(*) as n, {R6.format('avg(sqrt(list_dot_product(embedding::double[], embedding::double[])))')} as mean_norm from embeddings group by label")
def embedding_norm_stats(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(norm)).alias("mean_norm"))


#: The class of an id: the least of its rows', as code, with prefix or point, or by name; one-letter codes outside the label space stand for themselves.
TRUTH = r"""alias as (select key, min(term) as term from (select term, unnest([t, 'lcc' || t, t || 'lcc', b, t || b, b || t]) as key from (select term, regexp_replace(lower(term), '[^\p{L}\p{N}]+', '', 'g') as t, regexp_replace(lower(broader), '[^\p{L}\p{N}]+', '', 'g') as b from label_space where facet = 'lcc_code')) group by key),
gt as (select id, min(truth) as truth from (select id, coalesce(term, case when length(trim(lcc_code)) = 1 then upper(trim(lcc_code)) end) as truth from shelf_features left join alias on key = nullif(regexp_replace(lower(lcc_code), '[^\p{L}\p{N}]+', '', 'g'), '')) where truth is not null group by id)"""
RUNS = f"""{TRUTH}, first_runs as (select query_id, ranked_doc_ids from (select *, row_number() over (partition by query_id order by len(ranked_doc_ids) desc, array_to_string(ranked_doc_ids, ',')) as r from retrieval_runs where query_id is not null) where r = 1),
flat as (select query_id, unnest(ranked_doc_ids) as doc, generate_subscripts(ranked_doc_ids, 1) as pos from first_runs),
runs as (select query_id as query, doc, row_number() over (partition by query_id order by min(pos)) as rank from flat group by query_id, doc),
cls as (select id, truth as c from gt)"""


@query(f"""with {RUNS}, j as (select r.query, r.rank, case when a.c = b.c then 1 else 0 end as hit from runs r join cls a on a.id = r.query left join cls b on b.id = r.doc)
select count(*) as n_queries, {R6.format('avg(p)')} as precision_5, {R6.format('avg(rr)')} as mrr from (select query, sum(hit) filter (where rank <= 5) / count(*) filter (where rank <= 5) as p, coalesce(max(case when hit = 1 then 1.0 / rank end), 0) as rr from j group by query)""")
def run_metrics(spark, d):
    """Stored rankings (the longest of a query, repeated documents at their first place) judged by equal class."""
    runs = table(spark, d, "retrieval_runs").where("query_id is not null")
    w = Window.partitionBy("query_id").orderBy(F.size("ranked_doc_ids").desc(), F.concat_ws(",", "ranked_doc_ids"))
    one = runs.withColumn("r", F.row_number().over(w)).where("r = 1")
    flat = one.select("query_id", F.posexplode("ranked_doc_ids").alias("pos", "doc")).groupBy("query_id", "doc").agg(F.min("pos").alias("pos"))
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    cls = class_truth(table(spark, d, "shelf_features"), table(spark, d, "label_space"), "c")
    j = ranked.join(cls.select(F.col("id").alias("query_id"), F.col("c").alias("qc")), "query_id").join(cls.select(F.col("id").alias("doc"), "c"), "doc", "left").withColumn("hit", F.when(F.col("c") == F.col("qc"), 1).otherwise(0))
    per = j.groupBy("query_id").agg((F.sum(F.when(F.col("rank") <= 5, F.col("hit"))) / F.count_if(F.col("rank") <= 5)).alias("p"), F.coalesce(F.max(F.when(F.col("hit") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return per.agg(F.count("*").alias("n_queries"), r6(F.avg("p")).alias("precision_5"), r6(F.avg("rr")).alias("mrr"))
