"""Stored rankings judged by facets: binary, graded and instruction relevance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import r6
from corpusmill.operators import judgments as J
from corpusmill.plans.pairing import FX, facets
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6, RUNS
from corpusmill.runtime import stage
from corpusmill.sources.tables import table

COLS = ("sub", "cls", "form", "cat", "aud", "reg", "topics")
RUNS_FX = f"{RUNS}, {FX}"


def first_rankings(spark, d) -> DataFrame:
    """(query, doc, rank): the longest stored ranking of a query, repeated documents at their first place."""
    runs = table(spark, d, "retrieval_runs").where("query_id is not null")
    best = runs.groupBy("query_id").agg(F.min_by("ranked_doc_ids", F.struct((-F.size("ranked_doc_ids")).alias("n"), F.concat_ws(",", "ranked_doc_ids").alias("s"))).alias("ids"))
    ids = F.filter("ids", lambda x: x.isNotNull())
    return best.select(F.col("query_id").alias("query"), F.posexplode(F.array_distinct(ids)).alias("p", "doc")).select("query", "doc", (F.col("p") + 1).alias("rank"))


def _sides(spark, d, corpus_only=False):
    """Facets of all documents, of the queries, and the rankings with the facets of both sides as columns q_* and d_*."""
    fx = facets(spark, d).select("id", *COLS)
    runs = first_rankings(spark, d)
    queries = fx.join(runs.select(F.col("query").alias("id")).distinct(), "id", "left_semi")
    q = queries.select(F.col("id").alias("query"), *[F.col(c).alias(f"q_{c}") for c in COLS])
    of = fx.select(F.col("id").alias("doc"), *[F.col(c).alias(f"d_{c}") for c in COLS], F.lit(True).alias("known"))
    j = runs.join(q, "query").join(of, "doc", "left")
    if corpus_only:  # ranks among documents of the corpus
        j = j.where("known").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    return fx, queries, j


CUTS = (1, 5, 10, 50, 100)


@query(f"""with {RUNS}, n as (select c, count(*) - 1 as m from cls where c is not null group by c), q as (select a.id as query, a.c, n.m from (select distinct query from runs) u join cls a on a.id = u.query join n using (c) where n.m > 0),
j as (select q.query, q.m, r.rank, case when b.c = q.c and r.doc <> q.query then 1 else 0 end as hit from q join runs r on r.query = q.query left join cls b on b.id = r.doc),
u as (select *, sum(hit) over (partition by query order by rank) as cum from j),
k(k) as (values {', '.join(f'({k})' for k in CUTS)}),
p as (select k, query, m, sum(hit / log2(rank + 1)) filter (where rank <= k) as dcg, sum(hit) filter (where rank <= k) as hits, count(*) filter (where rank <= k) as got, sum(hit * cum / rank) filter (where rank <= k) as psum, min(rank) filter (where hit = 1) as first from u cross join k group by 1, 2, 3),
i as (select p.*, (select sum(1 / log2(x + 1)) from range(1, least(p.m, p.k)::bigint + 1) t(x)) as ideal from p)
select k::bigint as k, count(*) as n_queries, {R6.format('avg(dcg / ideal)')} as ndcg, {R6.format('avg(coalesce(1.0 / first, 0))')} as mrr, {R6.format('avg(hits / m)')} as recall, {R6.format('avg(hits / got)')} as precision, {R6.format('avg(psum / m)')} as map from i group by k""")
def ranking_metrics_at_k(spark, d):
    """NDCG, MRR, recall, precision and MAP at 1, 5, 10, 50 and 100; relevant: other documents of the query's class, which are counted and not listed. Queries without any are skipped."""
    from corpusmill.operators.labels import class_truth

    cls = class_truth(table(spark, d, "shelf_features"), table(spark, d, "label_space"), "c")
    n = cls.groupBy("c").agg((F.count("*") - 1).alias("m")).where("m > 0")
    runs = first_rankings(spark, d)
    q = runs.select("query").distinct().join(cls.withColumnRenamed("id", "query"), "query").join(n, "c")
    j = runs.join(q, "query").join(cls.select(F.col("id").alias("doc"), F.col("c").alias("dc")), "doc", "left")
    j = j.withColumn("hit", F.when((F.col("dc") == F.col("c")) & (F.col("doc") != F.col("query")), 1).otherwise(0))
    u = j.withColumn("cum", F.sum("hit").over(Window.partitionBy("query").orderBy("rank")))  # one ranking
    at = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(0))
    cells = [F.struct(at(k, F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"), at(k, F.col("hit")).alias("hits"), at(k, F.lit(1)).alias("got"), at(k, F.col("hit") * F.col("cum") / F.col("rank")).alias("psum"), F.lit(k).alias("k")) for k in CUTS]
    p = u.groupBy("query", "m").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.array(*cells).alias("x")).select("m", "first", F.explode("x").alias("x")).select("m", "first", "x.*")
    ideal = reduce(lambda acc, k: acc.when(F.col("k") == k, J.ideal_dcg([(1.0, F.col("m"))], k)), CUTS, F.when(F.lit(False), 0.0))
    a = lambda c, n: r6(F.avg(c)).alias(n)
    return p.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n_queries"), a(F.col("dcg") / ideal, "ndcg"), a(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"), a(F.col("hits") / F.col("m"), "recall"), a(F.col("hits") / F.col("got"), "precision"), a(F.col("psum") / F.col("m"), "map"))


SHARE = "coalesce(len(list_intersect(q.topics, x.topics)) > 0, false)"
GAIN_SQL = {
    "class": f"case when q.sub = x.sub then 3.0 when q.cls = x.cls then 2.0 when {SHARE} then 1.0 else 0.0 end",
    "form": "case when q.form = x.form then 3.0 when q.cat = x.cat then 1.0 else 0.0 end",
    "category": "case when q.form = x.form then 3.0 when q.cat = x.cat then 2.0 else 0.0 end",
}


def graded_sql(axis):
    g = GAIN_SQL[axis]
    return f"""select '{axis}' as axis, count(*) as n_queries, {R6.format('avg(dcg / idcg)')} as ndcg_10 from (select qid, coalesce(max(dcg), 0) as dcg, max(idcg) as idcg from
 (select q.id as qid, sum(gain / log2(i + 1)) as idcg from (select q.id, {g} as gain, row_number() over (partition by q.id order by {g} desc, x.id) as i from qs q cross join fx x) q where i <= 10 and gain > 0 group by 1) a left join
 (select r.query as qid2, sum(({g}) / log2(rank + 1)) as dcg from runs r join qs q on q.id = r.query join fx x on x.id = r.doc where r.rank <= 10 group by 1) b on qid = qid2 group by qid) z"""


@query(f"with {RUNS_FX}, qs as (select * from fx where id in (select query from runs)) " + " union all ".join(graded_sql(a) for a in GAIN_SQL))
def graded_ndcg(spark, d):
    """NDCG@10 with gains by the relation of query and document, on three axes. The ideal comes from counts by facet: no list of relevant documents is made. Queries without a positive tier are skipped."""
    fx, queries, j = _sides(spark, d)
    share = J.matches("topics", F.col("q_topics"), F.col("d_topics"))
    same = lambda f: J.matches(f, F.col(f"q_{f}"), F.col(f"d_{f}"))
    g = {
        "class": F.when(same("sub"), J.GAINS["class"][0]).when(same("cls"), J.GAINS["class"][1]).when(share, J.GAINS["class"][2]).otherwise(0.0),
        "form": F.when(same("form"), J.GAINS["form"][0]).when(same("cat"), J.GAINS["form"][1]).otherwise(0.0),
        "category": F.when(same("form"), J.GAINS["category"][0]).when(same("cat"), J.GAINS["category"][1]).otherwise(0.0),
    }
    top = j.where("rank <= 10").groupBy("query").agg(*[F.sum(x / F.log2(F.col("rank") + 1)).alias(f"dcg_{a}") for a, x in g.items()])
    q = queries
    for on in (["sub"], ["cls"], ["form"], ["cat"], ["form", "cat"]):
        q = q.join(J.counts_by(fx, on).withColumnRenamed("n", "n_" + "_".join(on)), on, "left")
    shared = J.topic_counts(fx, queries).select(F.col("topics").alias("t"), F.col("cls").alias("c"), "shared", "shared_same")
    q = q.join(shared, (q["topics"] == shared["t"]) & q["cls"].eqNullSafe(shared["c"]), "left").fillna(0, ["n_sub", "n_cls", "n_form", "n_cat", "n_form_cat", "shared", "shared_same"])
    other = F.col("n_cat") - F.col("n_form_cat")
    ideal = {
        "class": J.ideal_dcg(list(zip(J.GAINS["class"], (F.col("n_sub"), F.col("n_cls") - F.col("n_sub"), F.col("shared") - F.col("shared_same")), strict=True)), 10),
        "form": J.ideal_dcg(list(zip(J.GAINS["form"], (F.col("n_form"), other), strict=True)), 10),
        "category": J.ideal_dcg(list(zip(J.GAINS["category"], (F.col("n_form"), other), strict=True)), 10),
    }
    per = q.select(F.col("id").alias("query"), *[x.alias(f"ideal_{a}") for a, x in ideal.items()]).join(top, "query", "left")
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(f"dcg_{a}", F.lit(0.0)).alias("dcg"), F.col(f"ideal_{a}").alias("ideal")) for a in g])
    return per.select(F.explode(rows).alias("x")).select("x.*").where("ideal > 0").groupBy("axis").agg(F.count("*").alias("n_queries"), r6(F.avg(F.col("dcg") / F.col("ideal"))).alias("ndcg_10"))


def match_sql(f):
    return "coalesce(len(list_intersect(q.topics, x.topics)) > 0, false)" if f == "topics" else f"coalesce(q.{f} = x.{f}, false)"


def instruction_sql(select):
    parts = [f"select '{name}' as instruction, q.id as query, x.id as doc, {match_sql(a)} as anchor, {match_sql(c)} as violates from qs q cross join fx x" for name, (a, c) in J.INSTRUCTIONS.items()]
    return f"""with {RUNS_FX}, qs as (select * from fx where id in (select query from runs)), m as ({' union all '.join(parts)}),
c as (select instruction, query, count(*) filter (where anchor and not violates) as n_rel, avg(violates::int) as chance from m group by 1, 2),
r as (select m.*, row_number() over (partition by m.instruction, m.query order by runs.rank) as rank from m join runs on runs.query = m.query and runs.doc = m.doc) {select}"""


def _instructions(spark, d, rankings: bool = True):
    """For each instruction (queries with n_rel and chance, rankings with anchor and violates), from counts by facet."""
    fx, queries, j = _sides(spark, d, corpus_only=True)
    fx, queries, j = stage(fx, "facets"), stage(queries, "queries"), stage(j, "rankings") if rankings else j  # each instruction reads them, and plans of all would fill the driver
    size = F.broadcast(fx.agg(F.count("*").alias("size")))  # one row
    out = []
    for name, (a, c) in J.INSTRUCTIONS.items():
        if a == "topics":
            s = J.topic_counts(fx, queries).select(F.col("topics").alias("t"), F.col("cls").alias("c"), "shared", "shared_same")
            q = queries.join(s, (queries["topics"] == s["t"]) & queries["cls"].eqNullSafe(s["c"]), "left").withColumn("n_a", F.col("shared")).withColumn("n_ac", F.col("shared_same"))
        else:
            q = queries.join(J.counts_by(fx, [a]).withColumnRenamed("n", "n_a"), a, "left").join(J.counts_by(fx, [a, c]).withColumnRenamed("n", "n_ac"), [a, c], "left")
        q = q.join(J.counts_by(fx, [c]).withColumnRenamed("n", "n_c"), c, "left").crossJoin(size).fillna(0, ["n_a", "n_ac", "n_c"])
        q = q.select(F.lit(name).alias("instruction"), F.col("id").alias("query"), (F.col("n_a") - F.col("n_ac")).alias("n_rel"), (F.col("n_c") / F.col("size")).alias("chance"))
        r = j.select(F.lit(name).alias("instruction"), "query", "rank", J.matches(a, F.col(f"q_{a}"), F.col(f"d_{a}")).alias("anchor"), J.matches(c, F.col(f"q_{c}"), F.col(f"d_{c}")).alias("violates"))
        out.append((q, r))
    return reduce(DataFrame.unionByName, [q for q, _ in out]), reduce(DataFrame.unionByName, [r for _, r in out])


@query(instruction_sql("select instruction, count(*) filter (where n_rel > 0) as n_queries, count(*) filter (where n_rel = 0) as n_empty, sum(n_rel)::bigint as relevant from c group by instruction"))
def instruction_qrels(spark, d):
    """Queries with and without documents that satisfy an instruction, and the number of such documents."""
    q, _ = _instructions(spark, d, rankings=False)
    return q.groupBy("instruction").agg(F.count_if(F.col("n_rel") > 0).alias("n_queries"), F.count_if(F.col("n_rel") == 0).alias("n_empty"), F.sum("n_rel").alias("relevant"))


@query(instruction_sql(f"""select instruction, count(*) as n_queries, {R6.format('avg(am)')} as anchor_match_10, {R6.format('avg(cv)')} as contrast_violation_10, {R6.format('avg(chance)')} as chance, {R6.format('case when avg(chance) > 0 then avg(cv) / avg(chance) else 0 end')} as lift, {R6.format('avg(ndcg)')} as ndcg_10
 from (select c.instruction, c.query, max(chance) as chance, avg(anchor::int) as am, avg(violates::int) as cv, sum((anchor and not violates)::int / log2(rank + 1)) / (select sum(1 / log2(x + 1)) from range(1, least(max(n_rel), 10)::bigint + 1) t(x)) as ndcg from c join r using (instruction, query) where n_rel > 0 and rank <= 10 group by 1, 2) group by instruction"""))
def instruction_diagnostics(spark, d):
    """Over queries with a relevant document: how often the first ten keep the anchor and break the contrast, the chance of breaking it, and its lift."""
    q, r = _instructions(spark, d)
    good = (F.col("anchor") & ~F.col("violates")).cast("int")
    per = r.where("rank <= 10").groupBy("instruction", "query").agg(F.avg(F.col("anchor").cast("int")).alias("am"), F.avg(F.col("violates").cast("int")).alias("cv"), F.sum(good / F.log2(F.col("rank") + 1)).alias("dcg"))
    j = q.where("n_rel > 0").join(per, ["instruction", "query"]).withColumn("ndcg", F.col("dcg") / J.ideal_dcg([(1.0, F.col("n_rel"))], 10))
    lift = F.when(F.avg("chance") > 0, F.avg("cv") / F.avg("chance")).otherwise(F.lit(0.0))
    return j.groupBy("instruction").agg(F.count("*").alias("n_queries"), r6(F.avg("am")).alias("anchor_match_10"), r6(F.avg("cv")).alias("contrast_violation_10"), r6(F.avg("chance")).alias("chance"), r6(lift).alias("lift"), r6(F.avg("ndcg")).alias("ndcg_10"))


@query(f"with {RUNS_FX} select instruction, count(*) as n, min('Instruct: ' || replace(instruction, '_', ' ') || chr(10) || 'Query: ' || id) as first from (values {', '.join(f'({n!r})' for n in J.INSTRUCTIONS)}) i(instruction), fx where id in (select query from runs) group by instruction")
def rendered_queries(spark, d):
    """The queries' texts with their instruction before them."""
    q = first_rankings(spark, d).select("query").distinct().join(facets(spark, d).select(F.col("id").alias("query")), "query", "left_semi")
    i = q.select("query", F.explode(F.array(*[F.lit(n) for n in J.INSTRUCTIONS])).alias("instruction"))
    return i.groupBy("instruction").agg(F.count("*").alias("n"), F.min(F.format_string("Instruct: %s\nQuery: %s", F.replace("instruction", F.lit("_"), F.lit(" ")), "query")).alias("first"))
