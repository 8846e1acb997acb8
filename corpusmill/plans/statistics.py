"""Significance, resampling and rank statistics over run results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import correlation, r6
from corpusmill.operators.labels import class_truth
from corpusmill.plans.evaluation import PRED, _evaluated
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6, TRUTH
from corpusmill.sources.tables import table

#: Runs as models, classes as tasks, accuracy over the class's documents as score.
SCORES = f"""{PRED}, sc as (select run_name as model, truth as task, avg((truth = pred)::int) as score, count(*) as cost from ev group by 1, 2)"""


def _scores(spark, d):
    ok = (F.col("truth") == F.col("pred")).cast("int")
    return _evaluated(spark, d).groupBy(F.col("run_name").alias("model"), F.col("truth").alias("task")).agg(F.avg(ok).alias("score"), F.count("*").alias("cost"))


@query(f"with {SCORES}, r as (select *, row_number() over (partition by task order by score desc, model) as r from sc) select model, {R6.format('avg(r)')} as mean_rank, {R6.format('stddev_pop(r)')} as sd_rank, min(r) as best, max(r) as worst, sum(case when r <= 3 then 1 else 0 end)::bigint as top3 from r group by model")
def rank_consistency(spark, d):
    r = _scores(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("score"), "model")).cast("long"))
    return r.groupBy("model").agg(r6(F.avg("r")).alias("mean_rank"), r6(F.stddev_pop("r")).alias("sd_rank"), F.min("r").alias("best"), F.max("r").alias("worst"), F.count_if(F.col("r") <= 3).alias("top3"))


@query(f"with {SCORES}, r as (select *, row_number() over w as r, lead(score) over w as next from sc window w as (partition by task order by score desc, model)) select task, model as champion, {R6.format('score - next')} as gap from r where r = 1")
def champions(spark, d):
    w = Window.partitionBy("task").orderBy(F.desc("score"), "model")
    r = _scores(spark, d).select("*", F.row_number().over(w).alias("r"), F.lead("score").over(w).alias("next")).where("r = 1")
    return r.select("task", F.col("model").alias("champion"), r6(F.col("score") - F.col("next")).alias("gap"))


@query(f"with {SCORES}, m as (select model, avg(score) as score, sum(cost) as cost from sc group by model) select a.model from m a where not exists (select 1 from m b where b.cost <= a.cost and b.score >= a.score and (b.cost < a.cost or b.score > a.score))")
def pareto_frontier(spark, d):
    """By a running maximum over cheaper models and the best of the own cost: no pairwise join."""
    m = _scores(spark, d).groupBy("model").agg(F.avg("score").alias("score"), F.sum("cost").alias("cost"))
    by = m.groupBy("cost").agg(F.max("score").alias("top"))
    cheaper = F.max("top").over(Window.orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    b = by.withColumn("cheaper", cheaper)
    return m.join(b, "cost").where((F.col("score") == F.col("top")) & (F.col("cheaper").isNull() | (F.col("score") > F.col("cheaper")))).select("model")


@query(f"with {SCORES} select a.task as task_a, b.task as task_b, {R6.format('case when stddev_pop(a.score) * stddev_pop(b.score) > 0 then corr(a.score, b.score) end')} as r, count(*) as n from sc a join sc b on a.model = b.model and a.task < b.task group by 1, 2 having count(*) >= 3")
def task_correlation(spark, d):
    s = _scores(spark, d)
    j = s.alias("a").join(s.alias("b"), (F.col("a.model") == F.col("b.model")) & (F.col("a.task") < F.col("b.task")))
    return j.groupBy(F.col("a.task").alias("task_a"), F.col("b.task").alias("task_b")).agg(r6(correlation("a.score", "b.score")).alias("r"), F.count("*").alias("n")).where("n >= 3")


@query(f"""with d as (select id, max(case when run_name = (select min(run_name) from class_predictions) then confidence end) as x, max(case when run_name = (select max(run_name) from class_predictions) then confidence end) as y from class_predictions group by id), p as (select x - y as d from d where x is not null and y is not null)
select count(*) as n, {R6.format('avg(d)')} as mean_difference, {R6.format('avg(d) / stddev_samp(d)')} as cohen_d, {R6.format('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} as t from p""")
def paired_t(spark, d):
    p = _paired(spark, d).select((F.col("x") - F.col("y")).alias("d"))
    return p.agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean_difference"), r6(F.avg("d") / F.stddev_samp("d")).alias("cohen_d"), r6(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t"))


def _paired(spark, d):
    p = table(spark, d, "class_predictions")
    ends = p.agg(F.min("run_name").alias("lo"), F.max("run_name").alias("hi"))
    j = p.crossJoin(F.broadcast(ends))  # one row on the right
    return j.groupBy("id").agg(F.max(F.when(F.col("run_name") == F.col("lo"), F.col("confidence"))).alias("x"), F.max(F.when(F.col("run_name") == F.col("hi"), F.col("confidence"))).alias("y")).where("x is not null and y is not null")


@query(f"""with {TRUTH}, g as (select * from gt), p as (select id, run_name, min(prediction) as pred from class_predictions group by 1, 2),
e as (select p.id, max(case when run_name = (select min(run_name) from class_predictions) then (pred = truth)::int end) as x, max(case when run_name = (select max(run_name) from class_predictions) then (pred = truth)::int end) as y from p join g using (id) group by p.id),
c as (select sum(case when x = 1 and y = 0 then 1 else 0 end) as b, sum(case when x = 0 and y = 1 then 1 else 0 end) as c from e where x is not null and y is not null)
select b::bigint as b, c::bigint as c, {R6.format('(abs(b - c) - 1) * (abs(b - c) - 1) / (b + c)')} as statistic from c""")
def mcnemar(spark, d):
    p = table(spark, d, "class_predictions")
    truth = class_truth(table(spark, d, "shelf_features"), table(spark, d, "label_space"))
    ends = p.agg(F.min("run_name").alias("lo"), F.max("run_name").alias("hi"))
    j = p.groupBy("id", "run_name").agg(F.min("prediction").alias("pred")).join(truth, "id").crossJoin(F.broadcast(ends)).withColumn("ok", (F.col("pred") == F.col("truth")).cast("int"))  # one row on the right
    e = j.groupBy("id").agg(F.max(F.when(F.col("run_name") == F.col("lo"), F.col("ok"))).alias("x"), F.max(F.when(F.col("run_name") == F.col("hi"), F.col("ok"))).alias("y"))
    c = e.agg(F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("b"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("c"))
    diff = F.abs(F.col("b") - F.col("c")) - 1
    return c.select("b", "c", r6(F.try_divide(diff.cast("double") * diff, F.col("b") + F.col("c"))).alias("statistic"))


@query(f"with {SCORES}, r as (select model, task, rank() over (partition by task order by score desc) + (count(*) over (partition by task, score) - 1) / 2.0 as r from sc), k as (select count(distinct model) as k, count(distinct task) as n from sc), full_models as (select model from sc group by model having count(*) = (select n from k)), q as (select model, row_number() over (order by model) as i from full_models) select model, {R6.format('avg(r)')} as average_rank from r where model in (select model from q) group by model")
def friedman_ranks(spark, d):
    s = _scores(spark, d)
    w = Window.partitionBy("task").orderBy(F.desc("score"))  # the best has the first rank
    r = s.withColumn("r", F.rank().over(w) + (F.count("*").over(Window.partitionBy("task", "score")) - 1) / 2.0)
    n = s.select("task").distinct().count()
    whole = s.groupBy("model").agg(F.count("*").alias("n")).where(F.col("n") == n).select("model")
    return r.join(whole, "model", "left_semi").groupBy("model").agg(r6(F.avg("r")).alias("average_rank"))


def adjust(p):
    """Holm, Benjamini-Hochberg, Benjamini-Yekutieli and Bonferroni for (name, p), a row for each test."""
    i = Window.orderBy("p", "name")
    r = p.withColumn("i", F.row_number().over(i)).withColumn("m", F.count("*").over(Window.partitionBy()))
    one = lambda c: r6(F.least(F.lit(1.0), c))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda s, x: s + F.lit(1.0) / x)
    return r.select("name", one(F.max(F.col("p") * (F.col("m") - F.col("i") + 1)).over(Window.orderBy("i"))).alias("holm"), one(F.min(F.col("p") * F.col("m") / F.col("i")).over(Window.orderBy(F.desc("i")))).alias("bh"), one(F.col("p") * F.col("m")).alias("bonferroni"), one(F.min(F.col("p") * F.col("m") * harmonic / F.col("i")).over(Window.orderBy(F.desc("i")))).alias("by_"))
