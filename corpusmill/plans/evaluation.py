"""Classification, multilabel, pair and clustering evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import cosine, facet_set, r6
from corpusmill.operators import metrics
from corpusmill.operators.labels import class_truth
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6, TRUTH
from corpusmill.sources.tables import table

PRED = f"""{TRUTH},
pr as (select run_name, id, prediction as pred, confidence from (select *, row_number() over (partition by run_name, id order by prediction, confidence desc) as r from class_predictions) where r = 1),
ev as (select run_name, id, truth, pred, confidence from pr join gt using (id)),
labels as (select term as label from label_space where facet = 'lcc_code')"""


def _truth(spark, d):
    return class_truth(table(spark, d, "shelf_features"), table(spark, d, "label_space"))


def _evaluated(spark, d):
    w = Window.partitionBy("run_name", "id").orderBy("prediction", F.desc_nulls_last("confidence"))
    pr = table(spark, d, "class_predictions").withColumn("r", F.row_number().over(w)).where("r = 1")
    return pr.join(_truth(spark, d), "id").select("run_name", "id", "truth", F.col("prediction").alias("pred"), "confidence")


def _labels(spark, d):
    return table(spark, d, "label_space").where("facet = 'lcc_code'").select(F.col("term").alias("label"))


@query(f"with {PRED} select truth, pred, count(*) as n from ev group by 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(_evaluated(spark, d))


CLASSES = f"""with {PRED}, c as (select truth, pred, count(*) as n from ev group by 1, 2),
m as (select label, coalesce((select sum(n) from c where truth = label and pred = label), 0) as tp, coalesce((select sum(n) from c where truth = label), 0) as support, coalesce((select sum(n) from c where pred = label), 0) as predicted from labels),
f as (select label, case when predicted > 0 then tp / predicted else 0 end as precision, case when support > 0 then tp / support else 0 end as recall, case when predicted + support > 0 then 2 * tp / (predicted + support) else 0 end as f1, support from m)"""


@query(f"{CLASSES} select label, {R6.format('precision')} as precision, {R6.format('recall')} as recall, {R6.format('f1')} as f1, support::bigint as support from f")
def classification_per_class(spark, d):
    m = metrics.class_metrics(metrics.confusion(_evaluated(spark, d)), _labels(spark, d))
    return m.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"{CLASSES} select {R6.format('avg(f1)')} as macro_f1, {R6.format('sum(f1 * support) / sum(support)')} as weighted_f1, (select {R6.format('avg(case when truth = pred then 1.0 else 0.0 end)')} from ev) as accuracy from f")
def classification_f1(spark, d):
    ev = _evaluated(spark, d)
    m = metrics.class_metrics(metrics.confusion(ev), _labels(spark, d))
    acc = ev.agg(r6(F.avg(F.when(F.col("truth") == F.col("pred"), 1.0).otherwise(0.0))).alias("accuracy"))
    return m.agg(r6(F.avg("f1")).alias("macro_f1"), r6(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support"))).alias("weighted_f1")).crossJoin(acc)


@query(f"with {PRED}, c as (select truth, pred, count(*) as n from ev where truth <> pred group by 1, 2), s as (select *, sum(n) over () as errors, sum(n) over (partition by truth) as of_class from c) select truth, pred, n, {R6.format('n / errors')} as error_share, {R6.format('n / of_class')} as class_share from s order by n desc, truth, pred limit 10")
def top_confusions(spark, d):
    c = metrics.confusion(_evaluated(spark, d)).where("truth <> pred")
    of = c.groupBy("truth").agg(F.sum("n").alias("of_class"))
    all_ = c.agg(F.sum("n").alias("errors"))
    j = c.join(of, "truth").crossJoin(F.broadcast(all_))  # one row on the right
    return j.select("truth", "pred", "n", r6(F.col("n") / F.col("errors")).alias("error_share"), r6(F.col("n") / F.col("of_class")).alias("class_share")).orderBy(F.desc("n"), "truth", "pred").limit(10)


@query(f"with {PRED} select run_name, count(*) as n, {R6.format('avg(case when truth = pred then 1.0 else 0.0 end)')} as accuracy from ev group by run_name")
def stratified_accuracy(spark, d):
    return _evaluated(spark, d).groupBy("run_name").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("truth") == F.col("pred"), 1.0).otherwise(0.0))).alias("accuracy"))


@query(f"with {PRED} select case when g.id is null then 'unknown id' when l.label is null then 'label not in space' when p.n > 1 then 'repeated' else 'ok' end as verdict, count(*) as n from (select run_name, id, prediction, count(*) over (partition by run_name, id) as n from class_predictions) p left join (select distinct id from shelf_features where id is not null) g on g.id = p.id left join labels l on l.label = p.prediction group by 1")
def prediction_validation(spark, d):
    p = table(spark, d, "class_predictions")
    n = p.groupBy("run_name", "id").agg(F.count("*").alias("n"))
    ids = table(spark, d, "shelf_features").where("id is not null").select("id").distinct().withColumn("known", F.lit(True))
    j = p.join(n, ["run_name", "id"]).join(ids, "id", "left").join(_labels(spark, d).withColumnRenamed("label", "prediction").withColumn("in_space", F.lit(True)), "prediction", "left")
    v = F.when(F.col("known").isNull(), "unknown id").when(F.col("in_space").isNull(), "label not in space").when(F.col("n") > 1, "repeated").otherwise("ok")
    return j.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


SCORED = f"with {PRED}, s as (select confidence as score, case when truth = pred then 1 else 0 end as y from ev where confidence is not null)"


def _scored(spark, d):
    return _evaluated(spark, d).where("confidence is not null").select(F.col("confidence").alias("score"), F.when(F.col("truth") == F.col("pred"), 1).otherwise(0).alias("y"))


@query(f"""{SCORED}, r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from s),
a as (select sum(rk) filter (where y = 1) as sp, sum(y) as p, count(*) - sum(y) as n from r)
select {R6.format('(sp - p * (p + 1) / 2.0) / (p * n)')} as auc, p::bigint as n_pos, n::bigint as n_neg from a""")
def pair_auc(spark, d):
    return metrics.auc(_scored(spark, d)).select(r6(F.col("auc")).alias("auc"), "n_pos", "n_neg")


@query(f"""{SCORED}, b as (select score, sum(y) as pos, count(*) as n from s group by score), c as (select pos, sum(pos) over w as tp, sum(n) over w as m from b window w as (order by score desc rows unbounded preceding))
select {R6.format('sum(pos * tp / m) / sum(pos)')} as ap from c""")
def pair_average_precision(spark, d):
    return metrics.average_precision(_scored(spark, d)).select(r6(F.col("ap")).alias("ap"))


@query(f"""{SCORED}, b as (select score, sum(y) as pos, count(*) as n from s group by score), c as (select score, sum(pos) over w as tp, sum(n) over w as m, sum(pos) over () as p from b window w as (order by score desc rows unbounded preceding)),
f as (select score as threshold, {R6.format('2.0 * tp / (m + p)')} as f1 from c) select threshold, f1 from f order by f1 desc, threshold limit 1""")
def best_threshold(spark, d):
    by = _scored(spark, d).groupBy("score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = by.select("score", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("m")).crossJoin(by.agg(F.sum("pos").alias("p")))
    return c.select(F.col("score").alias("threshold"), r6(2.0 * F.col("tp") / (F.col("m") + F.col("p"))).alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


@query(f"""with {PRED}, a as (select id, min(pred) filter (where run_name = (select min(run_name) from class_predictions)) as x, min(pred) filter (where run_name = (select max(run_name) from class_predictions)) as y from pr group by id),
b as (select x, y from a where x is not null and y is not null), n as (select count(*) as n, avg(case when x = y then 1.0 else 0.0 end) as po from b),
e as (select coalesce(sum(u.n * v.n), 0) as pe from (select x, count(*) as n from b group by x) u join (select y, count(*) as n from b group by y) v on u.x = v.y)
select n, {R6.format('po')} as observed, {R6.format('(po - pe / (n * n)) / (1 - pe / (n * n))')} as kappa from n cross join e""")
def cohen_kappa(spark, d):
    p = table(spark, d, "class_predictions")
    ends = p.agg(F.min("run_name").alias("lo"), F.max("run_name").alias("hi"))
    w = Window.partitionBy("run_name", "id").orderBy("prediction", F.desc_nulls_last("confidence"))
    one = p.withColumn("r", F.row_number().over(w)).where("r = 1").crossJoin(F.broadcast(ends))  # one row on the right
    b = one.groupBy("id").agg(F.min(F.when(F.col("run_name") == F.col("lo"), F.col("prediction"))).alias("x"), F.min(F.when(F.col("run_name") == F.col("hi"), F.col("prediction"))).alias("y")).where("x is not null and y is not null")
    po = b.agg(F.count("*").alias("n"), F.avg(F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.0)).alias("po"))
    e = b.groupBy(F.col("x").alias("l")).agg(F.count("*").alias("a")).join(b.groupBy(F.col("y").alias("l")).agg(F.count("*").alias("c")), "l").agg(F.coalesce(F.sum(F.col("a") * F.col("c")), F.lit(0)).alias("s"))
    pe = F.try_divide("s", F.col("n").cast("double") * F.col("n"))
    return po.crossJoin(e).select("n", r6(F.col("po")).alias("observed"), r6(F.try_divide(F.col("po") - pe, 1 - pe)).alias("kappa"))


#: Vectors by nearest of ten seeds drawn by hash, by cosine over all dimensions.
CLUSTERS = f"""sd as (select vec_id as seed, embedding as u from embeddings order by md5('seed|' || vec_id), vec_id limit 10), sm as (select vec_id, label, seed, {R6.format('list_cosine_similarity(u::double[], embedding::double[])')} as sim from embeddings cross join sd),
nr as (select * from (select *, row_number() over (partition by vec_id order by sim desc, seed) as r from sm) where r = 1), c as (select label as truth, seed as pred from nr)"""


def nearest_seeds(spark, d):
    """(truth, pred, sim): each vector's nearest of ten seeds over all dimensions; the seeds are one row."""
    e = table(spark, d, "embeddings")
    seeds = e.orderBy(F.md5(F.concat(F.lit("seed|"), F.col("vec_id"))), "vec_id").limit(10).agg(F.collect_list(F.struct(F.col("vec_id").alias("seed"), F.col("embedding").alias("u"))).alias("seeds"))
    near = lambda s: F.struct((-r6(cosine(s["u"], F.col("embedding")))).alias("far"), s["seed"].alias("seed"))
    best = F.array_min(F.transform("seeds", near))
    return e.crossJoin(F.broadcast(seeds)).select(F.col("label").alias("truth"), best.alias("b")).select("truth", F.col("b.seed").alias("pred"), (-F.col("b.far")).alias("sim"))


@query(f"""with {CLUSTERS}, k as (select truth, pred, count(*) as n from c group by 1, 2), t as (select truth, sum(n) as nt from k group by 1), p as (select pred, sum(n) as np from k group by 1), tot as (select sum(n) as total from k),
h as (select (select sum(-(nt / total) * ln(nt / total)) from t, tot) as ht, (select sum(-(np / total) * ln(np / total)) from p, tot) as hp, (select sum(n / total * ln(n * total / (nt * np))) from k join t using (truth) join p using (pred), tot) as mi,
 (select sum(n * (n - 1) / 2.0) from k) as sn, (select sum(nt * (nt - 1) / 2.0) from t) as st, (select sum(np * (np - 1) / 2.0) from p) as sp, total from tot)
select {R6.format('mi / ht')} as homogeneity, {R6.format('mi / hp')} as completeness, {R6.format('2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp)')} as v_measure, {R6.format('2 * mi / (ht + hp)')} as nmi, {R6.format('(sn - st * sp / (total * (total - 1) / 2.0)) / ((st + sp) / 2 - st * sp / (total * (total - 1) / 2.0))')} as ari, total::bigint as n from h""")
def clustering_metrics(spark, d):
    m = metrics.clustering_metrics(nearest_seeds(spark, d))
    return m.select(*[r6(F.col(c)).alias(c) for c in ("homogeneity", "completeness", "v_measure", "nmi", "ari")], "n")


SETS = r"list_sort(list_distinct(list_filter(list_transform(coalesce({}, []), lambda x: trim(lower(x))), lambda x: x is not null and x <> '')))"


@query(f"""with f as (select rec_no, {SETS.format('topics')} as ts, {SETS.format('geographic')} as gs from shelf_features)
select count(*) as n_rows, {R6.format('avg(len(ts))')} as topic_cardinality, {R6.format('avg(len(gs))')} as place_cardinality, sum(case when len(ts) = 0 then 1 else 0 end)::bigint as without_topics from f""")
def label_cardinality(spark, d):
    f = table(spark, d, "shelf_features").select(facet_set(F.col("topics")).alias("ts"), facet_set(F.col("geographic")).alias("gs"))
    return f.agg(F.count("*").alias("n_rows"), r6(F.avg(F.size("ts"))).alias("topic_cardinality"), r6(F.avg(F.size("gs"))).alias("place_cardinality"), F.count_if(F.size("ts") == 0).alias("without_topics"))


@query(f"""with e as (select vec_id, label, embedding from embeddings), c as (select label, k, avg(v) as m from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as k from e) group by 1, 2),
cl as (select label, list(m order by k) as centre from c group by 1), s as (select vec_id, e.label = cl.label as own, {R6.format('list_cosine_similarity(embedding::double[], centre)')} as sim from e cross join cl),
m as (select vec_id, {R6.format('max(sim) filter (where own) - max(sim) filter (where not own)')} as margin from s group by vec_id)
select case when margin < 0 then 'hard' when margin >= 0.05 then 'easy' else 'medium' end as band, count(*) as n from m group by 1""")
def difficulty_bands(spark, d):
    """Margin of the own class's mean vector over the best other; classes are few, so centres are joined whole."""
    e = table(spark, d, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("centre"))
    s = e.crossJoin(F.broadcast(centre.withColumnRenamed("label", "other"))).select("vec_id", (F.col("label") == F.col("other")).alias("own"), r6(cosine(F.col("embedding"), F.col("centre"))).alias("sim"))  # one row for each class
    m = s.groupBy("vec_id").agg(r6(F.max(F.when(F.col("own"), F.col("sim"))) - F.max(F.when(~F.col("own"), F.col("sim")))).alias("margin"))
    return m.groupBy(F.when(F.col("margin") < 0, "hard").when(F.col("margin") >= 0.05, "easy").otherwise("medium").alias("band")).agg(F.count("*").alias("n"))
