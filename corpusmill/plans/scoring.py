"""Multilabel, pair, cluster and stratified metrics over real predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import r6
from corpusmill.functions.spellings import aliases, facet_key
from corpusmill.operators import metrics, multilabel, pairs
from corpusmill.plans.evaluation import CLUSTERS, PRED, SCORED, _evaluated, _labels, _scored, nearest_seeds
from corpusmill.plans.pairing import FX, JACCARD, QUOTAS, facets, mine_sql
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6, TRUTH
from corpusmill.sources.tables import table

LEAST = 0.5  # of a score that predicts
#: All classes that the rows of an id have, and each label's best confidence over all runs.
CELLS = f"""{TRUTH}, labels as (select term as label from label_space where facet = 'lcc_code'),
t as (select distinct id, term as label from shelf_features join alias on key = nullif(regexp_replace(lower(lcc_code), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '') where id is not null),
s as (select id, prediction as label, max(confidence) as score from class_predictions join labels on label = prediction where confidence is not null and id is not null group by 1, 2),
ids as (select distinct id from t intersect select distinct id from class_predictions where confidence is not null),
c as (select ids.id, l.label, coalesce((t.label is not null)::int, 0) as y, coalesce(s.score, 0) as score, (coalesce(s.score, 0) >= {LEAST})::int as p from ids cross join labels l left join t on t.id = ids.id and t.label = l.label left join s on s.id = ids.id and s.label = l.label)"""


def _cells(spark, d):
    space = table(spark, d, "label_space")
    keys = aliases(space).where("facet = 'lcc_code'").select("key", F.col("term").alias("label"))
    truth = table(spark, d, "shelf_features").where("id is not null").select("id", facet_key("lcc_code").alias("key")).join(F.broadcast(keys), "key").select("id", "label").distinct()  # a few spellings for each class
    scored = table(spark, d, "class_predictions").where("confidence is not null and id is not null").select("id", F.col("prediction").alias("label"), F.col("confidence").alias("score"))
    labels = _labels(spark, d)
    return multilabel.cells(truth, scored, labels, LEAST), labels


ROWS = "select id, sum(y) as t, sum(p) as k, sum(y * p) as tp from c group by id"
LABELS = "select label, sum(y) as support, sum(p) as num_predicted, sum(y * p) as tp, case when sum(y) + sum(p) > 0 then 2.0 * sum(y * p) / (sum(y) + sum(p)) else 0 end as f1 from c group by label"


@query(f"""with {CELLS}, r as ({ROWS}), l as ({LABELS}) select count(*) as n, {R6.format('2.0 * sum(tp) / sum(t + k)')} as f1_micro, (select {R6.format('avg(f1)')} from l) as f1_macro, (select {R6.format('sum(f1 * support) / sum(support)')} from l) as f1_weighted,
 {R6.format('avg(case when t + k > 0 then 2.0 * tp / (t + k) else 0 end)')} as f1_samples, {R6.format('avg((t = tp and k = tp)::int)')} as subset_accuracy, {R6.format('sum(t + k - 2 * tp) / (count(*) * (select count(*) from labels))')} as hamming_loss from r""")
def multilabel_bundle(spark, d):
    """Every class of an id's rows against the classes that any run predicts with enough confidence."""
    c, labels = _cells(spark, d)
    return multilabel.bundle(c, labels).select("n", *[r6(F.col(x)).alias(x) for x in ("f1_micro", "f1_macro", "f1_weighted", "f1_samples", "subset_accuracy", "hamming_loss")])


@query(f"""with {CELLS}, l as ({LABELS}) select label, {R6.format('case when num_predicted > 0 then tp / num_predicted else 0 end')} as precision, {R6.format('case when support > 0 then tp / support else 0 end')} as recall, {R6.format('f1')} as f1, support::bigint as support, num_predicted::bigint as num_predicted from l""")
def multilabel_per_label(spark, d):
    c, labels = _cells(spark, d)
    return multilabel.per_label(c, labels).select("label", *[r6(F.col(x)).alias(x) for x in ("precision", "recall", "f1")], "support", "num_predicted")


@query(f"""with {CELLS}, u as (select a.id, a.label, count(*) as rank, sum(b.y) as trues from c a join c b on a.id = b.id and b.score >= a.score where a.y = 1 group by 1, 2), q as (select id, avg(trues / rank) as lrap, max(rank) as depth from u group by id),
g as (select label, score, sum(y) as pos, count(*) as m from c group by 1, 2), w as (select label, pos, sum(pos) over (partition by label order by score desc) as tp, sum(m) over (partition by label order by score desc) as n from g), ap as (select label, sum(pos * tp / n) / sum(pos) as ap from w group by label having sum(pos) > 0),
h as (select score, sum(y) as pos, count(*) as m from c group by 1), v as (select pos, sum(pos) over (order by score desc) as tp, sum(m) over (order by score desc) as n from h)
select {R6.format('avg(lrap)')} as lrap, {R6.format('avg(depth)')} as coverage_error, (select {R6.format('sum(pos * tp / n) / sum(pos)')} from v) as map_micro, (select {R6.format('avg(ap)')} from ap) as map_macro from q""")
def multilabel_ranking(spark, d):
    """Threshold-free metrics of the label ranking; labels without a score are counted, never made."""
    c, labels = _cells(spark, d)
    a, b = multilabel.ranking(c, labels), multilabel.mean_average_precision(c, labels)
    return a.crossJoin(b).select(*[r6(F.col(x)).alias(x) for x in ("lrap", "coverage_error", "map_micro", "map_macro")])  # rows of one


MINED = f"{mine_sql(QUOTAS)}, pr as (select label as y, stratum, {R6.format(JACCARD.format(a='x.topics', b='y.topics'))} as score from mined m join fx x on x.id = m.a join fx y on y.id = m.b)"


def _pair_scores(spark, d):
    """Mined pairs with the overlap of their topics as score."""
    f = facets(spark, d)
    p = pairs.mine_pairs(f, QUOTAS)
    t = f.select("id", "topics")
    j = p.join(t.select(F.col("id").alias("doc_a"), F.col("topics").alias("ta")), "doc_a").join(t.select(F.col("id").alias("doc_b"), F.col("topics").alias("tb")), "doc_b")
    return j.select(F.col("label").alias("y"), "stratum", r6(pairs.jaccard(F.col("ta"), F.col("tb"))).alias("score"))


@query(f"""{MINED}, x as (select y, (score >= 0.2)::int as p from pr), s as (select count(*) as n, sum((y = p)::int) as ok, sum(y * p) as tp, sum(p) as pp, sum(y) as pos from x), b as (select score, sum(y) as pos, count(*) as n from pr group by score), c as (select pos, n, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as m, sum(n - pos) over (order by score) - (n - pos) as below from b)
select n, {R6.format('ok / n')} as accuracy, {R6.format('tp / pp')} as precision, {R6.format('tp / pos')} as recall, {R6.format('2 * tp / (pp + pos)')} as f1, (select {R6.format('sum(pos * tp / m) / sum(pos)')} from c) as ap, (select {R6.format('sum(pos * (below + (n - pos) / 2.0)) / (sum(pos) * sum(n - pos))')} from c) as auc from s""")
def pair_bundle(spark, d):
    """Accuracy, precision, recall and F1 at a threshold, AUC and average precision of mined pairs."""
    s = _pair_scores(spark, d)
    p = (F.col("score") >= 0.2).cast("int")
    a = s.agg(F.count("*").alias("n"), F.sum((F.col("y") == p).cast("int")).alias("ok"), F.sum(F.col("y") * p).alias("tp"), F.sum(p).alias("pp"), F.sum("y").alias("pos"))
    j = a.crossJoin(metrics.average_precision(s)).crossJoin(metrics.auc(s).select("auc"))  # rows of one
    return j.select("n", r6(F.col("ok") / F.col("n")).alias("accuracy"), r6(F.col("tp") / F.col("pp")).alias("precision"), r6(F.col("tp") / F.col("pos")).alias("recall"), r6(2 * F.col("tp") / (F.col("pp") + F.col("pos"))).alias("f1"), r6(F.col("ap")).alias("ap"), r6(F.col("auc")).alias("auc"))


@query(f"{MINED} select stratum, count(*) as n, {R6.format('avg((y = (score >= 0.2)::int)::int)')} as accuracy, {R6.format('avg(score)')} as mean_score from pr group by stratum")
def pair_accuracy_by_stratum(spark, d):
    ok = (F.col("y") == (F.col("score") >= 0.2).cast("int")).cast("int")
    return _pair_scores(spark, d).groupBy("stratum").agg(F.count("*").alias("n"), r6(F.avg(ok)).alias("accuracy"), r6(F.avg("score")).alias("mean_score"))


@query(f"""{SCORED}, q as (select quantile_cont(score, list_transform(range(0, 101), lambda i: i / 100.0)) as qs from s), th as (select distinct unnest(case when (select count(distinct score) from s) <= 100 then (select list(distinct score) from s) else qs end) as t from q),
f as (select t, 2.0 * sum(y) filter (where score >= t) / (count(*) filter (where score >= t) + sum(y)) as f1 from th cross join s group by t)
select {R6.format('t')} as threshold, {R6.format('f1')} as f1 from f order by floor(f1 * 1e6 + 0.5) desc, t limit 1""")
def best_threshold_percentiles(spark, d):
    """The threshold of best F1 among all scores if there are at most 100, else among 101 percentiles; the lowest of equals."""
    s = _scored(spark, d)
    by = s.groupBy("score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    few = s.agg(F.countDistinct("score").alias("m"), F.percentile("score", F.array(*[F.lit(i / 100) for i in range(101)])).alias("qs"))
    all_ = by.select("score").orderBy("score").limit(101).agg(F.sort_array(F.collect_list("score")).alias("ss"))  # 101 scores at most
    th = few.crossJoin(all_).select(F.explode(F.array_distinct(F.when(F.col("m") <= 100, F.col("ss")).otherwise(F.col("qs")))).alias("t"))
    total = by.agg(F.sum("pos").alias("p"))
    at = by.crossJoin(F.broadcast(th)).groupBy("t").agg(F.sum(F.when(F.col("score") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("score") >= F.col("t"), F.col("n")).otherwise(0)).alias("m"))  # 101 thresholds
    f1 = r6(2.0 * F.col("tp") / (F.col("m") + F.col("p")))
    return at.crossJoin(total).select(r6(F.col("t")).alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def metric_sql(k):
    """One row of cluster metrics from a contingency table k(truth, pred, n)."""
    return f"""select {R6.format('case when ht <= 0 then 1 else mi / ht end')} as homogeneity, {R6.format('case when hp <= 0 then 1 else mi / hp end')} as completeness, {R6.format('2 * mi / (ht + hp)')} as nmi, {R6.format('(sn - st * sp / (total * (total - 1) / 2.0)) / ((st + sp) / 2 - st * sp / (total * (total - 1) / 2.0))')} as ari, total::bigint as n from (select
 (select sum(-(m / total) * ln(m / total)) from (select truth, sum(n) as m from {k} group by 1)) as ht, (select sum(-(m / total) * ln(m / total)) from (select pred, sum(n) as m from {k} group by 1)) as hp,
 (select sum(n / total * ln(n * total / (nt * np))) from {k} join (select truth, sum(n) as nt from {k} group by 1) using (truth) join (select pred, sum(n) as np from {k} group by 1) using (pred)) as mi,
 (select sum(n * (n - 1) / 2.0) from {k}) as sn, (select sum(m * (m - 1) / 2.0) from (select sum(n) as m from {k} group by truth)) as st, (select sum(m * (m - 1) / 2.0) from (select sum(n) as m from {k} group by pred)) as sp, total from (select sum(n)::double as total from {k}))"""


@query(f"""with {CLUSTERS}, a as (select label as truth, case when sim < 0.1 then -1 else seed end as pred from nr), k as (select truth, pred, count(*) as n from a where pred <> -1 group by 1, 2)
select m.*, (select count(*) from a where pred = -1) as noise, {R6.format("(select avg((pred = -1)::int) from a)")} as noise_ratio, (select count(distinct pred) from k) as clusters_pred, (select count(distinct truth) from a) as clusters_true, {R6.format("(select abs((select count(distinct pred) from k) - count(distinct truth)) / count(distinct truth) from a)")} as k_error from ({metric_sql('k')}) m""")
def discovery_metrics(spark, d):
    """Clusters with noise (vectors far from every seed): metrics over the rest, share of noise and error of the number of clusters."""
    a = nearest_seeds(spark, d).select("truth", F.when(F.col("sim") < 0.1, -1).otherwise(F.col("pred")).alias("pred"))
    return metrics.discovery(a).select(*[r6(F.col(c)).alias(c) for c in ("homogeneity", "completeness", "nmi", "ari")], "n", "noise", r6(F.col("noise_ratio")).alias("noise_ratio"), "clusters_pred", "clusters_true", r6(F.col("k_error")).alias("k_error"))


CONDITIONAL = f"""{FX}, a as (select cls, form as truth, coalesce(reg, '') as pred from fx where cls is not null and form is not null), ok as (select cls from a group by cls having count(*) >= 20 and count(distinct truth) > 1),
ct as (select cls, truth, pred, count(*) as n from a where cls in (select cls from ok) group by 1, 2, 3), tot as (select cls, sum(n)::double as total from ct group by 1), tt as (select cls, truth, sum(n) as nt from ct group by 1, 2), pp as (select cls, pred, sum(n) as np from ct group by 1, 2),
ht as (select cls, sum(-(nt / total) * ln(nt / total)) as ht from tt join tot using (cls) group by 1), hp as (select cls, sum(-(np / total) * ln(np / total)) as hp from pp join tot using (cls) group by 1), mi as (select cls, sum(n / total * ln(n * total / (nt * np))) as mi from ct join tt using (cls, truth) join pp using (cls, pred) join tot using (cls) group by 1),
per as (select cls, case when ht <= 0 then 1 else mi / ht end as homogeneity, case when ht + hp > 0 then 2 * mi / (ht + hp) else 1 end as nmi, total from ht join hp using (cls) join mi using (cls) join tot using (cls)),
k as (select truth, cls || '::' || pred as pred, sum(n) as n from ct group by 1, 2)"""


@query(f"with {CONDITIONAL} select (select count(*) from per) as classes, (select count(distinct cls) from a) - (select count(*) from per) as skipped, (select {R6.format('avg(homogeneity)')} from per) as macro_homogeneity, (select {R6.format('avg(nmi)')} from per) as macro_nmi, m.homogeneity as pooled_homogeneity, m.nmi as pooled_nmi, m.n from ({metric_sql('k')}) m")
def conditional_clustering(spark, d):
    """Clusters (registers) against forms within each class of 20 documents and two forms at least: the classes' mean, and all pooled with clusters told apart by class."""
    f = facets(spark, d).where("cls is not null and form is not null").select("cls", F.col("form").alias("truth"), F.coalesce("reg", F.lit("")).alias("pred"))
    size = f.groupBy("cls").agg(F.count("*").alias("m"), F.countDistinct("truth").alias("t"))
    kept = size.where("m >= 20 and t > 1").select("cls")
    a = f.join(kept, "cls", "left_semi")
    per = metrics.clustering_by(a, "cls").agg(F.count("*").alias("classes"), F.avg("homogeneity").alias("h"), F.avg("nmi").alias("i"))
    pooled = metrics.clustering_metrics(a.select("truth", F.concat_ws("::", "cls", "pred").alias("pred")))
    n = size.agg(F.count("*").alias("all"))
    j = per.crossJoin(pooled).crossJoin(n)  # rows of one
    return j.select("classes", (F.col("all") - F.col("classes")).alias("skipped"), r6(F.col("h")).alias("macro_homogeneity"), r6(F.col("i")).alias("macro_nmi"), r6(F.col("homogeneity")).alias("pooled_homogeneity"), r6(F.col("nmi")).alias("pooled_nmi"), "n")


FIELDS = ("reg", "aud", "model", "split")
EVX = f"""{PRED}, {FX}, ex as (select ev.*, (truth = pred)::int as ok, fx.reg, fx.aud, fx.model, fx.split from ev join fx using (id)), st as ({' union all '.join(f"select '{f}' as field, coalesce({f}, 'unknown') as stratum, count(*) as n, sum(ok) as correct from ex group by 2" for f in FIELDS)}), big as (select *, correct / n as accuracy from st where n >= 10)"""


def _strata(spark, d):
    """(field, stratum, n, correct) in one pass: each evaluated prediction counts for one stratum of every field."""
    ev = _evaluated(spark, d).select("id", (F.col("truth") == F.col("pred")).cast("int").alias("ok"))
    j = ev.join(facets(spark, d).select("id", *FIELDS), "id")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("unknown")).alias("stratum")) for f in FIELDS])
    return j.select("ok", F.explode(rows).alias("x")).groupBy("x.field", "x.stratum").agg(F.count("*").alias("n"), F.sum("ok").alias("correct"))


@query(f"with {EVX} select field, stratum, n, correct::bigint as correct, {R6.format('correct / n')} as accuracy, {R6.format('1 - correct / n')} as error_rate from st")
def accuracy_by_field(spark, d):
    a = F.col("correct") / F.col("n")
    return _strata(spark, d).select("field", "stratum", "n", "correct", r6(a).alias("accuracy"), r6(1 - a).alias("error_rate"))


@query(f"with {EVX}, r as (select *, row_number() over (partition by field order by floor(accuracy * 1e6 + 0.5), stratum) as lo, row_number() over (partition by field order by floor(accuracy * 1e6 + 0.5) desc, stratum) as hi from big) select field, stratum, n, {R6.format('accuracy')} as accuracy, case when lo <= 5 then 'worst' else 'best' end as side from r where lo <= 5 or hi <= 5")
def best_and_worst_strata(spark, d):
    """The five best and worst strata of each field, of ten predictions at least."""
    s = _strata(spark, d).where("n >= 10").withColumn("accuracy", r6(F.col("correct") / F.col("n")))
    w = lambda o: F.row_number().over(Window.partitionBy("field").orderBy(o, "stratum"))
    r = s.withColumn("lo", w(F.asc("accuracy"))).withColumn("hi", w(F.desc("accuracy"))).where("lo <= 5 or hi <= 5")
    return r.select("field", "stratum", "n", "accuracy", F.when(F.col("lo") <= 5, "worst").otherwise("best").alias("side"))


@query(f"""with {EVX}, o as (select avg(ok) as overall from ex), v as (select accuracy as a, field || '=' || stratum as s from big union all select overall, 'overall' from o)
select {R6.format('(select overall from o)')} as overall, {R6.format('min(a)')} as worst, (select s from v order by floor(a * 1e6 + 0.5), s limit 1) as worst_stratum, {R6.format('(select overall from o) - min(a)')} as gap, {R6.format('var_pop(a)')} as variance, (select overall from o) - min(a) <= 0.1 as is_reliable from v""")
def reliability_gap(spark, d):
    """Overall accuracy against the worst stratum of any field, and the variance over strata and the whole."""
    big = _strata(spark, d).where("n >= 10").select((F.col("correct") / F.col("n")).alias("a"), F.concat_ws("=", "field", "stratum").alias("s"))
    ev = _evaluated(spark, d).join(facets(spark, d).select("id"), "id", "left_semi")
    o = ev.agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("a"))
    v = big.unionByName(o.select("a", F.lit("overall").alias("s")))
    m = v.agg(F.min("a").alias("w"), F.var_pop("a").alias("v"), F.min(F.struct(r6(F.col("a")).alias("k"), "s")).alias("m"))
    gap = F.col("a") - F.col("w")
    return o.crossJoin(m).select(r6(F.col("a")).alias("overall"), r6(F.col("w")).alias("worst"), F.col("m.s").alias("worst_stratum"), r6(gap).alias("gap"), r6(F.col("v")).alias("variance"), (gap <= 0.1).alias("is_reliable"))


@query(f"with {PRED} select run_name, id, truth, pred, confidence from ev where truth <> pred and confidence >= 0.5 order by confidence desc, run_name, id limit 20")
def high_confidence_errors(spark, d):
    """The twenty wrong predictions of highest confidence."""
    e = _evaluated(spark, d).where((F.col("truth") != F.col("pred")) & (F.col("confidence") >= 0.5))
    return e.orderBy(F.desc("confidence"), "run_name", "id").limit(20).select("run_name", "id", "truth", "pred", "confidence")


@query(f"with {PRED}, {FX}, e as (select reg, truth, pred from ev join fx using (id) where reg is not null), big as (select reg from e group by reg having count(*) >= 10), c as (select reg, truth, pred, count(*) as n from e where reg in (select reg from big) group by 1, 2, 3) select reg as register, truth, pred, n from c")
def stratified_confusion(spark, d):
    """Confusion counts within each register of ten predictions at least."""
    e = _evaluated(spark, d).join(facets(spark, d).where("reg is not null").select("id", "reg"), "id")
    big = e.groupBy("reg").agg(F.count("*").alias("m")).where("m >= 10").select("reg")
    return e.join(big, "reg", "left_semi").groupBy(F.col("reg").alias("register"), "truth", "pred").agg(F.count("*").alias("n"))


@query(f"""with {PRED}, {FX}, e as (select reg, truth, pred from ev join fx using (id) where reg is not null), t as (select reg, truth as l, count(*) as n from e group by 1, 2), p as (select reg, pred as l, count(*) as n from e group by 1, 2), h as (select reg, truth as l, count(*) as n from e where truth = pred group by 1, 2),
g as (select r.reg, label, coalesce(2.0 * h.n / (coalesce(t.n, 0) + coalesce(p.n, 0)), 0) as f1 from (select distinct reg from e) r cross join labels left join t on t.reg = r.reg and t.l = label left join p on p.reg = r.reg and p.l = label left join h on h.reg = r.reg and h.l = label) select reg as register, {R6.format('avg(f1)')} as macro_f1 from g group by 1""")
def stratified_macro_f1(spark, d):
    """Macro F1 over the whole label space within each register."""
    e = _evaluated(spark, d).join(facets(spark, d).where("reg is not null").select("id", "reg"), "id")
    tp = e.where("truth = pred").groupBy("reg", F.col("truth").alias("label")).agg(F.count("*").alias("tp"))
    both = e.groupBy("reg", F.col("truth").alias("label")).agg(F.count("*").alias("m")).unionByName(e.groupBy("reg", F.col("pred").alias("label")).agg(F.count("*").alias("m")))
    f = both.groupBy("reg", "label").agg(F.sum("m").alias("m")).join(F.broadcast(_labels(spark, d)), "label", "left_semi").join(tp, ["reg", "label"], "left")  # a small label space
    n = _labels(spark, d).agg(F.count("*").alias("n"))
    return f.groupBy("reg").agg(F.sum(F.coalesce(2.0 * F.col("tp") / F.col("m"), F.lit(0.0))).alias("s")).crossJoin(n).select(F.col("reg").alias("register"), r6(F.col("s") / F.col("n")).alias("macro_f1"))


UNCERTAIN = "avg((a = '?' or b = '?')::int)"
AGREE = f"""{PRED}, g as (select id, run_name, truth, pred from ev), w as (select id, truth, max(case when run_name = 'lin-bow' then pred end) as a, max(case when run_name = 'enc-large' then pred end) as b from g group by 1, 2)"""


@query(f"with {AGREE} select count(*) as n, {R6.format('avg((a = truth)::int)')} as accuracy_a, {R6.format('avg((b = truth)::int)')} as accuracy_b, {R6.format('avg((a = b)::int)')} as agreement, {R6.format('avg(((a = b) and a = truth)::int)')} as all_agree, {R6.format(UNCERTAIN)} as uncertain from w where a is not null and b is not null")
def coder_agreement(spark, d):
    """Two runs as coders against the gold class, over documents that both coded: a three-way join as one grouping."""
    w = _evaluated(spark, d).groupBy("id", "truth").agg(F.max(F.when(F.col("run_name") == "lin-bow", F.col("pred"))).alias("a"), F.max(F.when(F.col("run_name") == "enc-large", F.col("pred"))).alias("b")).where("a is not null and b is not null")
    m = lambda c: r6(F.avg(F.expr(c).cast("int")))
    return w.agg(F.count("*").alias("n"), m("a = truth").alias("accuracy_a"), m("b = truth").alias("accuracy_b"), m("a = b").alias("agreement"), m("a = b and a = truth").alias("all_agree"), m("a = '?' or b = '?'").alias("uncertain"))


@query(f"""with {PRED}, n as (select run_name, count(*) as rows, count(distinct id) as ids, count(*) - count(distinct id) as repeated, count(*) filter (where confidence is null) as no_confidence, count(*) filter (where prediction not in (select label from labels)) as outside from class_predictions group by 1), m as (select run_name, count(*) as missing from (select distinct run_name from class_predictions) r cross join gt where not exists (select 1 from class_predictions p where p.run_name = r.run_name and p.id = gt.id) group by 1)
select n.run_name, n.rows, n.ids, n.repeated, n.no_confidence, n.outside, coalesce(missing, 0) as missing from n left join m using (run_name)""")
def run_coverage(spark, d):
    """Rows, repeats, labels outside the space and labelled ids that a run lacks; the last by counts, without pairing runs and ids."""
    from corpusmill.operators.labels import class_truth

    p = table(spark, d, "class_predictions")
    inside = F.broadcast(_labels(spark, d).withColumnRenamed("label", "prediction").withColumn("inside", F.lit(True)))  # a small label space
    gold = class_truth(table(spark, d, "shelf_features"), table(spark, d, "label_space")).select("id", F.lit(True).alias("gold"))
    j = p.join(inside, "prediction", "left").join(gold, "id", "left")
    n = j.groupBy("run_name").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.count_if(F.col("confidence").isNull()).alias("no_confidence"), F.count_if(F.col("inside").isNull() & F.col("prediction").isNotNull()).alias("outside"), F.countDistinct(F.when(F.col("gold"), F.col("id"))).alias("have"))
    g = gold.agg(F.count("*").alias("all"))
    return n.crossJoin(F.broadcast(g)).select("run_name", "rows", "ids", (F.col("rows") - F.col("ids")).alias("repeated"), "no_confidence", "outside", (F.col("all") - F.col("have")).alias("missing"))  # one row on the right
