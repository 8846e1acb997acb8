"""Fitted vocabularies and their reuse, presets, bundles, verdicts over arms, slices by quota, and tables by model and task."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import correlation, hash60, r6
from corpusmill.operators import lexical, metrics
from corpusmill.operators.resampling import replicate_sums
from corpusmill.plans.evaluation import PRED, _evaluated, _labels
from corpusmill.plans.gates import lit
from corpusmill.plans.pairing import FX, facets, hash_sql
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import POST, QS, R6, TOK, _queries
from corpusmill.plans.scoring import CELLS, _cells
from corpusmill.plans.significance import BS, H, U, WEIGHT, interval
from corpusmill.plans.statistics import SCORES, _scores
from corpusmill.plans.texts import _masked, LABELS
from corpusmill.runtime import stage
from corpusmill.sources.tables import table

VOCAB = f"{POST}, nd as (select count(*) as n from documents), vf as (select term, count(*) as df from post group by term), vc as (select term, df, row_number() over (order by df desc, term) as r from vf cross join nd where df >= 2 and df <= floor(0.5 * n))"


def fitted(spark, d, features=1000):
    """(term, df, id): terms of two documents at least and half of them at most, the `features` most frequent, numbered by name."""
    t = lexical.token_table(table(spark, d, "documents"), "doc_id", "text")
    return lexical.fit_vocabulary(t, 2, 0.5, features)


@query(f"with {VOCAB} select term, df, row_number() over (order by term) - 1 as id from vc where r <= 1000")
def fitted_vocabulary(spark, d):
    return fitted(spark, d)


@query(f"with {VOCAB}, v as (select term, row_number() over (order by term) - 1 as id from vc where r <= 1000), p as (select rec_no, unnest({TOK.replace('{}', 'title')}) as term from shelf_features) select rec_no, id, count(*) as tf from p join v using (term) group by 1, 2")
def transformed_titles(spark, d):
    """New texts under a vocabulary that was fitted on others: words outside it are left out."""
    v = stage(fitted(spark, d).select("term", "id"), "vocabulary")
    t = lexical.token_table(table(spark, d, "shelf_features"), "rec_no", "title", v)
    return lexical.postings_of(t).join(v, "term").select(F.col("doc").alias("rec_no"), "id", "tf")


#: Presets of k1 and b.
PRESETS = {"default": (1.5, 0.75), "short": (1.2, 0.5), "long": (2.0, 0.75)}
PRE = ", ".join(f"('{n}', {a}::double, {b}::double)" for n, (a, b) in PRESETS.items())


@query(f"""with {POST}, {QS}, q as (select query, term, count(*) as qtf from qt group by 1, 2), st as (select count(*) as n, avg(dl) as avgdl from (select doc, max(dl) as dl from post group by doc)), dfs as (select term, count(*) as df from post group by term), pr(preset, k1, b) as (values {PRE}),
s as (select preset, query, doc, sum(qtf * ln((n - df + 0.5) / (df + 0.5)) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))) as score from q join post using (term) join dfs using (term) cross join st cross join pr group by 1, 2, 3), r as (select *, row_number() over (partition by preset, query order by floor(score * 1e6 + 0.5) desc, doc) as rank from s)
select preset, query, doc as best, {R6.format('score')} as score from r where rank = 1""")
def bm25_presets(spark, d):
    """The best document of each query under each preset; texts are read once for all of them."""
    docs = table(spark, d, "documents")
    terms = stage(_queries(spark, d).select("query", F.explode(lexical.tokens(F.col("qtext"))).alias("term")), "terms")
    q = terms.groupBy("query", "term").agg(F.count("*").alias("qtf"))
    t = lexical.token_table(docs, "doc_id", "text", q)
    wanted = stage(lexical.postings_of(t).join(q.select("term").distinct(), "term", "left_semi"), "wanted")
    out = None
    for name, (k1, b) in PRESETS.items():
        s = lexical._bm25(q, wanted, t.where("dl > 0"), k1, b)
        best = s.groupBy("query").agg(F.min(F.struct((-r6(F.col("score"))).alias("s"), "doc")).alias("m")).select(F.lit(name).alias("preset"), "query", F.col("m.doc").alias("best"), (-F.col("m.s")).alias("score"))
        out = best if out is None else out.unionByName(best)
    return out


BUNDLE = f"""{PRED}, c as (select truth, pred, count(*) as n from ev group by 1, 2), m as (select label, coalesce((select sum(n) from c where truth = label and pred = label), 0) as tp, coalesce((select sum(n) from c where truth = label), 0) as s, coalesce((select sum(n) from c where pred = label), 0) as p from labels), f as (select label, case when p > 0 then tp / p else 0 end as precision, case when s > 0 then tp / s else 0 end as recall, case when p + s > 0 then 2 * tp / (p + s) else 0 end as f1, s, tp, p from m)"""


@query(f"with {BUNDLE} select 'accuracy' as metric, {R6.format('(select avg((truth = pred)::int) from ev)')} as value union all select 'macro_f1', {R6.format('avg(f1)')} from f union all select 'macro_precision', {R6.format('avg(precision)')} from f union all select 'macro_recall', {R6.format('avg(recall)')} from f union all select 'micro_f1', {R6.format('2 * sum(tp) / (sum(p) + sum(s))')} from f union all select 'weighted_f1', {R6.format('sum(f1 * s) / sum(s)')} from f")
def classification_bundle(spark, d):
    """All classification metrics in long form, from one table of confusions."""
    ev = _evaluated(spark, d)
    conf = stage(metrics.confusion(ev), "confusion")
    c = metrics.class_metrics(conf, _labels(spark, d))
    inside = _labels(spark, d)
    tp = conf.where("truth = pred").join(inside, F.col("truth") == F.col("label"), "left_semi").agg(F.sum("n").alias("tp"))
    sums = conf.select(F.col("truth").alias("label"), "n").unionByName(conf.select(F.col("pred").alias("label"), "n")).join(inside, "label", "left_semi").agg(F.sum("n").alias("m"))
    acc = conf.agg(F.try_divide(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    j = c.agg(F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")).crossJoin(acc).crossJoin(tp).crossJoin(sums)  # rows of one
    j = j.withColumn("micro_f1", F.try_divide(2 * F.col("tp"), "m"))
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), r6(F.col(n)).alias("value")) for n in ("accuracy", "macro_f1", "macro_precision", "macro_recall", "micro_f1", "weighted_f1")])
    return j.select(F.explode(rows).alias("x")).select("x.*")


@query(f"""with {CELLS}, {BS}, r as (select id, sum(y) as t, sum(p) as k, sum(y * p) as tp, {H.format('id')} as h from c group by id), w as (select b, t, k, tp, {WEIGHT} as g from (select b, t, k, tp, {U} as u from r cross join bs)), m as (select b, 2.0 * sum(g * tp) / sum(g * (t + k)) as m from w group by b) select {R6.format('quantile_cont(m, 0.025)')} as lo, {R6.format('quantile_cont(m, 0.975)')} as hi from m""")
def bootstrap_multilabel_f1(spark, d):
    """Interval of micro F1 when documents are resampled: weighted sums of each document's cells."""
    c, _ = _cells(spark, d)
    r = c.groupBy("id").agg(F.sum(F.col("y") * F.col("p")).alias("tp"), (F.sum("y") + F.sum("p")).alias("n")).withColumn("h", hash60(F.col("id")))
    m = replicate_sums(r, ["tp", "n"]).withColumn("m", 2 * F.col("s_tp") / F.col("s_n"))
    return interval(m, [], "m").select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query(f"""with {SCORES}, {BS}, r as (select model, task, score, {H.format('task')} as h from sc), p as (select a.model as ma, b.model as mb, a.task, a.h, a.score as x, b.score as y from r a join r b on a.task = b.task and a.model < b.model),
w as (select ma, mb, b, x, y, {WEIGHT} as g from (select ma, mb, b, x, y, {U} as u from p cross join bs)), s as (select ma, mb, b, sum(g) as n, sum(g * x) as sx, sum(g * y) as sy, sum(g * x * x) as xx, sum(g * y * y) as yy, sum(g * x * y) as xy from w group by 1, 2, 3),
c as (select ma, mb, (n * xy - sx * sy) / sqrt((n * xx - sx * sx) * (n * yy - sy * sy)) as r from s where (n * xx - sx * sx) * (n * yy - sy * sy) > 1e-9) select ma as model_a, mb as model_b, {R6.format('quantile_cont(r, 0.025)')} as lo, {R6.format('quantile_cont(r, 0.975)')} as hi from c group by 1, 2""")
def correlation_intervals(spark, d):
    """Interval of the correlation of two runs' scores when tasks are resampled."""
    s = _scores(spark, d).withColumn("h", hash60(F.col("task")))
    j = s.alias("a").join(s.alias("b"), (F.col("a.task") == F.col("b.task")) & (F.col("a.model") < F.col("b.model")))
    p = j.select(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), F.col("a.h").alias("h"), F.col("a.score").alias("x"), F.col("b.score").alias("y")).selectExpr("*", "x * x as xx", "y * y as yy", "x * y as xy")
    m = replicate_sums(p, ["x", "y", "xx", "yy", "xy"], ["model_a", "model_b"])
    v = (F.col("w") * F.col("s_xx") - F.col("s_x") * F.col("s_x")) * (F.col("w") * F.col("s_yy") - F.col("s_y") * F.col("s_y"))
    r = m.where(v > 1e-9).withColumn("r", (F.col("w") * F.col("s_xy") - F.col("s_x") * F.col("s_y")) / F.sqrt(v))
    return interval(r, ["model_a", "model_b"], "r").select("model_a", "model_b", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query(f"with {SCORES}, r as (select model, task, rank() over (partition by task order by score desc) as r from sc) select model, {', '.join(f'max(r) filter (where task = {lit(t)})::bigint as rank_{t.lower()}' for t in 'ABCDEFGHJKLMNPQRSTUVZ')}, {R6.format('avg(r)')} as mean_rank from r group by model")
def rank_matrix(spark, d):
    """Runs by classes: the rank of each, and the mean."""
    r = _scores(spark, d).withColumn("r", F.rank().over(Window.partitionBy("task").orderBy(F.desc("score"))))
    return r.groupBy("model").agg(*[F.max(F.when(F.col("task") == t, F.col("r"))).cast("long").alias(f"rank_{t.lower()}") for t in "ABCDEFGHJKLMNPQRSTUVZ"], r6(F.avg("r")).alias("mean_rank"))


@query(f"with {SCORES}, b as (select task, max(score) as top from sc group by 1) select model, sc.task, {R6.format('score')} as score, score = top as is_best from sc join b using (task)")
def best_of_each_task(spark, d):
    """Scores by run and class with the best of each class marked, as tables of results print them."""
    s = _scores(spark, d)
    b = s.groupBy("task").agg(F.max("score").alias("top"))
    return s.join(b, "task").select("model", "task", r6(F.col("score")).alias("score"), (F.col("score") == F.col("top")).alias("is_best"))


MARGINS = f"{PRED}, s as (select id, truth, coalesce(max(confidence) filter (where pred = truth), 0) as own, coalesce(max(confidence) filter (where pred <> truth), 0) as other from ev group by 1, 2), m as (select id, {R6.format('own - other')} as margin from s), q as (select quantile_cont(margin, 1 / 3) as lo, quantile_cont(margin, 2 / 3) as hi from m)"


@query(f"with {MARGINS} select case when margin < 0 or margin <= lo then 'hard' when margin >= hi then 'easy' else 'medium' end as band, count(*) as n, {R6.format('avg(margin)')} as mean_margin from m cross join q group by 1")
def difficulty_terciles(spark, d):
    """Documents by the margin of the true class's best confidence over any other's: terciles, and hard wherever it is negative."""
    e = _evaluated(spark, d)
    best = lambda c: F.coalesce(F.max(F.when(c, F.col("confidence"))), F.lit(0.0))
    m = e.groupBy("id", "truth").agg(r6(best(F.col("pred") == F.col("truth")) - best(F.col("pred") != F.col("truth"))).alias("margin"))
    q = m.agg(F.percentile("margin", 1 / 3).alias("lo"), F.percentile("margin", 2 / 3).alias("hi"))
    band = F.when((F.col("margin") < 0) | (F.col("margin") <= F.col("lo")), "hard").when(F.col("margin") >= F.col("hi"), "easy").otherwise("medium")
    return m.crossJoin(F.broadcast(q)).groupBy(band.alias("band")).agg(F.count("*").alias("n"), r6(F.avg("margin")).alias("mean_margin"))  # one row on the right


@query("with t as (select text as t from documents union select body from shelf_features union select title from shelf_features) select count(*) as texts, bit_xor(('0x' || substr(md5(t), 1, 15))::bigint)::bigint as checksum from t where t is not null")
def texts_to_embed(spark, d):
    """All different texts of the corpora, once each, as what an embedding cache needs."""
    s = table(spark, d, "shelf_features")
    t = table(spark, d, "documents").select(F.col("text").alias("t")).unionByName(s.select(F.col("body").alias("t"))).unionByName(s.select(F.col("title").alias("t"))).where("t is not null").distinct()
    return t.agg(F.count("*").alias("texts"), F.bit_xor(hash60(F.col("t"))).alias("checksum"))


@query("with c as (select md5(body) as k, min(rec_no) as vec from shelf_features where split = 'train' and body is not null group by 1) select count(*) as n_rows, count(c.vec) as hits, count(*) - count(c.vec) as misses, sum(coalesce(c.vec, 0))::bigint as checksum from shelf_features s left join c on c.k = md5(s.body) where s.split <> 'train'")
def content_keyed_cache(spark, d):
    """Lookups of texts in a cache keyed by content, with a fallback for misses."""
    s = table(spark, d, "shelf_features")
    c = s.where("split = 'train' and body is not null").groupBy(F.md5("body").alias("k")).agg(F.min("rec_no").alias("vec"))
    j = s.where("split <> 'train'").select(F.md5("body").alias("k")).join(c, "k", "left")
    return j.agg(F.count("*").alias("n_rows"), F.count("vec").alias("hits"), F.count_if(F.col("vec").isNull()).alias("misses"), F.sum(F.coalesce("vec", F.lit(0))).alias("checksum"))


@query(f"with {LABELS}, a as (select source, {R6.format('avg(len(' + TOK.replace('{}', 'masked') + ') / greatest(len(' + TOK.replace('{}', 'ms.text') + '), 1))')} as kept, count(*) as n, sum((removed > 0)::int)::bigint as touched from ms join documents using (doc_id) where source is not null group by 1) select source, n, touched, kept, case when kept >= 0.99 then 'hardly touched' when kept >= 0.95 then 'touched' else 'much changed' end as verdict from a")
def masking_ablation(spark, d):
    """What masking leaves of each source's texts, with a verdict: arms are joined by document."""
    m = _masked(spark, d).join(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "doc_id")
    n = lambda c: F.size(lexical.tokens(F.col(c)))
    a = m.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("removed") > 0).alias("touched"), r6(F.avg(n("masked") / F.greatest(n("text"), F.lit(1)))).alias("kept"))
    return a.select("source", "n", "touched", "kept", F.when(F.col("kept") >= 0.99, "hardly touched").when(F.col("kept") >= 0.95, "touched").otherwise("much changed").alias("verdict"))


@query(f"""with {FX}, w as (select id, cls, spec_id, {hash_sql('slice', 'spec_id')} as h from fx where cls is not null and spec_id is not null), s as (select spec_id, min(cls) as cls, min(h) as h, count(*) as docs from w group by 1), r as (select *, row_number() over (partition by cls order by h, spec_id) as r from s) select cls, spec_id, docs from r where r <= 4""")
def transfer_slice(spark, d):
    """Whole works of each class up to a quota of four, in hash order."""
    w = facets(spark, d).where("cls is not null and spec_id is not null")
    s = w.groupBy("spec_id").agg(F.min("cls").alias("cls"), F.count("*").alias("docs")).withColumn("h", hash60(F.concat_ws("|", F.lit("slice"), "spec_id")))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("h", "spec_id"))).where("r <= 4").select("cls", "spec_id", "docs")


@query(f"""with {FX}, u as (select id, {R6.format("(" + hash_sql('affine', 'id') + " % 1000003) / 1000003.0")} as u, cat, aud from fx where cat is not null) select cat, count(*) as n, count(*) filter (where u < 0.7) as affine, count(*) filter (where u >= 0.7) as free, min(aud) filter (where u < 0.7) as first_affine from u group by 1""")
def affinity_draws(spark, d):
    """Documents that a generator with affinities would bind to their category, seven of ten by hash."""
    u = facets(spark, d).where("cat is not null").withColumn("u", r6(hash60(F.concat_ws("|", F.lit("affine"), "id")) % 1000003 / F.lit(1000003.0)))
    return u.groupBy("cat").agg(F.count("*").alias("n"), F.count_if(F.col("u") < 0.7).alias("affine"), F.count_if(F.col("u") >= 0.7).alias("free"), F.min(F.when(F.col("u") < 0.7, F.col("aud"))).alias("first_affine"))


@query(r"select facet, count(*) as n, count(*) filter (where len(list_filter(regexp_extract_all(lower(broader), '[\p{L}]{3,}'), lambda w: not list_contains(regexp_extract_all(lower(term), '[\p{L}]{3,}'), w))) > 0) as informative from label_space group by facet")
def informative_labels(spark, d):
    """Labels whose broader name says a word that they don't."""
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]{3,})"), F.lit(1))
    more = F.size(F.array_except(w(F.col("broader")), w(F.col("term")))) > 0
    return table(spark, d, "label_space").groupBy("facet").agg(F.count("*").alias("n"), F.count_if(more).alias("informative"))


@query(r"with c as (select rec_no, trim(regexp_replace(regexp_replace(coalesce(register_description, ''), '\s*\([^)]*\)', '', 'g'), '\s+', ' ', 'g')) as d, coalesce(lcc_name, '') as n from shelf_features) select case when d <> '' and d <> 'None' then 'described' when n <> '' then 'named' else 'bare' end as tier, count(*) as n_rows, min(case when d <> '' and d <> 'None' then d when n <> '' then n else 'rec ' || rec_no end) as first from c group by 1")
def description_tiers(spark, d):
    """The best description that a row has: its own, cleaned, else its class's name, else its number."""
    s = table(spark, d, "shelf_features")
    c = s.select("rec_no", F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("register_description", F.lit("")), r"\s*\([^)]*\)", ""), r"\s+", " ")).alias("d"), F.coalesce("lcc_name", F.lit("")).alias("n"))
    own, named = ~F.col("d").isin("", "None"), F.col("n") != ""
    best = F.when(own, F.col("d")).when(named, F.col("n")).otherwise(F.concat(F.lit("rec "), F.col("rec_no").cast("string")))
    return c.groupBy(F.when(own, "described").when(named, "named").otherwise("bare").alias("tier")).agg(F.count("*").alias("n_rows"), F.min(best).alias("first"))


@query(f"with {SCORES}, x as (select model, avg(score) as s from sc where task < 'K' group by 1), y as (select model, avg(score) as s from sc where task >= 'K' group by 1) select count(*) as models, {R6.format('case when stddev_pop(x.s) * stddev_pop(y.s) > 0 then corr(x.s, y.s) end')} as r, {R6.format('max(abs(x.s - y.s))')} as widest, coalesce(corr(x.s, y.s) >= 0.9, false) as agree from x join y using (model)")
def cross_formulation_agreement(spark, d):
    """Whether two halves of the classes order the runs alike."""
    half = lambda c, n: _scores(spark, d).where(c).groupBy("model").agg(F.avg("score").alias(n))
    j = half("task < 'K'", "x").join(half("task >= 'K'", "y"), "model")
    r = correlation("x", "y")
    return j.agg(F.count("*").alias("models"), r6(r).alias("r"), r6(F.max(F.abs(F.col("x") - F.col("y")))).alias("widest"), F.coalesce(r >= 0.9, F.lit(False)).alias("agree"))
