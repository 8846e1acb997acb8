"""Resampling and tests over all pairs of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import correlation, hash60, r6
from corpusmill.operators import tails
from corpusmill.operators.graph import connected_components
from corpusmill.operators.resampling import P, POISSON, replicate_sums, signs
from corpusmill.plans.evaluation import PRED, _evaluated, _labels
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6
from corpusmill.plans.scoring import MINED
from corpusmill.plans.statistics import SCORES, _scores, adjust

B = 200
U = f"(((h % {P}) * ((1103515245 * (b + 1) + 12345) % {P - 1} + 1) + (22695477 * (b + 1) + 1) % {P}) % {P} / {P}.0)"
WEIGHT = "case " + " ".join(f"when u < {p} then {i}" for i, p in enumerate(POISSON)) + f" else {len(POISSON)} end"
BS = f"bs as (select unnest(range(1, {B + 1})) as b)"
H = "('0x' || substr(md5({}), 1, 15))::bigint"
#: Documents that two runs both have, with whether each is right and its confidence; every pair of runs.
PAIRS = f"""{PRED}, oo as (select run_name, id, (truth = pred)::int as ok, coalesce(confidence, 0) as conf from ev), pp as (select x.run_name as run_a, y.run_name as run_b, x.id, x.ok as ok_a, y.ok as ok_b, x.conf as conf_a, y.conf as conf_b, {H.format('x.id')} as h from oo x join oo y on x.id = y.id and x.run_name < y.run_name)"""
RUN_PAIR = ["run_a", "run_b"]


def _runs(spark, d) -> DataFrame:
    return _evaluated(spark, d).select("run_name", "id", (F.col("truth") == F.col("pred")).cast("int").alias("ok"), F.coalesce("confidence", F.lit(0.0)).alias("conf"))


def run_pairs(spark, d) -> DataFrame:
    """A row for each document and pair of runs that have it; runs of a document are few, so the pairs are made within its row."""
    g = _runs(spark, d).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("run_name", "ok", "conf"))).alias("x"))
    two = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    j = g.select("id", F.explode(two).alias("p"))
    c = lambda s, f, n: F.col(f"p.{s}.{f}").alias(n)
    return j.select(c("a", "run_name", "run_a"), c("b", "run_name", "run_b"), "id", c("a", "ok", "ok_a"), c("b", "ok", "ok_b"), c("a", "conf", "conf_a"), c("b", "conf", "conf_b"), hash60(F.col("id")).alias("h"))


def interval(df: DataFrame, by: list[str], value: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(value, lo).alias("lo"), F.percentile(value, hi).alias("hi"))


@query(f"""with v as (select id, avg(confidence) as x, {H.format('id')} as h from class_predictions where confidence is not null and id is not null group by id), {BS}, w as (select b, x, {WEIGHT} as k from (select b, x, {U} as u from v cross join bs)), m as (select b, sum(k * x) / sum(k) as m from w group by b), t as (select avg(x) as mean from v)
select {R6.format('mean')} as mean, {R6.format('lo')} as lo, {R6.format('hi')} as hi, {R6.format('2 * mean - hi')} as basic_lo, {R6.format('2 * mean - lo')} as basic_hi from t cross join (select quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m)""")
def bootstrap_mean_ci(spark, d):
    """Percentile and basic intervals of a mean: one pass, with running sums for all replicates in every task."""
    from corpusmill.sources.tables import table

    p = table(spark, d, "class_predictions").where("confidence is not null and id is not null")
    v = p.groupBy("id").agg(F.avg("confidence").alias("x")).select("x", hash60(F.col("id")).alias("h"))
    m = replicate_sums(v, ["x"], replicates=B).select((F.col("s_x") / F.col("w")).alias("m"))
    j = v.agg(F.avg("x").alias("mean")).crossJoin(interval(m, [], "m"))  # rows of one
    return j.select(r6(F.col("mean")).alias("mean"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), r6(2 * F.col("mean") - F.col("hi")).alias("basic_lo"), r6(2 * F.col("mean") - F.col("lo")).alias("basic_hi"))


@query()
def bootstrap_bca_ci(spark, d):
    """Bias-corrected and accelerated interval of the mean; the acceleration of a mean is its skewness over 6 sqrt(n)."""
    from corpusmill.sources.tables import table

    p = table(spark, d, "class_predictions").where("confidence is not null and id is not null")
    v = p.groupBy("id").agg(F.avg("confidence").alias("x")).select("x", hash60(F.col("id")).alias("h"))
    m = replicate_sums(v, ["x"], replicates=B).select((F.col("s_x") / F.col("w")).alias("m"))
    one = v.agg(F.avg("x").alias("mean"), F.skewness("x").alias("skew"), F.count("*").alias("n"))
    j = m.crossJoin(F.broadcast(one)).groupBy("mean", "skew", "n").agg(F.avg((F.col("m") < F.col("mean")).cast("int")).alias("below"), F.sort_array(F.collect_list("m")).alias("ms"))  # 200 replicates

    def end(p: float):
        def f(below, skew, n):
            z0 = tails.NORMAL.inv_cdf(min(max(below, 0.5 / B), 1 - 0.5 / B))
            a = skew / (6 * n**0.5)
            z = z0 + tails.NORMAL.inv_cdf(p)
            return tails.NORMAL.cdf(z0 + z / (1 - a * z))

        return tails.column(f, "below", "skew", "n")

    spot = j.select("mean", "ms", end(0.025).alias("pl"), end(0.975).alias("ph"))
    at = lambda p: F.element_at("ms", (F.floor(F.col(p) * (B - 1)) + 1).cast("int"))
    return spot.select(r6(F.col("mean")).alias("mean"), r6(at("pl")).alias("lo"), r6(at("ph")).alias("hi"))


DRAWS = f"{PAIRS}, {BS}, dr as (select run_a, run_b, b, ok_a, ok_b, conf_a, conf_b, {U} as u from pp cross join bs)"


@query(f"""with {DRAWS}, m as (select run_a, run_b, b, sum(({WEIGHT}) * (ok_a - ok_b)) / sum({WEIGHT}) as m from dr group by 1, 2, 3), o as (select run_a, run_b, avg(ok_a - ok_b) as diff, count(*) as n from pp group by 1, 2),
c as (select run_a, run_b, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi, avg((m <= 0)::int) as below, avg((m >= 0)::int) as above from m group by 1, 2)
select run_a, run_b, n, {R6.format('diff')} as diff, {R6.format('lo')} as lo, {R6.format('hi')} as hi, {R6.format('least(1.0, 2 * case when diff >= 0 then below else above end)')} as p, lo > 0 or hi < 0 as significant from o join c using (run_a, run_b)""")
def paired_bootstrap(spark, d):
    """Difference of accuracy of every pair of runs over the documents both have, with interval and p."""
    pp = run_pairs(spark, d).withColumn("x", F.col("ok_a") - F.col("ok_b"))
    m = replicate_sums(pp, ["x"], RUN_PAIR, B).withColumn("m", F.col("s_x") / F.col("w"))
    c = m.groupBy(*RUN_PAIR).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.avg((F.col("m") <= 0).cast("int")).alias("below"), F.avg((F.col("m") >= 0).cast("int")).alias("above"))
    o = pp.groupBy(*RUN_PAIR).agg(F.avg("x").alias("diff"), F.count("*").alias("n"))
    p = F.least(F.lit(1.0), 2 * F.when(F.col("diff") >= 0, F.col("below")).otherwise(F.col("above")))
    return o.join(c, RUN_PAIR).select(*RUN_PAIR, "n", r6(F.col("diff")).alias("diff"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), r6(p).alias("p"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


@query(f"""with {DRAWS}, m as (select run_a, run_b, b, sum(({WEIGHT}) * conf_a) / sum(({WEIGHT}) * conf_b) as m from dr group by 1, 2, 3) select run_a, run_b, {R6.format('quantile_cont(m, 0.025)')} as lo, {R6.format('quantile_cont(m, 0.975)')} as hi, {R6.format('(select sum(conf_a) / sum(conf_b) from pp where pp.run_a = m.run_a and pp.run_b = m.run_b)')} as ratio from m group by 1, 2""")
def bootstrap_ratio(spark, d):
    """Ratio of mean confidence of every pair of runs, with its interval."""
    pp = run_pairs(spark, d)
    m = replicate_sums(pp, ["conf_a", "conf_b"], RUN_PAIR, B).withColumn("m", F.col("s_conf_a") / F.col("s_conf_b"))
    o = pp.groupBy(*RUN_PAIR).agg((F.sum("conf_a") / F.sum("conf_b")).alias("ratio"))
    return interval(m, RUN_PAIR, "m").join(o, RUN_PAIR).select(*RUN_PAIR, *[r6(F.col(c)).alias(c) for c in ("lo", "hi", "ratio")])


@query(f"""with {PRED}, {BS}, e as (select run_name, (truth = pred)::int as ok, {H.format("run_name || '|' || id")} as h from ev), m as (select run_name, b, sum(k * ok) / sum(k) as m from (select run_name, b, ok, {WEIGHT} as k from (select run_name, b, ok, {U} as u from e cross join bs)) group by 1, 2), c as (select run_name, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi, var_samp(m) as v from m group by 1), o as (select run_name, avg(ok) as accuracy from e group by 1)
select run_name, row_number() over (order by accuracy desc, run_name) as rank, {R6.format('accuracy')} as accuracy, {R6.format('lo')} as lo, {R6.format('hi')} as hi, {R6.format('v')} as variance from o join c using (run_name)""")
def leaderboard_ci(spark, d):
    """Runs by accuracy, with interval and variance by bootstrap."""
    e = _evaluated(spark, d).select("run_name", (F.col("truth") == F.col("pred")).cast("int").alias("ok"), hash60(F.concat_ws("|", "run_name", "id")).alias("h"))
    m = replicate_sums(e, ["ok"], ["run_name"], B).withColumn("m", F.col("s_ok") / F.col("w"))
    c = m.groupBy("run_name").agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.var_samp("m").alias("v"))
    o = e.groupBy("run_name").agg(F.avg("ok").alias("accuracy"))
    rank = F.row_number().over(Window.orderBy(F.desc("accuracy"), "run_name")).cast("long")  # a row for each run
    return o.join(c, "run_name").select("run_name", rank.alias("rank"), r6(F.col("accuracy")).alias("accuracy"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), r6(F.col("v")).alias("variance"))


@query(f"""with {PRED}, {BS}, e as (select truth, pred, {H.format("run_name || '|' || id")} as h from ev), w as (select b, truth, pred, {WEIGHT} as k from (select b, truth, pred, {U} as u from e cross join bs)), c as (select b, truth, pred, sum(k) as k from w group by 1, 2, 3),
f as (select bs.b, label, coalesce(2.0 * tp / nullif(coalesce(s, 0) + coalesce(p, 0), 0), 0) as f1 from bs cross join labels left join (select b, truth as label, sum(k) as s from c group by 1, 2) a on a.b = bs.b and a.label = labels.label left join (select b, pred as label, sum(k) as p from c group by 1, 2) x on x.b = bs.b and x.label = labels.label left join (select b, truth as label, sum(k) as tp from c where truth = pred group by 1, 2) t on t.b = bs.b and t.label = labels.label)
select {R6.format('quantile_cont(m, 0.025)')} as lo, {R6.format('quantile_cont(m, 0.975)')} as hi from (select b, avg(f1) as m from f group by b)""".replace("bs.b, label, coalesce", "bs.b, labels.label, coalesce"))
def bootstrap_macro_f1(spark, d):
    """Interval of macro F1 over the label space: weighted confusion counts of every replicate."""
    e = _evaluated(spark, d).select("truth", "pred", hash60(F.concat_ws("|", "run_name", "id")).alias("h"))
    c = replicate_sums(e, [], ["truth", "pred"], B).select("b", "truth", "pred", F.col("w").alias("k"))
    ends = c.select("b", F.col("truth").alias("label"), "k", F.when(F.col("truth") == F.col("pred"), F.col("k")).otherwise(0).alias("tp")).unionByName(c.select("b", F.col("pred").alias("label"), "k", F.lit(0.0).alias("tp")))
    f = ends.groupBy("b", "label").agg(F.sum("k").alias("m"), F.sum("tp").alias("tp")).join(F.broadcast(_labels(spark, d)), "label", "left_semi")  # a small label space
    n = _labels(spark, d).agg(F.count("*").alias("n"))
    m = f.groupBy("b").agg(F.sum(F.when(F.col("m") > 0, 2 * F.col("tp") / F.col("m")).otherwise(0.0)).alias("s")).crossJoin(F.broadcast(n)).withColumn("m", F.col("s") / F.col("n"))  # one row on the right
    return interval(m, [], "m").select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query(f"""{MINED.replace('as score from mined m', f"as score, {H.format('m.a')} as ha, {H.format('m.b')} as hb from mined m")}, {BS}, w as (select b, y, score, ({WEIGHT.replace('u <', 'ua <')}) * ({WEIGHT.replace('u <', 'ub <')}) as k from (select b, y, score, {U.replace('(h %', '(ha %')} as ua, {U.replace('(h %', '(hb %')} as ub from pr cross join bs)),
g as (select b, score, sum(k * y) as pos, sum(k * (1 - y)) as neg from w group by 1, 2), a as (select b, pos, neg, sum(neg) over (partition by b order by score) - neg as below from g), m as (select b, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as m from a group by b)
select {R6.format('quantile_cont(m, 0.025)')} as lo, {R6.format('quantile_cont(m, 0.975)')} as hi from m""")
def dyadic_bootstrap_auc(spark, d):
    """Interval of the AUC of mined pairs when documents are resampled: a pair weighs the product of its documents' weights."""
    from corpusmill.operators import pairs
    from corpusmill.operators.resampling import poisson_weights, uniforms
    from corpusmill.plans.pairing import QUOTAS, facets

    f = facets(spark, d)
    t = f.select("id", "topics")
    p = pairs.mine_pairs(f, QUOTAS)
    j = p.join(t.select(F.col("id").alias("doc_a"), F.col("topics").alias("ta")), "doc_a").join(t.select(F.col("id").alias("doc_b"), F.col("topics").alias("tb")), "doc_b")
    s = j.select(F.col("label").alias("y"), r6(pairs.jaccard(F.col("ta"), F.col("tb"))).alias("score"), hash60(F.col("doc_a")).alias("ha"), hash60(F.col("doc_b")).alias("hb"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            k = poisson_weights(uniforms(pdf["ha"].to_numpy(), B)) * poisson_weights(uniforms(pdf["hb"].to_numpy(), B))
            for (y, score), rows in pdf.groupby(["y", "score"]).indices.items():
                yield pd.DataFrame({"b": range(1, B + 1), "y": y, "score": score, "k": k[rows].sum(0)})

    g = s.mapInPandas(run, "b long, y int, score double, k double").groupBy("b", "score").agg(F.sum(F.col("k") * F.col("y")).alias("pos"), F.sum(F.col("k") * (1 - F.col("y"))).alias("neg"))
    w = Window.partitionBy("b").orderBy("score")  # a row for each distinct score
    a = g.withColumn("below", F.sum("neg").over(w) - F.col("neg")).groupBy("b").agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("m"))
    return interval(a, [], "m").select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


PERMUTE = f"""{DRAWS}, m as (select run_a, run_b, b, sum(case when u < 0.5 then ok_a - ok_b else ok_b - ok_a end) / count(*) as m from dr group by 1, 2, 3), o as (select run_a, run_b, avg(ok_a - ok_b) as diff, count(*) as n from pp group by 1, 2),
pv as (select o.run_a, o.run_b, max(n) as n, max(diff) as diff, (sum((abs(m) >= abs(diff) - 1e-12)::int) + 1) / {B + 1}.0 as p from o join m on o.run_a = m.run_a and o.run_b = m.run_b group by 1, 2)"""


def _permuted(spark, d) -> DataFrame:
    pp = run_pairs(spark, d).withColumn("x", F.col("ok_a") - F.col("ok_b"))
    m = replicate_sums(pp, ["x"], RUN_PAIR, B, signs)
    o = pp.groupBy(*RUN_PAIR).agg(F.avg("x").alias("diff"), F.count("*").alias("n"))
    j = m.join(o, RUN_PAIR).withColumn("hit", (F.abs(F.col("s_x") / F.col("n")) >= F.abs("diff") - 1e-12).cast("int"))
    return j.groupBy(*RUN_PAIR).agg(F.max("n").alias("n"), F.max("diff").alias("diff"), ((F.sum("hit") + 1) / float(B + 1)).alias("p"))


@query(f"with {PERMUTE} select run_a, run_b, n, {R6.format('diff')} as diff, {R6.format('p')} as p from pv")
def permutation_test(spark, d):
    """Sign-flip test of the difference of accuracy of every pair of runs."""
    return _permuted(spark, d).select(*RUN_PAIR, "n", r6(F.col("diff")).alias("diff"), r6(F.col("p")).alias("p"))


@query(f"""with {PERMUTE}, r as (select run_a || '|' || run_b as name, {R6.format('p')} as p from pv), i as (select *, row_number() over (order by p, name) as i, count(*) over () as m from r), h as (select *, (select sum(1.0 / x) from range(1, m + 1) t(x)) as c from i)
select name, p, {R6.format('least(1.0, max(p * (m - i + 1)) over (order by i))')} as holm, {R6.format('least(1.0, min(p * m / i) over (order by i desc))')} as bh, {R6.format('least(1.0, min(p * m * c / i) over (order by i desc))')} as by_, {R6.format('least(1.0, p * m)')} as bonferroni from h""")
def multiple_tests(spark, d):
    """Corrections of the permutation tests of all pairs of runs: Holm, Benjamini-Hochberg, Benjamini-Yekutieli and Bonferroni."""
    p = _permuted(spark, d).select(F.concat_ws("|", *RUN_PAIR).alias("name"), r6(F.col("p")).alias("p"))
    return p.join(adjust(p), "name")


@query(f"""with {PERMUTE}, recursive_seed as (select distinct run_name as r from class_predictions), same as (select run_a as x, run_b as y from pv where p >= 0.05 union select run_b, run_a from pv where p >= 0.05 union select r, r from recursive_seed),
s2 as (select distinct a.x, b.y from same a join same b on a.y = b.x), s4 as (select distinct a.x, b.y from s2 a join s2 b on a.y = b.x) select x as run_name, min(y) as equivalence_group from s4 group by x""")
def equivalence_groups(spark, d):
    """Runs linked by differences that are not significant, as connected components."""
    p = _permuted(spark, d)
    names = _runs(spark, d).select("run_name").distinct()
    key = lambda c: F.xxhash64(c)
    edges = p.where("p >= 0.05").select(key("run_a").alias("u"), key("run_b").alias("v")).unionByName(names.select(key("run_name").alias("u"), key("run_name").alias("v")))
    comp = connected_components(edges).join(names.select(key("run_name").alias("node"), "run_name"), "node")
    first = comp.groupBy("component").agg(F.min("run_name").alias("equivalence_group"))
    return comp.join(first, "component").select("run_name", "equivalence_group")


@query(f"""with {PAIRS}, s as (select run_a, run_b, conf_a - conf_b as d from pp where conf_a <> conf_b), r as (select *, rank() over (partition by run_a, run_b order by floor(abs(d) * 1e6 + 0.5)) + (count(*) over (partition by run_a, run_b, floor(abs(d) * 1e6 + 0.5)) - 1) / 2.0 as r from s),
w as (select run_a, run_b, count(*) as n, coalesce(sum(r) filter (where d > 0), 0) as wp, coalesce(sum(r) filter (where d < 0), 0) as wm from r group by 1, 2) select run_a, run_b, n, case when n >= 10 then least(wp, wm) end as statistic, {R6.format('case when n >= 10 then (least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0) end')} as z from w""")
def wilcoxon_statistic(spark, d):
    """Signed-rank statistic of the confidences of every pair of runs; ranks come from counts by distinct difference. Fewer than ten differences give none."""
    s = run_pairs(spark, d).select(*RUN_PAIR, (F.col("conf_a") - F.col("conf_b")).alias("d")).where("d <> 0").withColumn("k", F.floor(F.abs("d") * 1e6 + 0.5))
    c = s.groupBy(*RUN_PAIR, "k").agg(F.count("*").alias("m"), F.count_if(F.col("d") > 0).alias("up"))
    w = Window.partitionBy(*RUN_PAIR).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # distinct differences
    r = c.withColumn("r", F.coalesce(F.sum("m").over(w), F.lit(0)) + (F.col("m") + 1) / 2.0)
    g = r.groupBy(*RUN_PAIR).agg(F.sum("m").alias("n"), F.sum(F.col("r") * F.col("up")).alias("wp"), F.sum(F.col("r") * (F.col("m") - F.col("up"))).alias("wm"))
    n, st = F.col("n").cast("double"), F.least("wp", "wm")
    z = (st - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return g.select(*RUN_PAIR, "n", F.when(n >= 10, st).alias("statistic"), r6(F.when(n >= 10, z)).alias("z"))


@query(f"""with {PAIRS}, s as (select run_a, run_b, count(*) as n, avg(conf_a - conf_b) as m, stddev_samp(conf_a - conf_b) as sd from pp group by 1, 2) select run_a, run_b, n, {R6.format('m')} as mean_difference, {R6.format('m / sd')} as cohen_d, case when abs(m / sd) < 0.2 then 'negligible' when abs(m / sd) < 0.5 then 'small' when abs(m / sd) < 0.8 then 'medium' else 'large' end as effect, {R6.format('m / (sd / sqrt(n))')} as t from s""")
def paired_effects(spark, d):
    """Paired effect size and t of the confidences of every pair of runs."""
    s = run_pairs(spark, d).withColumn("x", F.col("conf_a") - F.col("conf_b")).groupBy(*RUN_PAIR).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    e = F.abs(F.col("m") / F.col("sd"))
    size = F.when(e < 0.2, "negligible").when(e < 0.5, "small").when(e < 0.8, "medium").otherwise("large")
    return s.select(*RUN_PAIR, "n", r6(F.col("m")).alias("mean_difference"), r6(F.col("m") / F.col("sd")).alias("cohen_d"), size.alias("effect"), r6(F.col("m") / (F.col("sd") / F.sqrt("n"))).alias("t"))


@query(f"""with {PAIRS}, c as (select run_a, run_b, sum((ok_a = 1 and ok_b = 0)::int) as b, sum((ok_a = 0 and ok_b = 1)::int) as c from pp group by 1, 2) select run_a, run_b, b::bigint as b, c::bigint as c, {R6.format('case when b + c > 0 then (abs(b - c) - 1) * (abs(b - c) - 1) / (b + c) end')} as statistic, {R6.format('ln((b + 0.5) / (c + 0.5))')} as log_odds from c""")
def mcnemar_pairs(spark, d):
    """Discordant documents of every pair of runs, with continuity correction and log odds ratio."""
    c = run_pairs(spark, d).groupBy(*RUN_PAIR).agg(F.count_if((F.col("ok_a") == 1) & (F.col("ok_b") == 0)).alias("b"), F.count_if((F.col("ok_a") == 0) & (F.col("ok_b") == 1)).alias("c"))
    x = F.abs(F.col("b") - F.col("c")) - 1
    return c.select(*RUN_PAIR, "b", "c", r6(F.try_divide(x.cast("double") * x, F.col("b") + F.col("c"))).alias("statistic"), r6(F.ln((F.col("b") + 0.5) / (F.col("c") + 0.5))).alias("log_odds"))


@query()
def test_p_values(spark, d):
    """p of the tests of every pair of runs: t with its interval, McNemar, Wilcoxon; exact distributions, on one row for each pair."""
    t, m, w = paired_effects(spark, d), mcnemar_pairs(spark, d), wilcoxon_statistic(spark, d)
    j = t.join(m.select(*RUN_PAIR, F.col("statistic").alias("x2")), RUN_PAIR).join(w.select(*RUN_PAIR, "z"), RUN_PAIR, "left").withColumn("df", F.col("n") - 1)
    q = tails.column(lambda df: tails.t_quantile(0.975, df), "df")
    half = q * F.abs(F.col("mean_difference") / F.nullif(F.col("t"), F.lit(0.0)))
    return j.select(*RUN_PAIR, tails.column(tails.t_two_sided, "t", "df").alias("p_t"), (F.col("mean_difference") - half).alias("lo"), (F.col("mean_difference") + half).alias("hi"), tails.column(lambda x: tails.chi2_tail(x, 1), "x2").alias("p_mcnemar"), tails.column(tails.z_two_sided, "z").alias("p_wilcoxon"))


RANKED = f"""{SCORES}, kt as (select count(distinct task) as n, count(distinct model) as k from sc), full_tasks as (select task from sc group by task having count(*) = (select k from kt)), rk as (select model, task, rank() over (partition by task order by score desc) + (count(*) over (partition by task, score) - 1) / 2.0 as r, score from sc where task in (select task from full_tasks))"""


def _ranked(spark, d) -> DataFrame:
    """Average ranks of models within the tasks that all of them have, the best first."""
    s = _scores(spark, d)
    k = s.agg(F.countDistinct("model").alias("k"))
    whole = s.groupBy("task").agg(F.count("*").alias("m")).crossJoin(F.broadcast(k)).where("m = k").select("task")  # one row on the right
    r = F.rank().over(Window.partitionBy("task").orderBy(F.desc("score"))) + (F.count("*").over(Window.partitionBy("task", "score")) - 1) / 2.0
    return s.join(whole, "task", "left_semi").withColumn("r", r)


@query(f"""with {RANKED}, m as (select model, sum(r) as s from rk group by 1), n as (select count(distinct task) as n, count(distinct model) as k from rk), ti as (select sum(c * c * c - c) as t from (select count(*)::double as c from rk group by task, score))
select {R6.format('(12.0 / (n * k * (k + 1.0)) * sum(s * s) - 3.0 * n * (k + 1)) / (1 - max(t) / (n * (k * k * k - k)::double))')} as chi2, k as groups, n as blocks from m cross join n cross join ti group by n, k""")
def friedman_statistic(spark, d):
    """Friedman's chi-square over the tasks that all runs have, corrected for ties."""
    r = _ranked(spark, d)
    m = r.groupBy("model").agg(F.sum("r").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.count("*").alias("k"))
    t = r.groupBy("task", "score").agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    n = r.agg(F.countDistinct("task").alias("n"))
    x = m.crossJoin(t).crossJoin(n)  # rows of one
    k, nn = F.col("k").cast("double"), F.col("n").cast("double")
    stat = (12.0 / (nn * k * (k + 1)) * F.col("q") - 3.0 * nn * (k + 1)) / (1 - F.col("t") / (nn * (k * k * k - k)))
    return x.select(r6(stat).alias("chi2"), F.col("k").alias("groups"), F.col("n").alias("blocks"))


@query()
def nemenyi_pairs(spark, d):
    """Friedman's p, and for every pair of runs the difference of mean ranks, its p by the studentised range and the critical difference (the range without the root of two, as the survey records)."""
    r = _ranked(spark, d).groupBy("model").agg(F.avg("r").alias("rank"))
    f = friedman_statistic(spark, d)
    j = r.alias("a").join(r.alias("b"), F.col("a.model") < F.col("b.model")).crossJoin(F.broadcast(f))  # a row for each pair of runs
    diff = F.abs(F.col("a.rank") - F.col("b.rank"))
    unit = F.sqrt(F.col("groups") * (F.col("groups") + 1) / (6.0 * F.col("blocks")))
    out = j.select(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), diff.alias("difference"), unit.alias("unit"), "chi2", "groups")
    return out.select("model_a", "model_b", "difference", tails.column(lambda x, g: tails.chi2_tail(x, g - 1), "chi2", "groups").alias("p_friedman"), tails.column(lambda x, u, g: tails.range_tail(x / u * 2**0.5, int(g)), "difference", "unit", "groups").alias("p"), tails.column(lambda u, g: tails.range_quantile(0.95, int(g)) * u, "unit", "groups").alias("critical_difference"))


@query(f"""with {SCORES}, j as (select a.task as ta, b.task as tb, corr(a.score, b.score) as r, stddev_pop(a.score) * stddev_pop(b.score) as v, count(*) as n from sc a join sc b on a.model = b.model group by 1, 2 having count(*) >= 3), s as (select sum(case when v > 0 then r * r else 0 end) as q, count(distinct ta) as n from j where v > 0)
select n as tasks, {R6.format('n * n / q')} as effective_tests from s""")
def effective_tests(spark, d):
    """Effective number of tests: n squared over the sum of squared correlations, which is what the eigenvalues give, without computing them. Tasks without variance are left out."""
    s = _scores(spark, d)
    j = s.alias("a").join(s.alias("b"), "model").groupBy(F.col("a.task").alias("ta"), F.col("b.task").alias("tb")).agg(correlation("a.score", "b.score").alias("r"), F.count("*").alias("n")).where("n >= 3 and r is not null")
    return j.agg(F.countDistinct("ta").alias("tasks"), F.sum(F.col("r") * F.col("r")).alias("q")).select("tasks", r6(F.col("tasks") * F.col("tasks") / F.col("q")).alias("effective_tests"))


@query(f"""with {SCORES}, p as (select a.model as ma, b.model as mb, a.task, sign(a.score - b.score) as s from sc a join sc b on a.task = b.task and a.model < b.model), j as (select x.task as ta, y.task as tb, sum(x.s * y.s) as c, sum(abs(x.s)) as nx, sum(abs(y.s)) as ny from p x join p y on x.ma = y.ma and x.mb = y.mb and x.task < y.task group by 1, 2)
select ta as task_a, tb as task_b, {R6.format('case when nx * ny > 0 then c / sqrt(nx * ny) end')} as tau_b from j""")
def kendall(spark, d):
    """Kendall's tau-b of every pair of tasks over the models, from the signs of pairs of models, which are few."""
    s = _scores(spark, d)
    p = s.alias("a").join(s.alias("b"), (F.col("a.task") == F.col("b.task")) & (F.col("a.model") < F.col("b.model"))).select(F.col("a.task").alias("task"), F.col("a.model").alias("ma"), F.col("b.model").alias("mb"), F.signum(F.col("a.score") - F.col("b.score")).alias("s"))
    j = p.alias("x").join(p.alias("y"), (F.col("x.ma") == F.col("y.ma")) & (F.col("x.mb") == F.col("y.mb")) & (F.col("x.task") < F.col("y.task")))
    g = j.groupBy(F.col("x.task").alias("task_a"), F.col("y.task").alias("task_b")).agg(F.sum(F.col("x.s") * F.col("y.s")).alias("c"), F.sum(F.abs("x.s")).alias("nx"), F.sum(F.abs("y.s")).alias("ny"))
    return g.select("task_a", "task_b", r6(F.try_divide(F.col("c"), F.sqrt(F.col("nx") * F.col("ny")))).alias("tau_b"))


STABLE = f"""{RANKED}, tr as (select model, task, rank() over (partition by model order by score) + (count(*) over (partition by model, score) - 1) / 2.0 as r from rk), j as (select a.model as ma, b.model as mb, corr(a.r, b.r) as rho from tr a join tr b on a.task = b.task and a.model < b.model group by 1, 2)"""


@query(f"with {STABLE} select count(*) as pairs, {R6.format('median(rho)')} as median_rho, {R6.format('min(rho)')} as least_rho, median(rho) >= 0.9 as is_stable from j")
def rank_stability(spark, d):
    """Agreement of runs, taken as repetitions, on the order of the tasks: the median of all pairs against a floor of 0.9."""
    r = _ranked(spark, d)
    t = F.rank().over(Window.partitionBy("model").orderBy("score")) + (F.count("*").over(Window.partitionBy("model", "score")) - 1) / 2.0
    t = r.select("model", "task", t.alias("t"))
    j = t.alias("a").join(t.alias("b"), (F.col("a.task") == F.col("b.task")) & (F.col("a.model") < F.col("b.model"))).groupBy(F.col("a.model").alias("ma"), F.col("b.model").alias("mb")).agg(correlation("a.t", "b.t").alias("rho"))
    return j.agg(F.count("*").alias("pairs"), F.percentile("rho", 0.5).alias("m"), F.min("rho").alias("least")).select("pairs", r6(F.col("m")).alias("median_rho"), r6(F.col("least")).alias("least_rho"), (F.col("m") >= 0.9).alias("is_stable"))


@query(f"""with {SCORES}, js as (select model, avg(score) as s from sc group by 1), bs as (select unnest(range(1, 101)) as b), jt as (select b, model, s + 0.02 * ({U.replace('(h %', f"({H.format('model')} %")} - 0.5) as x from js cross join bs), o as (select model, row_number() over (order by s desc, model) as r0 from js), r as (select b, model, row_number() over (partition by b order by x desc, model) as r from jt)
select model, r0 as rank, min(r) as best, max(r) as worst, {R6.format('avg((r = r0)::int)')} as kept from r join o using (model) group by 1, 2""")
def jitter_sensitivity(spark, d):
    """How often a run keeps its rank when all mean scores are shaken by up to a hundredth, in a hundred replicates."""
    s = _scores(spark, d).groupBy("model").agg(F.avg("score").alias("s"))
    b = F.col("b")
    u = (F.pmod(hash60(F.col("model")), F.lit(P)) * ((F.lit(1103515245) * (b + 1) + 12345) % (P - 1) + 1) + (F.lit(22695477) * (b + 1) + 1) % P) % P / F.lit(float(P))
    j = s.withColumn("r0", F.row_number().over(Window.orderBy(F.desc("s"), "model")).cast("long")).withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(100).cast("long")))).withColumn("x", F.col("s") + 0.02 * (u - 0.5))  # a row for each run
    r = j.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("x"), "model")).cast("long"))
    return r.groupBy("model", F.col("r0").alias("rank")).agg(F.min("r").alias("best"), F.max("r").alias("worst"), r6(F.avg((F.col("r") == F.col("r0")).cast("int"))).alias("kept"))
