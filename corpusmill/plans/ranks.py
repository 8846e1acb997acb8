"""Rank statistics, multilabel metrics, masking and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import correlation, facet_set, hash60, r6, tokens
from corpusmill.plans.assembly import H60
from corpusmill.plans.evaluation import SETS
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6, TOK
from corpusmill.plans.statistics import SCORES, _scores
from corpusmill.sources.tables import table


def average_ranks(df, by: list[str], value: str):
    """df with `r`: the rank of value within by, ties at their average."""
    w = Window.partitionBy(*by).orderBy(value)
    return df.withColumn("r", F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0)


@query(f"""with {SCORES}, j as (select a.task as ta, b.task as tb, a.model, a.score as x, b.score as y from sc a join sc b on a.model = b.model and a.task < b.task),
r as (select ta, tb, rank() over (partition by ta, tb order by x) + (count(*) over (partition by ta, tb, x) - 1) / 2.0 as rx, rank() over (partition by ta, tb order by y) + (count(*) over (partition by ta, tb, y) - 1) / 2.0 as ry from j)
select ta as task_a, tb as task_b, {R6.format('case when stddev_pop(rx) * stddev_pop(ry) > 0 then corr(rx, ry) end')} as spearman from r group by 1, 2""")
def spearman(spark, d):
    s = _scores(spark, d)
    j = s.alias("a").join(s.alias("b"), (F.col("a.model") == F.col("b.model")) & (F.col("a.task") < F.col("b.task"))).select(F.col("a.task").alias("task_a"), F.col("b.task").alias("task_b"), F.col("a.score").alias("x"), F.col("b.score").alias("y"))
    r = average_ranks(average_ranks(j, ["task_a", "task_b"], "x").withColumnRenamed("r", "rx"), ["task_a", "task_b"], "y")
    return r.groupBy("task_a", "task_b").agg(r6(correlation("rx", "r")).alias("spearman"))


@query(f"""with v as (select source as g, n_chars as x from documents where source is not null and n_chars is not null), r as (select g, x, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as r from v),
s as (select g, sum(r) as sr, count(*) as m from r group by g), n as (select count(*) as n from v), t as (select sum(c * c * c - c) as t from (select count(*)::double as c from v group by x))
select {R6.format('(12.0 / (n * (n + 1.0)) * sum(sr * sr / m) - 3 * (n + 1.0)) / (1 - t / (n * n * n * 1.0 - n))')} as statistic, count(*) as groups from s cross join n cross join t group by n, t""")
def kruskal_statistic(spark, d):
    """Ranks come from counts by distinct value, so no global sort of rows is needed."""
    v = table(spark, d, "documents").where("source is not null and n_chars is not null").select(F.col("source").alias("g"), F.col("n_chars").alias("x"))
    c = v.groupBy("x").agg(F.count("*").cast("double").alias("c"))
    below = F.coalesce(F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranks = c.select("x", (below + (F.col("c") + 1) / 2).alias("r"))
    s = v.groupBy("g", "x").agg(F.count("*").alias("k")).join(ranks, "x").groupBy("g").agg(F.sum(F.col("r") * F.col("k")).alias("sr"), F.sum("k").alias("m"))
    t = c.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    h = s.agg(F.sum(F.col("sr") * F.col("sr") / F.col("m")).alias("q"), F.count("*").alias("groups")).crossJoin(t)  # rows of one
    n = F.col("n")
    return h.select(r6((12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))).alias("statistic"), "groups")


@query(f"""with a as (select rec_no, id, {SETS.format('topics')} as ts from shelf_features), p as (select id, min(rec_no) as lo, max(rec_no) as hi from shelf_features where id is not null group by id having count(*) > 1),
j as (select x.ts as t, y.ts as u from p join a x on x.rec_no = p.lo join a y on y.rec_no = p.hi)
select count(*) as n, {R6.format("avg(case when t = u then 1.0 else 0.0 end)")} as subset_accuracy, {R6.format("2.0 * sum(len(list_intersect(t, u))) / sum(len(t) + len(u))")} as micro_f1,
 {R6.format("avg(case when len(t) + len(u) = 0 then 0.0 else len(list_intersect(t, u)) * 1.0 / len(list_distinct(list_concat(t, u))) end)")} as jaccard from j""")
def multilabel_metrics(spark, d):
    """Topics of the last delivery of a record against the first."""
    s = table(spark, d, "shelf_features").where("id is not null")
    ts = F.array_sort(facet_set(F.col("topics")))
    g = s.groupBy("id").agg(F.min_by(ts, "rec_no").alias("t"), F.max_by(ts, "rec_no").alias("u"), F.count("*").alias("n")).where("n > 1")
    both, any_ = F.size(F.array_intersect("t", "u")), F.size(F.array_union("t", "u"))
    return g.agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("t") == F.col("u"), 1.0).otherwise(0.0))).alias("subset_accuracy"), r6(2.0 * F.sum(both) / F.sum(F.size("t") + F.size("u"))).alias("micro_f1"), r6(F.avg(F.when(any_ == 0, 0.0).otherwise(both / any_))).alias("jaccard"))


@query(f"""with t as (select doc_id, list_filter({TOK.replace('{}', 'text')}, lambda w: len(w) > 0) as ts, {TOK.replace('{}', 'lcgft_form')} as label from documents), m as (select doc_id, len(ts) as n, len(list_filter(ts, lambda w: list_contains(label, w) or list_contains(label, w || 's') or list_contains(list_transform(label, lambda x: x || 's'), w))) as k from t)
select doc_id, k::bigint as removed, (n - k)::bigint as kept from m""")
def mask_terms(spark, d):
    """Tokens of a document that name its own form, with a plural s or without, and what is left without them."""
    t = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("ts"), tokens(F.col("lcgft_form")).alias("label"))
    label = t.withColumn("names", F.array_distinct(F.concat("label", F.transform("label", lambda x: F.concat(x, F.lit("s"))), F.transform("label", lambda x: F.regexp_replace(x, "s$", "")))))
    k = F.size(F.filter("ts", lambda w: F.array_contains("names", w)))
    return label.select("doc_id", k.cast("long").alias("removed"), (F.size("ts") - k).cast("long").alias("kept"))


@query(f"""with t as (select doc_id, {TOK.replace('{}', 'text')} as ts from documents), e as (select doc_id, unnest(ts) as term, generate_subscripts(ts, 1) as pos from t), r as (select doc_id, term, row_number() over (partition by doc_id order by {H60.format("doc_id || '|' || pos")}, pos) as r from e)
select doc_id, count(*) as kept, bit_xor({H60.format('term')})::bigint as checksum from r where r > 9 group by doc_id""")
def sham_drop(spark, d):
    """Nine tokens of each document dropped in hash order, the control for masking."""
    e = table(spark, d, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("p", "term")).withColumn("pos", F.col("p") + 1)
    r = e.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(hash60(F.concat_ws("|", "doc_id", "pos")), "pos"))).where("r > 9")
    return r.groupBy("doc_id").agg(F.count("*").alias("kept"), F.bit_xor(hash60(F.col("term"))).alias("checksum"))


@query("select 'predicted only' as side, count(*) as n from (select distinct id from class_predictions where id is not null except select distinct id from shelf_features) union all select 'corpus only', count(*) from (select distinct id from shelf_features where id is not null except select distinct id from class_predictions) union all select 'both', count(*) from (select id from class_predictions intersect select id from shelf_features)")
def id_set_ops(spark, d):
    """One full outer join of the distinct ids instead of three set operations."""
    p = table(spark, d, "class_predictions").where("id is not null").select("id").distinct().withColumn("p", F.lit(True))
    s = table(spark, d, "shelf_features").where("id is not null").select("id").distinct().withColumn("s", F.lit(True))
    side = F.when(F.col("s").isNull(), "predicted only").when(F.col("p").isNull(), "corpus only").otherwise("both")
    return p.join(s, "id", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query("select origin, count(*) as n, count(lang) as with_lang, count(model) as with_model from (select 'documents' as origin, lang, null as model from documents union all select 'records', null, model from shelf_features) group by origin")
def union_by_name(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("origin"), "lang")
    b = table(spark, d, "shelf_features").select(F.lit("records").alias("origin"), "model")
    return a.unionByName(b, allowMissingColumns=True).groupBy("origin").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count("model").alias("with_model"))


@query(f"""with p as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n+'), lambda x: trim(x)), lambda x: length(x) >= 10)) as para from documents)
select doc_id, count(*) as paragraphs, max(length(para)) as longest from p group by doc_id""")
def paragraphs(spark, d):
    p = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 10)
    e = table(spark, d, "documents").select("doc_id", F.explode(p).alias("para"))
    return e.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("para")).cast("long").alias("longest"))


@query(f"""with f as (select doc_id, lang, lcc_code, coalesce(lcc_code, '') || '|' || coalesce(lcgft_form, '') as stratum from documents), c as (select stratum, count(*) as n from f group by 1)
select case when n < 10 then coalesce(lcc_code, '') || '|_combined' else stratum end as stratum, count(*) as n from f join c using (stratum) group by 1""")
def combined_strata(spark, d):
    """Strata of fewer than ten rows are combined by their first facet."""
    f = table(spark, d, "documents").select(F.coalesce("lcc_code", F.lit("")).alias("first"), F.concat_ws("|", F.coalesce("lcc_code", F.lit("")), F.coalesce("lcgft_form", F.lit(""))).alias("stratum"))
    c = f.groupBy("first", "stratum").agg(F.count("*").alias("n"))
    return c.groupBy(F.when(F.col("n") < 10, F.concat("first", F.lit("|_combined"))).otherwise(F.col("stratum")).alias("stratum")).agg(F.sum("n").alias("n"))
