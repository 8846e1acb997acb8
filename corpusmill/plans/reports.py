"""Distributions, co-occurrence, ledger and price reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import length_bucket, r6, word_count
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6
from corpusmill.sources.tables import table

WORDS = r"len(list_filter(regexp_split_to_array(coalesce({}, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))"


@query(f"select lang, count(*) as n, sum({WORDS.format('text')})::bigint as words, max(length(text)) as longest from documents group by lang")
def doc_text_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(word_count(F.col("text"))).alias("words"), F.max(F.length("text")).cast("long").alias("longest"))


@query("select case when length(text) < 500 then 'short' when length(text) < 2000 then 'medium' else 'long' end as bucket, count(*) as n from documents where trim(text) <> '' group by 1")
def length_buckets(spark, d):
    return table(spark, d, "documents").where("trim(text) <> ''").groupBy(length_bucket(F.length("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"select lang, {R6.format('quantile_cont(n_chars, 0.25)')} as p25, {R6.format('quantile_cont(n_chars, 0.5)')} as p50, {R6.format('quantile_cont(n_chars, 0.9)')} as p90, {R6.format('avg(n_chars)')} as mean, {R6.format('stddev_pop(n_chars)')} as sd from documents group by lang")
def length_quantiles(spark, d):
    q = lambda p, n: r6(F.percentile("n_chars", p)).alias(n)
    return table(spark, d, "documents").groupBy("lang").agg(q(0.25, "p25"), q(0.5, "p50"), q(0.9, "p90"), r6(F.avg("n_chars")).alias("mean"), r6(F.stddev_pop("n_chars")).alias("sd"))


@query("select lang, source, grouping(lang) as g_lang, grouping(source) as g_source, count(*) as n from documents group by grouping sets ((lang), (source), (lang, source), ())")
def lang_source_grouping_sets(spark, d):
    docs = table(spark, d, "documents").select("lang", "source")
    return spark.sql("select lang, source, cast(grouping(lang) as bigint) as g_lang, cast(grouping(source) as bigint) as g_source, count(*) as n from {docs} group by grouping sets ((lang), (source), (lang, source), ())", docs=docs)


@query(f"with c as (select source, coalesce(lang, '(none)') as lang, count(*) as n from documents group by 1, 2), s as (select *, n / sum(n) over (partition by source) as p from c) select source, {R6.format('-sum(p * ln(p))')} as entropy, count(*) as support from s group by source")
def source_entropy(spark, d):
    c = table(spark, d, "documents").groupBy("source", F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(F.count("*").alias("n"))
    s = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    return s.groupBy("source").agg(r6(-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), F.count("*").alias("support"))


@query(f"""with a as (select coalesce(upper(trim(lcc_code)), '(none)') as v, count(*) as n from shelf_features where split = 'train' group by 1), b as (select coalesce(upper(trim(lcc_code)), '(none)') as v, count(*) as n from shelf_features where split = 'test' group by 1),
j as (select coalesce(a.n, 0) / (select sum(n) from a) as p, coalesce(b.n, 0) / (select sum(n) from b) as q from a full join b using (v)) select {R6.format('sum(abs(p - q)) / 2')} as tvd, {R6.format('max(abs(p - q))')} as max_divergence, count(*) as categories from j""")
def split_divergence(spark, d):
    v = F.coalesce(F.upper(F.trim("lcc_code")), F.lit("(none)")).alias("v")
    c = table(spark, d, "shelf_features").where("split in ('train', 'test')").groupBy(v).agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    t = c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    diff = F.abs(F.col("a") / F.col("ta") - F.col("b") / F.col("tb"))
    return c.crossJoin(F.broadcast(t)).agg(r6(F.sum(diff) / 2).alias("tvd"), r6(F.max(diff)).alias("max_divergence"), F.count("*").alias("categories"))  # one row on the right


@query(f"""with c as (select lang, source, count(*) as n from documents where lang is not null group by 1, 2), r as (select lang, sum(n) as nr from c group by 1), k as (select source, sum(n) as nc from c group by 1), t as (select sum(n) as total from c),
x as (select coalesce(c.n, 0) as o, nr * nc / total as e from r cross join k cross join t left join c on c.lang = r.lang and c.source = k.source)
select {R6.format('sum((o - e) * (o - e) / e)')} as chi2, {R6.format('sqrt(sum((o - e) * (o - e) / e) / ((select total from t) * least((select count(*) from r) - 1, (select count(*) from k) - 1)))')} as cramers_v from x""")
def cramers_v(spark, d):
    """Over the dense table of the two facets' values, which are few."""
    c = table(spark, d, "documents").where("lang is not null").groupBy("lang", "source").agg(F.count("*").alias("n"))
    r, k, t = c.groupBy("lang").agg(F.sum("n").alias("nr")), c.groupBy("source").agg(F.sum("n").alias("nc")), c.agg(F.sum("n").alias("total"))
    x = r.crossJoin(k).crossJoin(t).join(c, ["lang", "source"], "left").withColumn("e", F.col("nr") * F.col("nc") / F.col("total")).withColumn("o", F.coalesce("n", F.lit(0)))
    a = x.agg(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("chi2"), F.max("total").alias("t"), F.countDistinct("lang").alias("nl"), F.countDistinct("source").alias("ns"))
    return a.select(r6(F.col("chi2")).alias("chi2"), r6(F.sqrt(F.col("chi2") / (F.col("t") * F.least(F.col("nl") - 1, F.col("ns") - 1)))).alias("cramers_v"))


@query(f"""with l as (select *, row_number() over (partition by request_id order by received_at) as r from cost_ledger)
select model, run_id, grouping(model) as g_model, grouping(run_id) as g_run, count(*) as requests, {R6.format('sum(coalesce(cost_usd, 0))')} as cost from l where r = 1 group by rollup (model, run_id)""")
def spend_rollup(spark, d):
    """Spend by model and run over distinct requests (the first received of each)."""
    l = table(spark, d, "cost_ledger")  # noqa: E741
    first = l.withColumn("r", F.row_number().over(Window.partitionBy("request_id").orderBy("received_at"))).where("r = 1")
    return spark.sql("select model, run_id, cast(grouping(model) as bigint) as g_model, cast(grouping(run_id) as bigint) as g_run, count(*) as requests, floor(sum(coalesce(cost_usd, 0)) * 1e6 + 0.5) / 1e6 as cost from {first} group by rollup (model, run_id)", first=first)


@query("select date_trunc('day', received_at) as day, count(*) as n, sum(case when lower(status) = 'ok' then 1 else 0 end)::bigint as ok from cost_ledger group by 1")
def ledger_daily(spark, d):
    return table(spark, d, "cost_ledger").groupBy(F.date_trunc("day", "received_at").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.lower("status") == "ok").alias("ok"))


@query("""with t(lo, price) as (values (0, 1.0), (500, 0.8), (1000, 0.6), (2000, 0.5)), j as (select request_id, input_tokens, max(lo) as tier from cost_ledger join t on lo <= input_tokens group by all)
select tier::bigint as tier, count(*) as requests from j group by 1""")
def price_tier_asof(spark, d):
    """As-of lookup in a short table of tiers: the tier of highest threshold not above the prompt's size."""
    tiers = F.array(*[F.lit(x) for x in (0, 500, 1000, 2000)])
    l = table(spark, d, "cost_ledger").where("input_tokens >= 0").select("request_id", "input_tokens").distinct()  # noqa: E741
    return l.groupBy(F.array_max(F.filter(tiers, lambda x: x <= F.col("input_tokens"))).cast("long").alias("tier")).agg(F.count("*").alias("requests"))


@query("select trim(lcgft_form) as form, count(*) as frequency, row_number() over (order by count(*) desc, trim(lcgft_form)) as rank from shelf_features where trim(lcgft_form) <> '' group by 1 order by rank limit 20")
def taxonomy_top_n(spark, d):
    f = table(spark, d, "shelf_features").where("trim(lcgft_form) <> ''").groupBy(F.trim("lcgft_form").alias("form")).agg(F.count("*").alias("frequency"))
    top = f.orderBy(F.desc("frequency"), "form").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("frequency"), "form")).cast("long"))


@query("""with g as (select rec_no, unnest(geographic) as x, generate_subscripts(geographic, 1) as pos from shelf_features), m as (select rec_no, arg_min(region_name, pos) as region, count(distinct region_name) as regions from g join place_regions p on lower(p.place) = lower(trim(x)) group by rec_no)
select region, count(*) as n, sum(case when regions = 1 then 1 else 0 end)::bigint as unambiguous from m group by region""")
def geographic_regions(spark, d):
    """The first region of each row and the rows of one region only; the places are a fixed table of dozens."""
    places = F.broadcast(table(spark, d, "place_regions").select(F.lower("place").alias("key"), "region_name"))
    g = table(spark, d, "shelf_features").select("rec_no", F.posexplode("geographic").alias("pos", "x")).withColumn("key", F.lower(F.trim("x")))
    m = g.join(places, "key").groupBy("rec_no").agg(F.min_by("region_name", "pos").alias("region"), F.countDistinct("region_name").alias("regions"))
    return m.groupBy("region").agg(F.count("*").alias("n"), F.count_if(F.col("regions") == 1).alias("unambiguous"))


@query("select n_name, count(*) as orders, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where l_discount between 0.03 and 0.07 group by n_name")
def relational_smoke(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").where("l_discount between 0.03 and 0.07").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + 0.5).cast("double").alias("revenue"))
