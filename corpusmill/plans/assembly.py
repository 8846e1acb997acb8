"""Quality gates, duplicates, splits and pair mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import hash60, shingles, tokens
from corpusmill.operators.lexical import postings
from corpusmill.plans.gates import gate_language, gate_refusal_self_label  # noqa: F401
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import TOK
from corpusmill.runtime import spread
from corpusmill.sources.tables import table

#: Pairs that label_pairs draws of each class.
PAIRS_OF_CLASS = 20
H60 = "('0x' || substr(md5({}), 1, 15))::bigint"


KEY = r"sha256(lower(regexp_replace(trim(text), '\s+', ' ', 'g')))"


@query(f"select doc_id from (select doc_id, row_number() over (partition by {KEY} order by doc_id) as r from documents where trim(text) <> '') where r = 1")
def exact_dedup_keep_first(spark, d):
    """The first document of each text, white space and case aside: a minimum by key, so no group of copies is sorted or gathered."""
    key = F.sha2(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")), 256)
    return table(spark, d, "documents").where("trim(text) <> ''").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"""with t as (select doc_id, {TOK.replace('{}', 'text')} as ts from documents), s as (select doc_id, len(ts) as n, ts from t)
select doc_id, case when n = 0 then 0 when n < 5 then 1 else len(list_distinct([array_to_string(ts[i:i+4], ' ') for i in range(1, n - 3)])) end::bigint as shingles from s""")
def shingle_counts(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(shingles(tokens(F.col("text")), 5)).cast("long").alias("shingles"))


@query(f"""with k as (select doc_id, source, {H60.format("'7|' || doc_id")} as h from documents), r as (select *, row_number() over (partition by source order by h, doc_id) as r, count(*) over (partition by source) as n from k)
select source, case when r <= floor(n * 0.2) then 'test' when r <= floor(n * 0.4) then 'dev' else 'train' end as split, count(*) as n, min(doc_id) as least from r group by 1, 2""")
def stratified_split(spark, d):
    """Shares of each source by hash order: exact at any size of stratum, as ranks come from range-sorted partitions."""
    from corpusmill.runtime import running_total

    k = table(spark, d, "documents").where("source is not null").select("doc_id", "source", hash60(F.concat(F.lit("7|"), F.col("doc_id"))).alias("h"))
    n = k.groupBy("source").agg(F.count("*").alias("n"))
    r = running_total(k, ["h", "doc_id"], "r", by="source").join(n, "source")
    split = F.when(F.col("r") + 1 <= F.floor(F.col("n") * 0.2), "test").when(F.col("r") + 1 <= F.floor(F.col("n") * 0.4), "dev").otherwise("train")
    return r.groupBy("source", split.alias("split")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("select id, count(distinct split) as splits, count(*) as n from shelf_features where id is not null group by id having count(distinct split) > 1")
def split_collisions(spark, d):
    return table(spark, d, "shelf_features").where("id is not null").groupBy("id").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")


@query(f"select split, count(*) as n, bit_xor({H60.format('id')})::bigint as checksum from (select distinct split, id from shelf_features where id is not null) group by split")
def split_checksums(spark, d):
    """An order-free checksum of each split's ids that is merged like a count: no list of ids is gathered."""
    return table(spark, d, "shelf_features").where("id is not null").select("split", "id").distinct().groupBy("split").agg(F.count("*").alias("n"), F.bit_xor(hash60(F.col("id"))).alias("checksum"))


@query("""with c as (select lcc_code, lcgft_form, count(*) as n from documents group by 1, 2), p as (select case when a.lcc_code = b.lcc_code and a.lcgft_form = b.lcgft_form then 'S0_same_both' when a.lcc_code = b.lcc_code then 'S2_same_class' when a.lcgft_form = b.lcgft_form then 'S3_same_form' else 'S6_unrelated' end as stratum,
 case when a.lcc_code is not distinct from b.lcc_code and a.lcgft_form is not distinct from b.lcgft_form then a.n * (a.n - 1) // 2 else a.n * b.n end as n from c a join c b on (coalesce(a.lcc_code, ''), coalesce(a.lcgft_form, '')) <= (coalesce(b.lcc_code, ''), coalesce(b.lcgft_form, '')))
select stratum, sum(n)::bigint as pairs from p group by 1""")
def relation_strata(spark, d):
    """Pairs of documents by relation, counted from facet cells: the pairs themselves are never made."""
    c = table(spark, d, "documents").groupBy("lcc_code", "lcgft_form").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("t")).select((F.col("t").cast("decimal(38,0)") * (F.col("t") - 1) / 2).cast("long").alias("all"))
    two = lambda x: (x.cast("decimal(20,0)") * (x - 1) / 2).cast("long")
    both = c.agg(F.sum(F.when(F.col("lcc_code").isNotNull() & F.col("lcgft_form").isNotNull(), two(F.col("n")))).alias("v"))
    by = lambda f: c.where(F.col(f).isNotNull()).groupBy(f).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias("v"))
    x = both.select(F.col("v").alias("s0")).crossJoin(by("lcc_code").select(F.col("v").alias("c"))).crossJoin(by("lcgft_form").select(F.col("v").alias("f"))).crossJoin(t)  # rows of one
    rows = F.array(*[F.struct(F.lit(s).alias("stratum"), v.cast("long").alias("pairs")) for s, v in (("S0_same_both", F.col("s0")), ("S2_same_class", F.col("c") - F.col("s0")), ("S3_same_form", F.col("f") - F.col("s0")), ("S6_unrelated", F.col("all") - F.col("c") - F.col("f") + F.col("s0")))])
    return x.select(F.explode(rows).alias("x")).select("x.stratum", "x.pairs").where("pairs > 0")


@query(f"""with r as (select doc_id, lcc_code, row_number() over (partition by lcc_code order by {H60.format("'p|' || doc_id")}, doc_id) as r from documents where lcc_code is not null)
select a.doc_id as doc_a, b.doc_id as doc_b, a.lcc_code as label from r a join r b on a.lcc_code = b.lcc_code and b.r = a.r + 1 where a.r % 2 = 1 and a.r < {2 * PAIRS_OF_CLASS}""")
def label_pairs(spark, d):
    """Up to PAIRS_OF_CLASS positive pairs for each class in hash order: neighbours by rank, so no pair is made that isn't kept. pairing.generate_pairs has no limit."""
    w = Window.partitionBy("lcc_code").orderBy(hash60(F.concat(F.lit("p|"), F.col("doc_id"))), "doc_id")
    r = table(spark, d, "documents").where("lcc_code is not null").select("doc_id", "lcc_code", F.row_number().over(w).alias("r")).where(F.col("r") <= 2 * PAIRS_OF_CLASS)
    p = r.withColumn("g", F.floor((F.col("r") - 1) / 2)).groupBy("lcc_code", "g").agg(F.min_by("doc_id", "r").alias("doc_a"), F.max_by("doc_id", "r").alias("doc_b"), F.count("*").alias("n"))
    return p.where("n = 2").select("doc_a", "doc_b", F.col("lcc_code").alias("label"))


@query(f"""with t as (select doc_id, {TOK.replace('{}', 'text')} as ts from documents)
select doc_id, len(ts)::bigint as n_tokens, case when len(ts) <= 512 then '<=512' when len(ts) <= 1024 then '<=1024' else '>1024' end as stratum from t""")
def truncation_audit(spark, d):
    n = F.size(tokens(F.col("text"))).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("n_tokens"), F.when(n <= 512, "<=512").when(n <= 1024, "<=1024").otherwise(">1024").alias("stratum"))
