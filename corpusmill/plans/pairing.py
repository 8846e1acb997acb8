"""Pairs of documents: strata, mining by quotas, topic pairs, minimal pairs, and set-overlap joins."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import facet_set, r6, word_count
from corpusmill.operators import pairs
from corpusmill.operators.judgments import FEW, sets_that_meet, subsets
from corpusmill.plans.evaluation import SETS
from corpusmill.plans.registry import query
from corpusmill.plans.reports import WORDS
from corpusmill.plans.retrieval import R6
from corpusmill.runtime import running_total, stage
from corpusmill.sources.tables import table

FACET = "nullif(lower(trim({})), '')"
#: One row for each id, the first delivered, with its facets trimmed and in lower case.
FX = f"""fx as (select id, rec_no, split, null::varchar as sub, {FACET.format('lcc_code')} as cls, {FACET.format('lcgft_form')} as form, {FACET.format('lcgft_category')} as cat, {FACET.format('audience')} as aud, {FACET.format('register')} as reg, {SETS.format('topics')} as topics, nullif(trim(model), '') as model, spec_id, block_id, body
 from (select *, row_number() over (partition by id order by rec_no) as rr from shelf_features where id is not null) where rr = 1)"""


def facets(spark, d, body: bool = False):
    """One row for each id, by a minimum: rows of an id are never gathered; texts move only where they are asked for."""
    f = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    s = table(spark, d, "shelf_features").where("id is not null")
    row = F.struct(
        "rec_no", "split", F.lit(None).cast("string").alias("sub"), f("lcc_code").alias("cls"), f("lcgft_form").alias("form"), f("lcgft_category").alias("cat"), f("audience").alias("aud"), f("register").alias("reg"),
        F.array_sort(facet_set(F.col("topics"))).alias("topics"), F.nullif(F.trim("model"), F.lit("")).alias("model"), "spec_id", "block_id", *(["body"] if body else []),
    )
    return s.groupBy("id").agg(F.min_by(row, "rec_no").alias("x")).select("id", "x.*")


def hash_sql(seed, *cols):
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join([f"'{seed}'", *cols]) + ")), 1, 15))::bigint"


JACCARD = "case when len(list_distinct(list_concat({a}, {b}))) > 0 then len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) else 0 end"


def relation_sql(a, b):
    j = JACCARD.format(a=f"{a}.topics", b=f"{b}.topics")
    return f"""case when {a}.sub = {b}.sub and {a}.form = {b}.form and {j} = 1 then 'S0_identical_facets' when {a}.sub = {b}.sub then 'S1_same_subclass' when {a}.cls = {b}.cls then 'S2_same_class'
 when {a}.form = {b}.form then 'S3_same_form' when {a}.cat = {b}.cat then 'S4_same_category' when {j} > 0 then 'S5_same_topic' else 'S6_unrelated' end"""


def mine_sql(quotas, seed="mine", per_group=64, lags=8):
    parts = []
    for i, (s, q) in enumerate(quotas.items()):
        by = pairs.INDEX[s]
        src = "(select *, unnest(topics) as topic from fx)" if by == "topic" else "fx"
        group = by or "0"
        where = f"where {by} is not null" if by else ""
        parts.append((f"r{i} as (select * from (select *, {group} as g, row_number() over (partition by {group} order by {hash_sql(f'{seed}|{s}', 'id')}, id) as r from {src} {where}) where r <= {per_group if by else 4 * q})", f"""
select * from (select *, row_number() over (order by h, a, b) as k from (select distinct least(x.id, y.id) as a, greatest(x.id, y.id) as b, coalesce(x.cls = y.cls, false)::int as label, '{s}' as stratum, {hash_sql(seed, 'least(x.id, y.id)', 'greatest(x.id, y.id)')} as h
 from r{i} x join r{i} y on x.g = y.g and y.r > x.r and y.r <= x.r + {lags} and x.id <> y.id where {relation_sql('x', 'y')} = '{s}')) where k <= {q}"""))
    return f"with {FX}, " + ", ".join(p for p, _ in parts) + ", mined as (" + " union all ".join(q for _, q in parts) + ")"


QUOTAS = {**pairs.balanced_quotas(800), "S0_identical_facets": 10, "S1_same_subclass": 10}


@query(f"{mine_sql(QUOTAS)} select 'pair_' || lpad((row_number() over (order by h, a, b) - 1)::varchar, 6, '0') as pair_id, a as doc_a, b as doc_b, label, stratum from mined")
def mine_stratum_pairs(spark, d):
    """Pairs by quotas of the seven strata, half of them positive."""
    return pairs.mine_pairs(facets(spark, d), QUOTAS)


@query(f"{mine_sql(QUOTAS)}, asked(stratum, requested) as (values {', '.join(f'({s!r}, {QUOTAS.get(s, 0)})' for s in pairs.STRATA)}) select stratum, requested::bigint as requested, count(mined.a) as produced, greatest(requested - count(mined.a), 0)::bigint as shortfall from asked left join mined using (stratum) group by stratum, requested")
def mining_shortfalls(spark, d):
    return pairs.mining_report(pairs.mine_pairs(facets(spark, d), QUOTAS), QUOTAS)


HALVES = f"r as (select *, row_number() over (partition by cls order by {hash_sql('halves', 'id')}, id) as r from fx where cls is not null), n as (select *, row_number() over (order by {hash_sql('across', 'id')}, id) as r from fx where cls is not null)"


@query(f"""with {FX}, {HALVES} select least(x.id, y.id) as doc_a, greatest(x.id, y.id) as doc_b, 1 as label from r x join r y on x.cls = y.cls and y.r = x.r + 1 and x.r % 2 = 1
union all select least(x.id, y.id), greatest(x.id, y.id), 0 from n x join n y on y.r = x.r + 1 and x.r % 2 = 1 and x.cls <> y.cls""")
def generate_pairs(spark, d):
    """Positive pairs within classes and negative ones across, each document at most once on either side and no cap: ranks come from range-sorted partitions."""
    f = facets(spark, d).where("cls is not null").select("id", "cls")

    def halves(seed, by):
        ranked = running_total(f.withColumn("h", pairs.order_key(seed, F.col("id"))), ["h", "id"], "r", by=by)
        on = ["cls"] if by else []
        g = ranked.groupBy(*on, F.floor(F.col("r") / 2).alias("g")).agg(F.min("id").alias("doc_a"), F.max("id").alias("doc_b"), F.count("*").alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
        return g.where("n = 2")

    pos = halves("halves", "cls").select("doc_a", "doc_b", F.lit(1).alias("label"))
    return pos.unionByName(halves("across", None).where("lo <> hi").select("doc_a", "doc_b", F.lit(0).alias("label")))


#: Shares of pairs by the number of shared topics, of a binary and of a graded set.
OVERLAPS = {"binary": {0: 0.5, 1: 0.5}, "graded": {0: 0.4, 1: 0.3, 2: 0.2, 3: 0.1}}
N_TOPIC_PAIRS = 400
TOPIC_PAIRS = f"""e as (select id, topics, unnest(topics) as topic from fx), t as (select * from (select *, row_number() over (partition by topic order by {hash_sql('topic', 'id')}, id) as r from e) where r <= 64),
z as (select * from (select id, topics, row_number() over (order by {hash_sql('none', 'id')}, id) as r from fx where len(topics) > 0) where r <= {4 * N_TOPIC_PAIRS}),
c as (select distinct least(x.id, y.id) as a, greatest(x.id, y.id) as b, len(list_intersect(x.topics, y.topics)) as overlap from t x join t y on x.topic = y.topic and y.r > x.r and y.r <= x.r + 8
 union select distinct least(x.id, y.id), greatest(x.id, y.id), len(list_intersect(x.topics, y.topics)) from z x join z y on y.r > x.r and y.r <= x.r + 8),
q as (select *, least(overlap, 3) as label, row_number() over (partition by least(overlap, 3) order by {hash_sql('pick', 'a', 'b')}, a, b) as k from c)"""


@query(f"with {FX}, {TOPIC_PAIRS} select a as doc_a, b as doc_b, overlap::bigint as overlap, label::bigint as label from q where k <= case label {' '.join(f'when {k} then {int(N_TOPIC_PAIRS * s)}' for k, s in OVERLAPS['graded'].items())} end")
def overlap_pairs(spark, d):
    """Topic pairs whose numbers of shared topics follow given shares; candidates are near neighbours in hash order, by topic and over all documents."""
    f = facets(spark, d).select("id", "topics")
    by_topic = pairs.neighbours(pairs.first_of_groups(f.select("id", "topics", F.explode("topics").alias("topic")), "topic", 64, "topic"), "topic", 8, keep=("topics",))
    any_ = pairs.neighbours(pairs.first_of_groups(f.where(F.size("topics") > 0), None, 4 * N_TOPIC_PAIRS, "none"), None, 8, keep=("topics",))
    c = by_topic.unionByName(any_).select("a", "b", F.size(F.array_intersect("topics_a", "topics_b")).cast("long").alias("overlap")).distinct()
    c = c.withColumn("label", F.least("overlap", F.lit(3).cast("long")))
    out = None
    for k, share in OVERLAPS["graded"].items():
        one = c.where(F.col("label") == k).orderBy(pairs.order_key("pick", F.col("a"), F.col("b")), "a", "b").limit(int(N_TOPIC_PAIRS * share))
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "overlap", "label")


@query(f"""with {FX}, r as (select * from (select *, row_number() over (partition by cls, form order by {hash_sql('minimal', 'id')}, id) as r from fx where cls is not null and form is not null and reg is not null) where r <= 16)
select x.id as doc_a, y.id as doc_b, x.cls, x.form, x.reg as register_a, y.reg as register_b from r x join r y on x.cls = y.cls and x.form = y.form and y.r = x.r + 1 and x.reg <> y.reg""")
def minimal_pairs(spark, d):
    """Pairs alike in class and form that differ in register only."""
    f = facets(spark, d).where("cls is not null and form is not null and reg is not null")
    w = Window.partitionBy("cls", "form").orderBy(pairs.order_key("minimal", F.col("id")), "id")
    r = f.select("id", "cls", "form", "reg").withColumn("r", F.row_number().over(w)).where("r <= 17").withColumn("next", F.lead(F.struct("id", "reg", "r")).over(Window.partitionBy("cls", "form").orderBy("r")))
    r = r.where("r <= 16 and next.r <= 16 and reg <> next.reg")
    return r.select(F.col("id").alias("doc_a"), F.col("next.id").alias("doc_b"), "cls", "form", F.col("reg").alias("register_a"), F.col("next.reg").alias("register_b"))


@query(f"""with {FX}, r as (select * from (select *, row_number() over (partition by cls order by {hash_sql('natural', 'id')}, id) as r, count(*) over (partition by cls) as n from fx where cls is not null) where r <= 24),
p as (select x.cls, x.id as a, y.id as b, row_number() over (partition by x.cls order by {hash_sql('np', 'x.id', 'y.id')}, x.id, y.id) as k from r x join r y on x.cls = y.cls and y.r > x.r and y.r <= x.r + 3)
select cls, a as doc_a, b as doc_b from p where k <= 20""")
def natural_pairs(spark, d):
    """Up to 20 pairs of each class in which no document occurs more than six times: each has at most three partners after it and three before."""
    f = facets(spark, d).where("cls is not null").select("id", "cls")
    r = pairs.first_of_groups(f, "cls", 24, "natural")
    left = r.select("cls", F.explode(F.sequence(F.col("r") + 1, F.col("r") + 3)).alias("to"), F.col("id").alias("doc_a"))
    p = left.join(r.select("cls", F.col("r").alias("to"), F.col("id").alias("doc_b")), ["cls", "to"])
    k = F.row_number().over(Window.partitionBy("cls").orderBy(pairs.order_key("np", F.col("doc_a"), F.col("doc_b")), "doc_a", "doc_b"))
    return p.withColumn("k", k).where("k <= 20").select("cls", "doc_a", "doc_b")


MINED = mine_sql(QUOTAS)


@query(f"""{MINED}, u as (select a as id from mined union all select b from mined) select (select count(*) from mined) as pairs, (select sum(label)::bigint from mined) as positives, count(*) as documents, max(n) as most_uses, {R6.format('avg(n)')} as mean_uses from (select id, count(*) as n from u group by id)""")
def pair_reuse(spark, d):
    """How often documents occur in the mined pairs."""
    p = pairs.mine_pairs(facets(spark, d), QUOTAS)
    uses = p.select(F.explode(F.array("doc_a", "doc_b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    u = uses.agg(F.count("*").alias("documents"), F.max("n").alias("most_uses"), r6(F.avg("n")).alias("mean_uses"))
    return p.agg(F.count("*").alias("pairs"), F.sum("label").alias("positives")).crossJoin(u)  # rows of one


@query(f"""with {FX}, s as (select topics, count(*) as n from fx where len(topics) > 0 group by topics), q as (select topics, count(*) as n from fx where len(topics) > 0 and rec_no % 20 = 0 group by topics)
select len(list_intersect(q.topics, s.topics))::bigint as overlap, sum(q.n * s.n)::bigint as pairs from q cross join s where len(list_intersect(q.topics, s.topics)) > 0 group by 1""")
def topic_overlap_join(spark, d):
    """Documents that share topics with the queries (every record number divisible by 20), counted by how many they share.

    Both sides are counted by subset of their topics. Over all pairs the products of the counts of subsets of j topics sum to the pairs that share k topics times
    C(k, j), which gives the pairs by k; pairs of sets are made only where one is of more than FEW topics.
    """
    f = facets(spark, d).where(F.size("topics") > 0).select("topics", "rec_no")
    s = stage(f.groupBy("topics").agg(F.count("*").alias("n"), F.count_if(F.col("rec_no") % 20 == 0).alias("m")), "sets")
    by = s.where(F.size("topics") <= FEW).select(F.explode(subsets(F.col("topics"))).alias("s"), "n", "m").groupBy("s").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("m > 0")
    exact = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731 - the sums of products may pass 2^63 where the pairs don't
    sums = by.groupBy(F.size("s").alias("j")).agg(F.sum((exact("n") * exact("m")).cast("decimal(38,0)")).alias("x"))
    k = F.explode(F.sequence(F.lit(1), F.col("j"))).alias("k")
    chosen = reduce(lambda c, jk: c.when((F.col("j") == jk[0]) & (F.col("k") == jk[1]), (-1) ** (jk[0] - jk[1]) * comb(*jk)), [(j, i) for j in range(1, FEW + 1) for i in range(1, j + 1)], F.when(F.lit(False), 0))
    few = sums.select("j", "x", k).select(F.col("k").cast("long").alias("overlap"), (chosen.cast("decimal(38,0)") * F.col("x")).cast("decimal(38,0)").alias("pairs"))
    q = s.where("m > 0").select(F.col("topics").alias("qt"), "m")
    many = sets_that_meet(q, s.select("topics", "n")).select("overlap", (exact("m") * exact("n")).cast("decimal(38,0)").alias("pairs"))
    return few.unionByName(many).groupBy("overlap").agg(F.sum("pairs").cast("long").alias("pairs")).where("pairs > 0")


PER_CLASS = 5


@query(f"""with {FX}, w as (select id, cls, {WORDS.format('body')} as n from fx where cls is not null), r as (select *, row_number() over (partition by cls order by {hash_sql('annotate', 'id')}, id) as r from w where n >= 60) select id, cls, n::bigint as n_words from r where r <= {PER_CLASS}""")
def stratified_annotation_sample(spark, d):
    """Texts of 60 words or more, equally many of each class."""
    f = facets(spark, d, True).where("cls is not null").select("id", "cls", word_count(F.col("body")).cast("long").alias("n_words")).where("n_words >= 60")
    return pairs.first_of_groups(f, "cls", PER_CLASS, "annotate").select("id", "cls", "n_words")


@query(f"""with {FX}, k as (select spec_id, min(id) as rep from fx where spec_id is not null group by spec_id), s as (select k.spec_id, coalesce(cls, '') as stratum from k join fx on fx.id = k.rep),
r as (select *, row_number() over (partition by stratum order by {hash_sql('group', 'spec_id')}, spec_id) as r, count(*) over (partition by stratum) as n from s),
p as (select spec_id, case when r <= floor(n * 0.2) then 'test' when r <= floor(n * 0.4) then 'dev' else 'train' end as split from r)
select p.split, count(*) as n, count(distinct fx.spec_id) as groups, min(fx.id) as least from fx join p on p.spec_id = fx.spec_id group by 1""")
def grouped_split(spark, d):
    """All documents of a spec in one split: the specs are split, stratified by their first document's class, and joined back."""
    f = facets(spark, d).where("spec_id is not null").select("id", "spec_id", F.coalesce("cls", F.lit("")).alias("stratum"))
    s = f.groupBy("spec_id").agg(F.min_by("stratum", "id").alias("stratum")).withColumn("h", pairs.order_key("group", F.col("spec_id")))
    n = s.groupBy("stratum").agg(F.count("*").alias("n"))
    r = running_total(s, ["h", "spec_id"], "r", by="stratum").join(n, "stratum")
    split = F.when(F.col("r") + 1 <= F.floor(F.col("n") * 0.2), "test").when(F.col("r") + 1 <= F.floor(F.col("n") * 0.4), "dev").otherwise("train")
    j = f.join(r.select("spec_id", split.alias("split")), "spec_id")
    return j.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("spec_id").alias("groups"), F.min("id").alias("least"))


@query(f"""with {FX}, r as (select block_id, split, id, row_number() over (partition by block_id order by {hash_sql('block', 'id')}, id) as r, count(*) over (partition by block_id) as n from fx where block_id is not null)
select block_id, count(*) filter (where r <= floor(n * 0.7)) as train, count(*) filter (where r > floor(n * 0.7)) as held_out, min(id) filter (where r > floor(n * 0.7)) as least_held_out from r group by block_id""")
def block_split(spark, d):
    """Each block's first seven tenths in draw order to train, the rest held out."""
    f = facets(spark, d).where("block_id is not null").select("id", "block_id").withColumn("h", pairs.order_key("block", F.col("id")))
    n = f.groupBy("block_id").agg(F.count("*").alias("n"))
    r = running_total(f, ["h", "id"], "r", by="block_id").join(n, "block_id").withColumn("first", F.col("r") + 1 <= F.floor(F.col("n") * 0.7))
    return r.groupBy("block_id").agg(F.count_if("first").alias("train"), F.count_if(~F.col("first")).alias("held_out"), F.min(F.when(~F.col("first"), F.col("id"))).alias("least_held_out"))


@query(f"""with {FX}, n as (select cls, count(*) as n from fx where cls is not null group by 1), m as (select min(n) as m from n), r as (select id, cls, row_number() over (partition by cls order by {hash_sql('even', 'id')}, id) as r from fx where cls is not null)
select cls, count(*) as kept, min(id) as least, max(id) as most from r cross join m where r <= m group by cls""")
def balance_to_smallest(spark, d):
    """Every class cut to the size of the smallest, by hash order."""
    f = facets(spark, d).where("cls is not null").select("id", "cls").withColumn("h", pairs.order_key("even", F.col("id")))
    m = f.groupBy("cls").agg(F.count("*").alias("n")).agg(F.min("n").alias("m"))
    r = running_total(f, ["h", "id"], "r", by="cls").crossJoin(F.broadcast(m)).where("r < m")  # one row on the right
    return r.groupBy("cls").agg(F.count("*").alias("kept"), F.min("id").alias("least"), F.max("id").alias("most"))


@query(f"""with {FX}, a as (select id, cls, model, row_number() over (partition by cls, model order by {hash_sql('cap', 'id')}, id) as ra, {hash_sql('cap', 'id')} as h from fx where cls is not null and model is not null), b as (select *, row_number() over (partition by cls order by h, id) as rc from a where ra <= 2) select cls, id, model from b where rc <= 12""")
def capped_draw(spark, d):
    """At most two documents of a model in each class, twelve of a class: both orders share the key, so two limits give what a greedy draw gives."""
    f = facets(spark, d).where("cls is not null and model is not null").select("id", "cls", "model").withColumn("h", pairs.order_key("cap", F.col("id")))
    a = f.withColumn("ra", F.row_number().over(Window.partitionBy("cls", "model").orderBy("h", "id"))).where("ra <= 2")
    return a.withColumn("rc", F.row_number().over(Window.partitionBy("cls").orderBy("h", "id"))).where("rc <= 12").select("cls", "id", "model")
