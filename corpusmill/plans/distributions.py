"""Distributions, co-occurrence of facets, slice profiles and their comparison, taxonomies and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import hash60, r6, word_count
from corpusmill.plans.pairing import FX, facets
from corpusmill.plans.registry import query
from corpusmill.plans.reports import WORDS
from corpusmill.plans.retrieval import R6
from corpusmill.sources.tables import table

DIMS = ("cls", "form", "cat", "aud", "reg")


def dimensions(df: DataFrame, dims, extra=()) -> DataFrame:
    """(dim, value, *extra): a row for each dimension of a row, lists flattened, what is missing as (none)."""
    one = lambda c: F.array(F.coalesce(F.col(c), F.lit("(none)")))
    many = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("(none)")))
    tagged = lambda c, vs: F.transform(vs, lambda v: F.struct(F.lit(c).alias("dim"), v.alias("value")))
    rows = F.concat(*[tagged(c, many(c) if df.schema[c].dataType.typeName() == "array" else one(c)) for c in dims])
    return df.select(*extra, F.explode(rows).alias("x")).select(*extra, "x.dim", "x.value")


DISTS = " union all ".join([*(f"select '{c}' as dim, coalesce({c}, '(none)') as value, split from fx" for c in DIMS), "select 'topics', unnest(case when len(topics) > 0 then topics else ['(none)'] end), split from fx"])


@query(f"with {FX}, x as ({DISTS}) select dim, value, count(*) as n from x group by 1, 2")
def facet_distributions(spark, d):
    """Counts of every dimension's values in one pass: all dimensions are rows of one grouping."""
    return dimensions(facets(spark, d), (*DIMS, "topics")).groupBy("dim", "value").agg(F.count("*").alias("n"))


CO = f"{FX}, c as (select unnest(topics) as topic, reg from fx where reg is not null), m as (select topic, reg, count(*) as n from c group by 1, 2)"


@query(f"with {CO} select topic, reg as register, n from m")
def topic_register_matrix(spark, d):
    """Records by topic and register, the cells that occur."""
    return _matrix(spark, d).select("topic", F.col("reg").alias("register"), "n")


def _matrix(spark, d):
    f = facets(spark, d).where("reg is not null").select("reg", F.explode("topics").alias("topic"))
    return f.groupBy("topic", "reg").agg(F.count("*").alias("n"))


def top_cells(m: DataFrame, rows: str, cols: str, k: int) -> DataFrame:
    """Cells of the k rows and columns of largest sums, ties by name."""
    best = lambda c: m.groupBy(c).agg(F.sum("n").alias("s")).orderBy(F.desc("s"), c).limit(k).select(c)
    return m.join(F.broadcast(best(rows)), rows, "left_semi").join(F.broadcast(best(cols)), cols, "left_semi")  # k names each


TOP = "tr as (select topic from m group by 1 order by sum(n) desc, topic limit 10), tc as (select reg from m group by 1 order by sum(n) desc, reg limit 10), t as (select * from m where topic in (select topic from tr) and reg in (select reg from tc))"


@query(f"with {CO}, {TOP} select topic, reg as register, n from t")
def top_of_matrix(spark, d):
    return top_cells(_matrix(spark, d), "topic", "reg", 10).select("topic", F.col("reg").alias("register"), "n")


@query(f"with {CO}, {TOP} select count(*) as observed, (select count(*) from tr) * (select count(*) from tc) as possible, {R6.format('count(*) / ((select count(*) from tr) * (select count(*) from tc))')} as density from t")
def cooccurrence_sparsity(spark, d):
    """Share of the cells of the ten largest rows and columns that occur."""
    m = _matrix(spark, d)
    t = top_cells(m, "topic", "reg", 10)
    size = m.agg(F.least(F.countDistinct("topic"), F.lit(10)).alias("r"), F.least(F.countDistinct("reg"), F.lit(10)).alias("c"))
    return t.agg(F.count("*").alias("observed")).crossJoin(size).select("observed", (F.col("r") * F.col("c")).alias("possible"), r6(F.try_divide("observed", F.col("r") * F.col("c"))).alias("density"))  # rows of one


@query(f"with {FX} select len(topics)::bigint as topics, count(*) as n from fx group by 1")
def topics_per_document(spark, d):
    return facets(spark, d).groupBy(F.size("topics").cast("long").alias("topics")).agg(F.count("*").alias("n"))


@query(f"with {FX}, r as (select topics, row_number() over (order by ('0x' || substr(md5('window|' || id), 1, 15))::bigint, id) as r from fx) select len(list_intersect(a.topics, b.topics))::bigint as overlap, count(*) as pairs from r a join r b on b.r > a.r and b.r <= a.r + 10 group by 1")
def sliding_topic_overlap(spark, d):
    """Shared topics of documents at most ten places apart in hash order; places come from range-sorted partitions and pairs by place, so the work is linear."""
    from corpusmill.runtime import running_total

    f = facets(spark, d).select("id", "topics", hash60(F.concat_ws("|", F.lit("window"), "id")).alias("h"))
    r = running_total(f, ["h", "id"], "r")
    left = r.select(F.explode(F.sequence(F.col("r") + 1, F.col("r") + 10)).alias("r"), F.col("topics").alias("ta"))
    return left.join(r.select("r", "topics"), "r").groupBy(F.size(F.array_intersect("ta", "topics")).cast("long").alias("overlap")).agg(F.count("*").alias("pairs"))


RANKED = "w as (select source, n_chars as n, row_number() over (partition by source order by n_chars, doc_id) - 1 as i, count(*) over (partition by source) as m from documents where source is not null and n_chars is not null)"


@query(f"with {RANKED} select source, max(m) as n, min(n)::bigint as least, max(case when i = round_even(0.1 * (m - 1), 0) then n end)::bigint as p10, max(case when i = round_even(0.5 * (m - 1), 0) then n end)::bigint as p50, max(case when i = round_even(0.9 * (m - 1), 0) then n end)::bigint as p90, {R6.format('avg(n)')} as mean, max(n)::bigint as most from w group by source")
def length_stats_nearest_rank(spark, d):
    """Length statistics by rounded nearest rank (halves to the even place), from counts by distinct length: no source's lengths are gathered."""
    c = table(spark, d, "documents").where("source is not null and n_chars is not null").groupBy("source", "n_chars").agg(F.count("*").alias("k"))
    w = Window.partitionBy("source").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)  # distinct lengths
    r = c.withColumn("at", F.coalesce(F.sum("k").over(w), F.lit(0))).join(c.groupBy("source").agg(F.sum("k").alias("m")), "source")
    spot = lambda q: F.max(F.when((F.bround(q * (F.col("m") - 1), 0) >= F.col("at")) & (F.bround(q * (F.col("m") - 1), 0) < F.col("at") + F.col("k")), F.col("n_chars")))
    return r.groupBy("source").agg(F.max("m").alias("n"), F.min("n_chars").alias("least"), spot(F.lit(0.1)).alias("p10"), spot(F.lit(0.5)).alias("p50"), spot(F.lit(0.9)).alias("p90"), r6(F.sum(F.col("k") * F.col("n_chars")) / F.sum("k")).alias("mean"), F.max("n_chars").alias("most"))


SHARES = f"{FX}, x as ({DISTS}), c as (select dim, value, count(*) filter (where split = 'train') as a, count(*) filter (where split = 'test') as b from x where split in ('train', 'test') group by 1, 2), p as (select *, a / nullif(sum(a) over (partition by dim), 0) as p, b / nullif(sum(b) over (partition by dim), 0) as q from c)"


def _shares(spark, d):
    x = dimensions(facets(spark, d).where("split in ('train', 'test')"), (*DIMS, "topics"), ("split",))
    c = x.groupBy("dim", "value").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    t = c.groupBy("dim").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return c.join(t, "dim").select("dim", "value", "a", "b", F.try_divide("a", "ta").alias("p"), F.try_divide("b", "tb").alias("q"))


@query(f"with {SHARES} select dim, {R6.format('sum(abs(p - q)) / 2')} as tvd, {R6.format('max(abs(p - q))')} as max_divergence, max(abs(p - q)) > 0.1 as flagged, count(*) filter (where b = 0) as missing_in_test, count(*) filter (where a = 0) as missing_in_train, {R6.format('coalesce(-sum(q * ln(nullif(q, 0))) / nullif(ln(count(*) filter (where b > 0)), 0), 0)')} as entropy_test from p group by dim")
def split_comparison(spark, d):
    """Distance of train and test in every dimension, values missing on either side, and the normalised entropy of test."""
    delta = F.abs(F.col("p") - F.col("q"))
    some = F.count_if(F.col("b") > 0)
    entropy = F.try_divide(-F.sum(F.when(F.col("q") > 0, F.col("q") * F.ln("q"))), F.when(some > 1, F.ln(some)))
    return _shares(spark, d).groupBy("dim").agg(r6(F.sum(delta) / 2).alias("tvd"), r6(F.max(delta)).alias("max_divergence"), (F.max(delta) > 0.1).alias("flagged"), F.count_if(F.col("b") == 0).alias("missing_in_test"), F.count_if(F.col("a") == 0).alias("missing_in_train"), r6(F.coalesce(entropy, F.lit(0.0))).alias("entropy_test"))


@query(f"with {SHARES}, r as (select dim, value, {R6.format('q - p')} as delta from p), k as (select *, row_number() over (partition by dim order by delta desc, value) as hi, row_number() over (partition by dim order by delta, value) as lo from r) select dim, value, delta, case when hi <= 5 and delta > 0 then 'over' else 'under' end as side from k where (hi <= 5 and delta > 0) or (lo <= 5 and delta < 0)")
def largest_share_deltas(spark, d):
    """The five values of each dimension that test has most too much and too little of."""
    r = _shares(spark, d).select("dim", "value", r6(F.col("q") - F.col("p")).alias("delta"))
    over = r.where("delta > 0").withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("delta"), "value"))).where("k <= 5").withColumn("side", F.lit("over"))
    under = r.where("delta < 0").withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy("delta", "value"))).where("k <= 5").withColumn("side", F.lit("under"))
    return over.unionByName(under).select("dim", "value", "delta", "side")


PROFILE = f"{FX}, b as (select cls, spec_id, model, {WORDS.format('body')} as n from fx), s as (select cls, spec_id, count(*) as chunks from b group by 1, 2)"


@query(f"with {PROFILE} select (select count(*) from b) as documents, (select count(distinct cls) from b) as classes, (select count(distinct spec_id) from b) as works, (select count(distinct model) from b) as models, (select max(chunks) from s) as most_chunks, {R6.format('(select avg(chunks) from s)')} as mean_chunks, (select min(n)::bigint from b) as least_words, (select max(n)::bigint from b) as most_words, {R6.format('(select avg(w) from (select cls, count(distinct spec_id) as w from b where cls is not null group by 1))')} as works_per_class")
def slice_profile(spark, d):
    """One row on a slice: documents, classes, works, models, chunks of a work, lengths, works of a class."""
    b = facets(spark, d, True).select("cls", "spec_id", "model", word_count(F.col("body")).cast("long").alias("n"))
    a = b.agg(F.count("*").alias("documents"), F.countDistinct("cls").alias("classes"), F.countDistinct("spec_id").alias("works"), F.countDistinct("model").alias("models"), F.min("n").alias("least_words"), F.max("n").alias("most_words"))
    s = b.groupBy("cls", "spec_id").agg(F.count("*").alias("chunks"))
    c = s.agg(F.max("chunks").alias("most_chunks"), r6(F.avg("chunks")).alias("mean_chunks"))
    w = s.where("cls is not null and spec_id is not null").groupBy("cls").agg(F.count("*").alias("w")).agg(r6(F.avg("w")).alias("works_per_class"))
    return a.crossJoin(c).crossJoin(w)  # rows of one


@query("select facet, count(*) as terms, count(distinct broader) as broader, max(length(term))::bigint as longest from label_space group by facet")
def label_space_stats(spark, d):
    return table(spark, d, "label_space").groupBy("facet").agg(F.count("*").alias("terms"), F.countDistinct("broader").alias("broader"), F.max(F.length("term")).cast("long").alias("longest"))


@query(f"""with {FX}, e as (select unnest(topics) as topic from fx), c as (select topic, count(*) as n from e group by 1), r as (select *, row_number() over (order by n desc, topic) as rank, sum(n) over () as total, sum(n) over (order by n desc, topic rows unbounded preceding) as upto from c) select topic, n, rank, {R6.format('upto / total')} as coverage from r where rank <= 25""")
def taxonomy_coverage(spark, d):
    """The 25 most frequent topics with their rank and what share of all uses they cover together."""
    c = facets(spark, d).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    top = c.orderBy(F.desc("n"), "topic").limit(25)
    w = Window.orderBy(F.desc("n"), "topic")  # 25 rows
    return top.crossJoin(F.broadcast(total)).select("topic", "n", F.row_number().over(w).cast("long").alias("rank"), r6(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")).alias("coverage"))


def ranked_pool(df: DataFrame, size: int, by: str = "rank") -> DataFrame:
    """The first `size` rows of a ranked pool; more than it has, or fewer than one, is an error."""
    if size < 1:
        raise ValueError("size must be at least 1")
    n = df.limit(size).count()
    if n < size:
        raise ValueError(f"the pool has {n} rows, {size} are wanted")
    return df.orderBy(by).limit(size)


@query("with f as (select trim(lcgft_form) as form, count(*) as n from shelf_features where trim(lcgft_form) <> '' group by 1), r as (select form, n, row_number() over (order by n desc, form) as rank from f) select form, n, rank from r where rank <= 15")
def ranked_form_pool(spark, d):
    f = table(spark, d, "shelf_features").where("trim(lcgft_form) <> ''").groupBy(F.trim("lcgft_form").alias("form")).agg(F.count("*").alias("n"))
    r = f.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "form")).cast("long"))  # distinct forms
    return ranked_pool(r, 15)


@query("""with f as (select trim(lcgft_form) as form, count(*) as n from shelf_features where trim(lcgft_form) <> '' group by 1), c as (select lower(term) as k, broader from label_space where facet = 'lcgft_form'), o as (select form, n, row_number() over (order by n desc, form) as r from f where lower(form) not in (select k from c))
select term as form, broader as category, true as curated from label_space where facet = 'lcgft_form' union all select form, null, false from o where r <= 10""")
def expanded_form_pool(spark, d):
    """The curated forms and the ten most frequent others."""
    curated = table(spark, d, "label_space").where("facet = 'lcgft_form'").select(F.col("term").alias("form"), F.col("broader").alias("category"), F.lit(True).alias("curated"))
    f = table(spark, d, "shelf_features").where("trim(lcgft_form) <> ''").groupBy(F.trim("lcgft_form").alias("form")).agg(F.count("*").alias("n"))
    other = f.join(F.broadcast(curated.select(F.lower("form").alias("k"))), F.lower("form") == F.col("k"), "left_anti")  # a small label space
    return curated.unionByName(other.orderBy(F.desc("n"), "form").limit(10).select("form", F.lit(None).cast("string").alias("category"), F.lit(False).alias("curated")))


# Places

PLACES = "g as (select rec_no, trim(lower(x)) as k, pos from (select rec_no, unnest(geographic) as x, generate_subscripts(geographic, 1) as pos from shelf_features)), j as (select g.*, region_name from g left join place_regions p on lower(p.place) = g.k)"


def _regions(spark, d):
    """(rec_no, pos, key, region): each place of a row with its region, null where it is not known."""
    p = F.broadcast(table(spark, d, "place_regions").select(F.lower("place").alias("k"), F.col("region_name").alias("region")))  # a fixed table of dozens
    g = table(spark, d, "shelf_features").select("rec_no", F.posexplode("geographic").alias("pos", "x")).select("rec_no", "pos", F.trim(F.lower("x")).alias("k"))
    return g.join(p, "k", "left")


@query(f"with {PLACES}, m as (select rec_no, arg_min(region_name, pos) filter (where region_name is not null) as first, list_sort(list(distinct region_name) filter (where region_name is not null)) as every from j group by 1) select rec_no, first as first_region, case when len(every) = 1 then every[1] end as only_region, array_to_string(every, '|') as all_regions from m where first is not null")
def region_policies(spark, d):
    """The region of a row under each policy: the first, the only one, all of them."""
    m = _regions(spark, d).where("region is not null").groupBy("rec_no").agg(F.min_by("region", "pos").alias("first_region"), F.sort_array(F.collect_set("region")).alias("r"))  # the places of one row
    return m.select("rec_no", "first_region", F.when(F.size("r") == 1, F.col("r")[0]).alias("only_region"), F.array_join("r", "|").alias("all_regions"))


@query(f"with {PLACES}, r as (select distinct rec_no, region_name as a from j where region_name is not null) select x.a as region_a, y.a as region_b, count(*) as n from r x join r y on x.rec_no = y.rec_no and x.a < y.a group by 1, 2")
def region_pairs(spark, d):
    """How often two regions stand in one row; the pairs are made within the row."""
    m = _regions(spark, d).where("region is not null").groupBy("rec_no").agg(F.sort_array(F.collect_set("region")).alias("r")).where(F.size("r") > 1)
    two = F.flatten(F.transform("r", lambda a, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda b: F.struct(a.alias("region_a"), b.alias("region_b")))))
    return m.select(F.explode(two).alias("p")).groupBy("p.region_a", "p.region_b").agg(F.count("*").alias("n"))


@query(f"with {PLACES} select count(*) as n_places, count(region_name) as known, count(distinct k) filter (where region_name is null and k <> '') as unknown_names, count(distinct rec_no) filter (where region_name is not null) as clusterable_rows, (select count(*) from shelf_features) as n_rows from j")
def place_validation(spark, d):
    a = _regions(spark, d).agg(F.count("*").alias("n_places"), F.count("region").alias("known"), F.countDistinct(F.when(F.col("region").isNull() & (F.col("k") != ""), F.col("k"))).alias("unknown_names"), F.countDistinct(F.when(F.col("region").isNotNull(), F.col("rec_no"))).alias("clusterable_rows"))
    return a.crossJoin(table(spark, d, "shelf_features").agg(F.count("*").alias("n_rows")))  # rows of one


@query(f"with {PLACES} select k as place from j where region_name is null and k <> '' group by 1")
def unknown_places(spark, d):
    return _regions(spark, d).where("region is null and k <> ''").select(F.col("k").alias("place")).distinct()


# Authority lookup by several kinds of names, the best kind first

KINDS = f"""src as (select key, min(priority) as priority, arg_min(term, (priority, term)) as term from (select lower(term) as key, 1 as priority, term from label_space where facet = 'lcgft_form' union all select lower(term) || 's', 2, term from label_space where facet = 'lcgft_form' union all select regexp_replace(lower(term), 's$', ''), 2, term from label_space where facet = 'lcgft_form' union all select 'lcgft ' || lower(term), 3, term from label_space where facet = 'lcgft_form') group by key)"""


@query(f"with {KINDS}, v as (select lower(trim(regexp_replace(lcgft_form, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) as k, count(*) as n from shelf_features where trim(lcgft_form) <> '' group by 1) select coalesce(case priority when 1 then 'preferred' when 2 then 'number' when 3 then 'labelled' end, 'none') as matched, sum(n)::bigint as n_rows, count(*) as spellings from v left join src on src.key = v.k group by 1")
def lookup_by_precedence(spark, d):
    """Spellings looked up under preferred names, then singular or plural, then labelled ones; how many rows each kind finds."""
    t = table(spark, d, "label_space").where("facet = 'lcgft_form'").select("term", F.lower("term").alias("l"))
    keys = F.array(*[F.struct(k.alias("key"), F.lit(p).alias("priority")) for k, p in ((F.col("l"), 1), (F.concat("l", F.lit("s")), 2), (F.regexp_replace("l", "s$", ""), 2), (F.concat(F.lit("lcgft "), "l"), 3))])
    src = t.select("term", F.explode(keys).alias("x")).select("term", "x.*").groupBy("key").agg(F.min("priority").alias("priority"))
    v = table(spark, d, "shelf_features").where("trim(lcgft_form) <> ''").groupBy(F.lower(F.trim(F.regexp_replace("lcgft_form", r"[^\p{L}\p{N}]+", " "))).alias("key")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("priority") == 1, "preferred").when(F.col("priority") == 2, "number").when(F.col("priority") == 3, "labelled").otherwise("none")
    return v.join(F.broadcast(src), "key", "left").groupBy(kind.alias("matched")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("spellings"))  # a small label space
