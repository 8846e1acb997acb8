"""Projections and predicates over whole tables: normal forms, codes, keys, first reasons, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import fields as X
from corpusmill.functions.expr import r6, word_count
from corpusmill.plans.registry import query
from corpusmill.plans.reports import WORDS
from corpusmill.plans.retrieval import R6
from corpusmill.sources.tables import table


def records(spark, d):
    return table(spark, d, "shelf_features")


@query("select register, count(*) as n from shelf_features where split in ('dev', 'test') and register = 'formal' group by 1")
def filtered_rows(spark, d):
    return X.filter_by(records(spark, d), {"split": ["dev", "test"], "register": "formal", "no_such_field": 1}).groupBy("register").agg(F.count("*").alias("n"))


@query("select case when trim(coalesce(text, body, title)) is not null and trim(coalesce(text, body, title)) <> '' then 'kept' else 'dropped' end as side, count(*) as n from shelf_features group by 1")
def text_fallback(spark, d):
    """Text, else body, else title; rows without any are dropped from evaluation."""
    s = records(spark, d)
    t = F.trim(X.text_or(s, "text", "body", "title"))
    return s.groupBy(F.when(F.coalesce(t, F.lit("")) != "", "kept").otherwise("dropped").alias("side")).agg(F.count("*").alias("n"))


@query("""select sum(length(coalesce(title, '')))::bigint as title_chars, sum(coalesce(word_count, 0))::bigint as words, sum(len(list_filter(coalesce(topics, []), lambda x: x is not null)))::bigint as topics, count(*) filter (where thinking_budget <> -1) as budgets, sum(case when len(target_word_range) = 2 then target_word_range[2] else 0 end)::bigint as most_words, floor(sum(coalesce(token_multiplier, 1)) * 1e3 + 0.5) / 1e3 as multipliers, count(*) as n from shelf_features""")
def normal_documents(spark, d):
    """The fixed schema of all documents, summed up."""
    n = X.normal_document(records(spark, d))
    return n.agg(F.sum(F.length("title")).alias("title_chars"), F.sum("word_count").alias("words"), F.sum(F.size("topics")).alias("topics"), F.count("thinking_budget").alias("budgets"), F.sum(F.col("target_word_range")[1]).alias("most_words"), (F.floor(F.sum(F.col("token_multiplier").cast("double")) * 1e3 + 0.5) / 1e3).alias("multipliers"), F.count("*").alias("n"))


@query("select 'split=' || coalesce(split, 'none') || '|audience=' || coalesce(audience, 'none') || '|branch=unknown' as stratum, count(*) as n from shelf_features group by 1")
def strata_keys(spark, d):
    s = records(spark, d)
    return s.groupBy(X.strata_key(s, ["split", "audience", "branch"]).alias("stratum")).agg(F.count("*").alias("n"))


@query("""select x.field, count(*) as n_values, count(distinct x.v) as different from (select 'topics' as field, unnest(topics) as v from shelf_features union all select 'register', register from shelf_features) x where v is not null and v <> '' group by 1""")
def list_values(spark, d):
    """Scalars and lists read alike, as lists of non-empty values."""
    s = records(spark, d)
    named = lambda f: F.transform(X.as_list(s, f), lambda v: F.struct(F.lit(f).alias("field"), v.alias("v")))
    rows = F.concat(named("topics"), named("register"))
    return s.select(F.explode(rows).alias("x")).groupBy("x.field").agg(F.count("*").alias("n_values"), F.countDistinct("x.v").alias("different"))


@query(r"select rec_no, trim(regexp_replace(coalesce(title, ''), '^(?:\s*#+\s*|\s*[Tt]itle\s*:\s*){1,3}', '')) as title, regexp_replace(lower(trim(coalesce(model, ''))), '^[^/]*/', '') as model from shelf_features")
def bare_titles(spark, d):
    """Titles without marks of headings, models without the hub before them."""
    return records(spark, d).select("rec_no", X.title_bare(F.col("title")).alias("title"), F.regexp_replace(F.lower(F.trim(F.coalesce("model", F.lit("")))), r"^[^/]*/", "").alias("model"))


@query(r"""with y as (select try_cast(nullif(regexp_extract(title, '([0-9]{4})$', 1), '') as int) as y from shelf_features) select ((y - 1) // 100 * 100 + 1)::varchar || '-' || ((y - 1) // 100 * 100 + 100)::varchar as century, count(*) as n, min(y)::bigint as least, max(y)::bigint as most from y where y is not null group by 1""")
def centuries(spark, d):
    """Titles that end with a year, by century."""
    y = X.year_of(F.regexp_extract("title", r"([0-9]{4})$", 1))
    return records(spark, d).select(y.alias("y")).where("y is not null").groupBy(X.century(F.col("y")).alias("century")).agg(F.count("*").alias("n"), F.min("y").cast("long").alias("least"), F.max("y").cast("long").alias("most"))


@query(r"with l as (select upper(regexp_extract(trim(coalesce(lcc_code, '')), '^([A-Za-z]+)', 1)) as l from shelf_features) select case when length(l) between 1 and 3 then l end as letters, count(*) as n from l group by 1")
def class_letters(spark, d):
    return records(spark, d).groupBy(X.class_letters(F.col("lcc_code")).alias("letters")).agg(F.count("*").alias("n"))


@query("with p as (select regexp_split_to_array(rtrim(coalesce(lcc_uri, ''), '/'), '[/:]') as p from shelf_features) select p[-2] as type, p[-1] as id, count(*) as n from p where len(p) >= 2 group by 1, 2")
def authorities(spark, d):
    return records(spark, d).select(X.authority(F.col("lcc_uri")).alias("a")).where("a is not null").groupBy("a.type", "a.id").agg(F.count("*").alias("n"))


CODES = r"""c as (select upper(regexp_extract(trim(coalesce(lcc_code, '')), '^([A-Za-z]{1,3})', 1)) as p, target_word_range[1] as lo, target_word_range[2] as hi from shelf_features), r as (select p as prefix, lo::bigint as lo, hi::bigint as hi, (hi - lo)::bigint as span, p || lo || '-' || p || hi as code from c where p <> '' and lo is not null and hi is not null)"""


@query(f"with {CODES} select prefix, max(span) as span, arg_max(code, (span, code)) as widest from r group by prefix")
def widest_ranges(spark, d):
    """Codes such as Q50-Q100, built of class and word range, read back; the widest of each prefix."""
    c = records(spark, d).select(F.upper(F.regexp_extract(F.trim(F.coalesce("lcc_code", F.lit(""))), r"^([A-Za-z]{1,3})", 1)).alias("p"), F.get("target_word_range", F.lit(0)).alias("lo"), F.get("target_word_range", F.lit(1)).alias("hi")).where("p <> '' and lo is not null and hi is not null")
    code = F.concat("p", F.col("lo").cast("string"), F.lit("-"), "p", F.col("hi").cast("string"))
    r = c.select(code.alias("code")).select("code", X.code_range(F.col("code")).alias("r")).where("r is not null")
    return r.groupBy("r.prefix").agg(F.max("r.span").alias("span"), F.max_by("code", F.struct("r.span", "code")).alias("widest"))


BILLIONS = r"try_cast(nullif(regexp_extract(lower(model), '(?:^|[^a-z0-9.])(\d+(?:\.\d+)?)b(?:$|[^a-z0-9])', 1), '') as double)"


@query(f"with b as (select {BILLIONS} as b from shelf_features) select case when b is null then 'unknown' when b < 1 then 'tiny' when b < 4 then 'small' when b < 15 then 'medium' when b < 80 then 'large' else 'frontier' end as size, count(*) as n, min(b) as least, max(b) as most from b group by 1")
def size_categories(spark, d):
    b = records(spark, d).select(X.billions(F.col("model")).alias("b"))
    return b.groupBy(X.size_category(F.col("b")).alias("size")).agg(F.count("*").alias("n"), F.min("b").alias("least"), F.max("b").alias("most"))


LADDER = f"case when trim(coalesce(body, '')) = '' then 'no_body' when coalesce(trim(title), '') in ('', 'None') then 'no_title' when coalesce(lcc_code, '') = '' then 'no_class' when coalesce(len(topics), 0) = 0 then 'no_topics' when {WORDS.format('body')} < 20 then 'too_short' when {WORDS.format('body')} > 2000 then 'too_long' end"


def _ladder():
    words, topics = word_count(F.col("body")), F.when(F.col("topics").isNull(), 0).otherwise(F.size("topics"))
    return [("no_body", F.trim(F.coalesce("body", F.lit(""))) == ""), ("no_title", F.coalesce(F.trim("title"), F.lit("")).isin("", "None")), ("no_class", F.coalesce("lcc_code", F.lit("")) == ""), ("no_topics", topics == 0), ("too_short", words < 20), ("too_long", words > 2000)]


@query(f"select coalesce({LADDER}, 'eligible') as reason, count(*) as n from shelf_features group by 1")
def eligibility(spark, d):
    """The first reason for which a row can't be used."""
    return records(spark, d).groupBy(F.coalesce(X.first_reason(_ladder()), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


VALID = f"list_filter([case when id is null or id = '' then 'id' end, case when trim(coalesce(body, '')) = '' then 'body' end, case when coalesce(word_count, 0) > 0 and abs(word_count - {WORDS.format('body')}) > 5 then 'word_count' end, case when coalesce(split, '') not in ('train', 'dev', 'test') then 'split' end, case when temperature not between 0 and 2 then 'temperature' end], lambda x: x is not null)"


@query(f"select rec_no, array_to_string({VALID}, ',') as errors from shelf_features where len({VALID}) > 0")
def record_errors(spark, d):
    """All that is wrong with a row, by name."""
    n = word_count(F.col("body"))
    rules = [("id", F.coalesce("id", F.lit("")) == ""), ("body", F.trim(F.coalesce("body", F.lit(""))) == ""), ("word_count", (F.coalesce("word_count", F.lit(0)) > 0) & (F.abs(F.col("word_count") - n) > 5)), ("split", ~F.coalesce("split", F.lit("")).isin("train", "dev", "test")), ("temperature", ~F.col("temperature").between(0, 2))]
    return records(spark, d).select("rec_no", X.all_reasons(rules).alias("e")).where(F.size("e") > 0).select("rec_no", F.array_join("e", ",").alias("errors"))


@query("""with i as (select count(*) as n from shelf_features where id is not null group by id having count(*) > 1), t as (select count(*) as n from shelf_features where body is not null group by sha256(body) having count(*) > 1)
select 'id' as kind, count(*) as groups, coalesce(sum(n), 0)::bigint as n_rows from i union all select 'text', count(*), coalesce(sum(n), 0)::bigint from t""")
def duplicate_warnings(spark, d):
    """Repeated ids and texts of a slice, both from one grouping."""
    s = records(spark, d)
    keys = F.array(F.struct(F.lit("id").alias("kind"), F.col("id").alias("k")), F.struct(F.lit("text").alias("kind"), F.sha2("body", 256).alias("k")))
    g = s.select(F.explode(keys).alias("x")).where("x.k is not null").groupBy("x.kind", "x.k").agg(F.count("*").alias("n"))
    twice = F.col("n") > 1
    return g.groupBy("kind").agg(F.count_if(twice).alias("groups"), F.sum(F.when(twice, F.col("n")).otherwise(0)).alias("n_rows"))


@query("select source_type, count(*) as n from shelf_features group by 1")
def single_source_type(spark, d):
    """Counts by type of source, of a slice that has one only; several are refused."""
    return X.refuse_to_pool(records(spark, d)).groupBy("source_type").agg(F.count("*").alias("n"))


@query("with t as (select x, count(*) as n from (select trim(unnest(topics)) as x from shelf_features) where x <> '' group by 1), s as (select sum(n) as total from t) select x as term, n as frequency from t where n >= 20")
def frequent_terms(spark, d):
    return records(spark, d).select(F.explode("topics").alias("t")).select(F.trim("t").alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("frequency")).where("frequency >= 20")


HEAD = "list_filter(list_transform(coalesce(topics, []), lambda h: trim(split_part(h, ' -- ', 1))), lambda x: x is not null and x <> '')"


@query(f"with h as (select rec_no, {HEAD} as m from shelf_features), u as (select rec_no, list_filter(list_transform(m, lambda x, i: case when list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i then x end), lambda x: x is not null) as m from h) select rec_no, array_to_string(m, '|') as headings from u where len(m) > 0")
def main_headings(spark, d):
    return records(spark, d).select("rec_no", X.main_headings(F.col("topics")).alias("m")).where(F.size("m") > 0).select("rec_no", F.array_join("m", "|").alias("headings"))


#: Own values: words that tell an audience in topics.
MARKERS = {"law": "jurists", "ecology": "naturalists", "erosion": "naturalists", "stage": "players", "museum": "curators"}


@query("select coalesce(" + ", ".join(f"case when contains(t, '{m}') then '{v}' end" for m, v in MARKERS.items()) + ", 'general') as audience, count(*) as n from (select lower(array_to_string(coalesce(topics, []), ' | ')) as t from shelf_features) group by 1")
def audiences_by_marker(spark, d):
    return records(spark, d).groupBy(X.by_marker(F.col("topics"), MARKERS, "general").alias("audience")).agg(F.count("*").alias("n"))


@query("select coalesce(extra->>'$.retry', '0') as retry, count(*) as n, floor(sum(coalesce(cost_usd, 0)) * 1e6 + 0.5) / 1e6 as cost from cost_ledger group by 1")
def nested_values(spark, d):
    """A value by its path in a JSON field, with a fallback."""
    l = table(spark, d, "cost_ledger")  # noqa: E741
    return l.groupBy(F.coalesce(F.get_json_object("extra", "$.retry"), F.lit("0")).alias("retry")).agg(F.count("*").alias("n"), r6(F.sum(F.coalesce("cost_usd", F.lit(0.0)))).alias("cost"))


@query(f"select rec_no, {R6.format('temperature')} as temperature, coalesce(nullif(trim(model_resolved), ''), nullif(trim(model), ''), 'unknown') as generator from shelf_features")
def resolved_generators(spark, d):
    """The model as resolved, else as asked for, else unknown."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return records(spark, d).select("rec_no", r6(F.col("temperature").cast("double")).alias("temperature"), F.coalesce(blank("model_resolved"), blank("model"), F.lit("unknown")).alias("generator"))
