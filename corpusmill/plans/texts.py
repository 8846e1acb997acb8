"""Tokens, sentences, envelopes, masking and passages over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.expr import r6, tokens
from corpusmill.operators.gates import TOPIC_STOP_WORDS, topic_words
from corpusmill.operators.lexical import document_frequencies, token_table
from corpusmill.plans.evaluation import SETS
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import POST, R6, TOK
from corpusmill.sources.tables import table

WS = r"[ \t\n\x0B\f\r]+"
SIMPLE = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{L}\p{N}_]+')"
ALPHA = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{L}\p{Nl}\p{No}]+')"
TRIM = rf"regexp_replace({{}}, '^{WS}|{WS}$', '', 'g')"
WORDS_SQL = f"list_filter(regexp_split_to_array(coalesce({{}}, ''), '{WS}'), lambda x: x <> '')"


def docs(spark, d):
    return table(spark, d, "documents")


@query(f"select doc_id, len({SIMPLE.replace('{}', 'text')})::bigint as simple, len({ALPHA.replace('{}', 'text')})::bigint as alpha, len({TOK.replace('{}', 'text')})::bigint as normalised, len(list_filter({TOK.replace('{}', 'text')}, lambda x: length(x) >= 3))::bigint as of_three from documents")
def token_variants(spark, d):
    """Tokens of a text under each tokenizer."""
    t = F.col("text")
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return docs(spark, d).select("doc_id", n(T.simple_tokens(t), "simple"), n(T.alpha_tokens(t), "alpha"), n(tokens(t), "normalised"), n(tokens(t, 3), "of_three"))


@query(f"with {POST}, v as (select term from (select term, sum(tf) as cf from post group by term having sum(tf) >= 2) order by cf desc, term limit 500) select doc as doc_id, sum(tf)::bigint as tokens, coalesce(sum(tf) filter (where term in (select term from v)), 0)::bigint as known, count(*) filter (where term in (select term from v)) as types from post group by doc")
def vocabulary_encoding(spark, d):
    """Tokens of each text inside a fitted vocabulary of 500 terms seen twice at least; the others are unknown."""
    t = token_table(docs(spark, d), "doc_id", "text")
    v = document_frequencies(t).where("cf >= 2").orderBy(F.desc("cf"), "term").limit(500).agg(F.collect_set("term").alias("v"))
    known = F.filter("ts", lambda w: F.array_contains("v", w))
    return t.where("dl > 0").crossJoin(F.broadcast(v)).select(F.col("doc").alias("doc_id"), F.col("dl").alias("tokens"), F.size(known).cast("long").alias("known"), F.size(F.array_distinct(known)).cast("long").alias("types"))  # one row of 500 terms


@query(f"with t as (select doc_id, {TOK.replace('{}', 'text')} as ts from documents) select doc_id, len(list_distinct(ts))::bigint as unigrams, case when len(ts) < 2 then 0 else len(list_distinct([array_to_string(ts[i:i+1], ' ') for i in range(1, len(ts))])) end::bigint as bigrams from t")
def ngram_counts(spark, d):
    bound = F.transform(F.array(tokens(F.col("text"))), lambda w: F.struct(F.size(F.array_distinct(w)).cast("long").alias("u"), F.size(F.array_distinct(T.ngrams(w, 2))).cast("long").alias("b")))[0]
    return docs(spark, d).select("doc_id", bound.alias("x")).select("doc_id", F.col("x.u").alias("unigrams"), F.col("x.b").alias("bigrams"))


SENT = f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]){WS}', '\\1' || chr(1), 'g'), chr(1)), lambda x: {TRIM.format('x')}), lambda x: length(x) >= 3)"


@query(f"select doc_id, len({SENT})::bigint as n, coalesce(list_max(list_transform({SENT}, lambda x: length(x))), 0)::bigint as longest from documents")
def sentence_counts(spark, d):
    s = T.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


PARA = rf"list_filter(list_transform(regexp_split_to_array(coalesce(body, ''), '\n[ \t\f\r]*\n+'), lambda x: {TRIM.format('x')}), lambda x: length(x) >= 10)"


@query(f"select rec_no, len({PARA})::bigint as n, coalesce(list_sum(list_transform({PARA}, lambda x: length(trim(regexp_replace(x, '{WS}', ' ', 'g'))))), 0)::bigint as unwrapped_chars from shelf_features")
def blank_line_paragraphs(spark, d):
    """Paragraphs between blank lines, with hard-wrapped lines joined."""
    p = table(spark, d, "shelf_features").select("rec_no", T.paragraphs(F.col("body")).alias("p"))
    return p.select("rec_no", F.size("p").cast("long").alias("n"), F.aggregate(F.transform("p", lambda x: F.length(T.unwrap(x))), F.lit(0), lambda a, x: a + x).cast("long").alias("unwrapped_chars"))


@query()
def sentence_segments(spark, d):
    """Sentences with their places; checked in the tests against the text itself."""
    return T.segments(docs(spark, d), "doc_id", "text")


@query()
def chunk_passages(spark, d):
    """Passages of about 400 words, three of each text at most, evenly spaced."""
    return T.chunk_passages(docs(spark, d), "doc_id", "text").drop("passage")


TEXT = "coalesce(text, '')"
ENV = f"(select doc_id, {TRIM.format(TEXT)} as t from documents)"


@query(rf"select doc_id, trim(regexp_replace(case when instr(t, chr(10)) > 0 then substr(t, 1, instr(t, chr(10)) - 1) else t end, '^(?i)title[: ]\s*', '')) as title, case when instr(t, chr(10)) > 0 then length(regexp_replace(substr(t, instr(t, chr(10)) + 1), '^{WS}', '')) else 0 end::bigint as body_chars from {ENV}")
def envelopes(spark, d):
    """Title and body of a text, by its first line."""
    e = docs(spark, d).select("doc_id", T.envelope(F.col("text")).alias("e"))
    return e.select("doc_id", "e.title", F.length("e.body").cast("long").alias("body_chars"))


@query(f"select doc_id, md5(array_to_string({WORDS_SQL.format('text')}[1:64], ' ')) as head from documents")
def first_64_words(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.first_words(F.col("text"), 64)).alias("head"))


VARIANTS = r"""list_transform(list_sort(list_transform(list_filter(list_distinct(list_concat(base, list_transform(base, lambda w: w || 's'), list_transform(base, lambda w: regexp_replace(w, 's$', '')))), lambda w: w <> ''), lambda w: {'n': -length(w), 'w': w})), lambda x: x.w)"""
LABELS = r"""lb as (select doc_id, coalesce(text, '') as text, lcgft_form as label, list_concat([lower(trim(lcgft_form))], list_filter(regexp_split_to_array(lower(trim(lcgft_form)), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 5)) as base from documents),
vr as (select *, """ + VARIANTS + r""" as variants from lb),
mk as (select doc_id, text, case when trim(coalesce(label, '')) <> '' then regexp_replace(text, '(?i)\b(' || array_to_string(list_transform(variants, lambda w: regexp_replace(w, '([^\p{L}\p{N} ])', '\\\1', 'g')), '|') || ')\b', ' ', 'g') else text end as new from vr),
ms as (select doc_id, text, array_to_string(""" + WORDS_SQL.format("new") + r""", ' ') as masked, len(""" + WORDS_SQL.format("text") + ") - len(" + WORDS_SQL.format("new") + ") as removed from mk)"""


def _masked(spark, d):
    return docs(spark, d).select("doc_id", "text", T.masked(F.col("text"), F.col("lcgft_form")).alias("m")).select("doc_id", "text", F.col("m.text").alias("masked"), F.col("m.removed").alias("removed"))


@query(f"with {LABELS} select doc_id, md5(masked) as masked, removed::bigint as removed from ms")
def masked_texts(spark, d):
    """Texts without the words of their own form; the masked text is compared by its md5."""
    return _masked(spark, d).select("doc_id", F.md5("masked").alias("masked"), F.col("removed").cast("long").alias("removed"))


@query(f"""with {LABELS}, e as (select doc_id, removed, unnest({WORDS_SQL.format('text')}) as w, generate_subscripts({WORDS_SQL.format('text')}, 1) as i from ms), r as (select *, row_number() over (partition by doc_id order by ('0x' || substr(md5(doc_id || '|' || i), 1, 15))::bigint, i) as r from e)
select doc_id, md5(string_agg(w, ' ' order by i)) as sham, count(*) as kept from r where r > removed group by doc_id""")
def sham_texts(spark, d):
    """Texts without as many words as masking took, drawn by hash."""
    m = _masked(spark, d).select("doc_id", T.sham(F.col("text"), F.col("doc_id"), F.col("removed")).alias("s"))
    return m.select("doc_id", F.md5("s").alias("sham"), F.size(T.words_of(F.col("s"))).cast("long").alias("kept")).where("kept > 0")


@query(f"with {LABELS} select count(*) as n, {R6.format('avg((removed > 0)::int)')} as share_touched, {R6.format('avg(removed)')} as mean_removed, max(removed)::bigint as most_removed from ms")
def masking_audit(spark, d):
    m = _masked(spark, d)
    return m.agg(F.count("*").alias("n"), r6(F.avg((F.col("removed") > 0).cast("int"))).alias("share_touched"), r6(F.avg("removed")).alias("mean_removed"), F.max("removed").cast("long").alias("most_removed"))


@query(rf"select facet, term, array_to_string({VARIANTS}, '|') as variants from (select facet, term, list_concat([lower(trim(term))], list_filter(regexp_split_to_array(lower(trim(term)), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 5)) as base from label_space)")
def label_variants(spark, d):
    return table(spark, d, "label_space").select("facet", "term", F.array_join(T.label_variants(F.col("term")), "|").alias("variants"))


NORM = r"trim(regexp_replace(lower(term), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query(f"select facet, term, {NORM} as normal, case when {NORM} like '%ies' then regexp_replace({NORM}, 'ies$', 'y') when {NORM} like '%s' then regexp_replace({NORM}, 's$', '') when {NORM} like '%y' then regexp_replace({NORM}, 'y$', 'ies') else {NORM} || 's' end as other from label_space")
def singular_plural(spark, d):
    return table(spark, d, "label_space").select("facet", "term", T.singular_plural(F.col("term")).alias("x")).select("facet", "term", F.col("x")[0].alias("normal"), F.col("x")[1].alias("other"))


SIGNAL = f"sg as (select rec_no, lower(coalesce(body, '')) as b, topic from (select rec_no, body, unnest({SETS.format('topics')}) as topic from shelf_features))"


@query(f"with {SIGNAL} select topic, count(*) as n, {R6.format('avg(contains(b, topic)::int)')} as share_verbatim from sg group by topic")
def surface_signal(spark, d):
    """How often a topic stands in the texts that carry it, letter by letter."""
    from corpusmill.functions.expr import facet_set

    e = table(spark, d, "shelf_features").select(F.lower(F.coalesce("body", F.lit(""))).alias("b"), F.explode(facet_set(F.col("topics"))).alias("topic"))
    return e.groupBy("topic").agg(F.count("*").alias("n"), r6(F.avg(F.contains("b", "topic").cast("int"))).alias("share_verbatim"))


SIG = rf"list_filter({ALPHA.replace('{}', 'title')}, lambda w: length(w) >= 3 and w not in ({', '.join(repr(w) for w in TOPIC_STOP_WORDS)}))"

OVERLAP = f"len(list_intersect({SIG}, {ALPHA.replace('{}', 'body')})) / len(list_distinct({SIG}))"


@query(f"select rec_no, {R6.format(OVERLAP)} as overlap from shelf_features where len({SIG}) > 0")
def title_body_overlap(spark, d):
    """Share of a title's telling words that its body has."""
    s = table(spark, d, "shelf_features").select("rec_no", F.array_distinct(topic_words(F.coalesce("title", F.lit("")))).alias("t"), T.alpha_tokens(F.col("body")).alias("b")).where(F.size("t") > 0)
    return s.select("rec_no", r6(F.size(F.array_intersect("t", "b")) / F.size("t")).alias("overlap"))


DROP = rf"""(select rec_no, lower(trim(coalesce(title, ''))) as tt, {PARA} as ps from shelf_features)"""


@query(f"select rec_no, len(ps)::bigint as n, len(list_filter(ps, lambda p: lower(trim(regexp_replace(p, '{WS}', ' ', 'g'))) <> tt))::bigint as kept from {DROP}")
def without_title_paragraphs(spark, d):
    """Paragraphs that repeat the title are dropped."""
    p = table(spark, d, "shelf_features").select("rec_no", F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("tt"), T.paragraphs(F.col("body")).alias("ps"))
    return p.select("rec_no", F.size("ps").cast("long").alias("n"), F.size(F.filter("ps", lambda x: F.lower(T.unwrap(x)) != F.col("tt"))).cast("long").alias("kept"))


@query(f"""with t as (select doc_id, source, len({TOK.replace('{}', 'text')}) as n from documents) select source, count(*) as docs, {R6.format('median(n)')} as median, {R6.format('quantile_cont(n, 0.9)')} as p90, {R6.format('avg((n > 512)::int)')} as share_over, {R6.format('sum(least(n, 512)) / nullif(sum(n), 0)')} as tokens_kept from t group by source""")
def truncation_by_source(spark, d):
    """Token lengths by source, the share of texts over a cap and of tokens kept under it."""
    t = docs(spark, d).select("source", F.size(tokens(F.col("text"))).cast("long").alias("n"))
    return t.groupBy("source").agg(F.count("*").alias("docs"), r6(F.percentile("n", 0.5)).alias("median"), r6(F.percentile("n", 0.9)).alias("p90"), r6(F.avg((F.col("n") > 512).cast("int"))).alias("share_over"), r6(F.try_divide(F.sum(F.least("n", F.lit(512))), F.sum("n"))).alias("tokens_kept"))
