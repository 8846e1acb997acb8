"""Quality gates over whole tables, and reports by generator."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.expr import r6, word_count
from corpusmill.operators import gates
from corpusmill.plans.registry import query
from corpusmill.plans.reports import WORDS
from corpusmill.plans.retrieval import R6, TOK
from corpusmill.sources.tables import table


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def _in(words):
    return ", ".join(lit(w) for w in words)


BLANK = r"not regexp_matches(coalesce({}, ''), '[^\s\x0b\x85\p{{Z}}]')"
END = r"regexp_replace(coalesce({}, ''), '[\s\x0b\x85\p{{Z}}]+$', '')"
match = lambda c, p, flags="i": f"regexp_matches({c}, {lit(f'(?{flags})' + p)})"
names = lambda c, ps, wrap="{}": "list_filter([" + ", ".join(f"case when {match(c, wrap.format(p), 'im' if k in gates.LINES else 'i')} then {lit(k)} end" for k, p in ps.items()) + "], lambda x: x is not null)"
PARSE_SQL = f"case when {BLANK.format('title')} then 'empty_title' when {BLANK.format('body')} then 'empty_body' end"
REFUSAL_SQL = f"case when {BLANK.format('body')} then ['empty_text'] else list_concat({names("coalesce(body, '')", gates.REFUSALS, chr(92) + 'b(?:{})' + chr(92) + 'b')}, {names(END.format('body'), gates.CUT_MARKS)}) end"
SELF_SQL = names("coalesce(body, '')", gates.SELF_LABELS)


def language_sql(c):
    ts = TOK.replace("{}", c)
    share = f"(len(list_filter({ts}, lambda w: w in ({_in(gates.ENGLISH_WORDS)}))) / nullif(len({ts}), 0))"
    ascii_ = f"(length(regexp_replace(coalesce({c}, ''), '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(coalesce({c}, ''), '\\P{{L}}', '', 'g')), 0))"
    return share, f"coalesce({share} >= 0.12 and {ascii_} >= 0.5, false)"


LO, HI = "target_word_range[1]", "target_word_range[2]"
DELTA_SQL = f"case when {LO} is null or {HI} is null or ({LO} = 0 and {HI} = 0) then 0 when {WORDS.format('body')} < {LO} then {WORDS.format('body')} - {LO} when {WORDS.format('body')} > {HI} then {WORDS.format('body')} - {HI} else 0 end"
SLACK_SQL = f"greatest(5.0, round_even(0.25 * greatest(coalesce({HI} - {LO}, 1), 1), 0))"
COVER_SQL = f"""case when topics is null or len(topics) = 0 then 1.0 else coalesce((select avg(case when len(ws) = 0 then 1.0 when len(list_filter(ws, lambda w: len(list_filter(seen, lambda x: starts_with(x, w))) > 0)) / len(ws) >= 0.6 then 1.0 else 0.0 end)
 from (select list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda w: length(w) >= 3 and w not in ({_in(gates.TOPIC_STOP_WORDS)})) as ws from (select unnest(topics) as t) where t is not null)), 1.0) end"""
SEEN = r"(select *, list_distinct(regexp_extract_all(lower(coalesce(body, '')), '[\p{L}\p{N}_]+')) as seen from shelf_features)"


@query(f"select rec_no, {PARSE_SQL} as reason, {PARSE_SQL} is null as passed from shelf_features")
def gate_parse(spark, d):
    reason = gates.parse_reason(F.col("title"), F.col("body"))
    return table(spark, d, "shelf_features").select("rec_no", reason.alias("reason"), reason.isNull().alias("passed"))


@query(f"select doc_id, {R6.format(language_sql('text')[0])} as share, {language_sql('text')[1]} as passed from documents")
def gate_language(spark, d):
    """Share of English function words among the words, at least 0.12, where at least half of the letters are ASCII."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", r6(gates.language_share(t)).alias("share"), gates.language_passed(t).alias("passed"))


@query(f"select rec_no, ({DELTA_SQL})::bigint as delta, abs({DELTA_SQL}) <= {SLACK_SQL} as passed from shelf_features")
def gate_length(spark, d):
    lo, hi = F.get("target_word_range", F.lit(0)), F.get("target_word_range", F.lit(1))
    delta = gates.length_delta(word_count(F.col("body")), lo, hi)
    return table(spark, d, "shelf_features").select("rec_no", delta.cast("long").alias("delta"), (F.abs(delta) <= gates.length_slack(lo, hi)).alias("passed"))


@query(f"select rec_no, len({REFUSAL_SQL}) > 0 as refusal, len({SELF_SQL}) > 0 as self_label from shelf_features")
def gate_refusal_self_label(spark, d):
    """refusal: a refusing phrase, a mark of truncation, or no text; self_label: a phrase that names the text's own category."""
    b = F.col("body")
    return table(spark, d, "shelf_features").select("rec_no", (F.size(gates.refusal_reasons(b)) > 0).alias("refusal"), (F.size(gates.self_label_names(b)) > 0).alias("self_label"))


STRUCTURE_SQL = r"regexp_replace(coalesce(body, ''), '[\s\x0b\x85\p{Z}*_`|>#~]+$', '')"


@query(f"""select rec_no, array_to_string({REFUSAL_SQL}, ',') as reasons, {WORDS.replace('{}', STRUCTURE_SQL)} >= 15 and instr({lit(gates.SENTENCE_END)}, right({STRUCTURE_SQL}, 1)) = 0 as no_sentence_end from shelf_features""")
def gate_refusal(spark, d):
    """Every refusing phrase and mark of truncation by name; a missing end of sentence is recorded only."""
    b = F.col("body")
    return table(spark, d, "shelf_features").select("rec_no", F.array_join(gates.refusal_reasons(b), ",").alias("reasons"), gates.no_sentence_end(b).alias("no_sentence_end"))


EXCERPTS = "list_filter([" + ", ".join("substr(regexp_extract(coalesce(body, ''), " + lit(("(?im)" if k in gates.LINES else "(?i)") + p) + ", 0), 1, 60)" for k, p in gates.SELF_LABELS.items()) + "], lambda x: x <> '')"


@query(f"select rec_no, array_to_string({SELF_SQL}, ',') as names, array_to_string({EXCERPTS}, '|') as excerpts from shelf_features where len({SELF_SQL}) > 0")
def gate_self_label(spark, d):
    b = F.col("body")
    named = table(spark, d, "shelf_features").where(F.size(gates.self_label_names(b)) > 0)
    return named.select("rec_no", F.array_join(gates.self_label_names(b), ",").alias("names"), F.array_join(gates.self_label_excerpts(b), "|").alias("excerpts"))


@query(f"select rec_no, {R6.format(COVER_SQL)} as coverage from {SEEN}")
def gate_topic_coverage(spark, d):
    return table(spark, d, "shelf_features").select("rec_no", r6(gates.topic_coverage(F.col("body"), F.col("topics"))).alias("coverage"))


QC_SQL = f"""q as (select rec_no, model, spec_id, {PARSE_SQL} is null as qc_parse, {language_sql('body')[1]} as qc_language, ({DELTA_SQL})::bigint as qc_delta, abs({DELTA_SQL}) <= {SLACK_SQL} as qc_length, len({SELF_SQL}) = 0 as qc_self_label, len({REFUSAL_SQL}) = 0 as qc_refusal, {COVER_SQL} as qc_topic_coverage from {SEEN}),
f as (select *, array_to_string(list_filter([{', '.join(f"case when not qc_{g} then '{g}' end" for g in gates.GATES)}], lambda x: x is not null), ',') as failed from q)"""


@query(f"with {QC_SQL} select rec_no, qc_parse, qc_language, qc_delta, qc_length, qc_self_label, qc_refusal, {R6.format('qc_topic_coverage')} as qc_topic_coverage, failed, failed = '' as passed from f")
def qc_flat(spark, d):
    """All gates of every row in one pass over the table."""
    q = gates.all_gates(table(spark, d, "shelf_features").select("rec_no", "title", "body", "topics", "target_word_range"))
    return q.select("rec_no", *[f"qc_{g}" for g in ("parse", "language", "delta", "length", "self_label", "refusal")], r6(F.col("qc_topic_coverage")).alias("qc_topic_coverage"), F.array_join("qc_failed", ",").alias("failed"), F.col("qc_passed").alias("passed"))


GENERATOR_SQL = "coalesce(nullif(trim(model), ''), 'unknown')"


def generator():
    """The generator of a row: its model, else 'unknown'; empty is none."""
    return F.coalesce(F.nullif(F.trim("model"), F.lit("")), F.lit("unknown"))


@query(f"with {QC_SQL} select {GENERATOR_SQL} as generator, count(*) as generated, count(*) filter (where failed = '') as retained, count(*) filter (where failed <> '') as rejected, {', '.join(f'count(*) filter (where not qc_{g}) as failed_{g}, {R6.format(f"avg(qc_{g}::int)")} as rate_{g}' for g in gates.GATES)} from f group by 1")
def qc_by_source(spark, d):
    """Rows generated, retained and rejected by generator, and failures and pass rates by gate: one aggregation, no pivot."""
    q = gates.all_gates(table(spark, d, "shelf_features").select("rec_no", "model", "title", "body", "topics", "target_word_range"))
    by = [x for g in gates.GATES for x in (F.count_if(~F.col(f"qc_{g}")).alias(f"failed_{g}"), r6(F.avg(F.col(f"qc_{g}").cast("int"))).alias(f"rate_{g}"))]
    return q.groupBy(generator().alias("generator")).agg(F.count("*").alias("generated"), F.count_if("qc_passed").alias("retained"), F.count_if(~F.col("qc_passed")).alias("rejected"), *by)


LEAK = r"""lab as (select list(distinct term) as labels from label_space where facet in ('lcc_code', 'lcgft_form') and length(term) >= 4),
tx as (select doc_id, text, ' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g') || ' ' as t from documents),
hit as (select doc_id, x from tx, (select unnest(labels) as x from lab) where contains(t, ' ' || trim(regexp_replace(lower(x), '[^\p{L}\p{N}_]+', ' ', 'g')) || ' '))"""


def _labels(spark, d):
    """All labels in one row: a bounded label space."""
    return table(spark, d, "label_space").where("facet in ('lcc_code', 'lcgft_form') and length(term) >= 4").agg(F.collect_set("term").alias("labels"))


@query(f"with {LEAK} select doc_id, array_to_string(list(x order by -length(x), x), '|') as leaked from hit group by doc_id")
def leaked_labels(spark, d):
    """Labels of the label space that stand in a text as whole words, longest first."""
    j = table(spark, d, "documents").select("doc_id", "text").crossJoin(F.broadcast(_labels(spark, d)))  # one row on the right
    return j.select("doc_id", F.array_join(gates.labels_in(F.col("text"), F.col("labels")), "|").alias("leaked")).where("leaked <> ''")


CONTEXT = r"""own as (select doc_id, coalesce(text, '') as t, regexp_escape(lcgft_form) as l from documents where trim(lcgft_form) <> '')"""


@query(rf"""with {CONTEXT} select doc_id from own where regexp_matches(t, '(?im)(?:^|[\n(\[])\s*(?:' || l || ')\s*[)\]]?\s*[:—-]') or regexp_matches(t, '(?im)(?:category|genre|form|class|type|subject)\s*[:=]\s*' || l) or regexp_matches(t, '(?im)\((?:lcgft|lcc|lcsh)\s*[:=]?\s*' || l)""")
def labels_in_labelling_context(spark, d):
    """Documents that use their own form's name as a label: before a colon, after "genre:" or in "(LCGFT ...)"."""
    q = F.concat(F.lit("\\Q"), "lcgft_form", F.lit("\\E"))
    t = F.coalesce("text", F.lit(""))
    three = F.concat(F.lit(r"(?im)(?:^|[\n(\[])\s*(?:"), q, F.lit(r")\s*[)\]]?\s*[:—-]|(?:category|genre|form|class|type|subject)\s*[:=]\s*"), q, F.lit(r"|\((?:lcgft|lcc|lcsh)\s*[:=]?\s*"), q)
    return table(spark, d, "documents").where("trim(lcgft_form) <> ''").where(F.rlike(t, three)).select("doc_id")


@query()
def sanitized_descriptions(spark, d):
    """Texts without the labels they leak, longest first, with what was left over cleaned; checked against a plain version in the tests."""
    j = table(spark, d, "documents").select("doc_id", "text").crossJoin(F.broadcast(_labels(spark, d)))  # one row on the right
    return j.where(F.size(gates.labels_in(F.col("text"), F.col("labels"))) > 0).select("doc_id", gates.without_labels(F.col("text"), F.col("labels")).alias("text"))
