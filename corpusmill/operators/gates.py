"""Quality gates of a document as column expressions; each gives what it measured and why it failed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.expr import tokens, word_count

#: English function words, the share of them that English text has, and the share of ASCII letters.
ENGLISH_WORDS = "the a an and or but if of to in on for with as by at from is are was were be been being this that these those it its he she they we you i his her their our your not no so than then which who whom whose what when where why how all any some most more less can could will would shall should may might must do does did has have had into through about between among over under after before during without within against up down out off also only just there here such other same each both few many much".split()
ENGLISH_SHARE, ASCII_SHARE = 0.12, 0.5
#: Phrases of refusals, each with the name under which it is reported.
REFUSALS = {
    "cannot_help": r"i can(?:not|'t) (?:help|assist|comply|fulfill|provide)",
    "sorry_but": r"i'?m sorry,? but",
    "as_an_ai": r"as an ai",
    "as_an_ai_language_model": r"as an ai language model",
    "as_a_large_language_model": r"as a large language model",
    "no_ability": r"i do not have the ability to",
    "not_able": r"i am not able to",
    "will_not_be_able": r"i won'?t be able to",
    "unable_to_do_this": r"unable to (?:fulfill|complete|assist with) (?:this|that) request",
    "must_decline": r"i must decline",
    "content_policy": r"against (?:my|the) content policy",
    "am_an_ai": r"i'?m (?:just )?an ai",
}
#: Marks of truncation.
CUT_MARKS = {"truncated_mark": r"\[(?:content )?truncated\]", "control_token": r"<\|[^|]*\|>", "ellipsis": r"\.\.\.\s*$"}
#: Phrases by which a text names its own category.
SELF_LABELS = {
    "vocabulary": r"\b(?:lcgft|lcsh|lcdgt|lcc)\s*[)\]]?\s*:",
    "heading": r"^\s*(?:document\s+type|subject\s+area|category|genre)\s*:",
    "field_of": r"\bin the field of\b",
    "this_text_explores": r"\bthis (?:satire|lecture|poem|essay|report|guide|article|document)\b[^.]{0,40}\b(?:explores|covers|examines|presents)\b",
    "in_law": r"^\s*(?:in|within)\s+(?:political science|medicine|law|philosophy|economics|sociology)\s*,",
}
LINES = ("heading", "in_law")  # those that begin a line
#: Words that say nothing of a topic, how long a word must be, what share of a topic's words covers it.
TOPIC_STOP_WORDS, TOPIC_WORD, TOPIC_COVERED = "a an and of the in on for to with as by at from or".split(), 3, 0.6
SENTENCE_END, STRUCTURE = ".!?\"'”’)]}:;,", "*_`|>#~ \\t"
GATES = ("parse", "language", "length", "self_label", "refusal")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return ~_text(c).rlike(r"(?U)\S")


def parse_reason(title: Column, body: Column) -> Column:
    """empty_title, empty_body, or null where both are there."""
    return F.when(is_blank(title), "empty_title").when(is_blank(body), "empty_body")


def language_share(text: Column) -> Column:
    """Share of English function words among the words; null without words."""
    ts = tokens(text)
    return F.transform(F.array(ts), lambda x: F.when(F.size(x) > 0, F.size(F.filter(x, lambda w: w.isin(ENGLISH_WORDS))) / F.size(x)))[0]


def ascii_share(text: Column) -> Column:
    letters = F.length(F.regexp_replace(_text(text), r"\P{L}", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(_text(text), r"[^A-Za-z]", "")) / letters)


def language_passed(text: Column) -> Column:
    return F.coalesce((language_share(text) >= ENGLISH_SHARE) & (ascii_share(text) >= ASCII_SHARE), F.lit(False))


def length_delta(words: Column, lo: Column, hi: Column) -> Column:
    """Words below (negative) or above the range; 0 within it, and where there is no range (null or 0 to 0)."""
    none = lo.isNull() | hi.isNull() | ((lo == 0) & (hi == 0))
    return F.when(none, 0).when(words < lo, words - lo).when(words > hi, words - hi).otherwise(0)


def length_slack(lo: Column, hi: Column) -> Column:
    """A quarter of the range's width to the nearest whole word, halves to the even one; 5 at least."""
    return F.greatest(F.lit(5.0), F.bround(F.lit(0.25) * F.greatest(F.coalesce(hi - lo, F.lit(1)), F.lit(1))))


def _named(text: Column, patterns: dict[str, str], wrap: str = "{}") -> Column:
    """The names of the patterns that occur, in their order."""
    each = [F.when(text.rlike("(?iUm)" + wrap.format(p)) if k in LINES else text.rlike("(?iU)" + wrap.format(p)), F.lit(k)) for k, p in patterns.items()]
    return F.array_compact(F.array(*each))


def refusal_reasons(text: Column) -> Column:
    """Names of the refusing phrases and marks of truncation in a text; empty_text for none."""
    t = _text(text)
    return F.when(is_blank(t), F.array(F.lit("empty_text"))).otherwise(F.concat(_named(t, REFUSALS, r"\b(?:{})\b"), _named(F.regexp_replace(t, r"(?U)\s+$", ""), CUT_MARKS)))


def no_sentence_end(text: Column) -> Column:
    """A text of 15 words or more whose last sign, structure aside, ends no sentence; recorded only, as tables and signatures end so too."""
    core = F.rtrim(F.regexp_replace(_text(text), rf"(?U)[\s{STRUCTURE}]+$", ""))
    return (word_count(core) >= 15) & (F.instr(F.lit(SENTENCE_END), F.right(core, F.lit(1))) == 0)


def self_label_names(text: Column) -> Column:
    return _named(_text(text), SELF_LABELS)


def self_label_excerpts(text: Column, width: int = 60) -> Column:
    """The first match of each self-labelling pattern, cut to `width` characters."""
    t = _text(text)
    one = [F.substring(F.regexp_extract(t, ("(?iUm)" if k in LINES else "(?iU)") + p, 0), 1, width) for k, p in SELF_LABELS.items()]
    return F.filter(F.array(*one), lambda x: x != "")


def topic_words(topic: Column) -> Column:
    words = F.regexp_extract_all(F.lower(topic), F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) >= TOPIC_WORD) & ~w.isin(TOPIC_STOP_WORDS))


def topic_coverage(text: Column, topics: Column) -> Column:
    """Share of the topics of which the text has at least TOPIC_COVERED of the telling words, as beginnings of words; 1 without topics.

    A topic without such a word counts as covered. Recorded only: a text that shows a topic need not name it.
    """
    seen = F.array_distinct(F.regexp_extract_all(F.lower(_text(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    has = lambda ws, w: F.exists(ws, lambda x: F.startswith(x, w))
    covered = lambda ws, t: F.when(F.size(t) == 0, True).otherwise(F.size(F.filter(t, lambda w: has(ws, w))) / F.size(t) >= TOPIC_COVERED)
    parts = F.transform(F.filter(topics, lambda t: t.isNotNull()), topic_words)
    bound = F.array(F.struct(seen.alias("seen"), parts.alias("parts")))
    share = F.transform(bound, lambda s: F.try_divide(F.size(F.filter(s["parts"], lambda t: covered(s["seen"], t))), F.size(s["parts"])))[0]
    return F.when(topics.isNull() | (F.size(topics) == 0), F.lit(1.0)).otherwise(F.coalesce(share, F.lit(1.0)))


def all_gates(df: DataFrame, title: str = "title", body: str = "body", topics: str = "topics", word_range: str = "target_word_range") -> DataFrame:
    """df with qc_parse, qc_language, qc_length, qc_self_label, qc_refusal (true = passed), qc_topic_coverage (a share), qc_delta, qc_failed (the failed gates by name, in order) and qc_passed."""
    t, lo, hi = F.col(body), F.get(word_range, F.lit(0)), F.get(word_range, F.lit(1))
    delta = length_delta(word_count(t), lo, hi)
    out = df.select(
        "*", parse_reason(F.col(title), t).isNull().alias("qc_parse"), language_passed(t).alias("qc_language"), delta.cast("long").alias("qc_delta"),
        (F.abs(delta) <= length_slack(lo, hi)).alias("qc_length"), (F.size(self_label_names(t)) == 0).alias("qc_self_label"),
        (F.size(refusal_reasons(t)) == 0).alias("qc_refusal"), topic_coverage(t, F.col(topics)).alias("qc_topic_coverage"),
    )
    failed = F.array_compact(F.array(*[F.when(~F.col(f"qc_{g}"), F.lit(g)) for g in GATES]))
    return out.withColumn("qc_failed", failed).withColumn("qc_passed", reduce(lambda a, b: a & b, [F.col(f"qc_{g}") for g in GATES]))


# Leakage of labels into texts


def labels_in(text: Column, labels: Column, least: int = 4) -> Column:
    """Labels of `least` characters or more that stand in the text as whole words, whatever their case; longest first, then by name."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(_text(text)), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    flat = lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))
    found = F.filter(F.array_distinct(labels), lambda x: x.isNotNull() & (F.length(x) >= least))
    bound = F.array(F.struct(t.alias("t"), found.alias("f")))
    hits = F.transform(bound, lambda s: F.filter(s["f"], lambda x: F.contains(s["t"], flat(x))))[0]
    return F.transform(F.array_sort(F.transform(hits, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def without_labels(text: Column, labels: Column) -> Column:
    """The text without its labels, longest first, and without the punctuation and blanks that are left over."""
    bare = F.aggregate(labels_in(text, labels), _text(text), lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), x, F.lit(r"\E(?!\w)")), F.lit("")))
    for pattern, new in ((r"\(\s*\)|\[\s*\]", ""), (r"\s+([,.;:!?])", "$1"), (r"([,;:])(?:\s*[,;:])+", "$1"), (r"^[\s,;:]+", ""), (r"\s+", " ")):
        bare = F.regexp_replace(bare, pattern, new)
    return F.trim(bare)
