"""Fields as column expressions: normal forms, codes, dates, keys and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_by(df: DataFrame, wanted: dict) -> DataFrame:
    """Rows whose fields equal a value or one of a list; unknown fields are skipped, and no row left is an error (looked for in one row only)."""
    known = {k: v for k, v in wanted.items() if k in df.columns}
    out = reduce(lambda d, kv: d.where(F.col(kv[0]).isin(list(kv[1])) if isinstance(kv[1], (list, tuple, set)) else F.col(kv[0]) == kv[1]), known.items(), df)
    if known and out.isEmpty():
        raise ValueError(f"no row passes {known}")
    return out


def text_or(df: DataFrame, *names: str) -> Column:
    """The first of the columns that df has, null for null only: text, else body, else title."""
    return F.coalesce(*[F.col(c) for c in names if c in df.columns], F.lit(None).cast("string"))


def strata_key(df: DataFrame, fields: list[str]) -> Column:
    """f1=v1|f2=v2: null is none, a field that df lacks unknown."""
    parts = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("none")) if f in df.columns else F.lit("unknown")) for f in fields]
    return F.concat_ws("|", *parts)


def as_list(df: DataFrame, name: str) -> Column:
    """A list of the non-empty values of a column, be it a scalar or a list."""
    c = F.col(name) if df.schema[name].dataType.typeName() == "array" else F.array(F.col(name).cast("string"))
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def title_bare(title: Column) -> Column:
    """A title without up to three marks of headings or words "Title:" before it."""
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"^(?:\s*#+\s*|\s*[Tt]itle\s*:\s*){1,3}", ""))


def year_of(c: Column) -> Column:
    """A year of four digits at the beginning of a value, else null."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"^([0-9]{4})", 1), F.lit("")).cast("int")


def century(year: Column) -> Column:
    """1801-1900 for 1897."""
    first = F.floor((year - 1) / 100) * 100 + 1
    return F.concat_ws("-", first.cast("string"), (first + 99).cast("string"))


def class_letters(code: Column) -> Column:
    """The one to three letters that a call number begins with, in capitals; null for none or more."""
    letters = F.upper(F.regexp_extract(F.trim(F.coalesce(code, F.lit(""))), r"^([A-Za-z]+)", 1))
    return F.when(F.length(letters).between(1, 3), letters)


def agency_code(number: Column) -> Column:
    """The agency of a documents number: what stands before its first blank, colon and point."""
    return F.nullif(F.upper(F.split_part(F.rtrim(F.split_part(F.trim(F.coalesce(number, F.lit(""))), F.lit(" "), F.lit(1)), F.lit(":")), F.lit("."), F.lit(1))), F.lit(""))


def code_range(code: Column) -> Column:
    """(prefix, lo, hi, span) of KF1-KF9827 or KF1-9827; null where it has no such form."""
    p = r"^([A-Z]{1,3})(\d+)-(?:[A-Z]{1,3})?(\d+)$"
    part = lambda i: F.regexp_extract(code, p, i)
    lo, hi = F.nullif(part(2), F.lit("")).cast("long"), F.nullif(part(3), F.lit("")).cast("long")
    return F.when(code.rlike(p), F.struct(part(1).alias("prefix"), lo.alias("lo"), hi.alias("hi"), (hi - lo).alias("span")))


def authority(uri: Column) -> Column:
    """(type, id): the last two parts of an authority's address."""
    parts = F.split(F.rtrim(F.coalesce(uri, F.lit("")), F.lit("/")), "[/:]")
    return F.when(F.size(parts) >= 2, F.struct(F.element_at(parts, -2).alias("type"), F.element_at(parts, -1).alias("id")))


def billions(model: Column) -> Column:
    """The size in a model's name, in billions of parameters: 7 for larkspur-7b."""
    return F.nullif(F.regexp_extract(F.lower(model), r"(?:^|[^a-z0-9.])(\d+(?:\.\d+)?)b(?:$|[^a-z0-9])", 1), F.lit("")).cast("double")


#: Classes of size by billions of parameters.
SIZES = (("tiny", 1.0), ("small", 4.0), ("medium", 15.0), ("large", 80.0))


def size_category(b: Column) -> Column:
    out = None
    for name, below in SIZES:
        out = F.when(b < below, name) if out is None else out.when(b < below, name)
    return F.when(b.isNull(), "unknown").otherwise(out.otherwise("frontier"))


def main_headings(headings: Column) -> Column:
    """The part before " -- " of each heading, each once whatever its case, in order."""
    mains = F.filter(F.transform(F.coalesce(headings, F.array().cast("array<string>")), lambda h: F.trim(F.split_part(h, F.lit(" -- "), F.lit(1)))), lambda x: x.isNotNull() & (x != ""))
    lows = F.transform(mains, lambda x: F.lower(x))
    bound = F.array(F.struct(mains.alias("m"), lows.alias("l")))
    return F.transform(bound, lambda s: F.filter(F.transform(s["m"], lambda x, i: F.when(F.array_position(s["l"], F.lower(x)) == i + 1, x)), lambda x: x.isNotNull()))[0]


def by_marker(headings: Column, markers: dict[str, str], otherwise: str | None = None) -> Column:
    """The value of the first marker, in the order of the table, that stands in the headings."""
    low = F.lower(F.array_join(F.coalesce(headings, F.array().cast("array<string>")), " | "))
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(v)) for m, v in markers.items()], F.lit(otherwise))


def first_reason(ladder: list[tuple[str, Column]]) -> Column:
    """The name of the first rule of a ladder that a row breaks, null for none; a rule that is null is not broken."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in ladder])


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))


def refuse_to_pool(df: DataFrame, kind: str = "source_type") -> DataFrame:
    """df, where all rows are of one kind; else an error: different kinds are not to be pooled silently."""
    kinds = [r[0] for r in df.select(kind).distinct().limit(3).collect()]
    if len(kinds) > 1:
        raise ValueError(f"rows of several kinds: {sorted(map(str, kinds))}")
    return df


def normal_document(df: DataFrame) -> DataFrame:
    """The fixed schema of a document: nulls to defaults, -1 as no budget, casts; columns that df lacks get their default, others are left out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
    ints = lambda c, z: (F.coalesce(F.col(c).cast("int"), F.lit(z)) if c in df.columns else F.lit(z)).alias(c)
    lists = lambda c: (F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()) if c in df.columns else F.array().cast("array<string>")).alias(c)
    floats = lambda c, z: (F.coalesce(F.col(c).cast("float"), F.lit(z).cast("float")) if c in df.columns else F.lit(z).cast("float")).alias(c)
    names = ["id", "text", "title", "body", "lcc_code", "lcc_name", "lcc_uri", "lcgft_category", "lcgft_form", "audience", "register", "register_description", "target_length", "model", "provider_served", "model_resolved", "git_commit", "code_version", "spec_id", "block_id", "prompt_variant_id", "source_type"]
    rng = F.when(F.size("target_word_range") == 2, F.col("target_word_range")).otherwise(F.array(F.lit(0), F.lit(0))) if "target_word_range" in df.columns else F.array(F.lit(0), F.lit(0))
    budget = F.nullif(F.col("thinking_budget"), F.lit(-1)) if "thinking_budget" in df.columns else F.lit(None).cast("int")
    return df.select(*map(text, names), ints("word_count", 0), lists("topics"), lists("geographic"), rng.alias("target_word_range"), floats("temperature", 0.0), floats("top_p", 1.0), ints("reasoning_tokens", 0), budget.alias("thinking_budget"), floats("token_multiplier", 1.0))
