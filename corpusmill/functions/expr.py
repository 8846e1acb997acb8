"""Column expressions that the operators share; every one is a built-in, so plans stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they become.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"


def r6(c: Column) -> Column:
    """Rounded to six places the same way by any engine with IEEE doubles."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def normalise(text: Column) -> Column:
    """Lower case without accents (Latin letters)."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column, min_length: int = 1) -> Column:
    """Words (letters, digits, underscores), normalised; null text gives an empty array."""
    t = F.regexp_extract_all(normalise(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return t if min_length <= 1 else F.filter(t, lambda x: F.length(x) >= min_length)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def shingles(words: Column, n: int) -> Column:
    """Runs of n words, each once; all the words where there are fewer, none where there are none."""

    def runs(w: Column) -> Column:
        k = F.size(w)
        each = F.transform(F.sequence(F.lit(1), F.greatest(k - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return F.transform(F.array(words), runs)[0]  # binds the words: they are computed once, not for every run


def hash60(c: Column) -> Column:
    """A 60-bit number from md5: the same in any engine."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def facet_set(c: Column) -> Column:
    """Trimmed lower-case values, each once, without blanks; null becomes empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.lower(x))), lambda x: x.isNotNull() & (x != "")))


def length_bucket(chars: Column) -> Column:
    return F.when(chars < 500, "short").when(chars < 2000, "medium").otherwise("long")


def cosine(u: Column, v: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(u, v) / (F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)))


def correlation(x, y) -> Column:
    """Pearson correlation as an aggregate; null where either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
