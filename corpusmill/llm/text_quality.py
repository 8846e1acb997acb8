"""Per-document text statistics, and fixed-threshold rules that tell natural language from lists, tables and junk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.runtime import spread

#: Function words of English, French, German and Spanish.
COMMON_WORDS = (
    "a an and any are as at be been because before both but by can could did do does during each every few for from had has have he her here him his how "
    "i if in into is it its just least less many may me might more most much must my no nobody not now of off on once one only or other others our out over own "
    "rather since she should so some such than that the their them then there these they this those though through to too under until up us very was we were what "
    "when where which while who whom whose why will with without would you your o between after although another beside instead "
    "au aux ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se ses si son sur un une "
    "aber als am auch auf aus bei bis das dass dem den der des die doch du ein eine einem einen einer er es für hat ich ihr im ist man mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war wie wir wird zu zum zur "
    "al como con del desde el ella ellos era fue ha hasta la las lo los más me mi muy no nos para pero por porque que se sin sobre su sus también te un una y ya"
).split()

#: Published thresholds (large-corpus filters), as they are: words, mean length of a word, symbols and ellipses a word, shares of bullet and ellipsis lines and of words with a letter, how many of eight words, share of repeated lines.
N_WORDS, MEAN_WORD, SYMBOLS_PER_WORD, BULLET_LINES, ELLIPSIS_LINES, ALPHA_WORDS, STOP_WORDS_LEAST, DUPLICATE_UNITS = (50, 100_000), (3.0, 10.0), 0.1, 0.9, 0.3, 0.8, 2, 0.3
#: The published eight words.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
#: Own thresholds, which decide. Short prose and other languages fail the published rules on the number of words and the eight words, so a share of common words of four languages
#: stands for them. Bullets: a list may have a line of introduction. Duplicates: two equal sentences are no repetition yet. Symbols: marks among many common words are no junk.
COMMON_SHARE, BULLET_LINES_OWN, BULLET_WORDS_OWN, DUPLICATES_LEAST, SYMBOLS_COMMON = 0.1, 0.8, 0.6, 3, 0.25

SPACE = r" \t\n\x0b\f\r"
BULLET = rf"^[{SPACE}]*(?:[-*+•‣◦▪●–—»·]|\(?[0-9]{{1,3}}[.)\]]|\(?[a-zA-Z][.)])[{SPACE}]"
SLICE_BYTES = 16 << 20  # of text that is worked on at once

STATS = [
    *(T.StructField(x, T.LongType()) for x in ("n_words", "n_chars", "n_lines")),
    *(T.StructField(x, T.DoubleType()) for x in ("mean_word_len", "symbols_per_word", "marks_per_word", "alpha_words", "punct_lines", "bullet_lines", "bullet_words", "ellipsis_lines", "common_words")),
    T.StructField("n_stop_words", T.LongType()), T.StructField("duplicate_units", T.DoubleType()), T.StructField("n_duplicates", T.LongType()), T.StructField("digit_share", T.DoubleType()),
]


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _has(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def _parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all parts, the row of each)."""
    return lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def _distinct(rows: np.ndarray, parts: pa.Array, n: int) -> np.ndarray:
    """How many different parts each of n rows has."""
    if not len(parts):
        return np.zeros(n, np.int64)
    codes = pc.dictionary_encode(parts).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.bincount(np.unique(rows.astype(np.int64) * (int(codes.max()) + 1) + codes) // (int(codes.max()) + 1), minlength=n)


def quality_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of a batch of texts, by whole-column string kernels; over null, empty and blank texts counts are 0 and shares are null (NaN).

    Words are runs without white space, common words are compared without case and without the punctuation around them, lines are
    the non-blank ones, units are the lines or, in a text of one line, its sentences.
    """
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(t)
    lines, of = _parts(pc.split_pattern(t, "\n"))
    lines = pc.utf8_trim(lines, characters=" ")
    full = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
    lines, of = lines.filter(pa.array(full)), of[full]
    count = lambda rows, mask=None: np.bincount(rows if mask is None else rows[mask], minlength=n).astype(np.int64)
    n_words, n_chars, n_lines = _count(t, rf"[^{SPACE}]+"), pc.utf8_length(t).to_numpy(zero_copy_only=False).astype(np.int64), count(of)
    bullet = _has(lines, BULLET)
    bullet_words = np.bincount(of[bullet], _count(lines.filter(pa.array(bullet)), rf"[^{SPACE}]+"), minlength=n)
    bare, word_of = _parts(pc.split_pattern_regex(pc.utf8_lower(t), r"[^\p{L}\p{N}'’]+"))
    some = pc.not_equal(bare, "").to_numpy(zero_copy_only=False)
    common = pc.is_in(bare, value_set=pa.array(sorted(set(COMMON_WORDS)), pa.large_string())).to_numpy(zero_copy_only=False)
    stop = pc.is_in(bare, value_set=pa.array(STOP_WORDS, pa.large_string())).to_numpy(zero_copy_only=False)
    one = n_lines <= 1
    sentences, s_of = _parts(pc.split_pattern(pc.replace_substring_regex(pc.utf8_trim(t.filter(pa.array(one)), characters=" "), rf"([.!?])[{SPACE}]+", "\\1\x00"), "\x00"))
    many = ~one[of]
    units, unit_of = pa.concat_arrays([lines.filter(pa.array(many)), sentences]), np.concatenate([of[many], np.flatnonzero(one)[s_of]])
    n_units = count(unit_of)
    repeated = n_units - _distinct(unit_of, units, n)

    def share(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(b > 0, a / b, np.nan)

    return {
        "n_words": n_words, "n_chars": n_chars, "n_lines": n_lines,
        "mean_word_len": share(n_chars - _count(t, f"[{SPACE}]"), n_words),
        "symbols_per_word": share(_count(t, r"[#<>{}|\[\]=\\^~_\t]|\.\.\.|…"), n_words),
        "marks_per_word": share(_count(t, r"#|\.\.\.|…"), n_words),
        "alpha_words": share(_count(t, rf"[^{SPACE}]*\p{{L}}[^{SPACE}]*"), n_words),
        "punct_lines": share(count(of, _has(lines, rf"[.!?:;,…][\"'”’»)\]]*[{SPACE}]*$")), n_lines),
        "bullet_lines": share(count(of, bullet), n_lines),
        "bullet_words": share(bullet_words, n_words),
        "ellipsis_lines": share(count(of, _has(lines, rf"(?:\.\.\.|…)[{SPACE}]*$")), n_lines),
        "common_words": share(count(word_of, common), count(word_of, some)),
        "n_stop_words": _distinct(word_of[stop], bare.filter(pa.array(stop)), n),
        "duplicate_units": share(repeated, n_units), "n_duplicates": repeated,
        "digit_share": share(_count(t, "[0-9]"), n_chars),
    }


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield at, end
        at = end


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text")
        for a, b in _slices(texts):
            stats = quality_stats(texts.slice(a, b - a))
            kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
            new = [pa.array(stats[f.name], pa.float64(), from_pandas=True) if isinstance(f.dataType, T.DoubleType) else pa.array(stats[f.name], pa.int64()) for f in STATS]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*batch.schema.names[:-1], *(f.name for f in STATS)])


def _failed(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(r, F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull())


def published_reasons() -> Column:
    """The published rules that a row of statistics fails, each as it was published."""
    c = F.col
    return _failed({
        "word_count": (c("n_words") < N_WORDS[0]) | (c("n_words") > N_WORDS[1]),
        "word_length": (c("mean_word_len") < MEAN_WORD[0]) | (c("mean_word_len") > MEAN_WORD[1]),
        "symbols": c("marks_per_word") > SYMBOLS_PER_WORD,
        "bullet_lines": c("bullet_lines") > BULLET_LINES,
        "ellipsis_lines": c("ellipsis_lines") > ELLIPSIS_LINES,
        "alphabetic_words": c("alpha_words") < ALPHA_WORDS,
        "stop_words": c("n_stop_words") < STOP_WORDS_LEAST,
        "duplicate_lines": c("duplicate_units") > DUPLICATE_UNITS,
    })


def quality_reasons() -> Column:
    """The rules that decide and that a row of statistics fails, in fixed order; an empty array where it fails none."""
    c = F.col
    return _failed({
        "few_common_words": c("common_words") < COMMON_SHARE,
        "bullet_list": (c("bullet_lines") > BULLET_LINES_OWN) | ((c("bullet_words") > BULLET_WORDS_OWN) & (c("n_lines") > 4)),
        "symbols": (c("symbols_per_word") > SYMBOLS_PER_WORD) & (c("common_words") < SYMBOLS_COMMON),
        "few_alphabetic_words": c("alpha_words") < ALPHA_WORDS,
        "word_length": (c("mean_word_len") < MEAN_WORD[0]) | (c("mean_word_len") > MEAN_WORD[1]),
        "ellipsis_lines": (c("ellipsis_lines") > ELLIPSIS_LINES) & (c("n_lines") > 3),
        "repetition": (c("duplicate_units") > DUPLICATE_UNITS) & (c("n_duplicates") >= DUPLICATES_LEAST),
    })


def text_quality(df: DataFrame, row: str = "rec_no", text: str = "body", word_count: str = "word_count") -> DataFrame:
    """One row for each row of df: its statistics, the stated word count against the counted one, failed rules, is_natural.

    `published` holds the failures of the published rules as they are; `reasons` those of the rules that decide: the published thresholds on
    letters, word length, ellipses and repetition, and own ones (see above) in place of those that short or foreign prose fails. Null and blank texts are
    natural language with no reasons (there is nothing to reject); a null or zero word_count gives a null word_count_error. Repeated rows count each.
    """
    narrow = spread(df.select(F.col(row), F.col(word_count).alias("stated_words"), F.col(text).alias("_text")))
    schema = T.StructType([narrow.schema[row], narrow.schema["stated_words"], *STATS])
    stats = narrow.mapInArrow(_run, schema)
    error = F.when(F.col("stated_words") > 0, (F.col("stated_words") - F.col("n_words")).cast("double") / F.col("stated_words"))
    out = stats.withColumn("word_count_error", error)
    none = F.array().cast("array<string>")
    for name, failed in (("published", published_reasons()), ("reasons", quality_reasons())):
        out = out.withColumn(name, F.when(F.col("n_words") > 0, failed).otherwise(none))
    return out.withColumn("is_natural", F.size("reasons") == 0)
