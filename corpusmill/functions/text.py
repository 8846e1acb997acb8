"""Text as column expressions: sentences, paragraphs, envelopes, masking; and chunking, which carries state, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.expr import hash60

SEP = "\x01"


def _t(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def simple_tokens(text: Column) -> Column:
    """Words of letters, digits and underscores in lower case, accents kept."""
    return F.regexp_extract_all(F.lower(_t(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def alpha_tokens(text: Column) -> Column:
    """Runs of letters in lower case (numerals that are letters, such as Roman ones, among them)."""
    return F.regexp_extract_all(F.lower(_t(text)), F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), F.lit(1))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, repeated ones too; none where there are fewer."""
    each = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, each(w)).otherwise(F.array().cast("array<string>")))[0]


def sentences(text: Column, least: int = 3) -> Column:
    """Pieces between a sentence's end and white space, trimmed, of `least` characters at least."""
    parts = F.split(F.regexp_replace(_t(text), r"([.!?])[ \t\n\x0B\f\r]+", "$1" + SEP), SEP)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")), lambda x: F.length(x) >= least)


def paragraphs(text: Column, least: int = 10, separator: str = r"\n[ \t\f\r]*\n+") -> Column:
    """Parts between blank lines, trimmed, of `least` characters at least."""
    parts = F.split(_t(text), separator)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")), lambda x: F.length(x) >= least)


def unwrap(paragraph: Column) -> Column:
    """Hard-wrapped lines joined, white space as single blanks."""
    return F.trim(F.regexp_replace(paragraph, r"[ \t\n\x0B\f\r]+", " "))


def first_words(text: Column, n: int) -> Column:
    words = F.filter(F.split(_t(text), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    return F.array_join(F.slice(words, 1, n), " ")


def envelope(text: Column) -> Column:
    """(title, body): the first line without "Title:" and what follows it; a text of one line is all title."""
    t = F.regexp_replace(_t(text), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    at = F.instr(t, "\n")
    head = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
    body = F.when(at > 0, F.regexp_replace(F.substring(t, at + 1, F.length(t)), r"^[ \t\n\x0B\f\r]+", "")).otherwise(F.lit(""))
    return F.struct(F.trim(F.regexp_replace(head, r"(?i)^title[: ]\s*", "")).alias("title"), body.alias("body"))


def label_variants(label: Column, least: int = 5) -> Column:
    """The label, its words of `least` letters or more, and each with a plural s or without; longest first, then by name."""
    low = F.lower(F.trim(label))
    words = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least)
    base = F.concat(F.array(low), words)
    every = F.array_distinct(F.concat(base, F.transform(base, lambda w: F.concat(w, F.lit("s"))), F.transform(base, lambda w: F.regexp_replace(w, "s$", ""))))
    every = F.filter(every, lambda w: w != "")
    return F.transform(F.array_sort(F.transform(every, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])


def words_of(text: Column) -> Column:
    return F.filter(F.split(_t(text), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")


def masked(text: Column, label: Column) -> Column:
    """(text, removed): the text without the label's variants as whole words, whatever their case, and the words that went."""
    quoted = F.transform(label_variants(label), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N} ])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?i)\b("), F.array_join(quoted, "|"), F.lit(r")\b"))
    new = F.array_join(words_of(F.when(F.trim(F.coalesce(label, F.lit(""))) != "", F.regexp_replace(_t(text), pattern, F.lit(" "))).otherwise(_t(text))), " ")
    bound = F.array(F.struct(new.alias("text"), F.size(words_of(text)).alias("n")))
    return F.transform(bound, lambda x: F.struct(x["text"].alias("text"), (x["n"] - F.size(words_of(x["text"]))).alias("removed")))[0]


def sham(text: Column, key: Column, n: Column) -> Column:
    """The text without n of its words, those first in an order by hash of key and place: the control for masking."""
    ws = words_of(text)
    ranked = F.transform(F.array_sort(F.transform(ws, lambda w, i: F.struct(hash60(F.concat_ws("|", key.cast("string"), (i + 1).cast("string"))).alias("h"), i.alias("i"), w.alias("w")))), lambda x: x)
    kept = F.array_sort(F.transform(F.slice(ranked, n + 1, F.greatest(F.size(ranked), F.lit(1))), lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"))))
    return F.array_join(F.transform(kept, lambda x: x["w"]), " ")


def singular_plural(label: Column) -> Column:
    """A label in lower case with its plural or singular."""
    n = F.trim(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", " "))
    other = F.when(F.endswith(n, F.lit("ies")), F.regexp_replace(n, "ies$", "y")).when(F.endswith(n, F.lit("s")), F.regexp_replace(n, "s$", "")).when(F.endswith(n, F.lit("y")), F.regexp_replace(n, "y$", "ies")).otherwise(F.concat(n, F.lit("s")))
    return F.array(n, other)


def fenced(text: Column, begin: str = r"\*\*\* ?START OF[^\n]*\n", end: str = r"\*\*\* ?END OF") -> Column:
    """What stands between two fences, the whole text where a fence is missing, without lines of credits."""
    inner = F.regexp_extract(_t(text), rf"(?is){begin}(.*?){end}", 1)
    kept = F.when(inner != "", inner).otherwise(_t(text))
    return F.regexp_replace(kept, r"(?im)^(?:produced by|transcribed by|e-text prepared by)[^\n]*\n?", "")


# What carries state from part to part

CHUNK_WORDS, CHUNK_LEAST, CHUNK_MOST = 400, 150, 900


def chunk(parts: list[str], target: int = CHUNK_WORDS, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> list[str]:
    """Paragraphs put together to passages of about `target` words: one is closed when it has that many. A paragraph of more than `most` words is cut; a last passage of fewer than `least` joins the one before, unless that would pass `most`."""
    out: list[list[str]] = []
    held: list[str] = []
    for part in parts:
        words = part.split()
        for at in range(0, len(words), most):
            piece = words[at : at + most]
            if held and len(held) + len(piece) > most:
                out.append(held)
                held = []
            held = held + piece
            if len(held) >= target:
                out.append(held)
                held = []
    if held:
        if out and len(held) < least and len(out[-1]) + len(held) <= most:
            out[-1] = out[-1] + held
        else:
            out.append(held)
    return [" ".join(x) for x in out]


def evenly(n: int, k: int, skip: int = 1) -> list[int]:
    """At most k places spread evenly over n, without the first and last `skip` where there are more than k besides."""
    span = range(skip, n - skip) if n - 2 * skip >= k else range(n)
    m = len(span)
    return [span[i] for i in range(m)] if m <= k else sorted({span[round(i * (m - 1) / (k - 1))] if k > 1 else span[m // 2] for i in range(k)})


def chunk_passages(df: DataFrame, key: str, text: str, separator: str = "\n", k: int = 3) -> DataFrame:
    """(key, chunk, of, n_words, passage): at most k passages of each text, evenly spaced; texts without words give none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[key], pdf[text], strict=True):
                passages = chunk([p for p in (t or "").split(separator) if p.strip()])
                rows += [(i, j, len(passages), len(passages[j].split()), passages[j]) for j in evenly(len(passages), k)]
            yield pd.DataFrame(rows, columns=[key, "chunk", "of", "n_words", "passage"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, chunk int, of int, n_words int, passage string")


def segments(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(key, segment, begin, end, sentence): sentences with their places in the text, counted from 0; text[begin:end] is the sentence."""
    import re

    kind = df.schema[key].dataType.simpleString()
    space = " \t\n\x0b\f\r"
    cut = re.compile(r"(?<=[.!?])[ \t\n\x0B\f\r]+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[key], pdf[text], strict=True):
                at = no = 0
                for s in cut.split(t or ""):
                    s = s.strip(space)
                    if len(s) < least:
                        continue
                    at = t.index(s, at)
                    rows.append((i, no, at, at + len(s), s))
                    at, no = at + len(s), no + 1
            yield pd.DataFrame(rows, columns=[key, "segment", "begin", "end", "sentence"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, segment int, begin int, end int, sentence string")
