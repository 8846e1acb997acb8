"""Texts cut off by field limits or in transfer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.spellings import model_key
from corpusmill.llm.text_quality import COMMON_WORDS
from corpusmill.runtime import spread, stage

#: Forms in which a length may have been limited.
MEASURES = ("chars", "bytes", "utf16", "html_chars", "html_bytes", "json_chars", "json_ascii", "crlf_chars", "crlf_bytes")
#: Marks of truncation, [truncated] or [content truncated] and tokens in <| |>.
KNOWN_TRACE = r"\[(?:content )?truncated\]|<\|[^|>\n]*\|>"
#: Own values: further marks that whoever cuts a text leaves behind.
OWN_TRACE = r"\[\s*(?:content |text |output )?(?:truncated|cut|clipped|\.\.\.|…)[^\]\n]{0,20}\]|\((?:more|continued|cont\.?|truncated|cut)\)|�+"
STRONG_TRACE = f"{KNOWN_TRACE}|{OWN_TRACE}"
TRACE = re.compile(rf"\s*(?:(?P<strong>{STRONG_TRACE})|(?P<weak>\.\.\.|…))\s*$", re.IGNORECASE)
ENDED = re.compile(r"[.!?。！？][\"”’'»)\]]*(?:\s*[^\w\s.,;:]{1,3}|\s*\([^()\n]{1,12}\))?\s*$")
UNIT = re.compile(r"[.!?]+[\"”’'»)\]]*(?:\s+|$)|\n+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
LETTERS = re.compile(r"[^\W\d_]$")
COMMON = frozenset(COMMON_WORDS)
FLUSH = 400_000
STATED_SLACK = (2.0, 0.03)  # words that a right count may be off by: absolute, and as a share
SEEN, PROSE, SELDOM_LAST = 3, 0.1, 0.002  # sightings that make a word or pattern known; share of common words of prose; share of a word's uses at a sentence's end

ROWS = "kind string, row long, model string, h long, lengths array<long>, n_words long, stated long, ended boolean, trace string, verse boolean, prose boolean, open_end boolean, word long, skeleton long, longer long, further long, key long, n long, n_end long"


def _h(kind: str, s: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + "\0" + s) - (1 << 63)


def skeleton(unit: str) -> str:
    """A sentence's pattern: its common words, and one sign for each run of other words, capitalised words and numbers."""
    out: list[str] = []
    for w in WORD.findall(unit):
        low = w.lower()
        s = low if low in COMMON else "9" if w.isdigit() else "X" if w[0].isupper() else "x"
        if s not in ("x", "X") or not out or out[-1] != s:
            out.append(s)
    return " ".join(out)


def lengths(b: str) -> list[int]:
    """The length of a text under each of MEASURES."""
    n, nb = len(b), len(b.encode("utf-8", "surrogatepass"))
    wide = 0 if nb == n else sum(c > "￿" for c in b)
    amp, tags, quotes, nl, back = b.count("&"), b.count("<") + b.count(">"), b.count('"') + b.count("'"), b.count("\n"), b.count("\\")
    html = 4 * amp + 3 * tags + 5 * quotes
    json_ = b.count('"') + back + nl + b.count("\t") + b.count("\r")
    ascii_ = 0 if nb == n else sum(5 if c <= "￿" else 11 for c in b if c > "\x7f")
    return [n, nb, n + wide, n + html, nb + html, n + json_, n + json_ + ascii_, n + nl, nb + nl]


def _starts(parts, longer: Counter, n: int, between: str, kind: str) -> None:
    """Adds n to the count of every proper beginning of a word (its letters) or a pattern (its signs), each told by its hash; any length, in one pass over it."""
    h = xxhash.xxh3_64(kind + "\0")
    for i, part in enumerate(parts[:-1]):
        h.update(between + part if i else part)
        longer[h.intdigest() - (1 << 63)] += n


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words, ends, ended = Counter(), Counter(), Counter()

    def stats() -> pd.DataFrame:
        rows = []
        longer: Counter = Counter()
        for w, n in words.items():
            rows.append((_h("w", w), n, ends.get(w, 0)))
            _starts(w, longer, n, "", "p")
        rows += [(h, n, 0) for h, n in longer.items()]
        further: Counter = Counter()
        for s, n in ended.items():
            rows.append((_h("s", s), n, n))
            _starts(s.split(" "), further, n, " ", "q")
        rows += [(h, n, 0) for h, n in further.items()]
        words.clear(), ends.clear(), ended.clear()
        return pd.DataFrame([("stat", *[None] * (len(columns) - 4), *r) for r in rows], columns=columns, dtype=object)

    columns = [c.split()[0] for c in ROWS.split(", ")]
    for pdf in batches:
        got = []
        for row, model, body, stated in zip(pdf["row"], pdf["model"], pdf["body"], pdf["stated"], strict=True):
            t = body.rstrip()
            found = TRACE.search(t)
            core = t[: found.start()] if found else t
            tokens = WORD.findall(core)
            units = [u for u in UNIT.split(core) if u.strip()]
            inner = UNIT.split(core)[:-1]
            words.update(tokens[:-1])
            for u in inner:
                last = WORD.findall(u[-40:])
                if last:
                    ends[last[-1]] += 1
                if u:
                    ended[skeleton(u)] += 1
            common = sum(w.lower() in COMMON for w in tokens) / max(1, len(tokens))
            lines = [x for x in core.split("\n") if x.strip()]
            verse = len(lines) > 2 and sum(not x.rstrip().endswith((".", "!", "?", '"', "”")) for x in lines[:-1]) > 0.6 * (len(lines) - 1)
            n = len(body.split())
            last, pattern = tokens[-1] if tokens else "", skeleton(units[-1]) if units else ""
            strong = bool(found and found["strong"])
            open_end = bool(LETTERS.search(core)) and (common >= PROSE or len(body) < 10 * max(n, 1))
            trace = "strong" if strong else "weak" if found else ""
            got.append(("row", row, model, _h("b", body), lengths(body), n, stated, bool(ENDED.search(core)) and not strong, trace, verse, common >= PROSE, open_end, _h("w", last), _h("s", pattern), _h("p", last), _h("q", pattern), None, None, None))
        yield pd.DataFrame(got, columns=columns, dtype=object)
        if len(words) + len(ended) > FLUSH:
            yield stats()
    yield stats()


def _limits(rows: DataFrame) -> DataFrame:
    """(model, measure, length, n): lengths at which far more unfinished texts end than at those around; model "*" is all of them."""
    one = rows.select("h", F.explode(F.array(F.coalesce("model", F.lit("")), F.lit("*"))).alias("model"), F.posexplode("lengths").alias("m", "length")).where("model <> ''")
    seen = one.groupBy("model", "m", "length").agg(F.countDistinct("h").alias("n"))
    near = Window.partitionBy("model", "m").orderBy("length")
    around = F.sum("n").over(near.rangeBetween(-25, 25)) - F.sum("n").over(near.rangeBetween(-3, 3))
    out = seen.withColumn("around", around / F.lit(44.0)).where((F.col("n") >= 5) & (F.col("n") >= 6 * F.col("around") + 3))
    names = F.element_at(F.array(*[F.lit(x) for x in MEASURES]), F.col("m") + 1)
    return out.select("model", names.alias("measure"), "m", "length", "n")


def truncation(df: DataFrame, row: str = "rec_no", text: str = "body", model: str = "model", word_count: str = "word_count") -> tuple[DataFrame, DataFrame]:
    """(rows, limits): every row with a non-blank text, whether it is cut and why; and the lengths at which texts are cut.

    Each text's length is taken under alternative encodings, entity and JSON escaping and line ends, and lengths are grouped by
    model and measure: a length at which unfinished texts pile up is a storage limit. Then endings are inspected. Counts over
    all texts tell whether the last word is a word or the start of one, whether it ever ends a sentence, and whether the
    last sentence's pattern is one that ends or one that goes on. A text is cut if it doesn't end like a sentence and
    bears a mark of the cut, ends within a word or on a word that can't be last, is at a limit, has fewer words than
    stated, or has a pattern that only goes on. Closings, verse and sentences without a stop are complete. Rows with null or blank
    texts are left out; null and zero word counts say nothing; equal texts get equal verdicts but for word_count and model.
    """
    src = df.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").where(F.col(text).rlike(r"\S"))
    src = src.select(F.col(row).cast("long").alias("row"), model_key(F.col(model)).alias("model"), F.col(text).alias("body"), F.col(word_count).cast("long").alias("stated"))
    scanned = stage(spread(src).mapInPandas(_scan, ROWS), "endings")
    rows = scanned.where("kind = 'row'").select("row", "model", "h", "lengths", "n_words", "stated", "ended", "trace", "verse", "prose", "open_end", "word", "skeleton", "longer", "further")
    stats = stage(scanned.where("kind = 'stat'").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")), "ending-stats")
    unfinished = stage(rows.where("not ended or trace <> ''"), "unfinished")
    limits = stage(_limits(unfinished.where("prose")), "limits")
    at = unfinished.select("row", "model", F.posexplode("lengths").alias("m", "length")).join(limits.select(F.col("model").alias("lm"), "m", "length"), ["m", "length"])
    at = at.where((F.col("lm") == "*") | (F.col("lm") == F.col("model"))).select("row").distinct().withColumn("at_limit", F.lit(True))
    u = unfinished.drop("lengths")
    for col, name in (("word", "w"), ("longer", "p"), ("skeleton", "s"), ("further", "q")):
        u = u.join(stats.select(F.col("key").alias(col), F.col("n").alias(f"{name}_n"), F.col("n_end").alias(f"{name}_end")), col, "left")
    u = u.join(at, "row", "left").fillna({"w_n": 0, "w_end": 0, "p_n": 0, "s_n": 0, "q_n": 0, "at_limit": False})
    c = F.col
    slack = F.greatest(F.lit(STATED_SLACK[0]), c("n_words") * F.lit(STATED_SLACK[1]))
    fewer = F.coalesce(c("stated") > c("n_words") + slack, F.lit(False))
    part = c("open_end") & (c("w_n") < SEEN) & (c("p_n") >= SEEN)
    never_last = (c("w_n") >= SEEN) & (c("w_end") < c("w_n") * F.lit(SELDOM_LAST))
    known = c("s_n") >= SEEN
    goes_on = ~known & (c("q_n") >= SEEN) & ~c("verse")
    reason = (
        F.when(c("trace") == "strong", "mark")
        .when(c("ended"), None)
        .when(part, "within a word")
        .when(~c("prose"), None)
        .when(never_last & c("open_end"), "word that is never last")
        .when(c("at_limit"), "length limit")
        .when(fewer & ~(known & (c("stated") < c("n_words") * F.lit(1.1))), "fewer words than stated")
        .when(goes_on, "sentence that goes on")
    )
    verdict = u.select("row", reason.alias("reason")).where("reason is not null")
    out = rows.select("row", "model", "n_words", "stated", "trace").join(verdict, "row", "left").withColumn("is_cut", F.col("reason").isNotNull())
    return out.withColumnRenamed("row", row), limits.select("model", "measure", "length", "n")


def cut_rates(rows: DataFrame) -> DataFrame:
    """(model, n_rows, n_cut, share_cut) over truncation()'s rows; rows without a model under null."""
    return rows.groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if("is_cut").alias("n_cut")).withColumn("share_cut", F.col("n_cut") / F.col("n_rows"))
