"""One key for the spellings of a category or of a writing model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before or after a category's name by facet.
LABELS = {"lcc_code": ["lcc"], "lcgft_form": ["lcgft"], "register": ["register"], "model": []}

#: Tags after a model's name that say how it was served.
TAGS = "free|paid|latest|beta|preview|community|self|extended"


def squeeze(c: Column) -> Column:
    """Letters and digits only, in lower case; null where none are left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def model_key(c: Column) -> Column:
    """A writing model's key: without case, separators, the house or hub before it and the tag (":free", "@community") after it.

    Digits stay apart where a separator parts them, so sizes, editions and fine-tune numbers remain different models.
    Null for null, empty and blank.
    """
    s = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    s = F.regexp_replace(s, r"^.*/", "")
    s = F.regexp_replace(s, rf"[:@]({TAGS})\s*$", "")
    s = F.regexp_replace(s, r"^[^:@]*[:@]", "")
    s = F.regexp_replace(s, r"(?<=\d)[^\p{L}\p{N}]+(?=\d)", "~")
    return F.nullif(F.regexp_replace(s, r"[^\p{L}\p{N}~]+", ""), F.lit(""))


def aliases(label_space: DataFrame) -> DataFrame:
    """(facet, key, term): the keys under which each term of a label space may stand in a field."""
    one = []
    for facet, words in LABELS.items():
        own = label_space.where(F.col("facet") == facet)
        if facet == "model":
            one.append(own.select("facet", model_key(F.col("term")).alias("key"), "term"))
            continue
        t = squeeze(F.col("term"))
        keys = [t, *[F.concat(F.lit(w), t) for w in words], *[F.concat(t, F.lit(w)) for w in words]]
        if facet == "lcc_code":
            name = squeeze(F.col("broader"))
            keys += [name, F.concat(t, name), F.concat(name, t)]
        one.append(own.select("facet", F.explode(F.array_distinct(F.array(*keys))).alias("key"), "term"))
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out.where("key is not null").groupBy("facet", "key").agg(F.min("term").alias("term"))


def facet_key(facet: str) -> Column:
    return model_key(F.col(facet)) if facet == "model" else squeeze(F.col(facet))
