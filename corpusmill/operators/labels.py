"""Ground truth from fields that spell a category in several ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.spellings import aliases, facet_key


def class_truth(shelf: DataFrame, label_space: DataFrame, out: str = "truth") -> DataFrame:
    """(id, out): the least class of an id's rows, whether given as code, with prefix or point, or by name; one-letter codes outside the label space stand for themselves."""
    terms = aliases(label_space).where("facet = 'lcc_code'").select("key", "term")
    code = F.coalesce("term", F.when(F.length(F.trim("lcc_code")) == 1, F.upper(F.trim("lcc_code"))))
    rows = shelf.select("id", "lcc_code", facet_key("lcc_code").alias("key")).join(F.broadcast(terms), "key", "left")  # a few spellings for each term
    return rows.select("id", code.alias(out)).where(F.col(out).isNotNull()).groupBy("id").agg(F.min(out).alias(out))
