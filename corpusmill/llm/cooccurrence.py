"""Items that appear together: pair counts and association over records of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.blocks import pairs_within
from corpusmill.runtime import stage


def clean_item(c: Column) -> Column:
    """Lower case, one blank for white space, underscores and hyphens, no punctuation at either end; accents and apostrophes are kept. Null where nothing is left."""
    s = F.regexp_replace(F.lower(c), r"[\s\p{Z}_-]+", " ")
    s = F.regexp_replace(s, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.nullif(s, F.lit(""))


def record_items(df: DataFrame, record: str, lists: list[str]) -> DataFrame:
    """(record, item), each once: the cleaned items of all the lists of all rows of a record.

    Rows with a null record are left out; null lists count as empty, null and blank items as none.
    """
    both = F.concat(*[F.coalesce(F.col(x), F.array().cast("array<string>")) for x in lists])
    one = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.explode(F.array_distinct(both)).alias("raw"))
    return one.select("record", clean_item(F.col("raw")).alias("item")).where("item is not null").distinct()


def cooccurrence(items: DataFrame, n_records: int, min_pairs: int = 1, min_share: float = 0.0, large: int = 48) -> DataFrame:
    """Pairs of items held by at least max(min_pairs, min_share * n_records) records, with their association.

    With the defaults that is every pair of items that any record holds. `items` is (record, item) without repeats; n_records counts records without items too. Out: item_a < item_b, n_ab, n_a,
    n_b, n, lift = n_ab * n / (n_a * n_b), pmi = ln(lift), npmi. An item below the threshold can't be part of a pair
    above it, so such items go first: that is exact, and shortens long baskets. Baskets of up to `large` items make
    their pairs within the row. Longer ones are split into chunks of items, and each product of two chunks is a
    join key of its own, so one huge basket is spread over many tasks. Both kinds are pre-aggregated before the
    shuffle by pair. Empty input gives no rows.
    """
    least = max(int(min_pairs), 1, _ceil(min_share * n_records))
    counts = stage(items.groupBy("item").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least), "item-counts")
    kept = items.join(counts.select("item"), "item", "left_semi")
    sizes = kept.groupBy("record").agg(F.count("*").alias("m")).where("m > 1")
    ordinary = kept.join(sizes.where(F.col("m") <= large).select("record"), "record", "left_semi")
    arrays = ordinary.groupBy("record").agg(F.sort_array(F.collect_list("item")).alias("xs"))
    pairs = F.flatten(F.transform("xs", lambda x, i: F.transform(F.slice("xs", i + 2, F.size("xs")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    near = arrays.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    huge = kept.join(sizes.where(F.col("m") > large).select("record"), "record", "left_semi")
    far = pairs_within(huge, ["record"], "item", block=large).select("a", "b")
    together = near.groupBy("a", "b").agg(F.count("*").alias("k")).unionByName(far.groupBy("a", "b").agg(F.count("*").alias("k")))
    n_ab = together.groupBy("a", "b").agg(F.sum("k").alias("n_ab")).where(F.col("n_ab") >= least)
    n = F.lit(int(n_records)).cast("long")
    out = n_ab.join(counts.select(F.col("item").alias("a"), F.col("cnt").alias("n_a")), "a").join(counts.select(F.col("item").alias("b"), F.col("cnt").alias("n_b")), "b")
    lift = F.col("n_ab").cast("double") * n / (F.col("n_a").cast("double") * F.col("n_b"))
    out = out.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", n.alias("n"), lift.alias("lift"))
    return out.withColumn("pmi", F.ln("lift")).withColumn("npmi", F.when(F.col("n_ab") < n, F.col("pmi") / -F.ln(F.col("n_ab").cast("double") / n)).otherwise(F.lit(1.0)))


def _ceil(x: float) -> int:
    """The least integer that is not below x, where x may miss an integer by the rounding of a product."""
    k = round(x)
    return k if abs(x - k) < 1e-9 * max(1.0, abs(x)) else int(x) + (x > int(x))
