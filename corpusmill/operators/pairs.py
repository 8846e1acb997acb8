"""Relations of document pairs, and mining of pairs by quotas without making the pairs that are not kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import hash60
from corpusmill.runtime import stage

#: The ladder of relations, from the closest to none.
STRATA = ("S0_identical_facets", "S1_same_subclass", "S2_same_class", "S3_same_form", "S4_same_category", "S5_same_topic", "S6_unrelated")
#: The facet by whose groups candidates of a stratum are looked for; unrelated pairs come from all documents.
INDEX = {"S0_identical_facets": "sub", "S1_same_subclass": "sub", "S2_same_class": "cls", "S3_same_form": "form", "S4_same_category": "cat", "S5_same_topic": "topic", "S6_unrelated": None}


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ > 0, both / any_).otherwise(F.lit(0.0))


def relation(a, b) -> Column:
    """The stratum of a pair; a and b give the columns sub, cls, form, cat (null where unknown) and topics (an array) of either side."""
    same = lambda f: F.coalesce(a(f) == b(f), F.lit(False))
    topics = jaccard(a("topics"), b("topics"))
    return (
        F.when(same("sub") & same("form") & (topics == 1.0), STRATA[0]).when(same("sub"), STRATA[1]).when(same("cls"), STRATA[2])
        .when(same("form"), STRATA[3]).when(same("cat"), STRATA[4]).when(topics > 0, STRATA[5]).otherwise(STRATA[6])
    )


def order_key(seed: str, *cols) -> Column:
    """A 60-bit number from md5 of the seed and the columns, by which draws are made: the same in any engine and for any order of rows."""
    return hash60(F.concat_ws("|", F.lit(seed), *cols))


def first_of_groups(df: DataFrame, group: str | None, most: int, seed: str, key: str = "id") -> DataFrame:
    """df with `r`: the first `most` rows of each group in hash order. Each task keeps no more of a group than that, however large it is."""
    w = Window.partitionBy(group or F.lit(0)).orderBy("_h", key)
    return df.withColumn("_h", order_key(seed, F.col(key))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("_h")


def neighbours(df: DataFrame, group: str | None, lags: int, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, *_a, *_b): rows of a group whose ranks `r` differ by at most `lags`, a the one of smaller key."""
    on = [group] if group else []
    left = df.select(*on, F.explode(F.sequence(F.col("r") + 1, F.col("r") + lags)).alias("_to"), F.col(key).alias("_l"), *[F.col(c).alias(f"{c}_l") for c in keep])
    right = df.select(*on, F.col("r").alias("_to"), F.col(key).alias("_r"), *[F.col(c).alias(f"{c}_r") for c in keep])
    j = left.join(right, [*on, "_to"]).where("_l <> _r")
    flip = F.col("_l") > F.col("_r")
    side = lambda x, y, n: F.when(flip, F.col(y)).otherwise(F.col(x)).alias(n)
    return j.select(side("_l", "_r", "a"), side("_r", "_l", "b"), *[s for c in keep for s in (side(f"{c}_l", f"{c}_r", f"{c}_a"), side(f"{c}_r", f"{c}_l", f"{c}_b"))])


def balanced_quotas(total: int, negatives: tuple[str, ...] = STRATA[3:], positive: str = STRATA[2]) -> dict[str, int]:
    """Quotas of which half are positive: the negatives share the other half evenly, and the positives equal their sum."""
    if total < 0 or not negatives:
        raise ValueError("total must not be negative, and there must be a negative stratum")
    each = total // 2 // len(negatives)
    return {**dict.fromkeys(negatives, each), positive: each * len(negatives)}


FACETS = ("sub", "cls", "form", "cat", "topics")


def mine_pairs(docs: DataFrame, quotas: dict[str, int], seed: str = "mine", per_group: int = 64, lags: int = 8) -> DataFrame:
    """(pair_id, doc_a, doc_b, label, stratum): up to the quota of pairs of each stratum, label 1 where the classes are equal.

    docs(id, sub, cls, form, cat, topics): one row for each document. Candidates of a stratum are near neighbours in hash order within
    the groups of the facet that makes it (INDEX), `per_group` documents of each and `lags` partners of each document: the
    work is bounded by the groups, never by their pairs. Strata exclude each other, so no pair comes twice. Pair ids count
    all pairs in hash order. What a quota lacks shows in mining_report(). Fewer than two documents give no pairs.
    """
    if min(quotas.values(), default=0) < 0:
        raise ValueError("quotas must not be negative")
    found = []
    docs = stage(docs.select("id", *FACETS), "mine")
    for stratum, quota in quotas.items():
        if not quota:
            continue
        by = INDEX[stratum]
        rows = docs.select("id", *FACETS, F.explode("topics").alias("topic")) if by == "topic" else docs.select("id", *FACETS)
        rows = rows.where(F.col(by).isNotNull()) if by else rows
        some = first_of_groups(rows, by, per_group if by else 4 * quota, f"{seed}|{stratum}")
        pairs = neighbours(some, by, lags, keep=FACETS).dropDuplicates(["a", "b"])
        kept = pairs.where(relation(lambda f: F.col(f"{f}_a"), lambda f: F.col(f"{f}_b")) == stratum)
        label = F.coalesce(F.col("cls_a") == F.col("cls_b"), F.lit(False)).cast("int")
        found.append(kept.select("a", "b", label.alias("label"), F.lit(stratum).alias("stratum"), order_key(seed, F.col("a"), F.col("b")).alias("h")).orderBy("h", "a", "b").limit(quota))
    if not found:
        found = [docs.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("label"), F.lit("").alias("stratum"), F.lit(0).cast("long").alias("h")).limit(0)]
    every = reduce(DataFrame.unionByName, found)
    no = F.row_number().over(Window.orderBy("h", "a", "b")) - 1  # over the quotas' rows only
    return every.select(F.concat(F.lit("pair_"), F.lpad(no.cast("string"), 6, "0")).alias("pair_id"), F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "label", "stratum")


def mining_report(pairs: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(stratum, requested, produced, shortfall) for all strata, those without a quota or without pairs too."""
    asked = pairs.sparkSession.createDataFrame([(s, quotas.get(s, 0)) for s in STRATA], "stratum string, requested long")
    got = pairs.groupBy("stratum").agg(F.count("*").alias("produced"))
    n = F.coalesce("produced", F.lit(0))
    return asked.join(got, "stratum", "left").select("stratum", "requested", n.alias("produced"), F.greatest(F.col("requested") - n, F.lit(0)).alias("shortfall"))
