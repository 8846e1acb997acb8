"""The pN_ queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import cooccurrence, grouped_split, mixing, near_duplicates, packing, pii, split_overlap, target_sample, text_quality, tokens, truncation
from corpusmill.operators.blocks import pairs_within
from corpusmill.runtime import stage
from corpusmill.sources.tables import table


#: Similar in the sense of the test data: sets of three-word runs, at least 0.6 of them in common.
WORDS, SIMILARITY = 3, 0.6


def _pairs(spark: SparkSession, d: str, min_pairs: int = 5, min_share: float = 0.004) -> DataFrame:
    shelf = table(spark, d, "shelf_features")
    n = shelf.where("id is not null").select("id").distinct().count()
    items = cooccurrence.record_items(shelf, "id", ["topics", "geographic"])
    return cooccurrence.cooccurrence(items, n, min_pairs=min_pairs, min_share=min_share)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("double(n_ab) * n >= 3d * n_a * n_b").select("item_a", "item_b")  # products of counts may pass 2^63


def p1_association(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return _pairs(spark, d).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", r("lift"), r("pmi"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of items that any record holds, with its count and lift."""
    lift = (F.floor(F.col("lift") * 1e6 + 0.5) / 1e6).alias("lift")
    return _pairs(spark, d, 1, 0.0).select("item_a", "item_b", "n_ab", "n_a", "n_b", lift)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation(table(spark, d, "shelf_features"))[0].where("is_cut").select("rec_no")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(truncation.truncation(table(spark, d, "shelf_features"))[0])


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation(table(spark, d, "shelf_features"))[1]


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.split_overlap(table(spark, d, "shelf_features"), similarity=SIMILARITY, words=WORDS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    o = _overlaps(spark, d)
    return o.select(F.least("train_row", "eval_row").alias("rec_a"), F.greatest("train_row", "eval_row").alias("rec_b")).distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_counts(_overlaps(spark, d), table(spark, d, "shelf_features"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].where("not can_be_met").select("facet", "category")


def _sample(spark: SparkSession, d: str):
    return target_sample.target_sample(table(spark, d, "shelf_features"), table(spark, d, "label_space"), table(spark, d, "sample_targets"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0]


def p4_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1]


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, d, "shelf_features"), similarity=SIMILARITY, words=WORDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_within(p5_groups(spark, d), ["group"], "rec_no").select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.text_quality(table(spark, d, "shelf_features")).where("not is_natural").select("rec_no")


def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    q = text_quality.text_quality(table(spark, d, "shelf_features"))
    return q.withColumn("reasons", F.array_join("reasons", ",")).withColumn("published", F.array_join("published", ","))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.tied_models(table(spark, d, "shelf_features"))


SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _split(spark: SparkSession, d: str) -> DataFrame:
    shelf = table(spark, d, "shelf_features")
    return grouped_split.grouped_split(grouped_split.related_groups(shelf, "rec_no", grouped_split.model_ties(shelf)), SPLITS)


def p7_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select(F.col("row").alias("rec_no"), "split")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    s = grouped_split.split_shares(_split(spark, d), SPLITS)
    return s.withColumn("share_reached", F.floor(F.col("share_reached") * 1e6 + 0.5) / 1e6)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return stage(tokens.token_counts(table(spark, d, "documents").select("doc_id", "source", "text"), keep=["doc_id", "source"]), "sizes")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sized(spark, d)
    kinds = table(spark, d, "pack_capacities").collect()  # the sizes of containers: a handful of rows
    out = None
    for r in kinds:
        one = packing.pack(sizes, r["capacity_tokens"], ["doc_id"]).select(F.lit(r["container_kind"]).alias("container_kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are, and how many texts were divided because they are larger than one."""
    packed = p8_pack(spark, d)
    per = packed.groupBy("container_kind", "container").agg(F.sum("n_tokens").alias("used"), F.sum(F.when(F.col("piece") > 0, 1).otherwise(0)).alias("cuts"))
    sums = per.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("cuts").alias("cuts"))
    return sums.join(table(spark, d, "pack_capacities"), "container_kind").withColumn("share_used", F.col("tokens") / (F.col("containers").cast("double") * F.col("capacity_tokens")))


def _mix(spark: SparkSession, d: str):
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"), ramps=mixing.fade_in_repeated)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _pii(spark: SparkSession, d: str):
    docs = table(spark, d, "documents")
    places = tuple(sorted(r[0] for r in table(spark, d, "place_regions").select("place").distinct().collect()))  # a fixed table of dozens
    return docs, pii.fit_pii(docs, "doc_id", places=places)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs, model = _pii(spark, d)
    return pii.find_pii(docs, model).select("doc_id", "kind", "pii").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs, model = _pii(spark, d)
    return pii.redact(docs.select("doc_id", "text"), model).select("doc_id", "redacted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("p") and name[1].isdigit()}
