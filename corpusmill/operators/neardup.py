"""Near-duplicates by MinHash signatures and bands, with a hash that any engine can repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import alpha_tokens
from corpusmill.operators.blocks import pairs_within
from corpusmill.runtime import spread, stage

try:
    from _md5 import md5  # the same, for short strings in half the time
except ImportError:
    from hashlib import md5

#: A prime, words of a shingle, permutations, bands, and how similar is too similar.
PRIME, SHINGLE, PERMUTATIONS, BANDS, THRESHOLD = (1 << 31) - 1, 5, 128, 32, 0.9


def coefficients(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(n, dtype=np.int64)
    return (1103515245 * (i + 1) + 12345) % (PRIME - 1) + 1, (22695477 * (i + 1) + 1) % PRIME


def shingle_hashes(words: list[str], k: int = SHINGLE) -> np.ndarray:
    """The different k-word shingles of a text as numbers below the prime; all of it where it has fewer words, none for none."""
    if not len(words):
        return np.empty(0, np.int64)
    runs = set(map(" ".join, zip(*[words[i:] for i in range(k)], strict=False))) if len(words) >= k else {" ".join(words)}
    digests = np.frombuffer(b"".join([md5(s.encode()).digest() for s in runs]), ">u8")[::2]  # 15 hexadecimal digits are 60 bits
    return np.unique((digests.astype(np.uint64) >> np.uint64(4)).astype(np.int64) % PRIME)


def signatures(docs: DataFrame, doc: str, text: str, shingles: bool = True) -> DataFrame:
    """(doc, signature, shingles): the least value of each of PERMUTATIONS universal hashes over the shingles; PRIME - 1 throughout for a text without words. The shingles are left out where they are not wanted."""
    a, b = coefficients()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sig, sets = [], []
            for words in pdf["ts"]:
                h = shingle_hashes(list(words))
                least = np.full(PERMUTATIONS, PRIME - 1, np.int64)
                for at in range(0, len(h), 4096):
                    least = np.minimum(least, ((h[at : at + 4096, None] * a + b) % PRIME).min(0))
                sig.append(least)
                sets.append(h)
            out = pd.DataFrame({"doc": pdf["doc"], "signature": sig})
            yield out.assign(shingles=sets) if shingles else out

    t = spread(docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))).select("doc", alpha_tokens(F.col("text")).alias("ts"))
    return t.mapInPandas(run, "doc long, signature array<long>" + ", shingles array<long>" * shingles)


def agreement(a, b):
    """Share of the places at which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(PERMUTATIONS))


def band_keys(sig: DataFrame, bands: int = BANDS) -> DataFrame:
    """(doc, key): a key of 64 bits for each band of a signature, equal where the band and all its rows are; share_band() tells those that are equal by chance."""
    if PERMUTATIONS % bands:
        raise ValueError("the number of bands must divide that of the permutations")
    r = PERMUTATIONS // bands
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("signature")[i * r + j] for j in range(r)]) for i in range(bands)])
    return sig.select("doc", F.explode(keys).alias("key"))


def share_band(a, b, bands: int = BANDS):
    """Whether two signatures agree in all rows of a band."""
    r = PERMUTATIONS // bands
    return F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.slice(a, i * r + 1, r) == F.slice(b, i * r + 1, r))


def similar_heads(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, pairs): the first document of each signature, and pairs (a, b, similarity) of heads that share a band.

    Documents of equal signatures meet only through their head, and a crowded band is split into blocks, so no band is joined with itself in one task.
    """
    heads = stage(sig.groupBy("signature").agg(F.min("doc").alias("doc")), "heads")
    met = pairs_within(band_keys(heads), ["key"], "doc").select("a", "b").distinct()
    side = lambda c: heads.select(F.col("doc").alias(c), F.col("signature").alias(f"s{c}"))
    return heads, stage(met.join(side("a"), "a").join(side("b"), "b").where(share_band("sa", "sb")).select("a", "b", agreement("sa", "sb").alias("similarity")), "near")


def verdicts(sig: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, matched, similarity, passed): each document against all earlier ones, kept or not; the most similar, the first of equals. Documents that meet none pass with 0."""
    heads, pairs = similar_heads(sig)
    near = pairs.select(F.col("a").alias("earlier"), F.col("b").alias("doc"), "similarity")
    copies = sig.select("doc", "signature").join(heads.withColumnRenamed("doc", "earlier"), "signature").where("doc <> earlier").select("earlier", "doc", F.lit(1.0).alias("similarity"))
    best = near.unionByName(copies).groupBy("doc").agg(F.max(F.struct("similarity", (-F.col("earlier")).alias("e"))).alias("m"))
    s = F.coalesce("m.similarity", F.lit(0.0))
    return sig.select("doc").join(best, "doc", "left").select("doc", (-F.col("m.e")).alias("matched"), s.alias("similarity"), (s < threshold).alias("passed"))


def exact_jaccard(sig: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard): pairs of heads whose sets of shingles are that similar; candidates share a band."""
    _, pairs = similar_heads(sig)
    sets = sig.groupBy("doc").agg(F.first("shingles").alias("s"))
    j = pairs.join(sets.select(F.col("doc").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("s").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return j.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("jaccard")).where(F.col("jaccard") >= threshold)
