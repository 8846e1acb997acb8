"""Groups of near-duplicate texts by pigeonring filtering of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shingles import WordIds, prefix_length, set_id, shingle_batch, token_batch
from corpusmill.operators.blocks import pairs_within
from corpusmill.operators.graph import connected_components
from corpusmill.runtime import spread, stage, unstage

SEGMENTS, FINE_BITS = 8, 2048
#: Counters of shingles: one for each 64 of them, within these bounds (4 to 64 MB).
COUNTERS, MOST_COUNTERS = 1 << 20, 1 << 24
SLICES = 64  # tasks that add up counters or filter bits
#: Key groups up to this size are compared within a task; larger ones are split by a second shared shingle.
GROUP = 256
#: A shingle whose counter is above this, and above CROWD times the mean counter, is never gathered: its texts take the second shingle at once.
HOT, CROWD = 50_000, 16
#: Pairs are looked for in rounds by the smaller set's size, each over so many shingles, so that what is met by chance never lies on disk all at once.
ROUND, NO_END = 100_000_000, 1 << 31
RECORD = np.dtype([("key", "<u8"), ("set", "<i8"), ("n", "<u4"), ("at", "<u4")])
SKETCH = [f"k{i}" for i in range(SEGMENTS)]
SETS = ", ".join(["row long", "set long", "high long", "n int", *(f"{c} long" for c in SKETCH), "shingles binary"])
#: Where sets are of two sides, this bit of a set's number tells its side.
SIDE = 1


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """A bit vector of 8 segments of 64: each shingle flips one bit, so two vectors differ in at most as many bits as the sets in shingles."""
    bits = np.bincount((s >> np.uint64(20)) % np.uint64(64 * SEGMENTS), minlength=64 * SEGMENTS) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def sets_of_texts(k: int):
    """Rows (row, text) to their shingle sets, by a 128-bit number, with bit vectors; texts without words are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for pdf in batches:
            sets = shingle_batch(*token_batch(pdf["text"], ids), k)
            keep = np.array([len(s) > 0 for s in sets], bool)
            sets = [s for s in sets if len(s)]
            sketches = np.array([odd_sketch(s) for s in sets], "<i8").reshape(len(sets), SEGMENTS)
            ids128 = [set_id(s) for s in sets]
            low, high = (np.array([(x >> r) & 0xFFFFFFFFFFFFFFFF for x in ids128], np.uint64).view(np.int64) for r in (0, 64))
            out = pd.DataFrame({"row": pdf["row"].to_numpy()[keep], "set": low, "high": high, "n": np.array([len(s) for s in sets], np.int32)})
            for i, c in enumerate(SKETCH):
                out[c] = sketches[:, i]
            out["shingles"] = [s.tobytes() for s in sets]
            yield out

    return run


def _count(counters: int):
    """A task's counts of shingles by counter, cut to slices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(counters, np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf["shingles"]), "<u8") % np.uint64(counters), minlength=counters)
        cut = np.minimum(total, 2**31 - 1).astype("<u4").reshape(SLICES, -1)
        yield pd.DataFrame({"slice": np.arange(SLICES), "counts": [c.tobytes() for c in cut]})

    return run


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[int, np.ndarray] = {}
    for pdf in batches:
        for i, b in zip(pdf["slice"], pdf["counts"], strict=True):
            c = np.frombuffer(b, "<u4").astype(np.int64)
            totals[i] = totals[i] + c if i in totals else c
    yield pd.DataFrame({"slice": list(totals), "counts": [np.minimum(c, 2**31 - 1).astype("<u4").tobytes() for c in totals.values()]})


def shingle_frequencies(sets: DataFrame, shingles: int) -> np.ndarray:
    """How often shingles fall on each counter, over all texts; tasks hand their counts on in slices, so no task adds up more than 1 / SLICES of them."""
    counters = min(MOST_COUNTERS, max(COUNTERS, 1 << max(0, shingles // 64).bit_length()))
    cores = sets.sparkSession.sparkContext.defaultParallelism
    part = sets.select("shingles")
    part = part.coalesce(cores) if part.rdd.getNumPartitions() > cores else part
    rows = part.mapInPandas(_count(counters), "slice int, counts binary").repartition(min(SLICES, cores), "slice").mapInPandas(_add, "slice int, counts binary").collect()  # 4 bytes a counter
    if not rows:
        return np.zeros(counters, "<u4")
    return np.concatenate([np.frombuffer(r["counts"], "<u4") for r in sorted(rows, key=lambda r: r["slice"])])


def least_shared(n):
    """How many shingles two similar sets, the smaller of n, must share within their prefixes: the prefixes are longer by as many less one."""
    return 1 + n // 32


def least_shared_of(n: Column) -> Column:
    return F.floor(n / F.lit(32)) + F.lit(1)


def size_bands(sets: DataFrame, shingles: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """(from, to, most, shingles): bands [from, to) of the smaller set's size, about ROUND shingles in each; the largest size that a set similar to one of them has, and the shingles of all sets from `from` to that size."""
    if shingles <= ROUND:
        return [(0, NO_END, NO_END, shingles)]
    rows = [(r["n"], r["s"]) for r in sets.groupBy("n").agg(F.sum("n").alias("s")).orderBy("n").collect()]  # a row for each size
    edges, held = [0], 0
    for n, s in rows:
        if held >= ROUND:
            edges.append(n)
            held = 0
        held += s
    bands = []
    for low, end in zip(edges, [*edges[1:], NO_END], strict=True):
        most = NO_END if end == NO_END else int((end - 1) / similarity + 1e-9)
        bands.append((low, end, most, sum(s for n, s in rows if low <= n <= most)))
    return bands


def _prefixes(similarity: float, frequency, ranges: int):
    """Each text's rarest shingles, enough that similar texts share one, as records cut by range of the shingle; those of crowded shingles go to range -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = frequency.value
        hot = max(HOT, CROWD * float(f.mean()))
        for pdf in batches:
            pdf = pdf.drop_duplicates("set")
            parts = []
            for s, set_, n in zip(pdf["shingles"], pdf["set"], pdf["n"], strict=True):
                h = np.frombuffer(s, "<u8")
                p = min(n, prefix_length(n, similarity) + least_shared(n) - 1)
                rank = np.lexsort((h, f[h % np.uint64(len(f))]))[:p]
                r = np.empty(p, RECORD)
                r["key"], r["set"], r["n"], r["at"] = h[rank], set_, n, np.arange(p)
                parts.append(r)
            if not parts:
                continue
            r = np.concatenate(parts)
            to = ((r["key"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            crowded = f[r["key"] % np.uint64(len(f))] > hot
            # all records of such a shingle are told by the same counter, so none is left behind; they stay where they are
            to[crowded] = -1 - (r["set"][crowded] % ranges)
            order = np.argsort(to, kind="stable")
            r, to = r[order], to[order]
            starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            ends = np.append(starts[1:], len(r))
            yield pd.DataFrame({"range": to[starts], "records": [r[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]})

    return run


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts, np.diff(np.append(starts, len(key)))


def _viable(n_a, at_a, n_b, at_b, similarity: float) -> np.ndarray:
    """Sizes within the similarity's bounds, and the shared shingle within both texts' prefixes for the overlap that these sizes need."""
    lo, hi = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    need = np.ceil(similarity / (1 + similarity) * (lo + hi) - 1e-9)
    need = need - least_shared(lo) + 1
    return (lo >= similarity * hi - 1e-9) & (n_a - at_a >= need) & (n_b - at_b >= need)


def _candidates(similarity: float, end: int, across: bool = False):
    """Pairs of sets that share a record's key, and how often, the smaller set of fewer than `end` shingles; `across`: only those of opposite sides. A range's records are sorted once; equal offsets within runs of a key are compared as arrays."""

    def count(seen: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((seen[:, 1], seen[:, 0]))
        seen, k = seen[order], k[order]
        new = np.concatenate([[True], (seen[1:, :2] != seen[:-1, :2]).any(1)])
        return seen[new], np.add.reduceat(k, np.flatnonzero(new))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(blobs: list[bytes], told: bool):
            r = np.frombuffer(b"".join(blobs), RECORD)
            if told:
                yield pd.DataFrame({"a": r["set"], "b": np.ascontiguousarray(r["key"]).view(np.int64), "n": r["n"].astype(np.int32), "k": np.zeros(len(r), np.int32)})
                return
            r = r[np.lexsort((r["set"], r["key"]))]
            same = (r["key"][1:] == r["key"][:-1]) & (r["set"][1:] == r["set"][:-1])
            r = r[np.concatenate([[True], ~same])]
            starts, size = _runs(r["key"])
            big = size > GROUP
            if big.any():
                take = np.concatenate([np.arange(s, s + m) for s, m in zip(starts[big], size[big], strict=True)])
                g = r[take]
                yield pd.DataFrame({"a": g["set"], "b": np.ascontiguousarray(g["key"]).view(np.int64), "n": g["n"].astype(np.int32), "k": np.zeros(len(g), np.int32)})
            small = ~big & (size > 1)
            starts, size = starts[small], size[small]
            seen, k_seen = np.empty((0, 3), np.int64), np.empty(0, np.int64)
            for d in range(1, int(size.max(initial=1))):
                m = size > d
                s, k = starts[m], size[m] - d
                base = np.repeat(s, k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
                x, y = r[base], r[base + d]
                ok = _viable(x["n"].astype(np.int64), x["at"], y["n"].astype(np.int64), y["at"], similarity) & (np.minimum(x["n"], y["n"]) < end)
                if across:
                    ok &= (x["set"] ^ y["set"]) & SIDE == SIDE
                if ok.any():
                    a, b = x["set"][ok], y["set"][ok]
                    smaller = np.minimum(x["n"][ok], y["n"][ok]).astype(np.int64)
                    seen = np.concatenate([seen, np.stack([np.minimum(a, b), np.maximum(a, b), smaller], 1)])
                    k_seen = np.concatenate([k_seen, np.ones(len(a), np.int64)])
                if len(seen) > 2_000_000:
                    seen, k_seen = count(seen, k_seen)
            if len(seen):
                seen, k_seen = count(seen, k_seen)
                yield pd.DataFrame({"a": seen[:, 0], "b": seen[:, 1], "n": seen[:, 2].astype(np.int32), "k": k_seen.astype(np.int32)})

        held: dict[int, list[bytes]] = {}
        for pdf in batches:
            for g, b in zip(pdf["range"], pdf["records"], strict=True):
                if g < 0:
                    yield from flush([b], True)
                else:
                    held.setdefault(g, []).append(b)
        for g in list(held):
            yield from flush(held.pop(g), False)

    return run


def _second_keys(similarity: float, frequency):
    """For texts in crowded groups: one record for each further shingle, up to one more than the prefix, keyed by both shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = frequency.value
        for pdf in batches:
            parts = []
            for s, set_, n, key in zip(pdf["shingles"], pdf["set"], pdf["n"], pdf["key"], strict=True):
                h = np.frombuffer(s, "<u8")
                first = np.uint64(np.int64(key).view(np.uint64))
                # shares `key` and at least one of the others in a prefix that is longer by one, unless one shared shingle is enough
                p = min(n, prefix_length(n, similarity) + 1)
                rank = np.lexsort((h, f[h % np.uint64(len(f))]))[:p]
                other = h[rank]
                other = other[other != first]
                r = np.empty(len(other), [("key", "<u8"), ("set", "<i8")])
                with np.errstate(over="ignore"):
                    r["key"] = (other * np.uint64(0x9E3779B97F4A7C15)) ^ first
                r["set"] = set_
                parts.append(r)
            if parts:
                r = np.concatenate(parts)
                yield pd.DataFrame({"key": r["key"].view(np.int64), "set": r["set"]})

    return run


def ring_filter(budget: Column, d: list[Column]) -> Column:
    """Pigeonring: if the differences d of a ring of m segments sum to at most `budget`, from some segment on every chain of l segments differs in at most l * budget / m.

    False means that the sum is above the budget for certain.
    """
    m = len(d)
    start = None
    for i in range(m):
        chain, so_far = None, None
        for j in range(m):
            so_far = d[(i + j) % m] if so_far is None else so_far + d[(i + j) % m]
            ok = so_far * F.lit(m) <= budget * F.lit(j + 1)
            chain = ok if chain is None else chain & ok
        start = chain if start is None else start | chain
    return start


#: Bits of the filter for each set, and the most it may have (128 MB); beyond, texts are joined without it.
BITS_EACH, MOST_BITS = 12, 1 << 30


def _slots(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = ids.view(np.uint64)
    return [(h >> np.uint64(r)) % np.uint64(bits) for r in (0, 19, 33)]


def _mark(bits: int):
    """The filter's slices, each from the slots that fall on it."""
    width = bits // SLICES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, s in zip(pdf["slice"], pdf["slots"], strict=True):
                if i not in held:
                    held[i] = np.zeros(width, bool)
                held[i][np.frombuffer(s, "<u4")] = True
        yield pd.DataFrame({"slice": list(held), "bits": [np.packbits(x).tobytes() for x in held.values()]})

    return run


def _cut_slots(bits: int):
    width = bits // SLICES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.concatenate(_slots(pdf["set"].to_numpy(), bits)) if len(pdf) else np.empty(0, np.uint64)
            to = (at // np.uint64(width)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            at, to = at[order], to[order]
            starts, size = _runs(to) if len(to) else (np.empty(0, int), np.empty(0, int))
            yield pd.DataFrame({"slice": to[starts], "slots": [(at[s : s + m] % np.uint64(width)).astype("<u4").tobytes() for s, m in zip(starts, size, strict=True)]})

    return run


def only_involved(sets: DataFrame, involved: DataFrame) -> DataFrame:
    """The rows of `sets` whose set is in `involved`, and a few others; a Bloom filter of BITS_EACH bits a set, made in slices by all tasks, spares the rest a shuffle."""
    n = involved.count()
    bits = max(1 << 16, 1 << (BITS_EACH * n).bit_length())
    if bits > MOST_BITS:
        return sets
    tasks = min(SLICES, sets.sparkSession.sparkContext.defaultParallelism)
    rows = involved.mapInPandas(_cut_slots(bits), "slice long, slots binary").repartition(tasks, "slice").mapInPandas(_mark(bits), "slice long, bits binary").collect()  # at most MOST_BITS
    whole = np.zeros(bits // 8, np.uint8).reshape(SLICES, -1)
    for r in rows:
        whole[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    shared = sets.sparkSession.sparkContext.broadcast(whole.tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(shared.value, np.uint8)
        for pdf in batches:
            keep = np.ones(len(pdf), bool)
            for slot in _slots(pdf["set"].to_numpy(), bits):
                keep &= (held[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 == 1
            yield pdf[keep]

    return sets.mapInPandas(run, sets.schema)


def _fine_sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for s in pdf["shingles"]:
            bits = np.bincount((np.frombuffer(s, "<u8") >> np.uint64(16)) % np.uint64(FINE_BITS), minlength=FINE_BITS) & 1
            out.append(np.packbits(bits.astype(np.uint8)).tobytes())
        yield pdf[["set", "n"]].assign(fine=out)


def _near(similarity: float):
    """The ring filter's last chain, the sum, on the finer vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["fa"]), np.uint64).reshape(len(pdf), -1)
            y = np.frombuffer(b"".join(pdf["fb"]), np.uint64).reshape(len(pdf), -1)
            far = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield pdf.loc[far <= np.floor((1 - similarity) / (1 + similarity) * (pdf["na"] + pdf["nb"]) + 1e-9), ["a", "b"]]

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield pdf.loc[ok, ["a", "b"]]

    return run


def close_sets(sets: DataFrame, similarity: float, across: bool = False) -> DataFrame:
    """Pairs (a, b) of different sets, by `set`, that steps 1 to 3 of similar_sets() leave; `across`: only those whose numbers differ in the bit SIDE."""
    spark = sets.sparkSession
    size = sets.agg(F.sum("n")).first()[0] or 0
    frequency = spark.sparkContext.broadcast(shingle_frequencies(sets, size))  # 4 to 64 MB by construction
    bands = size_bands(sets, size, similarity)
    pairs, crowded, done = None, None, []
    for low, end, most, held in bands:
        ranges = max(2 * spark.sparkContext.defaultParallelism, int(held * (1 - similarity) * RECORD.itemsize / 12e6) + 1)
        some = sets if len(bands) == 1 else sets.where(F.col("n").between(low, most))
        records = some.select("set", "n", "shingles").mapInPandas(_prefixes(similarity, frequency, ranges), "range long, records binary")
        met = stage(records.repartition(ranges, "range").mapInPandas(_candidates(similarity, end, across), "a long, b long, n int, k int"), "candidates")
        enough = met.where("k > 0").groupBy("a", "b").agg(F.first("n").alias("n"), F.sum("k").alias("k")).where(F.col("k") >= least_shared_of(F.col("n"))).select("a", "b")
        told = met.where("k = 0").select(F.col("a").alias("set"), F.col("b").alias("key"))
        if len(bands) > 1:
            enough, told = stage(enough, "enough"), stage(told, "crowded")
            unstage(met)
            done += [enough, told]
        else:
            done.append(met)
        pairs, crowded = (enough, told) if pairs is None else (pairs.unionByName(enough), crowded.unionByName(told))
    crowded = crowded.distinct() if len(bands) > 1 else crowded  # a set comes up in several rounds
    if not crowded.isEmpty():
        unique = sets.join(crowded.select("set").distinct(), "set", "left_semi").dropDuplicates(["set"]).select("set", "n", "shingles")
        again = stage(crowded.join(unique, "set").mapInPandas(_second_keys(similarity, frequency), "key long, set long").distinct(), "second-keys")
        sized = stage(again.join(unique.select("set", "n"), "set"), "second-sized")
        within = pairs_within(sized, ["key"], "set", block=GROUP, keep=["n"], where=lambda left, right: F.least(left("n"), right("n")) >= F.greatest(left("n"), right("n")) * F.lit(similarity) - F.lit(1e-9))
        # sets so small that one shared shingle may do: 1 / (na + nb - 1) is at least the similarity, so neither has more than 1 / similarity
        tiny = crowded.join(unique.where(F.col("n") <= F.lit(int(1 / similarity + 1e-9))).select("set", "n"), "set")
        small = pairs_within(tiny, ["key"], "set", block=GROUP, keep=["n"])
        pairs = pairs.unionByName(within.select("a", "b")).unionByName(small.select("a", "b"))
    if across:  # crowded groups pair all their sets
        pairs = pairs.where(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(SIDE)) == SIDE)
    pairs = pairs.distinct()
    heads = sets.groupBy("set").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in SKETCH])
    of = lambda x: heads.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{x}{c}") for c in SKETCH])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    budget = F.floor(F.lit((1 - similarity) / (1 + similarity)) * (F.col("na") + F.col("nb")) + F.lit(1e-9))
    d = [F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in SKETCH]
    held = stage(both.where(ring_filter(budget, d)).select("a", "b"), "ring")
    unstage(*done)
    return held

def similar_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different sets, by `set`, whose Jaccard similarity is at least `similarity`; sets(set, n, k0..k7, shingles), repeats allowed.

    Jaccard similarity t means that the indicator vectors' Hamming distance is at most (1 - t) / (1 + t) * (|A| + |B|).
    1. Each set's shingles are ordered rarest first, by counters filled from all texts, and the first n - ceil(t n) + 1 are sent
       by range of the shingle to tasks that pair sets with a shingle in common. Any two similar sets meet there; frequent
       shingles come last in the order and are hardly ever sent. Prefixes are longer by a few shingles, and a pair must share as many
       more, which leaves few chance meetings. 2. Groups of more than GROUP sets at a shingle are not paired:
       their sets are sent again by two shingles, which similar sets share too if they share more than one. 3. The ring
       of segments of the sets' bit vectors must hold a start from which all chains stay within their share of the distance; what is left is held
       against longer vectors. 4. The full distance is computed on the shingles. Nothing is capped and no step loses a pair.
    Above ROUND shingles, 1. goes by rounds, one for each band of the smaller set's size, so that meetings are counted and gone before the next.
    """
    held = close_sets(sets, similarity)
    involved = stage(held.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "involved")
    texts = stage(only_involved(sets.select("set", "n", "shingles"), involved).join(involved, "set", "left_semi").dropDuplicates(["set"]), "texts")
    fine = texts.mapInPandas(_fine_sketch, "set long, n int, fine binary")
    side = lambda x: fine.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    near = stage(held.join(side("a"), "a").join(side("b"), "b").mapInPandas(_near(similarity), "a long, b long"), "near")
    j = near.join(texts.select(F.col("set").alias("a"), F.col("shingles").alias("sa")), "a").join(texts.select(F.col("set").alias("b"), F.col("shingles").alias("sb")), "b")
    out = stage(j.select("a", "b", "sa", "sb").mapInPandas(_verify(similarity), "a long, b long"), "similar")
    unstage(held, involved, texts, near)
    return out


def apart(sets: DataFrame) -> DataFrame:
    """sets without `high`: where different sets have the same 64-bit number, all but one get another, made of all 128 bits.

    Of 1e10 sets a few share their number. They are found by comparing the other 64 bits, and their numbers are few enough to be broadcast:
    n * n / 2^65 are expected, one in a billion at that size.
    """
    same = sets.groupBy("set").agg(F.min("high").alias("kept"), F.max("high").alias("most")).where("kept <> most").select("set", "kept")
    if same.isEmpty():
        return sets.drop("high")
    j = sets.join(F.broadcast(same), "set", "left")
    moved = F.when(F.col("kept").isNotNull() & (F.col("high") != F.col("kept")), F.xxhash64(F.lit("apart"), "set", "high")).otherwise(F.col("set"))
    return stage(j.withColumn("set", moved).drop("high", "kept"), "sets")


def near_duplicate_groups(df: DataFrame, row: str = "rec_no", text: str = "body", similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(row, group, links) for the rows in a group of two or more: rows linked by similar texts or chains of them.

    Similar: Jaccard similarity of the sets of `words`-word shingles (words are runs of letters and digits without case and accents; a text of
    fewer words is one shingle) at least `similarity`. `links` is the number of other
    distinct sets similar to the row's. Null texts and texts without words are in no group. Rows count each, repeated or not; copies share a
    set and are never compared with each other. group is its least row; sets are told apart by 128 bits.
    """
    src = df.where(F.col(text).isNotNull()).select(F.col(row).cast("long").alias("row"), F.col(text).alias("text"))
    sets = apart(stage(spread(src).mapInPandas(sets_of_texts(words), SETS), "sets"))
    pairs = similar_sets(sets, similarity)
    comp = connected_components(pairs, "a", "b")
    links = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    rows = sets.select("row", "set").join(comp.withColumnRenamed("node", "set"), "set", "left").join(links.withColumnRenamed("node", "set"), "set", "left")
    rows = rows.select("row", F.coalesce("component", "set").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    many = rows.groupBy("group").agg(F.count("*").alias("m"), F.min("row").alias("least")).where("m > 1").select("group", "least")
    out = stage(rows.join(many, "group").select(F.col("row").alias(row), F.col("least").alias("group"), "links"), "groups")
    unstage(pairs, comp)
    return out
