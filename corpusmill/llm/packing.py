"""Filling containers of a fixed capacity with texts, by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import running_total


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many containers follow each, for `counts` items of each length up to capacity.

    Lengths are placed longest first, each into the shortest packs that still have room (those with most room left);
    all equal packs take items at once, so the work depends on the number of lengths and patterns, not of items. An item
    that fits nowhere opens a pack, which is then the shortest and takes the next items of the same length.
    """
    packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        if room not in packs or not packs[room]:
            heappush(rooms, -room)
        packs[room][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        if length <= 0:
            continue
        while left:
            while rooms and not packs.get(-rooms[0]):
                heappop(rooms)
            room = -rooms[0] if rooms else -1
            if room < length:
                each = capacity // length
                if left >= each:
                    put((length,) * each, capacity - each * length, left // each)
                if left % each:
                    put((length,) * (left % each), capacity - (left % each) * length, 1)
                break
            pattern, n = next(iter(packs[room].items()))
            take = min(n, left)
            if take == n:
                del packs[room][pattern]
            else:
                packs[room][pattern] = n - take
            put((*pattern, length), room - length, take)
            left -= take
    return [(p, n) for room in packs.values() for p, n in room.items() if n]


#: Ranks of a length that share a join key with the patterns that take them.
BLOCK = 1024


def pack(items: DataFrame, capacity: int, key: list[str], size: str = "n_tokens") -> DataFrame:
    """(*key, piece, n_tokens, container) for items with distinct keys: each item in one container, or in pieces if larger than capacity.

    An item of size s > capacity is cut into floor(s / capacity) pieces that fill a container each and a rest, which
    is packed like any item. Items of size 0 (null, empty texts) lie in container 0 if there are containers, else 0 opens one.
    The histogram of sizes has at most `capacity` rows. Each step of packing ends a length or a pattern, so patterns are few beside items, but
    their number has no bound that does not grow: they are joined back by (length, block of ranks), an ordinary join of keys of
    at most BLOCK items, never a broadcast. An item's rank among those of its size is counted without gathering a size in one task.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = items.sparkSession
    s = F.coalesce(F.col(size), F.lit(0)).cast("long")
    cut = items.select(*key, F.greatest(s, F.lit(0).cast("long")).alias("s"))
    full = F.floor(F.col("s") / F.lit(capacity))
    rest = F.col("s") - full * F.lit(capacity)
    whole = F.transform(F.sequence(F.lit(1).cast("long"), full), lambda i: F.struct((i - 1).alias("piece"), F.lit(capacity).cast("long").alias("n")))
    last = F.array(F.struct(full.alias("piece"), rest.alias("n")))
    pieces = F.when(full == 0, last).when(rest == 0, whole).otherwise(F.concat(whole, last))
    cut = cut.select(*key, F.explode(pieces).alias("p")).select(*key, "p.piece", F.col("p.n").alias("n_tokens"))
    ranked = running_total(cut, [*key, "piece"], "rank", by="n_tokens")
    counts = {r["n_tokens"]: r["n"] for r in ranked.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    rows: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, n in sorted(pack_histogram(counts, capacity)):
        for length in pattern:
            rows.append((length, used[length], used[length] + n, first))
            used[length] += n
        first += n
    if 0 in counts:
        rows.append((0, 0, counts[0], -1))
    plan = spark.createDataFrame(rows, "n_tokens long, lo long, hi long, first long")
    block = lambda c: F.floor(c / F.lit(BLOCK))
    plan = plan.withColumn("block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))))
    joined = ranked.withColumn("block", block(F.col("rank"))).join(plan, ["n_tokens", "block"]).where("rank >= lo and rank < hi")
    container = F.when(F.col("first") < 0, F.lit(0).cast("long")).otherwise(F.col("first") + F.col("rank") - F.col("lo"))
    return joined.select(*key, "piece", "n_tokens", container.alias("container"))
