"""Mixing sources to target shares of the total size in tokens, along a curriculum that changes with time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import running_total, stage


def allot(stock: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens for each source: its share of `total`, at most its stock times its cap; what capped sources lack is shared by the others in proportion."""
    give = dict.fromkeys(targets, 0.0)
    limit = {s: stock.get(s, 0) * max(0, cap) for s, (_, cap) in targets.items()}
    open_ = {s for s, (w, _) in targets.items() if w > 0 and limit[s] > 0}
    left = total
    while open_ and left > 1e-9:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if give[s] + left * targets[s][0] / weight >= limit[s]}
        if not full:
            for s in open_:
                give[s] += left * targets[s][0] / weight
            break
        for s in full:
            left -= limit[s] - give[s]
            give[s] = float(limit[s])
        open_ -= full
    return give


def schedule_position(x: Column, ramp: Column) -> Column:
    """The time t in [0, 1] at which a source has had the share x of its tokens, where its weight is 1 + ramp * (2t - 1) times its mean.

    The weight's integral is t + ramp * (t^2 - t); solved for t. ramp in [-1, 1]: below 0 the source fades out, above 0 it fades in.
    """
    b = F.lit(1.0) - ramp
    root = F.sqrt(F.greatest(b * b + F.lit(4.0) * ramp * x, F.lit(0.0)))
    return F.when(F.abs(ramp) < 1e-9, x).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (root - b) / (F.lit(2.0) * ramp))))


def fade_in_repeated(give: dict[str, float], stock: dict[str, int], ramp: float = 0.5) -> dict[str, float]:
    """A schedule by source: those used more than once come late and the others early, so that repeats meet a model that has seen the rest."""
    return {s: ramp if stock.get(s) and g > stock[s] else -ramp for s, g in give.items()}


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, ramps: dict[str, float] | Callable | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(uses, report) for docs(doc_id, source, n_tokens) and targets(source, target_share, max_repeats).

    uses: one row for each use of a text: doc_id, source, n_tokens, use (1, 2, ...), position in [0, 1]; texts not used
    don't appear. `total` is the size of the mixture, the stock of the wanted sources if not given. A source's tokens
    over its stock gives its repeats r: every text is used floor(r) times, and the texts that come first in a seeded
    random order once more, up to the source's demand; a text counts while the tokens before it are below the demand. No text is used more than max_repeats times.
    `ramps` gives each source's schedule, as a dict or a function of the sources' tokens and stocks: its weight at time t is 1 + ramp * (2t - 1) times its mean.
    Each use's place on the source's token line is turned into a time by inverting the source's cumulative demand, and the time into a position
    by the cumulative demand of all sources: position is the share of all tokens that come before, so equal stretches
    of it hold equal numbers of tokens, and the weights of a time are each source's share of the demand at that time.
    report: source, target_share, share_reached, tokens_wanted, tokens_used, stock, repeats, shortfall.
    Sources without a target or without texts give no uses; a wanted source without texts is reported with stock 0. Null sources are none; texts of 0 tokens are never used. Repeated doc_ids are texts of their own.
    """
    from pyspark.sql import types as T

    spark = docs.sparkSession
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where("source is not null").collect()}  # one row for each source
    mine = docs.where("source is not null and n_tokens > 0").join(F.broadcast(targets.where("source is not null").select("source").distinct()), "source", "left_semi")
    mine = stage(mine.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")), "mix-docs")
    stock = {r["source"]: r["n"] for r in mine.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    size = float(sum(stock.values())) if total is None else float(total)
    give = allot(stock, goal, size)
    ramps = (ramps(give, stock) if callable(ramps) else ramps) or {}
    given = sum(give.values())
    tilt = sum(give[s] * float(ramps.get(s, 0.0)) for s in give) / given if given else 0.0
    rows = [(s, goal[s][0], goal[s][1], int(stock.get(s, 0)), give[s], float(ramps.get(s, 0.0))) for s in goal]
    names = [("source", T.StringType()), ("target_share", T.DoubleType()), ("max_repeats", T.IntegerType()), ("stock", T.LongType()), ("tokens_wanted", T.DoubleType()), ("ramp", T.DoubleType())]
    plan = spark.createDataFrame(rows, T.StructType([T.StructField(n, t) for n, t in names]))
    placed = running_total(mine.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")), ["_h", "doc_id"], "before", by="source", amount="n_tokens")
    j = placed.join(F.broadcast(plan), "source")
    # use k of a text begins at (k - 1) * stock + before on the source's token line
    uses = F.floor((F.col("tokens_wanted") - F.col("before") - F.lit(1e-6)) / F.col("stock")) + 1
    uses = F.least(F.greatest(uses, F.lit(0)), F.col("max_repeats")).cast("int")
    j = j.withColumn("k", uses).where("k > 0").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("k"))))
    at = (F.col("use") - 1) * F.col("stock") + F.col("before") + F.col("n_tokens") / 2.0
    x = F.least(F.lit(1.0), at / F.col("tokens_wanted"))
    t = schedule_position(x, F.col("ramp"))
    position = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t + F.lit(tilt) * (t * t - t)))
    out = stage(j.select("doc_id", "source", "n_tokens", "use", position.alias("position")), "mix-uses")
    got = out.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"))
    all_used = out.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_used"))
    r = plan.join(got, "source", "left").crossJoin(F.broadcast(all_used))  # one row on the right
    used = F.coalesce("tokens_used", F.lit(0))
    report = r.select("source", "target_share", (used / F.greatest("all_used", F.lit(1))).alias("share_reached"), "tokens_wanted", used.alias("tokens_used"), "stock", F.when(F.col("stock") > 0, used / F.col("stock")).alias("repeats"), F.greatest(F.col("target_share") * F.lit(size) - used, F.lit(0.0)).alias("shortfall"))
    return out.repartitionByRange("position").sortWithinPartitions("position", "doc_id", "use"), report
