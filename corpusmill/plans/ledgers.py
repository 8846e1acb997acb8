"""Ledger of requests: prices, budgets, provenance, efficiency, completeness; draws and specifications."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import hash60, r6
from corpusmill.functions.fields import billions
from corpusmill.functions.spellings import aliases, model_key
from corpusmill.plans.evaluation import PRED, _evaluated, _labels
from corpusmill.plans.pairing import FX, facets, hash_sql
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6
from corpusmill.plans.statistics import SCORES, _scores
from corpusmill.sources.tables import table

#: Distinct requests, the first received of each.
FIRST = "l as (select * from (select *, row_number() over (partition by request_id order by received_at, coalesce(cost_usd, -1), model) as r from cost_ledger) where r = 1)"
COLS = ("model", "run_id", "input_tokens", "output_tokens", "cost_usd", "provider_served", "spec_id", "status", "received_at")


def first_requests(spark, d):
    """One row for each request, by a minimum: repeats are never gathered."""
    l = table(spark, d, "cost_ledger")  # noqa: E741
    order = F.struct("received_at", F.coalesce("cost_usd", F.lit(-1.0)).alias("c"), "model")
    return l.groupBy("request_id").agg(F.min_by(F.struct(*COLS), order).alias("x")).select("request_id", "x.*")


#: Own values: prices of a million tokens, in and out, by size of prompt, and the discount of batches.
TIERS = ((0, 0.5, 1.5), (1000, 0.4, 1.2), (4000, 0.3, 1.0))
BATCH_DISCOUNT, TOLERANCE = 0.5, 0.25
TIER_SQL = "t(lo, pin, pout) as (values " + ", ".join(f"({a}, {b}::double, {c}::double)" for a, b, c in TIERS) + ")"
PRICED = f"with {FIRST}, {TIER_SQL}, p as (select l.request_id, l.run_id, cost_usd, (input_tokens * pin + output_tokens * pout) / 1e6 * case when ends_with(l.run_id, '0') then {BATCH_DISCOUNT} else 1 end as cost, lo from l join t on t.lo = (select max(lo) from t where lo <= l.input_tokens) where input_tokens >= 0 and output_tokens >= 0)"


def _priced(spark, d):
    """Requests with the price of their tier, found in an array of a few: an as-of lookup without a join."""
    tiers = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("pin"), F.lit(c).alias("pout")) for a, b, c in TIERS])
    l = first_requests(spark, d).where("input_tokens >= 0 and output_tokens >= 0")  # noqa: E741
    t = l.withColumn("t", F.array_max(F.filter(tiers, lambda x: x["lo"] <= F.col("input_tokens"))))
    cost = (F.col("input_tokens") * F.col("t.pin") + F.col("output_tokens") * F.col("t.pout")) / F.lit(1e6) * F.when(F.endswith("run_id", F.lit("0")), BATCH_DISCOUNT).otherwise(1.0)
    return t.select("request_id", "run_id", "cost_usd", cost.alias("cost"), F.col("t.lo").alias("lo"))


@query(f"{PRICED} select lo::bigint as tier, count(*) as requests, {R6.format('sum(cost)')} as cost from p group by lo")
def tiered_costs(spark, d):
    return _priced(spark, d).groupBy(F.col("lo").cast("long").alias("tier")).agg(F.count("*").alias("requests"), r6(F.sum("cost")).alias("cost"))


@query(f"{PRICED} select case when cost_usd is null then 'not stated' when abs(cost - cost_usd) <= {TOLERANCE} * cost_usd then 'agrees' when cost > cost_usd then 'stated too low' else 'stated too high' end as verdict, count(*) as n from p group by 1")
def price_cross_check(spark, d):
    """Stated costs against computed ones, within a tolerance."""
    c, s = F.col("cost"), F.col("cost_usd")
    v = F.when(s.isNull(), "not stated").when(F.abs(c - s) <= TOLERANCE * s, "agrees").when(c > s, "stated too low").otherwise("stated too high")
    return _priced(spark, d).groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


CAP = 0.05
MODEL = "coalesce(nullif(trim(model), ''), 'unknown')"


@query(f"with {FIRST} select {MODEL} as model, count(*) as requests, {R6.format('sum(coalesce(cost_usd, 0))')} as spent, {R6.format(f'greatest({CAP} - sum(coalesce(cost_usd, 0)), 0)')} as remaining, sum(coalesce(cost_usd, 0)) >= {CAP} as exhausted from l group by 1")
def budget_report(spark, d):
    spent = F.sum(F.coalesce("cost_usd", F.lit(0.0)))
    m = F.coalesce(F.nullif(F.trim("model"), F.lit("")), F.lit("unknown"))
    return first_requests(spark, d).groupBy(m.alias("model")).agg(F.count("*").alias("requests"), r6(spent).alias("spent"), r6(F.greatest(F.lit(CAP) - spent, F.lit(0.0))).alias("remaining"), (spent >= CAP).alias("exhausted"))


@query("select distinct spec_id from cost_ledger where lower(status) = 'ok' and spec_id is not null")
def completed_specs(spark, d):
    return table(spark, d, "cost_ledger").where((F.lower("status") == "ok") & F.col("spec_id").isNotNull()).select("spec_id").distinct()


PROVENANCE = ("git_commit", "code_version", "provider_served", "prompt_variant_id", "block_id")


@query("with x as (" + " union all ".join(f"select '{c}' as field, {c} as v from shelf_features where {c} <> ''" for c in PROVENANCE) + "), c as (select field, v, count(*) as n from x group by 1, 2), r as (select *, row_number() over (partition by field order by n desc, v) as r from c) select field, count(*) as different, sum(n)::bigint as n_values, max(v) filter (where r = 1) as most_common, max(n) as times from r group by field")
def provenance(spark, d):
    """Different values of each field of provenance, and the most common one."""
    s = table(spark, d, "shelf_features")
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in PROVENANCE])
    c = s.select(F.explode(rows).alias("x")).where("x.v <> ''").groupBy("x.field", "x.v").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "v"))
    return c.groupBy("field").agg(F.count("*").alias("different"), F.sum("n").alias("n_values"), best.alias("b")).select("field", "different", "n_values", F.col("b.v").alias("most_common"), (-F.col("b.n")).alias("times"))


MKEY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), '^.*/', ''), '[:@](free|paid|latest|beta|preview|community|self|extended)\s*$', ''), '^[^:@]*[:@]', ''), '([0-9])[^\p{L}\p{N}]+([0-9])', '\1~\2', 'g'), '[^\p{L}\p{N}~]+', '', 'g')"
RESOLVED = f"with known as (select term, {MKEY.replace('{}', 'term')} as k from label_space where facet = 'model'), r as (select model, {MKEY.replace('{}', 'model')} as k from cost_ledger where trim(model) <> '')"


@query(f"{RESOLVED} select coalesce(case when r.model = e.term then 'exact' when n.k is not null then 'normalised' end, 'default') as kind, count(*) as requests, count(distinct r.model) as spellings from r left join known e on e.term = r.model left join (select distinct k from known) n on n.k = r.k group by 1")
def resolved_prices(spark, d):
    """How the ledger's models are found in the table of known ones: as they stand, after normalisation, or not at all."""
    known = F.broadcast(aliases(table(spark, d, "label_space")).where("facet = 'model'").select(F.col("key").alias("k"), "term"))  # a small label space
    r = table(spark, d, "cost_ledger").where("trim(model) <> ''").select("model", model_key(F.col("model")).alias("k"))
    kind = F.when(F.col("model") == F.col("term"), "exact").when(F.col("term").isNotNull(), "normalised").otherwise("default")
    return r.join(known, "k", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("requests"), F.countDistinct("model").alias("spellings"))


SIZE = r"try_cast(nullif(regexp_extract(lower(model), '(?:^|[^a-z0-9.])(\d+(?:\.\d+)?)b(?:$|[^a-z0-9])', 1), '') as double)"
EFF = f"""{FIRST}, e as (select {MKEY.replace('{}', 'model')} as m, {SIZE} as b, (lower(status) = 'ok')::int as ok from l where trim(model) <> ''), g as (select m as model, avg(ok) as score, max(b) as b, count(*) as n from e where b is not null group by 1 having count(*) >= 5),
f as (select *, case when b < 1 then 'tiny' when b < 4 then 'small' when b < 15 then 'medium' when b < 80 then 'large' else 'frontier' end as size from g)"""


def _efficiency(spark, d):
    from corpusmill.functions.fields import size_category

    e = first_requests(spark, d).where("trim(model) <> ''").select(model_key(F.col("model")).alias("model"), billions(F.col("model")).alias("b"), (F.lower("status") == "ok").cast("int").alias("ok"))
    g = e.where("b is not null").groupBy("model").agg(F.avg("ok").alias("score"), F.max("b").alias("b"), F.count("*").alias("n")).where("n >= 5")
    return g.withColumn("size", size_category(F.col("b")))


@query(f"with {EFF}, t as (select max(score) as top from f) select model, size, n, {R6.format('score')} as score, {R6.format('score * 1000 / log10(b * 1e9)')} as efficiency, {R6.format('score / top / pow(b / 7, 0.1)')} as relative, row_number() over (partition by size order by {R6.format('score')} desc, model) as size_rank from f cross join t")
def efficiency_scores(spark, d):
    """Share of good requests against size: per log of parameters, relative to the best at 7 billion, and the rank among models of like size."""
    f = _efficiency(spark, d)
    t = f.agg(F.max("score").alias("top"))
    rank = F.row_number().over(Window.partitionBy("size").orderBy(r6(F.col("score")).desc(), "model"))  # a row for each model
    return f.crossJoin(F.broadcast(t)).select("model", "size", "n", r6(F.col("score")).alias("score"), r6(F.col("score") * 1000 / F.log10(F.col("b") * 1e9)).alias("efficiency"), r6(F.col("score") / F.col("top") / F.pow(F.col("b") / 7, F.lit(0.1))).alias("relative"), rank.cast("long").alias("size_rank"))


@query(f"with {EFF}, k as (select model, b, {R6.format('score')} as score from f) select a.model, a.b as billions, a.score from k a where not exists (select 1 from k x where x.b <= a.b and x.score >= a.score and (x.b < a.b or x.score > a.score))")
def efficiency_frontier(spark, d):
    """Models that no smaller one beats, by a running maximum over sizes."""
    k = _efficiency(spark, d).select("model", "b", r6(F.col("score")).alias("score"))
    by = k.groupBy("b").agg(F.max("score").alias("top"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each size
    j = k.join(by.withColumn("smaller", F.max("top").over(w)), "b")
    return j.where((F.col("score") == F.col("top")) & (F.col("smaller").isNull() | (F.col("score") > F.col("smaller")))).select("model", F.col("b").alias("billions"), "score")


@query(f"with {EFF} select model, {R6.format('score')} as score, b as billions from f order by {R6.format('score')} desc, b, model limit 10")
def efficiency_leaderboard(spark, d):
    f = _efficiency(spark, d).select("model", r6(F.col("score")).alias("score"), F.col("b").alias("billions"))
    return f.orderBy(F.desc("score"), "billions", "model").limit(10)


#: Weights of kinds of tasks, renormalised over those present.
WEIGHTS = {"retrieval": 0.30, "classification": 0.25, "clustering": 0.20, "pairs": 0.25}


@query(f"""with {SCORES}, cm as (select model, 'classification' as kind, avg(score) as s from sc group by 1), pa as (select run_name as model, score, y from (select run_name, confidence as score, (truth = pred)::int as y from ev where confidence is not null)), rk as (select model, y, rank() over (partition by model order by score) + (count(*) over (partition by model, score) - 1) / 2.0 as r from pa),
au as (select model, 'pairs' as kind, (sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as s from rk group by 1), al as (select * from cm union all select * from au), w(kind, w) as (values {', '.join(f"('{k}', {v}::double)" for k, v in WEIGHTS.items())})
select model, count(*) as kinds, {R6.format('sum(w * s) / sum(w)')} as score from al join w using (kind) group by model""")
def weighted_model_score(spark, d):
    """Mean score by kind of task, then weighted over the kinds a run has: mean accuracy over classes, and AUC of confidence."""
    cm = _scores(spark, d).groupBy("model").agg(F.avg("score").alias("s")).select("model", F.lit("classification").alias("kind"), "s")
    p = _evaluated(spark, d).where("confidence is not null").select(F.col("run_name").alias("model"), F.col("confidence").alias("score"), (F.col("truth") == F.col("pred")).cast("int").alias("y"))
    by = p.groupBy("model", "score").agg(F.sum("y").alias("pos"), (F.count("*") - F.sum("y")).alias("neg"))
    w = Window.partitionBy("model").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # distinct scores
    u = by.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    au = u.groupBy("model").agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)) / (F.sum("pos").cast("double") * F.sum("neg"))).alias("s")).select("model", F.lit("pairs").alias("kind"), "s")
    weight = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    return cm.unionByName(au).groupBy("model").agg(F.count("*").alias("kinds"), r6(F.sum(weight * F.col("s")) / F.sum(weight)).alias("score"))


@query(f"with {PRED}, m as (select distinct run_name from class_predictions), n as (select run_name, truth, count(*) as n from ev group by 1, 2) select m.run_name, l.label, coalesce(n.n, 0) as n, coalesce(n.n, 0) = 0 as missing, sum(coalesce(n.n, 0)) over (partition by l.label) = 0 as missing_everywhere from m cross join labels l left join n on n.run_name = m.run_name and n.truth = l.label")
def completeness_matrix(spark, d):
    """Runs by classes, with the cells that have no result and the classes that no run has."""
    n = _evaluated(spark, d).groupBy("run_name", F.col("truth").alias("label")).agg(F.count("*").alias("n"))
    grid = table(spark, d, "class_predictions").select("run_name").distinct().crossJoin(F.broadcast(_labels(spark, d)))  # runs by a small label space
    j = grid.join(n, ["run_name", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("run_name", "label", "n", (F.col("n") == 0).alias("missing"), (F.sum("n").over(Window.partitionBy("label")) == 0).alias("missing_everywhere"))


@query(f"with {FIRST} select run_id, count(*) as cells, count(distinct model) as models, count(distinct spec_id) as specs, count(*) filter (where lower(status) <> 'ok') as failed, count(*) filter (where lower(status) = 'ok') = 0 as always_failing from l group by run_id")
def result_ledger(spark, d):
    """By run: cells, models, specifications, failures, and whether nothing ever went well."""
    ok = F.lower("status") == "ok"
    return first_requests(spark, d).groupBy("run_id").agg(F.count("*").alias("cells"), F.countDistinct("model").alias("models"), F.countDistinct("spec_id").alias("specs"), F.count_if(~ok).alias("failed"), (F.count_if(ok) == 0).alias("always_failing"))


@query("with o as (select request_id, status, received_at from cost_ledger where received_at < '2025-02-01'), p as (select request_id, status, received_at from cost_ledger where received_at >= '2025-01-15'), x as (select request_id, max(received_at) as t from p group by 1), y as (select request_id, max(received_at) as t from o where request_id not in (select request_id from x) group by 1) select 'produced' as side, count(*) as n from x union all select 'old', count(*) from y")
def upsert_latest(spark, d):
    """Results of a run over those on disk: what was produced now wins, the rest stays."""
    l = table(spark, d, "cost_ledger").select("request_id", "received_at")  # noqa: E741
    new = l.where("received_at >= timestamp_ntz '2025-01-15'").groupBy("request_id").agg(F.max("received_at").alias("t")).withColumn("side", F.lit("produced"))
    old = l.where("received_at < timestamp_ntz '2025-02-01'").groupBy("request_id").agg(F.max("received_at").alias("t")).withColumn("side", F.lit("old"))
    return new.unionByName(old.join(new, "request_id", "left_anti")).groupBy("side").agg(F.count("*").alias("n"))


@query(f"with {FX}, f as (select id, rec_no, regexp_extract(lower(model), '([a-z]+)', 1) as family from fx where model is not null), big as (select family from f group by 1 having count(*) >= 10), r as (select *, row_number() over (partition by family order by rec_no) as r from f where family in (select family from big)) select family, id from r where r <= 3")
def family_heads(spark, d):
    """The first three rows of each family of models with ten rows at least."""
    f = facets(spark, d).where("model is not null").select("id", "rec_no", F.regexp_extract(F.lower("model"), r"([a-z]+)", 1).alias("family"))
    big = f.groupBy("family").agg(F.count("*").alias("n")).where("n >= 10").select("family")
    r = f.join(big, "family", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy("rec_no"))).where("r <= 3")
    return r.select("family", "id")


@query("select block_id, count(*) as n, min(word_count)::bigint as least, max(word_count)::bigint as most, sum(word_count)::bigint // count(word_count) as mean, count(distinct lcgft_form) as forms, count(distinct audience) as audiences from shelf_features where block_id is not null and word_count is not null group by block_id")
def artifact_index(spark, d):
    """Index of blocks: rows, shortest, longest and whole mean length, different forms and audiences."""
    s = table(spark, d, "shelf_features").where("block_id is not null and word_count is not null")
    return s.groupBy("block_id").agg(F.count("*").alias("n"), F.min("word_count").cast("long").alias("least"), F.max("word_count").cast("long").alias("most"), F.floor(F.sum("word_count") / F.count("word_count")).alias("mean"), F.countDistinct("lcgft_form").alias("forms"), F.countDistinct("audience").alias("audiences"))


# Draws: uniform numbers from md5, so that any engine draws the same

#: Buckets of length with their word ranges and weights.
BUCKETS = (("micro", 10, 25, 0.05), ("tiny", 25, 50, 0.08), ("brief", 50, 100, 0.12), ("short", 100, 250, 0.20), ("medium", 250, 500, 0.25), ("long", 500, 1000, 0.15), ("very_long", 1000, 2000, 0.10), ("extended", 2000, 4000, 0.05))
N_DRAWS = 4000


def uniform_sql(seed, i="i"):
    return f"(('0x' || substr(md5('{seed}|' || {i}), 1, 15))::bigint % 1000003 / 1000003.0)"


def uniform(seed, i="i"):
    return hash60(F.concat(F.lit(f"{seed}|"), F.col(i).cast("string"))) % 1000003 / F.lit(1000003.0)


def pick(u, weighted):
    """The value whose stretch of the cumulative weights holds u."""
    out, upto = None, 0.0
    for name, w in weighted[:-1]:
        upto = round(upto + w, 12)
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(weighted[-1][0])


def pick_sql(u, weighted):
    upto, parts = 0.0, []
    for name, w in weighted[:-1]:
        upto = round(upto + w, 12)
        parts.append(f"when {u} < {upto} then '{name}'")
    return f"case {' '.join(parts)} else '{weighted[-1][0]}' end"


LENGTHS = [(b[0], b[3]) for b in BUCKETS]
DRAWN = f"dr as (select i, {pick_sql(uniform_sql('length'), LENGTHS)} as length, case when {uniform_sql('audience')} < 0.3 then null else 'a' || floor({uniform_sql('which')} * 9)::int end as audience, {uniform_sql('class')} as uc, {uniform_sql('form')} as uf from (select unnest(range(0, {N_DRAWS})) as i)), cl as (select term, row_number() over (order by term) - 1 as i, count(*) over () as m from label_space where facet = 'lcc_code'), ct as (select broader as cat, row_number() over (order by broader) - 1 as i, count(*) over () as m from (select distinct broader from label_space where facet = 'lcgft_form')), fo as (select term, broader as cat, row_number() over (partition by broader order by term) - 1 as i, count(*) over (partition by broader) as m from label_space where facet = 'lcgft_form'), sp as (select dr.i, length, audience, cl.term as class, fo.term as form from dr join cl on cl.i = floor(uc * cl.m) join ct on ct.i = floor(uf * ct.m) join fo on fo.cat = ct.cat and fo.i = floor(uf * ct.m * 997 % 1 * fo.m))"


def draw_specs(spark, d, n=N_DRAWS):
    """Specifications: length by weight, audience with a share of none, class uniform, form by category first and then within it."""
    space = table(spark, d, "label_space")
    cl = space.where("facet = 'lcc_code'").agg(F.array_sort(F.collect_list("term")).alias("classes"))
    fo = space.where("facet = 'lcgft_form'").groupBy("broader").agg(F.array_sort(F.collect_list("term")).alias("forms")).agg(F.array_sort(F.collect_list(F.struct("broader", "forms"))).alias("cats"))
    base = spark.range(n).withColumnRenamed("id", "i").crossJoin(F.broadcast(cl)).crossJoin(F.broadcast(fo))  # a small label space, as arrays
    at = lambda u, xs: F.element_at(xs, (F.floor(u * F.size(xs)) + 1).cast("int"))
    uf = uniform("form")
    cat = at(uf, F.col("cats"))
    audience = F.when(uniform("audience") >= 0.3, F.concat(F.lit("a"), F.floor(uniform("which") * 9).cast("string")))
    return base.select("i", pick(uniform("length"), LENGTHS).alias("length"), audience.alias("audience"), at(uniform("class"), F.col("classes")).alias("class"), cat.alias("c"), (uf * F.size("cats") * 997 % 1).alias("u2")).select("i", "length", "audience", "class", at(F.col("u2"), F.col("c.forms")).alias("form"))


@query(f"with {DRAWN} select 'length' as dim, length as value, count(*) as n from dr group by 2 union all select 'audience', coalesce(audience, '(none)'), count(*) from dr group by 2 union all select 'class', class, count(*) from sp group by 2 union all select 'form', form, count(*) from sp group by 2")
def drawn_dimensions(spark, d):
    """What the samplers draw, by dimension and value."""
    s = draw_specs(spark, d)
    rows = F.array(*[F.struct(F.lit(c).alias("dim"), F.coalesce(c, F.lit("(none)")).alias("value")) for c in ("length", "audience", "class", "form")])
    return s.select(F.explode(rows).alias("x")).groupBy("x.dim", "x.value").agg(F.count("*").alias("n"))


@query(f"with {DRAWN}, b as (select i // 500 as block, sha256(concat_ws('|', class, form, length, coalesce(audience, ''))) as h from sp) select block, count(*) as specs, count(distinct h) as different, count(*) - count(distinct h) as repeated, bit_xor(('0x' || substr(h, 1, 15))::bigint)::bigint as checksum from b group by block")
def spec_blocks(spark, d):
    """Specifications in blocks of 500 with repeats and a checksum for each block."""
    s = draw_specs(spark, d).select(F.floor(F.col("i") / 500).alias("block"), F.sha2(F.concat_ws("|", "class", "form", "length", F.coalesce("audience", F.lit(""))), 256).alias("h"))
    return s.groupBy("block").agg(F.count("*").alias("specs"), F.countDistinct("h").alias("different"), (F.count("*") - F.countDistinct("h")).alias("repeated"), F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")).alias("checksum"))


BUCKET_SQL = "bk(bucket, lo, hi) as (values " + ", ".join(f"('{a}', {b}, {c})" for a, b, c, _ in BUCKETS) + ")"


@query(f"with {BUCKET_SQL}, t as (select coalesce(bucket, 'none') as bucket, word_count from shelf_features left join bk on word_count >= lo and word_count < hi) select bucket, count(*) as documents, coalesce(sum(word_count), 0)::bigint as words, {R6.format('coalesce(sum(word_count), 0) * 1.35 / 1e6 * 1.5')} as planned_cost from t group by 1")
def planned_costs(spark, d):
    """Documents by bucket of length, found in an array of ranges, and what writing them would cost by token estimate."""
    hit = F.filter(F.array(*[F.struct(F.lit(a).alias("b"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for a, lo, hi, _ in BUCKETS]), lambda x: (F.col("word_count") >= x["lo"]) & (F.col("word_count") < x["hi"]))
    b = F.coalesce(F.get(hit, F.lit(0))["b"], F.lit("none"))
    words = F.coalesce(F.sum("word_count"), F.lit(0))
    return table(spark, d, "shelf_features").groupBy(b.alias("bucket")).agg(F.count("*").alias("documents"), words.alias("words"), r6(words * 1.35 / 1e6 * 1.5).alias("planned_cost"))


@query(f"with {FX}, r as (select id, cls, {hash_sql('head', 'id')} as h from fx where cls is not null), k as (select *, row_number() over (partition by cls order by h, id) as r, count(*) over (partition by cls) as n from r) select cls, count(*) filter (where r <= floor(n * 0.6)) as train, count(*) filter (where r > floor(n * 0.6) and r <= floor(n * 0.8)) as dev, count(*) filter (where r > floor(n * 0.8)) as test, max(n) < 15 as too_small from k group by cls")
def split_feasibility(spark, d):
    """How each class would be split, and which are too small for three parts of five."""
    n = facets(spark, d).where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"))
    a, b = F.floor(F.col("n") * 0.6), F.floor(F.col("n") * 0.8)
    return n.select("cls", a.alias("train"), (b - a).alias("dev"), (F.col("n") - b).alias("test"), (F.col("n") < 15).alias("too_small"))
