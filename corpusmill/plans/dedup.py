"""Near-duplicates, building a dataset end to end, and its promotion report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.expr import hash60, r6
from corpusmill.functions.fields import text_or
from corpusmill.operators import gates, neardup
from corpusmill.operators.neardup import BANDS, PERMUTATIONS, PRIME
from corpusmill.plans.gates import GENERATOR_SQL, QC_SQL, generator
from corpusmill.plans.pairing import FX, facets, hash_sql
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6
from corpusmill.plans.texts import ALPHA
from corpusmill.runtime import running_total, stage
from corpusmill.sources.tables import table

SIG = f"""tk as (select doc_id as doc, {ALPHA.replace('{}', 'text')} as ts from documents where trim(text) <> ''), sh as (select doc, list_distinct(case when len(ts) = 0 then [] when len(ts) < 5 then [array_to_string(ts, ' ')] else [array_to_string(ts[i:i+4], ' ') for i in range(1, len(ts) - 3)] end) as ss from tk),
hs as (select doc, list_sort(list_distinct(list_transform(ss, lambda s: ('0x' || substr(md5(s), 1, 15))::bigint % {PRIME}))) as h from sh),
sg as (select doc, h, list_transform(range(0, {PERMUTATIONS}), lambda i: coalesce(list_min(list_transform(h, lambda x: (x * ((1103515245 * (i + 1) + 12345) % {PRIME - 1} + 1) + (22695477 * (i + 1) + 1) % {PRIME}) % {PRIME})), {PRIME - 1})) as s from hs)"""
NEAR = f"""{SIG}, bd as (select doc, s, b, s[4*b+1:4*b+4] as k from sg cross join (select unnest(range(0, {BANDS})) as b)), ca as (select distinct x.doc as a, y.doc as b from bd x join bd y on x.b = y.b and x.k = y.k and x.doc < y.doc),
sm as (select a, b, len(list_filter(list_zip(x.s, y.s), lambda z: z[1] = z[2])) / {PERMUTATIONS}.0 as sim from ca join sg x on x.doc = a join sg y on y.doc = b)"""
HEADS = f"{NEAR}, hd as (select min(doc) as doc from sg group by s), hp as (select * from sm where a in (select doc from hd) and b in (select doc from hd))"


#: The same over the rows of shelf_features, which hold texts with small edits.
of_records = lambda sql: sql.replace("doc_id as doc", "rec_no as doc").replace("lower(coalesce(text, ''))", "lower(coalesce(body, ''))").replace("from documents where trim(text) <> ''", "from shelf_features where trim(body) <> ''")


def _signatures(spark, d) -> DataFrame:
    return stage(neardup.signatures(table(spark, d, "documents").where("trim(text) <> ''"), "doc_id", "text"), "signatures")


def _record_signatures(spark, d) -> DataFrame:
    return stage(neardup.signatures(table(spark, d, "shelf_features").where("trim(body) <> ''"), "rec_no", "body"), "signatures")


@query(f"with {SIG} select doc as doc_id, md5(array_to_string(s, ',')) as signature, len(h)::bigint as shingles from sg")
def near_dup_signatures(spark, d):
    """Signatures of all texts, compared by their md5."""
    s = neardup.signatures(table(spark, d, "documents").where("trim(text) <> ''"), "doc_id", "text")
    return s.select(F.col("doc").alias("doc_id"), F.md5(F.array_join("signature", ",")).alias("signature"), F.size("shingles").cast("long").alias("shingles"))


@query(f"with {NEAR}, mx as (select b as doc, max(sim) as sim from sm group by 1) select sg.doc as doc_id, (select min(a) from sm where sm.b = sg.doc and sm.sim = mx.sim) as matched, {R6.format('coalesce(mx.sim, 0)')} as similarity, coalesce(mx.sim, 0) < 0.9 as passed from sg left join mx using (doc)")
def near_dup_verdicts(spark, d):
    """Each document's most similar earlier one by signature."""
    v = neardup.verdicts(_signatures(spark, d))
    return v.select(F.col("doc").alias("doc_id"), "matched", r6(F.col("similarity")).alias("similarity"), "passed")


@query(of_records(f"with {HEADS} select a as rec_a, b as rec_b, {R6.format('sim')} as similarity from hp where sim >= 0.9"))
def lsh_similar_pairs(spark, d):
    """Pairs of different signatures above the threshold, each by its first document."""
    _, pairs = neardup.similar_heads(_record_signatures(spark, d))
    return pairs.where("similarity >= 0.9").select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"), r6(F.col("similarity")).alias("similarity"))


@query(of_records(f"""with {SIG}, hd as (select min(doc) as doc, any_value(h) as h from sg group by s), e as (select doc, unnest(h) as x from hd), n as (select doc, len(h) as n from hd), i as (select a.doc as a, b.doc as b, count(*) as m from e a join e b on a.x = b.x and a.doc < b.doc group by 1, 2)
select a as rec_a, b as rec_b, {R6.format('m / (p.n + q.n - m)')} as jaccard from i join n p on p.doc = a join n q on q.doc = b where m / (p.n + q.n - m) >= 0.8"""))
def jaccard_near_dups(spark, d):
    """Pairs of different signatures whose shingles agree to 0.8 exactly; the SQL compares all pairs, so it measures the bands' recall."""
    j = neardup.exact_jaccard(_record_signatures(spark, d), 0.8)
    return j.select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"), r6(F.col("jaccard")).alias("jaccard"))


@query(f"""with {NEAR}, p as (select * from sm where sim >= 0.9), k as (select x.source as sa, y.source as sb from p join documents x on x.doc_id = a join documents y on y.doc_id = b), f as (select a as doc from p union select b from p)
select (select count(*) from sg) as documents, (select count(*) from f) as flagged, {R6.format('(select count(*) from f) / (select count(*) from sg)')} as duplicate_rate, (select count(*) from k where sa = sb) as within_source, (select count(*) from k where sa <> sb) as across_sources""")
def near_dup_report(spark, d):
    """Documents with a near-duplicate, and pairs within and across sources. Pairs of copies are counted from the groups' sizes, never listed."""
    sig = _signatures(spark, d)
    heads, pairs = neardup.similar_heads(sig)
    source = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source")
    member = sig.select("doc", "signature").join(heads.withColumnRenamed("doc", "head"), "signature").join(source, "doc").select("doc", "head", "source")
    n = stage(member.groupBy("head", "source").agg(F.count("*").alias("n")), "members")
    size = n.groupBy("head").agg(F.sum("n").alias("m"))
    near = pairs.where("similarity >= 0.9").select("a", "b")
    two = lambda x: x * (x - 1) / 2
    inside = n.agg(F.sum(two(F.col("n"))).alias("same")).crossJoin(size.agg(F.sum(two(F.col("m"))).alias("all")))
    na = n.select(F.col("head").alias("a"), F.col("source").alias("sa"), F.col("n").alias("na"))
    nb = n.select(F.col("head").alias("b"), F.col("source").alias("sb"), F.col("n").alias("nb"))
    cross = near.join(na, "a").join(nb, "b").agg(F.coalesce(F.sum(F.when(F.col("sa") == F.col("sb"), F.col("na") * F.col("nb"))), F.lit(0)).alias("same2"), F.coalesce(F.sum(F.when(F.col("sa") != F.col("sb"), F.col("na") * F.col("nb"))), F.lit(0)).alias("other2"))
    flagged = size.where("m > 1").select("head").unionByName(near.select(F.explode(F.array("a", "b")).alias("head"))).distinct().join(size, "head").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("flagged"))
    j = sig.agg(F.count("*").alias("documents")).crossJoin(flagged).crossJoin(inside).crossJoin(cross)  # rows of one
    return j.select("documents", "flagged", r6(F.try_divide("flagged", "documents")).alias("duplicate_rate"), (F.col("same") + F.col("same2")).cast("long").alias("within_source"), (F.col("all") - F.col("same") + F.col("other2")).cast("long").alias("across_sources"))


# Hashes of contents


@query(f"select split, count(*) as n, bit_xor({hash_sql('content', 'id', 'body')})::bigint as content from (select distinct split, coalesce(id, '') as id, coalesce(body, '') as body from shelf_features) group by split")
def split_content_hashes(spark, d):
    """An order-free hash of each split's ids and texts, merged like a count."""
    s = table(spark, d, "shelf_features").select("split", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("body", F.lit("")).alias("body")).distinct()
    return s.groupBy("split").agg(F.count("*").alias("n"), F.bit_xor(hash60(F.concat_ws("|", F.lit("content"), "id", "body"))).alias("content"))


SPEC = ("audience", "block_id", "lcc_code", "lcgft_form", "register", "target_length")


@query("select substr(sha256(to_json(struct_pack(" + ", ".join(f"{c} := coalesce({c}, '')" for c in SPEC) + "))), 1, 16) as content_id, count(*) as n from shelf_features group by 1")
def spec_content_ids(spark, d):
    """An id of a specification by the sha256 of its fields as JSON, in the order of their names."""
    j = F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in SPEC]))
    return table(spark, d, "shelf_features").groupBy(F.substring(F.sha2(j, 256), 1, 16).alias("content_id")).agg(F.count("*").alias("n"))


# The dataset, end to end

BUILT = f"""{QC_SQL}, base as (select s.rec_no, s.id, s.spec_id, s.body, s.lcc_code, {GENERATOR_SQL.replace('model', 's.model')} as generator, f.failed from shelf_features s join f using (rec_no)), passed as (select * from base where failed = ''),
kept as (select * from (select *, row_number() over (partition by sha256(lower(regexp_replace(trim(body), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) order by rec_no) as r from passed) where r = 1),
gr as (select coalesce(spec_id, 'row ' || rec_no) as g, coalesce(min(upper(trim(lcc_code))), '') as stratum from kept group by 1), rg as (select *, row_number() over (partition by stratum order by {hash_sql('build', 'g')}, g) as r, count(*) over (partition by stratum) as n from gr),
sp as (select g, case when r <= floor(n * 0.2) then 'test' when r <= floor(n * 0.4) then 'dev' else 'train' end as split from rg), done as (select kept.*, sp.split from kept join sp on sp.g = coalesce(kept.spec_id, 'row ' || rec_no))"""


def build_dataset(spark, d) -> DataFrame:
    """(rec_no, id, spec_id, body, generator, failed, kept, split): gates, then exact duplicates among what passed, then a split of whole specs, stratified by class."""
    s = table(spark, d, "shelf_features").select("rec_no", "id", "spec_id", "lcc_code", "model", "title", "body", "topics", "target_word_range")
    q = gates.all_gates(s).select("rec_no", "id", "spec_id", "lcc_code", "body", generator().alias("generator"), F.array_join("qc_failed", ",").alias("failed"))
    q = stage(q, "gated")
    key = F.sha2(F.lower(F.regexp_replace(F.trim("body"), r"[ \t\n\x0B\f\r]+", " ")), 256)
    first = q.where("failed = ''").groupBy(key.alias("k")).agg(F.min("rec_no").alias("rec_no")).select("rec_no", F.lit(True).alias("kept"))
    group = F.coalesce("spec_id", F.concat(F.lit("row "), F.col("rec_no").cast("string"))).alias("g")
    kept = q.join(first, "rec_no", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    g = kept.where("kept").groupBy(group).agg(F.coalesce(F.min(F.upper(F.trim("lcc_code"))), F.lit("")).alias("stratum")).withColumn("h", hash60(F.concat_ws("|", F.lit("build"), "g")))
    n = g.groupBy("stratum").agg(F.count("*").alias("n"))
    r = running_total(g, ["h", "g"], "r", by="stratum").join(n, "stratum")
    split = F.when(F.col("r") + 1 <= F.floor(F.col("n") * 0.2), "test").when(F.col("r") + 1 <= F.floor(F.col("n") * 0.4), "dev").otherwise("train")
    return kept.withColumn("g", group).join(r.select("g", split.alias("_s")), "g", "left").select("rec_no", "id", "spec_id", "body", "generator", "failed", "kept", F.when(F.col("kept"), F.col("_s")).alias("split"))


@query(f"with {BUILT} select rec_no, split from done")
def dataset_build(spark, d):
    """What a build keeps, with its split."""
    return build_dataset(spark, d).where("kept").select("rec_no", "split")


@query(f"""with {BUILT}, b as (select base.*, done.split from base left join done using (rec_no)) select generator, count(*) as generated, count(split) as retained, count(*) filter (where failed <> '') as rejected, count(*) filter (where failed = '' and split is null) as duplicates, count(distinct spec_id) as specs, count(*) filter (where spec_id is null or spec_id = '') as without_spec, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'dev') as dev, count(*) filter (where split = 'test') as test from b group by 1""")
def promotion_report(spark, d):
    """By generator: rows generated, retained, rejected by gates or as copies, specs and splits."""
    b = build_dataset(spark, d)
    n = lambda c, name: F.count_if(c).alias(name)
    return b.groupBy("generator").agg(
        F.count("*").alias("generated"), n(F.col("kept"), "retained"), n(F.col("failed") != "", "rejected"), n((F.col("failed") == "") & ~F.col("kept"), "duplicates"), F.countDistinct("spec_id").alias("specs"),
        n(F.coalesce("spec_id", F.lit("")) == "", "without_spec"), *[n(F.coalesce(F.col("split") == s, F.lit(False)), s) for s in ("train", "dev", "test")],
    )


@query(f"with {BUILT} select count(*) as specs, count(*) filter (where n > 1) as straddling from (select spec_id, count(distinct split) as n from done where spec_id is not null group by 1)")
def build_straddles(spark, d):
    """Specs in more than one split of the build: none may be."""
    b = build_dataset(spark, d).where("kept and spec_id is not null").groupBy("spec_id").agg(F.countDistinct("split").alias("n"))
    return b.agg(F.count("*").alias("specs"), F.count_if(F.col("n") > 1).alias("straddling"))


COVERED = ("cls", "form", "cat", "aud", "reg")


@query(f"with {FX} select count(distinct spec_id) as specs, count(*) filter (where coalesce(spec_id, '') = '') as missing, " + ", ".join(f"count(distinct {c}) as n_{c}" for c in COVERED) + " from fx")
def spec_coverage(spark, d):
    f = facets(spark, d)
    return f.agg(F.countDistinct("spec_id").alias("specs"), F.count_if(F.coalesce("spec_id", F.lit("")) == "").alias("missing"), *[F.countDistinct(c).alias(f"n_{c}") for c in COVERED])


@query(f"""with p as (select 'records' as corpus, rec_no as n, coalesce(text, body, title) as t, model, split from shelf_features union all select 'documents', doc_id, text, null, null from documents), k as (select *, sha256(lower(regexp_replace(trim(t), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as k from p where trim(t) <> ''),
r as (select *, row_number() over (partition by k order by corpus desc, n) as r from k) select corpus, coalesce(split, 'train') as split, count(*) as n from r where r = 1 group by 1, 2""")
def pooled_build(spark, d):
    """Two corpora of different columns pooled by name, the first of equal texts kept, rows without a split to train: the keeper is a minimum, no group of copies is sorted."""
    s = table(spark, d, "shelf_features")
    a = s.select(F.lit("records").alias("corpus"), F.lit(0).alias("o"), F.col("rec_no").alias("n"), text_or(s, "text", "body", "title").alias("t"), "model", "split")
    b = table(spark, d, "documents").select(F.lit("documents").alias("corpus"), F.lit(1).alias("o"), F.col("doc_id").alias("n"), F.col("text").alias("t"))
    p = a.unionByName(b, allowMissingColumns=True).where("trim(t) <> ''")
    k = F.sha2(F.lower(F.regexp_replace(F.trim("t"), r"[ \t\n\x0B\f\r]+", " ")), 256)
    first = p.groupBy(k.alias("k")).agg(F.min_by(F.struct("corpus", F.coalesce("split", F.lit("train")).alias("split")), F.struct("o", "n")).alias("x"))
    return first.groupBy("x.corpus", "x.split").agg(F.count("*").alias("n"))


@query("select rec_no, md5(concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(array_to_string(topics, '; ')), ''), nullif(trim(body), ''))) as text from shelf_features")
def catalogue_texts(spark, d):
    """Records as texts: the fields that are not empty, a blank line between them."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (F.col("title"), F.array_join("topics", "; "), F.col("body"))]
    return table(spark, d, "shelf_features").select("rec_no", F.md5(F.concat_ws("\n\n", *parts)).alias("text"))
