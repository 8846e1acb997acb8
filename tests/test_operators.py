import math
import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import fields
from corpusmill.functions import text as T
from corpusmill.operators import gates, judgments, lexical, multilabel, neardup, pairs, resampling, tails, vectors
from corpusmill.plans.distributions import ranked_pool


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


# Gates


def test_refusal_reasons_name_what_fired(spark):
    got = column(spark, ["As an AI language model, I cannot help.", "fine text", "", None, "cut [truncated]", "and so on...  ", "one... two"], gates.refusal_reasons)
    assert got == [["cannot_help", "as_an_ai", "as_an_ai_language_model"], [], ["empty_text"], ["empty_text"], ["truncated_mark"], ["ellipsis"], []]


def test_self_label_excerpts(spark):
    got = column(spark, ["Title\nGenre: satire", "This essay explores " + "x" * 90, "He won.", None], gates.self_label_excerpts)
    assert [[x.strip() for x in g] for g in got] == [["Genre:"], ["This essay explores"], [], []]


def test_length_slack_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(100, 130), (10, 20), (0, 38), (None, None), (0, 42)], "lo int, hi int")
    assert [r.s for r in df.select(gates.length_slack(F.col("lo"), F.col("hi")).alias("s")).collect()] == [8.0, 5.0, 10.0, 5.0, 10.0]


def test_topic_coverage(spark):
    df = spark.createDataFrame([("Land was surveyed by wages", ["Land surveys", "Wage disputes"]), ("x", None), ("x", []), ("", ["of the"]), (None, ["Beekeeping", None])], "t string, ts array<string>")
    assert [r.c for r in df.select(gates.topic_coverage(F.col("t"), F.col("ts")).alias("c")).collect()] == [0.0, 1.0, 1.0, 1.0, 0.0]


def test_labels_go_longest_first(spark):
    df = spark.createDataFrame([("A radio interview, and Radio interviews (Essays), too", ["Radio interviews", "Essays", "Radio", "and", None])], "t string, ls array<string>")
    r = df.select(gates.labels_in(F.col("t"), F.col("ls")).alias("f"), gates.without_labels(F.col("t"), F.col("ls")).alias("w")).first()
    assert r.f == ["Radio interviews", "Essays", "Radio"] and r.w == "A interview, and, too"


# Pairs


def test_relation_ladder(spark):
    c = "sub string, cls string, form string, cat string, topics array<string>"
    cases = [
        (("qa", "q", "f", "c", ["t"]), ("qa", "q", "f", "c", ["t"]), 0), (("qa", "q", "f", "c", []), ("qa", "q", "f", "c", []), 1), (("qa", "q", "f", "c", ["t"]), ("qb", "q", "f", "c", ["t"]), 2),
        ((None, "q", "f", "c", []), (None, "h", "f", "c", []), 3), ((None, "q", "f", "c", []), (None, "h", "g", "c", []), 4), ((None, None, None, None, ["t", "u"]), (None, None, None, None, ["u"]), 5), ((None, None, None, None, []), (None, None, None, None, []), 6),
    ]
    rows = [(i, a, b) for i, (a, b, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, a struct<{c.replace(' ', ':').replace(',:', ',')}>, b struct<{c.replace(' ', ':').replace(',:', ',')}>")
    got = df.orderBy("i").select(pairs.relation(lambda f: F.col(f"a.{f}"), lambda f: F.col(f"b.{f}")).alias("r")).collect()
    assert [r.r for r in got] == [pairs.STRATA[k] for _, _, k in cases]


def test_mining_keeps_quotas_and_reports_what_lacks(spark):
    rng = random.Random(4)
    rows = [(f"d{i:03d}", f"s{i % 9}" if i % 2 else None, f"c{i % 4}", f"f{i % 5}", f"k{i % 3}", sorted(rng.sample(["a", "b", "c", "d", "e"], rng.randint(0, 3)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "id string, sub string, cls string, form string, cat string, topics array<string>")
    quotas = {**dict.fromkeys(pairs.STRATA, 15), pairs.STRATA[0]: 4}
    got = pairs.mine_pairs(docs, quotas).collect()
    by = {r[0]: r for r in rows}
    seen = set()
    for p in got:
        a, b = by[p.doc_a], by[p.doc_b]
        assert p.doc_a < p.doc_b and (p.doc_a, p.doc_b) not in seen and p.label == int(a[2] == b[2])
        seen.add((p.doc_a, p.doc_b))
        j = len(set(a[5]) & set(b[5])) / max(1, len(set(a[5]) | set(b[5])))
        k = (0 if a[3] == b[3] and j == 1 else 1) if a[1] and a[1] == b[1] else 2 if a[2] == b[2] else 3 if a[3] == b[3] else 4 if a[4] == b[4] else 5 if j else 6
        assert p.stratum == pairs.STRATA[k]
    assert sorted(p.pair_id for p in got) == [f"pair_{i:06d}" for i in range(len(got))]
    report = {r.stratum: r for r in pairs.mining_report(pairs.mine_pairs(docs, quotas), quotas).collect()}
    assert set(report) == set(pairs.STRATA) and all(r.produced + r.shortfall == r.requested for r in report.values()) and report[pairs.STRATA[2]].shortfall == 0
    assert pairs.mine_pairs(docs.limit(1), quotas).count() == 0
    with pytest.raises(ValueError):
        pairs.mine_pairs(docs, {pairs.STRATA[2]: -1})


def test_balanced_quotas():
    q = pairs.balanced_quotas(803)
    assert q[pairs.STRATA[2]] == sum(v for k, v in q.items() if k != pairs.STRATA[2]) == 400
    with pytest.raises(ValueError):
        pairs.balanced_quotas(10, ())


# Judgments and metrics


def test_ideal_dcg_of_tiers(spark):
    rng = random.Random(2)
    rows = [(rng.randint(-1, 5), rng.randint(0, 9), rng.randint(0, 20)) for _ in range(40)]
    got = spark.createDataFrame(rows, "a int, b int, c int").select(judgments.ideal_dcg([(3.0, F.col("a")), (2.0, F.col("b")), (1.0, F.col("c"))], 10).alias("x")).collect()
    for (a, b, c), r in zip(rows, got, strict=True):
        gains = ([3] * max(a, 0) + [2] * b + [1] * c)[:10]
        assert r.x == pytest.approx(sum(g / math.log2(i + 2) for i, g in enumerate(gains)))


def brute_multilabel(truth, score, labels, ids):
    lrap, depth, micro = [], [], []
    for i in ids:
        s = [score.get((i, x), 0.0) for x in labels]
        y = [x in truth[i] for x in labels]
        micro += list(zip(s, y, strict=True))
        if any(y):
            rank = [sum(v >= s[j] for v in s) for j in range(len(labels))]
            lrap.append(np.mean([sum(y[k] for k in range(len(labels)) if s[k] >= s[j]) / rank[j] for j in range(len(labels)) if y[j]]))
            depth.append(max(rank[j] for j in range(len(labels)) if y[j]))

    def ap(rows):
        p = sum(y for _, y in rows)
        total = 0.0
        for t in sorted({s for s, _ in rows}, reverse=True):
            at = [y for s, y in rows if s >= t]
            total += sum(y for s, y in rows if s == t) / p * (sum(at) / len(at))
        return total

    by_label = [[(score.get((i, x), 0.0), x in truth[i]) for i in ids] for x in labels]
    macro = [ap(rows) for rows in by_label if any(y for _, y in rows)]
    return np.mean(lrap), np.mean(depth), ap(micro), np.mean(macro)


def test_multilabel_ranking_equals_brute_force(spark):
    rng = random.Random(9)
    labels, ids = list("abcdef"), list(range(30))
    truth = {i: set(rng.sample(labels, rng.randint(0, 3))) for i in ids}
    truth[0] = {"a"}
    score = {(i, x): rng.choice([0.2, 0.5, 0.5, 0.9]) for i in ids for x in labels if rng.random() < 0.5}
    t = spark.createDataFrame([(i, x) for i in ids for x in truth[i]] + [(99, "a"), (1, "zz")], "id int, label string")
    known = {i for i in ids if truth[i] | ({"zz"} if i == 1 else set())} & {i for i, _ in score}
    s = spark.createDataFrame([(i, x, v) for (i, x), v in score.items()] + [(3, "yy", 1.0)], "id int, label string, score double")
    space = spark.createDataFrame([(x,) for x in labels], "label string")
    c = multilabel.cells(t, s, space, 0.5)
    r, m = multilabel.ranking(c, space).first(), multilabel.mean_average_precision(c, space).first()
    want = brute_multilabel(truth, score, labels, sorted(known))
    assert (r.lrap, r.coverage_error, m.map_micro, m.map_macro) == pytest.approx(want)
    b = multilabel.bundle(c, space).first()
    tp = sum(len(truth[i] & {x for x in labels if score.get((i, x), 0) >= 0.5}) for i in known)
    both = sum(len(truth[i]) + sum(score.get((i, x), 0) >= 0.5 for x in labels) for i in known)
    assert b.n == len(known) and b.f1_micro == pytest.approx(2 * tp / both) and b.hamming_loss == pytest.approx((both - 2 * tp) / (len(known) * 6))


# Resampling and tails


def test_tails_against_tables():
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and tails.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert tails.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-7) and tails.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-7) and tails.chi2_tail(0, 3) == 1
    assert tails.chi2_tail(2.0, 1) == pytest.approx(math.erfc(1.0)) and tails.z_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.range_quantile(0.95, 3) == pytest.approx(3.314, abs=2e-3) and tails.range_quantile(0.95, 10) == pytest.approx(4.474, abs=2e-3)
    assert tails.beta_share(2, 3, 0.4) == pytest.approx(0.5248)


def test_draws_behave_like_poisson_and_signs():
    u = resampling.uniforms(np.arange(5000, dtype=np.int64) * 7919 + 13, 50)
    w, s = resampling.poisson_weights(u), resampling.signs(u)
    assert 0 <= u.min() and u.max() < 1 and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.06 and abs(s.mean()) < 0.02


def test_replicate_sums_do_not_depend_on_partitions(spark):
    df = spark.range(400).select((F.col("id") * 7919).alias("h"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"))
    get = lambda n: {(r.g, r.b): (r.w, r.s_x) for r in resampling.replicate_sums(df.repartition(n), ["x"], ["g"], 20).collect()}
    one, many = get(1), get(7)
    assert one == many and len(one) == 60 and {g for g, _ in one} == {"a", "b", None}


# Texts


def brute_chunks(parts, target, least, most):
    pieces = [p.split()[i : i + most] for p in parts for i in range(0, len(p.split()), most)]
    out, held = [], []
    for w in pieces:
        if held and len(held) + len(w) > most:
            out.append(held)
            held = []
        held = held + w
        if len(held) >= target:
            out.append(held)
            held = []
    if held and out and len(held) < least and len(out[-1]) + len(held) <= most:
        out[-1] = out[-1] + held
    elif held:
        out.append(held)
    return [" ".join(x) for x in out]


def test_chunks_lose_no_word_and_keep_bounds():
    rng = random.Random(1)
    for _ in range(60):
        parts = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.choice([1, 5, 30, 200]))) for _ in range(rng.randint(0, 12))]
        got = T.chunk(parts, 40, 15, 90)
        assert " ".join(got).split() == " ".join(parts).split() and all(len(x.split()) <= 90 for x in got) and got == brute_chunks(parts, 40, 15, 90)
    assert T.evenly(10, 3) == [1, 5, 8] and T.evenly(2, 3) == [0, 1] and T.evenly(0, 3) == []


def test_segments_are_places_in_the_text(spark):
    texts = ["One two. Three four!  Five?", "a. a. a. abc. abc.", "", None, "  Lead. Tail without end"]
    rows = T.segments(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect()
    for r in rows:
        assert texts[r.i][r.begin : r.end] == r.sentence and len(r.sentence) >= 3
    assert [r.sentence for r in rows if r.i == 0] == ["One two.", "Three four!", "Five?"] and [r.begin for r in rows if r.i == 1] == [9, 14]


def test_masking_and_its_sham(spark):
    df = spark.createDataFrame([(1, "The field guide and Field guides of a GUIDE.", "Field guides"), (2, "x y", None), (3, None, "Essays")], "i int, t string, l string")
    r = {x.i: x for x in df.select("i", T.masked(F.col("t"), F.col("l")).alias("m"), T.sham(F.col("t"), F.col("i"), F.lit(2)).alias("s")).collect()}
    assert r[1].m.text == "The and of a ." and r[1].m.removed == 4 and len(r[1].s.split()) == 7 and r[2].m.text == "x y" and r[3].m.text == ""


def test_fences_and_paragraphs(spark):
    text = "intro\n*** START OF BOOK\nProduced by X\nBody one.\n\nBody two\nwraps.\n*** END OF BOOK\nlicence"
    inner = column(spark, [text, "no fence here"], T.fenced)
    assert "licence" not in inner[0] and "Produced" not in inner[0] and "Body one." in inner[0] and inner[1] == "no fence here"
    assert column(spark, ["para one is here\n \n\npara two\nwraps here\n\nx"], T.paragraphs) == [["para one is here", "para two\nwraps here"]]


# Fields


def test_codes(spark):
    assert column(spark, ["Y 4.EC 7:H 32", "A 13.2:T 73", "", None, "LC 1:"], fields.agency_code) == ["Y", "A", None, None, "LC"]
    assert column(spark, ["QA76", "kf 1", "1a", None, "ABCD1"], fields.class_letters) == ["QA", "KF", None, None, None]
    got = column(spark, ["KF1-KF9827", "Q1-20", "x", None], fields.code_range)
    assert [tuple(g) if g else None for g in got] == [("KF", 1, 9827, 9826), ("Q", 1, 20, 19), None, None]
    assert column(spark, ["larkspur-7b", "x-0.5b-mini", "b7", None, "m-70B:free"], fields.billions) == [7.0, 0.5, None, None, 70.0]
    assert column(spark, ["1897-03-02", "1901", "c. 1900", None], fields.year_of) == [1897, 1901, None, None]
    assert column(spark, ["1897-03-02", "1901"], lambda c: fields.century(fields.year_of(c))) == ["1801-1900", "1901-2000"]
    assert column(spark, ["## Title: The End", "Title The End", " # x", None], fields.title_bare) == ["The End", "Title The End", "x", ""]


def test_headings_and_markers(spark):
    assert column(spark, [["Law -- France", "law -- Spain", " Art ", None, ""], None], fields.main_headings, "array<string>") == [["Law", "Art"], []]
    assert column(spark, [["Civil law", "Stage"], ["x"], None], lambda c: fields.by_marker(c, {"stage": "players", "law": "jurists"}, "none"), "array<string>") == ["players", "none", "none"]


def test_normal_document_fills_what_is_missing(spark):
    r = fields.normal_document(spark.createDataFrame([("a", None, -1, [None, "t"])], "id string, title string, thinking_budget int, topics array<string>")).first()
    assert (r.title, r.thinking_budget, r.topics, r.target_word_range, r.token_multiplier, r.geographic) == ("", None, ["t"], [0, 0], 1.0, [])


def test_filter_by_and_pools(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "rank int, x string")
    assert fields.filter_by(df, {"x": ["a", "b"], "none": 1}).count() == 2
    with pytest.raises(ValueError):
        fields.filter_by(df, {"x": "zz"})
    assert [r.rank for r in ranked_pool(df, 2).collect()] == [1, 2]
    for n in (0, 4):
        with pytest.raises(ValueError):
            ranked_pool(df, n)
    with pytest.raises(ValueError):
        fields.refuse_to_pool(df.withColumnRenamed("x", "source_type"))


# Near-duplicates and vectors


def test_signatures_estimate_jaccard_and_crowded_bands_are_complete(spark):
    rng = random.Random(3)
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(300)] = "changed"
        texts.append(" ".join(w))
    texts += ["", None, "short", "short", "other words are here"]
    sig = neardup.signatures(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t")
    rows = {r.doc: r for r in sig.collect()}
    sets = {i: set(r.shingles) for i, r in rows.items()}
    for i, j in list(combinations(range(20), 2))[:60]:
        true = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert abs(np.mean(np.array(rows[i].signature) == np.array(rows[j].signature)) - true) < 0.2
    got = {(r.a, r.b) for r in neardup.exact_jaccard(sig.where("doc < 60"), 0.9).collect()}
    heads = {}
    for i in range(60):
        heads.setdefault(tuple(rows[i].signature), i)
    want = {(i, j) for i, j in combinations(sorted(heads.values()), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.9}
    assert got == want and want
    v = {r.doc: r for r in neardup.verdicts(sig).collect()}
    assert v[63].matched == 62 and v[63].similarity == 1 and not v[63].passed and v[64].passed and v[64].matched is None
    with pytest.raises(ValueError):
        neardup.band_keys(sig, 31)


def test_dense_top_keeps_ties_by_document(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (90, 4)).astype(float)
    v[v.any(1) == 0] = 1
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "doc long, v array<float>").repartition(5)
    got = {}
    for r in lexical.dense_top(df, df.where("doc % 9 = 0"), 4, block=16).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["doc"]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q, ranks in got.items():
        s = np.floor(u @ u[q] * 1e6 + 0.5) / 1e6
        want = sorted((i for i in range(90) if i != q), key=lambda i: (-s[i], i))[:4]
        assert [ranks[k] for k in (1, 2, 3, 4)] == want
    assert len(got) == 10


def test_svd_of_texts_separates_topics(spark):
    rng = random.Random(8)
    a, b = ["river", "bridge", "ferry", "harbour"], ["court", "judge", "appeal", "verdict"]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(30))) for i in range(60)] + [(60, ""), (61, None)]
    e = {r.doc: np.array(r.v) for r in vectors.embed_texts(spark.createDataFrame(rows, "i int, t string"), "i", "t", 16, 2).collect()}
    assert len(e) == 62 and np.allclose(np.linalg.norm(e[0]), 1) and not e[60].any()
    assert np.mean([e[0] @ e[i] for i in range(2, 60, 2)]) > 0.8 > 0.4 > abs(np.mean([e[0] @ e[i] for i in range(1, 60, 2)]))


def test_linked_clusters(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(5)] + [(10 + i, [0.01 * i, 1.0]) for i in range(5)] + [(99, [-1.0, -1.0])]
    got = {r.doc: r.cluster for r in vectors.linked_clusters(spark.createDataFrame(rows, "doc long, v array<float>"), 0.9, 3).collect()}
    assert {got[i] for i in range(5)} == {0} and {got[10 + i] for i in range(5)} == {10} and got[99] == 99


# Topics that sets share


def topic_rows(spark, n, most, seed=4):
    rng = random.Random(seed)
    names = [f"t{i:02d}" for i in range(14)]
    rows = [(f"d{i}", i, sorted(rng.sample(names, min(len(names), rng.randrange(most)))), rng.choice(["a", "b", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, rec_no long, topics array<string>, cls string")


@pytest.mark.parametrize("most", [5, 13])
def test_topic_counts_equal_comparing_all(spark, most):
    rows, docs = topic_rows(spark, 150, most)
    got = {(tuple(r.topics), r.cls): (r.shared, r.shared_same) for r in judgments.topic_counts(docs, docs.where("rec_no % 3 = 0")).collect()}
    want = {}
    for _, i, ts, c in rows:
        if i % 3 == 0 and ts:
            met = [k for _, _, us, k in rows if set(ts) & set(us)]
            want[tuple(ts), c] = (len(met), sum(k is not None and k == c for k in met))
    assert got == want


def test_sets_that_share_a_hot_topic_are_never_paired(spark):
    n = 20_000
    docs = spark.range(n).selectExpr("id as rec_no", "array_sort(array('hot', concat('own', id))) as topics", "'a' as cls")
    began = time.perf_counter()
    got = judgments.topic_counts(docs, docs).agg(F.count("*"), F.min("shared"), F.max("shared"), F.min("shared_same")).first()
    assert tuple(got) == (n, n, n, n) and time.perf_counter() - began < 60  # pairs of sets would be 4e8


def test_graded_ideal_from_topic_counts_alone(spark):
    docs = spark.createDataFrame([("a", ["x", "y"], "Q"), ("b", ["y"], "Q"), ("c", ["x", "y", "z"], "H"), ("d", ["z"], None)], "id string, topics array<string>, cls string")
    got = {(tuple(r.topics), r.cls): (r.shared, r.shared_same) for r in judgments.topic_counts(docs, docs).collect()}
    assert got == {(("x", "y"), "Q"): (3, 2), (("y",), "Q"): (3, 2), (("x", "y", "z"), "H"): (4, 1), (("z",), None): (2, 0)}
    assert sum(len(r.s) for r in docs.where("id = 'c'").select(judgments.subsets(F.col("topics")).alias("s")).collect()) == 7
