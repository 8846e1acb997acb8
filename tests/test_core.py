import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.expr import shingles, tokens
from corpusmill.operators import lexical, metrics
from corpusmill.operators.blocks import pairs_within
from corpusmill.operators.graph import connected_components
from corpusmill.plans import assembly
from corpusmill.plans.evaluation import _truth
from corpusmill.plans.statistics import adjust
from corpusmill.runtime import running_total


def test_running_total_by_group(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), rng.randint(0, 9)) for i in range(300)]
    got = {r.k: r.before for r in running_total(spark.createDataFrame(rows, "k int, g string, n int"), ["k"], "before", by="g", amount="n").collect()}
    seen = {"a": 0, "b": 0}
    for k, g, n in rows:
        assert got[k] == seen[g]
        seen[g] += n


def test_running_total_empty(spark):
    assert running_total(spark.createDataFrame([], "k int"), ["k"], "r").count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1120)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None:
            parent[max(find(u), find(v))] = min(find(u), find(v))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pairs_within_splits_large_groups(spark):
    rows = [("g", i) for i in range(150)] + [("h", 1), ("h", 2), ("single", 9)]
    got = {(r["g"], r["a"], r["b"]) for r in pairs_within(spark.createDataFrame(rows, "g string, x int"), ["g"], "x", block=16).collect()}
    assert got == {("g", i, j) for i in range(150) for j in range(i + 1, 150)} | {("h", 1, 2)}


def test_tokens_and_shingles(spark):
    df = spark.createDataFrame([("Été À la_mer, 12!",), (None,), ("",)], "t string").select(tokens(F.col("t")).alias("ts"))
    assert [r.ts for r in df.collect()] == [["ete", "a", "la_mer", "12"], [], []]
    got = df.select(shingles(F.col("ts"), 3).alias("s")).collect()
    assert [r.s for r in got] == [["ete a la_mer", "a la_mer 12"], [], []]


def test_bm25_by_hand(spark):
    post = lexical.postings(spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "d d d d"), (4, "e")], "i int, t string"), "i", "t")
    got = lexical.bm25(spark.createDataFrame([("q", "b"), ("q", "b"), ("q", "zz")], "query string, term string"), post).collect()
    assert [r.doc for r in got] == [1]
    assert got[0].score == pytest.approx(2 * math.log(3.5 / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2.5)))


def test_dcg_closed_form(spark):
    rank = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("r", 5, 1)], "query string, doc int, rank int")
    rel = spark.createDataFrame([("q", 1, 3.0), ("q", 2, 1.0), ("s", 9, 1.0)], "query string, doc int, gain double")
    got = {r["query"]: r for r in metrics.ranking_metrics(rank, rel, 2).collect()}
    assert set(got) == {"q", "s"} and got["q"].ndcg == pytest.approx(1.0) and got["s"].ndcg == 0 and got["s"].ap == 0


def test_auc_ties_and_one_class(spark):
    s = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "score double, y int")
    assert metrics.auc(s).first().auc == pytest.approx(0.875)
    assert metrics.auc(s.where("y = 1")).first().auc == 0.5


def test_perfect_clustering(spark):
    m = metrics.clustering_metrics(spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "truth int, pred int")).first()
    assert (m.homogeneity, m.completeness, m.ari) == (pytest.approx(1), pytest.approx(1), pytest.approx(1))


def test_absent_label_counts_as_zero(spark):
    conf = metrics.confusion(spark.createDataFrame([("A", "A"), ("A", "B")], "truth string, pred string"))
    got = {r.label: r.f1 for r in metrics.class_metrics(conf, spark.createDataFrame([("A",), ("B",), ("C",)], "label string")).collect()}
    assert got["A"] == pytest.approx(2 / 3) and got["B"] == 0 and got["C"] == 0


def test_holm_and_bh(spark):
    got = adjust(spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.9)], "name string, p double")).toPandas().set_index("name")
    assert got.loc["b", "holm"] == pytest.approx(0.04) and got.loc["a", "bh"] == pytest.approx(0.03) and isinstance(got, pd.DataFrame)


def test_truth_reads_all_spellings(spark, tmp_path):
    rows = [("a", "Q"), ("b", " q "), ("c", "C."), ("d", "LCC C"), ("e", "Q - Science"), ("f", "Auxiliary Sciences of History"), ("g", None), ("h", "nonsense"), ("i", "Science"), ("i", "C"), ("k", "x")]
    spark.createDataFrame(rows, "id string, lcc_code string").write.parquet(f"{tmp_path}/shelf_features.parquet")
    space = [("lcc_code", "Q", "Science"), ("lcc_code", "C", "Auxiliary Sciences of History")]
    spark.createDataFrame(space, "facet string, term string, broader string").write.parquet(f"{tmp_path}/label_space.parquet")
    got = {r.id: r.truth for r in _truth(spark, str(tmp_path)).collect()}
    assert got == {"a": "Q", "b": "Q", "c": "C", "d": "C", "e": "Q", "f": "C", "i": "C", "k": "X"}


def test_gate_refusal_self_label_whole_lists(spark, tmp_path):
    refusing = ["We are unable to complete that request now.", "It is against my content policy.", "I'm just an AI, sorry.", "I cannot help", "A tale [Content truncated]", "left <|endoftext|> over", "and then... \n", "", " \n\u00a0", None]
    naming = ["Title\n Genre : satire", "This essay quietly explores rivers.", "Intro\nIn law, it is so.", "Tipo (LCC): Law"]
    clean = ["A plain text.", "The genre: satire", "He won, in law, a case.", "One... two."]
    rows = list(enumerate(refusing + naming + clean))
    spark.createDataFrame(rows, "rec_no int, body string").write.parquet(f"{tmp_path}/shelf_features.parquet")
    got = {r.rec_no: (r.refusal, r.self_label) for r in assembly.gate_refusal_self_label(spark, str(tmp_path)).collect()}
    n, m = len(refusing), len(refusing) + len(naming)
    assert got == {i: (i < n, n <= i < m) for i, _ in rows}


def test_gate_language_whole_list_and_ascii_share(spark, tmp_path):
    rows = [(1, "You should do what we would do"), (2, "the " + "\u0436\u0437\u0438\u0439" * 9), (3, "Kurz danach kam ein Brief"), (4, "12 34"), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.share, r.passed) for r in assembly.gate_language(spark, str(tmp_path)).collect()}
    assert got == {1: (1.0, True), 2: (0.5, False), 3: (0.0, False), 4: (0.0, False), 5: (None, False), 6: (None, False)}


@pytest.mark.parametrize("held", [4_000_000, 300, 10])
def test_components_of_a_giant_and_a_path(spark, monkeypatch, held):
    """One component of nearly all nodes and a long path, whether forests merge to one or go on in rounds."""
    from corpusmill.operators import graph

    monkeypatch.setattr(graph, "TASK_TIES", held)
    rng = random.Random(3)
    perm = rng.sample(range(1000), 1000)
    edges = list(zip(perm, perm[1:], strict=False)) + [(rng.choice([5000, 5001]), rng.randint(5000, 9000)) for _ in range(4000)] + [(9500, 9500)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(11)).collect()}
    assert all(c == 0 for n, c in got.items() if n < 1000) and got[9500] == 9500
    assert len({c for n, c in got.items() if 5000 <= n < 9500}) <= 2


def test_pairs_within_heavy_groups_by_broadcast(spark, monkeypatch):
    from corpusmill.operators import blocks

    monkeypatch.setattr(blocks, "HEAVY", 10)
    rows = [("g", i) for i in range(40)] + [("h", 1), ("h", 2), (None, 1), (None, 2)]
    got = {(r["g"], r["a"], r["b"]) for r in pairs_within(spark.createDataFrame(rows, "g string, x int"), ["g"], "x", block=16).collect()}
    assert got == {("g", i, j) for i in range(40) for j in range(i + 1, 40)} | {("h", 1, 2)}


def test_unstage_and_scratch(spark):
    import os

    from corpusmill.runtime import scratch, stage, unstage

    path = lambda t: t._staged_at.removeprefix("file://")
    a = stage(spark.range(3))
    assert os.path.isdir(path(a)) and a.count() == 3
    unstage(a)
    assert not os.path.exists(path(a))
    with scratch(spark):
        b = stage(spark.range(4))
        assert b.count() == 4
    assert not os.path.exists(path(b))
