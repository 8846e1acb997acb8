import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import cooccurrence, grouped_split, mixing, near_duplicates, packing, pii, split_overlap, target_sample, text_quality, tokens, truncation
from corpusmill.llm.shingles import WordIds, shingle_batch, token_batch
from corpusmill.llm.spellings import model_key


def corpus(n=160, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.45:
            w = list(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 30, 60, 120]))]
        out.append(w)
    return [" ".join(w) for w in out]


def similar(texts, k, t):
    sets = shingle_batch(*token_batch(texts, WordIds()), k)
    sets = [set(s.tolist()) for s in sets]
    return {(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9}


def test_cooccurrence_blocks_equal_brute_force(spark):
    rng = random.Random(3)
    recs = [(r, [f"Item_{rng.randint(0, 60)}." for _ in range(rng.choice([0, 2, 5, 40]))], None) for r in range(60)] + [(None, ["x"], ["y"])]
    df = spark.createDataFrame(recs, "id int, a array<string>, b array<string>")
    items = cooccurrence.record_items(df, "id", ["a", "b"])
    got = {(r.item_a, r.item_b): r.n_ab for r in cooccurrence.cooccurrence(items, 60, min_pairs=3, large=7).collect()}
    want = Counter()
    for _, xs, _ in recs[:-1]:
        want.update(combinations(sorted({x.lower().replace("_", " ").strip(".") for x in xs}), 2))
    assert got == {p: n for p, n in want.items() if n >= 3}


def test_cooccurrence_empty(spark):
    df = spark.createDataFrame([], "id int, a array<string>")
    assert cooccurrence.cooccurrence(cooccurrence.record_items(df, "id", ["a"]), 0).count() == 0


@pytest.mark.parametrize("group", [256, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(near_duplicates, "GROUP", group)
    texts = [*corpus(), "", "?!", corpus()[0], corpus()[0].upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts), None)]
    got = near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "rec_no long, body string"), similarity=0.6, words=3).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, j in similar(texts, 3, 0.6):
        parent[find(i)] = find(j)
    want = {}
    for x in list(parent):
        want.setdefault(find(x), set()).add(x)
    have = {}
    for r in got:
        have.setdefault(r.group, set()).add(r.rec_no)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_empty(spark):
    assert near_duplicates.near_duplicate_groups(spark.createDataFrame([], "rec_no long, body string")).count() == 0


def test_ring_filter_keeps_every_pair_within_budget(spark):
    rng = np.random.default_rng(1)
    d = rng.integers(0, 12, (500, 8))
    df = spark.createDataFrame([(*map(int, r), int(r.sum() + rng.integers(-6, 7))) for r in d], ", ".join([*(f"d{i} int" for i in range(8)), "budget int"]))
    bad = df.where(~near_duplicates.ring_filter(F.col("budget"), [F.col(f"d{i}") for i in range(8)])).where("d0+d1+d2+d3+d4+d5+d6+d7 <= budget")
    assert bad.count() == 0


@pytest.mark.parametrize("shard", [4_000_000, 900])
def test_split_overlap_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(split_overlap, "SHARD_WORDS", shard)
    texts = corpus(seed=9)
    splits = [random.Random(i).choice(["train", "train", "dev", "test", "other"]) for i in range(len(texts))]
    rows = [(i, s, t) for i, (s, t) in enumerate(zip(splits, texts, strict=True))] + [(900, "train", None), (901, "dev", ""), (902, None, "w1 w2 w3")]
    got = {(r.train_row, r.eval_row) for r in split_overlap.split_overlap(spark.createDataFrame(rows, "rec_no long, split string, text string"), similarity=0.6, words=3).collect()}
    want = {(i, j) if splits[i] == "train" else (j, i) for i, j in similar(texts, 3, 0.6) if sorted([splits[i] == "train", splits[j] == "train"]) == [False, True] and "other" not in (splits[i], splits[j])}
    assert got == want and want


def test_split_overlap_pairs_all_raw_variants_of_short_texts(spark):
    rows = [(1, "train", "green door"), (2, "train", "Green  door!"), (3, "dev", "green door"), (4, "test", "GREEN door"), (5, "dev", "gréen\tdoor."), (6, "test", "door green"), (7, "test", "green  door")]
    got = {(r.train_row, r.eval_row, r.shared, r.total, r.longest) for r in split_overlap.split_overlap(spark.createDataFrame(rows, "rec_no long, split string, text string")).collect()}
    assert got == {(t, e, 1, 1, 2) for t in (1, 2) for e in (3, 4, 5, 7)}


def test_split_overlap_indexes_and_probes_only_what_met(spark, monkeypatch):
    """Texts of one side only, and evaluation texts that no training text meets, cost no search."""
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    shared, twins = text(), text()
    rows = [(i, "train" if i % 2 else "dev", text()) for i in range(120)] + [(200, "train", shared), (201, "test", shared + " end"), (202, "train", twins), (203, "train", twins + " end")]
    seen, kept = {}, split_overlap.stage
    monkeypatch.setattr(split_overlap, "stage", lambda df, name: (out := kept(df, name), seen.update({name: out.count()}))[0])
    monkeypatch.setattr(split_overlap, "SHARD_WORDS", 60)
    got = split_overlap.split_overlap(spark.createDataFrame(rows, "rec_no long, split string, text string"), similarity=0.6, words=3).collect()
    assert [(r.train_row, r.eval_row, r.shared, r.total) for r in got] == [(200, 201, 38, 39)]
    assert (seen["overlap-candidates"], seen["overlap-texts"]) == (1, 1)


def test_split_overlap_empty(spark):
    assert split_overlap.split_overlap(spark.createDataFrame([], "rec_no long, split string, text string")).count() == 0


def test_word_index_counts_runs():
    toks = np.array([5, 6, 5, 6, 7, 5, 6], np.uint64)
    parts = split_overlap.WordIndex.build(toks, np.array([0, 4, 7]), np.array([1, 2]), np.array([2, 1]), np.zeros((2, 16), np.uint64))
    ix = split_overlap.WordIndex(parts.__getitem__)
    lo, hi = ix.search(np.array([ix.symbols(np.array(r, np.uint64)) for r in ([5, 6], [6, 5], [6, 7], [7, 5], [5, 9])]))
    assert (hi - lo).tolist() == [3, 1, 0, 1, 0]
    assert ix.words_of(1).tolist() == [7, 5, 6]


def test_model_key(spark):
    rows = ["Larkspur-7B", "models/Larkspur 7b", "orchardworks/larkspur-7b:free", "larkspur_7b ", "larkspur-70b", "hub:windrow-3b-ft-000017", "windrow-3b-FT-000017@community", "windrow-3b-ft-000018", "", "  ", None, "x-1-2b", "x-12b"]
    k = [r.k for r in spark.createDataFrame([(m,) for m in rows], "m string").select(model_key(F.col("m")).alias("k")).collect()]
    assert len(set(k[:4])) == 1 and k[4] != k[0] and k[5] == k[6] != k[7] and k[8:11] == [None] * 3 and k[11] != k[12]


def test_grouped_split_parts_nothing(spark):
    rows = [(i, f"m-{i % 40}", f"id{i // 2}" if i % 5 else None) for i in range(400)] + [(400, None, None), (400, None, None)]
    df = spark.createDataFrame(rows, "rec_no long, model string, id string")
    groups = grouped_split.related_groups(df, "rec_no", {"id": F.col("id")})
    got = {r.row: (r.group, r.split) for r in grouped_split.grouped_split(groups, {"train": 0.5, "validation": 0.3, "test": 0.2}).collect()}
    assert len(got) == 401
    assert max(Counter(g for g, _ in set(got.values())).values()) == 1
    n = Counter(s for _, s in got.values())
    assert abs(n["train"] - 200.5) <= 2 and abs(n["test"] - 80.2) <= 2


def test_fill_levels_is_the_greedy_choice():
    rng = random.Random(4)
    for _ in range(50):
        d, size, count = [rng.randint(-20, 200) for _ in range(3)], rng.randint(1, 9), rng.randint(0, 60)
        left, want = list(d), [0, 0, 0]
        for _ in range(count):
            k = max(range(3), key=lambda j: (left[j], -j))
            left[k] -= size
            want[k] += 1
        got = grouped_split.fill_levels(list(map(float, d)), size, count)
        assert sum(got) == count
        assert sorted(x - g * size for x, g in zip(d, got, strict=True)) == sorted(x - w * size for x, w in zip(d, want, strict=True))


def test_tied_models_chain(spark):
    df = spark.createDataFrame([(1, "A-1", "x"), (2, "b-2", "x"), (3, "a_1", "y"), (4, "c", "z"), (5, "", "z"), (6, None, "y")], "rec_no long, model string, id string")
    assert {(r.model_a, r.model_b) for r in grouped_split.tied_models(df).collect()} == {("A-1", "a_1"), ("A-1", "b-2"), ("a_1", "b-2")}


def test_pack_every_item_once_within_capacity(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 1, 5, 30, 60, 99, 100, 101, 250])) for i in range(500)] + [(500, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id int, n_tokens long"), 100, ["doc_id"]).toPandas()
    assert got.groupby("container")["n_tokens"].sum().max() <= 100
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == {i: n or 0 for i, n in rows}
    pieces = got.groupby("doc_id").size()
    assert all(pieces[i] == max(1, -(-(n or 0) // 100)) for i, n in rows)
    assert packing.pack(spark.createDataFrame([], "doc_id int, n_tokens long"), 100, ["doc_id"]).count() == 0


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.tokenizer_dir()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["It's 2 o'clock,  no?\n\n Été — ½", "", None, "<|endoftext|> a  b", "ſ𝒳 word " * 50]
    got = tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1), keep=["i"]).orderBy("i").collect()
    assert [r.n_tokens for r in got] == [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]


def test_mix_shares_and_caps(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3] if i % 3 else "a", 10 + i % 7) for i in range(900)] + [(900, None, 5), (901, "zz", 5), (902, "a", 0)], "doc_id int, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 2), ("c", 0.3, 4), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(docs, targets, total=9000.0, ramps={"a": 0.5, "b": -0.5})
    u = uses.toPandas()
    most = u.groupby(["source", "doc_id"]).size().groupby("source").max().to_dict()
    assert set(most) == {"a", "b", "c"} and most["a"] <= 1 and most["b"] <= 2 and most["c"] <= 4
    r = {x.source: x for x in report.collect()}
    assert r["none"].stock == 0 and r["none"].shortfall == pytest.approx(1800)
    assert r["b"].tokens_used / r["c"].tokens_used == pytest.approx(1, abs=0.02)
    assert u["position"].between(0, 1).all()
    assert u[u.source == "a"]["position"].mean() > u[u.source == "b"]["position"].mean()


def test_schedule_position_inverts_the_integral(spark):
    df = spark.createDataFrame([(t / 20, r) for t in range(21) for r in (-1.0, -0.4, 0.0, 0.7, 1.0)], "t double, r double")
    x = F.col("t") + F.col("r") * (F.col("t") * F.col("t") - F.col("t"))
    assert df.select(F.max(F.abs(mixing.schedule_position(x, F.col("r")) - F.col("t"))).alias("e")).first().e < 1e-6


def test_quality_rules(spark):
    prose = "It was late when the letter came, and nobody in the house had expected that it would be so long. "
    rows = [(1, prose * 1, 20), (2, "\n".join(f"* dry bridge {i}" for i in range(12)), None), (3, "qzx9 0x1f 33 77 88\n" * 5, 0), (4, "", 3), (5, None, None), (6, "The river was low\nAnd the mill was still\nUntil the night is over", 14), (7, prose * 1 + "\n\n- dry garden\n- small mill\n\n" + prose[:60], 30), (8, (prose + "\n") * 9, 9), (9, "<li><a href='/x'>of the</a></li>" * 5, 2)]
    got = {r.rec_no: r.is_natural for r in text_quality.text_quality(spark.createDataFrame(rows, "rec_no int, body string, word_count int")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False, 9: False}


def test_truncation_endings(spark):
    rng = random.Random(8)
    noun = ["river", "bridge", "garden", "letter", "market", "harbour"]
    s = lambda: f"The {rng.choice(noun)} of the {rng.choice(noun)} was repaired by the {rng.choice(noun)}."
    full = [" ".join(s() for _ in range(rng.randint(3, 9))) for _ in range(300)]
    rows = [(i, t, "m-1", len(t.split())) for i, t in enumerate(full)]
    cases = {1000: s() + " The bri", 1001: s() + " The river of the", 1002: s() + " [truncated]", 1003: full[0][:-1], 1004: "", 1005: None, 1006: s()[:-1] + "…", 1007: s() + " The garden of the bridge was repa�"}
    rows += [(k, t, "m-1", None) for k, t in cases.items()]
    got, limits = truncation.truncation(spark.createDataFrame(rows, "rec_no long, body string, model string, word_count int"))
    assert {r.rec_no for r in got.where("is_cut").collect()} == {1000, 1001, 1002, 1007}
    assert limits.count() == 0
    assert truncation.truncation(spark.createDataFrame([], "rec_no long, body string, model string, word_count int"))[0].count() == 0


def test_lengths_under_encodings():
    n = dict(zip(truncation.MEASURES, truncation.lengths('é&"\n'), strict=True))
    assert (n["chars"], n["bytes"], n["html_chars"], n["json_chars"], n["json_ascii"], n["crlf_chars"]) == (4, 5, 13, 6, 11, 5)


def test_target_sample(spark):
    rows = [(i, f"id{i}", "Q" if i % 3 else "LCC H", "Essays", " Formal", "alpha-1") for i in range(300)]
    df = spark.createDataFrame(rows, "rec_no int, id string, lcc_code string, lcgft_form string, register string, model string")
    space = spark.createDataFrame([("lcc_code", "Q", "Science"), ("lcc_code", "H", "Social"), ("lcc_code", "A", "General"), ("lcgft_form", "Essays", "x"), ("register", "formal", "y"), ("model", "alpha-1", "h")], "facet string, term string, broader string")
    targets = spark.createDataFrame([("lcc_code", "Q", 0.5, 1, 0.2), ("lcc_code", "H", 0.4, 1, 0.2), ("lcc_code", "A", 0.1, 2, 0.2), ("lcgft_form", "Essays", 1.0, 1, 0.2), ("register", "formal", 1.0, 1, 0.2), ("model", "alpha-1", 1.0, 1, 0.2)], "facet string, category string, target_share double, min_records int, sample_fraction double")
    sample, report = target_sample.target_sample(df, space, targets)
    r = {(x.facet, x.category): x for x in report.collect()}
    assert not r["lcc_code", "A"].can_be_met and r["lcc_code", "A"].available == 0
    assert abs(r["lcc_code", "H"].share_reached - 0.44) < 0.15 and sample.count() >= 60
    assert target_sample.target_sample(df.limit(0), space, targets)[0].count() == 0


def test_smallest_is_exact(spark):
    df = spark.range(5000).select("id", (F.pmod(F.xxhash64("id"), F.lit(997)) / 7.0 + 0.001).alias("x"))
    want = sorted((r.x, r.id) for r in df.collect())
    for k in (0, 1, 777, 5000, 9000):
        got = sorted((r.x, r.id) for r in target_sample.smallest(df, F.col("x"), k).collect())
        assert [x for x, _ in got] == [x for x, _ in want[:k]]


def test_pii_on_generated_letters(spark):
    rng = random.Random(7)
    first, tail = ["Oriane", "Tobrin", "Ulrika", "Dashel"], ["lotte", "skov", "stein"]
    docs, want = [], set()
    for i in range(400):
        f, s = rng.choice(first), rng.choice(["Bran", "Kel", "Mor"]) + rng.choice(tail)
        mail, tel = f"{f.lower()}.{s.lower()}@mail.example.org", f"+1 415 555 01{rng.randint(10, 99)}"
        docs.append((i, f"The parcel is here.\nContact: {f} {s}, {mail}, {tel}\nControl number 376246{rng.randint(10, 99)} was reused. {f} {s} wrote on 04/11/1913."))
        want |= {(i, "name", f"{f} {s}"), (i, "email", mail), (i, "phone", tel)}
    docs += [(500, ""), (501, None), (502, "x" * 30000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = pii.fit_pii(df, "doc_id")
    got = {(r.doc_id, r.kind, r.pii) for r in pii.find_pii(df, model).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    red = {r.doc_id: r.redacted for r in pii.redact(df, model).collect()}
    assert red[501] is None and red[500] == "" and "[EMAIL]" in red[0] and "[NAME]" in red[0]


def test_pii_lexicons_count_all_documents(spark):
    """A first name and a surname ending that the sample of 10 documents hardly shows are known, and their names found."""
    docs = [(i, f"The parcel is here.\nContact: Ulrika Branlotte, u.b{i}@mail.example.org, +1 415 555 01{i % 90 + 10}\nUlrika Branlotte wrote.") for i in range(600)]
    docs += [(600 + i, f"The parcel is here.\nContact: Zephrin Qualdimox, z.q{i}@mail.example.org, +1 415 555 01{i + 10}\nZephrin Qualdimox wrote.") for i in range(6)]
    docs += [(700 + i, f"A letter from Osmirra Branlotte, number {i}.") for i in range(6)] + [(800 + i, "A visit, Von Branlotte came.") for i in range(6)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    model = pii.fit_pii(df, "doc_id", sample_docs=10)
    assert model["first"] == {"ulrika", "zephrin", "osmirra"} and model["ends"] == {"tte", "mox"} and "parcel" in model["ordinary"]
    assert model["first"] == pii.fit_pii(df, "doc_id", sample_docs=1000)["first"]
    got = {(r.doc_id, r.pii) for r in pii.find_pii(df, model).where("kind = 'name'").collect()}
    assert {(600 + i, "Zephrin Qualdimox") for i in range(6)} | {(700 + i, "Osmirra Branlotte") for i in range(6)} <= got


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(3)
    u, w = rng.normal(size=(3, 6)), rng.normal(size=(2, 6, 6))
    edges = np.array([[0, 1, 0], [1, 2, 1]])
    b = pii.propagate(u, edges, w, sweeps=60)
    joint = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2][None, None, :] + w[0][:, :, None] + w[1][None, :, :])
    p = np.exp(b - b.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for k, axes in enumerate(((1, 2), (0, 2), (0, 1))):
        assert np.allclose(p[k], joint.sum(axes) / joint.sum(), atol=1e-3)


@pytest.mark.parametrize(("similarity", "words"), [(0.3, 2), (0.8, 5)])
def test_near_duplicates_with_crowded_shingles(spark, monkeypatch, similarity, words):
    """Boilerplate in nine tenths of the texts, with hot shingles told before they are gathered, at low and high similarity."""
    monkeypatch.setattr(near_duplicates, "GROUP", 2)
    monkeypatch.setattr(near_duplicates, "HOT", 3)
    monkeypatch.setattr(near_duplicates, "CROWD", 0)
    rng = random.Random(12)
    texts = corpus(70, 3)
    boiler = "all rights of this text are kept by the house that printed it in spring"
    texts = [t if i % 10 == 0 else f"{boiler} {t}" if i % 3 else f"{boiler} w{rng.randint(1, 9)}" for i, t in enumerate(texts)] + ["a b", "a b c", "a b d", "a b c d", "b a"]
    rows = list(enumerate(texts))
    got = near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "rec_no long, body string"), similarity=similarity, words=words).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, j in similar(texts, words, similarity):
        parent[find(i)] = find(j)
    want, have = {}, {}
    for x in list(parent):
        want.setdefault(find(x), set()).add(x)
    for r in got:
        have.setdefault(r.group, set()).add(r.rec_no)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values())) and want


def test_sets_of_equal_numbers_are_kept_apart(spark):
    sets = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 5)], "row long, set long, high long")
    got = {r.row: r.set for r in near_duplicates.apart(sets).collect()}
    assert got[1] == got[3] == 7 and got[2] not in (7, 8) and got[4] == 8


def test_target_sample_gaps_are_near_the_raked_optimum(spark):
    """Ids that lack a category of a facet are drawn too, and every facet's gaps stay within 0.02 of what raking alone leaves."""
    rng = random.Random(21)
    pick = lambda xs, none: None if rng.random() < none else rng.choices(xs, range(1, len(xs) + 1))[0]
    lcc, forms, regs, models = list("ABCDEFGHKLMN"), [f"form{c}" for c in "abcdefgh"], ["formal", "plain", "verse"], [f"mod{c}" for c in "abcde"]
    rows = [(f"id{i}", pick(lcc, 0.12), pick(forms, 0.1), pick(regs, 0.05), pick(models, 0.1)) for i in range(12000)] + [(None, "A", "forma", "formal", "moda")]
    df = spark.createDataFrame(rows, "id string, lcc_code string, lcgft_form string, register string, model string")
    terms = {"lcc_code": lcc, "lcgft_form": forms, "register": regs, "model": models}
    space = spark.createDataFrame([(f, t, f"the {t} kind") for f, ts in terms.items() for t in ts], "facet string, term string, broader string")
    goal = [(f, t, 1 / len(ts), 20, 0.2) for f, ts in terms.items() for t in ts]
    targets = spark.createDataFrame(goal, "facet string, category string, target_share double, min_records int, sample_fraction double")
    sample, report = target_sample.target_sample(df, space, targets)
    s, r = sample.toPandas(), report.toPandas()
    assert s["id"].is_unique and s[target_sample.FACETS].isna().any(axis=1).mean() > 0.1
    cells = df.where("id is not null").groupBy(*target_sample.FACETS).count().withColumnRenamed("count", "left").toPandas()
    want = {f: {t: 0.2 * 12000 / len(ts) for t in ts} for f, ts in terms.items()}
    mass = target_sample.rake(cells, want, 200, 1e-4)
    for f in terms:
        met = r[(r["facet"] == f) & r["can_be_met"]]
        best = sum(abs(mass[(cells[f] == c).to_numpy()].sum() - want[f][c]) for c in met["category"])
        assert met["gap"].abs().sum() <= best + 0.02 * 2400
    again = target_sample.target_sample(df.repartition(7), space, targets)[0].toPandas()
    assert set(again["id"]) == set(s["id"])


def test_cooccurrence_of_a_huge_basket(spark):
    """Baskets of 3,000 items in blocks of production size: every pair once, those of two baskets twice."""
    items = spark.range(3000).selectExpr("1 as record", "concat('i', id) as item").union(spark.range(2000, 5000).selectExpr("2 as record", "concat('i', id) as item"))
    got = cooccurrence.cooccurrence(items, 2).groupBy("n_ab").agg(F.count("*").alias("n"), F.count_if(F.col("item_a") >= F.col("item_b")).alias("bad"))
    assert {r.n_ab: (r.n, r.bad) for r in got.collect()} == {1: (2 * 3000 * 2999 // 2 - 2 * 1000 * 999 // 2, 0), 2: (1000 * 999 // 2, 0)}


def test_mix_positions_hold_equal_tokens(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "abc"[i % 3], rng.randint(1, 40)) for i in range(9000)], "doc_id int, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.6, 4), ("b", 0.3, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    u = mixing.mix(docs, targets, ramps={"a": 0.8, "b": -0.6})[0].toPandas()
    tenth = u.groupby((u["position"] * 10).clip(upper=9.999).astype(int))["n_tokens"].sum()
    assert len(tenth) == 10 and tenth.max() / tenth.min() < 1.05
    late, early = u[u["position"] > 0.9], u[u["position"] < 0.1]
    share = lambda x, s: x[x.source == s]["n_tokens"].sum() / x["n_tokens"].sum()
    assert share(late, "a") > share(early, "a") + 0.2
    u = mixing.mix(docs, targets, ramps=mixing.fade_in_repeated)[0].toPandas()
    assert u[u.source == "a"]["position"].mean() > u[u.source == "b"]["position"].mean()


def test_pack_fills_containers(spark):
    """At most one hundredth of the capacity is left unused, whatever the block of ranks."""
    rng = random.Random(4)
    rows = [(i, min(900, int(rng.lognormvariate(4, 1)))) for i in range(6000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id int, n_tokens long"), 1000, ["doc_id"]).toPandas()
    assert len(got) == 6000 and got.groupby("container")["n_tokens"].sum().max() <= 1000
    assert got["n_tokens"].sum() / (1000 * got["container"].nunique()) > 0.99


def test_split_shares(spark):
    a = spark.createDataFrame([(1, 5, "train"), (2, 5, "train"), (3, 6, "test")], "row int, group long, split string")
    got = {r.split: (r.n_rows, r.n_groups, round(r.share_reached, 3)) for r in grouped_split.split_shares(a, {"train": 0.7, "test": 0.2, "dev": 0.1}).collect()}
    assert got == {"train": (2, 1, 0.667), "test": (1, 1, 0.333), "dev": (0, 0, 0.0)}


def test_beginnings_of_any_length_are_counted():
    """A word of 5,000 letters and a sentence of 300 parts count for each of their beginnings."""
    longer, further = Counter(), Counter()
    w = "ab" * 2500
    truncation._starts(w, longer, 3, "", "p")
    assert len(longer) == len(w) - 1 and longer[truncation._h("p", w[:4321])] == 3
    s = " ".join(f"x{i}" for i in range(300))
    truncation._starts(s.split(" "), further, 1, " ", "q")
    assert further[truncation._h("q", " ".join(s.split(" ")[:250]))] == 1 and len(further) == 299


def test_quality_statistics_by_hand_and_in_slices(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(text_quality, "SLICE_BYTES", 40)
    text = "# The end...\n- one two\n\n- one two\nAnd 42 of THE was it."
    rows = [(i, x, w) for i, (x, w) in enumerate([(text, 14), (None, None), ("", 0), (" \t", 2), ("Yes. Yes. Yes. No.", 4), ("x" * 5000, 1)])]
    got = {r.rec_no: r for r in text_quality.text_quality(spark.createDataFrame(rows, "rec_no int, body string, word_count int")).collect()}
    r = got[0]
    assert (r.n_words, r.n_lines, r.n_stop_words, r.n_duplicates) == (15, 4, 3, 1) and r.bullet_lines == 0.5 and r.bullet_words == pytest.approx(6 / 15)
    assert r.marks_per_word == pytest.approx(2 / 15) and "word_count" in r.published and "symbols" in r.published and r.word_count_error == pytest.approx(-1 / 14)
    assert got[4].n_duplicates == 2 and got[1].n_words == got[2].n_words == 0 and got[1].mean_word_len is None and not got[1].published
    assert got[5].mean_word_len == 5000 and "word_length" in got[5].reasons
    assert text_quality.quality_stats(pa.array([], pa.string()))["n_words"].tolist() == []
    assert text_quality.text_quality(spark.createDataFrame([], "rec_no int, body string, word_count int")).count() == 0


def test_pii_names_without_lines_of_contacts(spark):
    """Names are learned from running text: other proper names, towns and houses are none, and no form of line is needed."""
    rng = random.Random(17)
    first = ["Oriane", "Tobrin", "Ulrika", "Dashel", "Zofka", "Kwabeno", "Imke", "Søndra"]
    stems, tails = ["Bran", "Kel", "Mor", "Dral", "Quish", "Lun", "Fast", "Gri", "Hack"], ["lotte", "skov", "stein", "wick", "zalde"]
    towns, houses = ["Lomara", "Okwanta", "Fennimore", "Quillby"], ["Museum", "Institute", "Harbour Office", "Lending Library", "Land Registry"]
    verbs = ["wrote to the harbour", "came late", "asked for the museum", "left the library", "saw the institute", "read about land"]
    docs, want = [], set()
    for i in range(500):
        n, town, house = f"{rng.choice(first)} {rng.choice(stems)}{rng.choice(tails)}", rng.choice(towns), rng.choice(houses)
        docs.append((i, f"In spring the {town} {house} was closed. {n} {rng.choice(verbs)}, and {n} signed. They met at Upper Tessel near Candle Row, said {rng.choice(['he', 'she'])} in {town}."))
        want.add((i, n))
    docs += [(900, "İzmir. Oriane Branlotte wrote."), (901, "STRASSE ẞ İ Dashel Kelskov read."), (902, None), (903, " ")]
    want |= {(900, "Oriane Branlotte"), (901, "Dashel Kelskov")}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = pii.fit_pii(df, "doc_id")
    got = {(r.doc_id, r.pii) for r in pii.find_pii(df, model).where("kind = 'name'").collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
    assert {(900, "Oriane Branlotte"), (901, "Dashel Kelskov")} <= got


def test_pii_learns_a_false_address():
    assert pii.silver("It was lost in 1885 Candle Row was paved", 15, 30, "A", []) == pii.NONE
    assert pii.silver("Send it to 18 Candle Row now", 11, 24, "A", []) == pii.ADDRESS


def test_taken_intervals():
    rng = random.Random(5)
    taken, held = pii.Taken(), []
    for _ in range(400):
        a = rng.randint(0, 2000)
        b = a + rng.randint(1, 12)
        assert taken.free(a, b) == all(b <= x or a >= y for x, y in held)
        if taken.free(a, b):
            taken.add(a, b)
            held.append((a, b))


def test_shards_are_cut_by_words(spark, monkeypatch):
    """Few long texts and many short ones: no shard has much more than its words, and each holds neighbouring lengths."""
    monkeypatch.setattr(split_overlap, "SHARD_WORDS", 400)
    rows = [(i, "word " * (3 if i % 4 else 300)) for i in range(200)] + [(900, ""), (901, "x")]
    df, n = split_overlap.cut_shards(spark.createDataFrame(rows, "key long, text string"))
    got = df.toPandas()
    assert len(got) == len(rows) and n / 2 < got["shard"].nunique() <= n
    words = got.assign(w=got["text"].str.split().str.len()).groupby("shard")["w"]
    assert words.sum().median() <= 800 and words.sum().max() <= 2400
    assert split_overlap.cut_shards(df.select("key", "text").limit(0))[1] == 1


@pytest.mark.parametrize(("stretch", "k"), [(512, 3), (10, 3), (7, 5)])
def test_maximal_matches_equal_brute_force(monkeypatch, stretch, k):
    """Backward search finds matches far longer than eight words, none that could be longer to the left, and every run of k words that is there."""
    monkeypatch.setattr(split_overlap, "STRETCH", stretch)
    rng = random.Random(stretch)
    texts = [[rng.randint(1, 6) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    texts += [list(texts[0]), list(texts[1])]
    toks, offs = np.array([w for t in texts for w in t], np.uint64), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    z = np.zeros(len(texts), np.int64)
    ix = split_overlap.WordIndex(split_overlap.WordIndex.build(toks, offs, z, z, np.zeros((len(texts), 16), np.uint64)).__getitem__)
    has = lambda r: any(t[i : i + len(r)] == r for t in texts for i in range(len(t)))
    queries = [texts[0][5:] + [99] + texts[1], [rng.randint(1, 7) for _ in range(80)], [1], [99] * 5, texts[2]]
    q = np.array([w for t in queries for w in t], np.uint64)
    qo = np.concatenate([[0], np.cumsum([len(t) for t in queries])])
    begin, end = [], []
    for a, b in zip(qo[:-1], qo[1:], strict=True):
        for at in range(a, b, stretch):
            begin.append(max(a, at - k + 1))
            end.append(min(b, at + stretch))
    begin, end = np.array(begin), np.array(end)
    which, b, e, lo, hi = ix.maximal(ix.symbols(q), begin, end, k)
    assert (hi > lo).all()
    flat = q.tolist()
    covered = set()
    for s, x, y in zip(which, b, e, strict=True):
        assert y - x >= k and has(flat[x:y]) and (x == begin[s] or not has(flat[x - 1 : y]))
        covered |= set(range(x, y - k + 1))
    owner = np.repeat(np.arange(len(queries)), np.diff(qo))
    assert covered == {i for i in range(len(flat) - k + 1) if owner[i] == owner[i + k - 1] and has(flat[i : i + k])}
    assert stretch < 512 or max(e - b) > 8


def test_longest_match_of_two_texts():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randint(1, 5) for _ in range(rng.randint(0, 40))] for _ in range(2))
        b = b[:10] + a[5:25] + b[10:]
        runs = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        want = max((n for n in range(3, len(a) + 1) if runs(a, n) & runs(b, n)), default=0)
        assert split_overlap.longest_match(np.array(a, np.uint64), np.array(b, np.uint64), 3) == want


@pytest.mark.parametrize("group", [256, 3])
def test_near_duplicates_in_rounds_equal_one_round(spark, monkeypatch, group):
    rng = random.Random(12)
    rows = []
    for i in range(160):
        w = [rng.choice("abcdefghijkl") + rng.choice("mnop") for _ in range(rng.randrange(4, 90))] if i % 3 == 0 else list(w)
        if i % 3 and len(w) > 8:
            w[rng.randrange(len(w))] = "changed"
            w += ["more"] * rng.randrange(3)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "rec_no long, body string")
    monkeypatch.setattr(near_duplicates, "GROUP", group)
    seen, kept = [], near_duplicates.stage
    monkeypatch.setattr(near_duplicates, "stage", lambda d, name="t": (seen.append(name), kept(d, name))[1])
    got = lambda: {(r.rec_no, r.group, r.links) for r in near_duplicates.near_duplicate_groups(df, similarity=0.6, words=3).collect()}
    once = got()
    assert seen.count("candidates") == 1
    seen.clear()
    monkeypatch.setattr(near_duplicates, "ROUND", 1200)
    assert got() == once and len(once) > 60 and seen.count("candidates") > 2
