import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusmill.operators import neardup
from corpusmill.plans import movement
from corpusmill.sinks import writers
from corpusmill.sources import readers
from corpusmill.streaming import streams


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_json_lines_strict_and_tolerant(spark, tmp_path):
    write(tmp_path / "p.jsonl", '{"run_name": "a", "id": "x", "prediction": "Q", "confidence": 0.5}\n{"run_name": "a", "id":\n')
    p = str(tmp_path / "p.jsonl")
    assert readers.jsonl_tolerant(spark, p, readers.PREDICTIONS).count() == 1
    assert [r.line for r in readers.torn_lines(spark, p, readers.PREDICTIONS).collect()] == ['{"run_name": "a", "id":']
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.jsonl_strict(spark, p, readers.PREDICTIONS).collect()


def test_split_scan_falls_back_and_drops_blanks(spark, tmp_path):
    rows = [("a", "test", None, "body", "t"), ("b", "test", None, None, "title"), ("c", "test", " ", "body", "t"), ("d", "train", "x", None, None)]
    spark.createDataFrame(rows, "id string, split string, text string, body string, title string").write.parquet(str(tmp_path / "d"))
    assert {r.id: r.text for r in readers.split_scan(spark, str(tmp_path / "d"), "test").collect()} == {"a": "body", "b": "title"}
    assert readers.split_scan(spark, str(tmp_path / "d"), wanted={"id": ["d"]}).count() == 1


def test_pair_scan_maps_names_and_fails_loudly(spark, tmp_path):
    spark.createDataFrame([("a", "b", 1)], "a string, b string, label int").write.parquet(str(tmp_path / "pairs/same_lcgft/test"))
    assert readers.pair_scan(spark, str(tmp_path), "same_form_pairs", "test").count() == 1
    with pytest.raises(PySparkException, match="no_such"):
        readers.pair_scan(spark, str(tmp_path), "no_such", "test").count()


def test_documents_and_results_by_file(spark, tmp_path):
    write(tmp_path / "docs/1.json", '{"id": "a",\n "body": "text", "git_commit": "c1"}')
    write(tmp_path / "docs/2.json", '{"id": "b", "body": " ", "git_commit": "c1"}')
    write(tmp_path / "docs/3.json", '{"id": "c", "body": "text", "git_commit": "c2"}')
    assert {r.id for r in readers.json_documents(spark, str(tmp_path / "docs")).collect()} == {"a", "c"}
    assert {r.id for r in readers.json_documents(spark, str(tmp_path / "docs"), ["c1"]).collect()} == {"a"}
    write(tmp_path / "res/tf_idf_lcc_form.json", '{"score": 0.5, "error": null}')
    write(tmp_path / "res/bow_lcc_form.json", '{"score": 0.1, "error": "killed"}')
    write(tmp_path / "res/bow_other.json", '{"score": 0.9}')
    assert [(r.model, r.task, r.score, r.file) for r in readers.result_folder(spark, str(tmp_path / "res"), "lcc_form").collect()] == [("tf_idf", "lcc_form", 0.5, "tf_idf_lcc_form.json")]


def test_samples_with_a_header_gzipped(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 0)], "id string, ok int")
    writers.save_results(spark.createDataFrame([("f1", 0.5)], "name string, value double"), str(tmp_path / "r"), rows)
    import glob
    import gzip

    lines = [json.dumps({"_type": "header", "task": "lcc"})]
    for f in glob.glob(f"{tmp_path}/r/samples/*.json.gz"):
        lines += gzip.open(f, "rt").read().splitlines()
    with gzip.open(tmp_path / "s.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    head, got = readers.with_header(spark, str(tmp_path / "s.jsonl.gz"), "id string, ok int")
    assert head["task"] == "lcc" and {(r.id, r.ok) for r in got.collect()} == {("a", 1), ("b", 0)}


def test_a_block_that_was_changed_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), ("y", None)], "a string, b int")
    p = str(tmp_path / "block")
    writers.save_spec_block(rows, p)
    assert {tuple(r) for r in readers.spec_block(spark, p, "a string, b int").collect()} == {("x", 1), ("y", None)}
    spark.createDataFrame([('{"a": "z"}',)], "value string").write.mode("append").text(p)
    with pytest.raises(ValueError, match="manifest"):
        readers.spec_block(spark, p, "a string, b int")


def test_triples_and_skos_and_frequencies(spark, tmp_path):
    nt = '<u:1> <http://x/core#prefLabel> "Bücher \\"alt\\""@de .\n<u:1> <http://x/core#prefLabel> "Books"@en .\n<u:1> <http://x/core#altLabel> "Tomes"@en .\n<u:1> <http://x/core#broader> <u:2> .\n<u:2> <http://x/core#prefLabel> "Sachen"@de .\n<u:3> <http://x/core#broader> <u:1> .\n# no triple\nbroken\n'
    write(tmp_path / "t.nt", nt)
    t = readers.triples(spark, str(tmp_path / "t.nt"))
    assert t.count() == 6 and {r.object for r in t.where("lang = 'de'").collect()} == {'Bücher "alt"', "Sachen"}
    assert {r.id: (r.label, r.alternatives, r.broader) for r in readers.concepts(t).collect()} == {"u:1": ("Books", ["Tomes"], ["u:2"]), "u:2": ("Sachen", [], [])}
    rec = {"@graph": [{"@id": "u:1", "@type": "skos:Concept", "skos:prefLabel": [{"@language": "fr", "@value": "Livres"}, {"@language": "en", "@value": "Books"}]}, {"@id": "u:9", "@type": "other"}]}
    write(tmp_path / "s.json", json.dumps(rec) + "\nnot json\n")
    assert [(r.id, r.label) for r in readers.skos_lines(spark, str(tmp_path / "s.json")).collect()] == [("u:1", "Books")]
    write(tmp_path / "f.json", '{"b": 5, "a": 5,\n "c": 9}')
    assert [(r.label, r["rank"]) for r in readers.frequency_taxonomy(spark, str(tmp_path / "f.json")).orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    pool = spark.createDataFrame([("Q", "Science", 1), ("QA", None, 2), ("QB", "Stars", 3)], "code string, description string, rank int")
    assert [r.code for r in readers.subclass_pool(pool, 1, True, False).collect()] == ["QB"]


def test_dataset_in_every_form_and_its_metadata(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "train"), ("b", "y", "test"), ("c", "z", "train")], "id string, body string, split string")
    for form in ("parquet", "json", "orc"):
        meta = writers.save_dataset(df, f"file://{tmp_path}/{form}", form, {"same": df.select("id", "split")})
        assert meta["splits"] == {"train": 2, "test": 1} and json.loads((tmp_path / form / "metadata.json").read_text())["pairs"] == {"same": {"train": 2, "test": 1}}
        assert spark.read.format(form).load(f"{tmp_path}/{form}/data").count() == 3
    with pytest.raises(ValueError):
        writers.save_dataset(df, str(tmp_path / "x"), "csv")
    m = writers.save_splits_jsonl(df, f"file://{tmp_path}/splits", ["body"])
    assert m["train"]["rows"] == 2 and m == writers.save_splits_jsonl(df.repartition(5), f"file://{tmp_path}/splits2", ["body"])
    a = writers.save_artifacts(df.withColumn("body", F.lit("one two three")), f"file://{tmp_path}/art")
    assert a == {"documents": 3, "least_words": 3, "most_words": 3, "mean_words": 3} and sum(f.stat().st_size > 0 for f in (tmp_path / "art/documents").glob("*.json")) == 3
    writers.save_matrix(spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("a", "x", 3)], "r string, c string, n int"), f"file://{tmp_path}/m", "r", "c", "n")
    assert next((tmp_path / "m").glob("*.csv")).read_text().split() == ["r,x,y", "a,4,0", "b,0,2"]


def test_events_fan_out_and_append(spark, tmp_path):
    seen = []
    for _ in range(2):
        log = writers.EventLog(seen.append, writers.JsonEvents(spark, f"file://{tmp_path}/events"))
        log.emit("start", task="lcc")
        log.emit("done", task="lcc", score=0.5)
        log.close()
    assert len(seen) == 4 and readers.jsonl_strict(spark, str(tmp_path / "events"), "event string, payload string").where("event = 'done'").count() == 2


def test_stream_of_several_files_equals_the_batch(spark, tmp_path):
    rng = random.Random(6)
    schema = "request_id string, model string, cost_usd double"
    rows = [(f"r{i % 70}", rng.choice(["a", " b ", "", None]), 0.25) for i in range(100)]
    keep = {}
    for r in rows:
        keep.setdefault(r[0], r)
    rows = [keep[r[0]] for r in rows]
    for k in range(4):
        spark.createDataFrame(rows[k * 25 : k * 25 + 25], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    s = streams.file_stream(spark, f"{tmp_path}/in/*", schema, each=1)
    got = {r.model: (r.requests, r.spent) for r in streams.run_to_end(streams.spend_by_model(s)).collect()}
    want = {}
    for _, m, c in keep.values():
        k = (m or "").strip() or "unknown"
        want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0.0))[1] + c)
    assert got == want


def test_near_duplicates_over_batches_equal_all_at_once(spark, tmp_path):
    rng = random.Random(7)
    texts, rows = [], []
    for i in range(40):
        w = list(rng.choice(texts)) if texts and rng.random() < 0.6 else [f"w{rng.choice('abcdefghij')}{rng.choice('klmnopq')}{rng.choice('rstuv')}" for _ in range(120)]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "changed"
        texts.append(w)
        rows.append((i, " ".join(w)))
    rows.append((40, ""))
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10] + (rows[40:] if k == 3 else []), "i long, t string").coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    s = streams.file_stream(spark, f"{tmp_path}/in/*", "i long, t string", each=1)
    got = {r.doc: (r.matched, round(r.similarity, 6)) for r in streams.near_duplicates(s, "i", "t").collect()}
    sig = neardup.signatures(spark.createDataFrame(rows, "i long, t string").where("t <> ''"), "i", "t")
    want = {r.doc: (r.matched, round(r.similarity, 6)) for r in neardup.verdicts(sig).collect()}
    assert got == want and sum(m is not None for m, _ in want.values()) > 10


def test_late_events_and_sessions(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1, "a", 1.0), ("2024-01-01 00:35:00", 1, "a", 2.0), ("2024-01-01 02:00:00", 1, "b", 3.0)]
    df = spark.createDataFrame(rows, "t string, user_id long, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/in/p0")
    s = lambda: streams.file_stream(spark, f"{tmp_path}/in/*", df.schema)
    w = {(r.start.hour, r.event_type): (r.n, r.total) for r in streams.run_to_end(streams.event_windows(s())).collect()}
    assert w == {(0, "a"): (2, 3.0), (2, "b"): (1, 3.0)}
    assert sorted(r.n for r in streams.run_to_end(streams.event_sessions(s())).collect()) == [1, 2]


def test_ledger_that_is_a_folder_streams_too(spark, tmp_path):
    ledger = spark.createDataFrame([("a", "m", 0.25), ("b", None, 0.5), ("a", "m", 0.25), ("c", "m", None)], "request_id string, model string, cost_usd double")
    ledger.repartition(3).write.parquet(f"{tmp_path}/cost_ledger.parquet")
    assert {r.model: (r.requests, r.spent) for r in movement.stream_spend(spark, str(tmp_path)).collect()} == {"m": (2, 0.25), "unknown": (1, 0.5)}


def test_documents_that_are_a_folder_stream_too(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30))) for i in range(3)] + [(3, "other words"), (4, " ")], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.matched, r.similarity) for r in movement.stream_near_dups(spark, str(tmp_path)).collect()} == {0: (None, 0.0), 1: (0, 1.0), 2: (0, 1.0), 3: (None, 0.0)}


def test_index_of_streamed_documents_is_small(spark, tmp_path, monkeypatch):
    """Band keys are numbers, and a key that two bands have by chance makes no match."""
    docs = spark.createDataFrame([(i, " ".join(chr(97 + n // 26) + chr(97 + n % 26) for n in (j * i % 97 for j in range(40)))) for i in range(1, 9)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    one_key = lambda sig: sig.select("doc", F.lit(7).cast("long").alias("key"))
    assert neardup.band_keys(neardup.signatures(docs, "doc_id", "text", shingles=False)).dtypes == [("doc", "bigint"), ("key", "bigint")]
    monkeypatch.setattr(neardup, "band_keys", one_key)
    paths = []
    monkeypatch.setattr(streams, "new_path", lambda s, name: paths.append(f"{tmp_path}/{name}") or paths[-1])
    got = {r.doc_id: (r.matched, r.similarity) for r in movement.stream_near_dups(spark, f"{tmp_path}/in").collect()}
    assert got == {i: (None, 0.0) for i in range(1, 9)}
    assert dict(spark.read.parquet(f"{paths[0]}/index").dtypes)["signature"] == "array<int>"
