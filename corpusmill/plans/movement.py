"""Streams over the tables, and tables written and read back through every reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.expr import r6
from corpusmill.plans.dedup import NEAR
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval import R6
from corpusmill.runtime import new_path
from corpusmill.sinks import writers
from corpusmill.sources import readers
from corpusmill.sources.tables import table
from corpusmill.streaming import streams


def _stream(spark, d, name):
    return streams.table_stream(spark, d, name, table(spark, d, name).schema)


@query(f"with l as (select * from (select *, row_number() over (partition by request_id order by received_at) as r from cost_ledger) where r = 1) select coalesce(nullif(trim(model), ''), 'unknown') as model, count(*) as requests, {R6.format('sum(coalesce(cost_usd, 0))')} as spent from l group by 1")
def stream_spend(spark, d):
    """Running spend by model over the ledger as a stream, without repeated requests."""
    return streams.run_to_end(streams.spend_by_model(_stream(spark, d, "cost_ledger")))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, floor(sum(value) * 1e4 + 0.5) / 1e4 as total from events group by 1, 2")
def stream_event_windows(spark, d):
    """Events by kind and hour over a stream with a watermark."""
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.run_to_end(streams.event_windows(e))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.floor(F.col("total") * 1e4 + 0.5) / 1e4).alias("total"))


@query("select time_bucket(interval '30 minutes', ts) - s * interval '30 minutes' as start, event_type, count(*) as n from events cross join (values (0), (1)) x(s) group by 1, 2")
def stream_sliding_windows(spark, d):
    """Events in windows of an hour that begin every half hour."""
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.run_to_end(streams.event_windows(e, "1 hour", slide="30 minutes")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval '30 minutes' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) as n from s group by user_id, s""")
def stream_sessions(spark, d):
    """Sessions of users over a stream."""
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.run_to_end(streams.event_sessions(e), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"with {NEAR}, mx as (select b as doc, max(sim) as sim from sm group by 1) select sg.doc as doc_id, (select min(a) from sm where sm.b = sg.doc and sm.sim = mx.sim) as matched, {R6.format('coalesce(mx.sim, 0)')} as similarity from sg left join mx using (doc)")
def stream_near_dups(spark, d):
    """Verdicts of documents that come as a stream."""
    out = streams.near_duplicates(_stream(spark, d, "documents"), "doc_id", "text")
    return out.select(F.col("doc").alias("doc_id"), "matched", r6(F.col("similarity")).alias("similarity"))


@query(f"select run_name, count(*) as n, {R6.format('avg(confidence)')} as confidence from class_predictions group by run_name")
def predictions_as_jsonl(spark, d):
    """Predictions written as JSON lines and read back strictly."""
    path = new_path(spark, "predictions")
    table(spark, d, "class_predictions").write.json(path)
    return readers.jsonl_strict(spark, path, readers.PREDICTIONS).groupBy("run_name").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("confidence"))


@query(f"select coalesce(lower(status), '(none)') as status, count(*) as n, {R6.format('sum(coalesce(cost_usd, 0))')} as cost from cost_ledger group by 1")
def ledger_as_jsonl(spark, d):
    """The ledger appended in two parts, torn lines among them, and read back without those."""
    path = new_path(spark, "ledger")
    l = table(spark, d, "cost_ledger").drop("received_at")  # noqa: E741
    writers.append_ledger(l.where("input_tokens % 2 = 0"), path)
    writers.append_ledger(l.where("input_tokens % 2 <> 0 or input_tokens is null"), path)
    spark.createDataFrame([('{"request_id": "torn", "status": "o',), ("not json",)], "value string").coalesce(1).write.mode("append").text(path)
    r = readers.jsonl_tolerant(spark, path, readers.LEDGER)
    return r.groupBy(F.coalesce(F.lower("status"), F.lit("(none)")).alias("status")).agg(F.count("*").alias("n"), r6(F.sum(F.coalesce("cost_usd", F.lit(0.0)))).alias("cost"))


@query("select split, count(*) as n, sum(length(coalesce(text, body, title)))::bigint as chars from shelf_features where trim(coalesce(text, body, title)) <> '' group by split")
def dataset_written_and_scanned(spark, d):
    """A dataset saved by split and scanned again split by split, with the text's fallback."""
    path = new_path(spark, "dataset")
    shelf = table(spark, d, "shelf_features")
    writers.save_dataset(shelf, path)
    parts = [readers.split_scan(spark, f"{path}/data", s, schema=shelf.schema) for s in ("train", "dev", "test")]
    return readers.union_of(*parts).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select case when split in ('train', 'dev', 'test') then split else 'train' end as split, count(*) as n, min(id) as least from shelf_features group by 1")
def splits_as_jsonl(spark, d):
    """Splits as JSON lines with a folder each, unknown ones to train."""
    path = new_path(spark, "pooled")
    writers.save_pooled(table(spark, d, "shelf_features").select("id", "body", "split"), path)
    return readers.jsonl_strict(spark, f"{path}/jsonl", "id string, body string, split string").groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("least"))


@query("with a as (select id, trim(coalesce(title, '')) as title, nullif(trim(audience), '') as audience from shelf_features where trim(id) <> '') select count(*) as n, count(audience) as with_audience, count(nullif(title, '')) as with_title from a")
def sheet_as_csv(spark, d):
    """An annotation sheet written as CSV and read back with trimmed cells."""
    path = new_path(spark, "sheet")
    table(spark, d, "shelf_features").select("id", "title", "audience").write.option("header", True).option("escape", '"').csv(path)
    return readers.annotation_sheet(spark, path).agg(F.count("*").alias("n"), F.count("audience").alias("with_audience"), F.count("title").alias("with_title"))


@query("select facet, count(*) as n, min(term) as least from label_space group by facet")
def specs_as_block(spark, d):
    """A block with manifest and checksum written and read back."""
    path = new_path(spark, "block")
    writers.save_spec_block(table(spark, d, "label_space"), path)
    return readers.spec_block(spark, path, "facet string, term string, broader string").groupBy("facet").agg(F.count("*").alias("n"), F.min("term").alias("least"))


@query("select term as label, broader from label_space where facet = 'lcgft_form'")
def taxonomy_as_triples(spark, d):
    """A taxonomy written as SKOS triples, with labels in two languages, and read back as concepts."""
    path = new_path(spark, "triples")
    t = table(spark, d, "label_space").where("facet = 'lcgft_form'")
    s = F.concat(F.lit("<urn:form:"), F.md5("term"), F.lit(">"))
    quoted = lambda c: F.regexp_replace(c, '"', r'\\\\"')
    line = lambda p, o: F.concat(s, F.lit(f" <http://www.w3.org/2004/02/skos/core#{p}> "), o, F.lit(" ."))
    lines = F.array(line("prefLabel", F.concat(F.lit('"A '), quoted("term"), F.lit('"@de'))), line("prefLabel", F.concat(F.lit('"'), quoted("term"), F.lit('"@en'))), line("broader", F.concat(F.lit("<"), F.replace("broader", F.lit(" "), F.lit("%20")), F.lit(">"))), F.lit("# a comment"))
    t.select(F.explode(lines).alias("value")).write.text(path)
    c = readers.concepts(readers.triples(spark, path))
    return c.select("label", F.replace(F.col("broader")[0], F.lit("%20"), F.lit(" ")).alias("broader"))


@query("select source, count(*) as n, max(n_chars) as most from documents where source is not null group by source")
def catalogue_as_xml(spark, d):
    """Records written as XML and read back by element."""
    path = new_path(spark, "xml")
    table(spark, d, "documents").select("doc_id", "source", "n_chars").write.format("xml").option("rowTag", "record").option("rootTag", "records").save(path)
    r = readers.catalogue_xml(spark, path, "record", "doc_id bigint, source string, n_chars bigint")
    return r.where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("most"))


@query("select run_name as model, 'lcc' as task, count(*) as n from class_predictions group by 1")
def results_as_files(spark, d):
    """A result file for each model, an error stub among them, scanned by folder with model and task from the name."""
    path = new_path(spark, "results")
    rows = table(spark, d, "class_predictions").groupBy("run_name").agg(F.count("*").alias("n")).collect()  # a row for each run
    for r in rows:
        writers.put_text(spark, f"{path}/{r['run_name']}_lcc.json", '{"n": %d,\n "error": null}' % r["n"])
    writers.put_text(spark, f"{path}/broken_lcc.json", '{"n": 0, "error": "out of memory"}')
    writers.put_text(spark, f"{path}/other_task.json", '{"n": 0}')
    return readers.result_folder(spark, path, "lcc").select("model", "task", F.col("n").cast("long").alias("n"))
