"""Readers with explicit schemas: JSON lines strict and tolerant, result folders, headers with checksums, CSV, XML, taxonomies in triples and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTIONS = "run_name string, id string, prediction string, confidence double"
LEDGER = "request_id string, logged_at string, received_at timestamp, run_id string, model string, input_tokens int, output_tokens int, reasoning_tokens int, cost_usd double, provider_served string, spec_id string, doc_ref string, status string, extra string"


def jsonl_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a schema; a line that is none fails the read when it is reached."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a schema without the lines that are torn."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def torn_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line): what jsonl_tolerant() leaves out."""
    parsed = F.from_json("value", f"{schema}, _torn string", {"columnNameOfCorruptRecord": "_torn"})
    return spark.read.text(path).withColumn("x", parsed).where("x._torn is not null").select(F.col("value").alias("line"))


def with_text(df: DataFrame, *names: str) -> DataFrame:
    """df with `text`: the first of the named columns that it has and that is not null; rows whose text is blank are dropped."""
    from corpusmill.functions.fields import text_or

    return df.withColumn("text", text_or(df, *names)).where(F.trim("text") != "")


def split_scan(spark: SparkSession, root: str, split: str | None = None, wanted: dict | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet rows of a split with their text (text, else body, else title), filtered by fields; blank texts are dropped. A folder without files needs a schema."""
    from corpusmill.functions.fields import filter_by

    df = (spark.read.schema(schema) if schema else spark.read).parquet(root)
    df = df.where(F.col("split") == split) if split is not None and "split" in df.columns else df
    return with_text(filter_by(df, wanted or {}), "text", "body", "title")


#: Folders of pair sets by the name of their configuration, where it isn't the name itself.
PAIR_FOLDERS = {"same_form_pairs": "same_lcgft", "same_lcc_pairs": "same_lcc", "topic_overlap_pairs": "topic_overlap"}


def pair_scan(spark: SparkSession, root: str, config: str, split: str) -> DataFrame:
    """The pairs of a configuration and split; a folder that is not there is an error that names it."""
    return spark.read.parquet(f"{root}/pairs/{PAIR_FOLDERS.get(config, config)}/{split}")


def json_documents(spark: SparkSession, folder: str, commits: list[str] | None = None) -> DataFrame:
    """One JSON object a file: those with a body, of the given commits where such are given; `file` is the file's path."""
    df = spark.read.option("multiLine", True).json(folder).withColumn("file", F.input_file_name())
    df = df.where(F.trim("body") != "")
    return df.where(F.col("git_commit").isin(commits)) if commits else df


def result_folder(spark: SparkSession, folder: str, task: str | None = None) -> DataFrame:
    """Results, a JSON object a file named <model>_<task>.json, with `model`, `task` and `file`; records of an error are left out."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", f"*_{task or '*'}.json").json(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    end = task.replace(".", r"\.") if task else "[^_]+(?:_[^_]+)?"
    df = df.withColumn("file", F.concat(name, F.lit(".json"))).withColumn("model", F.regexp_extract(name, rf"^(.*)_({end})$", 1)).withColumn("task", F.regexp_extract(name, rf"^(.*)_({end})$", 2))
    return df.where(F.col("error").isNull()) if "error" in df.columns else df


def with_header(spark: SparkSession, path: str, schema: str, kind: str = "_type") -> tuple[dict, DataFrame]:
    """(header, rows) of JSON lines, plain or gzipped, whose header line says so in `kind`."""
    lines = spark.read.text(path)
    head = lines.where(F.get_json_object("value", f"$.{kind}") == "header").limit(1).collect()  # one line
    import json

    rows = lines.where(F.coalesce(F.get_json_object("value", f"$.{kind}"), F.lit("")) != "header")
    return (json.loads(head[0][0]) if head else {}), rows.select(F.from_json("value", schema).alias("x")).select("x.*")


def spec_block(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a block whose first line is a manifest with the number of rows and their checksum (the md5s of all lines, merged by exclusive or); a block that does not agree is an error."""
    manifest, _ = with_header(spark, path, schema)
    lines = spark.read.text(path).where(F.get_json_object("value", "$.__manifest__").isNull())
    from corpusmill.functions.expr import hash60

    got = lines.agg(F.count("*").alias("n"), F.bit_xor(hash60(F.col("value"))).alias("x")).first()
    if manifest.get("rows") != got["n"] or manifest.get("checksum") != got["x"]:
        raise ValueError(f"block {path}: {got['n']} rows with checksum {got['x']}, the manifest says {manifest.get('rows')} and {manifest.get('checksum')}")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object over several lines, as a row."""
    return spark.read.option("multiLine", True).json(path)


def annotation_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet with a header, cells trimmed and blank ones null, rows without an id left out."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in df.columns]).where("id is not null")


def catalogue_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Records of an XML catalogue, one for each element of that name."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def union_of(*frames: DataFrame) -> DataFrame:
    """Rows of tables of different columns, by name; what one lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, lang) of N-Triples; comments and other lines are left out, escapes are resolved."""
    p = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<[^>]*>)?)\s*\.\s*$'
    g = lambda i: F.regexp_extract("value", p, i)
    lit = F.regexp_replace(F.regexp_replace(g(4), r'\\"', '"'), r"\\\\", r"\\")
    rows = spark.read.text(path).where(F.col("value").rlike(p))
    return rows.select(g(1).alias("subject"), g(2).alias("predicate"), F.when(g(3) != "", g(3)).otherwise(lit).alias("object"), F.nullif(F.lower(g(5)), F.lit("")).alias("lang"))


def concepts(t: DataFrame) -> DataFrame:
    """(id, label, alternatives, broader) of SKOS triples: English labels first, then by name; concepts without a label are left out."""
    name = F.regexp_extract("predicate", r"([^#/]+)$", 1)
    order = F.struct((F.coalesce(F.col("lang"), F.lit("")) != "en").alias("other"), F.col("object"))
    pick = lambda n: F.collect_set(F.when(name == n, F.col("object")))
    g = t.groupBy(F.col("subject").alias("id")).agg(F.min_by(F.when(name == "prefLabel", F.col("object")), F.when(name == "prefLabel", order)).alias("label"), F.sort_array(pick("altLabel")).alias("alternatives"), F.sort_array(pick("broader")).alias("broader"))
    return g.where("label is not null")


def skos_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of a dump of SKOS records as JSON lines with an @graph each; an English label before others."""
    schema = "`@graph` array<struct<`@id`: string, `@type`: string, `skos:prefLabel`: array<struct<`@language`: string, `@value`: string>>>>"
    g = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).select(F.explode("@graph").alias("n")).where(F.col("n")["@type"].contains("Concept"))
    labels = F.array_sort(F.transform(F.col("n")["skos:prefLabel"], lambda x: F.struct((F.coalesce(x["@language"], F.lit("")) != "en").alias("o"), x["@value"].alias("v"))))
    return g.select(F.col("n")["@id"].alias("id"), F.get(labels, F.lit(0))["v"].alias("label")).where("label is not null")


def frequency_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(label, frequency, rank) of a JSON object of frequencies by label, ranked by frequency and then by label."""
    from pyspark.sql import Window

    one = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, bigint>").alias("m")).select(F.explode("m").alias("label", "frequency"))
    return one.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("frequency"), "label")))  # a taxonomy's labels


def subclass_pool(df: DataFrame, size: int, require_description: bool = False, include_main: bool = True) -> DataFrame:
    """The first `size` of (code, description, rank), with a description where wanted, without one-letter codes where not."""
    from corpusmill.plans.distributions import ranked_pool

    df = df.where(F.trim(F.coalesce("description", F.lit(""))) != "") if require_description else df
    return ranked_pool(df if include_main else df.where(F.length("code") > 1), size)
