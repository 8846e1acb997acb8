"""Writers. Each writes from the executors; what the driver writes is a manifest of a few numbers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.expr import hash60
from corpusmill.functions.fields import strata_key


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, through the file system that the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def save_dataset(df: DataFrame, path: str, form: str = "parquet", pairs: dict[str, DataFrame] | None = None) -> dict:
    """Splits as folders split=..., pair sets under pairs/<name>/split=..., and metadata.json with the number of rows of each. form: parquet, json or orc."""
    if form not in ("parquet", "json", "orc"):
        raise ValueError(form)
    meta = {"form": form, "splits": {}, "pairs": {}}
    for name, part in {"": df, **(pairs or {})}.items():
        where = f"{path}/pairs/{name}" if name else f"{path}/data"
        part.write.mode("overwrite").partitionBy("split").format(form).save(where)
        counts = {r["split"]: r["n"] for r in part.groupBy("split").agg(F.count("*").alias("n")).collect()}  # a few splits
        if name:
            meta["pairs"][name] = counts
        else:
            meta["splits"] = counts
    put_text(df.sparkSession, f"{path}/metadata.json", json.dumps(meta, sort_keys=True))
    return meta


def save_splits_jsonl(df: DataFrame, path: str, strata: list[str]) -> dict:
    """JSON lines by split, and metadata with sizes and an order-free checksum of each split's ids."""
    df.write.mode("overwrite").partitionBy("split").json(f"{path}/data")
    rows = df.groupBy("split").agg(F.count("*").alias("n"), F.bit_xor(hash60(F.col("id"))).alias("checksum"), F.countDistinct(strata_key(df, strata)).alias("strata")).collect()  # a few splits
    meta = {r["split"]: {"rows": r["n"], "checksum": r["checksum"], "strata": r["strata"]} for r in rows}
    put_text(df.sparkSession, f"{path}/metadata.json", json.dumps(meta, sort_keys=True))
    return meta


def save_artifacts(df: DataFrame, path: str, per_file: int = 1) -> dict:
    """Documents as JSON, at most `per_file` a file, an index by id, and metadata: rows, shortest, longest and whole mean number of words."""
    df.write.mode("overwrite").option("maxRecordsPerFile", per_file).json(f"{path}/documents")
    words = F.size(F.filter(F.split(F.coalesce("body", F.lit("")), r"\s+"), lambda x: x != ""))
    df.select("id", words.alias("words")).write.mode("overwrite").parquet(f"{path}/index")
    r = df.agg(F.count("*").alias("n"), F.min(words).alias("lo"), F.max(words).alias("hi"), F.sum(words).alias("s")).first()
    meta = {"documents": r["n"], "least_words": r["lo"], "most_words": r["hi"], "mean_words": (r["s"] or 0) // r["n"] if r["n"] else 0}
    put_text(df.sparkSession, f"{path}/metadata.json", json.dumps(meta, sort_keys=True))
    return meta


def save_pooled(df: DataFrame, path: str) -> None:
    """Parquet and JSON lines by split; rows of no or an unknown split go to train."""
    known = F.col("split").isin("train", "dev", "test")
    p = df.withColumn("split", F.when(known, F.col("split")).otherwise("train"))
    p.write.mode("overwrite").partitionBy("split").parquet(f"{path}/parquet")
    p.write.mode("overwrite").partitionBy("split").json(f"{path}/jsonl")


def save_matrix(cells: DataFrame, path: str, rows: str, cols: str, value: str) -> None:
    """Cells as a CSV matrix with a header, 0 where there is none; the columns are the values of `cols`, which must be few."""
    cells.groupBy(rows).pivot(cols).agg(F.sum(value)).fillna(0).orderBy(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Rows appended to a ledger of JSON lines; committed files only ever appear whole."""
    rows.write.mode("append").json(path)


def save_results(metrics: DataFrame, path: str, samples: DataFrame | None = None) -> None:
    """Metrics in long form (name, value) as JSON, and rows of samples as gzipped JSON lines."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    if samples is not None:
        samples.write.mode("overwrite").option("compression", "gzip").json(f"{path}/samples")


def save_spec_block(rows: DataFrame, path: str) -> dict:
    """A block of JSON lines whose first line is a manifest with the number of rows and their checksum, in one file: blocks are small by construction."""
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    r = lines.agg(F.count("*").alias("n"), F.bit_xor(hash60(F.col("value"))).alias("x")).first()
    meta = {"__manifest__": True, "_type": "header", "rows": r["n"], "checksum": r["x"]}
    head = rows.sparkSession.createDataFrame([(json.dumps(meta),)], "value string")
    head.unionByName(lines).coalesce(1).write.mode("overwrite").text(path)
    return meta


class EventLog:
    """Events of a run, handed to several handlers; the JSON handler keeps lines and appends them to a ledger when it is closed."""

    def __init__(self, *handlers):
        self.handlers = handlers

    def emit(self, kind: str, **fields) -> None:
        for h in self.handlers:
            h({"event": kind, **fields})

    def close(self) -> None:
        for h in self.handlers:
            if hasattr(h, "close"):
                h.close()


class JsonEvents:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.rows = spark, path, []

    def __call__(self, event: dict) -> None:
        self.rows.append((event["event"], json.dumps(event, sort_keys=True)))

    def close(self) -> None:
        if self.rows:
            append_ledger(self.spark.createDataFrame(self.rows, "event string, payload string"), self.path)
            self.rows = []
