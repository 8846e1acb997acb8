"""Structured streams: running spend, windowed events, and near-duplicates against all earlier documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.expr import r6
from corpusmill.operators import neardup
from corpusmill.operators.blocks import pairs_within
from corpusmill.runtime import new_path


def file_stream(spark: SparkSession, folder: str, schema, files: str | None = None, form: str = "parquet", each: int | None = None) -> DataFrame:
    """Rows of the files in a folder as a stream, `each` files at a time where given."""
    reader = spark.readStream.schema(schema).format(form)
    reader = reader.option("pathGlobFilter", files) if files else reader
    return (reader.option("maxFilesPerTrigger", each) if each else reader).load(folder)


def table_stream(spark: SparkSession, root: str, name: str, schema, each: int | None = None) -> DataFrame:
    """The Parquet table `name` under `root` as a stream, whether it is a file or a folder of files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return file_stream(spark, f"{root}/{name}.parquet", schema, each=each)
    return file_stream(spark, root, schema, f"{name}.parquet", each=each)  # a stream takes folders only


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now; the last state of an aggregation (complete), or all rows (append). State and results lie in the shared folder, so a lost executor costs a batch."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")

    def put(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={no:09d}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("b")).first()["b"]
        out = out.where(F.col("batch") == last)
    return out.drop("batch")


def spend_by_model(ledger: DataFrame) -> DataFrame:
    """Running requests and spend by model over a stream of requests, repeated ones dropped."""
    cost = F.coalesce("cost_usd", F.lit(0.0))
    return ledger.dropDuplicates(["request_id"]).groupBy(F.coalesce(F.nullif(F.trim("model"), F.lit("")), F.lit("unknown")).alias("model")).agg(F.count("*").alias("requests"), r6(F.sum(cost)).alias("spent"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events by kind in tumbling windows, or sliding ones where a slide is given; what comes later than `late` is dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events no more than `gap` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def near_duplicates(stream: DataFrame, doc: str, text: str, threshold: float = neardup.THRESHOLD) -> DataFrame:
    """(doc, matched, similarity, passed) of a stream of documents: each against all earlier ones, those of its own batch with a smaller key among them.

    The index of signatures lies in the shared folder, a folder for each batch, which a repeated batch writes again; only bands
    that the batch has are looked up.
    """
    spark = stream.sparkSession
    path = new_path(spark, "neardup")

    def step(batch: DataFrame, no: int) -> None:
        mine = f"{path}/index/batch={no:09d}"
        sig = neardup.signatures(batch.where(F.trim(text) != ""), doc, text, shingles=False).select("doc", F.col("signature").cast("array<int>").alias("signature"))  # below 2^31
        sig.write.mode("overwrite").parquet(mine)
        new = spark.read.parquet(mine)
        inside = neardup.verdicts(new, threshold).select("doc", "matched", "similarity")
        earlier = spark.read.parquet(f"{path}/index").where(F.col("batch") < no).drop("batch") if no else None
        best = inside
        if earlier is not None and not earlier.isEmpty():
            old = earlier.groupBy("signature").agg(F.min("doc").alias("doc"))
            keys = neardup.band_keys(new.dropDuplicates(["signature"])).withColumn("fresh", F.lit(True))
            both = neardup.band_keys(old).join(keys.select("key").distinct(), "key", "left_semi").withColumn("fresh", F.lit(False))
            tagged = keys.unionByName(both)
            met = pairs_within(tagged.withColumn("m", F.concat_ws("|", "fresh", "doc")), ["key"], "m", keep=["fresh", "doc"]).where("fresh_a <> fresh_b")
            met = met.select(F.when(F.col("fresh_a"), F.col("doc_a")).otherwise(F.col("doc_b")).alias("head"), F.when(F.col("fresh_a"), F.col("doc_b")).otherwise(F.col("doc_a")).alias("earlier")).distinct()
            heads = new.dropDuplicates(["signature"]).select(F.col("doc").alias("head"), F.col("signature").alias("s"))
            scored = met.join(heads, "head").join(old.select(F.col("doc").alias("earlier"), F.col("signature").alias("t")), "earlier").where(neardup.share_band("s", "t")).select("s", "earlier", neardup.agreement("s", "t").alias("similarity"))
            across = new.join(scored, new["signature"] == scored["s"]).select("doc", F.col("earlier").alias("matched"), "similarity")
            every = inside.where("matched is not null").unionByName(across)
            top = every.groupBy("doc").agg(F.max(F.struct("similarity", (-F.col("matched")).alias("e"))).alias("m"))
            best = new.select("doc").join(top, "doc", "left").select("doc", (-F.col("m.e")).alias("matched"), F.coalesce("m.similarity", F.lit(0.0)).alias("similarity"))
        best.withColumn("passed", F.col("similarity") < threshold).write.mode("overwrite").parquet(f"{path}/out/batch={no:09d}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")
