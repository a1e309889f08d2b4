"""Structured Streaming over an event log: outbox with cursor, status projection, idempotent requests, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tallyspark.session import shared_path

#: fixed values: event types by rank; the highest seen decides the status
STATUS = {"view": "queued", "signup": "queued", "click": "running", "purchase": "completed", "error": "failed"}


def stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The Parquet files of a table as a stream; its checkpoint is the cursor."""
    schema = spark.read.parquet(path).schema
    # a single file is read through its folder and a name filter
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_dir(spark, path) else reader.parquet(path)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drain(df: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and give its rows. Progress and output are in the shared folder, or below
    the folder `at`: a later run there goes on where this one ended, and gives the rows of both."""
    spark = df.sparkSession
    out, cursor = (f"{at}/rows", f"{at}/cursor") if at else (shared_path(spark, name), shared_path(spark, f"{name}-cursor"))
    if mode == "append":
        q = df.writeStream.trigger(availableNow=True).option("checkpointLocation", cursor).format("parquet").start(out)
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={no}")

    q = df.writeStream.trigger(availableNow=True).option("checkpointLocation", cursor).outputMode(mode).foreachBatch(keep).start()
    q.awaitTermination()
    last = max([b.get("batchId", 0) for b in q.recentProgress], default=0)
    return spark.read.schema(df.schema).parquet(f"{out}/batch={last}")


def projected(events: DataFrame) -> DataFrame:
    """Per user the status of the furthest event and the last event_id."""
    rank = F.array_position(F.array(*map(F.lit, STATUS)), F.col("event_type"))
    names = F.array(*map(F.lit, STATUS.values()))
    return events.groupBy("user_id").agg(F.element_at(names, F.max(rank).cast("int")).alias("status"), F.max("event_id").alias("generation"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and event type; events later than the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def first_requests(events: DataFrame, key: str, late: str = "365 days") -> DataFrame:
    """One event for each request key."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.dropDuplicatesWithinWatermark([key])


def receipts(events: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """A row for each request (key, order, body) of a stream: key, order, receipt, outcome.

    The first request of a key is accepted and its order is the receipt; a later one with the same body is repeated and
    gets the same receipt, one with another body is a conflict with it and changes nothing. A key's state is one receipt.
    First is least in order among a micro-batch's requests of a key, which are held together (the trigger bounds them),
    and earlier batches come before later ones. A null body is a body like any other; rows with a null key are one key.
    """

    def judge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("_order", kind="stable")
        body_ = rows["_body"].map(lambda b: "" if b is None else "=" + b)
        if state.exists:
            receipt, first, fresh = *state.get, False
        else:
            receipt, first, fresh = int(rows["_order"].iloc[0]), body_.iloc[0], True
            state.update((receipt, first))
        outcome = body_.map(lambda b: "repeated" if b == first else "conflict")
        if fresh:
            outcome.iloc[0] = "accepted"
        yield pd.DataFrame({"_key": rows["_key"], "_order": rows["_order"], "receipt": receipt, "outcome": outcome.to_numpy()})

    e = events.select(F.col(key).cast("string").alias("_key"), F.col(order).cast("long").alias("_order"), F.col(body).cast("string").alias("_body"))
    out = e.groupBy("_key").applyInPandasWithState(judge, "_key string, _order long, receipt long, outcome string", "receipt long, first string", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("_key").alias(key), F.col("_order").alias(order), "receipt", "outcome")


def backlog(records: DataFrame, namespace: str) -> DataFrame:
    """Per namespace of a stream of (namespace, kind, generation), in update mode: appended, last, acked, pending.

    kind append adds a generation to the outbox, ack confirms all generations up to its own. A generation that comes
    twice counts once while it is pending, and one at or below what is acked already is never pending. State is the
    generations that are pending, so it is as long as the backlog.
    """

    def count(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        appended, last, acked, pending = state.get if state.exists else (0, -1, -1, [])
        for rows in batches:
            new, ack = rows.loc[rows["kind"] == "append", "generation"], rows.loc[rows["kind"] == "ack", "generation"]
            appended, last = appended + len(new), max(last, int(new.max()) if len(new) else -1)
            acked = max(acked, int(ack.max()) if len(ack) else -1)
            pending = sorted({g for g in (*pending, *new.tolist()) if g > acked})
        state.update((appended, last, acked, pending))
        yield pd.DataFrame({"_ns": [k[0]], "appended": [appended], "last": [last], "acked": [acked], "pending": [len(pending)]})

    r = records.select(F.col(namespace).cast("string").alias("_ns"), "kind", F.col("generation").cast("long").alias("generation"))
    out = r.groupBy("_ns").applyInPandasWithState(count, "_ns string, appended long, last long, acked long, pending long", "appended long, last long, acked long, pending array<long>", "update", GroupStateTimeout.NoTimeout)
    return out.select(F.col("_ns").alias(namespace), "appended", "last", "acked", "pending")


def drain_latest(df: DataFrame, name: str, key: str, at: str | None = None) -> DataFrame:
    """Run a stream in update mode over all that is there now: each key's newest row. A batch that is run again after a
    crash overwrites its own files."""
    spark = df.sparkSession
    base = at or shared_path(spark, name)

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={no}")

    df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/cursor").outputMode("update").foreachBatch(keep).start().awaitTermination()
    schema = StructType([*df.schema.fields, StructField("batch", LongType())])
    rows = spark.read.option("basePath", f"{base}/rows").schema(schema).parquet(f"{base}/rows")
    return rows.groupBy(key).agg(F.max_by(F.struct(*df.columns), "batch").alias("x")).select("x.*")
