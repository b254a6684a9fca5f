"""Structured Streaming: micro-batches, event-time counts, stateful detectors, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows and seconds of a micro-batch, fixed defaults.
BATCH_ROWS, BATCH_SECONDS = 100, 30


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A file source of Parquet; `ts` becomes a TIMESTAMP, as watermarks want it."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def kafka_stream(spark: SparkSession, servers: str, topic: str = "security-events", **options: str) -> DataFrame:
    """key, value, timestamp, headers from Kafka, where its connector is on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true").options(**options).load()


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None, seconds: int | None = None, retries: int = 3, **options: str) -> StreamingQuery:
    """Send each row as JSON to a topic. The producer repeats what fails, `retries` times, in order; what still fails
    stops the query, which goes on from its checkpoint at the next start: a row may come twice and is never lost."""
    value = F.to_json(F.struct(*(f"`{c}`" for c in df.columns))).alias("value")
    rows = df.select(*([F.col(f"`{key}`").cast("string").alias("key")] if key else []), value)
    out = rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
    out = out.option("kafka.retries", retries).option("kafka.enable.idempotence", "true").option("kafka.acks", "all").options(**options)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()


def envelopes(df: DataFrame, kind: str, source: str, **fields) -> DataFrame:
    """Typed stream events: event_kind, timestamp, source and the given columns."""
    return df.select(F.lit(kind).alias("event_kind"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit(source).alias("source"), *(c.alias(n) for n, c in fields.items()))


def micro_batches(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Hand each micro-batch to work; without seconds, what is there now and then stop. A failed batch stops the
    query and is repeated at the next start, so none is dropped."""
    out = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()


def tumbling_counts(df: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    own = df.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sliding_counts(df: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    own = df.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def session_counts(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    own = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return own.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def rolling_z_scores(df: DataFrame, window: int = 100, z: float = 3.0, warm_up: int = 10) -> DataFrame:
    """The rolling z-score with the last `window` values of each label as state.

    Points of a batch are taken by (timestamp, tie); points that come in a later batch count on arrival.
    df has label, timestamp (seconds), tie, value.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat([*batches]).sort_values(["timestamp", "tie"], kind="stable")
        out = []
        for t, tie, x in zip(rows["timestamp"], rows["tie"], rows["value"], strict=True):
            held = [*held[-(window - 1) :], float(x)] if window > 1 else [float(x)]
            if len(held) >= warm_up:
                mean = sum(held) / len(held)
                deviation = (sum((y - mean) ** 2 for y in held) / len(held)) ** 0.5
                if deviation > 0:
                    score = abs(x - mean) / deviation
                    out.append((key[0], int(t), int(tie), float(x), score, mean + z * deviation, bool(score > z), "z_score"))
        state.update((held,))
        yield pd.DataFrame(out, columns=["label", "timestamp", "tie", "value", "score", "threshold", "is_anomaly", "method"])

    return df.groupBy("label").applyInPandasWithState(
        step, "label string, timestamp bigint, tie bigint, value double, score double, threshold double, is_anomaly boolean, method string", "held array<double>", "append", GroupStateTimeout.NoTimeout
    )


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet once for what is there now; files and checkpoint make it exactly once."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
