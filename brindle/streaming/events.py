"""Event logs: batch roll-ups, the same as streams, and fan-out to several sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "type string, stage string, data map<string,string>, timestamp timestamp"


def event(type_: str, stage: str, **data: str):
    """Columns of one event with the time of its plan."""
    pairs = [F.lit(x) for kv in data.items() for x in kv]
    return F.struct(F.lit(type_).alias("type"), F.lit(stage).alias("stage"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("data"), F.current_timestamp().alias("timestamp"))


def gate_results(gates: DataFrame) -> DataFrame:
    """Events of type gate_result from (gate, ok, summary, timestamp)."""
    return gates.select(F.lit("gate_result").alias("type"), F.col("gate").alias("stage"), F.create_map(F.lit("ok"), F.col("ok").cast("string"), F.lit("summary"), F.col("summary")).alias("data"), "timestamp")


def rollup(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", every: str = "1 hour") -> DataFrame:
    """(start, kind, n, total): batch or streaming, the time read as UTC."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    out = timed.groupBy(F.window("_t", every), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), kind, "n", "total")


def rollup_stream(spark: SparkSession, folder: str, schema, name: str, time: str = "ts", kind: str = "event_type", value: str = "value", late: str = "10 minutes", every: str = "1 hour") -> StreamingQuery:
    """The roll-up over Parquet files as they come, into a memory table; complete results after each batch."""
    stream = spark.readStream.schema(schema).parquet(folder)
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.window("_t", every), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")
    return out.writeStream.outputMode("complete").format("memory").queryName(name).start()


def fan_out(sinks: list[Callable[[DataFrame, int], None]], failed: Callable[[int, Exception], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each batch to every sink; a sink that fails doesn't stop the others."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for i, sink in enumerate(sinks):
                try:
                    sink(batch, epoch)
                except Exception as e:  # noqa: BLE001  a sink's failure is its own
                    if failed:
                        failed(i, e)
        finally:
            batch.unpersist()

    return write


def json_sink(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, epoch: batch.write.mode("append").json(path)


def null_sink(batch: DataFrame, epoch: int) -> None:
    batch.write.format("noop").mode("overwrite").save()


def console_sink(rows: int = 20) -> Callable[[DataFrame, int], None]:
    """Prints the first rows of each batch as JSON lines; a report for people, so a limit of the feature."""

    def write(batch: DataFrame, epoch: int) -> None:
        for r in batch.limit(rows).select(F.to_json(F.struct("*")).alias("line")).collect():
            print(r.line, flush=True)

    return write


def callback_sink(each: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    return lambda batch, epoch: each(batch)
