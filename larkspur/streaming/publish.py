"""SNK-17: publishing a stream's messages, once for each batch, with throttled warnings.

Messages are sent by the tasks that hold them, each task with a client of its own, and what became of every message is written as the batch's table, by Spark's commit protocol:
a table of a batch is either whole or not there. A batch that runs again after its table is written sends nothing. Failed messages don't stop the stream; a warning is
given for a topic and code at most every ``WARN_S`` seconds of message time, by what earlier batches have left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from larkspur.operators import folds

WARN_S = 300.0
MESSAGES = "event_id long, us long, topic string, payload string, code int"
WARNINGS = "event_id long, us long, topic string, code int"


class Client(Protocol):
    def send(self, topic: str, payload: str) -> int:
        """0, or the broker's code of what went wrong."""


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path) if spark.read.text(f"{path}/_SUCCESS").isEmpty() else None
    except AnalysisException:
        return None


def _sent(messages: DataFrame, client: Callable[[], Client]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client()
        for batch in batches:
            codes = []
            for topic, payload in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                try:
                    codes.append(own.send(topic, payload))
                except Exception:  # noqa: BLE001  one message's failure is its own
                    codes.append(-1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32())], names=[*batch.schema.names, "code"])

    return messages.mapInArrow(run, MESSAGES)


def warnings(failed: DataFrame, before: DataFrame, seconds: float = WARN_S) -> DataFrame:
    """The failures to warn of: ``seconds`` after the last warning of their topic and code, the ones ``before`` included."""
    last = before.groupBy("topic", "code").agg(F.max_by("event_id", "us").alias("event_id"), F.max("us").alias("us")).select("event_id", "us", "topic", "code", F.lit(True).alias("old"))
    rows = last.unionByName(failed.select("event_id", "us", "topic", "code", F.lit(False).alias("old")))
    return folds.cooldown(rows, ["topic", "code"], "us", seconds).where("not old").drop("old")


def publish(stream: DataFrame, folder: str, client: Callable[[], Client], base_topic: str, warn_s: float = WARN_S) -> DataStreamWriter:
    """A stream's writer: rows (event_id, us, topic, payload) go to ``base_topic``/topic. ``folder`` has messages/batch=n and warnings/batch=n."""

    def step(batch: DataFrame, number: int) -> None:
        spark, place = batch.sparkSession, f"{folder}/messages/batch={number}"
        sent = _written(spark, place, MESSAGES)
        if sent is None:
            rows = batch.select("event_id", "us", F.concat_ws("/", F.lit(base_topic), "topic").alias("topic"), "payload")
            _sent(rows, client).write.mode("overwrite").parquet(place)
            sent = spark.read.schema(MESSAGES).parquet(place)
        if _written(spark, f"{folder}/warnings/batch={number}", WARNINGS) is None:
            before = _written(spark, f"{folder}/last/batch={number - 1}", WARNINGS)
            before = spark.createDataFrame([], WARNINGS) if before is None else before
            told = warnings(sent.where("code <> 0"), before, warn_s)
            told.write.mode("overwrite").parquet(f"{folder}/warnings/batch={number}")
            told = spark.read.schema(WARNINGS).parquet(f"{folder}/warnings/batch={number}")
            last = before.unionByName(told).groupBy("topic", "code").agg(F.max_by("event_id", "us").alias("event_id"), F.max("us").alias("us")).select("event_id", "us", "topic", "code")
            last.coalesce(1).write.mode("overwrite").parquet(f"{folder}/last/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log")
