"""Polled sources and published messages over the events table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larkspur.operators import temporal
from larkspur.plans import plan
from larkspur.plans.sql import EVENTS, walk
from larkspur.plans.streams import _micros, _run
from larkspur.session import shared_folder, stream_session
from larkspur.sources import polling
from larkspur.sources.events import events_view as events
from larkspur.streaming import publish


def station_documents(spark: SparkSession, sf_dir: str, folder: str) -> tuple[list[str], int, int]:
    """A JSON document of arrays for each camera and day, below ``folder``; the stations, and the first and last second."""
    at = F.floor(temporal.micros(F.col("ts")) / 900_000_000) * 900
    rows = events(spark, sf_dir).groupBy("camera_id", at.alias("at")).agg(F.max("value").alias("gust"), F.min("value").alias("rain"))
    day = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd")
    each = rows.groupBy(F.col("camera_id").alias("station"), day.alias("day")).agg(F.array_sort(F.collect_list(F.struct("at", "gust", "rain"))).alias("all"))
    text = F.to_json(F.struct(F.col("all.at").alias("time"), F.col("all.gust").alias("gust"), F.col("all.rain").alias("rain")))
    each.select("station", "day", text.alias("value")).write.partitionBy("station", "day").text(folder)
    size = rows.agg(F.min("at"), F.max("at"), F.array_sort(F.collect_set("camera_id"))).first()
    return size[2] or [], size[0] or 0, size[1] or 0


@plan("src_09_polled_slots", f"WITH {EVENTS} SELECT camera_id AS station, CAST(epoch_us(ts) // 900000000 * 900 AS BIGINT) AS at, max(value) AS gust, min(value) AS rain FROM e GROUP BY 1, 2")
def _(spark, sf_dir):
    """All stations' documents, polled in two runs of one stream: half of the time first, the rest after a restart."""
    own, folder = stream_session(spark), shared_folder(spark, "polled")
    stations, first, last = station_documents(spark, sf_dir, f"{folder}/in")
    for until in ((first + last) // 2, last):
        rows = polling.polled(own, f"{folder}/in/station={{station}}/day={{day}}", stations, ["gust", "rain"], first, until)
        query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@dataclass(frozen=True)
class Refusing:
    """A broker that is busy (code 4) for every thirteenth event and knows no topic of camera 3 (code 2)."""

    def send(self, topic: str, payload: str) -> int:
        return 2 if topic.endswith("cam_3") else 4 if int(payload.partition(":")[2].partition(",")[0]) % 13 == 0 else 0


def _published(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_folder(spark, "published")
    rows = _micros(stream_session(spark), sf_dir)
    messages = rows.select("event_id", "us", F.concat(F.lit("events/"), "camera_id").alias("topic"), F.to_json(F.struct("event_id", "label")).alias("payload"))
    publish.publish(messages, folder, Refusing, "home").trigger(availableNow=True).start().awaitTermination()
    return folder


_CODE = "CASE WHEN camera_id = 'cam_3' THEN 2 WHEN event_id % 13 = 0 THEN 4 ELSE 0 END"


@plan("snk_17_published", f"WITH {EVENTS} SELECT event_id, 'home/events/' || camera_id AS topic, '{{\"event_id\":' || event_id || ',\"label\":\"' || label || '\"}}' AS payload, {_CODE} AS code FROM e")
def _(spark, sf_dir):
    return spark.read.schema(publish.MESSAGES).parquet(f"{_published(spark, sf_dir)}/messages/batch=*").select("event_id", "topic", "payload", "code")


@plan(
    "snk_17_warnings",
    walk(
        f"SELECT camera_id || '/' || {_CODE} AS key, {_CODE} AS code, camera_id, event_id, epoch_us(ts) AS us FROM e WHERE {_CODE} > 0",
        "us AS last, true AS ok",
        "CASE WHEN r.us - w.last >= 300000000 THEN r.us ELSE w.last END AS last, r.us - w.last >= 300000000 AS ok",
        "event_id, 'home/events/' || camera_id AS topic, CAST(code AS INT) AS code",
        "ok",
        key="key",
    ),
)
def _(spark, sf_dir):
    """What a reader of the log would see: one warning of a topic and code in five minutes."""
    return spark.read.schema(publish.WARNINGS).parquet(f"{_published(spark, sf_dir)}/warnings/batch=*").select("event_id", "topic", "code")
