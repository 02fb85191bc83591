"""SRC-9: a polled source of slot arrays as a stream, by Spark's Python Data Source API.

A station's document of a day holds parallel arrays: ``time`` (Unix seconds of each slot) and one array a field, of any length. The stream's offset is a slot number (Unix seconds by
``SLOT_S``), so Spark's checkpoint knows what has been read: after a restart no slot comes twice and none is missed. A batch has one task for each station and day that its slots touch; a
document is fetched by that task, never by the driver. Documents or fields that aren't there, or aren't what they should be, give no rows or nulls, as an outage does.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SLOT_S = 900
DAY_S = 86_400


@dataclass
class StationDay(InputPartition):
    station: str
    day: int
    first: int
    end: int


def documents(url: str, timeout: float = 10.0) -> Iterator[dict]:
    """The JSON documents at a web address, or in a file or folder."""
    try:
        if url.startswith(("http://", "https://")):
            with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310  http and https only
                texts = [answer.read().decode()]
        else:
            path = Path(url.removeprefix("file://"))
            texts = [p.read_text() for p in sorted(path.glob("[!._]*"))] if path.is_dir() else [path.read_text()]
    except (OSError, urllib.error.URLError, UnicodeDecodeError):
        return
    for line in (x for text in texts for x in text.splitlines()):
        try:
            found = json.loads(line)
        except ValueError:
            continue
        if isinstance(found, dict):
            yield found


def slots(document: dict, fields: list[str], first: int, end: int) -> Iterator[tuple]:
    """(slot's time, fields...) of a document's slots from number ``first`` up to ``end``; a field's missing tail is null."""
    times = document.get("time")
    arrays = [v if isinstance(v := document.get(f), list) else [] for f in fields]
    for i, at in enumerate(times if isinstance(times, list) else []):
        if isinstance(at, int | float) and first <= int(at) // SLOT_S < end:
            yield (int(at), *(float(a[i]) if i < len(a) and isinstance(a[i], int | float) else None for a in arrays))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.stations, self.fields = options["url"], options["stations"].split(","), options["fields"].split(",")
        self.first, self.until = int(options.get("first", 0)), options.get("until")

    def initialOffset(self) -> dict:
        return {"slot": self.first // SLOT_S}

    def latestOffset(self) -> dict:
        """Slots that have begun by now are there."""
        return {"slot": int(float(self.until) if self.until else time.time()) // SLOT_S + 1}

    def partitions(self, start: dict, end: dict) -> list[StationDay]:
        first, last = start["slot"] * SLOT_S // DAY_S, (end["slot"] * SLOT_S - 1) // DAY_S
        return [StationDay(s, d, start["slot"], end["slot"]) for s in self.stations for d in range(first, last + 1)] if start["slot"] < end["slot"] else []

    def read(self, partition: StationDay) -> Iterator[tuple]:
        day = time.strftime("%Y-%m-%d", time.gmtime(partition.day * DAY_S))
        for document in documents(self.url.format(station=partition.station, day=day)):
            for row in slots(document, self.fields, partition.first, partition.end):
                if row[0] // DAY_S == partition.day:
                    yield (partition.station, *row)


class PolledSlots(DataSource):
    """Options: ``url`` with {station} and {day}, ``stations`` and ``fields`` (by commas), ``first`` (Unix seconds of the first slot wanted), ``until`` (the clock; the real one if not given)."""

    @classmethod
    def name(cls) -> str:
        return "polled_slots"

    def schema(self) -> str:
        return ", ".join(["station string", "at long", *(f"`{f}` double" for f in self.options["fields"].split(","))])

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def polled(spark: SparkSession, url: str, stations: list[str], fields: list[str], first: int = 0, until: int | None = None):
    """The stream of all stations' slots."""
    spark.dataSource.register(PolledSlots)
    reader = spark.readStream.format("polled_slots").option("url", url).option("stations", ",".join(stations)).option("fields", ",".join(fields)).option("first", first)
    return (reader.option("until", until) if until is not None else reader).load()
