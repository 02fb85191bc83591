"""STR-14: goals over the event store, evaluated again and again with the same outcome, and told once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import rules
from larkspur.operators import store, temporal

STATE = "goal_id string, progress long, target long, completed_at timestamp_ntz, notified_at timestamp_ntz"


@dataclass(frozen=True)
class Goal:
    """So many events, species or days that match, within a window of WIN-24."""

    name: str
    window: str
    target: int
    counted: str = "events"
    label: str | None = None
    labels: tuple[str, ...] | None = None
    hours: tuple[int, ...] | None = None

    def value(self) -> Column:
        """What an event that matches is counted by; null if by nothing."""
        counted = {"events": F.lit(""), "species": rules.blank_to_null(F.lower(F.col("bird_species"))), "days": rules.blank_to_null(F.substring("time", 1, 10))}[self.counted]
        return F.when(store.goal_matches(self.label, self.labels, self.hours), counted)

    def progress(self, now: str, value: Column, n: Column) -> Column:
        """The aggregate that counts it over ``n`` events a row, up to the target; null while the window is closed."""
        start, end = temporal.goal_window(self.window, now)
        value = F.when(F.col("ts").between(start, end), value)
        count = F.coalesce(F.sum(F.when(value.isNotNull(), n)), F.lit(0)) if self.counted == "events" else F.count_distinct(value)
        return F.when(F.first(start).isNotNull(), F.least(count.cast("long"), F.lit(self.target).cast("long")))


def evaluate(events: DataFrame, goals: Sequence[Goal], state: DataFrame, now: str) -> DataFrame:
    """The state after an evaluation at ``now``, with ``notify`` where a goal is to be told: it is complete and never was told.

    All goals are counted in one pass. Progress is counted anew, a completed goal stays so, a closed window keeps what was; so a second evaluation changes
    nothing and tells nothing. A goal's id has the year, so each season has its own.
    """
    counts = events.agg(*[g.progress(now, g.value(), F.lit(1)).alias(f"g{i}") for i, g in enumerate(goals)])
    return _after(counts, goals, state, now)


def _after(counts: DataFrame, goals: Sequence[Goal], state: DataFrame, now: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f"{g.name}_{now[:4]}").alias("goal_id"), F.col(f"g{i}").alias("counted"), F.lit(g.target).cast("long").alias("target")) for i, g in enumerate(goals)])
    known = state.select("goal_id", F.col("progress").alias("was"), "completed_at", "notified_at")
    out = counts.select(F.inline(rows)).join(known, "goal_id", "left")
    at, progress = F.lit(now).cast("timestamp_ntz"), F.coalesce("counted", "was", F.lit(0).cast("long"))
    done = F.coalesce("completed_at", F.when(F.col("counted") >= F.col("target"), at))
    notify = done.isNotNull() & F.col("notified_at").isNull()
    return out.select("goal_id", progress.alias("progress"), "target", done.alias("completed_at"), F.coalesce("notified_at", F.when(notify, at)).alias("notified_at"), notify.alias("notify"))


SUMMARY = "goal int, ts timestamp_ntz, value string, n long"


def summarise(events: DataFrame, goals: Sequence[Goal]) -> DataFrame:
    """What the goals can count of some events: rows (goal, ts, value, n)."""
    found = F.array_compact(F.array(*[F.when(g.value().isNotNull(), F.struct(F.lit(i).alias("goal"), g.value().alias("value"))) for i, g in enumerate(goals)]))
    return events.select("ts", F.inline(found)).groupBy("goal", "ts", "value").agg(F.count("*").alias("n")).select("goal", "ts", "value", "n")


def compact(summary: DataFrame, now: str) -> DataFrame:
    """The summary with all but the last week by months, and without former years: windows begin with a month or reach back a week from a clock that doesn't go back."""
    week = F.lit(now).cast("timestamp_ntz") - F.expr("interval 7 days")
    rows = summary.where((F.col("ts") >= week) | (F.year("ts") >= int(now[:4])))
    by = F.when(F.col("ts") >= week, F.col("ts")).otherwise(F.date_trunc("month", "ts").cast("timestamp_ntz"))
    return rows.groupBy("goal", by.alias("ts"), "value").agg(F.sum("n").alias("n"))


def evaluate_summary(summary: DataFrame, goals: Sequence[Goal], state: DataFrame, now: str) -> DataFrame:
    """``evaluate`` over a summary."""
    own = lambda i: F.when(F.col("goal") == i, F.col("value"))
    return _after(summary.agg(*[g.progress(now, own(i), F.col("n")).alias(f"g{i}") for i, g in enumerate(goals)]), goals, state, now)


def follow(stream: DataFrame, goals: Sequence[Goal], folder: str, now: str | Callable[[int], str]):
    """A stream's writer: after every micro-batch the goals' state is that of ``evaluate`` over all events so far, at ``now`` (or now(batch number), which must not go back).

    A batch is reduced to a summary and added to that of the batches before, which holds single times for the last week and months for the year. So a batch's work follows its own size, however long the stream has run.
    Each batch writes its own summary and state from those of the one before, so a batch that runs twice leaves the same.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        at = now(number) if callable(now) else now
        before = lambda what, schema: spark.read.schema(schema).parquet(f"{folder}/{what}/batch={number - 1}") if number else spark.createDataFrame([], schema)
        compact(before("summary", SUMMARY).unionByName(summarise(batch, goals)), at).write.mode("overwrite").parquet(f"{folder}/summary/batch={number}")
        summary = spark.read.schema(SUMMARY).parquet(f"{folder}/summary/batch={number}")
        evaluate_summary(summary, goals, before("state", STATE), at).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log")
