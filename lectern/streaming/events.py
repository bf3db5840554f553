"""Operators over timed events: windows, sessions, cooldowns, circuit breakers, budgets, and their streaming form.

Batch functions and streams share their expressions; a stream over a finished folder gives what the batch gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, by: str) -> DataFrame:
    """(start, by, n, total) of windows of one size; works on streams with a watermark."""
    return events.groupBy(F.window("ts", size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """(key, start, end, n) of runs of events with gaps under `gap`."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cooldown(events: DataFrame, key: str, trigger: str, seconds: int) -> DataFrame:
    """events plus blocked: an event of `trigger` blocks its key's later events for so many seconds."""
    at = F.when(F.col("event_type") == trigger, F.col("ts"))
    last = F.last(at, ignorenulls=True).over(Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("blocked", F.coalesce(F.col("ts") < last + F.make_interval(secs=F.lit(seconds)), F.lit(False)))


def breaker(events: DataFrame, key: str, failure: str, most: int) -> DataFrame:
    """events plus streak (failures in a row, this one included) and open (the streak before it had reached `most`)."""
    bad = F.col("event_type") == failure
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    d = events.withColumn("_run", F.sum(F.when(bad, 0).otherwise(1)).over(w))
    streak = F.sum(F.when(bad, 1).otherwise(0)).over(Window.partitionBy(key, "_run").orderBy("ts", "event_id"))
    d = d.withColumn("streak", F.when(bad, streak).otherwise(0))
    return d.withColumn("open", F.coalesce(F.lag("streak").over(w) >= most, F.lit(False))).drop("_run")


def gaps(events: DataFrame, key: str) -> DataFrame:
    """(key, n, largest, mean): seconds between a key's events."""
    g = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return events.withColumn("gap", g).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("gap"), 3).alias("largest"), F.round(F.avg("gap"), 3).alias("mean"))


def pacing(events: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """events plus recent (events of the key in the last `seconds`, this one included) and denied (more than `most`)."""
    w = Window.partitionBy(key).orderBy(F.unix_timestamp("ts")).rangeBetween(1 - seconds, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("denied", F.col("recent") > most)


def budget(items: DataFrame, key: str, order: list[str], cost: str, most: float) -> DataFrame:
    """items plus spent (running cost) and admitted (still within `most`)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = items.withColumn("spent", F.sum(cost).over(w))
    return d.withColumn("admitted", F.col("spent") <= most)


def first_seen(items: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """items plus distinct_so_far: how many different items of the key have been seen, in order."""
    first = F.row_number().over(Window.partitionBy(key, item).orderBy(*order)) == 1
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("_first", first.cast("int")).withColumn("distinct_so_far", F.sum("_first").over(w)).drop("_first")


def states(events: DataFrame, key: str) -> DataFrame:
    """(key, state, since, n): the last event's type decides the state."""
    last = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id"))
    s = events.groupBy(key).agg(last.alias("l"), F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("l.event_type") == "error", "failed").when(F.col("l.event_type") == "purchase", "succeeded").when(F.col("l.event_type") == "signup", "queued").otherwise("running")
    return s.select(key, state.alias("state"), F.col("l.ts").alias("since"), "n")


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(stream: DataFrame, ids: list[str], delay: str) -> DataFrame:
    """Each id once within the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(ids)


def run_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote. Files and progress are in the given folders,
    so a restart goes on where it stopped. Complete-mode results replace the folder at each batch."""
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        q = w.format("parquet").option("path", path).start()
    else:
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def failure_counts(stream: DataFrame, key: str, failure: str) -> DataFrame:
    """(key, failures, total) of every key, for the update mode: each batch gives the new counts of the keys that it has."""
    return stream.groupBy(key).agg(F.count(F.when(F.col("event_type") == failure, 1)).alias("failures"), F.count(F.lit(1)).alias("total"))
