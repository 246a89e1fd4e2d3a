"""The continuous mode: URLs seen once, lives of sessions and the queue of inputs, as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.functions import urls
from webloom.operators import store
from webloom.session import is_folder


def new_urls(stream: DataFrame, url: str, date: str | None = None, late: str = "1 day") -> DataFrame:
    """Each page once. With a date column, what is kept is bounded by the watermark."""
    keyed = stream.withColumn("dedup_key", urls.dedup_key(urls.normalized(F.col(url)))).where("dedup_key is not null")
    return keyed.withWatermark(date, late).dropDuplicatesWithinWatermark(["dedup_key"]) if date else keyed.dropDuplicates(["dedup_key"])


def states(stream: DataFrame, key: str, date: str, state: str) -> DataFrame:
    """The latest state of each session, for the update output mode."""
    return stream.groupBy(key).agg(F.max_by(state, date).alias("state"), F.count("*").alias("events"))


#: What a signal makes of a state; a signal that isn't named for it changes nothing.
LIFE = {
    ("", "start"): "running",
    ("running", "idle"): "hook",
    ("hook", "complete"): "done",
    ("running", "disconnect"): "interrupted",
    ("hook", "disconnect"): "interrupted",
    ("done", "start"): "running",
    ("interrupted", "start"): "running",
}


def lives(stream: DataFrame, key: str, order: list[str], signal: str) -> DataFrame:
    """(key, state, steps) after each batch: sessions run, wait for their hook, and are done or interrupted.

    A session's signals are taken in order within a batch, and batches as they come. ``steps``
    counts the signals that changed the state.
    """
    kind = dict(stream.dtypes)[key]

    def fold(ident: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, steps = state.get if state.exists else ("", 0)
        for s in pd.concat(list(parts)).sort_values(order)[signal]:
            after = LIFE.get((now, s))
            if after is not None:
                now, steps = after, steps + 1
        state.update((now, steps))
        yield pd.DataFrame({key: [ident[0]], "state": [now], "steps": [steps]})

    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, state string, steps int", "state string, steps int", "update", GroupStateTimeout.NoTimeout)


def due(stream: DataFrame, now: str) -> DataFrame:
    """Inputs of a queue stream that are due; poll it with ``trigger(processingTime="5 seconds")``."""
    return stream.where(F.col("date") <= F.lit(now).cast("timestamp"))


def taken(added: DataFrame, now: str, days: int = 28) -> tuple[DataFrame, DataFrame]:
    """The inputs that are due, and the queue in which they are due again in ``days`` days."""
    at = F.lit(now).cast("timestamp")
    is_due = F.coalesce(F.col("date") <= at, F.lit(False))
    return added.where(is_due), added.withColumn("date", F.when(is_due, at + F.make_dt_interval(F.lit(days))).otherwise(F.col("date")))


def serve(path: str, clock=None):
    """A ``foreachBatch`` function that keeps the queue in ``path``: it adds the batch's inputs and takes what is due.

    What batch n took is in ``path/taken/batch=n``; one query with a checkpoint is the only
    consumer, and a batch that is repeated writes the same folders again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = clock() if clock else str(spark.sql("select current_timestamp() as t").first().t)
        old = store.current(spark, f"{path}/queue")
        queue = batch if old is None else store.insert_ignore(old, batch, ["id"])
        gone, left = taken(queue, now)
        gone.write.mode("overwrite").parquet(f"{path}/taken/batch={batch_id}")
        left.write.mode("overwrite").parquet(f"{path}/queue/v{batch_id}")
        spark.createDataFrame([(batch_id,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/queue/current")

    return run


def replayed(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """The rows of a stream up to now, written below ``folder``, which has its checkpoint too.

    In the update mode the rows of all batches, the latest of a key among them. A stream
    that had no files has no batches, so no rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if not is_folder(spark, f"{folder}/rows"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/*")


def counts(stream: DataFrame, date: str, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by kind and window, final when the watermark has passed."""
    return stream.withWatermark(date, late).groupBy(F.window(date, window).alias("w"), by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), by, "events")
