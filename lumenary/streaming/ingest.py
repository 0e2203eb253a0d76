"""Beyond the batch surface: the same operators on streams.

A folder of images is rendered as files arrive (each micro-batch is the batch plan), and polls of a deployment are
folded into the first state that ends its wait, with a deadline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..operators import relational as R
from ..plans import process as P

AT_ONCE = 10_000
FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, glob: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """New files in a folder, as a stream of paths; a micro-batch has AT_ONCE at most."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", AT_ONCE).option("pathGlobFilter", glob).load(folder).select("path", "length")


def render_arrivals(spark: SparkSession, folder: str, settings: P.Settings, report: Callable[[DataFrame], None] | None = None):
    """A started query that renders each new file; `report` gets the rows of a micro-batch."""

    def each(batch: DataFrame, _: int) -> None:
        paths = [r["path"].removeprefix("file:").replace("///", "/", 1) for r in batch.select("path").orderBy("path").collect()]
        if paths:
            done = P.process(batch.sparkSession, paths, settings)
            (report or (lambda rows: rows.count()))(done)

    return arrivals(spark, folder).writeStream.foreachBatch(each).trigger(availableNow=True).start()


def waits(polls: DataFrame, deadline_ms: int = 30 * 60 * 1000) -> DataFrame:
    """A stream of polls (stack, ordinal, status) -> (stack, status, result), once per stack: done, failed, or timeout."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda status, result: pd.DataFrame({"stack": [key[0]], "status": [status], "result": [result]})
        if state.hasTimedOut:
            ended = state.exists and state.get[0]
            state.remove()
            if not ended:
                yield row(None, "timeout")
            return
        ended = state.exists and state.get[0]
        if not ended:
            rows = pd.concat(list(batches)).sort_values("ordinal")
            rows = rows[rows["status"].isin((*fixed.DONE, *fixed.FAILED))]
            if len(rows):
                status = rows["status"].iloc[0]
                ended = True
                yield row(status, "done" if status in fixed.DONE else "failed")
        state.update((bool(ended),))
        state.setTimeoutDuration(deadline_ms)

    return polls.groupBy("stack").applyInPandasWithState(fold, "stack string, status string, result string", "ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def statuses(polls: DataFrame) -> DataFrame:
    """Each poll with what its state means."""
    return polls.withColumn("kind", R.status_kind(F.col("status")))
