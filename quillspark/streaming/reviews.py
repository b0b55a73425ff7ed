"""Streaming form of the review log: reviews in, the first review of each job out, approved cases beside it. Which jobs have been
reviewed is keyed state of the stream, recovered from its checkpoint; the log itself is never read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.reviewlog import ENTRY, approved_cases, resolved

#: State of a job: id of the review that was accepted, and until when (milliseconds of event time) the job is remembered.
JOB_STATE = "id string, until long"


def review_stream(spark: SparkSession, folder: str, schema: str = ENTRY, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).json(folder)


def one_review_a_job(stream: DataFrame, late: str | None = None, keep_hours: float | None = None) -> DataFrame:
    """The stream with `accepted`: true for the first review of a job (of those in one batch the least timestamp, then id), false for
    any other. With `late` and `keep_hours`, reviews later than that are left out, and a job is forgotten so many hours after the time
    up to which reviews are in (the watermark); without, no job is ever forgotten."""
    kept = stream.columns
    schema = T.StructType([*stream.schema, T.StructField("accepted", T.BooleanType())])
    if late is not None:
        stream = stream.withColumn("_time", F.try_to_timestamp("timestamp")).withWatermark("_time", late)

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        # one pass: of the rows so far only the best one waits
        best = None
        for f in frames:
            f = f.copy()
            f["accepted"] = False
            if held is None and len(f):
                both = (f if best is None else pd.concat([best, f])).sort_values(["timestamp", "id"], kind="stable", na_position="last", ignore_index=True)
                best, f = both.iloc[:1], both.iloc[1:]
            if len(f):
                yield f[[*kept, "accepted"]]
        if best is not None:
            best = best.copy()
            best["accepted"] = True
            until = None
            if keep_hours is not None:
                when = best["_time"].iloc[0]
                at = state.getCurrentWatermarkMs() if pd.isna(when) else max(state.getCurrentWatermarkMs(), pd.Timestamp(when).value // 1_000_000)
                until = int(at + keep_hours * 3_600_000) + 1
            state.update((None if pd.isna(best["id"].iloc[0]) else str(best["id"].iloc[0]), until))
            yield best[[*kept, "accepted"]]
        if keep_hours is not None and state.exists:
            state.setTimeoutTimestamp(max(state.get[1], state.getCurrentWatermarkMs() + 1))

    kind = GroupStateTimeout.EventTimeTimeout if keep_hours is not None else GroupStateTimeout.NoTimeout
    return stream.groupBy("job_id").applyInPandasWithState(judge, schema, JOB_STATE, "append", kind)


def write_reviews(stream: DataFrame, log: str, approved: str, checkpoint: str, schema: str = ENTRY, late: str | None = None, keep_hours: float | None = None) -> StreamingQuery:
    """Append each job's first review to the log, and what it approves beside it. A batch that is run again has the state and the rows
    that it had before, and replaces its own part of both."""

    def batch(df: DataFrame, number: int) -> None:
        fresh = df.filter("accepted").drop("accepted").withColumn("batch", F.lit(number).cast("long")).persist()
        for rows, folder in ((fresh, log), (approved_cases(fresh).withColumn("batch", F.lit(number).cast("long")), approved)):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)
        fresh.unpersist()

    judged = one_review_a_job(resolved(stream), late, keep_hours)
    return judged.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def action_counts(stream: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: windowed counts of actions with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
