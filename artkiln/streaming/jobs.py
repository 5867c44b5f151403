"""Streams: job states, redelivery, idle expiry, drop folders, feed windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import latest_jobs
from ..session import shared_folder


def job_states(changes: DataFrame) -> DataFrame:
    """Latest state per task of a changelog stream, held in Spark's state store; written in update or complete mode.

    Changes are ordered by time and event id, wherever the borders of batches
    fall, so the answer is that of the batch operator.
    """
    return latest_jobs(changes)


def deliveries(events: DataFrame, hours: int = 24 * 7, delay: str | None = None) -> DataFrame:
    """Each delivery (state ``PENDING``) of a task with ``run``: false if the task was COMPLETED no more than ``hours`` before.

    A task that failed or is still open runs again. The state is the time of
    the task's last completion; it leaves once the watermark is ``hours`` past
    that time, when it could not change an answer any more. Rows that come
    later than ``delay`` (``hours``, if not given) are not judged.
    """
    keep = hours * 3_600_000_000

    def step(key, batches, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        done = state.get[0] if state.exists else None
        # A task has few rows: plain numbers are sorted, for a frame of its own costs more than they do.
        rows = [row for b in batches for row in zip(b["ts"].astype("datetime64[ns]").astype("int64").tolist(), b["event_id"].tolist(), b["state"].tolist())]
        rows.sort(key=lambda r: (r[0] == pd.NaT.value, r[0], r[1] != r[1], r[1]))  # unknown ones last
        out = []
        for ns, event_id, kind in rows:
            at = ns // 1000
            if kind == "PENDING":
                out.append((event_id, ns, done is None or at - done > keep))
            elif kind == "COMPLETED":
                done = at
        if done is not None:
            state.update((done,))
            state.setTimeoutTimestamp(max((done + keep) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            event_id, ns, run = zip(*out)
            yield pd.DataFrame({"task_id": key[0], "event_id": event_id, "ts": np.array(ns, dtype="datetime64[ns]"), "run": run})

    live = events.select("task_id", "event_id", "ts", "state").withWatermark("ts", delay or f"{hours} hours")
    return live.groupBy("task_id").applyInPandasWithState(step, "task_id STRING, event_id BIGINT, ts TIMESTAMP, run BOOLEAN", "done BIGINT", "append", "EventTimeTimeout")


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, label: str, base: str | None = None) -> DataFrame:
    """The rows that a stream gives for all that its source holds now, by files of the shared folder, as its checkpoint is.

    With the ``base`` of an earlier call the stream goes on from its
    checkpoint, and the rows are those of all calls.
    """
    spark = stream.sparkSession
    base = base or _fresh(spark, label)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def arriving(parts: list[DataFrame], label: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``step`` of a stream gives when parts arrive one after another, state kept between them in one checkpoint."""
    spark = parts[0].sparkSession
    base = _fresh(spark, label)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        rows = drained(step(spark.readStream.schema(part.schema).parquet(f"{base}/in")), label, base)
    return rows


def replayed(rows: DataFrame, label: str) -> DataFrame:
    """Given rows as a stream of files."""
    spark = rows.sparkSession
    path = _fresh(spark, label)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def once_per_content(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same content of a campaign passes once."""
    return uploads.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["campaign_id", "sha256"])


def idle_expiry(touches: DataFrame, hours: int = 8, delay: str = "1 hour") -> DataFrame:
    """Sessions of touches per project; a session that closes is an expired project."""
    live = touches.withWatermark("ts", delay)
    s = F.session_window("ts", f"{hours} hours")
    return live.groupBy("project_id", s.alias("w")).agg(F.count(F.lit(1)).alias("touches")).select(
        "project_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "touches")


def watch_folder(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a drop folder as a stream; contents are read only if used."""
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    return spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)


def posts_per_window(posts: DataFrame, account: str, length: str = "1 day", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Posts per account and window; a ``delay`` makes it a watermarked stream."""
    src = posts.withWatermark("ts", delay) if delay else posts
    w: Column = F.window("ts", length, slide) if slide else F.window("ts", length)
    return src.groupBy(account, w.alias("w")).agg(F.count(F.lit(1)).alias("posts")).select(
        account, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "posts")
