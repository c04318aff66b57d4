"""Contact rules on an arriving log: each account keeps its recent attempts as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampNTZType

from placewise import config
from placewise.operators import compliance

DAY_US = 86_400_000_000
WINDOW_DAYS = 14
# A day's slack for attempts that arrive late, both in what an account keeps and in when an idle account's state expires.
KEPT_DAYS = WINDOW_DAYS + 1
_STATE = "us array<long>, complaint array<boolean>"
_COUNTS = ["attempts_today", "attempts_7d", "attempts_14d"]


def earlier_attempts(us: np.ndarray, known: np.ndarray, complaints: np.ndarray, offset_us: int) -> dict[str, np.ndarray]:
    """For attempts at ``us``: how many of ``known`` (sorted) lie before them on the local day, in 7 and in 14 days; the last of ``complaints`` in 7 days or -1."""
    upto = np.searchsorted(known, us, "left")
    since = lambda start: upto - np.searchsorted(known, start, "left")
    midnight = (us + offset_us) // DAY_US * DAY_US - offset_us
    place = np.searchsorted(complaints, us, "left") - 1
    last = np.where(place >= 0, complaints[np.maximum(place, 0)] if len(complaints) else -1, -1)
    return {
        "attempts_today": since(midnight), "attempts_7d": since(us - 7 * DAY_US), "attempts_14d": since(us - WINDOW_DAYS * DAY_US),
        "last_complaint": np.where(last >= us - 7 * DAY_US, last, -1),
    }


def recent_attempts(offset_minutes: int, idle_days: int):
    """The state function: time and complaint mark of an account's attempts within ``KEPT_DAYS`` of its newest one."""

    def update(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(rows), ignore_index=True)
        us, complaint = batch["us"].to_numpy(np.int64), batch["complaint"].to_numpy(bool)
        every, marks = us, complaint
        if state.exists:
            before, before_marks = state.get
            every, marks = np.concatenate([np.array(before, np.int64), us]), np.concatenate([np.array(before_marks, bool), complaint])
        order = np.argsort(every, kind="stable")
        every, marks = every[order], marks[order]
        for name, values in earlier_attempts(us, every, every[marks], offset_minutes * 60_000_000).items():
            batch[name] = values.astype(np.int64)
        recent = every >= every[-1] - KEPT_DAYS * DAY_US
        state.update((every[recent].tolist(), marks[recent].tolist()))
        state.setTimeoutDuration(idle_days * 86_400_000)
        yield batch

    return update


def guarded(log: DataFrame, rules: config.ContactRules = config.ContactRules(), holidays: DataFrame | None = None, idle_days: int = KEPT_DAYS) -> DataFrame:
    """Each attempt of a streaming ``log`` with the verdict that the attempts before it lead to.

    ``log``: account_id, attempted_at, outcome, and further columns of plain types, which stay. An
    attempt counts those that arrived with it or earlier; within one micro-batch the order of
    arrival does not matter. The state of an account
    that is silent for ``idle_days`` is removed.
    """
    own = [f for f in log.schema.fields if f.name not in ("attempted_at",)]
    marked = log.withColumns({"us": F.unix_micros(F.col("attempted_at").cast("timestamp")), "complaint": F.coalesce(F.col("outcome") == "COMPLAINT", F.lit(False))}).drop("attempted_at")
    longs = [StructField(c, LongType()) for c in ("us",)] + [StructField("complaint", BooleanType())] + [StructField(c, LongType()) for c in (*_COUNTS, "last_complaint")]
    counted = marked.select(*[f.name for f in own], "us", "complaint").groupBy("account_id").applyInPandasWithState(
        recent_attempts(rules.utc_offset_minutes, idle_days), StructType([*own, *longs]), _STATE, "Append", GroupStateTimeout.ProcessingTimeTimeout
    )
    local = lambda c: F.timestamp_micros(c).cast(TimestampNTZType())
    counted = counted.withColumns({"attempted_at": local("us"), "last_complaint": F.when(F.col("last_complaint") >= 0, local("last_complaint"))}).drop("us", "complaint")
    return compliance.judged(counted, rules, holidays)


def run_guard(checked: DataFrame, target: str, checkpoint: str) -> None:
    """Write what has arrived into a Parquet table and stop: state timeouts alone start no further micro-batches, which would never end."""
    spark, name = checked.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        writer = checked.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.start(target).awaitTermination()
    finally:
        spark.conf.set(name, before)
