"""Declining streaks of daily scores, and daily error rates, over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.analytics import daily_error_rate

OUT = "metric string, day date, latest double, streak long, regressing boolean"
#: What is kept for each metric: days that are still open with their scores (days as seconds), and the last closed score and its streak.
STATE = "days array<long>, scores array<double>, latest double, streak long"


def streaks(daily: DataFrame, ts: str = "ts", late: str = "2 days", eps: float = 0.0, alert: int = 3) -> DataFrame:
    """metric, day, latest, streak, regressing of every closed day of a stream of (metric, ``ts``: a timestamp of the day, score).

    A day is closed when the watermark, ``late`` behind the newest row of all metrics, has passed it; until then rows may come in any order, and a day's later row replaces its earlier one. A
    timer closes the days of a metric that has no new rows. What comes for a closed day is left out. Days without a score are passed over. The last row of a metric is
    that of ``monitoring.streaks`` over its closed days.
    """

    def close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, scores, latest, streak = state.get if state.exists else ([], [], None, 0)
        held = dict(zip(days or [], scores or [], strict=True))
        passed = state.getCurrentWatermarkMs() / 1000
        for b in batches:
            for at, score in zip(b["at"].tolist(), b["score"].tolist(), strict=True):
                if score == score and at is not None:  # a null score comes as not a number
                    held[int(at)] = float(score)
        out = []
        for at in sorted(d for d in held if d < passed):
            score = held.pop(at)
            streak = streak + 1 if latest is not None and score < latest - eps else 0
            latest = score
            out.append((key[0], pd.Timestamp(at, unit="s").date(), latest, streak, streak >= alert))
        state.update((sorted(held), [held[d] for d in sorted(held)], latest, streak))
        if held:
            state.setTimeoutTimestamp(max(1000 * min(held) + 1, int(1000 * passed) + 1))
        if out:
            yield pd.DataFrame(out, columns=["metric", "day", "latest", "streak", "regressing"])

    rows = daily.withWatermark(ts, late).select("metric", ts, F.unix_timestamp(F.date_trunc("day", ts)).alias("at"), F.col("score").cast("double").alias("score"))
    return rows.groupBy("metric").applyInPandasWithState(close, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest(closed: DataFrame) -> DataFrame:
    """The last closed day of each metric."""
    return closed.groupBy("metric").agg(F.max_by(F.struct("day", "latest", "streak", "regressing"), "day").alias("x")).select("metric", "x.streak", "x.latest", "x.day", "x.regressing")


def error_rates(log: DataFrame, ts: str = "ts", is_error: str = "is_error", late: str = "1 day") -> DataFrame:
    """day, requests, errors, error_rate of each day; a stream gives a day when the watermark has passed its end."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    out = daily_error_rate(rows.withColumn("w", F.window(ts, "1 day")), "w", is_error)
    return out.select(F.to_date("w.start").alias("day"), "requests", "errors", "error_rate")


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what a stream gives to Parquet, each row once; a restart goes on from ``checkpoint``."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
