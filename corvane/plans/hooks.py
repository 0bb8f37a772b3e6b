"""Hooks of a run's stages: counts that are taken while a stage runs, job descriptions, and injected persist and alert functions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.sources.store import stored

Metrics = dict[str, object]
Persist = Callable[[str, Metrics], None]
Alert = Callable[[str], None]


@dataclass
class Trace:
    """A stage that ran: its metrics and seconds, or its error."""

    stage: str
    metrics: Metrics = field(default_factory=dict)
    seconds: float = 0.0
    error: str | None = None


class Stages:
    """Runs stages one after the other. A stage's metrics come from the job that writes it: nothing is computed again to count it.

    ``persist`` gets each stage's name and metrics, ``alert`` the text of each rule that holds. Hooks are at the run's edge: one that fails is noted in ``failures`` and
    fails nothing. A stage that fails leaves its trace and raises.
    """

    def __init__(self, spark: SparkSession, persist: Persist | None = None, alert: Alert | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.persist, self.alert, self.clock = spark, persist, alert, clock
        self.traces: list[Trace] = []
        self.failures: list[str] = []

    def _call(self, hook: Callable[..., None] | None, *args: object) -> None:
        if hook:
            try:
                hook(*args)
            except Exception as e:  # whatever a hook does must not end the run
                self.failures.append(f"{type(e).__name__}: {e}")

    def run(self, stage: str, rows: DataFrame, metrics: dict[str, Column] | None = None, rules: dict[str, Callable[[Metrics], bool]] | None = None) -> DataFrame:
        """``rows``, written and read again. ``metrics`` are aggregates over them, besides ``rows``, their number; ``rules`` are alerts' texts and when they hold."""
        trace, seen = Trace(stage), Observation(f"{stage} {len(self.traces)}")
        self.traces.append(trace)
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (metrics or {}).items()])
        context, began = self.spark.sparkContext, self.clock()
        before = context.getLocalProperty("spark.job.description")
        context.setJobDescription(f"stage: {stage}")
        try:
            out = stored(counted, "stage")
        except Exception as e:
            trace.error = f"{type(e).__name__}: {e}"
            raise
        finally:
            trace.seconds = self.clock() - began
            context.setLocalProperty("spark.job.description", before)
        trace.metrics = dict(seen.get)
        self._call(self.persist, stage, trace.metrics)
        for text, holds in (rules or {}).items():
            if holds(trace.metrics):
                self._call(self.alert, text)
        return out
