"""Judging in batches that can be taken up again: verdicts are kept by pair, failures are counted, and a second run judges only what is open."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import judge
from corvane.sources.snapshots import SnapshotTable
from corvane.sources.store import stored

#: A judge takes a claim and a passage and gives (supported, rationale); it may raise, or give None, where it has no verdict.
Judge = Callable[[str, str], tuple[bool, str] | None]
#: Pairs that one task judges, about: what is lost with an executor is one task's pairs at most.
PAIRS_PER_TASK = 200
PAIR = ("query_id", "claim", "chunk_id")
VERDICTS = "query_id string, claim string, chunk_id string, supported boolean, rationale string"


def run_judge(pairs: DataFrame, verdict: Judge) -> DataFrame:
    """``pairs`` (query_id, claim, chunk_id, text) with supported, rationale and error: the reason where a pair has no verdict. A failing pair fails no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    got = verdict(r.claim, r.text)
                    out.append((r.query_id, r.claim, r.chunk_id, *((bool(got[0]), got[1] or "", None) if got is not None else (None, None, "no verdict"))))
                except Exception as e:  # the judge is a service: whatever it raises is that pair's failure
                    out.append((r.query_id, r.claim, r.chunk_id, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[*PAIR, "supported", "rationale", "error"])

    rows = pairs.select(*[F.col(c).cast("string").alias(c) for c in (*PAIR, "text")])
    return rows.mapInPandas(run, f"{VERDICTS}, error string")


class JudgeRun:
    """A table of verdicts, one a pair, that runs add to."""

    def __init__(self, table: SnapshotTable) -> None:
        self.table = table

    def verdicts(self) -> DataFrame:
        return self.table.read(schema=VERDICTS)

    def open_pairs(self, citations: DataFrame, passages: DataFrame) -> DataFrame:
        """The pairs of cited claims and passages, each once, that have no verdict yet; ``supported`` is false where a cited passage was not retrieved. A citation without a claim or an identifier is none."""
        fanned = judge.fan_out(citations, passages).select(*[F.col(c).cast("string").alias(c) for c in PAIR], "text", "supported", "rationale")
        each = fanned.where(" and ".join(f"{c} is not null" for c in PAIR)).groupBy(*PAIR).agg(F.first("text").alias("text"), F.first("supported").alias("supported"), F.first("rationale").alias("rationale"))
        return each.join(self.verdicts().select(*PAIR), list(PAIR), "left_anti")

    def run(self, citations: DataFrame, passages: DataFrame, verdict: Judge) -> dict[str, int]:
        """Judges what is open and adds the verdicts in one commit. Returns how many pairs were open, judged, unretrieved (unsupported without being judged) and failed.

        Failed pairs stay open, so that the next run tries them again; pairs with a verdict are never judged twice.
        """
        version = self.table.snapshot().version
        rows = stored(self.open_pairs(citations, passages), "openpairs")
        lost, asked = rows.where("supported is not null"), rows.where("supported is null")
        n, gone = rows.count(), lost.count()
        parts = max(1, (n - gone) // PAIRS_PER_TASK)
        got = stored(run_judge(asked.repartition(parts), verdict), "verdicts")  # so no pair is sent to the judge again when the table is written
        good = got.where("error is null")
        columns = [c.split()[0] for c in VERDICTS.split(", ")]
        done = self.table.commit(lost.select(*columns).unionByName(good.select(*columns)), base=version) if n else 0
        return {"open": n, "judged": done - gone, "unretrieved": gone, "failed": n - done}


def accuracy_by_query(verdicts: DataFrame) -> DataFrame:
    """query_id, supported, total, citation_accuracy."""
    out = verdicts.groupBy("query_id").agg(F.count_if("supported").alias("supported"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("citation_accuracy", F.col("supported") / F.col("total"))
