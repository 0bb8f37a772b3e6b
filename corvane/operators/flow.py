"""Retrieval and evaluation steps that pass a state on; a step that fails leaves its error and the later ones are skipped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import fusion, judge
from corvane.sources.store import stored

Retriever = Callable[[], DataFrame]


@dataclass(frozen=True)
class State:
    """What the steps have found so far, for all queries at once."""

    fused: DataFrame | None = None
    reranked: DataFrame | None = None
    citations: DataFrame | None = None
    judgments: DataFrame | None = None
    accuracy: DataFrame | None = None
    error: str | None = None


def step(state: State, run: Callable[[State], State]) -> State:
    """``run(state)``; a state with an error passes unchanged, and an exception becomes a state with the error alone."""
    if state.error:
        return state
    try:
        return run(state)
    except Exception as e:  # the boundary of a step: whatever fails in it discards what it had
        return State(error=f"{type(e).__name__}: {e}")


def retrieve(sparse: Retriever, dense: Retriever | None, top_k: int = 10, k: int = fusion.RRF_K) -> State:
    """Fuses the lists of both retrievers; without a dense one the sparse list alone. The result is stored, so that a failure shows here."""

    def run(_: State) -> State:
        lists = [sparse(), *([dense()] if dense else [])]
        return State(fused=stored(fusion.rrf(lists, top_k, k), "fused"))

    return step(State(), run)


def rerank_with(state: State, rerank: Callable[[DataFrame], DataFrame]) -> State:
    """Adds what ``rerank`` makes of the fused rows."""
    return step(state, lambda s: replace(s, reranked=stored(rerank(s.fused), "reranked")))


def generate_with(state: State, generate: Callable[[DataFrame], DataFrame], top_k: int = 5) -> State:
    """Adds the citations (query_id, claim, chunk_ids) that ``generate`` gives for the first ``top_k`` results."""

    def run(s: State) -> State:
        passages = fusion.results(s.fused, s.reranked if s.reranked is not None else s.fused.limit(0), top_k)
        return replace(s, citations=stored(generate(passages), "citations"))

    return step(state, run)


def evaluate(state: State, passages: DataFrame, verdict: Column) -> State:
    """Adds the judgments of the citations against ``passages`` (query_id, chunk_id, text), and their accuracy."""

    def run(s: State) -> State:
        found = stored(judge.judged(judge.fan_out(s.citations, passages), verdict), "judgments")
        return replace(s, judgments=found, accuracy=judge.accuracy(found))

    return step(state, run)


def orchestrate(
    sparse: Retriever, dense: Retriever | None, rerank: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame], texts: DataFrame, verdict: Column,
    pool: int = 100, top_k: int = 10,
) -> State:
    """One run of all steps, for all queries at once: retrieve, re-rank, generate, evaluate. A step that fails leaves its error, and those after it are skipped.

    ``texts`` (doc_id, text) are the documents; answers are made from, and judged against, the first ``top_k`` re-ranked results; ``verdict`` sees query_id, claim, chunk_id and text.
    """
    state = rerank_with(retrieve(sparse, dense, pool), lambda rows: rerank(rows).where(F.col("rank") <= top_k))
    state = generate_with(state, generate, top_k)
    if state.error:
        return state
    passages = fusion.results(state.fused, state.reranked, top_k).join(texts, "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), "text")
    return evaluate(state, passages, verdict)


def hand_off(state: State) -> dict[str, object]:
    """What a retrieving party passes to an answering one: the ranked rows (re-ranked, if there are any) or the error."""
    return {"error": state.error} if state.error else {"ranked": state.reranked if state.reranked is not None else state.fused, "error": None}


def take_over(package: dict[str, object], state: State | None = None) -> State:
    """The answering party's state with what was handed over; an error goes on as the error."""
    if package["error"]:
        return State(error=str(package["error"]))
    return replace(state or State(), reranked=package["ranked"])


def first_queries(queries: DataFrame, n: int, query_id: str = "query_id") -> DataFrame:
    """The first n queries in the order of their identifiers, with name: bq01, bq02, .."""
    first = queries.orderBy(query_id).limit(n).agg(F.array_sort(F.collect_list(F.struct(query_id, "query"))).alias("q"))  # n rows
    rows = first.select(F.posexplode("q").alias("i", "x"))
    return rows.select(F.format_string("bq%02d", F.col("i") + 1).alias("name"), f"x.{query_id}", "x.query")
