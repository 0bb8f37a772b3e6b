"""Token counts by byte-pair merges, worked out once for each distinct word."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.store import stored

def ranks_of(path: str) -> dict[bytes, int]:
    """The merge ranks of a vocabulary file on the driver: a line for each token, base64 and rank."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if x}


def merged_length(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens ``word`` has: neighbouring parts of the lowest rank are merged, leftmost first, until none is in the vocabulary.

    Parts are a linked list, and possible merges a heap, so time grows with n log n.
    """
    if word in ranks:
        return 1
    n = len(word)
    end, ahead, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapify(heap)
    parts = n

    def offer(i: int) -> None:
        j = ahead[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heappush(heap, (rank, i, end[i], end[j]))

    while heap:
        _, i, middle, stop = heappop(heap)
        if not alive[i] or end[i] != middle or middle >= n or not alive[middle] or end[middle] != stop:
            continue  # one of the two was merged since
        alive[middle] = False
        end[i], ahead[i] = stop, ahead[middle]
        if ahead[i] < n:
            before[ahead[i]] = i
        parts -= 1
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return parts


def java_pattern(pattern: str) -> str:
    """A tokenizer's splitting pattern for Spark: letters, digits and white space are those of every script."""
    return f"(?U){pattern}"


def words_of(text: Column, pattern: str) -> Column:
    """The words that merges stay within: what ``pattern`` finds."""
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def token_counts(rows: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", name: str = "token_count") -> DataFrame:
    """``rows`` with ``name``: the number of tokens of each text (0 for null and empty ones). A column of that name is replaced; repeated rows each get their number.

    Texts are split by ``pattern`` in Spark; each distinct word of all texts is merged once, and the numbers come back by a join. ``ranks``, a vocabulary of fixed size, goes
    to every task as one broadcast variable.
    """
    sent = rows.sparkSession.sparkContext.broadcast(ranks)
    marked = stored(rows.drop(name).withColumn("_row", F.monotonically_increasing_id()), "subwordrows")
    words = marked.select("_row", F.explode(words_of(F.col(text), pattern)).alias("_w"))
    words = stored(words.groupBy("_row", "_w").agg(F.count(F.lit(1)).alias("_n")), "subwords")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_w": b["_w"], "_tokens": [merged_length(w.encode("utf-8", "surrogatepass"), sent.value) for w in b["_w"]]})

    known = words.select("_w").distinct().mapInPandas(measure, "_w string, _tokens long")
    sums = words.join(known, "_w").groupBy("_row").agg(F.sum(F.col("_n") * F.col("_tokens")).alias(name))
    return marked.join(sums, "_row", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long"))).drop("_row")
