from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from corpus_pipeline import packing_stage
from corvane.llm.packing import CachedEncoder, Capacities, added_tokens, best_fit_decreasing, pack
from corvane.llm.queries import op7_packing
from tests.llm.conftest import awkward_rows, prose

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ENCODER = CachedEncoder(RANKS, PATTERN)
REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
REFERENCE.encode_special_tokens = True
JSON = public_tokenizers.path("byte_bpe_50k.json")
WITH_ADDED = CachedEncoder(RANKS, PATTERN, added_tokens(JSON))
AS_GIVEN = Tokenizer.from_file(JSON)  # no switch set: strings of added tokens are one token


def one_by_one(items: list[int], capacity: int) -> list[int]:
    """Remaining capacities after best-fit decreasing, one item after another."""
    bins: list[int] = []
    for need in sorted(items, reverse=True):
        fits = [i for i, c in enumerate(bins) if c >= need]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= need
        else:
            bins.append(capacity - need)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_runs_are_best_fit_decreasing(case: tuple[int, list[int]]) -> None:
    capacity, items = case
    runs, bins = best_fit_decreasing(Counter(items), capacity)
    fill = defaultdict(list)
    for length, n in Counter(items).items():
        own = [r for r in runs if r[0] == length]
        for k in range(n):
            r = [x for x in own if x[1] <= k][-1]
            fill[r[2] + (k - r[1]) // r[3]].append((r[4] + (k - r[1]) % r[3] * length, length))
    assert sorted(fill) == list(range(bins))
    for rows in fill.values():
        end = 0
        for at, length in sorted(rows):
            assert at == end
            end += length
        assert end <= capacity
    assert sorted(capacity - sum(x for _, x in rows) for rows in fill.values()) == one_by_one(items, capacity)


def test_segment_tree() -> None:
    tree, held, r = Capacities(100), set(), random.Random(2)
    for _ in range(2000):
        c = r.randrange(101)
        (held.add if r.random() < 0.3 else held.discard)(c)
        tree.set(c, c in held)
        need = r.randrange(101)
        assert tree.tightest(need) == min((x for x in held if x >= need), default=None)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z'sé\n\t 1!<|>　\x85ß𝄞")), max_size=60))
def test_cached_words_give_the_tokenizers_ids(text: str) -> None:
    assert np.frombuffer(ENCODER.encode(text), dtype="<u4").tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "<", "|>", " ", "  ", "\n", "a", "b c", "é", "'s", "1"]), max_size=12))
def test_added_tokens_are_one_id(parts: list[str]) -> None:
    text = "".join(parts)
    assert np.frombuffer(WITH_ADDED.encode(text), dtype="<u4").tolist() == AS_GIVEN.encode(text, add_special_tokens=False).ids


def test_query_packs_added_tokens(spark: SparkSession, tmp_path: Path) -> None:
    texts = ["a <|endoftext|> b", "<|endoftext|>", "no <|endoftext| > here", "x  <|endoftext|><|endoftext|>\n"]
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (op7_packing(spark, str(tmp_path)).collect(), packing_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()):
        got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows}
        ids = [[*AS_GIVEN.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert got == {i: (len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in enumerate(ids)}


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack_awkward_rows(awkward: DataFrame, capacity: int) -> None:
    got = [r.asDict() for r in pack(awkward, RANKS, PATTERN, capacity).collect()]
    want = []
    for i, t, *_ in awkward_rows():
        ids = [*REFERENCE.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want += [(i, j, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for j, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in fill.values():
        end = 0
        for at, length in sorted(rows):
            assert at == end
            end += length
        assert end <= capacity
    assert len(fill) == len(one_by_one([x[3] for x in want], capacity))


def test_empty_and_a_frequent_length(nothing: DataFrame, spark: SparkSession) -> None:
    assert pack(nothing, RANKS, PATTERN).collect() == []
    df = spark.createDataFrame([(i, prose(1, 3)) for i in range(500)], "doc_id long, text string")
    rows = pack(df, RANKS, PATTERN, 64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 500
    size = rows[0]["length"]
    assert len({r["sequence_id"] for r in rows}) == -(-500 // (64 // size))
