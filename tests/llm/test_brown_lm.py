from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import brown_lm
from corvane.llm.brown_lm import BrownParams, score
from corvane.llm.wordhash import words
from tests.llm.conftest import awkward_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def brute(rows: list[tuple]) -> list[tuple]:
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(x for w, h in zip(tokens, held, strict=True) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return sorted(
        ((i, h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, _), w, h in zip(rows, tokens, held, strict=True)), key=str
    )


@pytest.mark.parametrize("size", [10**9, 500])
def test_base_against_brute_force(awkward: DataFrame, size: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(brown_lm, "CHUNK_CHARS", size)
    got = score(awkward, held_out(), params=BrownParams(classes=6, min_count=2)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([r[:2] for r in awkward_rows()])


def test_empty(nothing: DataFrame) -> None:
    assert score(nothing, held_out()).collect() == []


def sentences(seed: int, n: int) -> list[tuple[int, str]]:
    """Words of three kinds in a fixed order of kinds."""
    r = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abc"]
    return [(seed * 1000 + i, " ".join(r.choice(kinds[j % 3]) for j in range(r.randint(10, 40)))) for i in range(n)]


def test_classes_help_on_held_out_texts(spark: SparkSession) -> None:
    df = spark.createDataFrame(sentences(1, 400), "doc_id long, text string")
    p = BrownParams(classes=8, min_count=3, sweeps=6)
    rows = score(df, held_out(), params=p).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    gain = (rows["s"] - rows["b"]) / rows["n"]
    assert gain > 0.15  # knowing the kind of the next word is worth up to log10(3) less what the mixture costs
    none = score(df, held_out(), params=BrownParams(classes=8, min_count=3, sweeps=0)).where("held_out").agg(F.sum("score")).first()[0]
    assert rows["s"] > none


def test_registered_settings_cluster_and_never_lose_likelihood(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = sentences(3, 500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = brown_lm._clustered
    kept = lambda packed, lexicon, p: seen.append(real(packed, lexicon, p)) or seen[-1]
    monkeypatch.setattr(brown_lm, "_clustered", kept)
    got = {r["doc_id"]: r for r in score(df, held_out()).collect()}
    lexicon, moves = seen[0]
    first = score(df, held_out(), params=BrownParams(sweeps=0)).where("held_out").agg(F.sum("score")).first()[0]
    assert brown_lm.class_likelihood(moves) > brown_lm.class_likelihood(seen[1][1])
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > first
    assert sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) > 0.15
    # the scores again, from classes and counts, token by token
    p, c = BrownParams(), Counter()
    cls, digest = {}, {}
    for r in lexicon.collect():
        cls |= dict(zip(np.frombuffer(r["h"], dtype=np.uint64).tolist(), np.frombuffer(r["cls"], dtype=np.uint8).tolist(), strict=True))
    for i, t in rows:
        digest |= dict(zip(t.split(), words([t])[0].tolist(), strict=True))
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*t.split(), None])
    kind = lambda w: brown_lm.END_CLASS if w is None else cls[digest[w]]
    mass, pair, rare = Counter(), Counter(), sum(kind(w) == brown_lm.RARE_CLASS for w in c)
    for w, k in c.items():
        mass[kind(w)] += k
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            chain = [None, *t.split(), None]
            pair.update((kind(a), kind(b)) for a, b in zip(chain, chain[1:], strict=False))
    out = Counter()
    for (a, _), k in pair.items():
        out[a] += k
    total, distinct = sum(c.values()), len(c)
    for i, t in rows[:60]:
        want, chain = 0.0, [None, *t.split(), None]
        for a, b in zip(chain, chain[1:], strict=False):
            x = kind(b)
            emit = (c[b] + (x == brown_lm.RARE_CLASS)) / (mass[x] + (rare + 1 if x == brown_lm.RARE_CLASS else 0))
            ahead = (pair[kind(a), x] + p.alpha) / (out[kind(a)] + p.classes * p.alpha)
            want += math.log10(p.class_share * ahead * emit + (1 - p.class_share) * (c[b] + 1) / (total + distinct + 1))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6)


def test_the_model_is_a_distribution(spark: SparkSession) -> None:
    """One-word texts: the probabilities of every known word and of an unknown one add up to 1, after the end's share."""
    train = [(i, t) for i, t in sentences(2, 60)]
    known = sorted({w for _, t in train for w in t.split()})
    asked = [(10**6 + i, w) for i, w in enumerate([*known, "unknown"])] + [(10**6 - 1, "")]
    df = spark.createDataFrame(train + asked, "doc_id long, text string")
    held = F.col("doc_id") >= 10**6 - 1
    p = BrownParams(classes=6, min_count=5)
    got = {r["doc_id"]: r for r in score(df, held, params=p).where(held).collect()}
    # a text's first token follows the end class; divide the end that follows the word out again
    for key in ("score", "base_score"):
        total = 10 ** got[10**6 - 1][key]
        if key == "base_score":
            total += sum(10 ** (got[i][key] - got[10**6 - 1][key]) for i, _ in asked[:-1])
            assert total == pytest.approx(1, abs=1e-9)


def test_scores_follow_the_texts_and_no_setting(spark: SparkSession) -> None:
    df = spark.createDataFrame(sentences(6, 300), "doc_id long, text string")
    was, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for width, parts in (("3", 2), ("16", 7)):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            got.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in score(df.repartition(parts), held_out(), params=BrownParams(min_count=4)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0].keys() == got[1].keys() and all(got[0][i] == pytest.approx(got[1][i], abs=1e-9) for i in got[0])
    with pytest.raises(ValueError, match="classes"):
        score(df, held_out(), params=BrownParams(classes=129))
