from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact_dedup
from corvane.llm.exact_dedup import content_sort
from tests.llm.conftest import awkward_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check(rows: list[tuple], out: DataFrame, keep: str) -> None:
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out.collect()]
    want, kept = [], {}
    for norm, ids in groups.items():
        some = [i for i in ids if i is not None]
        best = (max(some) if keep == "largest" else min(some)) if some else None
        sha = hashlib.sha256(norm.encode()).hexdigest()
        want += [(i, best, len(ids), sha) for i in ids]
        kept[sha] = best
    assert sorted(((a, b, c, e) for a, b, c, _, e in got), key=str) == sorted(want, key=str)
    assert sorted(((e, a) for a, _, _, d, e in got if d), key=str) == sorted(kept.items(), key=str)  # one a group


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_awkward_rows(awkward: DataFrame, keep: str) -> None:
    check([r[:2] for r in awkward_rows()], content_sort(awkward, keep=keep), keep)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_a_hot_text_is_cut_and_joined(spark: SparkSession, keep: str, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = [(i, "Hot text" if i % 2 else f"text {i % 50}") for i in range(400)] + [(None, "hot text"), (399, "HOT text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_dedup._hot_texts(df.selectExpr("sha2(lower(text), 256) as _sha"), 4)
    check(rows, content_sort(df, keep=keep), keep)


def test_other_columns_pass_and_clashing_ones_are_replaced(awkward: DataFrame, nothing: DataFrame) -> None:
    out = content_sort(awkward)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "id", "key", "keep_id", "group_size", "kept", "text_sha256"]
    assert out.where("source = 'src0'").count() == len(awkward_rows())
    assert content_sort(nothing).collect() == []
    with pytest.raises(ValueError, match="keep"):
        content_sort(awkward, keep="any")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_string_identifiers_of_a_hot_text(spark: SparkSession, keep: str) -> None:
    rows = [(f"id{i}", "Hot text" if i % 2 else f"text {i % 50}") for i in range(400)]
    check(rows, content_sort(spark.createDataFrame(rows, "doc_id string, text string"), keep=keep), keep)
