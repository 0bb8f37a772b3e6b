"""Documents with every awkward case."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, h string, id string, key string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "zzzz", 1)
    texts = [
        (1, base), (2, base.upper()), (3, near), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "One"), (9, "two words"), (10, prose(2, 6000)), (10, prose(3, 80)),
        (11, prose(4, 90)), (11, prose(4, 90)), (None, base), (None, "no identifier here"), (12, "naïve café ÀÉ\n\nnaïve café ÀÉ"), (13, "a  b \n c\x0bd\r\ne"), (-5, near),
    ]
    return [(i, t, None, "src0", None, "x", None, "y", "z") for i, t in texts]


@pytest.fixture
def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture
def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
