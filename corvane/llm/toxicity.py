"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import shared_dir, stored
from corvane.llm.wordhash import chunks, words

#: Labelled rows (about) that the model is fitted on; more are thinned by a digest of their identifier.
MAX_LABELLED = 12_000
#: Features that the model weighs, chosen by association with the grades.
MAX_FEATURES = 4096
#: Digests of words fall into 2**FEATURE_BITS features.
FEATURE_BITS = 22
#: First bytes of a word that are features besides the word.
STEM_BYTES = (4, 5, 6, 7)


@dataclass
class OrdinalModel:
    """P(grade <= k | x) = sigmoid(thresholds[k] - weights . x), one weight vector for all thresholds."""

    features: np.ndarray  # ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def above(self, strength: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - strength[:, None], -500, 500)))

    def expected(self, strength: np.ndarray) -> np.ndarray:
        """The expected grade: the sum of P(grade > k)."""
        return self.above(strength).sum(axis=1)


def sparse_features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and log(1 + count) of every feature of every text, by row, then feature.

    Features are words (runs of characters other than white space and ASCII punctuation, A-Z lower-cased) and the first bytes of longer words, which stand for a
    stem, by digest. ``wanted`` (a flag for each possible feature) leaves others out before anything is counted.
    """
    rows, feats, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for a, b in chunks(texts):
        digest, owner, firsts = words(texts[a:b], punctuation=True, prefixes=STEM_BYTES)
        feature = np.concatenate([digest, *[d for d, _ in firsts]]) >> np.uint64(64 - FEATURE_BITS)
        feature, owner = feature.astype(np.int64), np.concatenate([owner, *[o for _, o in firsts]]).astype(np.int64)
        if wanted is not None:
            keep = wanted[feature]
            feature, owner = feature[keep], owner[keep]
        pair, count = np.unique((owner << FEATURE_BITS) | feature, return_counts=True)
        rows.append(a + (pair >> FEATURE_BITS))
        feats.append(pair & ((1 << FEATURE_BITS) - 1))
        values.append(np.log1p(count))
    return np.concatenate(rows), np.concatenate(feats), np.concatenate(values)


def severity(toxic: Column, quality: Column) -> Column:
    """Ordered grades from two labels: 0 not toxic, 1 toxic in a text of good (or unknown) quality, 2 toxic in a poor one; null where toxic is."""
    return F.when((toxic == 1) & (quality == 0), 2).when(toxic == 1, 1).when(toxic == 0, 0)


def _labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade: Column) -> DataFrame:
    """grade, features, amounts of each labelled document in the bounded sample, one row for each identifier (the least text where rows share it)."""
    known = labels.select(id_col, grade.cast("int").alias("grade")).where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("grade").alias("grade"))
    share = min(1.0, MAX_LABELLED / max(1, labels.count()))
    few = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(few), id_col).groupBy(id_col).agg(F.min("text").alias("text"), F.max("grade").alias("grade"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, feats, values = sparse_features(batch["text"].tolist())
            cut = np.searchsorted(rows, np.arange(1, len(batch)))
            yield pd.DataFrame({"grade": batch["grade"].array, "features": np.split(feats, cut), "amounts": np.split(values, cut)})

    return stored(texts.select("grade", "text").mapInPandas(run, "grade int, features array<long>, amounts array<double>"), "toxfeatures")


def _associated(rows: DataFrame, most: int) -> pd.DataFrame:
    """The ``most`` features whose presence depends most on grade > 0: feature, low and high document counts, z."""
    sizes = rows.groupBy((F.col("grade") > 0).alias("up")).count().collect()
    n = {r["up"]: r["count"] for r in sizes}
    n0, n1 = n.get(False, 0), n.get(True, 0)
    if not n0 or not n1:
        return pd.DataFrame({"feature": pd.Series(dtype="int64"), "low": [], "high": [], "z": []})
    seen = rows.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count_if(F.col("grade") == 0).alias("low"), F.count_if(F.col("grade") > 0).alias("high")
    )
    odds = F.log((F.col("high") + 0.5) / (n1 - F.col("high") + 0.5)) - F.log((F.col("low") + 0.5) / (n0 - F.col("low") + 0.5))
    spread = F.sqrt(1 / (F.col("high") + 0.5) + 1 / (F.col("low") + 0.5) + 1 / (n1 - F.col("high") + 0.5) + 1 / (n0 - F.col("low") + 0.5))
    ranked = seen.where(F.col("low") + F.col("high") >= 4).withColumn("z", odds / spread).where(F.abs("z") >= 2.5)
    return ranked.orderBy(F.desc(F.abs("z")), "feature").limit(most).toPandas()


def fit(rows: pd.DataFrame, features: np.ndarray, grades: int, rounds: int = 400, ridge: float = 0.01) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty by full-batch gradient steps (Adam) on the bounded sample.

    ``rows`` has grade, features (places in ``features``) and amounts. Thresholds stay ordered: their gaps are exponentials.
    """
    y = rows["grade"].to_numpy(dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(f) for f in rows["features"]])
    place = np.concatenate([np.zeros(0, dtype=np.int64), *[np.asarray(f, dtype=np.int64) for f in rows["features"]]])
    amount = np.concatenate([np.zeros(0), *[np.asarray(v, dtype=float) for v in rows["amounts"]]])
    k = grades - 1
    w, t = np.zeros(len(features)), np.concatenate(([1.0], np.zeros(k - 1)))
    moments = [np.zeros(len(w) + k), np.zeros(len(w) + k)]
    for step in range(1, rounds + 1):
        gaps = np.exp(t[1:])
        cuts = t[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        strength = np.bincount(owner, amount * w[place], minlength=len(rows))
        cdf = 1 / (1 + np.exp(-np.clip(cuts[None, :] - strength[:, None], -30, 30)))
        full = np.hstack([np.zeros((len(rows), 1)), cdf, np.ones((len(rows), 1))])
        slope = np.hstack([np.zeros((len(rows), 1)), cdf * (1 - cdf), np.zeros((len(rows), 1))])
        at = np.arange(len(rows))
        prob = np.maximum(full[at, y + 1] - full[at, y], 1e-12)
        by_strength = (slope[at, y + 1] - slope[at, y]) / prob  # of the negative log likelihood
        by_cut = np.zeros(k)
        for j in range(k):
            by_cut[j] = -(slope[:, j + 1] * ((y == j).astype(float) - (y == j + 1)) / prob).sum()
        by_t = np.concatenate(([by_cut.sum()], gaps * np.cumsum(by_cut[::-1])[::-1][1:]))
        grad = np.concatenate([np.bincount(place, amount * by_strength[owner], minlength=len(w)) + ridge * w, by_t]) / max(1, len(rows))
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[: len(w)], t - move[len(w) :]
    return OrdinalModel(features, w, t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:])))))


def train(docs: DataFrame, labels: DataFrame, grade: Column | str, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits the model on at most about ``MAX_LABELLED`` labelled documents.

    ``grade`` is a column of ``labels``, or an expression over them, that gives ordered grades 0, 1, ..; grades come from labels alone, never from a text. Repeated labels
    of a document count once, by the largest, and rows that share an identifier are one document; null grades and labels without a document are left out. Without
    labels of grade 0 and of a higher one every expected severity is 0.
    """
    shared_dir(docs.sparkSession)
    rows = _labelled_features(docs, labels, id_col, text_col, F.col(grade) if isinstance(grade, str) else grade)
    found = _associated(rows, MAX_FEATURES)
    if found.empty:
        return OrdinalModel(np.zeros(0, dtype=np.int64), np.zeros(0), np.full(1, 500.0))
    grades = rows.agg(F.max("grade")).first()[0] + 1
    features = np.sort(found["feature"].to_numpy(dtype=np.int64))

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, f, v in zip(batch["grade"], batch["features"], batch["amounts"], strict=True):
                at = np.minimum(np.searchsorted(features, f), len(features) - 1)
                keep = features[at] == f
                out.append((g, at[keep], np.asarray(v)[keep]))
            yield pd.DataFrame(out, columns=["grade", "features", "amounts"])

    few = rows.mapInPandas(narrow, "grade int, features array<long>, amounts array<double>").toPandas()  # bounded by MAX_LABELLED
    return fit(few, features, grades)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, expected_severity, severity_grade (the median one) and toxic (some grade above 0 is likelier than none).

    One row for each row, from whole texts, in the tasks that scan them. A null or empty text has no features. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.zeros(1 << FEATURE_BITS, dtype=bool)
        wanted[model.features] = True
        for batch in batches:
            rows, feats, values = sparse_features(batch["text"].tolist(), wanted)
            strength = np.zeros(len(batch))
            if len(model.features):
                strength = np.bincount(rows, values * model.weights[np.searchsorted(model.features, feats)], minlength=len(batch))
            above = model.above(strength)
            yield pd.DataFrame({
                "id": batch["id"].array, "expected_severity": above.sum(axis=1), "severity_grade": (above >= 0.5).sum(axis=1).astype(np.int32), "toxic": above[:, 0] >= 0.5,
            })

    kind = docs.schema[id_col].dataType
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, "id string, expected_severity double, severity_grade int, toxic boolean"
    )
    return found.select(F.col("id").cast(kind).alias(id_col), "expected_severity", "severity_grade", "toxic")


def cross_validated(docs: DataFrame, labels: DataFrame, grade: Column | str, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """grade, predicted, n: labelled documents by their grade and the median grade of a model that was fitted without them.

    Labels are dealt into ``folds`` parts by a digest of their identifier; each part is scored by a model of the others. Repeated labels count once, by the largest; labels
    without a document, and rows without an identifier, are left out; of rows that share an identifier each is counted. Without labels there is no row.
    """
    own = F.col(grade) if isinstance(grade, str) else grade
    known = labels.select(F.col(id_col), own.cast("int").alias("grade")).where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("grade").alias("grade"))
    known = stored(known.withColumn("fold", F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(folds)).cast("int")), "toxfolds")
    found = None
    for i in range(folds):
        model = train(docs, known.where(F.col("fold") != i), "grade", id_col, text_col)
        held = known.where(F.col("fold") == i).select(id_col, "grade")
        scored = score(docs.select(id_col, text_col).join(held.select(id_col), id_col), model, id_col, text_col).join(held, id_col).select("grade", F.col("severity_grade").alias("predicted"))
        found = scored if found is None else found.unionByName(scored)
    return found.groupBy("grade", "predicted").agg(F.count(F.lit(1)).alias("n"))
