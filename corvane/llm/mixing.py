"""Mixing documents to domain target weights by soft membership (DataFrame functions only)."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, ascii_lower, let, shared_dir, stored
from corvane.llm.quality_lines import _count

#: Labelled rows (about) that the classifier is fitted on; more are thinned by a digest of their identifier.
MAX_LABELLED = 10_000
#: Words of the lexicon for each domain.
LEXICON = 48
#: Iterations whose formula is kept as an expression before rates are written out.
KEPT_STEPS = 12
# What parts words here, and the bounds of the shape features' buckets.
MARKS = ".,!?;:"
SPLIT = r"[\x20\x09-\x0D.,!?;:]+"
BUCKETS = {
    "symbols": (0.002, 0.01, 0.03, 0.08),
    "marks": (0.002, 0.01, 0.03),
    "bars": (0.001, 0.02),
    "capitals": (0.02, 0.06, 0.2, 0.5),
    "word_length": (3.0, 4.0, 5.0, 6.0, 8.0),
    "distinct": (0.15, 0.3, 0.5, 0.7),
    "words": (10.0, 50.0, 200.0, 1000.0, 5000.0),
}


def _words(text: Column) -> Column:
    return let(F.btrim(text, F.lit(SPACE + MARKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(ascii_lower(t), SPLIT)))


def _bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    found = F.lit(0)
    for i, b in enumerate(bounds, 1):
        found = F.when(value >= b, F.lit(i)).otherwise(found)
    return found


def _shape(text: Column, distinct: Column, n: Column) -> Column:
    """An array of the bucket numbers of the shape features, in the order of ``BUCKETS``. Each count is taken once."""
    counts = F.struct(
        F.length(text).alias("size"), _count(text, "#*$%&<>").alias("symbols"), _count(text, "!").alias("marks"), _count(text, "|").alias("bars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("capitals"), F.size(distinct).alias("distinct"), n.alias("words"),
    )

    def shares(c: Column) -> Column:
        size, words = F.greatest(c["size"], F.lit(1)), F.greatest(c["words"], F.lit(1))
        value = {k: c[k] / size for k in ("symbols", "marks", "bars", "capitals")}
        value |= {"word_length": size / words, "distinct": c["distinct"] / words, "words": c["words"].cast("double")}
        return F.array(*[value[k] for k in BUCKETS])

    def buckets(v: Column) -> Column:
        return F.array(*[_bucket(F.get(v, F.lit(i)), b) for i, b in enumerate(BUCKETS.values())])

    return let(let(counts, shares), buckets)


@dataclass
class Classifier:
    """Naive Bayes over the presence of lexicon words and the buckets of the shape features."""

    domains: list[str]
    priors: list[float]  # log
    lexicon: list[str]
    word_logs: list[list[float]]  # by domain, of each lexicon word
    shape_logs: list[list[list[float]]]  # by domain and feature, of each bucket

    def posteriors(self, text: Column) -> Column:
        """tokens (long) and p (an array, one probability for each domain) of a text, as a struct.

        The words are split once. Null counts as empty.
        """

        def numbers(values: list[float]) -> Column:
            return F.array(*map(F.lit, values)) if values else F.array().cast("array<double>")

        def adding(logs: Column) -> Callable[[Column, Column], Column]:
            return lambda total, place: total + F.get(logs, place - 1)

        def by_words(w: Column) -> Column:
            def by_distinct(d: Column) -> Column:
                known = F.array(*map(F.lit, self.lexicon)) if self.lexicon else F.array().cast("array<string>")
                at = F.transform(F.array_intersect(d, known), lambda x: F.array_position(known, x).cast("int"))
                state = F.struct(at.alias("at"), _shape(F.coalesce(text, F.lit("")), d, F.size(w)).alias("shape"))

                def scores(x: Column) -> Column:
                    out = []
                    for k, prior in enumerate(self.priors):
                        total = F.aggregate(x["at"], F.lit(float(prior)), adding(numbers(self.word_logs[k])))
                        for f, logs in enumerate(self.shape_logs[k]):
                            total = total + F.get(numbers(logs), F.get(x["shape"], F.lit(f)))
                        out.append(total)
                    return F.array(*out)

                def soft(s: Column) -> Column:
                    raised = let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
                    return let(raised, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda t: F.transform(e, lambda x: x / t)))

                return F.struct(F.size(w).cast("long").alias("tokens"), let(let(state, scores), soft).alias("p"))

            return let(F.array_distinct(w), by_distinct)

        return let(_words(F.coalesce(text, F.lit(""))), by_words)


def train_classifier(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fits the classifier on at most about ``MAX_LABELLED`` rows of the labelled table.

    ``domain`` is an expression over ``labels`` that names a row's domain; rows without one, without an identifier or without a document are
    left out. What comes to the driver is the model: counts of ``LEXICON`` words for each domain and of the buckets.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    share = min(1.0, MAX_LABELLED / max(1, labels.count()))
    few = labels.select(F.col(id_col), domain.alias("domain")).where(F.col("domain").isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share * 1_000_000))
    few = few.groupBy(id_col).agg(F.min("domain").alias("domain"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(few), id_col).select(
        "domain", let(_words(text), lambda w: let(F.array_distinct(w), lambda d: F.struct(d.alias("d"), _shape(text, d, F.size(w)).alias("shape")))).alias("x")
    )
    rows = stored(rows.select("domain", "x.d", *[F.get("x.shape", F.lit(i)).alias(k) for i, k in enumerate(BUCKETS)]), "labelled")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    domains = sorted(sizes) or ["all"]
    total = max(1, sum(sizes.values()))
    # words: those whose share of a domain's documents differs most from the share of the others
    counts = rows.select("domain", F.explode("d").alias("word")).where("word <> ''").groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    lexicon: dict[str, list[int]] = {}
    for i, d in enumerate(domains if len(sizes) > 1 else []):
        rest = sum((F.col(f"n{j}") for j in range(len(domains)) if j != i), F.lit(0))
        mine, others = (F.col(f"n{i}") + 0.5) / (sizes[d] + 1), (rest + 0.5) / (total - sizes[d] + 1)
        gain = F.log(mine / others) * F.sqrt(F.col(f"n{i}"))
        for r in counts.where(F.col(f"n{i}") >= 5).orderBy(F.desc(F.round(gain, 9)), "word").limit(LEXICON).collect():
            lexicon[r["word"]] = [r[f"n{j}"] for j in range(len(domains))]
    words = sorted(lexicon)
    word_logs, shape_logs, priors = [], [], []
    buckets = {d: {k: [0] * (len(b) + 1) for k, b in BUCKETS.items()} for d in domains}
    pairs = rows.select("domain", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("b")) for k in BUCKETS])).alias("f"))
    for r in pairs.groupBy("domain", "f.k", "f.b").count().collect():
        buckets[r["domain"]][r["k"]][r["b"]] = r["count"]
    for j, d in enumerate(domains):
        n = sizes.get(d, 0)
        priors.append(math.log((n + 1) / (total + len(domains))))
        word_logs.append([math.log((lexicon[w][j] + 0.5) / (n + 1)) for w in words])
        shape_logs.append([[math.log((c + 0.5) / (n + 0.5 * len(v))) for c in v] for v in buckets[d].values()])
    return Classifier(domains, priors, words, word_logs, shape_logs)


def rate_of(p: Column, offsets: list[list[float]], max_rate: float | None = None) -> Column:
    """The rate that the steps of ``fit_steps`` give to a document with posteriors ``p``."""

    def step(rate: Column, off: Column) -> Column:
        moved = F.greatest(rate - F.aggregate(F.zip_with(p, off, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
        return moved if max_rate is None else F.least(moved, F.lit(float(max_rate)))

    if not offsets:
        return F.lit(1.0)
    return F.aggregate(F.array(*[F.array(*map(F.lit, o)) for o in offsets]), F.lit(1.0), step)


def fit_steps(
    members: DataFrame, domains: list[str], weights: dict[str, float], total: float | None = None, max_rate: float | None = None, rounds: int = 60, close: float = 1e-3
) -> list[list[float]]:
    """The steps to nonnegative rates whose expected domain token totals match the targets; ``rate_of`` takes them.

    ``members`` has tokens and p (an array in the order of ``domains``). Minimises the sum over domains of (sum of rate * tokens * p - target)^2 / present,
    where present is a domain's total at rate 1, by projected gradient steps from rate 1 in the metric of the documents' tokens: each round sums the totals over all
    documents in one distributed aggregate (as many numbers as domains), and moves every rate against the sum of p times the relative residuals, not below 0 and not above
    ``max_rate``. Ends when every total is within ``close`` of its target or nothing moves. A domain that no document
    belongs to can't be reached and is left out. ``total`` is by default that of the input. Step lengths are Barzilai and Borwein's, from
    the domains' Gram matrix over all documents; the steps end with the round that came closest. If ``rounds`` end before that, a warning names the residuals.
    """
    k = len(domains)
    base, rate = members.select("tokens", "p"), F.lit(1.0)
    sums = [F.sum(F.col("tokens") * F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]
    have = base.agg(*sums, *[F.sum(F.col("tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    gram = [[float(have[f"g{i}_{j}"] or 0.0) for j in range(k)] for i in range(k)]
    product = lambda x, y: sum(x[i] * gram[i][j] * y[j] for i in range(k) for j in range(k))
    present = [float(have[i] or 0.0) for i in range(k)]
    whole = sum(present) if total is None else float(total)
    scale = sum(weights.get(d, 0.0) for d in domains) or 1.0
    target = [whole * weights.get(d, 0.0) / scale for d in domains]
    gap = lambda totals: [(totals[i] - target[i]) / present[i] if present[i] > 0 else 0.0 for i in range(k)]
    loss = lambda totals: sum(present[i] * x * x for i, x in enumerate(gap(totals)))
    offsets: list[list[float]] = []
    now, length, last, best = present, 1.0, None, (loss(present), 0)
    while len(offsets) < rounds and any(abs(now[i] - target[i]) > close * max(target[i], 1.0) for i in range(k) if present[i] > 0):
        off = gap(now)
        if last is not None:
            change = [a - b for a, b in zip(last, off, strict=True)]
            curve = product(last, change)
            length = min(max(length * product(last, last) / curve, 0.5), 50.0) if curve > 0 else 1.0
        last = off
        offsets.append([length * x for x in off])
        rate = F.greatest(rate - sum((F.get("p", F.lit(i)) * x for i, x in enumerate(offsets[-1])), F.lit(0.0)), F.lit(0.0))
        if max_rate is not None:
            rate = F.least(rate, F.lit(float(max_rate)))
        if len(offsets) % KEPT_STEPS == 0:
            base, rate = stored(base.select("tokens", "p", rate.alias("rate")), "rates"), F.col("rate")
        got = base.agg(*[F.sum(rate * F.col("tokens") * F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
        before, now = now, [float(got[i] or 0.0) for i in range(k)]
        best = min(best, (loss(now), len(offsets)))
        if max(abs(a - b) for a, b in zip(now, before, strict=True)) <= 1e-7 * max(1.0, whole):
            break
    else:
        if len(offsets) >= rounds:
            warnings.warn(f"mixing stopped after {rounds} rounds; relative residuals by domain: {dict(zip(domains, (round(x, 4) for x in gap(now)), strict=True))}", stacklevel=2)
    return offsets[: best[1]]


def mix(
    docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    total_share: float | None = None, max_rate: float | None = None, columns: list[str] | None = None, whole: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """``columns`` of ``docs`` (all by default) with tokens, p, rate and copies, and the names of the domains in the order of p.

    copies is the whole part of rate, plus one with the probability of the rest, decided by a digest of the identifier: the same in every run. With ``max_rate`` 1 it is 0 or 1.
    ``total_share`` gives the target's total as a share of the input's tokens (1 by default); it is raised where the target of the domain
    ``whole`` would be less than that domain's tokens. Columns of these four names are
    replaced. Repeated rows are documents of their own; a null identifier is one like any other; an empty text has no tokens and the rate of its
    posterior. An empty table gives an empty result.
    """
    model = train_classifier(docs, labels, domain, id_col, text_col)
    own = [c for c in columns or docs.columns if c not in ("tokens", "p", "rate", "copies")]
    members = docs.select(*own, F.col(id_col).alias("_id"), model.posteriors(F.col(text_col)).alias("_m")).select(*own, "_id", "_m.tokens", "_m.p")
    members = stored(members, "members")
    total = None
    if total_share is not None:
        total = total_share * float(members.agg(F.sum("tokens")).first()[0] or 0)
    if whole in model.domains and weights.get(whole, 0.0) > 0:
        held = F.sum(F.col("tokens") * F.get("p", F.lit(model.domains.index(whole))))
        tokens, held_tokens = (float(x or 0) for x in members.agg(F.sum("tokens"), held).first())
        scale = sum(weights.get(d, 0.0) for d in model.domains)
        total = max(tokens if total is None else total, held_tokens * scale / weights[whole])
    steps = fit_steps(members, model.domains, weights, total, max_rate)
    chance = F.pmod(F.xxhash64(F.col("_id"), F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    out = members.withColumn("rate", rate_of(F.col("p"), steps, max_rate)).withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))
    return out.drop("_id"), model.domains


def label_domain() -> Column:
    """The domain of a row of ``labels``: toxic, else clean or rough by quality; null labels have none."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "rough")
