"""Language-model scores from a class-based bigram model with exchange clustering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bucketed, discard, shared_dir, shuffle_width, stored
from corvane.llm.wordhash import chunks, mix, words

#: Characters of text in one chunk; bounds a task's arrays.
CHUNK_CHARS = 12_000_000
#: Shares into which the words are dealt. Words of one share move one after another, so this number is part of the model: it follows no setting of the cluster.
SHARES = 64
#: The digest that stands for the end of a text.
END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: Classes 0 and 1 are fixed: the end, and rare words (unknown ones with them).
END_CLASS, RARE_CLASS = 0, 1
#: A class is seven bits of a byte; the eighth says whether a word may move.
MAX_CLASSES = 128


@dataclass(frozen=True)
class BrownParams:
    classes: int = 24
    min_count: int = 12  # words seen less often are of the rare class
    sweeps: int = 8  # passes over the corpus at most; each moves the words of one group
    least_gain: float = 0.0005  # of the classes' likelihood: the exchange has converged when each group in turn gains less
    class_share: float = 0.6  # of the class model, the rest is the unigram base
    alpha: float = 1.0  # added to class transitions


def _squeezed(a: np.ndarray) -> bytes:
    """Compressed bytes of 32-bit numbers, byte by byte of all numbers: high bytes are mostly alike."""
    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.int64(len(a)).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _opened(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:8], dtype=np.int64)[0])
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(n).astype(np.int64)


def _pack(docs: DataFrame, shares: int) -> DataFrame:
    """Chunks of documents as arrays: their words as places in the chunk's own vocabulary.

    chunk, ids, held (lists), ends (where each text ends), tokens (places), vocabulary (digests, by share of the lexicon, then ascending), counts (of the
    training texts), cuts (where each share begins).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, nth = TaskContext.get().partitionId(), 0
        ids, flags, texts = [], [], []

        def emit() -> pd.DataFrame:
            found, lengths = [], []
            for a, b in chunks(texts):
                digest, owner = words(texts[a:b])
                count = np.bincount(owner, minlength=b - a)
                found.append(np.insert(digest, np.cumsum(count), END))
                lengths.append(count + 1)
            size = np.concatenate(lengths)
            vocabulary, place = np.unique(np.concatenate(found), return_inverse=True)
            share = (vocabulary % np.uint64(shares)).astype(np.int64)
            order = np.lexsort((vocabulary, share))
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            place = rank[place]
            learn = np.repeat(~np.array(flags, dtype=bool), size)
            return pd.DataFrame({
                "chunk": [(part << 24) + nth], "ids": [list(ids)], "held": [list(flags)], "ends": [np.cumsum(size)], "tokens": [_squeezed(place)],
                "vocabulary": [vocabulary[order].tobytes()], "counts": [_squeezed(np.bincount(place[learn], minlength=len(order)))],
                "cuts": [np.searchsorted(share[order], np.arange(shares + 1))],
            })

        chars = 0
        for batch in batches:
            for i, f, t in zip(batch["id"], batch["held"], batch["text"], strict=True):
                ids.append(i)
                flags.append(bool(f))
                texts.append(t or "")
                chars += len(t or "") + 1
                if chars >= CHUNK_CHARS:
                    yield emit()
                    ids, flags, texts, chars, nth = [], [], [], 0, nth + 1
        if ids:
            yield emit()

    return docs.mapInPandas(
        run, "chunk long, ids array<string>, held array<boolean>, ends array<long>, tokens binary, vocabulary binary, counts binary, cuts array<long>"
    )


def _lexicon(packed: DataFrame, p: BrownParams) -> DataFrame:
    """One row for each share of the words: h (digests), c (training counts), cls (classes), and for each chunk the places of its words among them.

    A word's share follows from its digest, so one task sees all chunks' counts of a word; a share grows with the vocabulary over the number of shares.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, v, n, cuts in zip(batch["chunk"], batch["vocabulary"], batch["counts"], batch["cuts"], strict=True):
                h, count = np.frombuffer(v, dtype=np.uint64), _opened(n)
                rows = [(s, chunk, h[a:b].tobytes(), _squeezed(count[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pd.DataFrame(rows, columns=["share", "chunk", "h", "n"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, dtype=np.uint64) for x in group["h"]]
        h, index = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.zeros(len(h), dtype=np.int64)
        np.add.at(c, index, np.concatenate([_opened(x) for x in group["n"]]))
        cls = 2 + (mix(h, 3) % np.uint64(p.classes - 2)).astype(np.int64)  # frequent words are dealt to the free classes by digest
        cls[c < p.min_count] = RARE_CLASS
        cls[h == END] = END_CLASS
        rare = (cls == RARE_CLASS) & (c > 0)
        return pd.DataFrame({
            "share": [int(group["share"].iloc[0])], "h": [h.tobytes()], "c": [c.astype("<i8").tobytes()], "cls": [cls.astype(np.uint8).tobytes()],
            "chunks": [group["chunk"].tolist()], "sizes": [[len(x) for x in parts]], "places": [_squeezed(index)],
            "n": [int(c.sum())], "v": [int((c > 0).sum())], "rare": [int(rare.sum())],
        })

    rows = packed.select("chunk", "vocabulary", "counts", "cuts").mapInPandas(blocks, "share int, chunk long, h binary, n binary")
    schema = "share int, h binary, c binary, cls binary, chunks array<long>, sizes array<long>, places binary, n long, v long, rare long"
    return rows.groupBy("share").applyInPandas(merge, schema)


def _moving(h: np.ndarray, cls: np.ndarray, group: tuple[int, int] | None) -> np.ndarray:
    """The frequent words of one group of the vocabulary: (which, of how many)."""
    if group is None:
        return np.zeros(len(h), dtype=bool)
    return (cls > RARE_CLASS) & (mix(h, 7) % np.uint64(group[1]) == np.uint64(group[0]))


def class_likelihood(moves: np.ndarray) -> float:
    """The log likelihood of the training texts under the class bigrams, but for a constant that the words' counts alone decide."""
    total = lambda x: float((x * np.log(np.maximum(x, 1.0))).sum())
    return total(moves) - total(moves.sum(axis=1)) - total(moves.sum(axis=0))


def _looked_up(lexicon: DataFrame, group: tuple[int, int] | None) -> DataFrame:
    """For each chunk one row: of its vocabulary, in order, the counts, the classes and whether a word may move (0x80 in its class)."""

    def reply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                h, c = np.frombuffer(r.h, dtype=np.uint64), np.frombuffer(r.c, dtype="<i8")
                cls = np.frombuffer(r.cls, dtype=np.uint8)
                cls = cls | (_moving(h, cls, group).astype(np.uint8) << np.uint8(7))
                ends = np.cumsum(np.asarray(r.sizes))
                at = np.split(_opened(r.places), ends[:-1])
                rows = [(k, r.share, cls[i].tobytes(), _squeezed(c[i]) if group is None else b"") for k, i in zip(r.chunks, at, strict=True)]
                yield pd.DataFrame(rows, columns=["chunk", "share", "cls", "c"])

    rows = lexicon.select("share", "h", "c", "cls", "chunks", "sizes", "places").mapInPandas(reply, "chunk long, share int, cls binary, c binary")
    return rows.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("share", "cls", "c"))).alias("replies"))


def _with_classes(packed: DataFrame, looked: DataFrame, *columns: str) -> DataFrame:
    """Chunks with their replies. ``packed`` is in buckets by chunk and does not move."""
    return packed.select("chunk", "held", "ends", "tokens", *columns).join(
        looked.select("chunk", F.transform("replies", lambda r: r["cls"]).alias("cls"), F.transform("replies", lambda r: r["c"]).alias("c")), "chunk"
    )


def _read(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, lengths of texts, training flag of each text, class of each word, whether it may move."""
    size = np.diff(np.concatenate(([0], np.asarray(r.ends, dtype=np.int64))))
    cls = np.frombuffer(b"".join(r.cls), dtype=np.uint8)
    return _opened(r.tokens), size, ~np.asarray(r.held, dtype=bool), (cls & np.uint8(0x7F)).astype(np.int64), cls >= 0x80


def _transitions(packed: DataFrame, looked: DataFrame, k: int) -> np.ndarray:
    """How often each class follows each in the training texts (a text begins after an end): k * k sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                tokens, size, learn, cls, _ = _read(r)
                now = cls[tokens]
                before = np.concatenate(([END_CLASS], now[:-1]))
                total += np.bincount((before * k + now)[np.repeat(learn, size)], minlength=k * k)
        cell = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cell, "n": total[cell]})

    rows = _with_classes(packed, looked).mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(k * k)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def _moved(around: np.ndarray, cls: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The classes of words after each was taken out of its class and put where the class bigrams become likeliest.

    ``around`` has the classes before and after each word (k counts each). Every move changes the counts that the next word is judged under; the
    moves of other shares are seen with the next pass.
    """
    k = len(moves)
    now, mass = moves.astype(float).copy(), moves.sum(axis=0).astype(float)
    out = cls.copy()
    for w in np.argsort(-around[:, :k].sum(axis=1), kind="stable"):  # frequent words first
        left, right = around[w, :k], around[w, k:]
        n, a = left.sum(), out[w]
        if not n:
            continue
        now[a] -= right
        now[:, a] -= left
        np.maximum(now, 0, out=now)  # a word beside itself is taken out twice
        mass[a] -= n
        i, j = np.flatnonzero(left), np.flatnonzero(right)
        gain = (_xlogx(now[:, j] + right[j]) - _xlogx(now[:, j])).sum(axis=1) + (_xlogx(now[i] + left[i, None]) - _xlogx(now[i])).sum(axis=0)
        gain -= 2 * (_xlogx(mass + n) - _xlogx(mass))
        gain[: RARE_CLASS + 1] = -np.inf
        b = out[w] = gain.argmax()
        now[b] += right
        now[:, b] += left
        mass[b] += n
    return out


def _exchange(packed: DataFrame, looked: DataFrame, lexicon: DataFrame, moves: np.ndarray, group: tuple[int, int], p: BrownParams) -> DataFrame:
    """One exchange pass: each frequent word of one group moves to the class that makes its neighbours likeliest.

    Tasks sum the classes to the left and right of each such word in their chunks; a shuffle by share of the lexicon sums them over the corpus;
    then ``_moved`` takes the words of a share one after another.
    """
    k = p.classes

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                tokens, size, learn, cls, moving = _read(r)
                at = np.cumsum(moving) - 1
                now = cls[tokens]
                use = np.flatnonzero(moving[tokens] & np.repeat(learn, size))
                left = np.where(use > 0, now[np.maximum(use - 1, 0)], END_CLASS)
                right = now[use + 1]  # a text ends with an end, so there is a next token
                place = at[tokens[use]] * 2 * k
                both = np.bincount(np.concatenate((place + left, place + k + right)), minlength=int(moving.sum()) * 2 * k).reshape(-1, 2 * k)
                cuts = np.concatenate(([0], np.cumsum(moving)))[np.asarray(r.cuts, dtype=np.int64)]
                rows = [(s, r.chunk, _squeezed(both[a:b].ravel())) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pd.DataFrame(rows, columns=["share", "chunk", "around"])

    def choose(words_of: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        out = words_of.copy()
        for row in range(len(words_of)):  # one row a share
            r = words_of.iloc[row]
            h, cls = np.frombuffer(r["h"], dtype=np.uint64), np.frombuffer(r["cls"], dtype=np.uint8).copy()
            moving = _moving(h, cls, group)
            at = np.cumsum(moving) - 1
            got = np.zeros((int(moving.sum()), 2 * k))
            places = dict(zip(r["chunks"], np.split(_opened(r["places"]), np.cumsum(np.asarray(r["sizes"]))[:-1]), strict=True))
            for chunk, x in zip(around["chunk"], around["around"], strict=True):
                i = places[chunk]
                got[at[i[moving[i]]]] += _opened(x).reshape(-1, 2 * k)  # a word is once in a chunk's vocabulary
            at = np.flatnonzero(moving)
            cls[at] = _moved(got, cls[at].astype(np.int64), moves)
            out.at[out.index[row], "cls"] = cls.tobytes()
        return out

    found = _with_classes(packed, looked, "cuts").mapInPandas(contexts, "share int, chunk long, around binary")
    return lexicon.groupBy("share").cogroup(found.groupBy("share")).applyInPandas(choose, lexicon.schema)


def _clustered(packed: DataFrame, lexicon: DataFrame, p: BrownParams) -> tuple[DataFrame, np.ndarray]:
    """The lexicon after the exchange, and its class transitions.

    Groups of words move in turn, each under the counts that the moves before it left. A pass after which the texts are less likely is undone, and the
    groups are halved, as words that move at once may get in each other's way. So likelihood never falls; the exchange ends when each group in
    turn gains less than ``least_gain`` of it, or after ``sweeps`` passes.
    """
    groups, nth, quiet = 2, 0, 0
    looked = stored(_looked_up(lexicon, (0, groups)), "lmlooked")
    moves = _transitions(packed, looked, p.classes)
    for _ in range(p.sweeps):
        changed = stored(_exchange(packed, looked, lexicon, moves, (nth % groups, groups), p), "lexicon")
        after = (nth + 1) % groups, groups
        seen = stored(_looked_up(changed, after), "lmlooked")
        new = _transitions(packed, seen, p.classes)
        gain = class_likelihood(new) - class_likelihood(moves)
        discard(looked)
        if gain < 0:
            discard(seen)
            discard(changed)
            groups, nth, quiet = 2 * groups, 0, 0
            looked = stored(_looked_up(lexicon, (0, groups)), "lmlooked")
            continue
        discard(lexicon)
        quiet = quiet + 1 if gain <= p.least_gain * abs(class_likelihood(new)) else 0
        lexicon, looked, moves, nth = changed, seen, new, nth + 1
        if quiet == groups:
            break
    return lexicon, moves


def _scores(packed: DataFrame, looked: DataFrame, moves: np.ndarray, rare: int, total: int, distinct: int, p: BrownParams) -> DataFrame:
    """The columns of ``score`` for each document."""
    smooth = moves + p.alpha
    ahead = smooth / smooth.sum(axis=1, keepdims=True)
    mass = moves.sum(axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                tokens, size, learn, cls, _ = _read(r)
                c = np.concatenate([_opened(x) for x in r.c])
                base = (c + 1.0) / (total + distinct + 1.0)
                # a class's words share its mass; the rare class keeps one more share for all unknown words
                extra = (cls == RARE_CLASS).astype(float)
                emit = (c + extra) / np.maximum(mass[cls] + extra * (rare + 1.0), 1.0)
                now = cls[tokens]
                before = np.concatenate(([END_CLASS], now[:-1]))
                likely = p.class_share * ahead[before, now] * emit[tokens] + (1 - p.class_share) * base[tokens]
                first = np.cumsum(size) - size
                yield pd.DataFrame({
                    "doc_id": r.ids, "held_out": ~learn, "n_tokens": size, "n_known": np.add.reduceat((c[tokens] > 0).astype(np.int64), first),
                    "base_score": np.add.reduceat(np.log10(base)[tokens], first), "score": np.add.reduceat(np.log10(likely), first),
                })

    return _with_classes(packed, looked, "ids").mapInPandas(run, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", params: BrownParams | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for every row.

    The model learns from the rows whose ``held_out`` (a boolean Column) is false or null. Tokens are words, A-Z lower-cased, then one end for each text; null text is
    empty, so it is one end. base_score is the add-one unigram log10 probability over training tokens, with one share for all unknown words. score mixes it with
    P(class | class before) * P(word | class): exchange clustering assigns the words seen often enough to classes, in passes over the whole corpus until it converges. perplexity is 10 ** (-score / n_tokens).
    Both are proper distributions. Repeated rows and a null identifier are texts like any other. An empty table gives an empty result.

    Counts of words, classes around words and class transitions are sums over all training texts, moved by Spark's shuffles; the driver sees
    one number for each pair of classes and a few totals. Words are told apart by 64-bit digests.
    """
    p = params or BrownParams()
    if not 3 <= p.classes <= MAX_CLASSES:
        raise ValueError(f"classes must be 3 to {MAX_CLASSES}, not {p.classes}")
    shared_dir(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = bucketed(_pack(rows, SHARES), "lmchunks", "chunk", shuffle_width(docs.sparkSession))
    lexicon = stored(_lexicon(packed, p), "lexicon")
    totals = lexicon.agg(*[F.sum(x).alias(x) for x in ("n", "v", "rare")]).first()
    total, distinct, rare = (int(totals[x] or 0) for x in ("n", "v", "rare"))
    lexicon, moves = _clustered(packed, lexicon, p)
    looked = stored(_looked_up(lexicon, None), "lmlooked")
    out = _scores(packed, looked, moves, rare, total, distinct, p)
    return out.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
