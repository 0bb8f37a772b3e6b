"""Runs of repeated word sequences: segments split by rare words until they are stable, then scanned lag by lag."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least ``TIMES`` periods and ``SHORTEST`` words. So each of its words is in it ``TIMES`` times or more.
TIMES, SHORTEST = 4, 6
#: Words scanned at once, about; a longer text is scanned alone.
SCAN_WORDS = 1 << 20


def _surviving(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The places of words that may be in a run: ascending. ``segment`` numbers the text that each word is of.

    A word that is fewer than ``TIMES`` times in its segment is in no run there, so it parts the segment in two, where other words become rare in turn. A segment in
    which no word is rare is stable, and is not looked at again; one that is too short for any run goes.
    """
    at, done = np.arange(len(words)), []
    while len(at):
        order = np.lexsort((words[at], segment))
        new = np.flatnonzero(np.concatenate(([True], (np.diff(words[at][order]) != 0) | (np.diff(segment[order]) != 0))))
        often = np.empty(len(at), dtype=bool)
        often[order] = np.repeat(np.diff(np.append(new, len(at))) >= TIMES, np.diff(np.append(new, len(at))))
        sizes = np.bincount(segment)
        stable = (np.bincount(segment[~often], minlength=len(sizes)) == 0)[segment]
        done.append(at[stable])
        keep = often & ~stable
        at, was = at[keep], segment[keep]
        if len(at):
            segment = np.cumsum(np.concatenate(([0], (np.diff(at) > 1) | (np.diff(was) != 0))))
            long = np.bincount(segment)[segment] >= SHORTEST
            at = at[long]
            segment = np.unique(segment[long], return_inverse=True)[1]
    return np.sort(np.concatenate(done)) if done else at


def _same_ahead(w: np.ndarray, at: int, lag: int) -> int:
    """How many words from ``at`` on equal those ``lag`` later, without a break."""
    n, step, most = 0, 16, len(w) - lag - at
    while n < most:
        m = min(step, most - n)
        differ = w[at + n : at + n + m] != w[at + n + lag : at + n + lag + m]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + m, step * 4
    return most


def _same_behind(w: np.ndarray, at: int, lag: int) -> int:
    """How many words before ``at`` equal those ``lag`` later, without a break."""
    n, step = 0, 16
    while n < at:
        m = min(step, at - n)
        differ = (w[at - n - m : at - n] != w[at - n - m + lag : at - n + lag])[::-1]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + m, step * 4
    return at


def _scan(w: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in segments that stand one behind the other in ``w``, longest first, each with a mark of its own behind it.

    At lag q only every q-th word is read: a run of 4 q words holds four of them, so three equal neighbours in a row. Where there are, equality is followed word by word
    in both directions. A stretch that a smaller period fills already is the same run at the multiples of that period: most of their places are skipped unread.
    """
    found: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ends = np.cumsum(lengths + 1)
    for lag in range(1, int(lengths[0]) // TIMES + 1 if len(lengths) else 1):
        n = ends[np.searchsorted(-lengths, -max(TIMES * lag, SHORTEST), side="right") - 1]  # segments that are long enough stand in front
        each = w[:n:lag]
        same = each[1:] == each[:-1]
        at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * lag
        for start, length, period in known.pop(lag, ()):
            if len(at):
                at = at[(at < start) | (at + 3 * lag >= start + length)]
            if TIMES * (lag + period) <= length:
                known[lag + period].append((start, length, period))
        done = -1
        for a in at.tolist():
            if a < done:
                continue
            ahead = _same_ahead(w, a, lag)
            start = a - _same_behind(w, a, lag)
            done, length = a + ahead, a + ahead + lag - start
            if length >= max(TIMES * lag, SHORTEST) and (start, length) not in found:
                found[start, length] = lag
                if 2 * TIMES * lag <= length:
                    known[2 * lag].append((start, length, lag))
    return [(start, length, period) for (start, length), period in found.items()]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, given as numbers of its words, its runs (start, length, period) by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    words, owner = np.concatenate(texts) if len(texts) else np.zeros(0, dtype=np.int64), np.repeat(np.arange(len(texts)), sizes)
    at = _surviving(words, owner)
    if not len(at):
        return out
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(owner[at]) != 0))))
    lengths = np.diff(np.append(first, len(at)))
    order = np.argsort(-lengths, kind="stable")
    lengths, begins = lengths[order], at[first[order]]
    places = np.cumsum(lengths + 1) - lengths - 1
    line = np.empty(int(lengths.sum()) + len(lengths), dtype=np.int64)
    marks = places + lengths
    line[marks] = -1 - np.arange(len(marks))
    inside = np.ones(len(line), dtype=bool)
    inside[marks] = False
    line[inside] = words[np.repeat(begins, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
    starts = np.cumsum(sizes) - sizes
    for start, length, period in _scan(line, lengths):
        k = int(np.searchsorted(places, start, side="right")) - 1
        word = int(begins[k]) + start - int(places[k])
        text = int(owner[word])
        out[text].append((word - int(starts[text]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at just the six white space characters


def _numbers(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)


def planted(n: int, doc_id: object) -> np.ndarray:
    """Which original word stands at each of ``n`` places: one text in ten has its tail repeat a stretch of words."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    at = np.arange(n)
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, runs (array of start, length, period, by start, then period), text_out (the words that no run repeats) and the digest columns.

    Words are runs of other characters than space and \\t-\\r, compared as they are. A run is a stretch with smallest period q (words q apart are equal) of at least max(6, 4 q)
    words that cannot be extended. A word is dropped if a run contains it after the run's first q words. n_runs, and of the run with the greatest exact length/period
    (ties: least start, then period) start, length, period and exponent_milli, null if there is none; runs_sha256 of lines ``start,length,period``; collapsed_sha256 of
    text_out. ``plant`` first makes one text in ten repeat itself (see ``planted``), by the identifier, so that there are runs to find.

    Null and empty texts have no words and no run. Each row is judged alone: repeated rows, and rows that share an identifier or have none, each get their row; other
    columns are not read; an empty table gives no row. Texts of any length are read whole, by one task each: the work is that of sorting their words.
    """
    kind = docs.schema[id_col].dataType

    def rows(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        out = []
        for i, words, runs in zip(ids, texts, runs_of([_numbers(t) for t in texts]), strict=True):
            drop = np.zeros(len(words) + 1, dtype=np.int64)
            for start, length, period in runs:
                drop[start + period] += 1
                drop[start + length] -= 1
            kept = words if not runs else [words[j] for j in np.flatnonzero(np.cumsum(drop)[:-1] == 0)]
            text = b" ".join(kept)
            best = None
            for r in runs:
                if best is None or r[1] * best[2] > best[1] * r[2]:
                    best = r
            start, length, period = best or (None, None, None)
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
            out.append((
                i, len(runs), start, length, period, 1000 * length // period if best else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest(),
                [{"start": s, "length": n, "period": q} for s, n, q in runs], text.decode("utf-8", "surrogatepass"),
            ))
        frame = pd.DataFrame(out, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "text_out"])
        return frame.astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = _split(text)
                if plant:
                    words = [words[j] for j in planted(len(words), i)]
                ids.append(i)
                texts.append(words)
                held += len(words)
                if held >= SCAN_WORDS:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield rows(ids, texts)

    schema = (
        "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
        "runs array<struct<start:long,length:long,period:long>>, text_out string"
    )
    found = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
