"""Best-fit decreasing packing of tokenised documents into sequences of one length."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import shared_dir, shuffle_width, stored

#: Entries of a worker's memory of encoded words (about 200 bytes each), besides those of one text.
WORDS_KEPT = 1_000_000
#: Ends a document.
END_ID = 0
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]


def _single_spaced(text: str) -> bool:
    """True if every space stands alone between two characters that are no white space."""
    if text[:1] == " " or text[-1:] == " " or "  " in text:
        return False
    return not any(w in text and (w + " " in text or " " + w in text) for w in _WHITE)


def added_tokens(tokenizer: str) -> dict[str, int]:
    """The strings that a tokenizer's json file takes as one token wherever they stand, with their ids."""
    with open(tokenizer, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class CachedEncoder:
    """Encodes texts with a byte-level BPE vocabulary; equal words are encoded once.

    ``vocabulary`` is a file of ranks (base64 token, id on each line), the same vocabulary as the tokenizer's json file.
    The tokenizer's pattern starts a new piece at a single space between other characters, so no token spans such a
    space and a text's ids are those of its space-led words, one after another. Where other white space stands beside a space the text is not
    cut. A text is first split at the strings of ``added``: each is its one id, and what stands between two of them is a text
    of its own. Without ``added`` such strings are ordinary text.
    """

    def __init__(self, vocabulary: str, pattern: str, added: dict[str, int] | None = None) -> None:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._kept: dict[str, bytes] = {}  # ids of words with a space before them
        self._leads = np.zeros(max(ranks.values()) + 1, dtype=bool)  # tokens that begin with a space
        self._leads[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self._added = {t: np.array([i], dtype="<u4").tobytes() for t, i in (added or {}).items()}
        self._cut = re.compile("|".join(map(re.escape, sorted(self._added, key=len, reverse=True))))

    def _encode(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encodes words without spaces all at once; each begins at a token that begins with a space."""
        ids = np.array(self._bpe.encode_ordinary(" " + " ".join(words)), dtype="<u4")
        cuts = (4 * np.flatnonzero(self._leads[ids])).tolist()
        data = ids.tobytes()
        self._kept.update(zip(words, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)])), strict=True))

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if not any(t in text for t in self._added):
            return self._encode_between(text)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += [self._encode_between(text[at : m.start()]), self._added[m[0]]]
            at = m.end()
        return b"".join([*out, self._encode_between(text[at:])])

    def _encode_between(self, text: str) -> bytes:
        if not _single_spaced(text):
            first, *rest = _BETWEEN.split(text)
            return b"".join([self._encode(first), *[self._encode(" " + w) for w in rest]])
        first, *rest = text.split(" ")
        found = list(map(self._kept.get, rest))
        if None in found:
            missing = list({w for w, ids in zip(rest, found, strict=True) if ids is None})
            if len(self._kept) + len(missing) > WORDS_KEPT:
                self._kept.clear()
            self._learn(missing)
            found = [self._kept[w] if ids is None else ids for w, ids in zip(rest, found, strict=True)]
        return self._encode(first) + b"".join(found)


#: One encoder for each vocabulary in a Python worker, which runs many tasks.
_encoders: dict[tuple, CachedEncoder] = {}


def _encoder(vocabulary: str, pattern: str, added: dict[str, int] | None) -> CachedEncoder:
    key = (vocabulary, pattern, tuple(sorted((added or {}).items())))
    if key not in _encoders:
        _encoders[key] = CachedEncoder(vocabulary, pattern, added)
    return _encoders[key]


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces of at most ``capacity`` tokens.

    A document is its ids, then ``END_ID``; null text is empty. Only longer ones are cut: the first piece is the remainder (or full),
    the others are full, so that at most one piece of a document needs a place beside others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary, pattern, added)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows, ids = [], batch["doc_id"].array
            for k, text in enumerate(batch["text"]):
                data = encoder.encode(text or "") + end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(k, j, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            at = np.array(rows, dtype=np.int64).reshape(-1, 5)
            yield pd.DataFrame({"doc_id": ids[at[:, 0]], "piece": at[:, 1].astype(np.int32), "start": at[:, 2], "length": at[:, 3], "ids_crc32": at[:, 4]})

    kind = docs.schema[id_col].dataType
    found = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id string, piece int, start long, length long, ids_crc32 long"  # a string holds null and large numbers alike
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


class Capacities:
    """A segment tree over remaining capacities 0 .. size: which of them some open bin has."""

    def __init__(self, size: int) -> None:
        self._half = 1
        while self._half <= size:
            self._half *= 2
        self._any = [False] * (2 * self._half)

    def set(self, capacity: int, present: bool) -> None:
        i = capacity + self._half
        self._any[i] = present
        while i > 1:
            i //= 2
            self._any[i] = self._any[2 * i] or self._any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that some bin has, in logarithmic time."""
        i = need + self._half
        if self._any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self._any[i + 1]:
                i += 1
                while i < self._half:
                    i = 2 * i if self._any[2 * i] else 2 * i + 1
                return i - self._half
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs ``counts[length]`` items of each length; returns runs and the number of bins.

    Items come longest first; each goes to the tightest open bin that holds it, else to a new one. Bins of equal remaining capacity are
    alike, as are items of equal length, so what a run of items does is done at once: a bin takes as many as it can of a length
    before the next of its kind is touched, which is what one item after another would do. The work is bounded by
    the square of the capacity and not by the number of documents.

    A run (length, first rank, first bin, items for each bin, offset) places the items of that rank and on, until the next run of this length.
    """
    tree, bins, runs = Capacities(capacity), 0, []
    open_bins: dict[int, list[list[int]]] = defaultdict(list)  # remaining capacity: [first bin, number of bins]

    def put(left: int, first: int, number: int) -> None:
        if left and number:
            if not open_bins[left]:
                tree.set(left, True)
            open_bins[left].append([first, number])

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            left = tree.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                number = -(-rest // each)
                first = bins
                bins += number
            else:
                each = left // length
                span = open_bins[left][-1]
                number = min(span[1], -(-rest // each))
                first = span[0]
                span[0] += number
                span[1] -= number
                if not span[1]:
                    open_bins[left].pop()
                    if not open_bins[left]:
                        tree.set(left, False)
            full, part = divmod(rest, each)
            full = min(full, number)
            runs.append((length, rank, first, each, capacity - left))
            put(left - each * length, first, full)
            used = full * each
            if full < number:  # the last bin takes fewer
                put(left - part * length, first + full, 1)
                used += part
            rank += used
            rest -= used
    return runs, bins


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece: best-fit decreasing over all pieces.

    Strings of ``added`` are one token each. The tokens of a sequence have no gap from offset 0. Repeated rows, rows that share an identifier and a null identifier are packed as documents of
    their own. An empty table gives an empty result. Executors hold one batch of texts; the driver sees how many pieces each length has
    (at most ``capacity`` numbers). A piece's place follows from its rank among those of its length: ranks are counted within
    slices of the documents, so that no task needs all pieces of a frequent length, and slices are joined by prefix sums.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    slices = shuffle_width(spark)
    found = stored(pieces(docs, vocabulary, pattern, capacity, id_col, text_col, added), "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    runs, _ = best_fit_decreasing(counts, capacity)
    places: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    for run in runs:
        places[run[0]].append(run)
    starts = {length: [r[1] for r in rows] for length, rows in places.items()}

    sliced = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("nth", F.row_number().over(own) - 1)
    before = sliced.groupBy("length", "slice").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("slice")) - F.col("count")).drop("count")
    ranked = ranked.join(before, ["length", "slice"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch["before"].to_numpy() + batch["nth"].to_numpy()
            bins = np.zeros(len(batch), dtype=np.int64)
            offsets = np.zeros(len(batch), dtype=np.int64)
            for length, rows in batch.groupby("length").indices.items():
                runs_of, begin = np.array(places[length]), starts[length]
                at = np.searchsorted(begin, rank[rows], side="right") - 1
                nth = rank[rows] - runs_of[at, 1]
                bins[rows] = runs_of[at, 2] + nth // runs_of[at, 3]
                offsets[rows] = runs_of[at, 4] + nth % runs_of[at, 3] * length
            yield batch.drop(columns=["slice", "nth", "before"]).assign(sequence_id=bins, offset=offsets)

    kind = found.schema["doc_id"].dataType
    columns = ["piece", "start", "length", "ids_crc32"]
    placed = ranked.select(F.col("doc_id").cast("string"), *columns, "slice", "nth", "before").mapInPandas(
        place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed.withColumn("doc_id", F.col("doc_id").cast(kind))
