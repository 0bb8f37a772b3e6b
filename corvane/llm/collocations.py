"""Phrase collocations: counts of word paths in a HAT-trie, spilled as sorted runs and merged by prefix partition."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, UPPER, shuffle_width, stored

# The characters that end a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bits of a word's number within a task, so that a path of three words is one 63-bit number; 0 is no word.
BITS = 21
#: Entries of a hash container before it bursts, and of a task's whole trie before subtrees are spilled.
BURST, HELD = 1 << 14, 1 << 20
#: Words that a task numbers before all is spilled and numbering begins anew.
VOCABULARY = 3 << 18
#: Words taken into the trie at once, about. VOCABULARY and two batches of new words must stay below 2 ** BITS.
BATCH = 1 << 19
#: Nodes of a block of a run; nodes that the merge works on at once.
BLOCK, MERGED = 1 << 14, 1 << 19
#: Bytes of text whose paths one prefix partition holds, about.
BUCKET_BYTES = 256 << 20

_FOLD = bytes.maketrans(UPPER.encode() + b"\t" + PIECE_ENDS, LOWER.encode() + b" " + b"\n" * len(PIECE_ENDS))
_LOW = (1 << BITS) - 1


class HatTrie:
    """Counts of paths of three words. Its upper part is a sorted list of the path at which each container begins; a container is a hash table.

    A container holds all paths between its beginning and the next one. It starts with a range of first words, bursts between two of them where it can, then between second
    and third words: so a frequent word gets containers of its own, and rare ones share one.
    """

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.begins, self.held, self.size = burst, [0], [{}], 0

    def add(self, paths: np.ndarray) -> None:
        """Counts ``paths`` (numbers of three words each)."""
        keys, counts = np.unique(paths, return_counts=True)
        cuts = np.searchsorted(keys, np.array(self.begins[1:], dtype=np.int64)).tolist()
        for i in range(len(cuts), -1, -1):  # from the last, so that a burst moves none that is still to come
            a, b = cuts[i - 1] if i else 0, cuts[i] if i < len(cuts) else len(keys)
            if a == b:
                continue
            table = self.held[i]
            before, get = len(table), table.get
            for k, c in zip(keys[a:b].tolist(), counts[a:b].tolist(), strict=True):
                table[k] = get(k, 0) + c
            self.size += len(table) - before
            if len(table) > self.burst:
                self._split(i)

    def _split(self, i: int) -> None:
        """Bursts a container into parts of at most half its limit, each beginning with the shortest path that can part it from the one before."""
        table = self.held[i]
        keys = np.sort(np.fromiter(table, np.int64, len(table)))
        begins, at = [self.begins[i]], 0
        while len(keys) - at > self.burst:
            middle = at + self.burst // 2
            for shift in (2 * BITS, BITS, 0):  # between first words, else second, else third
                begin = int(keys[middle] >> shift) << shift
                if begin > keys[at]:
                    break
            begins.append(begin)
            at = int(np.searchsorted(keys, begin))
        parts: list[dict[int, int]] = [{} for _ in begins]
        for k, c in table.items():
            parts[bisect_right(begins, k) - 1][k] = c
        self.begins[i : i + 1], self.held[i : i + 1] = begins, parts

    def spill(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes whole containers out, largest first, until at most ``most`` entries stay: paths, ascending, and their counts."""
        taken = []
        for i in sorted(range(len(self.held)), key=lambda i: -len(self.held[i])):
            if self.size <= most:
                break
            self.size -= len(self.held[i])
            taken.append(self.held[i])
            self.held[i] = {}
        n = sum(map(len, taken))
        keys = np.fromiter((k for t in taken for k in t), np.int64, n)
        counts = np.fromiter((c for t in taken for c in t.values()), np.int64, n)
        order = np.argsort(keys)
        return keys[order], counts[order]


def _lines(parts: pa.Array) -> bytes:
    """The strings of ``parts``, each with a line break behind it."""
    return b"\n".join([*parts.to_pylist(), b""])


def _pressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _opened(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _strings(data: bytes) -> pa.Array:
    """The lines of ``data`` as an array of strings that end in their line breaks."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(data)])


RUN = "lang string, bucket int, first binary, second binary, nodes binary, totals binary, leaves binary, leafs binary, n long"
COLUMNS = [c.split()[0] for c in RUN.split(", ")]


class _Counter:
    """The words and paths of one language in one task."""

    def __init__(self, lang: str, buckets: int) -> None:
        self.lang, self.buckets, self.seed = lang, buckets, zlib.crc32(lang.encode("utf-8", "surrogatepass"))
        self.pending, self.n = [], 0
        self._anew()

    def _anew(self) -> None:
        self.number, self.trie, self.uses = {}, HatTrie(), np.zeros(0, dtype=np.int64)

    def add(self, text: str) -> Iterator[pd.DataFrame]:
        out = self.pending
        for piece in text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b"\n"):
            words = piece.split()
            for i in range(0, len(words), BATCH):
                number = self.number
                out += [number.setdefault(w, len(number) + 1) for w in words[i : i + BATCH]]
                out += [-number.setdefault(w, len(number) + 1) for w in words[i + BATCH : i + BATCH + 2]]  # ends of paths that begin in this part of a long piece
                out.append(0)
                if len(out) >= BATCH:
                    yield from self.take()

    def take(self) -> Iterator[pd.DataFrame]:
        """Moves the pending words into the trie; spills what is too much."""
        at = np.array([*self.pending, 0, 0], dtype=np.int64)
        self.pending.clear()
        begins, second, third = at[:-2] > 0, np.abs(at[1:-1]), np.abs(at[2:])
        paths = ((np.abs(at[:-2]) << 2 * BITS) | (second << BITS) | np.where(second > 0, third, 0))[begins]  # a path ends with its piece
        self.n += len(paths)
        used = np.bincount(at[:-2][begins], minlength=len(self.number) + 1)
        used[: len(self.uses)] += self.uses
        self.uses = used
        self.trie.add(paths[(paths >> BITS) & _LOW > 0])
        if len(self.number) >= VOCABULARY:
            yield from self.close()
        elif self.trie.size > HELD:
            yield from self.run(*self.trie.spill(HELD // 4))

    def close(self) -> Iterator[pd.DataFrame]:
        """Spills everything, the uses of single words too, and begins anew."""
        if self.pending:
            yield from self.take()
        yield from self.run(*self.trie.spill(0))
        single = np.flatnonzero(self.uses)
        yield from self.run(single << 2 * BITS, self.uses[single])
        if self.n:
            yield pd.DataFrame([(self.lang, 0, *[None] * 6, self.n)], columns=COLUMNS)
        self.n = 0
        self._anew()

    def run(self, paths: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        """Sorted runs of the paths, one for each prefix partition, in blocks. A prefix, the first two words, is a node with its total; third words are its leaves."""
        if not len(paths):
            return
        words = pa.array([b"", *self.number], pa.binary())
        rank = np.empty(len(words), dtype=np.int64)
        rank[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
        digest = np.fromiter(map(zlib.crc32, [b"", *self.number]), np.uint64, len(words))
        w1, w2, w3 = paths >> 2 * BITS, (paths >> BITS) & _LOW, paths & _LOW
        mixed = (digest[w1] * np.uint64(0x9E3779B97F4A7C15) ^ digest[w2] * np.uint64(0xC2B2AE3D27D4EB4F)) + np.uint64(self.seed)
        bucket = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % self.buckets
        order = np.lexsort((rank[w3], rank[w2], rank[w1], bucket))
        w1, w2, w3, bucket, counts = (x[order] for x in (w1, w2, w3, bucket, counts))
        new = np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (bucket[1:] != bucket[:-1])))
        first = np.flatnonzero(new)  # of each node among the leaves
        size, total = np.diff(np.append(first, len(new))), np.add.reduceat(counts, first)
        starts = np.flatnonzero(np.concatenate(([True], bucket[first][1:] != bucket[first][:-1])))
        out = []
        for a, end in zip(starts.tolist(), [*starts[1:].tolist(), len(first)], strict=True):
            for i in range(a, end, BLOCK):
                j = min(i + BLOCK, end)
                p, q = first[i], first[j - 1] + size[j - 1]
                at = first[i:j]
                ones, twos = words.take(pa.array(w1[at])), words.take(pa.array(w2[at]))
                pair = pc.if_else(pa.array(w2[at] > 0), pc.binary_join_element_wise(ones, twos, pa.scalar(b" ", pa.binary())), ones)
                deep = np.stack((size[i:j], total[i:j]))
                out.append((
                    self.lang, int(bucket[p]), ones[0].as_py(), twos[0].as_py(), _pressed(_lines(pair)), _pressed(deep.astype("<i8").tobytes()),
                    _pressed(_lines(words.take(pa.array(w3[p:q])))), _pressed(counts[p:q].astype("<i8").tobytes()), 0,
                ))
                if len(out) >= 64:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)


#: Languages whose tries a task holds at once.
LANGUAGES = 16


def _runs(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict[str, _Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if lang not in counters:
                    if len(counters) == LANGUAGES:
                        for c in counters.values():
                            yield from c.close()
                        counters = {}
                    counters[lang] = _Counter(lang, buckets)
                yield from counters[lang].add(text)
        for c in counters.values():
            yield from c.close()

    return docs.mapInPandas(run, RUN)


class _Block:
    """An open block of a run: its nodes from ``at`` on are still to be merged."""

    def __init__(self, r) -> None:
        self.nodes, self.leaves = _strings(_opened(r.nodes)), _strings(_opened(r.leaves))
        self.size, self.total = np.frombuffer(_opened(r.totals), dtype="<i8").reshape(2, -1)
        self.counts, self.ends, self.at = np.frombuffer(_opened(r.leafs), dtype="<i8"), np.cumsum(self.size), 0

    def cut(self, bound: tuple[bytes, bytes] | None) -> int:
        """How many nodes are below ``bound`` (first word, second word)."""
        if bound is None:
            return len(self.nodes)
        return bisect_left(range(len(self.nodes)), bound, lo=self.at, key=lambda i: _pair(self.nodes[i].as_py()))


def _pair(line: bytes) -> tuple[bytes, bytes]:
    first, _, second = line[:-1].partition(b" ")
    return first, second


def _merged(blocks: list[_Block], bound: tuple[bytes, bytes] | None, least: int) -> tuple[list[_Block], list[tuple[bytes, int]]]:
    """Sums of all nodes below ``bound`` and of their leaves, if they reach ``least``; blocks with nodes left."""
    cuts = [b.cut(bound) for b in blocks]
    use = [(b, c) for b, c in zip(blocks, cuts, strict=True) if c > b.at]
    found: list[tuple[bytes, int]] = []
    if use:
        keys = pa.concat_arrays([b.nodes.slice(b.at, c - b.at) for b, c in use])
        codes = keys.dictionary_encode()
        index, names = codes.indices.to_numpy(), codes.dictionary
        sums = np.zeros(len(names), dtype=np.int64)
        np.add.at(sums, index, np.concatenate([b.total[b.at : c] for b, c in use]))
        often = sums >= least
        found += [(names[i].as_py()[:-1], int(sums[i])) for i in np.flatnonzero(often)]
        done, paths, counts = 0, [], []
        for b, c in use:  # only leaves of frequent nodes can be frequent
            near = np.repeat(often[index[done : done + c - b.at]], b.size[b.at : c])
            node = np.repeat(index[done : done + c - b.at], b.size[b.at : c])
            done += c - b.at
            begin = int(b.ends[b.at] - b.size[b.at])
            at = np.flatnonzero(near)
            if len(at):
                third = b.leaves.take(pa.array(begin + at))
                paths.append(pc.binary_join_element_wise(names.take(pa.array(node[at])), third, pa.scalar(b"", pa.large_binary())))
                counts.append(b.counts[begin + at])
        if paths:
            codes = pa.concat_arrays(paths).dictionary_encode()
            sums = np.zeros(len(codes.dictionary), dtype=np.int64)
            np.add.at(sums, codes.indices.to_numpy(), np.concatenate(counts))
            for i in np.flatnonzero(sums >= least):
                pair, _, third = codes.dictionary[i].as_py()[:-1].partition(b"\n")
                if third:  # else the path ended with its second word
                    found.append((pair + b" " + third, int(sums[i])))
    for b, c in zip(blocks, cuts, strict=True):
        b.at = c
    return [b for b in blocks if b.at < len(b.nodes)], found


def _counted(runs: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f of all phrases of 1 to 3 words with f >= ``least``, and for each language rows without a phrase whose sum is its number of words.

    A prefix partition gets the blocks of its runs in the order of their first nodes. What lies below the next block's first node is complete and is summed as soon
    as there is enough of it; so a task holds the blocks that are open and no more.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[_Block] = []
        waiting, group, words = 0, None, {}

        def out(lang: str, found: list[tuple[bytes, int]]) -> Iterator[pd.DataFrame]:
            if found:  # columns without a value would be of numbers, which are no strings for Arrow
                yield pd.DataFrame({"lang": lang, "phrase": [p.decode("utf-8", "surrogatepass") for p, _ in found], "f": [f for _, f in found]})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.nodes is None:
                    words[r.lang] = words.get(r.lang, 0) + int(r.n)
                    continue
                if group != (r.bucket, r.lang) or waiting >= MERGED:
                    bound = (r.first, r.second) if group == (r.bucket, r.lang) else None
                    if held:
                        held, found = _merged(held, bound, least)
                        yield from out(group[1], found)
                    group, waiting = (r.bucket, r.lang), 0
                held.append(_Block(r))
                waiting += len(held[-1].nodes)
        if held:
            yield from out(group[1], _merged(held, None, least)[1])
        yield pd.DataFrame([(lang, None, n) for lang, n in words.items()], columns=["lang", "phrase", "f"])

    rows = runs.repartition(shuffle_width(runs.sparkSession), "bucket").sortWithinPartitions("bucket", "lang", "first", "second")
    return rows.mapInPandas(run, "lang string, phrase string, f long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of phrases of 1 to 3 words with f >= ``least``, and (lang, n): all words. See ``collocations``."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * shuffle_width(spark), -(-length // BUCKET_BYTES))
    found = stored(_counted(_runs(rows, buckets), least), "phrases")
    return found.where("phrase is not null"), found.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 or 3 words by how far their words attract each other.

    Texts are lower-cased (A-Z), split at ``PIECE_ENDS`` into pieces and those at spaces and tabs into words. f(phrase) counts its occurrences within pieces, overlaps
    included; n counts words. A candidate has a = f >= ``least``. Each cut into a first part and a rest scores floor(1000000 * a * a / (f(first) * f(rest))), in
    integers of up to 38 digits; the lowest counts, of equal ones that with the shorter first part. Candidates that lie in a longer one with 100 * f(longer) >=
    ``share`` * a are dropped. Ranks go by score, then a, both descending, then phrase in the order of UTF-8 bytes.

    Null language is ``und``, null text empty; repeated rows count again; identifiers and other columns are not read; an empty table gives no row. Counts cover all
    words: a task's trie spills whole subtrees as sorted runs, a hash of language and first two words deals the runs, and each partition merges its own.
    """
    counts, words = phrase_counts(docs, text_col, lang_col, least)
    size = F.size(F.split("phrase", " ", -1))
    counts = counts.withColumn("size", size)
    one = counts.where("size = 1").select("lang", "phrase", "f")
    two, three = (counts.where(F.col("size") == k).select("lang", "phrase", F.col("f").alias("a")) for k in (2, 3))
    part = lambda i, j: F.array_join(F.slice(F.split("phrase", " ", -1), i, j), " ")

    def cut(rows: DataFrame, k: int, size: int, firsts: DataFrame, rests: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_first": part(1, k), "_rest": part(k + 1, size - k)})
        rows = rows.join(firsts.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"])
        rows = rows.join(rests.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
        whole = lambda c: f"cast({c} as decimal(15, 0))"
        score = F.expr(f"cast(1000000 as decimal(7, 0)) * ({whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")
        return rows.select("lang", "phrase", "a", F.struct(score.alias("score"), F.lit(k).alias("k"), "l", "r").alias("cut"))

    pairs = two.withColumnRenamed("a", "f")
    cuts = cut(three, 1, 3, one, pairs).unionByName(cut(three, 2, 3, pairs, one))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inside = three.select("lang", F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = two.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    rows = lowest.unionByName(cut(alone, 1, 2, one, one)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(F.broadcast(words) if words.count() <= 1000 else words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
