"""Approximate nearest neighbours by a forest of sorted hash strings (prefix trees), searched depth by depth in all trees at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import discard, shuffle_width, stored

#: Sorted arrays of hash strings.
TREES = 32
#: A string's first symbol is the nearest of 2 * AXES directions of a random frame (6 bits), each following one the nearest of 4 (2 bits): 128 bits in all.
AXES, FIRST_BITS, BITS = 32, 6, 128
#: The deepest level: a level is a number of symbols. Level 0 is the whole tree.
DEEPEST = 1 + (BITS - FIRST_BITS) // 2
#: Levels whose prefixes (12 bits) are counted for all rows at once.
SHALLOW = 4
CELL_BITS = FIRST_BITS + 2 * (SHALLOW - 1)
#: Queries, drawn by digest, whose exact neighbours set how many candidates a search gathers, and the share of those neighbours that it must meet.
SAMPLE_QUERIES, TARGET = 200, 0.97
#: Entries of one range of a tree, about, and ranges at most; beyond that ranges grow with the table (some 40 MB a range at a billion vectors of 64 numbers).
RANGE_ROWS, MAX_RANGES = 4096, 1 << 18
#: Queries that meet one range in one task.
SALT_ROWS = 4096
#: Keys: tree (1 byte), length of the vector (4), hash (16), digest of the vector (16).
KEY, HEAD = 37, 5

_frames: dict[tuple[int, int], np.ndarray] = {}


def _frame(dim: int, tree: int) -> np.ndarray:
    if (dim, tree) not in _frames:
        _frames[dim, tree] = np.random.default_rng((dim, tree)).standard_normal((dim, AXES + 2 * (DEEPEST - 1)))
    return _frames[dim, tree]


def _hashes(x: np.ndarray, tree: int) -> np.ndarray:
    """(n, 16) bytes: the hash strings of the rows of ``x`` in one tree."""
    turned = x @ _frame(x.shape[1], tree)
    near = np.abs(turned[:, :AXES]).argmax(axis=1)
    first = 2 * near + (turned[np.arange(len(x)), near] > 0)
    pairs = turned[:, AXES:].reshape(len(x), -1, 2)
    second = np.abs(pairs[:, :, 1]) > np.abs(pairs[:, :, 0])
    sign = np.where(second, pairs[:, :, 1], pairs[:, :, 0]) > 0
    bits = np.empty((len(x), BITS), dtype=np.uint8)
    bits[:, :FIRST_BITS] = (first[:, None] >> np.arange(FIRST_BITS - 1, -1, -1)) & 1
    bits[:, FIRST_BITS::2], bits[:, FIRST_BITS + 1 :: 2] = second, sign
    return np.packbits(bits, axis=1)


def _keys(tree: int, hashes: np.ndarray, digests: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(hashes), KEY), dtype=np.uint8)
    out[:, 0] = tree
    out[:, 1:HEAD] = np.frombuffer(dim.to_bytes(4, "big"), dtype=np.uint8)
    out[:, HEAD : HEAD + 16] = hashes
    out[:, HEAD + 16 :] = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 16)
    return out


def _text(keys: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings that numpy compares byte by byte."""
    return np.ascontiguousarray(keys).reshape(-1, KEY).view(f"S{KEY}").ravel()


def _bits(level: int) -> int:
    return FIRST_BITS + 2 * (level - 1) if level else 0


def _bounds(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest key that share the first ``level`` symbols with each of ``keys``."""
    mask = np.packbits(np.arange(BITS) < _bits(level))
    low, high = keys.copy(), keys.copy()
    low[:, HEAD : HEAD + 16] &= mask
    high[:, HEAD : HEAD + 16] |= ~mask
    low[:, HEAD + 16 :], high[:, HEAD + 16 :] = 0, 255
    return low, high


def _matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(float)


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    for size, rows in frame.groupby(frame["v"].map(len), sort=False):
        if size:
            yield size, rows


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` and the lengths of its rows; rows of extreme size are scaled first, which leaves cosines as they are."""
    most = np.abs(x).max(axis=1, keepdims=True)
    x = np.where((most > 1e100) | (most < 1e-100), x / np.where(most > 0, most, 1), x)
    return x, np.sqrt((x * x).sum(axis=1))


def _usable(rows: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """id, digest, v: one row an identifier. Vectors that are null or zero, or hold a null or a number that is not finite, and rows without an identifier are out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["v"].map(len), sort=False):
                x = np.array([np.asarray(v, dtype=float) for v in part["v"]], dtype=float).reshape(len(part), -1)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                v = [r.tobytes() for r in (x[good] + 0.0).astype(kind)]  # there is one zero
                yield pd.DataFrame({"id": part["id"].to_numpy()[good], "digest": [hashlib.blake2b(b, digest_size=16).digest() for b in v], "v": v})

    known = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    found = known.mapInPandas(run, "id long, digest binary, v binary")
    return found.groupBy("id").agg(F.min(F.struct("digest", "v")).alias("x")).select("id", "x.*")


def _classes(usable: DataFrame, k: int) -> DataFrame:
    """digest, v, ids: equal vectors as one class with its k + 1 least identifiers; no others can be among the k nearest of anything."""
    order = Window.partitionBy("digest").orderBy("id")
    least = usable.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return least.groupBy("digest").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def _splitters(classes: DataFrame, rows: int, kind: str) -> np.ndarray:
    """The keys that part the ranges, from the strings of a sample that has about 8 keys a range."""
    ranges = min(MAX_RANGES, -(-rows * TREES // RANGE_ROWS))
    part = min(1.0, 8 * ranges / (rows * TREES))
    drawn = classes.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < math.ceil(part * (1 << 20))).select("digest", "v").toPandas()
    keys = [_text(_keys(t, _hashes(x, t), own["digest"].tolist(), x.shape[1])) for _, own in _by_length(drawn) for x in [_matrix(own["v"].tolist(), kind)] for t in range(TREES)]
    found = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=f"S{KEY}")
    return found[np.linspace(0, len(found), ranges, endpoint=False).astype(int)[1:]] if len(found) else found


def _places(splitters: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(splitters, _text(keys), side="right")


def _forest(classes: DataFrame, splitters: np.ndarray, kind: str) -> DataFrame:
    """p (range), key, v, least (identifier): each class once in each tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in _by_length(batch):
                x, digests = _matrix(part["v"].tolist(), kind), part["digest"].tolist()
                for tree in range(TREES):
                    keys = _keys(tree, _hashes(x, tree), digests, x.shape[1])
                    yield pd.DataFrame({"p": _places(splitters, keys), "key": [r.tobytes() for r in keys], "v": part["v"].to_numpy(), "least": part["least"].to_numpy()})

    return classes.select("digest", "v", F.get("ids", F.lit(0)).alias("least")).mapInPandas(run, "p int, key binary, v binary, least long")


class _Cells:
    """How many entries of each tree begin with each prefix of up to ``SHALLOW`` symbols."""

    def __init__(self, forest: DataFrame) -> None:
        digits = 2 * HEAD + CELL_BITS // 4
        found = forest.groupBy(F.substring(F.hex(F.substring("key", 1, HEAD + 2)), 1, digits).alias("cell")).count().toPandas()
        self.sums: dict[int, np.ndarray] = {}
        for cell, n in zip(found["cell"], found["count"], strict=True):
            tree, dim, place = int(cell[:2], 16), int(cell[2:10], 16), int(cell[10:], 16)
            self.sums.setdefault(dim, np.zeros((TREES, (1 << CELL_BITS) + 1), dtype=np.int64))[tree, place + 1] = n
        self.sums = {d: x.cumsum(axis=1) for d, x in self.sums.items()}

    def totals(self, x: np.ndarray) -> np.ndarray:
        """(n, SHALLOW + 1): over all trees, the entries that share so many symbols with each row of ``x``."""
        out = np.zeros((len(x), SHALLOW + 1), dtype=np.int64)
        sums = self.sums[x.shape[1]]
        for tree in range(TREES):
            h = _hashes(x, tree).astype(np.int64)
            cell = ((h[:, 0] << 8) | h[:, 1]) >> (16 - CELL_BITS)
            for level in range(SHALLOW + 1):
                rest = CELL_BITS - _bits(level)
                out[:, level] += sums[tree, ((cell >> rest) + 1) << rest] - sums[tree, (cell >> rest) << rest]
        return out


def _met(forest: DataFrame, routed: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work(range's rows, queries)`` for each range p and the queries that ``routed`` sends there.

    Where many go to one range, they are dealt over copies of it, as many as their number asks for.
    """
    salts = F.broadcast(routed.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("salts")))  # a row for each range: MAX_RANGES at most
    asked = routed.join(salts, "p").withColumn("salt", F.pmod(F.xxhash64("q"), F.col("salts"))).drop("salts")
    rows = forest.select("p", *columns).join(salts, "p").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return rows.groupBy("p", "salt").cogroup(asked.groupBy("p", "salt")).applyInPandas(work, schema)


def _deep_totals(asked: DataFrame, forest: DataFrame, splitters: np.ndarray, sizes: np.ndarray, kind: str) -> DataFrame:
    """q and totals: as ``_Cells.totals``, for the levels from ``SHALLOW`` + 1 to the deepest.

    A prefix is an interval of a sorted array, so its count is the rank of its end less that of its beginning. A rank is the rows of all ranges before (``sizes``) and those
    before it in its own range, which are counted there; all of that is a sum.
    """
    before = np.concatenate(([0], np.cumsum(sizes)))
    levels = range(SHALLOW + 1, DEEPEST + 1)
    names = [f"c{i}" for i in levels]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in _by_length(batch):
                x = _matrix(part["v"].tolist(), kind)
                for tree in range(TREES):
                    keys = _keys(tree, _hashes(x, tree), part["q"].tolist(), x.shape[1])
                    ends = np.array([[_places(splitters, y) for y in _bounds(keys, level)] for level in levels])  # level, end, query
                    base = (before[ends[:, 1]] - before[ends[:, 0]]).T.tolist()
                    out = []
                    for i, q in enumerate(part["q"]):
                        key, places = keys[i].tobytes(), np.unique(ends[:, :, i]).tolist()
                        out += [(p, q, key, base[i] if j == 0 else None) for j, p in enumerate(places)]
                    yield pd.DataFrame(out, columns=["p", "q", "key", "base"])

    def count(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries):
            return pd.DataFrame(columns=["q", *names])
        p = int(queries["p"].iloc[0])
        have = np.sort(_text(np.frombuffer(b"".join(rows["key"]), dtype=np.uint8)))
        keys = np.frombuffer(b"".join(queries["key"]), dtype=np.uint8).reshape(-1, KEY)
        out = {"q": queries["q"].to_numpy()}
        base = np.array([[0] * len(names) if b is None else b for b in queries["base"]], dtype=np.int64)
        for j, level in enumerate(levels):
            low, high = _bounds(keys, level)
            ends = np.where(_places(splitters, high) == p, np.searchsorted(have, _text(high), side="right"), 0)
            begins = np.where(_places(splitters, low) == p, np.searchsorted(have, _text(low)), 0)
            out[names[j]] = base[:, j] + ends - begins
        return pd.DataFrame(out)

    routed = asked.select("q", "v").mapInPandas(route, "p int, q binary, key binary, base array<long>")
    found = _met(forest, routed, ["key"], count, "q binary, " + ", ".join(f"{c} long" for c in names))
    return found.groupBy("q").agg(*[F.sum(c).alias(c) for c in names]).select("q", F.array(*names).alias("totals"))


def _sample_neighbours(sample: pd.DataFrame, classes: DataFrame, k: int, kind: str) -> pd.DataFrame:
    """q, v: the k nearest other classes of each vector in ``sample``, by comparison with all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[bytes, list] = {}
        for batch in batches:
            for size, part in _by_length(batch):
                own = sample[sample["v"].map(len) == size]
                if not len(own):
                    continue
                (x, nx), (y, ny) = _lengths(_matrix(part["v"].tolist(), kind)), _lengths(_matrix(own["v"].tolist(), kind))
                near = (y / ny[:, None]) @ (x / nx[:, None]).T
                digests, vectors = part["digest"].tolist(), part["v"].tolist()
                for i, q in enumerate(own["q"]):
                    at = np.argpartition(-near[i], min(k, len(x) - 1))[: k + 1]
                    best[q] = sorted(best.get(q, []) + [(-near[i, j], digests[j], vectors[j]) for j in at if digests[j] != q])[:k]
        yield pd.DataFrame([(q, -s, d, v) for q, rows in best.items() for s, d, v in rows], columns=["q", "s", "digest", "v"])

    found = classes.select("digest", "v").mapInPandas(run, "q binary, s double, digest binary, v binary")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "digest")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "v").toPandas()


def _candidates(asked: DataFrame, classes: DataFrame, forest: DataFrame, splitters: np.ndarray, sizes: np.ndarray, cells: _Cells, k: int, kind: str) -> int:
    """How many entries a search must gather so that the sampled queries meet ``TARGET`` of their true neighbours.

    A neighbour is met at the longest prefix it shares in any tree; so it is missed just if one symbol more already gives enough entries.
    """
    least = TREES * (k + 1)  # then some tree alone gives k + 1 different vectors
    sample = asked.orderBy("q").limit(SAMPLE_QUERIES).toPandas()
    if not len(sample):
        return least
    near = _sample_neighbours(sample, classes, k, kind)
    deep = _deep_totals(asked.sparkSession.createDataFrame(sample, "q binary, v binary"), forest, splitters, sizes, kind).toPandas()
    deep = dict(zip(map(bytes, deep["q"]), deep["totals"], strict=True))
    wants = []
    for _, part in _by_length(sample):
        x = _matrix(part["v"].tolist(), kind)
        for i, (q, shallow) in enumerate(zip(part["q"], cells.totals(x), strict=True)):
            own = near[near["q"] == q]
            if len(own):
                y = _matrix(own["v"].tolist(), kind)
                totals = [*shallow, *deep[bytes(q)], 0]
                equal = [np.unpackbits(_hashes(y, t) ^ _hashes(x[i : i + 1], t), axis=1) for t in range(TREES)]
                same = np.max([np.where(b.any(axis=1), b.argmax(axis=1), BITS) for b in equal], axis=0)
                wants += [int(totals[1 + (s - FIRST_BITS) // 2 + 1 if s >= FIRST_BITS else 1]) + 1 for s in same.tolist()]
    wants.sort()
    return max(least, wants[math.ceil(TARGET * len(wants)) - 1]) if wants else least


def nearest(rows: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``asked`` holds, its own identifier left out, by cosine; ties go to the smaller identifier.

    Each tree is an array of long hash strings, sorted and dealt into ranges. A query descends in every tree to the rows that share its longest prefix, and ascends in
    all trees at once, a symbol at a time, until the prefixes hold enough entries (``_candidates``, set from a bounded sample of queries whose neighbours are known); at
    level 0 all rows are candidates. Every candidate is compared in full, in the task that holds its range, and k + 1 leave it. Scores are cosines in double precision of
    the vectors as they are. Found neighbours do not depend on how Spark deals the rows.

    Vectors that are null, zero or hold a null or a number that is not finite take no part, nor do rows without an identifier. Repeated rows count once; of rows that share an
    identifier but not a vector that with the smallest digest counts. Vectors of different lengths are never neighbours. Equal vectors are searched once and may be each
    other's neighbours. Fewer than ``k`` candidates give as many rows. Other columns are not read; an empty table gives no row. A third of all rows may be near copies
    of one vector: long strings tell them apart, and what queries meet in one range is dealt over copies of it.
    """
    kind = "<f4" if rows.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    marked = rows.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"), asked.alias("_asked"))
    usable = stored(_usable(marked, "_id", "_v", kind), "vectors")
    classes = stored(_classes(usable, k), "vecclasses")
    ids = marked.where("_asked and _id is not null").select(F.col("_id").cast("long").alias("id")).distinct()
    queries = stored(usable.select("id", "digest").join(ids, "id").select(F.col("id").alias("query_id"), F.col("digest").alias("q")), "vecqueries")
    own = classes.select(F.col("digest").alias("q"), "v").join(queries.select("q").distinct(), "q")
    own = stored(own, "vecasked")
    splitters = _splitters(classes, max(1, classes.count()), kind)
    # ranges lie whole in one file each, so a search reads them in few pieces
    forest = stored(_forest(classes, splitters, kind).repartition(shuffle_width(rows.sparkSession), "p"), "forest")
    found = forest.groupBy("p").count().toPandas()
    sizes = np.zeros(len(splitters) + 1, dtype=np.int64)
    sizes[found["p"]] = found["count"]
    cells = _Cells(forest)
    wanted = _candidates(own, classes, forest, splitters, sizes, cells, k, kind)

    def shallow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in _by_length(batch):
                enough = cells.totals(_matrix(part["v"].tolist(), kind)) >= wanted
                enough[:, 0] = True
                level = enough.shape[1] - 1 - enough[:, ::-1].argmax(axis=1)
                yield pd.DataFrame({"q": part["q"].to_numpy(), "v": part["v"].to_numpy(), "level": level})

    levels = stored(own.mapInPandas(shallow, "q binary, v binary, level int"), "veclevels")
    further = levels.where(F.col("level") == SHALLOW)
    if not further.isEmpty():
        deeper = _deep_totals(further, forest, splitters, sizes, kind)
        more = F.size(F.filter("totals", lambda n: n >= wanted))  # totals fall from level to level
        deeper = deeper.select("q", more.alias("more"))
        levels = stored(levels.join(deeper, "q", "left").select("q", "v", (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "veclevels")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in _by_length(batch):
                x = _matrix(part["v"].tolist(), kind)
                qs, vs, levels_of = part["q"].tolist(), part["v"].tolist(), part["level"].to_numpy()
                for tree in range(TREES):
                    keys, out = _keys(tree, _hashes(x, tree), qs, x.shape[1]), []
                    for level in np.unique(levels_of).tolist():
                        if not level and tree:
                            continue  # any one tree has all rows
                        at = np.flatnonzero(levels_of == level)
                        low, high = _bounds(keys[at], level)
                        for i, a, b, lo, hi in zip(at, _places(splitters, low), _places(splitters, high), low, high, strict=True):
                            out += [(p, qs[i], vs[i], lo.tobytes(), hi.tobytes()) for p in range(a, b + 1)]
                    yield pd.DataFrame(out, columns=["p", "q", "v", "low", "high"])

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, part in _by_length(rows) if len(queries) else ():
            asked = queries[queries["v"].map(len) == size]
            if not len(asked):
                continue
            keys = _text(np.frombuffer(b"".join(part["key"]), dtype=np.uint8))
            order = np.argsort(keys)
            keys, least = keys[order], part["least"].to_numpy()[order]
            digests = [x[-16:] for x in part["key"]]
            (x, nx), (y, ny) = _lengths(_matrix(part["v"].tolist(), kind)[order]), _lengths(_matrix(asked["v"].tolist(), kind))
            begins = np.searchsorted(keys, _text(np.frombuffer(b"".join(asked["low"]), dtype=np.uint8)))
            ends = np.searchsorted(keys, _text(np.frombuffer(b"".join(asked["high"]), dtype=np.uint8)), side="right")
            for i, (q, a, b) in enumerate(zip(asked["q"], begins, ends, strict=True)):
                if a == b:
                    continue
                near = (x[a:b] @ y[i]) / nx[a:b]
                n = min(k + 1, b - a)
                border = np.partition(near, b - a - n)[b - a - n]
                at = a + np.flatnonzero(near >= border - 1e-9 * ny[i])
                score = (x[at] * y[i]).sum(axis=1) / (nx[at] * ny[i])  # summed row by row, so it is the same wherever a row is met
                for j in np.lexsort((least[at], -score))[: k + 1]:
                    out.append((q, digests[order[at[j]]], float(score[j]), int(least[at[j]])))
        return pd.DataFrame(out, columns=["q", "digest", "score", "least"])

    routed = stored(levels.mapInPandas(route, "p int, q binary, v binary, low binary, high binary"), "vecroutes")
    met = _met(forest, routed, ["key", "v", "least"], search, "q binary, digest binary, score double, least long")
    met = met.groupBy("q", "digest", "score", "least").agg(F.lit(1).alias("one"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    best = met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("q", "digest", "score")
    best = best.join(classes.select("digest", "ids"), "digest").select("q", "score", F.explode("ids").alias("vec_id"))
    # at most (k + 1) ** 2 for each vector that is asked for
    lists = stored(best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found")), "vecfound")
    discard(forest)
    discard(routed)
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    got = queries.join(lists, "q").select("query_id", F.posexplode(others).alias("at", "x"))
    return got.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
