"""N-gram Jaccard join with multiple-global-order filtering, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import discard, shared_dir, shuffle_width, stored
from corvane.llm.wordhash import chunks, mix, shingles

#: Largest table of survivors of the screen, in bytes, that the driver makes and sends to every executor (``CHOSEN_BYTES`` a row, as measured); a larger one is joined by shuffle.
BROADCAST_BYTES, CHOSEN_BYTES = 8 << 20, 128
#: A key of a join is hot if more rows have it than this, and more than their ``HOT_KEYS``-th part, so no join has more hot keys than that.
HOT_ROWS, HOT_KEYS = 1_000_000, 100_000
#: Rows drawn (about) to find shingles so frequent that one task should not hold them all.
SAMPLE_ROWS = 200_000
#: A block has about so many sets and shingles at most; two blocks are compared in one step of a task.
BLOCK_SETS, BLOCK_SHINGLES = 128, 500_000
#: Rows of a table of links or labels that one file holds, and one task contracts, about.
ROWS_PER_FILE = 100_000
#: Columns of one matrix product.
WIDTH = 4096


def _least(n, num: int, den: int):
    """The least overlap of a set of size n with any partner: ceil(num * n / den)."""
    return -(-num * n // den)


def _screen_size(n: int) -> int:
    """How many common shingles the screen asks for, besides those a partner may lack."""
    return max(1, n // 10)


def _key(s: np.ndarray) -> bytes | None:
    """A 128-bit digest of a set of shingles; none for the empty set."""
    if not len(s):
        return None
    return np.array([mix(s, 5).sum(dtype=np.uint64), mix(s, 6).sum(dtype=np.uint64) ^ np.uint64(len(s))], dtype=np.uint64).tobytes()


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """doc_id, n (set size), key (128-bit digest of the set), low: the first shingles in digest order.

    ``low`` has n - least(n) + screen(n) shingles: two sets that link share at least the smaller screen(n) of them. Of copies that a task meets
    only the first brings its ``low``, the others null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[bytes] = set()
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].tolist()
            for a, b in chunks(texts):
                sizes, keys, lows = [], [], []
                for s, i in zip(shingles(texts[a:b], size), ids.iloc[a:b], strict=True):
                    n, key = len(s), _key(s)
                    sizes.append(n)
                    keys.append(key)
                    first = key is not None and i is not None and key not in met
                    lows.append(s[: n - _least(n, num, den) + _screen_size(n)].view(np.int64) if first else None)
                    if first:
                        met.add(key)
                yield pd.DataFrame({"doc_id": ids.iloc[a:b].array, "n": sizes, "key": keys, "low": lows})

    kind = docs.schema[id_col].dataType
    found = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id string, n long, key binary, low array<long>"  # a string holds null and large numbers alike
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def _hot(lists: DataFrame, column: str) -> list[int]:
    """Shingles that hold more than half of a partition's share of a sample of the arrays in ``column``.

    At most ``2 * width`` can pass, so the list is bounded by the width of the shuffle. Missing one only makes a task larger.
    """
    width = shuffle_width(lists.sparkSession)
    total = lists.agg(F.sum(F.size(column))).first()[0] or 0
    drawn = lists.select(F.explode(column).alias("h")).sample(fraction=min(1.0, SAMPLE_ROWS / max(total, 1)), seed=3)
    least = max(20, min(total, SAMPLE_ROWS) // (2 * width))
    found = drawn.groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(2 * width)
    return [r["h"] for r in found.collect()]


def _hot_keys(counted: DataFrame, key: str, rows: int) -> DataFrame | None:
    """The hot keys of a join, ``HOT_KEYS`` at most, or None: ``counted`` has each key with its number n of rows, and there are at most about ``rows`` rows in all."""
    if rows <= HOT_ROWS:
        return None
    found = stored(counted.where(F.col("n") > max(HOT_ROWS, rows // HOT_KEYS)).select(key).coalesce(1), "hotkeys")
    return None if found.isEmpty() else found


def _apart(values: DataFrame) -> DataFrame:
    """``values`` for a join in which neither side is broadcast.

    Tables of numbers press to a tenth of what their hash tables take, so files within Spark's limit for broadcasts make the driver hold several of 30 to 50 MB at once. What grows
    with the documents is shuffled instead, whatever its files' size.
    """
    return values.hint("merge")


def _looked_up(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame | None, nulls: bool = False) -> DataFrame:
    """``rows`` joined with the one row that ``values`` has for each ``key``; rows without one get nulls.

    The rows of a hot key stay where they are and meet its value by broadcast; only the others are shuffled. With ``nulls``, so do rows with a
    null key, which have no value. ``rows`` may be read twice and should be a stored table then.
    """
    if hot is None and not nulls:
        return rows.join(_apart(values), key, "left")
    if hot is None:
        stays, few = F.col(key).isNull(), values.limit(0)
    else:
        stays, few = F.col(key).isNull() | F.coalesce("_hot", F.lit(False)), values.join(F.broadcast(hot), key, "left_semi")
        rows = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    rest, here = rows.where(~stays).drop("_hot"), rows.where(stays).drop("_hot")
    return rest.join(_apart(values), key, "left").unionByName(here.join(F.broadcast(few), key, "left"))


def _screened(slim: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The classes (key, doc_id) whose ``low`` shares enough shingles with other classes to have a partner at all.

    Rows of a shingle meet once, in one shuffle of two numbers a row, which the count of classes and the join both use; hot shingles, which many
    classes share, need not meet at all. A class that several tasks brought is counted so many times. It is told by a 64-bit digest here: should two
    share one, both only pass more easily.
    """
    cid = F.xxhash64("key").alias("cid")
    brought = slim.where("low is not null")
    rows, hot = brought.select(cid, F.explode("low").alias("h")), _hot(brought, "low")
    cold = (rows.where(~F.col("h").isin(hot)) if hot else rows).repartition("h")
    shared = cold.groupBy("h").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x <> y").select("h")
    met = cold.join(_apart(shared), "h").select("cid")
    if hot:
        met = met.unionByName(rows.where(F.col("h").isin(hot)).select("cid"))
    found = met.groupBy("cid").agg(F.count(F.lit(1)).alias("met"))
    least_partner = F.ceil(F.lit(num) * F.col("n") / F.lit(den))  # the smallest size that a partner can have
    known = classes.select("key", "doc_id", "n", "brought", cid).join(_apart(found), "cid")
    return known.where(F.col("met") / F.col("brought") >= F.greatest(F.lit(1), F.floor(least_partner / F.lit(10)))).select("key", "doc_id")


def _profiles(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Keys by sid (a number for each set), and profiles: sid, n, members (all shingles), and the prefixes first, rare and other under three global orders.

    The orders are: by digest; rarest first (by how many of ``chosen`` have a shingle, then by digest); and by a second digest. Shingles that
    no other set has come first in the second order, take their places in the prefix and are then left out of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                pairs = zip(batch["key"].iloc[a:b], shingles(texts[a:b], size), strict=True)
                found = [(k, s.view(np.int64)) for k, s in pairs if bytes(k) == _key(s)]  # rows may share an identifier
                yield pd.DataFrame(found, columns=["key", "members"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.join(chosen, "doc_id").select("key", "text").mapInPandas(run, "key binary, members array<long>")
    sets = stored(found.withColumn("sid", F.monotonically_increasing_id()), "sets")  # numbered once; repeated rows are sets that link
    rows, hot = sets.select("sid", F.explode("members").alias("h")), _hot(sets, "members")
    cold = (rows.where(~F.col("h").isin(hot)) if hot else rows).repartition("h")
    counted = cold.join(_apart(cold.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")), "h")
    if hot:
        often = rows.where(F.col("h").isin(hot))
        counted = counted.unionByName(often.join(F.broadcast(often.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("df"))), "h"))  # 2 * width rows at most
    # the two lists of a set are filled row by row, so they stay in step
    counted = counted.groupBy("sid").agg(F.collect_list("h").alias("hs"), F.collect_list("df").alias("dfs"))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sid, members, hs, dfs in zip(batch["sid"], batch["members"], batch["hs"], batch["dfs"], strict=True):
                m = np.asarray(members, dtype=np.int64).view(np.uint64)  # ascending
                df = np.ones(len(m), dtype=np.int64)
                df[np.searchsorted(m, np.asarray(hs, dtype=np.int64).view(np.uint64))] = dfs
                p = len(m) - _least(len(m), num, den) + 1
                pre = (np.arange(p), np.lexsort((m, df))[:p], np.argsort(mix(m, 9), kind="stable")[:p])
                first, rare, other = (m[i][df[i] > 1].view(np.int64) for i in pre)
                if len(first) and len(rare) and len(other):
                    out.append((sid, len(m), m.view(np.int64), first, rare, other))
            yield pd.DataFrame(out, columns=["sid", "n", "members", "first", "rare", "other"])

    schema = "sid long, n long, members array<long>, first array<long>, rare array<long>, other array<long>"
    # a partner holds least(n) of a set's shingles, so sets with fewer that any other has are out before their members are fetched
    able = counted.join(_apart(sets.select("sid", F.size("members").alias("n"))), "sid").where(F.size("hs") >= F.ceil(F.lit(num) * F.col("n") / F.lit(den))).drop("n")
    return sets.select("sid", "key"), stored(able.join(_apart(sets.select("sid", "members")), "sid").mapInPandas(prefixes, schema), "profiles")


def _parts(rows: int) -> int:
    """In how many files a narrow table of so many rows is kept."""
    return 1 + rows // ROWS_PER_FILE


def _contracted(links: DataFrame, parts: int) -> DataFrame:
    """Links with the same components, fewer and shorter: each task replaces the links it holds by one from each node to the least node they reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches if len(b)]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b = place[: len(a)], place[len(a) :]
        root, before = np.arange(len(nodes)), None
        while before is None or (root != before).any():
            before = root.copy()
            low = np.minimum(root[a], root[b])
            for end in (a, b):
                np.minimum.at(root, end, low)
                np.minimum.at(root, before[end], low)
            root = root[root]
        at = np.flatnonzero(root != np.arange(len(nodes)))
        yield pd.DataFrame({"a": nodes[at], "b": nodes[root[at]]})

    return links.select("a", "b").where("a <> b").coalesce(parts).mapInPandas(run, "a long, b long")


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root: the least node that ``links`` (a, b) reach from each node. Contraction in tasks, then label propagation with pointer jumping.

    A task contracts about ``ROWS_PER_FILE`` links, twice, the second time those with a common end in one range, or several if they are many; propagation
    joins what different tasks found. Neither the links of one hub nor the nodes of one component meet in one task.
    Each round writes its labels to the shared folder, so a lost executor costs that round only. Rounds grow with the logarithm of
    the longest chain. Nothing but counts comes to the driver. ``rows`` is about how many links there are, if that is known.
    """
    rows = links.count() if rows is None else rows
    parts = _parts(rows)
    short = stored(_contracted(links, parts), "contracted")
    if parts > 1:
        again = stored(_contracted(short.repartitionByRange(parts, "b", "a"), parts), "contracted")
        discard(short)
        short = again
    ways = short.unionByName(short.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    if parts > 1:
        ways = stored(ways.coalesce(parts), "ways")
    labels = ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    known = stored(labels.coalesce(parts), "labels")
    labels = known.select("node", "root")
    hubs = _hot_keys(ways.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b", 2 * rows)
    while True:
        near = _looked_up(ways, labels.select(F.col("node").alias("b"), "root"), "b", hubs).groupBy("a").agg(F.min("root").alias("m"))
        tops = _hot_keys(labels.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", 2 * rows)
        jumped = _looked_up(labels, labels.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", tops)
        lower = F.least("root", "m", F.coalesce("over", "root")).alias("root")
        moved = jumped.join(_apart(near), jumped.node == near.a).select("node", F.col("root").alias("was"), lower)
        moved = stored(moved.coalesce(parts), "labels")
        discard(known)
        known, labels = moved, moved.select("node", "root")
        if moved.where(F.col("root") != F.col("was")).isEmpty():
            discard(short)
            if parts > 1:
                discard(ways)
            return labels


def _cells(profiles: DataFrame) -> DataFrame:
    """sid, cell: the sets that rarest-first prefixes connect, directly or over others. Sets that link are in one cell.

    Each shingle that several sets hold names a hub among them, which it finds by broadcast if they are many.
    """
    posts = profiles.select("sid", F.explode("rare").alias("h"))
    held = profiles.agg(F.sum(F.size("rare"))).first()[0] or 0
    hubs = posts.groupBy("h").agg(F.min("sid").alias("b"), F.count(F.lit(1)).alias("n"))
    hubs = stored(hubs.where("n > 1").coalesce(_parts(held)), "hubs")
    met = _looked_up(posts, hubs.select("h", "b"), "h", _hot_keys(hubs, "h", held))
    edges = met.where("b is not null").select(F.col("sid").alias("a"), "b")
    return components(edges, held).select(F.col("node").alias("sid"), F.col("root").alias("cell"))


def _common(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """How many members the sets before and after ``cut`` have in common, pair by pair, from products of 0-1 matrices of bounded width."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # members of one set only have no column
    use = np.flatnonzero(times[place] > 1)
    owner, place = owner[use], column[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((cut, len(sets) - cut), dtype=np.int64)
    width = int(place[-1]) + 1 if len(place) else 0
    for begin in range(0, width, WIDTH):
        a, b = np.searchsorted(place, (begin, begin + WIDTH))
        held = np.zeros((len(sets), min(WIDTH, width - begin)), dtype=np.float32)
        held[owner[a:b], place[a:b] - begin] = 1
        out += (held[:cut] @ held[cut:].T).astype(np.int64)
    return out


def _joined(left: pd.DataFrame, right: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and of ``right`` that connect more of them: at most one fewer than there are rows.

    Pairs of one label are connected already. A candidate's sizes fit and it shares a prefix shingle under each of the three orders; only candidates are
    compared in full.
    """
    cut, both = len(left), pd.concat([left, right], ignore_index=True)
    n, label, sid = (both[c].to_numpy() for c in ("n", "label", "sid"))
    fits = den * np.minimum.outer(n[:cut], n[cut:]) >= num * np.maximum.outer(n[:cut], n[cut:])
    fits &= np.not_equal.outer(label[:cut], label[cut:])
    for order in ("rare", "first", "other"):
        if not fits.any():
            return []
        fits &= _common(both[order].tolist(), cut) > 0
    rows, cols = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
    if not len(rows):
        return []
    members = both["members"].tolist()
    same = _common([members[i] for i in rows] + [members[cut + j] for j in cols], len(rows))
    near = fits[np.ix_(rows, cols)] & (den * same >= num * (n[rows][:, None] + n[cut + cols][None, :] - same))
    root = {x: x for x in label.tolist()}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = rows[i], cut + cols[j]
        x, y = top(label[a]), top(label[b])
        if x != y:
            root[x] = y
            out.append((int(sid[a]), int(sid[b])))
    return out


def _compared(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) found within each group of ``dealt``: cell, i, j (numbers of two blocks), block (which one a row is of), label and the profile.

    Groups of one block are compared with themselves. A group is two blocks, so a task holds few sets at a time, and links leave it, never pairs.
    """

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        group = pd.concat(held, ignore_index=True)
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        found = _joined(group, group, num, den) if i == j else _joined(group[group["block"] == i], group[group["block"] == j], num, den)
        return pd.DataFrame(found, columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for batch in batches:
            for key, rows in batch.groupby(["cell", "i", "j"], sort=False):  # rows come in order, so a group may only go on in the next batch
                if key != last and held:
                    yield flush(held)
                    held = []
                held.append(rows)
                last = key
        if held:
            yield flush(held)

    spread = dealt.repartition(shuffle_width(dealt.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    columns = ["cell", "i", "j", "block", "label", "sid", "n", "members", "first", "rare", "other"]
    return spread.select(*columns).mapInPandas(run, "a long, b long")


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    return sets.join(_apart(components(links).select(F.col("node").alias("sid"), "root")), "sid", "left").withColumn("label", F.coalesce("root", "sid")).drop("root")


def _block(blocks: str, seed: int) -> Column:
    return F.pmod(F.xxhash64("sid", F.lit(seed)), F.col(blocks)).cast("int")


def _all_links(profiles: DataFrame, num: int, den: int) -> DataFrame:
    """Links that connect all that any links connect.

    Sets that link are in one cell. A cell is dealt into blocks at random, and each block is compared with itself: small cells are one block and done
    with that. Large ones are dealt anew once, so that what links widely gets one label. In cells that still have several labels, the sets outside
    the largest label are compared with all others, block by block: pairs within the largest label are connected already, and no other pair is left out.
    """
    narrow = _parts(profiles.count())
    cells = stored(_cells(profiles), "cells")
    sizes = cells.join(_apart(profiles.select("sid", "n")), "sid").groupBy("cell").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")
    rows = cells.join(_apart(sizes.select("cell", blocks)), "cell").select("sid", "cell", "blocks", F.col("sid").alias("label"))
    rows = stored(rows.coalesce(narrow), "setblocks")

    def within(rows: DataFrame, seed: int) -> DataFrame:
        own = _block("blocks", seed)
        dealt = rows.select("sid", "cell", "label", own.alias("block"), own.alias("i"), own.alias("j"))
        return stored(_compared(dealt.join(_apart(profiles), "sid"), num, den), "links")

    def still_open(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The sets of large cells with several labels, with their labels by ``links``."""
        rows = stored(_labelled(rows.where("blocks > 1").drop("label"), links).coalesce(narrow), "setlabels")
        several = rows.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("cell")
        return stored(rows.join(_apart(several), "cell").coalesce(narrow), "setlabels")

    links = within(rows, 0)
    rows = still_open(rows, links)
    if rows.isEmpty():
        return links
    links = stored(links.unionByName(within(rows, 1)).coalesce(narrow), "links")
    rows = still_open(rows, links)
    parts = rows.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("sets"))
    whole = parts.groupBy("cell").agg(F.sum("sets").alias("all"), F.max(F.struct("sets", "label")).alias("most")).where(F.col("all") > F.col("most.sets"))
    rest = rows.join(_apart(whole.select("cell", F.col("most.label").alias("largest"), F.col("most.sets").alias("most"), "all")), "cell")
    # blocks 0 .. outer - 1 hold the sets outside the largest label, the following ones the sets within
    share = F.col("blocks") / F.col("all")
    rest = rest.withColumn("outer", F.ceil(share * (F.col("all") - F.col("most"))).cast("int")).withColumn("inner", F.ceil(share * F.col("most")).cast("int"))
    inside = F.col("label") == F.col("largest")
    rest = rest.withColumn("block", F.when(inside, F.col("outer") + _block("inner", 2)).otherwise(_block("outer", 2)))
    others = F.sequence(F.lit(0), F.when(inside, F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1))
    rest = rest.withColumn("with", F.explode(others))
    dealt = rest.select("sid", "cell", "label", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    return links.unionByName(stored(_compared(dealt.join(_apart(profiles), "sid"), num, den), "links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``: the components of links between similar texts.

    A text's set has its distinct shingles of ``size`` words, A-Z lower-cased; two texts link when den * common >= num * union. A row's
    component_id is the least identifier that links reach. Texts without words, null texts and rows with a null
    identifier link with nothing and stand alone. Equal sets are one class from the start, so copies cost one
    comparison; repeated rows and rows that share an identifier each get their row. Other columns of ``docs`` are not read.
    Shingles are compared by 64-bit digests.

    1. Screen (first order, by digest): a class without enough common shingles among its first ones has no partner.
    2. Of what is left, prefixes under three global orders; the rarest-first ones part the sets into cells.
    3. Within cells, pairs that share a prefix shingle under each of the three orders are compared in full, in blocks; links give components.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    wide = stored(_sets(docs, id_col, text_col, size, num, den), "shinglesets")
    slim = stored(wide.select("doc_id", "n", "key"), "setkeys")
    usable = wide.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("key")
    classes = usable.agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.count("low").alias("brought"))
    classes = stored(classes, "classes")
    chosen = stored(_screened(wide, classes, num, den), "chosen")
    discard(wide)
    chosen = F.broadcast(chosen) if chosen.count() * CHOSEN_BYTES <= BROADCAST_BYTES else chosen.hint("shuffle_hash")  # else the texts would be sorted
    # the identifier finds the text again; where rows share it, the digest of the set says which one is meant
    keys, profiles = _profiles(docs, chosen, id_col, text_col, size, num, den)
    roots = components(_all_links(profiles, num, den))
    roots = stored(keys.join(_apart(roots), F.col("sid") == F.col("node")).groupBy("key").agg(F.min("root").alias("root")), "roots")
    discard(profiles)
    known = classes.join(_apart(roots), "key", "left").where("copies > 1 or root is not null").select("key", "root", "doc_id")
    all_rows = slim.count()
    known = stored(known.coalesce(_parts(all_rows)), "known")
    least = known.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    least = stored(least.coalesce(_parts(all_rows)), "leastids")
    known = _looked_up(known, least.select("root", "least"), "root", _hot_keys(least, "root", all_rows), nulls=True)
    known = known.select("key", F.coalesce("least", "doc_id").alias("component_id"))
    hot = _hot_keys(classes.select("key", F.col("copies").alias("n")), "key", all_rows)
    rows = _looked_up(slim, known, "key", hot, nulls=True)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
