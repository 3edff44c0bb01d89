"""Exact n-gram Jaccard join by size-banded tiles and hashed bitmaps (after Sandes, Teodoro and Melo, 2020).

Documents with equal shingle sets are one node. A node enters the tiles of its rarest shingles, as
many as two similar sets need to meet in one of them, and of its own band of sizes and the next one.
Each node has a bitmap in which every shingle flips the bit that its hash names; two bitmaps that
differ in d bits belong to sets that differ in at least d shingles, which bounds the overlap from
above. Pairs that the bound leaves are compared exactly, as sorted arrays. Hot tiles are cut into
blocks, of which any two meet in a tile of their own.

For components, nodes meet first at one centre of each tile of a few small hashes, so that a family
of near copies is one component after work in proportion to its size; then only tiles of several
components are compared, and in them only pairs of different ones.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, look_up, map_batches, materialize
from .components import connected_components
from .superminhash import PERCENT, WORDS, Shingler, mix

#: Counters of shingles by hash, and how many of them go in one row. A table of fixed size for any
#: input: it only sets the order in which shingles count as rare, which every order would do exactly.
COUNTERS, CHUNK = 1 << 20, 1 << 12
#: Smallest hashes of a set, in whose tiles it meets a centre. A set with a similarity of 0.8 to the
#: centre of its family misses it with probability 0.2 ** 5; the tiles of rare shingles find it then.
STARS = 5
#: Members of a block of a tile.
BLOCK = 512
#: 64-bit words of bitmaps that are compared at once.
AT_ONCE = 1 << 20


def need(n, m, percent: int):
    """Shingles that sets of n and m must share: the least whole number from ``percent * (n + m) / (100 + percent)`` on."""
    return -(-percent * (n + m) // (100 + percent))


def reach(n: int, percent: int) -> int:
    """How many of its rarest shingles a set looks for smaller and equal ones by; in the first ones of them larger sets find it."""
    return n - need(n, -(-percent * n // 100), percent) + 1


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit a shingle or more, a power of two of 64-bit words; each shingle flips the bit of its hash."""
    words = 1 << max(0, math.ceil(math.log2(max(1, len(shingles)) / 64)))
    bits = np.bincount((mix(shingles) & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


class Bitmaps:
    """Many bitmaps, of which pairs are compared at once."""

    def __init__(self, packed):
        self.words = np.frombuffer(b"".join(packed), np.uint64)
        self.size = np.array([len(p) // 8 for p in packed], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def _taken(self, rows: np.ndarray, size: int, to: int) -> np.ndarray:
        """The bitmaps of these rows, folded: what a shingle flips in a long bitmap it flips at the same place, modulo its size, in a short one."""
        words = self.words[self.start[rows][:, None] + np.arange(size)]
        return words if size == to else np.bitwise_xor.reduce(words.reshape(len(rows), size // to, to), axis=1)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits by which the bitmaps of rows x and y differ."""
        out = np.zeros(len(x), np.int64)
        kinds = self.size[x] << 32 | self.size[y]
        for kind in np.unique(kinds):
            at, sx, sy = np.flatnonzero(kinds == kind), int(kind >> 32), int(kind & 0xFFFFFFFF)
            step = max(1, AT_ONCE // max(sx, sy))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                to = min(sx, sy)
                out[some] = np.bitwise_count(self._taken(x[some], sx, to) ^ self._taken(y[some], sy, to)).sum(axis=1)
        return out


# --- counting and nodes ------------------------------------------------------------------------


def _counted(words: int):
    """Each document's set by its hash, and at the end of the task its counters, as packed chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, counters = Shingler(words), np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            whole = np.concatenate([*sets, np.empty(0, np.uint64)])
            counters += np.bincount((whole >> np.uint64(44)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "n": [len(s) for s in sets], "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "chunk": None, "counts": None})
        chunks = counters.reshape(-1, CHUNK)
        full = np.flatnonzero(chunks.any(axis=1))
        yield pd.DataFrame({"doc_id": None, "text_key": None, "n": None, "node": None, "chunk": full, "counts": [zlib.compress(chunks[i].tobytes(), 1) for i in full]})

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counters of all tasks, chunk by chunk, as levels of one byte: eight to a doubling."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch["chunk"], batch["counts"], strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
    levels = [np.minimum(255, 8 * np.log2(1.0 + c)).astype(np.uint8).tobytes() for c in total.values()]
    yield pd.DataFrame({"chunk": list(total), "levels": levels}, columns=["chunk", "levels"])


def _noded(words: int, percent: int, shared):
    """Texts to nodes: bitmap, smallest hashes, and the rarest shingles in the order of rising level, then hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, levels = Shingler(words), shared.value
        for batch in batches:
            rows = []
            for doc_id, text_key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
                s = shingles(text)
                in_order = s[np.lexsort((s, levels[(s >> np.uint64(44)).astype(np.int64)]))]
                rare, stars = in_order[: reach(len(s), percent)], np.sort(mix(s))[:STARS]
                rows.append((doc_id, text_key, xxhash.xxh3_128_digest(s.tobytes()), len(s), bitmap(s).tobytes(), stars.view(np.int64), rare.view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "node", "n", "bits", "stars", "rare"])

    return run


def _key(doc_id) -> Column:
    return F.coalesce(doc_id, F.lit(-(2**63)))


class Sets:
    """The documents of a table with their sets' names, and one row for each distinct set."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.words, self.percent = words, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
        self.sketch = materialize(map_batches(self.docs, _counted(words), "doc_id long, text_key long, n long, node binary, chunk int, counts binary"), "sketch")
        chunks = self.sketch.where("chunk is not null").select("chunk", "counts").repartition("chunk")
        levels = np.zeros(COUNTERS, np.uint8)
        for r in map_batches(chunks, _summed, "chunk int, levels binary").collect():
            levels[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["levels"], np.uint8)
        self.each = self.sketch.where("chunk is null").select("doc_id", "n", "node", "text_key")
        members = self.each.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("doc"), F.count("*").alias("members"))
        self.members = materialize(members, "members")
        shared = docs.sparkSession.sparkContext.broadcast(levels)
        texts = self._texts(self.members.select("first.doc_id", "first.text_key"))
        nodes = map_batches(texts, _noded(words, percent, shared), "doc_id long, text_key long, node binary, n long, bits binary, stars array<long>, rare array<long>")
        # Rows that repeat in id and text give a node twice; its rows have equal sets and one component.
        self.nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")

    def _texts(self, keys: DataFrame) -> DataFrame:
        """The documents of these ids and texts, with all further columns of ``keys``."""
        keys = keys.withColumn("id", _key(F.col("doc_id"))).drop("doc_id")
        return self.docs.withColumn("id", _key(F.col("doc_id"))).join(keys, ["id", "text_key"]).drop("id")

    def close(self) -> None:
        discard(self.sketch, self.members, self.nodes)

    # --- comparing ---

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that the bitmaps leave."""
        nodes = self.nodes.select("nid", "n", "bits")
        rows = _attached(_attached(pairs, nodes, "a", pairs), nodes, "b", pairs)
        return map_batches(rows, _bounded(self.percent), "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` whose whole sets are similar enough; the sets are made again from the texts of those that are asked for."""
        asked = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
        texts = self._texts(self.nodes.join(asked, "nid").select("nid", "doc_id", "text_key"))
        sets = materialize(map_batches(texts, _sets(self.words), "nid long, shingles array<long>").dropDuplicates(["nid"]), "sets")
        rows = _attached(_attached(pairs, sets, "a", pairs), sets, "b", pairs)
        out = materialize(map_batches(rows, _verified(self.percent), "a long, b long, overlap long, n_union long"), "links")
        discard(sets)
        return out

    def met_at_centres(self) -> DataFrame:
        """Pairs ``(a, b)`` of a member of a tile of small hashes and its centre, that with most neighbours in its tiles."""
        stars = self.nodes.select("nid", F.explode("stars").alias("star"))
        tiles = materialize(stars.groupBy("star").agg(F.count("*").alias("members")).where("members > 1"), "tiles")
        total = self.nodes.count() * STARS
        mine = materialize(look_up(stars, tiles.withColumn("found", F.col("members")), "star", total).where("found is not null"), "stars")
        score = mine.groupBy("nid").agg(F.sum("found").alias("score"))
        centres = mine.join(score, "nid").groupBy("star").agg(F.max(F.struct("score", "nid")).alias("c"), F.count("*").alias("members")).select("star", F.col("c.nid").alias("b"), "members")
        centres = materialize(centres, "centres")
        pairs = materialize(look_up(mine.select("nid", "star"), centres, "star", total).where("nid <> b").select(F.col("nid").alias("a"), "b").distinct(), "pairs")
        discard(tiles, mine, centres)
        return pairs

    def met_in_tiles(self, roots: DataFrame | None = None) -> DataFrame:
        """All pairs ``(a, b)`` that may be similar enough, of different roots in ``roots(node, root)`` if that is given."""
        named = self.nodes.select("nid", "n", "rare") if roots is None else self.nodes.select("nid", "n", "rare").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
        named = named.withColumn("root", F.col("nid") if roots is None else F.coalesce("root", "nid"))
        posts = named.select("nid", "n", "root", F.posexplode("rare").alias("place", "s"))
        tiles = posts.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("s", "members")
        tiles = materialize(tiles.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), "tiles")
        size = self.nodes.agg(F.sum(F.size("rare"))).first()[0] or 0
        live = materialize(look_up(posts, tiles, "s", size).where("blocks is not null"), "posts")
        # Sizes of a ratio of at most 100 to percent lie in one band or in two that are next to each other.
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.percent * 1.0001)) if self.percent < 100 else F.col("n")
        live_bits = live.join(self.nodes.select("nid", "bits"), "nid")
        banded = live_bits.withColumn("block", F.pmod(F.xxhash64("nid"), "blocks").cast("int")).withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band + F.col("up"))
        tile = banded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        rows = tile.select("s", "band", "i", "j", "up", "block", "nid", "root", "n", "place", "bits")
        keys = ["s", "band", "i", "j"]
        met = map_batches(rows.repartition(*keys).sortWithinPartitions(*keys, "nid"), _tiled(self.percent), "a long, b long")
        pairs = materialize(met.distinct(), "pairs")
        discard(tiles, live)
        return pairs


def _attached(rows: DataFrame, table: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """``rows`` of ``pairs`` with the columns of ``table(nid, ...)`` for their ``key``, named after it.

    The few keys with many pairs are broadcast, a row each; the others are shuffled to.
    """
    sizes = pairs.groupBy(key).agg(F.count("*").alias("members"))
    columns = [F.col(c).alias(f"{c}_{key}") for c in table.columns if c != "nid"]
    one = table.select(F.col("nid").alias(key), *columns).join(sizes, key)
    return look_up(rows, one, key, pairs.count())


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(words)
        for batch in batches:
            yield pd.DataFrame({"nid": batch["nid"], "shingles": [shingles(t).view(np.int64) for t in batch["text"]]})

    return run


def _bounded(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, m = batch["n_a"].to_numpy(np.int64), batch["n_b"].to_numpy(np.int64)
            maps = Bitmaps([*batch["bits_a"], *batch["bits_b"]])
            apart = maps.apart(np.arange(len(n)), np.arange(len(n)) + len(n))
            yield batch.loc[(n + m - apart) // 2 >= need(n, m, percent), ["a", "b"]]

    return run


def _verified(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(batch["shingles_a"], batch["shingles_b"], strict=True)]
            union = [len(a) + len(b) - k for a, b, k in zip(batch["shingles_a"], batch["shingles_b"], both, strict=True)]
            out = batch[["a", "b"]].assign(overlap=both, n_union=union)
            yield out[[100 * k >= percent * u for k, u in zip(both, union, strict=True)]]

    return run


def _compared(rows: pd.DataFrame, tile: np.ndarray, percent: int) -> pd.DataFrame:
    """The pairs of rows of one tile that size, place and bitmap leave; ``tile`` numbers the tiles, in order."""
    nid, root, n, place, block, up = (rows[c].to_numpy(np.int64) for c in ("nid", "root", "n", "place", "block", "up"))
    two_blocks = rows["i"].to_numpy(np.int64) != rows["j"].to_numpy(np.int64)
    maps = Bitmaps(rows["bits"].tolist())
    found = []
    for step in range(1, len(rows)):
        x = np.flatnonzero(tile[step:] == tile[:-step])
        if not len(x):
            break
        y = x + step
        # Of two blocks only pairs across; of two bands only those with the upper one, which is this tile's own.
        fit = (root[x] != root[y]) & (nid[x] != nid[y]) & ((up[x] == 0) | (up[y] == 0)) & (~two_blocks[x] | (block[x] != block[y]))
        x, y = x[fit], y[fit]
        low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        fit = (100 * low >= percent * high) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= need(n[x], n[y], percent))
        x, y = x[fit], y[fit]
        fit = (n[x] + n[y] - maps.apart(x, y)) // 2 >= need(n[x], n[y], percent)
        found.append(np.stack([np.minimum(nid[x[fit]], nid[y[fit]]), np.maximum(nid[x[fit]], nid[y[fit]])], axis=1))
    pairs = np.unique(np.concatenate([*found, np.empty((0, 2), np.int64)]), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _tiled(percent: int):
    """Rows by tile to pairs; a tile that goes on in the next frame waits for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, waiting = ["s", "band", "i", "j"], []

        def out(rows: pd.DataFrame, numbers: np.ndarray) -> pd.DataFrame:
            return _compared(rows.reset_index(drop=True), numbers, percent)

        for batch in batches:
            rows = pd.concat([*waiting, batch], ignore_index=True) if waiting else batch
            new = (rows[keys].to_numpy(np.int64)[1:] != rows[keys].to_numpy(np.int64)[:-1]).any(axis=1)
            numbers = np.concatenate([[0], np.cumsum(new)])
            done = int((numbers < numbers[-1]).sum())
            if done:
                yield out(rows.iloc[:done], numbers[:done])
            waiting = [rows.iloc[done:]]
        if waiting:
            yield out(waiting[0], np.zeros(len(waiting[0]), np.int64))

    return run


# --- results -----------------------------------------------------------------------------------


def similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and who has which set: ``(a, b, overlap, n_union)`` and ``(doc_id, n_shingles, node)``.

    ``a`` and ``b`` name sets as ``node`` does, ``a < b``; each linked pair comes once. Documents
    with one ``node`` have equal sets; their copies are not expanded. A document without shingles
    has a null node. See :func:`components` for what a set is.
    """
    sets = Sets(docs, words, percent)
    pairs = sets.met_in_tiles()
    links = sets.verified(pairs)
    names = sets.nodes.select("nid", "node")
    a, b = (names.select(F.col("nid").alias(k), F.col("node").alias(f"node_{k}")) for k in ("a", "b"))
    named = links.join(a, "a").join(b, "b").where("node_a <> node_b")
    out = named.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), "overlap", "n_union").distinct()
    return out, sets.each.select("doc_id", F.col("n").alias("n_shingles"), "node")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, component_id)``, one row a document.

    A document's set holds its distinct shingles of ``words`` lower-cased (A-Z) words; a shorter
    text is one shingle. Two documents are linked when ``100 * intersection >= percent * union``.
    ``component_id`` is the smallest doc_id that links reach. The join is exact; shingles are
    compared by 64-bit and equal sets by 128-bit hashes.

    A null or empty text, or one of white space, has no shingle and no link and keeps its own id. A
    repeated row gives repeated result rows. A row without doc_id links too; its ``component_id``
    is the smallest id in its component, null if there is none. Other columns are ignored. An
    empty table gives an empty result.
    """
    sets = Sets(docs, words, percent)
    pairs = sets.met_at_centres()
    near = materialize(sets.bounded(pairs), "near")
    links = sets.verified(near)
    roots = materialize(connected_components(links.select("a", "b")), "roots")
    discard(pairs, near)
    pairs = sets.met_in_tiles(roots)
    if pairs.limit(1).count():
        more = sets.verified(pairs)
        discard(roots)
        roots = materialize(connected_components(links.select("a", "b").unionByName(more.select("a", "b"))), "roots")
        discard(more)
    discard(pairs, links)
    placed = sets.nodes.select("nid", "node").join(roots.withColumnRenamed("node", "nid"), "nid", "left").groupBy("node").agg(F.min(F.coalesce("root", "nid")).alias("root"))
    named = materialize(sets.members.select("node", "doc", "members").join(placed, "node"), "named")
    lowest = named.groupBy("root").agg(F.min("doc").alias("low"))
    low = materialize(named.join(lowest, "root").select("node", "members", "low"), "lowest")
    full = look_up(sets.each.where("node is not null"), low, "node", sets.each.count())
    bare = sets.each.where("node is null").withColumn("low", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id")]
    discard(roots, named)
    return full.select(*columns).unionByName(bare.select(*columns))
