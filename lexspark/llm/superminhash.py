"""Near-duplicate detection with SuperMinHash signatures (Ertl, 2017).

Path: shingle sets -> one row per distinct set -> SuperMinHash -> banding -> exact verification ->
union-find and contraction. Copies of a set are one node, so a group of exact copies costs one row
however large it is. In a bucket every member is compared with one centre, so a bucket of n members
gives n links to verify and not n * n; members that are still apart afterwards meet where they share a
shingle that is rare among them, by prefix filtering, which loses no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, look_up, map_batches, materialize
from .components import connected_components

#: Bands times rows give the signature's length. At a similarity of 0.85 a pair shares no band
#: with probability (1 - 0.85 ** 7) ** 36 < 1e-6; at 0.8 with (1 - 0.8 ** 7) ** 36 = 2e-4.
BANDS, ROWS = 36, 7
#: Words of a shingle and the similarity in percent, unless a contract says otherwise.
WORDS, PERCENT = 5, 80
#: Ratio of the sizes in a class of sets.
CLASS = 1.02
#: Shingles that one vectorised pass holds; bounds the memory of the rank permutations.
PASS = 30_000
#: Steps whose swaps are looked up one by one before whole permutations are laid out.
LAZY = 8

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of the splitmix64 generator), element by element."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes; remembers the hashes of words it has seen."""

    def __init__(self, words: int, remembered: int = 100_000):
        self.words, self.remembered, self.seen = words, remembered, {}

    def __call__(self, text: str | None) -> np.ndarray:
        parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not parts:
            return np.empty(0, np.uint64)
        seen = self.seen
        if len(seen) > self.remembered:
            seen.clear()
        for w in set(parts):
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, parts), np.uint64, len(parts))
        k = min(self.words, len(parts))
        out = mix(h[: len(h) - k + 1] + _STEP)
        for i in range(1, k):
            out = mix(out + h[i : len(h) - k + 1 + i] * _STEP)
        if k < self.words:  # a whole short text: its own kind of shingle
            out = mix(out + np.uint64(k))
        return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` 32-bit ranks for each non-empty set.

    Each element draws a random permutation of the ``m`` slots, step by step; at step j it offers
    rank j plus a fraction to the slot that its permutation has there. All elements take step j
    before any takes step j + 1. After step j a filled slot holds a value below j + 1 that no later
    step can lower, so a set is done as soon as its slots are filled: the early stop of the paper,
    with the same signature as its element-by-element loop.
    """
    out = np.full((len(sets), m), np.inf)
    if not sets:
        return np.zeros((0, m), np.uint32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    state = mix(np.concatenate(sets) + _STEP)
    flat = out.reshape(-1)
    drawn: list[np.ndarray] = []  # the position that each earlier step swapped with its own
    moved: list[np.ndarray] = []  # the slot that it moved there
    order: np.ndarray | None = None  # whole permutations, once few elements are left
    for j in range(m):
        state = mix(state + _STEP)
        k = j + ((state >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot, here = k.copy(), np.full(len(k), j)
            for was, put in zip(drawn, moved, strict=True):
                np.copyto(slot, put, where=was == k)
                np.copyto(here, put, where=was == j)
        else:
            at = np.arange(len(k))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
        np.minimum.at(flat, owner * m + slot, j + (state & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32)
        if j == m - 1 or (done := ~np.isinf(out).any(axis=1)).all():
            break
        keep = ~done[owner]
        owner, state = owner[keep], state[keep]
        if order is not None:
            order = order[keep] if not keep.all() else order
            continue
        drawn, moved = [x[keep] for x in (*drawn, k)], [x[keep] for x in (*moved, here)]
        if j == LAZY:
            order = np.tile(np.arange(m, dtype=np.uint16), (len(owner), 1))
            at = np.arange(len(owner))
            for was, put in zip(drawn, moved, strict=True):
                order[at, was] = put
    whole = np.floor(out)
    return (mix(whole.astype(np.uint64) << np.uint64(32) | ((out - whole) * 2.0**32).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, the band's number included."""
    part = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key + part[:, :, r] * _STEP)
    return key.view(np.int64)


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(words)
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            bucket: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            start = 0
            while start < len(full):
                end, size = start, 0
                while end < len(full) and (end == start or size + len(sets[full[end]]) <= PASS):
                    size += len(sets[full[end]])
                    end += 1
                got = band_keys(signatures([sets[i] for i in full[start:end]], bands * rows), bands, rows)
                for i, row in zip(full[start:end], got, strict=True):
                    bucket[i] = row
                start = end
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "n_shingles": [len(s) for s in sets], "node": keys, "bands": bucket})

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(words)
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame({"node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return run


def _verified(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for a, b in zip(batch["sa"], batch["sb"], strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.loc[ok, ["a", "b"]]

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), _verified(percent), "a binary, b binary")


def sharing_rare(sets: DataFrame, percent: int) -> DataFrame:
    """``sets(node, shingles, n, root)`` to all pairs ``(a, b)`` of different roots that may be similar enough.

    Prefix filtering: in the order of rising document frequency, two sets of n and m shingles that
    share ``need(n, m)`` of them share one of the first n - need + 1 of one and m - need + 1 of the
    other, and after the first that they share both have enough left. So only sets that share a
    rare shingle meet, and members of a family whose edits differ do not. Sizes go in classes of
    :data:`CLASS`, and the larger set of a pair looks for the smaller one in each class that may
    have it, since the bound is close only for known sizes.
    """
    n = F.col("n")
    need = lambda x, y: F.ceil(percent * (x + y) / (100 + percent))
    size_class = lambda x: F.floor(F.log(x.cast("double")) / math.log(CLASS))
    rows = materialize(sets.select("node", "n", "root", F.explode("shingles").alias("s")), "shingles")
    # A shingle of one set only is first in the order and meets nothing: it only moves the places of the others.
    seen = rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    seen = materialize(seen.withColumn("members", F.col("df")), "frequencies")
    known = look_up(rows, seen, "s", rows.count()).where("df is not null")
    ordered = known.groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("known"))
    ordered = materialize(ordered.withColumn("own", n - F.size("known")).where(F.col("own") <= n - F.ceil(percent * n / 100)), "ordered")
    # The places up to a length, counted with the set's own shingles before the known ones.
    first = lambda length: F.slice(F.transform("known", lambda x, i: F.struct((i + F.col("own")).alias("place"), x["s"].alias("s"))), F.lit(1), F.greatest(F.lit(0), length - F.col("own")).cast("int"))
    small = ordered.select("node", "n", "root", size_class(n).alias("class"), F.explode(first(n - need(n, n) + 1)).alias("at"))
    least = F.ceil(percent * n / 100)
    looked = ordered.withColumn("class", F.explode(F.sequence(size_class(least), size_class(n))))
    floor_of = F.greatest(least, F.floor(F.pow(F.lit(CLASS), F.col("class"))) - 1)
    large = looked.select("node", "n", "root", "class", F.explode(first(n - need(n, floor_of) + 1)).alias("at"))
    columns = ["node", "n", "root", F.col("at.s").alias("s"), "class", F.col("at.place").alias("place")]
    keys = materialize(small.select(*columns, F.lit(0).alias("role")).unionByName(large.select(*columns, F.lit(1).alias("role"))), "keys")
    met = keys.groupBy("s", "class").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("role").alias("r0"), F.max("role").alias("r1")).where("lo <> hi and r0 < r1").select("s", "class")
    live = materialize(keys.join(met, ["s", "class"], "left_semi"), "met")
    x, y = (live.where(F.col("role") == i).select("s", "class", *(F.col(c).alias(f"{c}{i}") for c in ("node", "n", "root", "place"))) for i in (0, 1))
    order = (F.col("n0") < F.col("n1")) | ((F.col("n0") == F.col("n1")) & (F.col("node0") < F.col("node1")))
    enough = F.least(F.col("n0") - F.col("place0"), F.col("n1") - F.col("place1")) >= need(F.col("n0"), F.col("n1"))
    pairs = materialize(x.join(y, ["s", "class"]).where((F.col("root0") != F.col("root1")) & order & enough).select(F.col("node0").alias("a"), F.col("node1").alias("b")).distinct(), "pairs")
    discard(rows, seen, ordered, keys, live)
    return pairs


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, text_key, n_shingles, class, component_id)``, one row a document.

    ``text_key`` is a hash of the text; ``class`` names the group of linked documents, with or
    without ids, and is null for a document without shingles. See :func:`near_duplicates`.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketch = materialize(map_batches(docs, _sketch(words, bands, rows), "doc_id long, text_key long, n_shingles long, node binary, bands array<long>"), "sketch")
    nodes = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("members"))
    reps = sketch.where("node is not null").dropDuplicates(["node"]).select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = reps.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    member = materialize(reps.join(shared, "band"), "members")
    mine = member.select("node").distinct()
    # One text for each node in a shared bucket; the sets are made again from the text, so that they are not kept for all documents.
    chosen = sketch.select("doc_id", "node").join(mine, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"))).alias("s")).select(F.col("s.doc_id").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))).join(chosen, "doc_id", "left_semi")
    sets = materialize(map_batches(texts, _sets(words), "node binary, shingles array<long>").where("node is not null").dropDuplicates(["node"]), "sets")

    # First round: each bucket's centre is the member that meets most others in its buckets.
    score = member.groupBy("node").agg(F.sum("members").alias("score"))
    scored = member.join(score, "node")
    centre = scored.groupBy("band").agg(F.max(F.struct("score", "node")).alias("c")).select("band", F.col("c.node").alias("b"))
    star = member.join(centre, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    links = materialize(_verify(star, sets, percent), "links")
    roots = materialize(connected_components(links), "roots")

    # Second round: members of one bucket that are still apart.
    placed = member.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    apart = lambda df: df.join(df.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band"), "band", "left_semi")
    rest = materialize(apart(placed).select("node", "n", "root").distinct(), "apart")
    if rest.limit(1).count():
        pairs = sharing_rare(sets.join(rest, "node"), percent)
        more = materialize(_verify(pairs, sets, percent), "links")
        if more.limit(1).count():
            discard(roots)
            roots = materialize(connected_components(links.unionByName(more)), "roots")
        discard(pairs, more)
    discard(member, sets, links, rest)

    named = nodes.select("node", "doc", "members").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    lowest = named.where("root is not null").groupBy("root").agg(F.min("doc").alias("low"))
    named = materialize(named.join(lowest, "root", "left").select("node", "members", "class", F.coalesce("low", "doc").alias("low")), "classes")
    each = sketch.select("doc_id", "text_key", "n_shingles", "node")
    bare = each.where("node is null").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("binary").alias("class"), F.col("doc_id").alias("component_id"))
    full = look_up(each.where("node is not null"), named, "node", each.count())
    return full.select("doc_id", "text_key", "n_shingles", "class", F.col("low").alias("component_id")).unionByName(bare)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, component_id, kept)``, one row a document.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets of
    distinct shingles of ``words`` lower-cased (A-Z) words; a shorter text is one shingle.
    ``component_id`` is the smallest doc_id that links reach. Every link is confirmed on the full
    sets; shingles are compared by 64-bit and sets by 128-bit hashes.

    A null or empty text, or one of white space, has no shingle and no link and keeps its own id. A
    repeated row gives repeated result rows. A row without doc_id still links; its ``component_id``
    is the smallest id in its component, null if there is none, and ``kept`` is then false or true.
    Other columns are ignored. An empty table gives an empty result.
    """
    found = classes(docs, words, percent, bands, rows)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def survivors(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each class of near-duplicates.

    The row with the smallest doc_id stays, a null one last, of equal ids that with the smallest
    hash of its text; of rows that repeat in id and text one stays. So a document that shares its
    id with a copy is kept for itself, and a class without ids keeps one row. Documents without
    shingles are in no class; all of them stay but repeated rows. Columns of any name pass through.
    """
    ident = lambda df, name: df["doc_id"].cast("long").alias(name)
    twice = docs.groupBy(ident(docs, "__id"), F.xxhash64(docs["text"].cast("string")).alias("__key")).agg(F.count("*").alias("__n")).where("__n > 1")
    if twice.limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    found = materialize(classes(docs, words, percent).where("class is not null"), "found")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    groups = materialize(found.groupBy("class").agg(F.min(rank).alias("first"), F.count("*").alias("members")).where("members > 1"), "groups")
    gone = look_up(found, groups, "class", found.count()).where((F.col("first") != rank)).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    hit = docs["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__key"])
    return docs.join(gone, hit, "left_anti").select(docs.columns)
