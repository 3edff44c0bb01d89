"""Spelling variants by tries and distance-one Levenshtein automata (after Schulz and Mihov, 2002).

Words and their counts are aggregated by Spark. The vocabulary, in order, becomes shards of bounded
size, each a trie whose nodes hold a bit set of their letters and whose siblings lie side by side. Shards
are broadcast in bundles of bounded size; every word meets every shard: its automaton walks the trie
along the word, and at each place each single edit is followed depth-first to its end. What the tasks
send on is one row a word, the number of its near words and the best of them.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, look_up, map_batches, materialize

# Fixed values of the contract: what a run is, the share of runs that lose a letter, bounds of words and forms.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPOILT, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Words and letters of a shard (a longer word is a shard of its own), and bytes of the packed shards that are broadcast together.
SHARD_WORDS, SHARD_LETTERS, BUNDLE_BYTES = 50_000, 1 << 20, 32 << 20
#: States of automata that are followed at once.
STATES = 1 << 18


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``docs(doc_id, text)`` to ``(word, n)``: runs of letters, some spoilt by their hash, and how often each occurs."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(ident.alias("doc"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    # A run that is too short stays too short.
    runs = runs.where(F.length("run") >= least_length).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % SPOILT == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letters(word: str) -> bytes:
    """The letters of a word, numbered from 0: a to z, then from U+00C0 on."""
    return bytes(c - 97 if c < 128 else c - 0xC0 + 26 for c in word.encode("latin-1"))


class Trie:
    """A trie over sorted words: for each node a bit set of its children's letters, the first child, its word's place or -1.

    Nodes are numbered level by level, so that siblings follow each other by letter and a child's
    number is the first one's plus the number of smaller letters that are there.
    """

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        coded = [letters(w) for w in words]
        todo = [(0, len(coded))]
        bits, first, place = [], [], []
        depth, end = 0, 1
        at = 0
        while at < len(todo):
            if at == end:
                depth, end = depth + 1, len(todo)
            a, b = todo[at]
            at += 1
            ends = a < b and len(coded[a]) == depth
            place.append(a if ends else -1)
            a += ends
            first.append(len(todo))
            here = 0
            while a < b:
                letter, start = coded[a][depth], a
                while a < b and coded[a][depth] == letter:
                    a += 1
                here |= 1 << letter
                todo.append((start, a))
            bits.append((here & (2**64 - 1), here >> 64))
        self.bits, self.first, self.place = np.array(bits, np.uint64), np.array(first, np.int32), np.array(place, np.int32)

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps(("\n".join(self.words), self.counts, self.bits, self.first, self.place), protocol=5), 1)


class Bundle:
    """Some tries as one table of nodes, with the first node of each."""

    def __init__(self, shards: list[bytes]):
        parts = [pickle.loads(zlib.decompress(s)) for s in shards]
        self.words = [w for p in parts for w in p[0].split("\n")]
        self.counts = np.concatenate([p[1] for p in parts])
        self.bits = np.concatenate([p[2] for p in parts])
        sizes, n_words = [len(p[3]) for p in parts], [len(p[1]) for p in parts]
        self.roots = np.cumsum([0, *sizes[:-1]])
        starts = np.cumsum([0, *n_words[:-1]])
        self.first = np.concatenate([p[3].astype(np.int64) + r for p, r in zip(parts, self.roots, strict=True)])
        self.place = np.concatenate([np.where(p[4] < 0, -1, p[4] + s) for p, s in zip(parts, starts, strict=True)])
        self.degree = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        # The letter by which each node hangs below its parent, roots none; children fill the nodes in order.
        above = np.repeat(np.arange(len(self.bits)), self.degree)
        within = np.arange(len(above)) - np.repeat(np.cumsum(self.degree) - self.degree, self.degree)
        self.letter = np.full(len(self.bits), -1, np.int64)
        self.letter[self.first[above] + within] = np.nonzero(np.unpackbits(self.bits.view(np.uint8).reshape(len(self.bits), 16), axis=1, bitorder="little"))[1]

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The children by these letters, -1 where there are none."""
        low, high = self.bits[node, 0], self.bits[node, 1]
        shift = (letter & 63).astype(np.uint64)
        late = letter >= 64
        own = np.where(late, high, low)
        smaller = np.bitwise_count(own & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64) + np.where(late, np.bitwise_count(low), 0)
        return np.where((own >> shift) & np.uint64(1), self.first[node] + smaller, -1)

    def near(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The accepted pairs (number of the word given, place of a word of the bundle), each once."""
        size = np.array([len(c) for c in coded], np.int64)
        start = np.cumsum(size) - size
        text = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        found: list[np.ndarray] = []

        def follow(who: np.ndarray, node: np.ndarray, at: np.ndarray) -> None:
            """The edit is spent: the rest of the word, or no word."""
            while len(who):
                done = at == size[who]
                ends = self.place[node[done]]
                found.append((who[done][ends >= 0] << 32) | ends[ends >= 0])
                who, node, at = who[~done], node[~done], at[~done]
                node = self.child(node, text[start[who] + at])
                live = node >= 0
                who, node, at = who[live], node[live], at[live] + 1

        # Without an edit an automaton is in one node of each shard: that of the word's prefix.
        who, node = np.repeat(np.arange(len(coded)), len(self.roots)), np.tile(self.roots, len(coded))
        place = 0
        while len(who):
            more = size[who] > place
            # A letter left out; of a run of equal letters the first.
            begins = more.copy()
            if place:
                begins[more] = text[start[who[more]] + place] != text[start[who[more]] + place - 1]
            follow(who[begins], node[begins], np.full(int(begins.sum()), place + 1))
            cuts = np.flatnonzero(np.diff(np.cumsum(self.degree[node]) // STATES)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(who)], strict=True):
                w, parent = who[a:b], node[a:b]
                deg = self.degree[parent]
                w_all = np.repeat(w, deg)
                child = np.repeat(self.first[parent] - np.cumsum(deg) + deg, deg) + np.arange(int(deg.sum()))
                left = size[w_all] > place
                # A letter put in before an equal one is put in after it too, so only others count.
                other = ~left
                other[left] = self.letter[child[left]] != text[start[w_all[left]] + place]
                follow(w_all[other], child[other], np.full(int(other.sum()), place))
                other &= left
                follow(w_all[other], child[other], np.full(int(other.sum()), place + 1))  # a letter replaced
            who, node = who[more], node[more]
            node = self.child(node, text[start[who] + place])
            who, node = who[node >= 0], node[node >= 0]
            place += 1
        pairs = np.unique(np.concatenate([*found, np.empty(0, np.int64)]))
        return pairs >> 32, pairs & 0xFFFFFFFF


def _sharded(most_words: int):
    """Sorted words to tries of bounded size."""

    def out(some: list[tuple[str, int]]) -> pd.DataFrame:
        packed = Trie([w for w, _ in some], [n for _, n in some]).packed()
        return pd.DataFrame({"first": [some[0][0]], "bytes": [len(packed)], "shard": [packed]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some: list[tuple[str, int]] = []
        n_letters = 0
        for batch in batches:
            for word, n in zip(batch["word"], batch["n"], strict=True):
                if some and (len(some) == most_words or n_letters + len(word) > SHARD_LETTERS):
                    yield out(some)
                    some, n_letters = [], 0
                some.append((word, n))
                n_letters += len(word)
        if some:
            yield out(some)

    return run


def _met(shared):
    """Words to ``(word, n, n_near, form_n, form)`` by one bundle."""
    opened: list[Bundle] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not opened:
                opened.append(Bundle(shared.value))
            bundle = opened[0]
            who, place = bundle.near([letters(w) for w in batch["word"]])
            n_near = np.bincount(who, minlength=len(batch))
            order = np.lexsort((place, -bundle.counts[place], who))
            who, place = who[order], place[order]
            first = np.concatenate([[True], who[1:] != who[:-1]])[: len(who)]
            form, form_n = np.full(len(batch), None, object), np.full(len(batch), None, object)
            form[who[first]] = [bundle.words[p] for p in place[first]]
            form_n[who[first]] = bundle.counts[place[first]]
            yield batch[["word", "n"]].assign(n_near=n_near, form_n=form_n, form=form)
        opened.clear()

    return run


def _bundles(shards: DataFrame, most_bytes: int) -> Iterator[list[bytes]]:
    """Packed shards, as many at a time as a bundle holds, in the order of their words; only one bundle is on the driver."""
    listed = [(r["first"], r["bytes"]) for r in shards.select("first", "bytes").orderBy("first").collect()]
    a = 0
    while a < len(listed):
        b, size = a + 1, listed[a][1]
        while b < len(listed) and size + listed[b][1] <= most_bytes:
            size += listed[b][1]
            b += 1
        yield [r["shard"] for r in shards.where(F.col("first").between(listed[a][0], listed[b - 1][0])).orderBy("first").select("shard").collect()]
        a = b


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """``vocabulary(word, n)``, each word once, to ``(word, n, n_near, best_n, best)``.

    ``n_near`` counts the words at distance one; ``best`` is that of largest n, the smallest of
    equals. Words are made of a to z and letters from U+00C0 to U+00FF.
    """
    spark = vocabulary.sparkSession
    total = vocabulary.count()
    in_order = vocabulary.repartitionByRange(max(1, -(-total // shard_words)), "word").sortWithinPartitions("word")
    shards = materialize(map_batches(in_order, _sharded(shard_words), "first string, bytes long, shard binary"), "shards")
    # Long and short words apart over the tasks, whatever the order of the vocabulary.
    spread = vocabulary.repartition(max(spark.sparkContext.defaultParallelism, -(-total // shard_words)), F.xxhash64("word"))
    met = []
    for bundle in _bundles(shards, bundle_bytes):
        shared = spark.sparkContext.broadcast(bundle)
        met.append(materialize(map_batches(spread, _met(shared), "word string, n long, n_near long, form_n long, form string"), "met"))
        shared.unpersist()
    discard(shards)
    if not met:
        return vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = met[0]
    for part in met[1:]:
        every = every.unionByName(part)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form"))))
    reduced = every.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return reduced.select("word", "n", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.form").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` to ``(word, root)``: where following forms ends. Each round doubles the steps; forms must not go in circles."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        sizes = steps.groupBy("root").agg(F.count("*").alias("members"))
        top = steps.select(F.col("word").alias("root"), F.col("root").alias("top")).join(sizes, "root")
        if not top.limit(1).count():
            return steps
        moved = look_up(steps, materialize(top, "tops"), "root", steps.count()).select("word", F.coalesce("top", "root").alias("root"))
        steps = materialize(moved, "roots")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """``docs(doc_id, text)`` to ``(word, form, root, n, n_near, form_n)``, one row a word.

    Words are runs of letters of whole texts, lower-cased (A-Z), some with a letter deleted by the
    hash of doc_id and run, with at least ``least_length`` letters and ``least_count`` occurrences.
    ``n_near`` counts the words that differ by one inserted, deleted or replaced letter. ``form``
    is the near word of largest n, the smallest by code points of equals, if its n is at least
    ``times`` the word's; ``root`` the last word that forms lead to, the word itself if it has none.

    Null and empty texts have no words; a null doc_id is an empty one in the hash. Repeated rows
    count as often as they come. Words of any length are whole. Other columns are ignored; an empty
    table gives an empty result.
    """
    vocabulary = materialize(words(docs, least_length, least_count), "vocabulary")
    good: Column = F.col("best_n") >= times * F.col("n")
    found = near_words(vocabulary).select("word", "n", "n_near", F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    found = materialize(found, "found")
    ends = roots(found.where("form is not null").select("word", "form"))
    out = found.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
