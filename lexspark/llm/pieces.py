"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The merges are those of a public SentencePiece BPE model. A candidate merge that comes off the
agenda is skipped with a fixed probability, decided by a hash keyed with the seed, the document and
the place in its text, so every occurrence of a word is split on its own and each is reproduced by
its seed.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from .common import held, map_batches

#: Where the model lies on every machine; a parameter of all that follows.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 1
#: Texts whose parts are encoded together.
GROUP = 200
#: Occurrences after which a part's agendas are remembered, and how many new ones of a part in one group.
OFTEN, WAVES = 16, 4
SPACE = "▁"
_SEGMENT = re.compile(r" *[^ ]+| +")


MASK = 2**64 - 1


#: Parts up to this length are encoded together, so many at once.
SHORT, TOGETHER = 40, 5_000


def skipped(key, start, merged):
    """A 64-bit number for a candidate merge, which is skipped if it is below a limit; of numbers or arrays."""
    whole = not isinstance(key, np.ndarray)
    c = [x if whole else np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 31, 32)]
    cut = (lambda x: x & MASK) if whole else lambda x: x
    x = cut((key ^ cut(start * c[0])) + merged * c[1])
    x = cut((x ^ (x >> c[3])) * c[2])
    return x ^ (x >> c[4])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A piece model with merge-dropout.

    A text is cut before each run of spaces; no piece of such a model reaches over such a cut, so
    the parts are encoded one by one. Each occurrence of a part has a key of its own, which decides
    its candidate merges. What a part's agenda offers after given decisions does not depend on the
    key, so for frequent parts that is remembered as a tree: a node is a candidate merge, its
    branches lead to what follows if it is taken or skipped, and a leaf holds the pieces. A space becomes the piece mark; a literal
    mark and all characters without a piece become byte pieces, so decoding gives back any text.
    """

    def __init__(self, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, remembered: int = 50_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte: dict[int, int] = {}
        self.score: dict[str, float] = {}
        self.ident: dict[str, int] = {}
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ident[p], self.score[p] = i, sp.get_score(i)
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces, so encoding could lose characters")
        if any(SPACE in p.lstrip(SPACE) for p in self.ident):
            raise ValueError("a piece reaches over the start of a word")
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.high = frozenset(i for b, i in self.byte.items() if b >= 128)
        self.out = [chr(self.byte_of[i]) if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(self.piece)]
        self.merges = {
            (self.ident[p[:k]], self.ident[p[k:]]): (-self.score[p], i)
            for p, i in self.ident.items() for k in range(1, len(p)) if p[:k] in self.ident and p[k:] in self.ident
        }
        pairs = sorted((a << 32 | b, *f) for (a, b), f in self.merges.items())
        self.point = np.full(0x110000, -1, np.int64)
        for p, i in self.ident.items():
            if len(p) == 1 and p != SPACE:
                self.point[ord(p)] = i
        self.point[ord(" ")] = self.ident.get(SPACE, -1)
        self.pair, self.pair_rank, self.pair_piece = (np.array([p[k] for p in pairs], kind) for k, kind in enumerate((np.int64, float, np.int64)))
        self.dropout, self.seed, self.remembered = dropout, seed, remembered
        self.limit = int(self.dropout * 2**64)
        # The trees: a branch is a node, a leaf as -2 - its number, or -1 where no occurrence went yet.
        self.root: dict[str, int] = {}
        self.seen: Counter[str] = Counter()
        self.leaves: list[tuple[int, ...]] = []
        self.nodes = 0
        self.candidate, self.branch = np.zeros((2, 1_024), np.uint64), np.full(2 * 1_024, -1, np.int64)

    def segment(self, part: str, key: int, asked: list | None = None) -> tuple[int, ...]:
        """Pieces of one part: the agenda gives the best merge first, the leftmost of equals.

        ``asked`` gets the candidates that the key decided on, as ``(start, merged, skipped)``.
        """
        lead = len(part) - len(part.lstrip(" "))
        ident, merges = self.ident, self.merges
        # A literal mark, like a character without a piece, has no id, so it merges with nothing.
        chars = SPACE * lead + part[lead:]
        ids = [ident.get(c, -1) if i < lead or c != SPACE else -1 for i, c in enumerate(chars)]
        ids, start = self._merged(ids, key, self.limit, merges, asked)
        out: list[int] = []
        for i, a in zip(ids, start, strict=True):
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte[x] for x in chars[a].encode("utf-8", "surrogatepass")]
        return tuple(out)

    @staticmethod
    def _merged(ids: list[int], key: int, limit: int, merges: dict, asked: list | None = None) -> tuple[list[int], list[int]]:
        """The agenda as a heap, best rank first, then leftmost."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        live = [True] * n
        agenda = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(agenda)
        while agenda:
            _, a, was_a, was_b, merged = heapq.heappop(agenda)
            b = right[a] if live[a] else -1
            if b < 0 or ids[a] != was_a or ids[b] != was_b:
                continue
            skip = bool(limit) and skipped(key, a, merged) < limit
            if asked is not None:
                asked.append((a, merged, skip))
            if skip:
                continue
            ids[a], live[b] = merged, False
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            for x, y in ((left[a], a), (a, right[a])):
                if x >= 0 and y >= 0 and (f := merges.get((ids[x], ids[y]))):
                    heapq.heappush(agenda, (f[0], x, ids[x], ids[y], f[1]))
        at = [i for i in range(n) if live[i]]
        return [ids[i] for i in at], at

    def segments(self, parts: list[str], keys: np.ndarray) -> list[tuple[int, ...]]:
        """:meth:`segment` for many parts at once: each turn merges the best pair of every part."""
        short = [i for i, p in enumerate(parts) if len(p) <= SHORT]
        out: list = [None] * len(parts)
        for i, p in enumerate(parts):
            if len(p) > SHORT:
                out[i] = self.segment(p, int(keys[i]))
        short.sort(key=lambda i: len(parts[i]))
        for a in range(0, len(short), TOGETHER):
            at = short[a : a + TOGETHER]
            for i, ids in zip(at, self._segments([parts[i] for i in at], keys[at]), strict=True):
                out[i] = ids
        return out

    def _segments(self, parts: list[str], key: np.ndarray) -> list[tuple[int, ...]]:
        """The symbols of all parts lie in one array; a merge keeps the left place and links over the right one."""
        n, m = len(parts), max(map(len, parts)) + 1
        length = np.array([len(p) for p in parts])
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(len(points)) - np.repeat(first, length) + np.repeat(np.arange(n) * m, length)
        ids = np.full(n * m, -1, np.int64)
        ids[place] = self.point[points]
        # Spaces are marks at the start of a part only; parts of spaces are nothing else.
        after = np.arange(1, n * m + 1)
        before = np.arange(-1, n * m - 1)
        rank = np.full(n * m, np.inf, np.float32)
        merged = np.zeros(n * m, np.int64)
        rank[:-1], merged[:-1] = self._pairs(ids[:-1], ids[1:])
        limit = self.limit
        live, rows = np.arange(n), rank.reshape(n, m)
        alive = np.zeros(n * m, bool)
        alive[place] = True
        while len(live):
            best = rows[live].argmin(axis=1)
            at = live * m + best
            some = rank[at] < np.inf
            live, at, best = live[some], at[some], best[some]
            if limit:
                drop = skipped(key[live], best.astype(np.uint64), merged[at].astype(np.uint64)) < np.uint64(limit)
                rank[at[drop]] = np.inf
                at = at[~drop]
            gone = after[at]
            ids[at], alive[gone], rank[gone] = merged[at], False, np.inf
            next_ = after[gone]
            after[at] = next_
            before[np.minimum(next_, n * m - 1)] = at
            for left in (before[at], at):
                left = left[left >= 0]
                right = np.minimum(after[left], n * m - 1)
                rank[left], merged[left] = self._pairs(ids[left], np.where(after[left] < n * m, ids[right], -1))
        out = []
        alive_ids, count = ids[alive], np.add.reduceat(alive, np.arange(n) * m)
        ends = np.cumsum(count).tolist()
        where = (np.flatnonzero(alive) % m).tolist()
        flat, strange = alive_ids.tolist(), set((np.flatnonzero(alive & (ids < 0)) // m).tolist())
        a = 0
        for i, b in enumerate(ends):
            if i in strange:
                got: list[int] = []
                for x, at_ in zip(flat[a:b], where[a:b], strict=True):
                    got += (x,) if x >= 0 else [self.byte[c] for c in parts[i][at_].encode("utf-8", "surrogatepass")]
                out.append(tuple(got))
            else:
                out.append(tuple(flat[a:b]))
            a = b
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the merge of each pair; infinite if there is none."""
        key = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        there = self.pair[at] == key
        return np.where(there, self.pair_rank[at], np.inf), self.pair_piece[at]

    def learn(self, part: str, key: int) -> tuple[int, ...]:
        """:meth:`segment`, with its candidates and decisions added to the part's tree."""
        asked: list[tuple[int, int, bool]] = []
        found = self.segment(part, key, asked)
        if self.nodes + len(asked) > self.candidate.shape[1]:
            self.candidate = np.concatenate([self.candidate, np.zeros_like(self.candidate)], axis=1)
            self.branch = np.concatenate([self.branch, np.full_like(self.branch, -1)])
        last, at = -1, self.root.get(part, -1)
        for start, merged, skip in asked:
            if at == -1:
                at = self.nodes
                self.nodes += 1
                self.candidate[:, at] = start, merged
                self._branch(part, last, at)
            last = 2 * at + skip
            at = int(self.branch[last])
        if at == -1:
            self.leaves.append(found)
            self._branch(part, last, -1 - len(self.leaves))
        return found

    def _branch(self, part: str, last: int, to: int) -> None:
        if last < 0:
            self.root[part] = to
        else:
            self.branch[last] = to

    def walk(self, root: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The leaf that each key leads to from its root; -1 where the tree has none yet."""
        at = root.copy()
        live = np.flatnonzero(at >= 0)
        node, key = at[live], keys[live]
        while len(live):
            skip = skipped(key, self.candidate[0, node], self.candidate[1, node]) < np.uint64(self.limit)
            at[live] = node = self.branch[2 * node + skip]
            more = node >= 0
            live, node, key = live[more], node[more], key[more]
        return at

    def encode_parts(self, parts: list[str], keys: np.ndarray) -> list[tuple[int, ...]]:
        """Pieces of each part by its key: along the trees where they reach, else by :meth:`segments`."""
        kind, distinct = pd.factorize(np.array(parts, object))
        distinct = distinct.tolist()
        if not self.limit:
            found = self.segments(distinct, np.zeros(len(distinct), np.uint64))
            return [found[k] for k in kind.tolist()]
        if len(self.seen) > self.remembered:
            self.seen.clear()
        self.seen.update(dict(zip(distinct, np.bincount(kind).tolist(), strict=True)))
        root = np.fromiter(map(self.root.get, distinct, repeat(-1)), np.int64, len(distinct))
        often = (np.fromiter(map(self.seen.__getitem__, distinct), np.int64, len(distinct)) >= OFTEN) | (root != -1)
        often &= np.fromiter(map(len, distinct), np.int64, len(distinct)) <= SHORT
        leaf, open_ = np.full(len(parts), -1), np.arange(len(parts))
        for wave in range(WAVES + 1):
            leaf[open_] = self.walk(root[kind[open_]], keys[open_])
            open_ = open_[leaf[open_] == -1]
            able = open_[often[kind[open_]]]
            if wave == WAVES or not len(able) or len(self.leaves) >= self.remembered:
                break
            # One occurrence of each frequent part shows the way for those that decide alike.
            for i in able[np.unique(kind[able], return_index=True)[1]].tolist():
                self.learn(parts[i], int(keys[i]))
                root[kind[i]] = self.root[parts[i]]
        out: list = [self.leaves[k] for k in (-2 - leaf).tolist()] if self.leaves else [()] * len(parts)
        rest = open_.tolist()
        for i, ids in zip(rest, self.segments([parts[i] for i in rest], keys[open_]), strict=True):
            out[i] = ids
        return out

    def keys(self, texts: list[str], docs: list[int], counts: list[int]) -> np.ndarray:
        """A key for each part of each text, by seed, document, text and the part's place in the text."""
        seed = self.seed & MASK
        own = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), xxhash.xxh3_64_intdigest(b"%d" % d, seed)) for t, d in zip(texts, docs, strict=True)], np.uint64)
        first = np.cumsum([0, *counts[:-1]])
        place = (np.arange(sum(counts)) - np.repeat(first, counts)).astype(np.uint64)
        return mixed(np.repeat(own, counts) + place * np.uint64(0x9E3779B97F4A7C15))

    def encode_all(self, texts: list[str], keys: list[int]) -> list[list[int]]:
        """Piece ids of each text; the decisions depend on its key too, so equal texts may differ by key."""
        if not texts:
            return []
        cut = [_SEGMENT.findall(text) for text in texts]
        ends = np.cumsum([0, *map(len, cut)]).tolist()
        found = self.encode_parts(list(chain.from_iterable(cut)), self.keys(texts, keys, list(map(len, cut))))
        return [list(chain.from_iterable(found[a:b])) for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, text: str, key: int = 0) -> list[int]:
        return self.encode_all([text], [key])[0]

    def decode(self, ids) -> str:
        """The text of piece ids."""
        if self.high.isdisjoint(ids):
            return "".join(map(self.out.__getitem__, ids))
        out, raw, byte_of, put = [], bytearray(), self.byte_of, self.out
        for i in ids:
            if i in byte_of:
                raw.append(byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "surrogatepass"))
                raw.clear()
            out.append(put[i])
        return "".join(out) + raw.decode("utf-8", "surrogatepass")


def loaded(*setting) -> Pieces:
    return held(repr(setting), lambda: Pieces(*setting))


def _encode(setting: tuple, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(*setting)
        for batch in batches:
            texts, docs = [t or "" for t in batch["text"]], batch["doc_id"].tolist()
            for a in range(0, len(texts), GROUP):
                rows, some = [], texts[a : a + GROUP]
                keys = [0 if pd.isna(d) else int(d) + 1 for d in docs[a : a + GROUP]]
                for text, ids in zip(some, pieces.encode_all(some, keys), strict=True):
                    packed = np.array(ids, np.int32)
                    row = (len(ids), hashlib.sha256(packed.tobytes()).hexdigest(), pieces.decode(ids) == text)
                    rows.append((*row, packed) if with_ids else row)
                part = batch[["doc_id"]].iloc[a : a + GROUP]
                found = pd.DataFrame(rows, columns=["n_pieces", "pieces_sha256", "lossless", *["pieces"] * with_ids], index=part.index)
                yield pd.concat([part, found], axis=1)

    return run


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_pieces, pieces_sha256, lossless[, pieces])``.

    ``pieces_sha256`` is of the ids as 32-bit little-endian numbers; ``lossless`` tells that the
    ids decode to the text. The ids depend on model, dropout, seed, doc_id and text only; each
    candidate merge of each occurrence of a word is decided for itself. A null or empty text has no pieces. Repeated rows give equal results.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_pieces long, pieces_sha256 string, lossless boolean" + ", pieces array<int>" * with_ids
    return map_batches(rows, _encode((model, dropout, seed), with_ids), schema)


def _decode(setting: tuple):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(*setting)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [None if ids is None else pieces.decode(ids) for ids in batch["pieces"]]})

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded(doc_id, pieces)`` to ``(doc_id, text)``; null pieces give a null text."""
    return map_batches(encoded.select("doc_id", "pieces"), _decode((model, 0.0, 0)), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
