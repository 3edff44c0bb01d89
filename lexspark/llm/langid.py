"""Language identification by prediction by partial matching.

One context tree of bytes for each language, with escape method C, is learnt from a bounded sample
of labelled rows and then frozen. A text's score in a language is its exact code length in bits
under that tree; the shortest code wins.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_limit, held, map_batches

#: Longest context in bytes.
ORDER = 4
#: Bound of the training sample: distinct texts of a language.
SAMPLE_DOCS = 2_000
#: A text that costs more bits a byte than this in every language is in none of them. Bytes by
#: chance cost over 8, prose in a learnt language 2 to 4.
MOST_BITS = 7.0

#: Texts that are scored together, and bytes that one vectorised pass codes.
TOGETHER, PASS = 100, 100_000

UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
#: What a context tree reads: lower-cased UTF-8 with one space between words and around the text.
_PAD = b"    "


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text)


def coded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) + b" "


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text's bytes start, and for each gram length the bytes up to each byte as one number, the latest lowest.

    The context of a text's first bytes is a run of spaces, and not the text before it.
    """
    text = np.frombuffer(b"".join(_PAD[:order] + t for t in texts), np.uint8)
    length = np.array([len(t) for t in texts])
    start = np.cumsum(length) - length
    at = np.arange(length.sum()) + np.repeat((np.arange(len(texts)) + 1) * order, length)
    keys, key = [], np.zeros(len(at), np.int64)
    for back in range(order + 1):
        key = key | text[at - back].astype(np.int64) << (8 * back)
        keys.append(key)
    return start, keys


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class ContextTrees:
    """Byte context trees of all languages, built from counts of the longest grams and then frozen.

    A text is coded byte by byte; the context of a byte is what precedes it, over the spaces too,
    up to ``order`` bytes. A byte is coded at the longest context of the tree that has seen it,
    after an escape for each longer context that has not; below the empty context all 256 bytes
    are equally likely.
    """

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """``grams``: for each language the distinct grams of ``order + 1`` bytes as numbers, and their counts."""
        if order > len(_PAD):
            raise ValueError(f"contexts have at most {len(_PAD)} bytes")
        self.grams, self.order = grams, order
        self.languages = sorted(grams)
        self.frozen = False

    @classmethod
    def of_texts(cls, texts: dict[str, list[str]], order: int = ORDER) -> ContextTrees:
        return cls({lang: np.unique(_grams([coded(t) for t in some], order)[1][order], return_counts=True) for lang, some in texts.items()}, order)

    def freeze(self) -> ContextTrees:
        """Turn counts into code lengths, a row over the languages for each gram and each context."""
        n = len(self.languages)
        self.gram, self.bits, self.context, self.escape = [], [], [], []
        for back in range(self.order + 1):
            low = (1 << 8 * (back + 1)) - 1
            gram = np.unique(np.concatenate([self.grams[lang][0] & low for lang in self.languages])) if n else np.zeros(0, np.int64)
            k = np.zeros((len(gram), n))
            for at, lang in enumerate(self.languages):
                grams, counts = self.grams[lang]
                k[:, at] = np.bincount(np.searchsorted(gram, grams & low), weights=counts, minlength=len(gram))
            context, inverse = np.unique(gram >> 8, return_inverse=True)
            total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
            np.add.at(total, inverse, k)
            np.add.at(kinds, inverse, k > 0)
            both = np.maximum(total + kinds, 1)
            escape = np.where(kinds > 0, np.log2(both / np.maximum(kinds, 1)), 0.0)
            shorter = self.bits[-1][np.searchsorted(self.gram[-1], gram & ((1 << 8 * back) - 1))] if back else 8.0
            self.bits.append(np.where(k > 0, np.log2(both[inverse] / np.maximum(k, 1)), escape[inverse] + shorter))
            self.gram.append(gram)
            self.context.append(context)
            self.escape.append(escape)
        self.frozen = True
        return self

    def byte_bits(self, keys: list[np.ndarray]) -> np.ndarray:
        """Code length of each byte in each language."""
        out = np.zeros((len(keys[0]), len(self.languages)))
        todo = np.arange(len(out))
        for back in range(self.order, -1, -1):
            at, there = _find(self.gram[back], keys[back][todo])
            out[todo[there]] += self.bits[back][at[there]]
            todo = todo[~there]
            at, there = _find(self.context[back], keys[back][todo] >> 8)
            out[todo[there]] += self.escape[back][at[there]]
        out[todo] += 8.0
        return out

    def text_bits(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """Code length of each whole text in each language, and the bytes coded; texts of a white space only have one."""
        raw = [coded(t) for t in texts]
        out: list[tuple[np.ndarray, int]] = []
        a = 0
        while a < len(raw):
            b, size = a, 0
            while b < len(raw) and (b == a or size + len(raw[b]) <= PASS):
                size += len(raw[b])
                b += 1
            if b == a + 1 and size > PASS:  # one long text, piece by piece, each with the bytes before it as its context
                total = np.zeros(len(self.languages))
                for i in range(0, size, PASS):
                    first = max(0, i - self.order)
                    _, keys = _grams([raw[a][first : i + PASS]], self.order)
                    total += self.byte_bits([k[i - first :] for k in keys]).sum(axis=0)
                out.append((total, size))
            else:
                start, keys = _grams(raw[a:b], self.order)
                out += zip(np.add.reduceat(self.byte_bits(keys), start, axis=0), map(len, raw[a:b]), strict=True)
            a = b
        return out


def _count(order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang", sort=False):
                texts = part["text"].tolist()
                for a in range(0, len(texts), TOGETHER):
                    grams, counts = np.unique(_grams([coded(t) for t in texts[a : a + TOGETHER]], order)[1][order], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams, "n": counts})

    return run


def train(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> ContextTrees:
    """Learn from ``docs(text, lang)``: a sample of about ``sample_docs`` distinct texts of each language, all if there are fewer.

    A text is drawn by its hash, and once however many copies it has, so the sample depends neither
    on partitions nor on groups of copies. Only the counts of its grams come to the driver; the
    sample bounds them.
    """
    labelled = docs.where("text is not null and lang is not null").select("text", "lang").withColumn("h", F.xxhash64("text"))
    # Copies fall together before anything is shuffled: a pair of hashes for each row, one for each group of copies.
    sizes = labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("texts"))
    share = {r["lang"]: sample_docs / r["texts"] for r in sizes.collect()}
    if not share:
        return ContextTrees({}, order)
    limit = F.create_map(*[F.lit(x) for lang, part in share.items() for x in (lang, hash_limit(part))])
    sample = labelled.where(F.col("h") <= limit[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    counts = map_batches(sample.select("lang", "text"), _count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.orderBy("lang", "gram").toPandas()
    return ContextTrees({lang: (part["gram"].to_numpy(np.int64), part["n"].to_numpy(float)) for lang, part in found.groupby("lang")}, order)


def _frozen(shared, name: str) -> ContextTrees:
    return held(name, lambda: shared.value.freeze())


def _judged(trees: ContextTrees, texts: list, most_bits: float) -> list[tuple[str, float, float | None, bool]]:
    out: list = [(UNKNOWN, 0.0, None, True)] * len(texts)
    for a in range(0, len(texts), TOGETHER):
        at = [i for i in range(a, min(a + TOGETHER, len(texts))) if texts[i] and trees.languages and has_letter(texts[i])]
        for i, (bits, n) in zip(at, trees.text_bits([texts[i] for i in at]), strict=True):
            best = int(np.argmin(bits))
            chance = 1.0 / np.exp2(np.minimum(bits[best] - bits, 0.0)).sum()
            out[i] = (trees.languages[best], float(chance), float(bits[best] / n), bool(bits[best] > most_bits * n))
    return out


def _predict(shared, name: str, most_bits: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = _frozen(shared, name)
        for batch in batches:
            found = pd.DataFrame(_judged(trees, batch["text"].tolist(), most_bits), columns=["lang_pred", "score", "bits_per_byte", "rejected"], index=batch.index)
            yield pd.concat([batch[["doc_id"]], found], axis=1)

    return run


def _keep(shared, name: str, most_bits: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = _frozen(shared, name)
        for batch in batches:
            yield batch[[not x[3] for x in _judged(trees, batch["text"].tolist(), most_bits)]]

    return run


def identify(docs: DataFrame, trees: ContextTrees, most_bits: float = MOST_BITS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, lang_pred, score, bits_per_byte, rejected)``.

    ``score`` is the chance of the language among the learnt ones if all are equally likely before.
    ``rejected`` marks a text without any letter and one that is far from every learnt language.
    A null, empty or letterless text gets ``und``, score 0, no bits_per_byte, and is rejected, as
    every text is when nothing was learnt. Between equal code lengths the first language by name
    wins. Repeated rows and null ids pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, _predict(shared, uuid.uuid4().hex, most_bits), f"doc_id {kind}, lang_pred string, score double, bits_per_byte double, rejected boolean")


def accepted(docs: DataFrame, trees: ContextTrees, most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text :func:`identify` does not reject; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return map_batches(docs, _keep(shared, uuid.uuid4().hex, most_bits), docs.schema)


def held_out(doc_id: str = "doc_id"):
    """True for the documents that training must not see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
