"""Personal data in texts, disguised forms included, with exact source offsets.

Detectors work on plain text. For disguises a chain of transducers rewrites the text (look-alike
characters, spelled digits, at/dot words) and keeps for every character of the result the span of
the source that it came from, so what a detector finds in the rewritten text maps back exactly.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# --- detectors ---------------------------------------------------------------------------------

# The patterns of the contract, in forms that give the same matches in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """From each ``@`` back over the local part, then forward over the domain: no rescanning of long runs."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[Span]:
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


DETECTORS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(text: str) -> dict[str, list[Span]]:
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if (digit := _DIGIT.search(text) is not None) else [],
        "card": cards(text) if digit else [],
        "phone": phones(text) if "+" in text else [],
    }


# --- transducers -------------------------------------------------------------------------------


@dataclass
class Mapped:
    """A rewritten text; character i stands for ``source[start[i]:end[i]]``, and ``changed[i]`` if rewritten."""

    text: str
    start: list[int]
    end: list[int]
    changed: list[bool]

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace disjoint ascending spans; each character of a replacement stands for the whole span."""
        if not edits:
            return self
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, put in edits:
            text += (self.text[at:a], put)
            start += self.start[at:a] + [self.start[a]] * len(put)
            end += self.end[at:a] + [self.end[b - 1]] * len(put)
            changed += self.changed[at:a] + [True] * len(put)
            at = b
        text.append(self.text[at:])
        return Mapped("".join(text), start + self.start[at:], end + self.end[at:], changed + self.changed[at:])


# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "。": ".", "․": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
_ODD = re.compile(
    "[ ­ʰ-˿Ͱ-ԧ٠-٩۰-۹०-९ -⁯⁰-ₜ℀-⅏−①-⓿"
    "　-。﹐-﹯﻿＀-￯\U0001d400-\U0001d7ff]"
)


def _plain(c: str) -> str:
    """What an odd character stands for; itself if nothing plainer."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def fold_look_alikes(m: Mapped) -> Mapped:
    if m.text.isascii():
        return m
    edits = [(x.start(), x.end(), put) for x in _ODD.finditer(m.text) if (put := _plain(x[0])) != x[0]]
    return m.rewritten(edits)


# Spelled digits in English, French, German and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?:(?<!\w)plus[\s,-]+)?(?<!\w)(?:{_WORDS}|[0-9]+)(?:[\s,-]+(?:{_WORDS}|[0-9]+)(?!\w)){{3,}}")
_ONE = re.compile(rf"(?i)(?<!\w)(?:{_WORDS}|[0-9]+|plus)(?!\w)")


def digits_for_words(m: Mapped) -> Mapped:
    """Runs of four or more spelled or written digits, three of them spelled, become digits without gaps."""
    words = set(m.text.lower().replace("-", " ").replace(",", " ").replace(".", " ").split())
    if not any(w in DIGIT_WORDS for w in words):
        return m
    edits = []
    for run in _SPELLED.finditer(m.text):
        parts = list(_ONE.finditer(m.text, run.start(), run.end()))
        if sum(p[0].lower() in DIGIT_WORDS for p in parts) < 3:
            continue
        for k, p in enumerate(parts):
            word = p[0].lower()
            # The gap before a part goes with it, so that the run has no gap left.
            edits.append((parts[k - 1].end() if k else p.start(), p.end(), "+" if word == "plus" else DIGIT_WORDS.get(word, p[0])))
    return m.rewritten(edits)


# Words and entities that stand for @ and the full stop.
_AT, _DOT = r"(?:at|arroba|arobase|klammeraffe)", r"(?:dot|punto|punkt|point)"
_SIGN = re.compile(
    rf"(?i)\s*[\[({{<]\s*(?P<at>{_AT}|@)\s*[\])}}>]\s*|\s*[\[({{<]\s*(?P<dot>{_DOT}|\.)\s*[\])}}>]\s*"
    r"|(?P<at2>&#0*64;|&#x0*40;|&commat;|%40)|(?P<dot2>&#0*46;|&#x0*2e;|&period;|%2e)"
    rf"|(?<=\w)[ \t]+(?P<dot3>{_DOT})[ \t]+(?=\w)"
)
_BARE_AT = re.compile(rf"(?i)(?<=[a-z0-9])[ \t]+(?:{_AT}|@)[ \t]*(?=[a-z0-9-]+\.[a-z0-9])|(?<=[a-z0-9])@[ \t]+(?=[a-z0-9-]+\.[a-z0-9])")
_HINT = re.compile(rf"(?i)[\[({{<]\s*(?:{_AT}|{_DOT}|@|\.)\s*[\])}}>]|&#|%40|%2e|&commat|&period|[ \t]@|@[ \t]|(?<!\w){_DOT}(?!\w)")


def signs_for_words(m: Mapped) -> Mapped:
    """At/dot disguises become ``@`` and ``.``.

    Brackets and entities always do; a bare ``dot`` between words does; a bare ``at`` only before
    a domain whose dot was itself disguised, so that "at example.com" in prose stays.
    """
    if not _HINT.search(m.text):
        return m
    edits = [(x.start(), x.end(), "@" if x["at"] or x["at2"] else ".") for x in _SIGN.finditer(m.text)]
    out = m.rewritten(edits)
    bare = []
    for x in _BARE_AT.finditer(out.text):
        domain = _DOMAIN.match(out.text, x.end())
        if domain and ("@" in x[0] or any(out.changed[i] for i in range(domain.start(), domain.end()) if out.text[i] == ".")):
            bare.append((x.start(), x.end(), "@"))
    return out.rewritten(bare)


TRANSDUCERS = (fold_look_alikes, digits_for_words, signs_for_words)


def disguised(text: str) -> dict[str, list[Span]]:
    """Source spans that only the rewritten text shows; deleted characters leave no mark, so a span is compared with its source."""
    whole = None
    for step in TRANSDUCERS:
        if whole is None and not _needs(step, text):
            continue
        whole = step(whole if whole is not None else Mapped.of(text))
    if whole is None or whole.text == text:
        return {}
    found: dict[str, list[Span]] = {}
    for kind, spans in detect(whole.text).items():
        found[kind] = [(whole.start[a], whole.end[b - 1]) for a, b in spans if any(whole.changed[a:b]) or text[whole.start[a] : whole.end[b - 1]] != whole.text[a:b]]
    return found


def _needs(step: Callable, text: str) -> bool:
    """A cheap test whether a transducer could change the text."""
    if step is fold_look_alikes:
        return not text.isascii() and _ODD.search(text) is not None
    if step is digits_for_words:
        words = set(text.lower().replace("-", " ").replace(",", " ").split())
        return not DIGIT_WORDS.keys().isdisjoint(words) and _SPELLED.search(text) is not None
    low = text.lower()
    return any(sign in low for sign in ("@", "&", "%", "(", "[", "{", "<", "dot", "punto", "punkt", "point")) and _HINT.search(text) is not None


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans: a disguised one joins if it lies in no base span of its kind."""
    if not text:
        return {k: [] for k in KINDS}, {k: [] for k in KINDS}
    base = detect(text)
    more = disguised(text)
    every = {}
    for kind in KINDS:
        new = [s for s in more.get(kind, ()) if not any(b <= s[0] and s[1] <= e for b, e in base[kind])]
        every[kind] = sorted({*base[kind], *new})
    return base, every


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redact(text: str | None, spans: dict[str, list[Span]]) -> str | None:
    """The text with each span, or each run of overlapping spans, replaced by the first one's kind in brackets."""
    flat = sorted((a, b, kind) for kind in KINDS for a, b in spans[kind])
    if text is None or not flat:
        return text
    out, at, k = [], 0, 0
    while k < len(flat):
        a, b, kind = flat[k]
        k += 1
        while k < len(flat) and flat[k][0] < b:
            b, k = max(b, flat[k][1]), k + 1
        out += (text[at:a], f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            base, every = find(text)
            rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), sum(map(len, every.values())) - sum(map(len, base.values()))))
        found = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"], index=batch.index)
        yield pd.concat([batch[["doc_id"]], found], axis=1)


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised)``.

    The counts and ``base_sha256`` are of the plain spans; ``spans`` lists all, disguised ones
    included, as kind:start:end in code points. A null or empty text has none: counts 0, spans
    empty. Repeated rows and null ids pass through.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, _scan, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(text=[redact(t, find(t)[1]) for t in batch["text"]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of :func:`scan` in ``text`` replaced by its kind in brackets; other columns stay."""
    return map_batches(docs, _redact, docs.schema)
