"""Text and value helpers as column functions; offsets and lengths are in code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SEVERITIES, UNIT_DAYS

#: White space in the wide sense: Java's class leaves out the Unicode spaces.
SPACES = r"[\s   -     　﻿]"
def ascii_edges(pattern: str) -> str:
    r"""A pattern whose ``\b`` is a word edge among ASCII letters, digits and underscore only.

    An edge before a word is a look behind, one after a word a look ahead.
    """
    parts = pattern.split(r"\b")
    out = parts[0]
    for part in parts[1:]:
        before = not out or out[-1] in "(|:" or out.endswith(("(?i)", "(?im)"))
        out += (r"(?<![A-Za-z0-9_])" if before else r"(?![A-Za-z0-9_])") + part
    return out


def matches(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """True if one of the patterns occurs; one combined expression."""
    return F.coalesce(text, F.lit("")).rlike(ascii_edges(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns)))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The text that the first pattern with a match matches first; null if none does."""
    found = [F.nullif(F.regexp_extract(text, ascii_edges("(?i)" + p), 0), F.lit("")) for p in patterns]
    return F.coalesce(*found)


def sanitize(text: Column, most: int = 2_000_000) -> Column:
    """No byte order mark, control, zero-width or direction characters; line ends and blank lines evened; trimmed; cut."""
    x = F.regexp_replace(text, r"^﻿", "")
    x = F.regexp_replace(x, r"[\u0000-\u0008\u000B\u000E-\u001F\u007F-\u009F​-‏‪-‮⁠-⁤⁦-⁩﻿]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.substring(F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""), 1, most)


def collapse(text: Column) -> Column:
    """White space runs become one space, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", " "))


def phrase(text: Column) -> Column:
    """The comparison key of a phrase: lower case, letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def ascii_phrase(text: Column) -> Column:
    """:func:`phrase` that keeps ASCII letters and digits only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def comparable(text: Column) -> Column:
    """The form in which quotes are looked up: sanitised, lower case, straight quotes, single spaces.

    Of printable ASCII with single spaces only the case changes, and one look tells such texts.
    """
    whole = collapse(F.translate(F.lower(sanitize(text)), "‘’“”", "''\"\""))
    return F.when(text.rlike(r"[^ -~]|  |^ | \z") | (F.length(text) > 2_000_000), whole).otherwise(F.coalesce(F.lower(text), F.lit("")))


def cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis if cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def cut_at_word(text: Column, most: int) -> Column:
    """Cut at the last space if that keeps over six tenths, then an ellipsis."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    spaced = (F.instr(head, " ") > 0) & (at > most * 0.6)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(spaced, F.substring(head, F.lit(1), at.cast("int"))).otherwise(head), F.lit("…")))


def redact_secret(value: Column) -> Column:
    """Up to 8 characters all stars, else 4, at most 24 stars, 4."""
    n = F.length(value)
    stars = F.repeat(F.lit("*"), F.least(F.lit(24), n - 8))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 4), stars, F.right(value, F.lit(4))))


def log_escape(text: Column) -> Column:
    """Control characters out, backslash and quote escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"[\u0000-\u001F\u007F]", ""), r'(["\\])', r"\\$1")


def slug(text: Column) -> Column:
    """A name part of an id: lower-case letters and digits with single hyphens, at most 32."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", ""), 1, 32), "-$", "")


def stable_hash(text: Column) -> Column:
    """Multiply-by-33-and-xor over the characters in 32 bits, in base 36."""
    step = lambda acc, c: F.pmod(acc * 33, F.lit(1 << 32)).bitwiseXOR(F.ascii(c))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    codes = F.aggregate(chars, F.lit(5381).cast("long"), lambda acc, c: step(acc, c).cast("long"))
    return F.lower(F.conv(codes.cast("string"), 10, 36))


def severity_rank(severity: Column) -> Column:
    """0 for the gravest; unknown words last."""
    known = F.array(*[F.lit(s) for s in SEVERITIES])
    at = F.array_position(known, severity)
    return F.when(at > 0, at - 1).otherwise(len(SEVERITIES) - 1).cast("int")


def in_days(amount: Column, unit: Column) -> Column:
    """A period in days."""
    return reduce(lambda acc, u: acc.when(unit == u, amount * UNIT_DAYS[u][0]), UNIT_DAYS, F.when(F.lit(False), amount))


def exact_unit(unit: Column) -> Column:
    return unit.isin([u for u, (_, exact) in UNIT_DAYS.items() if exact])


# Spelled numbers.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "forty-five": 45, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
_NUMBER = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
#: The letters that a number begins with are looked at first, so that most places of a text fail at once.
STARTS = rf"(?<![a-z0-9-])(?=[0-9{''.join(sorted({w[0] for w in NUMBER_WORDS}))}])"
PERIOD = rf"(?i){STARTS}(?:(?:{_NUMBER})\s*\((\d{{1,4}})\)|(\d{{1,4}})|({_NUMBER}))\s*(calendar\s+|business\s+|working\s+)?(day|week|month|year)s?(?![A-Za-z0-9_])"


def period(found: Column) -> Column:
    """T4: a stated period as ``struct<phrase, amount, unit, qualifier, n_days, exact>``."""
    words = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, n)])
    part = lambda g: F.nullif(F.regexp_extract(found, PERIOD, g), F.lit(""))
    amount = F.coalesce(F.coalesce(part(1), part(2)).cast("int"), words[F.lower(part(3))])
    unit = F.lower(part(5))
    return F.struct(
        collapse(found).alias("phrase"), amount.alias("amount"), unit.alias("unit"), F.lower(F.trim(part(4))).alias("qualifier"),
        in_days(amount, unit).alias("n_days"), exact_unit(unit).alias("exact"),
    )


def periods(text: Column) -> Column:
    """T4: ``array<struct<phrase, amount, unit, qualifier, n_days, exact>>`` of the periods stated, in order.

    Spelled numbers are read whole, so "seventeen days" is 17; "thirty (30) days" is 30.
    """
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PERIOD), F.lit(0)), period)


def _distinct_terms(terms: Column) -> Column:
    """The first of the terms with one key, in order."""
    keyed = F.transform(terms, lambda t: F.struct(phrase(t).alias("key"), collapse(t).alias("term")))
    fresh = lambda acc, t: F.when(F.exists(acc, lambda a: a["key"] == t["key"]) | (t["term"] == ""), acc).otherwise(F.concat(acc, F.array(t)))
    return F.transform(F.aggregate(keyed, F.slice(keyed, 1, 0), fresh), lambda t: t["term"])


def quoted_terms(text: Column) -> Column:
    """T5: terms in straight or curly quotes, 3 to 60 characters, first spelling of each."""
    text = F.coalesce(text, F.lit(""))
    straight = F.regexp_extract_all(text, F.lit(r'"([^"\n]{3,60})"'), F.lit(1))
    curly = F.regexp_extract_all(text, F.lit("“([^”\\n]{3,60})”"), F.lit(1))
    return _distinct_terms(F.concat(straight, curly))


# Words that start a sentence and not a term.
SENTENCE_STARTERS = "the this that these those a an any all each every if in on for to no not such where when unless provided".split()
CAPITALIZED = r"\b[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|of|and|the|to|for|in)){1,4}\b"


def capitalized_terms(text: Column) -> Column:
    """Runs of two to five capitalised words that do not begin like a sentence."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ascii_edges(CAPITALIZED)), F.lit(0))
    return _distinct_terms(F.filter(found, lambda t: ~F.lower(F.split(collapse(t), " ")[0]).isin(SENTENCE_STARTERS)))


def event_key(text: Column) -> Column:
    """What a deadline is about: no periods, no within/after/from, the first eight words."""
    x = F.regexp_replace(collapse(text), ascii_edges(r"(?i)\b\d+\s*(?:days?|weeks?|months?|years?)\b"), "")
    return F.array_join(F.slice(F.split(phrase(F.regexp_replace(x, ascii_edges(r"(?i)\b(?:within|after|from)\b"), "")), " "), 1, 8), " ")


def clause_number(value: Column) -> Column:
    """Digits and dots of a clause number, without a leading word."""
    raw = F.regexp_replace(collapse(value), r"(?i)^(?:clause|section|paragraph|schedule|appendix)\s+", "")
    return F.regexp_replace(F.regexp_replace(raw, r"[^0-9.]", ""), r"\.0+$", "")


# The words that a question's search leaves out.
STOP_WORDS = (
    "the a an and or of to in on for is are was were be been with by at from as that this these those it its we they them he she if then than there here "
    "what which who whom when where how why do does did can could should would will shall may might must not no yes about into under over after before any "
    "all each other such my our your their"
).split()


def question_terms(question: Column) -> Column:
    """A1: lower-case terms of a question in order, repeats kept."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"[^a-z0-9.\s'-]", " "), r"\s+")
    bare = F.transform(parts, lambda t: F.regexp_replace(t, r"^[.'-]+|[.'-]+$", ""))
    return F.filter(bare, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


# Wordings that try to redirect a model that reads the text.
INJECTIONS = [
    ("ignore-instructions", r"(?i)ignore\s+(?:all\s+)?(?:the\s+)?(?:previous|above|prior)\s+(?:instructions|prompts|rules)"),
    ("disregard-instructions", r"(?i)disregard\s+(?:all\s+)?(?:previous|above|prior|the)\s+\w+"),
    ("role-override", r"(?i)\b(?:you\s+are\s+now|act\s+as|pretend\s+to\s+be|from\s+now\s+on\s+you)\b"),
    ("system-tag", r"(?i)<\|?\s*(?:system|assistant|developer|tool)\s*\|?>"),
    ("system-prefix", r"(?im)^\s*(?:system|assistant)\s*:"),
    ("schema-override", r"(?i)\b(?:do\s+not\s+(?:return|output|follow)|instead\s+return|output\s+only|respond\s+only)\b"),
    ("tool-invocation", r"(?i)\b(?:execute|run)\s+(?:this\s+)?(?:code|command|script)\b"),
    ("secret-exfiltration", r"(?i)\b(?:api[_\s-]?key|token|credential|password)\b\s*[:=]"),
]


def injections(text: Column, most: int = 10) -> Column:
    """``array<struct<name, found>>``, in the order of the patterns, at most ``most``."""
    each = [_named(text, name, p) for name, p in INJECTIONS]
    return F.slice(F.concat(*each), 1, most)


def _named(text: Column, name: str, pattern: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ascii_edges(pattern)), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.lit(name).alias("name"), m.alias("found")))


def neutralize(text: Column) -> Column:
    """Each such wording in brackets that mark it as text of the document."""
    return reduce(lambda x, p: F.regexp_replace(x, ascii_edges(p[1]), r"[document text: $0]"), INJECTIONS, text)


FENCE = "<<<UNTRUSTED_DOCUMENT_TEXT>>>"


def fenced(text: Column, label: str, most: int = 48_000) -> Column:
    """Untrusted text cut, neutralised and put between fences that it cannot contain."""
    inner = F.replace(neutralize(F.substring(text, 1, most)), F.lit(FENCE), F.lit("<< <fence> >>"))
    return F.concat_ws("\n", F.lit(f"{label}:"), F.lit(FENCE), inner, F.lit(FENCE))


def clean_question(question: Column, most: int = 500) -> Column:
    """A question made safe: neutralised, single spaces, cut at a word."""
    return cut_at_word(collapse(neutralize(sanitize(question))), most)


# Shapes of secrets.
SECRETS = {
    "google-api-key": r"AIza[0-9A-Za-z_-]{35}",
    "openai-key": r"sk-[A-Za-z0-9_-]{20,}",
    "github-token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "private-key-block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer-token": r"(?i)bearer\s+[A-Za-z0-9._~+/-]{20,}",
}


def secrets(text: Column) -> Column:
    """``array<struct<name, found>>`` of the secrets in a text."""
    return F.concat(*[_named(text, name, p) for name, p in SECRETS.items()])
