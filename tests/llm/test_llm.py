"""The operators of the llm subpackage against brute force, round trips and held-out accuracy."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import ann_srs, extract, imatch, langid, licenses, mixing, pieces, pii, superminhash, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(1, None, "en", "a", 0, 7), (2, "", None, None, 0, 7), (3, "word " * 50_000, "en", "a", 1, 7), (4, "Ein Satz.", None, None, 1, None), (4, "Ein Satz.", None, None, 1, None), (None, "no id here at all", "en", "b", 1, 7), (5, "\t\n ", "fr", "b", 3, 7)]
    return spark.createDataFrame(rows, DOCS + ", node int").withColumn("band", F.lit(1)).withColumn("size", F.lit("x"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- nearest neighbours ------------------------------------------------------------------------


def test_neighbours_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    got = defaultdict(list)
    for r in ann_srs.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    met = 0
    for q, found in got.items():
        found.sort()
        best = sorted((-float(v @ rows[q]), i) for i, v in rows.items() if i != q)[:20]
        met += len({i for _, i in best} & {i for _, i, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - rows[q] @ rows[i]) < 1e-9 for _, i, s in found)
    assert met >= 0.9 * 20 * len(got) and len(got) == sum(q % 20 == 0 for q in rows)


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (None, [1.0, 1.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0]), (4, [None, 1.0]), (5, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann_srs.nearest(table, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 2, 2.0), (0, 2, 3, 2.0)]
    assert ann_srs.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_nearest(rows, k):
    """Of ``(vec_id, vector)`` the ``k`` best ids and scores of each id divisible by 20, over all others."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    out = {}
    for q in {i for i in ids.tolist() if i % 20 == 0}:
        best = {}
        for mine in v[ids == q]:
            for i, s in zip(ids.tolist(), (v @ mine).tolist(), strict=True):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), s)
        out[q] = sorted((-s, i) for i, s in best.items())[:k]
    return out


@pytest.mark.parametrize("spread", [0.05, 0.3, 1.0])
def test_neighbours_over_many_blocks(spark, spread):
    """Many cells, a hot vector that fills several blocks, ids with several vectors: recall, and how much is not looked at."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + spread * rng.standard_normal(16)).tolist()) for i in range(4_000)]
    rows += [(i, [1.0] * 16) for i in range(4_000, 5_500)] + [(7, rng.standard_normal(16).tolist()), (7, [3.0] * 16), (40, [2.0] * 16)]
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("bound", F.lit(1))
    work = []
    got = defaultdict(list)
    for r in ann_srs.nearest(table, F.col("vec_id") % 20 == 0, k=10, block=500, work=work).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows, 10)
    met = 0
    for q, best in want.items():
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11)) and len({i for _, i, _ in found}) == 10
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        met += sum(s >= -best[-1][0] - 1e-9 for _, _, s in found)
    assert met >= 0.9 * 10 * len(want)
    n_queries = sum(i % 20 == 0 for i, _ in rows)
    assert work[1] < {0.05: 0.5, 0.3: 0.5, 1.0: 0.9}[spread] * n_queries * len(rows)


# --- near-duplicates ---------------------------------------------------------------------------


def brute_components(rows, words, percent):
    sets = {}
    for ident, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(words, len(w))
        sets[ident] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_brute(docs, words, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in superminhash.near_duplicates(docs, words, percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_family_of_edited_copies(spark):
    """Members that meet in many buckets, some linked only through others: the second round finds the rest."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 7))):
            w[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_duplicates_odd_rows(odd, none):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(odd, 3, 85).collect())
    assert got == [(-1, 3, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True)]
    assert superminhash.near_duplicates(none).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    sig = superminhash.signatures([np.unique(a), np.unique(b)], 1024)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.06


# --- personal data -----------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    keep = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(d := re.sub("[ -]", "", s)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
        "phone": lambda s: 9 <= sum(c in "0123456789" for c in s) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text or "") if keep[k](m[0])] for k, p in BASE.items()}


HARD = ["a@b.c d@e", "x@y@z.com", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "1234 5678-9012 3456 4111111111111111", "+49 (30) 1234-567.", "++1234567890", "a.b@c-d.e.", "4111 1111 1111 1111 1", "٣.1.1.1.1", "", "@" * 50, "1." * 30]


def test_pii_base_is_the_contract(spark, docs):
    texts = [r["text"] for r in docs.select("text").collect()] + HARD
    for text in texts:
        assert pii.find(text)[0] == brute_spans(text)


def test_pii_scan_and_disguises(spark, odd, none):
    rows = [(1, "write to jane [at] example [dot] com now"), (2, "call plus four nine three zero one two three four five six seven"), (3, "mail jоhn@example.com"), (4, "meet at example.com tomorrow")]
    got = {r["doc_id"]: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["spans"] == "email:9:36" and got[1]["n_email"] == 0 and rows[0][1][9:36] == "jane [at] example [dot] com"
    assert got[2]["spans"].startswith("phone:5:") and got[4]["spans"] == ""
    assert "email:5:21" in got[3]["spans"]
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.scan(odd).count() == 7 and pii.scan(none).count() == 0
    assert pii.redact("a jane@x.org b", pii.find("a jane@x.org b")[1]) == "a [EMAIL] b"


@pytest.mark.parametrize("mark", ["\u00ad", "\u200b", "\u200d", "\u2060", "\ufeff"])
@pytest.mark.parametrize(("kind", "parts"), [("email", ("jane@exam", "ple.com")), ("ip", ("10.20.", "30.40")), ("card", ("4111 1111 ", "1111 1111")), ("phone", ("+49 30 ", "1234567"))])
def test_pii_broken_by_deleted_characters(kind, parts, mark):
    text = f"so {mark}{mark.join(parts)}{mark} it is"
    base, every = pii.find(text)
    assert every[kind] == [(4, 5 + len("".join(parts)))] and base[kind] == []
    assert pii.redact(text, every) == f"so {mark}[{kind.upper()}]{mark} it is"


# --- fingerprints ------------------------------------------------------------------------------


def test_fingerprints(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    ids = sorted(rows)
    by_text = {}
    for n, i in enumerate(ids):
        text, nxt, k = rows[i], rows[ids[(n + 1) % len(ids)]], len(rows[i]) // 4
        edited = text[: len(text) - k] + nxt[:k]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert sum(g["near_edited"] for g in got.values()) > sum(g["near_next"] for g in got.values()) + 0.2 * len(ids)


def test_lexicon_is_the_band(spark, docs):
    """Exactly the terms within the band, whatever the number of buckets; a look-up finds these and no others."""
    sets = [set(re.findall(r"[^\W_]+", (r["text"] or "").lower())) for r in docs.collect()]
    df = defaultdict(int)
    for x in sets:
        for term in x:
            df[term] += 1
    band = {t for t, n in df.items() if max(2, 0.001 * len(sets)) <= n <= max(2, 0.1 * len(sets))}
    hashed = lambda terms: {r["h"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.xxhash64("t").alias("h")).collect()}
    for buckets in (1 << 16, 7):
        row = imatch.lexicon(docs, buckets=buckets).first()["lexicon"]
        assert len(row) == buckets and {h for part in row for h in part} == hashed(band)
    some = sorted(band)[:50] + sorted(set(df) - band)[:50]
    words = imatch.lexicon(docs, buckets=7).crossJoin(spark.createDataFrame([(some,)], "terms array<string>")).select("lexicon", F.transform("terms", lambda t: F.xxhash64(t)).alias("terms"))
    assert set(words.select(imatch.lexicon_terms(F.col("terms"), F.col("lexicon"), 7).alias("x")).first()["x"]) == hashed(some[:50])


def test_fingerprints_odd_rows(odd, none):
    got = imatch.fingerprints(odd).collect()
    assert len(got) == 7 and imatch.fingerprints(none).count() == 0
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 4}) == 1


# --- archives ----------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    long, other = "<p>ä</p>" * 200, "<b>" * 700
    rows = [(1, "u1", long), (2, "u 2\n", long), (9, None, long), (3, "u3", "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", other), (None, "u7", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive(pages).collect()}
    assert len(got) == 8
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 6)}
    assert warc.archive(pages.limit(0)).count() == 0


def test_records_at_every_cut():
    """Pieces of any length: a head, a body and what separates records may straddle a cut anywhere."""
    rows = [warc.record(1, "u", b"<p>" * 20), warc.record(2, "v", b""), warc.record(3, None, b"x" * 90, 1)]
    whole = b"".join(rows)
    want = [r.rstrip(b"\r\n") for r in rows]
    for size in [*range(1, 40), *range(40, len(whole) + 2, 7)]:
        got = [raw.rstrip(b"\r\n") for _, raw in warc.records(iter([whole[a : a + size] for a in range(0, len(whole), size)]))]
        assert got == want
    for cut in range(len(whole)):
        assert len(list(warc.records(iter([whole[:cut], whole[cut:]])))) == 3
    with pytest.raises(ValueError):
        list(warc.records(iter([whole[:30]])))


def test_archives_of_many_pieces(spark):
    """Archives over several pieces, a payload longer than a piece, a hot payload, clashing columns."""
    rows = [(i, "u", ("hot " * 400) if i % 3 == 0 else f"<p>{i}</p>" * (300_000 if i == 7 else 300), i) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, top int").withColumn("digest", F.lit("x")).coalesce(1)
    got = {r["page_id"]: r for r in warc.archive(pages, archive_bytes=1 << 20).collect()}
    assert len(got) == 120
    for i, _, html, _ in rows:
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(html), hashlib.sha1(html.encode()).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 117) if i % 3 == 0 and i < 117 else ("response", None))
    assert len({r["archive"] for r in got.values()}) > 1


# --- licences ----------------------------------------------------------------------------------


def test_licence_inheritance(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "print()"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0."), ("z.py", "x"), ("a/b/c/x.py", None), (None, "MIT License"), ("a//b/COPYING.txt", ""), ("q/w.py", "")]
    got = {r["path"]: (r["licence"], r["origin"], r["from_directory"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string").withColumn("term", F.lit(1))).collect()}
    assert got == {"a/LICENSE": ("MIT", "own", None), "a/b/c/x.py": ("MIT", "inherited", "a"), "a/b/y.py": ("Apache-2.0", "own", None), "z.py": (None, "none", None), "a/b/COPYING.txt": ("MIT", "inherited", "a"), "q/w.py": (None, "none", None)}


GPL3 = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main() {}
"""
WRAPPED = {
    "gpl3.c": (GPL3, "GPL-3.0"), "gpl2.c": (GPL3.replace("version 3", "version 2"), "GPL-2.0"),
    "lgpl.py": ("\n".join("# " + x for x in GPL3.split("\n")).replace("program", "library").replace("General Public", "Lesser General Public").replace("version 3", "version 2.1"), "LGPL-2.1"),
    "isc.js": ("// Copyright (c) 2020, Someone\n//\n// Permission to use, copy, modify, and/or distribute this software for any\n// purpose with or without fee is hereby granted, provided that the above\n// copyright notice and this permission notice appear in all copies.\n\nvar x;", "ISC"),
    "epl.java": ("/*\n * This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License 2.0 which is available at\n * https://www.eclipse.org/legal/epl-2.0/\n */", "EPL-2.0"),
    "apache.py": ('# Copyright 2021 Someone\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\nimport os', "Apache-2.0"),
    "spdx.c": ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), "both.rs": ("/* SPDX-License-Identifier: (mit or Apache-2.0) */\n", "(mit OR Apache-2.0)"),
    "with.c": ("# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\nx", "GPL-2.0-only WITH Linux-syscall-note"),
    "m/LICENSE": (f"MIT License\n\nCopyright (c) 2020 Some One\n\n{licenses._MIT}\n\n{licenses._MIT_KEEP}\n\n{licenses._AS_IS}\n", "MIT"),
    "b/LICENSE.txt": (f"Copyright (c) 2020, Some One\n\n{licenses._BSD}\n\n{licenses._BSD_2}\n\n{licenses._BSD_AS_IS}\n", "BSD-2-Clause"),
    "long.txt": ("prose without any cue " * 20_000 + "\nReleased under the MIT License.\n", "MIT"), "none.txt": ("We need a license to drive, and copyright is a topic of law.", None),
}


def test_licence_headers_and_files(spark):
    """Wrapped headers, SPDX expressions, whole licence files; extra columns and a very long text."""
    files = spark.createDataFrame([(p, t) for p, (t, _) in WRAPPED.items()], "path string, text string").withColumn("licence", F.lit("x")).withColumn("score", F.lit(1))
    got = {r["path"]: r for r in licenses.scan(files).collect()}
    assert {p: got[p]["licence"] for p in WRAPPED} == {p: want for p, (_, want) in WRAPPED.items()}
    assert licenses.scan(files.limit(0)).count() == 0


def test_licence_cosine_by_brute_force(spark, docs):
    """The score of each document's own licence is the best cosine over its segments, and no template within reach is missed."""
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    split = lambda text: [w for w in re.split(r"[^a-z0-9.]+|\.(?![0-9])", text.lower()) if w]
    n, df = len(licenses.TEMPLATES), defaultdict(int)
    for _, text in licenses.TEMPLATES:
        for w in set(split(text)):
            df[w] += 1
    idf = lambda w: np.log((1 + n) / (1 + df[w])) + 1 if w in df else np.log((1 + n) / 2) + 1

    def vector(text):
        out = defaultdict(float)
        for w in split(text):
            out[w] += idf(w)
        return out, np.sqrt(sum(x * x for x in out.values()))

    known = [(name, *vector(text)) for name, text in licenses.TEMPLATES]
    best = {}
    for r in licenses.segments(files).collect():
        v, length = vector(r["segment"])
        for name, t, norm in known:
            score = round(sum(x * t[w] for w, x in v.items() if w in t) / (length * norm), 9) if length else 0.0
            if score >= licenses.LEAST:
                best[r["path"]] = min(best.get(r["path"], (0.0, "")), (-score, name))
    got = {r["path"]: (-r["score"], r["licence"]) for r in licenses.own_licences(files).collect()}
    assert got.keys() == best.keys() and len(best) >= 3
    assert all(abs(got[p][0] - best[p][0]) < 1e-6 and got[p][1] == best[p][1] for p in best)


# --- language ----------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, none, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = langid.train(docs.where(~langid.held_out()))
    got = langid.identify(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n
    found = {r["doc_id"]: r for r in langid.identify(odd, trees).collect()}
    assert {found[i]["lang_pred"] for i in (1, 2, 5)} == {"und"} and found[4]["lang_pred"] == "de"
    assert langid.identify(none, langid.train(none)).count() == 0


def brute_bits(learnt, text, order):
    """Prediction by partial matching with escape method C, a byte at a time, from all counts of all contexts."""
    seen = defaultdict(lambda: defaultdict(int))
    for t in learnt:
        raw = b" " * order + langid.coded(t)
        for i in range(order, len(raw)):
            for k in range(order + 1):
                seen[raw[i - k : i]][raw[i]] += 1
    raw, bits = b" " * order + langid.coded(text), 0.0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            after = seen.get(raw[i - k : i])
            if after is None:
                continue
            both = sum(after.values()) + len(after)
            if raw[i] in after:
                bits -= np.log2(after[raw[i]] / both)
                break
            bits -= np.log2(len(after) / both)
        else:
            bits += 8.0
    return bits


def test_code_lengths_are_those_of_ppm(monkeypatch):
    learnt = {"x": ["the cat sat on the mat", "that hat"], "y": ["der Hund und die Katze", "den Hut", "ü"]}
    trees = langid.ContextTrees.of_texts(learnt).freeze()
    texts = ["the hat", "der cat und", "zzz  zz", "Ünd", "a" * 50, "the der " * 30]
    for limit in (langid.PASS, 64, 7):
        monkeypatch.setattr(langid, "PASS", limit)
        for text, (bits, n) in zip(texts, trees.text_bits(texts), strict=True):
            assert n == len(langid.coded(text)) and np.allclose(bits, [brute_bits(learnt[lang], text, 4) for lang in "xy"])


def test_language_sample_of_any_size(spark):
    """The share of hashes is kept at billions of documents; a language of a few hot texts is learnt once each."""
    for docs in (10**4, 3 * 10**9, 10**13):
        assert abs((langid.hash_limit(2_000 / docs) + 2**63) / 2**64 * docs - 2_000) < 1
    assert langid.hash_limit(1.0) == langid.hash_limit(7.5) == 2**63 - 1
    rows = [("the cat sat on the mat", "en")] * 3_000 + [("der Hund und die Katze", "de")] * 3 + [(None, "fr"), ("le chat", None)]
    table = spark.createDataFrame(rows, "text string, lang string").withColumn("gram", F.lit(1))
    trees = langid.train(table, sample_docs=5)
    want = langid.ContextTrees.of_texts({"en": [rows[0][0]], "de": [rows[3_000][0]]})
    assert trees.languages == ["de", "en"]
    for lang in trees.languages:
        assert all((a == b).all() for a, b in zip(trees.grams[lang], want.grams[lang], strict=True))


# --- mixing ------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, docs):
    first = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert {i: r["taken"] for i, r in first.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    size, target, taken, longest = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    for i, r in first.items():
        s = r["source"]
        assert r["size"] == words[i] and 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        size[s], target[s], taken[s], longest[s] = size[s] + r["size"], r["target"], taken[s] + r["taken"], max(longest[s], r["size"])
    goal, open_, left = {}, {s: 1 + n % 3 for n, s in enumerate(sorted(size))}, float(sum(size.values()))
    while open_:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if level * w >= 3 * size[s]]
        for s in over or list(open_):
            goal[s] = min(3.0 * size[s], level * open_.pop(s))
        left -= sum(goal[s] for s in over)
        if not over:
            break
    assert all(abs(goal[s] - target[s]) < 1e-6 * max(1, goal[s]) for s in size)
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in size)


def test_mixing_small_source_with_a_long_text_beside_a_large_one(spark):
    """Whatever blocks the other sources have, a source comes near its target, however long its longest document is."""
    rows = [(i, "w " * (40 + i * 37 % 260), "a") for i in range(300)] + [(300, "w " * 20_000, "a")]
    rows += [(1_000 + i, "w " * (40 + i * 91 % 500), "b") for i in range(9_000)] + [(20_000, "w " * 60_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 60), share=0.5)
    for r in got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 300, r
    assert got.where("taken > 3 * size or taken % size <> 0").count() == 0


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == 7 and all(r["taken"] == 0 for r in got if r["size"] == 0) and mixing.mix(none).count() == 0


# --- pieces ------------------------------------------------------------------------------------


def test_pieces_round_trip_and_dropout(docs, odd):
    for table in (docs, odd):
        out = pieces.encode(table)
        assert out.where("not lossless").count() == 0
        back = pieces.decode(out.select("doc_id", "pieces")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        assert back.exceptAll(table.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).count() == 0


def test_pieces_without_dropout_match_the_public_encoder(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.Pieces(dropout=0.0)
    for text in ["hello world", "A longer sentence, with commas and unusual words.", "x  y"]:
        assert model.decode(model.encode(text)) == text
    assert model.encode("hello world") == [i for i in sp.encode("hello world")] or model.encode(" hello world") == sp.encode("hello world")
    assert pieces.Pieces(seed=1).encode("internationalisation of everything", 3) != model.encode("internationalisation of everything") or pieces.Pieces(seed=2).encode("internationalisation of everything", 3) != model.encode("internationalisation of everything")


def test_every_occurrence_is_split_for_itself(spark):
    """A word repeated in one document, and at the same place of many documents, has many segmentations."""
    word = " internationalisation"
    model, text = pieces.Pieces(), word * 400
    assert model.decode(model.encode(text, 1)) == text
    keys = model.keys([text], [1], [400])
    alone = [model.segment(word, int(k)) for k in keys]
    assert model.encode_parts([word] * 400, keys) == model.encode_parts([word] * 400, keys) == alone == model.segments([word] * 400, keys)
    assert len(set(alone)) > 20 and model.encode(text, 1) == [i for ids in alone for i in ids]
    docs = spark.createDataFrame([(i, word[1:]) for i in range(300)], "doc_id long, text string")
    assert pieces.encode(docs).select("pieces").distinct().count() > 20
    first = []
    for key in model.keys([text], [2], [400]):
        asked = []
        model.segment(word, int(key), asked)
        first.append(asked[0][2])
    assert abs(np.mean(first) - pieces.DROPOUT) < 0.05


# --- main text ---------------------------------------------------------------------------------


def test_main_text():
    html = "<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line</h1><p>First\n  paragraph with <b>bold</b> words, long enough to count.<p>Second.<script>x()</script></article><div id='comments'><p>Reader says</p></div><footer>Imprint</footer></body></html>"
    assert extract.main_text(html) == "Head & line\n\nFirst paragraph with bold words, long enough to count.\n\nSecond."
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav>Menu</nav>") == ""


LONG = "A paragraph that is long enough to stand well above the threshold of the page, with more words than any of the others has. " * 4


@pytest.mark.parametrize("html", [
    "<body><article><p>One. {0}</p></article><article><h2>Two</h2><p>Short.</p></article><article><p>Three. {0}</p></article></body>",
    "<body><main><h1>Title</h1><article><p>{0}</p><p>{0}</p></article><p>closing</p></main></body>",
    "<body><h1>Title</h1><article><p>{0}</p></article><p>{0}</p></body>",
    "<body><h1>Title</h1><div><p>{0}</p><p>{0}</p><p>{0}</p></div><p>closing</p></body>",
    "<body><div><p>{0}</p></div><div><p>short</p></div><blockquote>{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}</blockquote></body>",
])
def test_main_text_is_whole(html):
    """Several articles, text beside the article, and plain elements with most of the text: nothing is lost."""
    page = html.format(LONG)
    assert extract.main_text(page).split() == re.sub("<[^>]*>", " ", page).split()


def test_ratios_decide_what_is_content(monkeypatch):
    """Without any element or name to go by, the ratios find the text; turned round, they find something else."""
    links = "<div>" + "<a href='x'>Some link</a><br>" * 8 + "</div>"
    page = f"<body><div>{'<span><i><b>Go</b></i></span><div>On</div>' * 9}</div>{links}<div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{links}<div>{'<div>x</div>' * 20}</div></body>"
    assert extract.main_text(page).split() == ["Head", *LONG.split(), "Short.", *LONG.split()]
    plain = f"<body><nav>{links}</nav><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article></body>"
    right = [extract.main_text(p) for p in (page, plain)]
    monkeypatch.setattr(extract, "clustered", lambda ratio: (level := extract.smoothed(-np.log1p(ratio))) >= level.mean())
    assert all(extract.main_text(p) != r for p, r in zip((page, plain), right, strict=True))


@pytest.mark.parametrize(("html", "want"), [
    ("<body><div class='promo'><article><p>Real text</p></article></div></body>", "Real text"),
    ("<body><div class='social-study'><p>{0}</p></div><nav>Menu</nav></body>", "{0}"),
    ("<body><article><p>Real text here</p></article><div class='promo'><p>{0}</p></div></body>", "Real text here"),
    ("<body><article><p>{0}</p></article><div id='comments'><article><h1>Re</h1><p>{0}{0}{0}</p></article></div></body>", "{0}"),
    ("<body>" + "<p>same line</p>" * 5 + "</body>", "\n\n".join(["same line"] * 5)),
])
def test_names_and_ties(html, want):
    assert extract.main_text(html.format(LONG.strip())) == want.format(LONG.strip())


def test_deep_and_long_pages():
    """Unclosed elements at any depth, and stray end tags, in linear time; a very long text is whole."""
    n = 20_000
    assert extract.main_text("<div>x " * n).split() == ["x"] * n
    assert extract.main_text("<b>x " * n + "</p>" * n).split() == ["x"] * n
    assert len(extract.main_text(f"<p>{'word ' * 500_000}</p>")) == 2_499_999


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Some text</p>", 1), (1, "u", "<p>Some text</p>", 1), (None, None, None, 1)], "page_id long, url string, html string, text int")
    assert sorted((r["text"], r["n_chars"]) for r in extract.extract(pages).collect()) == [("", 0), ("Some text", 9), ("Some text", 9)]
    wide = pages.withColumn("n_chars", F.lit("x")).withColumn("named", F.lit(1))
    assert extract.extract(wide).columns == ["page_id", "url", "text", "n_chars"]
    assert extract.extract(pages.limit(0)).count() == 0
