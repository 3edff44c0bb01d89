"""The operators on whitening, set joins and spelling variants, and what all operators owe to ids."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import ann_srs, extract, langid, mixing, pieces, pii, queries, spelling, superminhash, tiles, warc, whitening

SF = "/root/testdata/sf0.001"


# --- whitening ---------------------------------------------------------------------------------


def brute_whitened(rows, k):
    """n, sums, deviations, components, variances and trace by one covariance matrix over the distinct x vectors."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    return n, ((x * n - s) ** 2).sum(axis=1), ((x * n - s) / n) @ axes[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_by_brute_force(spark):
    """A given table with copies of rows and a hot vector, over more partitions than parts are merged at once."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    rows += rows[:40] + [(10_000 + i, rows[3][1]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(30).withColumn("width", F.lit("x")).withColumn("part", F.lit(1))
    n, deviation, w, share = brute_whitened([v for _, v in rows], 16)
    want = {}
    for (i, _), d, row in zip(rows, deviation.tolist(), w, strict=True):
        want[i] = (d, row)
    got = whitening.whitened(frame).collect()
    assert len(got) == 16 * len(rows)
    sign = {}
    for r in got:
        d, row = want[r["vec_id"]]
        k = r["component"] - 1
        sign.setdefault(k, np.sign(r["whitened"] * row[k]))
        assert (r["n"], r["deviation"]) == (n, d) and abs(sign[k] * r["whitened"] - row[k]) < 1e-8
        assert abs(r["explained"] / share[k] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_merges_lose_nothing():
    """Parts of far apart means, one with a single row, one of rank two: merged as all rows at once."""
    rng = np.random.default_rng(2)
    blocks = [rng.integers(-9, 9, (40, 6)) + 10_000 * i for i in range(5)] + [np.array([[1, 2, 3, 4, 5, 6]]), np.outer(rng.integers(0, 9, 30), [1, 0, 2, 0, 0, 1])]
    rows = np.concatenate(blocks)
    part = whitening.fold([whitening.Part.of(b) for b in blocks])
    s = rows.sum(axis=0)
    centred = (rows * len(rows) - s) / len(rows)
    assert part.n == len(rows) and part.sums == s.tolist()
    np.testing.assert_allclose(part.axes.T @ np.diag(part.values**2) @ part.axes, centred.T @ centred, rtol=1e-10, atol=1e-4)


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("-inf"), 1.0]), (None, [3.0, 4.5]), (2**63 - 1, [1.0, 5.0]), (6, [1.0, 2.0, 3.0]), (7, []), (-3, [0.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"] or 0, r["component"], r["n"], r["deviation"], r["whitened"] is None) for r in whitening.whitened(table).collect()))
    two = lambda i, d: [(i, 1, 3, d, False), (i, 2, 3, d, False)]
    assert got == sorted([(-3, 1, 1, 0, True), *two(0, 81920), *two(1, 140288), *two(1, 140288), *[(6, c, 1, 0, True) for c in (1, 2, 3)], *two(2**63 - 1, 66560)])
    assert whitening.whitened(table.limit(0)).count() == 0
    wide = spark.createDataFrame([(1, [float(2**39)]), (2, [float(-(2**39))])], "vec_id long, embedding array<double>")
    assert {(r["n"], r["deviation"], abs(r["whitened"])) for r in whitening.whitened(wide).collect()} == {(2, None, 1.0)}


# --- ids ---------------------------------------------------------------------------------------

IDS = [None, -5, 0, 2**53 + 1, 2**63 - 1]


def test_ids_stay_whole(spark):
    """Null, negative and 64-bit ids in one batch come back as they are."""
    text = "The tenant mails jane@example.com from the house by the river, number {} of all."
    docs = spark.createDataFrame([(i, text.format(n) * 3, "en", "a", 1) for n, i in enumerate(IDS)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    ids = lambda df, name="doc_id": sorted((r[name] for r in df.collect()), key=lambda i: (i is not None, i))
    trees = langid.train(docs)
    for df in (pii.scan(docs), pii.redacted(docs), pieces.encode(docs), pieces.decode(pieces.encode(docs)), superminhash.near_duplicates(docs), langid.identify(docs, trees), langid.accepted(docs, trees), mixing.mix(docs)):
        assert ids(df) == IDS
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert ids(extract.extract(pages), "page_id") == IDS and ids(warc.archive(pages), "page_id") == IDS


def test_licence_ids_stay_whole(spark, tmp_path):
    """Ids come back from the query on files: null, negative, large, with a source that ends in digits."""
    rows = [(i, "Released under the MIT License.", "src7") for i in IDS]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_licenses(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i)) == IDS and {r["licence"] for r in got} == {"MIT"}


@pytest.mark.parametrize("many", [False, True])
def test_neighbours_of_negative_and_repeated_ids(spark, many):
    """Negative ids are queries and neighbours; an id with thousands of vectors is one neighbour."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 8))
    rows = [(-20 * i, x.tolist()) for i, x in enumerate(v)] + [(2**53 + 1, v[0].tolist())]
    if many:
        rows += [(17, x.tolist()) for x in rng.standard_normal((5_000, 8))]
    ids, all_v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    got = {}
    for r in ann_srs.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5, block=1_000).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    met = 0
    for i, x in enumerate(v):
        best = {}
        for j, s in zip(ids.tolist(), (all_v @ x).tolist(), strict=True):
            if j != -20 * i:
                best[j] = max(best.get(j, -np.inf), s)
        fifth = sorted(best.values())[-5]
        met += sum(s >= fifth - 1e-9 for s in got[-20 * i].values())
        assert len(got[-20 * i]) == 5
    assert met >= 0.9 * 5 * len(v)


# --- set join ----------------------------------------------------------------------------------


def shingle_set(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    k = min(words, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_links(rows, percent=80):
    """Linked pairs of different sets, and the smallest id that each document reaches."""
    sets = {i: shingle_set(t) for i, t in rows}
    distinct = sorted({s for s in sets.values() if s}, key=lambda s: (len(s), sorted(s)))
    links = [(a, b) for n, a in enumerate(distinct) for b in distinct[n + 1 :] if 100 * len(a & b) >= percent * len(a | b)]
    up = {s: s for s in distinct}

    def root(s):
        while up[s] is not s:
            s = up[s]
        return s

    for a, b in links:
        if (x := root(a)) is not (y := root(b)):
            up[x] = y
    low = {}
    for i, s in sets.items():
        if s:
            low[root(s)] = min(low.get(root(s), i), i)
    return links, {i: (len(s), low[root(s)] if s else i) for i, s in sets.items()}


def family(n, edits, seed=5, length=120):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 900, length)]
    for i in range(n):
        w = list(base)
        for at in rng.integers(0, length, int(rng.integers(0, edits))):
            w[at] = f"x{rng.integers(0, 40)}"
        yield i, " ".join(w)


@pytest.mark.parametrize("percent", [80, 100])
def test_tiles_by_brute_force(spark, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_links([(r["doc_id"], r["text"]) for r in docs.collect()], percent)[1]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in tiles.components(docs, percent=percent).collect()} == want


def test_tiles_of_a_family(spark, monkeypatch):
    """Edited copies that meet in hot tiles, cut into blocks; some linked only through others; lengths that fill several bands."""
    monkeypatch.setattr(tiles, "BLOCK", 32)
    rows = list(family(220, 5)) + [(1_000 + i, " ".join(t.split()[: 60 + i])) for i, t in family(60, 2, seed=5)] + [(2_000 + i, " ".join(f"v{j}" for j in range(5, 5 + i))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    links, want = brute_links(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in tiles.components(docs).collect()} == want
    pairs, members = tiles.similar(docs)
    found = pairs.collect()
    node = {r["doc_id"]: r["node"] for r in members.collect()}
    sets = {bytes(node[i]): shingle_set(t) for i, t in rows if node[i] is not None}
    got = {frozenset((sets[bytes(r["a"])], sets[bytes(r["b"])])) for r in found}
    assert len(found) == len(links) and got == {frozenset(p) for p in links}
    assert all((r["overlap"], r["n_union"]) == (len(x & y), len(x | y)) for r in found for x, y in [(sets[bytes(r["a"])], sets[bytes(r["b"])])])


def test_bitmaps_never_exceed_the_difference():
    """The bits by which two bitmaps differ, of any sizes, are at most the elements by which the sets do."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3_000, n).astype(np.uint64)) for n in (1, 5, 64, 65, 300, 2_000, 9_000)]
    maps = tiles.Bitmaps([tiles.bitmap(s).tobytes() for s in sets])
    x, y = (a.reshape(-1) for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    for a, b, d in zip(x, y, maps.apart(x, y), strict=True):
        assert d <= len(np.setxor1d(sets[a], sets[b])) and (a != b or d == 0)


def test_tiles_odd_rows(spark):
    """Null, empty, blank, short and very long texts, copies, null ids, clashing columns, an empty table."""
    long = " ".join(f"w{i % 4_000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (6, "two one"), (9, long), (8, long + " w0 w1 w2 w3 w4"), (None, "one two"), (None, "lone text without an id at all"), (2**63 - 1, "number of all"), (-7, "number of all")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("n", F.lit("x")).withColumn("members", F.lit(0))
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in tiles.components(table).collect()))
    n = len(shingle_set(long))
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (9, n, 8), (8, n, 8), (0, 1, 4), (0, 3, 0), (2**63 - 1, 1, -7), (-7, 1, -7)])
    assert tiles.components(table.limit(0)).count() == 0


# --- spelling variants -------------------------------------------------------------------------


def brute_words(rows, least_length, least_count):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def brute_near(n):
    """Near words by edits of every word with every letter that is used."""
    alphabet = sorted({c for w in n for c in w})
    near = defaultdict(set)
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for c in alphabet for k in (0, 1) for i in range(len(w) + 1 - k)}
        near[w] = {x for x in edits if x in n and x != w}
    return near


def brute_variants(rows, least_length, least_count, times):
    n = brute_words(rows, least_length, least_count)
    near = brute_near(n)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_spelling_by_brute_force(spark):
    """A given table, with bounds that leave many words and long chains of forms."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 2, 2)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs, 3, 2, 2).collect()}
    assert got == want and sum(f is not None for f, *_ in want.values()) > 100
    assert any(want[f][0] is not None for f, *_ in want.values() if f is not None)


def test_spelling_over_many_shards(spark):
    """Shards of 40 words in bundles of a few: the same near words as by brute force."""
    rng = np.random.default_rng(8)
    n = {}
    while len(n) < 900:
        n["".join(rng.choice(list("abz\u00c0\u00e9\u00ff\u00d7"), int(rng.integers(1, 7))))] = int(rng.integers(1, 40))
    want = {}
    for w, some in brute_near(n).items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        want[w] = (n[w], len(some), n.get(best), best)
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: (r["n"], r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(table, shard_words=40, bundle_bytes=6_000).collect()}
    assert got == want


def test_spelling_odd_rows(spark):
    """Nulls, empty texts, repeated rows, letters outside the runs, words of many letters, clashing columns, an empty table."""
    long = "xy" * 4_000 + "x" * 8_000
    rows = [(1, None, 1), (2, "", 1), (None, "colours Colours " * 3, 1), (3, "colour " * 40, 1), (3, "colour " * 40, 1), (4, "na\u00efvely " * 5 + "Na\u00efvely", None), (5, f"{long} {long}y " * 6, 1), (6, "five5five five_ six \u0101bcdefgh", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("word", F.lit("w")).withColumn("root", F.lit(0))
    want = brute_variants([(r[0], r[1]) for r in rows if r[0] != 5], 6, 5, 5) | {long: (None, long, 6, 1, None), long + "y": (None, long + "y", 6, 1, None)}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(table).collect()}
    assert got == want and want["colours"] == ("colour", "colour", 6, 1, 80)
    assert spelling.variants(table.limit(0)).count() == 0


# --- main text ---------------------------------------------------------------------------------

PROSE = "<p>" + "A long paragraph of prose with many words in it, which goes on for a while and says things. " * 4 + "</p>"
PAGE = "<html><body><nav><a href=1>Home</a><a href=2>About</a></nav>{}<footer>Copyright</footer></body></html>"


@pytest.mark.parametrize("attrs", ['class="content-sidebar-wrap"', 'class="post with-comments"', 'id="page" class="no-banner"', 'class="has-sidebar"'])
def test_compound_names_hide_no_content(attrs):
    got = extract.main_text(PAGE.format(f"<div {attrs}><h2>Title</h2>{PROSE * 4}</div>"))
    assert got.startswith("Title\n\nA long") and len(got.split("\n\n")) == 5 and "Copyright" not in got


def test_names_within_an_article():
    """What is about something stays in an article; plain names of furniture go, in and outside of it."""
    kept = extract.main_text(PAGE.format(f'<main><h1>T</h1>{PROSE * 4}<div class="comment-on-ruling"><p>First said.</p></div><p class="notice-of-meeting">Second said.</p></main>'))
    assert "First said." in kept and "Second said." in kept
    gone = extract.main_text(PAGE.format(f'<div class="x">{PROSE * 4}</div><div class="comments-section">{PROSE * 9}</div><div class="cookie-notice">{PROSE}</div>'))
    assert len(gone.split("\n\n")) == 4
    assert extract.main_text(PAGE.format(f'<div class="cookie-notice">{PROSE}</div>')) == ""


# --- SQL ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert set(got.columns) == set(columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(columns).collect())
