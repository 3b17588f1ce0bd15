"""Hard negatives, decontamination and periodic runs against brute force; odd rows; repairs of earlier operators."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontam, embed_dedup, negatives, quality, queries, runs, urls


def brute_negatives(rows, positives=5, negatives_=5, low=80, high=100):
    """rows: (row, id, label, vector, is_anchor)."""
    out = []
    for row, i, label, v, is_anchor in rows:
        if not is_anchor:
            continue
        score = {r[0]: int(np.dot(v, r[3])) for r in rows}
        best = lambda some: sorted(some, key=lambda r: (-score[r[0]], r[1]))  # noqa: E731, B023
        for p in best([r for r in rows if r[2] == label and r[0] != row])[:positives]:
            near = [r for r in rows if r[2] != label and low * score[p[0]] <= 100 * score[r[0]] <= high * score[p[0]]]
            out += [(i, p[1], k + 1, n[1], score[p[0]], score[n[0]]) for k, n in enumerate(best(near)[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, block_anchors", [(37, 5), (1000, 1000)])
def test_hard_negatives_of_ties_copies_and_small_parts(spark, shard_rows, block_anchors, monkeypatch):
    monkeypatch.setattr(negatives, "STEP", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(5, 6)) * 20
    rows = []
    for n in range(400):
        v = (centre[n % 5] + rng.normal(size=6) * 8).round().astype(int).tolist()
        rows.append((n, n, f"label {int(rng.integers(4))}", v))
    rows[11] = (11, 11, rows[10][2], rows[10][3])  # equal rows, and a row that repeats an anchor's id
    rows[21] = (21, 20, rows[20][2], rows[20][3])
    rows[30] = (30, 30, rows[30][2], [0] * 6)
    given = [(i, label, v) for _, i, label, v in rows] + [(None, "label 1", [1] * 6), (900, None, [1] * 6), (910, "label 1", None)]
    df = spark.createDataFrame(given, "id long, label string, v array<long>").withColumn("row", F.lit("x"))
    got = negatives.hard_negatives(df, F.col("id") % 10 == 0, shard_rows=shard_rows, block_anchors=block_anchors)
    want = brute_negatives([(*r, r[1] % 10 == 0) for r in rows])
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 200


def test_hard_negatives_of_few_rows(spark):
    schema = "id long, label int, v array<long>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema), F.col("id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1, 2])], schema)
    assert negatives.hard_negatives(alone, F.col("id") % 10 == 0).count() == 0
    few = spark.createDataFrame([(0, 1, [10, 0]), (1, 1, [10, 0]), (2, 2, [9, 5]), (3, 2, [7, 0]), (4, 3, [10]), (5, 1, [-5, 0])], schema)
    got = sorted(tuple(r) for r in negatives.hard_negatives(few, F.col("id") == 0).collect())
    assert got == [(0, 1, 1, 4, 100, 100), (0, 1, 2, 2, 100, 90)]


def test_a_walk_skips_what_cannot_help(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(8, 4))
    p = (base[rng.integers(8, size=4000)] + rng.normal(size=(4000, 4)) * 0.02) * 200
    unit, length = negatives.directions(p)
    members, lengths = negatives.directions(p[:20])
    near = members @ members[0] > 0.99
    lists = negatives.Lists(unit, length, members[0], float(np.arccos((members[near] @ members[0]).min())))
    met = lists.walk(np.flatnonzero(near), lengths, None, lambda m: lengths[m] * 150, lambda m, c: None)
    assert 0 < met < 0.6 * near.sum() * len(p)


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_hits(text, items, length):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(WORD, low(text))
    hit, found = set(), set()
    for item, t in items:
        own = re.findall(WORD, low(t))
        if item is None or not own:
            continue
        m = min(length, len(own))
        for s in {tuple(own[i : i + m]) for i in range(len(own) - m + 1)}:
            for i in range(len(words) - m + 1):
                if tuple(words[i : i + m]) == s:
                    hit |= set(range(i, i + m))
                    found.add(str(item))
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("a_part", [7, 10**6])
def test_contamination_like_brute_force(spark, a_part):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "B", "ñu", "c1", "d--d", "e"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 9))) for i in range(12)] + [(3, text(5)), (20, ""), (21, None), (None, "a a a"), (22, "ñu")]
    texts = [text(rng.randint(0, 60)) for _ in range(40)] + [None, "", "?!", items[0][1].upper()]
    texts += [texts[0], "e " * 5000]
    docs = spark.createDataFrame([(i % 41, t, "own", 5) for i, t in enumerate(texts)], "doc_id long, text string, row string, n_hit int")
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), 4, a_part).collect()
    assert len(got) == len(texts) and all(r.row == "own" for r in got)
    key = lambda d, n, hit, found: (d, n, len(hit), tuple(found))
    want = sorted(key(i % 41, *brute_hits(t, items, 4)) for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert any(r.n_hit for r in got) and any(not r.n_hit for r in got)
    for r in got:
        if a_part > 7:
            assert sum(s.end - s.start for s in r.spans) == r.n_hit


def test_contamination_without_items_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit, list(r["items"])) for r in decontam.contamination(docs, none).collect()) == [(0, 0, []), (2, 0, [])]
    assert decontam.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_shifts_skip(spark):
    one = decontam.Shifts(10)
    one.add([f"w{i}".encode() for i in range(10)], ["1"])
    assert one.shift[b"w8 w9"] == 0 and one.shift[b"w0 w1"] == 8 and one.most == 9


def brute_runs(w, times=4, shortest=6):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(shortest, times * q) and not any(w[i + r : j + q] == w[i : j + q - r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("times, shortest", [(4, 6), (3, 9), (2, 2)])
def test_runs_like_brute_force(times, shortest):
    rng = random.Random(times)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = []
            while len(w) < rng.randint(0, 50):
                w += [rng.choice("ab") for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
            texts.append(w)
        assert runs.text_runs(texts, times, shortest) == [brute_runs(w, times, shortest) for w in texts]


def test_runs_query_like_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, data).collect()}
    assert len(got) == len(docs)
    planted = 0
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            planted += 1
            g, n = h // 10, len(w)
            a, original = g % n, list(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = [original[k] if k < a else original[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w) if len(w) < 3000 else None
        r = got[i]
        if found is None:
            continue
        drop = {k for s, n, q in found for k in range(s + q, s + n)}
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert r.n_runs == len(found) and r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest()
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert (r.start, r.length, r.period, r.exponent_milli) == want
    assert planted > 5 and any(r.n_runs for r in got.values())


def test_collapse(spark):
    long = "x y z " * 20_000
    rows = [(1, "a b " * 5 + "c", "r"), (1, "a b " * 5 + "c", "r"), (2, None, None), (3, " \t", "r"), (4, "one", "r"), (None, "k\tk k\nk k k k", "r"), (5, long, "r")]
    got = runs.collapse(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    assert sorted((str(r.doc_id), r.text, [tuple(x) for x in r.runs]) for r in got) == sorted(
        [("1", "a b c", [(0, 10, 2)])] * 2 + [("2", "", []), ("3", "", []), ("4", "one", []), ("None", "k", [(0, 7, 1)]), ("5", "x y z", [(0, 60_000, 3)])]
    )
    assert runs.collapse(spark.createDataFrame([], "text string, n int")).count() == 0


def test_prior_needs_no_negatives(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    whole, positive = quality.learn(docs, labels), quality.learn(docs, labels.withColumn("quality", F.when(F.col("quality") == 1, 1)))
    assert whole.prior == positive.prior and (whole.weights == positive.weights).all() and whole.bias == positive.bias
    counted = labels.agg(F.avg("quality")).first()[0]
    assert 0.05 < whole.prior < 1 and abs(whole.prior - counted) < 0.15


def test_long_hosts(spark):
    long = ".".join(["a" * 9] * 100_000)
    rows = [(1, f"https://{long}.example.com/en/x"), (2, f"https://{long}"), (3, "https://" + "." * 500_000 + "net/fr/"), (4, "http://aexample.com/en/"), (5, "http://x.example.com/en/")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: (None, "allow"), 3: ("net/fr/", "block"), 4: ("com/", "allow"), 5: ("example.com/en/", "block")}


@pytest.mark.parametrize("kind, labels", [("string", ["x", "y", None]), ("long", [2**33 + 1, 5, None])])
def test_labels_of_any_type(spark, kind, labels):
    v = [1.0, 0.5, 0.25]
    rows = [(1, labels[0], v), (2, labels[0], v), (3, labels[1], v), (4, labels[2], v), (5, labels[1], [0.99, 0.5, 0.25])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embedding_duplicates(spark.createDataFrame(rows, f"vec_id long, label {kind}, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4), 5: (1, 3)}
