"""Brute-force versions and laws of the trained and hashed operations."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import embed_dedup, langid, quality, sharding


def em(lik, chosen, steps):
    """Proportions and log-likelihood of one text, word by word, in plain Python."""
    share = {j: 1 / len(chosen) for j in chosen}
    for _ in range(steps):
        total = dict.fromkeys(chosen, 0.0)
        for row in lik:
            mass = sum(row[j] * share[j] for j in chosen)
            for j in chosen:
                total[j] += row[j] * share[j] / mass
        share = {j: total[j] / len(lik) for j in chosen}
    return share, sum(math.log(sum(row[j] * share[j] for j in chosen)) for row in lik)


def grow(lik, langs, steps, penalty):
    charge = penalty * math.log(len(lik) + 1)
    alone = [sum(math.log(row[j]) for row in lik) for j in range(langs)]
    chosen = [max(range(langs), key=lambda j: (alone[j], -j))]
    share, best = {chosen[0]: 1.0}, alone[chosen[0]] - charge
    while True:
        trials = []
        for j in set(range(langs)) - set(chosen):
            s, value = em(lik, [*chosen, j], steps)
            trials.append((value - (len(chosen) + 1) * charge, -j, s))
        if not trials or max(trials, key=lambda t: t[:2])[0] <= best:
            return share
        best, minus, share = max(trials, key=lambda t: t[:2])
        chosen.append(-minus)


def test_mixtures_like_plain_em():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 40, 10)
    owner = np.concatenate([rng.choice(3, n, p=[(1, 0, 0), (0.6, 0.4, 0), (0.3, 0.3, 0.4)][i % 3]) for i, n in enumerate(words)])
    loglik = rng.normal(-20, 1, (words.sum(), 3))
    loglik[np.arange(len(owner)), owner] += 4
    mixture = langid.Mixture(loglik, words, 6, 2.0)
    got = mixture.select()
    starts = np.cumsum(words) - words
    several = 0
    for i, (at, n) in enumerate(zip(starts, words, strict=True)):
        rows = np.exp(loglik[at : at + n] - loglik[at : at + n].max(axis=1, keepdims=True)).tolist()
        share, value = em(rows, [0, 1, 2], 6)
        s, v = mixture.fit(np.array([i]), np.ones((1, 3)))
        assert np.allclose(s[0], [share[j] for j in range(3)]) and v[0] == pytest.approx(value)
        want = grow(rows, 3, 6, 2.0)
        several += len(want) > 1
        assert np.allclose(got[i], [want.get(j, 0.0) for j in range(3)])
    assert several > 2


def test_steps_of_em_are_enough(spark):
    """Six steps leave the proportions where sixty would have them, near enough for the verdict."""
    en, de = "the and that with this from have ", "der und die mit nicht ist ein "
    model = langid.train(spark.createDataFrame([(en * 20, "en"), (de * 20, "de")], "text string, lang string"))
    docs = spark.createDataFrame([(i, en * i + de * (9 - i)) for i in range(10)], "doc_id long, text string")
    few, many = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model, steps=n).collect()} for n in (6, 60))
    assert all(few[i][0] == many[i][0] and abs(few[i][1] - many[i][1]) < 0.01 for i in few)


def test_gradient_of_the_risk():
    rng = np.random.default_rng(1)
    p, u, w = rng.normal(0.5, 1, (30, 4)), rng.normal(0, 1, (50, 4)), rng.normal(0, 0.3, 4)
    plain = lambda w, b: 0.4 * np.mean([math.log1p(math.exp(-(x @ w + b))) for x in p]) + 0.05 * (w @ w)
    bracket = lambda w, b: np.mean([math.log1p(math.exp(x @ w + b)) for x in u]) - 0.4 * np.mean([math.log1p(math.exp(x @ w + b)) for x in p])
    value, rest, grad = quality.nnpu(w, 0.2, p, u, 0.4, 0.1)
    assert value == pytest.approx(plain(w, 0.2)) and rest == pytest.approx(bracket(w, 0.2)) and rest > 0
    total = lambda v: plain(v[:-1], v[-1]) + bracket(v[:-1], v[-1])
    at = np.append(w, 0.2)
    numeric = [(total(at + h) - total(at - h)) / 2e-6 for h in np.eye(5) * 1e-6]
    assert np.allclose(grad, numeric, atol=1e-6)
    # below zero the bracket alone is followed, upward
    q, far = p + 10 * np.sign(w), np.append(w, 0.0)
    _, rest, grad = quality.nnpu(w, 0.0, q, u, 0.9, 0.0)
    shifted = lambda v: np.mean(np.logaddexp(0, u @ v[:-1] + v[-1])) - 0.9 * np.mean(np.logaddexp(0, q @ v[:-1] + v[-1]))
    assert rest < 0 and rest == pytest.approx(shifted(far))
    assert np.allclose(grad, [-(shifted(far + h) - shifted(far - h)) / 2e-6 for h in np.eye(5) * 1e-6], atol=1e-5)


def test_fit_lowers_the_risk_to_its_least():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(1, 1, (200, 3)), rng.normal(1, 1, (120, 3)), rng.normal(-1, 1, (180, 3))]).astype(np.float32)
    model = quality.fit_nnpu(x, 200, 0.4, steps=1500)
    p, u = x[:200].astype(float), x[200:].astype(float)  # standardised in place
    risk = lambda w, b: (lambda r: r[0] + max(0.0, r[1]))(quality.nnpu(w, b, p, u, 0.4, 1e-3))
    best = risk(model.weights.astype(float), model.bias)
    assert best < risk(np.zeros(3), 0.0) and all(best <= risk(model.weights + d, model.bias) + 1e-4 for d in np.concatenate([np.eye(3), -np.eye(3)]) * 0.2)


def test_prior_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(4)
    for prior in (0.2, 0.6, 0.9):
        n = int(3000 * prior)
        got = quality.estimate_prior(rng.normal(2, 1, 2000), np.concatenate([rng.normal(2, 1, n), rng.normal(-2, 1, 3000 - n)]))
        assert abs(got - prior) < 0.06


def draw(key, level, children):
    def ticket(c):
        digits = int(hashlib.md5(f"{key}/{level}{c}".encode()).hexdigest()[:13], 16)
        return -math.log((digits + 0.5) / 2**52) / children[c]

    return min(sorted(children), key=ticket)


def descend(key, shards):
    """The shard of a key, by hashlib, level after level."""
    region = draw(key, "region", {g: sum(s.weight for s in shards if s.region == g) for g in {s.region for s in shards}})
    inside = [s for s in shards if s.region == region]
    rack = draw(key, f"region{region}/rack", {r: sum(s.weight for s in inside if s.rack == r) for r in {s.rack for s in inside}})
    return draw(key, f"region{region}/rack{rack}/shard", {s.shard: s.weight for s in inside if s.rack == rack})


def test_shards_like_hashlib(spark):
    ids = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for r in sharding.assign(ids, sharding.tree(16)).collect():
        assert r["shard"] == descend(str(r.doc_id), sharding.tree(16)) and r.grown_shard == descend(str(r.doc_id), sharding.grow(sharding.tree(16)))


def test_changes_inside_a_rack_stay_there(spark):
    """Two shards of a rack trade weight: nothing moves but between them."""
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before = {r.doc_id: r["shard"] for r in sharding.assign(ids, sharding.tree(16)).collect()}
    traded = [sharding.Shard(s.region, s.rack, s.shard, {8: 0.5, 9: 1.5}.get(s.shard, 1.0)) for s in sharding.tree(16)]
    after = {r.doc_id: r["shard"] for r in sharding.assign(ids, traded).collect()}
    moved = {(before[i], after[i]) for i in before if before[i] != after[i]}
    assert moved and {s for pair in moved for s in pair} <= {8, 9, 10, 11} and all(a == 8 or b == 9 for a, b in moved)


def test_repeated_rows_have_slots_of_their_own(spark):
    same = spark.range(900).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.assign(same.unionByName(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("y").alias("text"))), sharding.tree(4)).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and len(got) == 1000


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_most_pairs_are_skipped(spread):
    """Of clusters and of random directions in 64 dimensions, few pairs that do not link are compared whole."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((50, 64))[rng.integers(0, 50, 2000)] + spread * rng.standard_normal((2000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(np.cov(unit.T))[1].T[::-1][: embed_dedup.LEADING]
    at = embed_dedup.coordinates(unit, axes)
    order = np.lexsort((at[:, 3], at[:, 2], at[:, 1], np.floor(at[:, 0] / 0.37)))
    join = embed_dedup.Join(unit[order], at[order], np.ones(2000, np.int64), 0.93)
    join.intervals((0, 2000), (0, 2000))
    near = np.triu(unit[order] @ unit[order].T >= 0.93, 1)
    assert (join.linked == near.sum(axis=0) + near.sum(axis=1)).all()
    assert near.sum() <= join.compared < near.sum() + 0.05 * 2000 * 1999 / 2
