"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bpe, chat, components, embed_dedup, langid, mixing, quality, sharding, simhash, topk, urls

LONG = "der lange text mit vielen worten und noch mehr " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "the cat and the dog sat there", "en", "a"), (1, "the cat and the dog sat there", "en", "a"), (2, None, "en", None), (3, "", "de", "a"), (4, " \t\n", None, "b"),
        (5, "!!! ??? 123", "de", "b"), (None, "der hund und die katze", "de", "c"), (None, None, None, None), (6, LONG, "de", "a"), (7, "one", "en", "b"),
    ]
    return spark.createDataFrame([(*r, f"x{i}", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, score string, fp int")


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))
    assert components.connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(5)
    v = {i: rng.integers(-64, 65, 8).tolist() for i in range(600)}
    v[20], v[21], v[22] = v[40], v[40], v[40]
    rows = [(i, x) for i, x in v.items()] + [(None, v[1])]
    got = topk.top_k(spark.createDataFrame(rows, "id long, v array<long>"), F.col("id") % 20 == 0, 5, shard_rows=64, block_queries=8).collect()
    want = {q: sorted(((-int(np.dot(v[q], v[i])), i) for i in v if i != q))[:5] for q in v if q % 20 == 0}
    for r in got:
        s, i = want[r.query_id][r["rank"] - 1]
        assert (r.score, r.vec_id) == (-s, i)
    assert len(got) == 30 * 5
    few = topk.top_k(spark.createDataFrame([(0, [1]), (1, [2])], "id long, v array<long>"), F.col("id") == 0).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(0, 1, 2)]
    twice = topk.top_k(spark.createDataFrame([(0, [1, 2]), (0, [3, 1]), (1, [5, 5]), (1, [9, 9])], "id long, v array<long>"), F.col("id") == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in twice) == [(0, 1, 1, 27), (0, 1, 1, 36), (0, 2, 1, 15), (0, 2, 1, 20), (0, 3, 0, 5), (0, 3, 0, 5)]
    huge = topk.top_k(spark.createDataFrame([(0, [2**40]), (1, [2**20]), (2, [3])], "id long, v array<long>"), F.col("id") == 0).collect()
    assert [(r.vec_id, r.score) for r in huge] == [(1, 2**60), (2, 3 * 2**40)]
    exact = topk.top_k(spark.createDataFrame([(0, [2**30 + 1, 1]), (1, [2**31 - 1, 5]), (2, [2**31 - 1, 4]), (3, [2**31 - 1, 5])], "id long, v array<long>"), F.col("id") == 0).collect()
    assert [(r.vec_id, r.score) for r in exact] == [(1, (2**30 + 1) * (2**31 - 1) + 5), (3, (2**30 + 1) * (2**31 - 1) + 5), (2, (2**30 + 1) * (2**31 - 1) + 4)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.quantised(empty), F.col("id") % 20 == 0).count() == 0
    bad = spark.createDataFrame([(0, None), (1, [float("nan")]), (2, [None]), (3, [float("inf")]), (4, [0.5])], "vec_id long, embedding array<double>")
    assert [(r.id, r.v) for r in topk.quantised(bad).collect()] == [(4, [32])]


def test_language(spark, odd):
    model = langid.train(odd.select("text", "lang"))
    got = langid.identify(odd, model).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 5)) and by[6].lang_pred == "de" and by[1].lang_pred == "en"
    none = langid.train(odd.where("false").select("text", "lang"))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.where("false"), model).count() == 0


def test_language_mixture(spark):
    en, de = "the and that with this from have", "der und die mit nicht ist ein"
    model = langid.train(spark.createDataFrame([(en * 20, "en"), (de * 20, "de")], "text string, lang string"))
    r = langid.identify(spark.createDataFrame([(1, (en + " ") * 6 + (de + " ") * 3)], "doc_id long, text string"), model).first()
    assert r.lang_pred == "en" and 0.55 < r.score < 0.8 and "de:" in r.mixture


def test_quality(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, "plain words in a row. " * 5 if i % 2 else "BAD!! $$$ ### " * 5) for i in range(40)], "doc_id long, text string")
    model = quality.learn(texts, labels)
    got = {r.doc_id: r.score for r in quality.score(texts, model).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2)
    assert quality.score(odd, model).count() == 10 and quality.score(odd.where("false"), model).count() == 0
    assert quality.learn(texts, labels.where("false")) is None and {r.score for r in quality.score(odd, None).collect()} == {0.5}


def brute_links(rows, least):
    out = {}
    for k, (i, label, v) in enumerate(rows):
        ok = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        out[k] = {j for j, (_, l2, w) in enumerate(rows) if ok and j != k and l2 == label and w is not None and all(x is not None and np.isfinite(x) for x in w) and any(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= least}
    return out


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(6)
        rows += [(len(rows) + j, int(rng.integers(0, 2)), (centre + 0.25 * rng.standard_normal(6)).tolist()) for j in range(40)]
    rows += [(1000 + j, 1, rows[0][2]) for j in range(5)] + [(2000, None, rows[0][2]), (2001, 0, None), (2002, 0, [0.0] * 6), (2003, 0, [float("nan")] * 6), (2004, 0, [None] * 6), (2005, 0, [])]
    got = {r.vec_id: r for r in embed_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    links = brute_links(rows, 0.93)
    seen, comp = set(), {}
    for k in links:
        if k not in seen:
            todo, group = [k], set()
            while todo:
                n = todo.pop()
                if n not in group:
                    group.add(n)
                    todo += links[n]
            seen |= group
            comp |= {n: min(rows[g][0] for g in group) for n in group}
    assert len(got) == len(rows)
    for k, (i, _, _) in enumerate(rows):
        assert got[i].n_links == len(links[k]) and got[i].component_id == comp[k] and got[i].kept == (i == comp[k])
    assert embed_dedup.embedding_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_chat_folds_edits_and_regenerations(spark):
    log = [
        ("c", 0, 0, "start", "user", ""), ("c", 1, 0, "delta", None, "Hel"), ("c", 2, 0, "delta", None, "lo <|x"), ("c", 3, 1, "start", "assistant", ""), ("c", 4, 1, "delta", None, "wrong"),
        ("c", 5, 1, "regenerate", None, None), ("c", 6, 1, "delta", None, "rig"), ("c", 7, 1, "delta", None, "ht"), ("c", 8, 0, "edit", None, "Hi \\s <turn user>"), ("c", 9, 2, "start", "user", ""),
        ("c", 10, 2, "delta", None, "gone"), ("c", 11, 2, "retract", None, None),
    ]
    folded = chat.fold(spark.createDataFrame(log, "conv_id string, seq long, message long, kind string, role string, text string"))
    assert [(r.role, r.text) for r in folded.orderBy("message").collect()] == [("user", "Hi \\s <turn user>"), ("assistant", "right")]
    back = chat.read_back(chat.render(folded)).first()
    assert [(s.role, s.text) for s in back.said] == [("user", "Hi \\s <turn user>"), ("assistant", "right")] and back.learnt == ["right"]


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "a"), (1, 0, "assistant", "\n</turn>\n<turn user>\n"), (1, 0, "assistant", "\n</turn>\n<turn user>\n"), (None, 1, "user", LONG), (2, 1, "assistant", ""), (2, 2, "as<sis>tant\\", "é\\l"), (3, 1, "a>\nb", "hello"), (3, 2, "assistant>\n", "x"), (3, 3, "\\g>\\", "\\g")]
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(s.role, s.text) for s in back[1].said] == [("user", "a"), ("", ""), ("assistant", "\n</turn>\n<turn user>\n"), ("assistant", "\n</turn>\n<turn user>\n")] and back[1].learnt == ["\n</turn>\n<turn user>\n"] * 2
    assert [tuple(t) for t in back[3].said] == [("a>\nb", "hello"), ("assistant>\n", "x"), ("\\g>\\", "\\g")] and back[3].learnt == []
    assert back[None].said[0].text == LONG and back[2].learnt == [] and back[2].said[1] == ("as<sis>tant\\", "é\\l")
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_mixing(spark, odd):
    got = mixing.mix(odd, block=4).collect()
    assert len(got) == 10 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(odd.where("false")).count() == 0 and mixing.mix(odd.where("doc_id = 3")).first().taken == 0


def test_schedule_is_even(spark):
    plan = spark.createDataFrame([("a", 0, 4000, 6000.0), ("b", 1, 4000, 3000.0)], "source string, number int, source_size long, target double")
    slots = mixing.schedule(plan, 1200, 10).orderBy("slot").toPandas()
    taken = slots.groupby("number").words.sum()
    assert taken[0] == 6000 and taken[1] == 3000
    share = (slots.number == 0).cumsum() / np.arange(1, len(slots) + 1)
    assert abs(share[50:] - 2 / 3).max() < 0.05
    assert (slots.groupby(["number", "block", "turn"]).size() == 1).all()


def small_and_huge(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("b", 40), ("c", 300), ("d", 1500), *((f"e{n}", n) for n in range(20, 220, 10))])]
    rows += [(100 + i, "w " * 300, "huge") for i in range(1000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_small_sources_reach_their_targets_beside_a_huge_one(spark):
    got = mixing.mix(small_and_huge(spark)).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = target.get(r.source_size, 0) + r.target * r["size"] / r.source_size
    assert all(abs(taken[s] - target[s]) <= 4 for s in taken) and {r.doc_id: r.taken for r in got if r.doc_id < 4} == {0: 2, 1: 80, 2: 600, 3: 3000}
    assert all((r.first_slot is None) == (r.taken == 0) for r in got)


def test_taken_words_like_brute_force(spark, odd):
    """A source's documents lie end to end in the order of their hashes; the mix takes its first goal words, round and round."""
    more = odd.select("doc_id", "source", "text").unionByName(small_and_huge(spark).where("doc_id < 150").select("doc_id", "source", "text"))
    got = mixing.mix(more, block=7).collect()
    rows = mixing.sizes(more).collect()
    target = {}
    for r in mixing.targets(mixing.sizes(more)).collect():
        target[r.source] = (int(r.target), r.source_size)
    want = []
    for source, (goal, size) in target.items():
        at = 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: r.h):
            inside = lambda to: max(0, min(to, at + r["size"]) - at)  # noqa: B023, E731
            want.append((r.doc_id or -1, r["size"], sum(inside(goal - turn * size) for turn in range(3))))
            at += r["size"]
    assert sorted((r.doc_id or -1, r["size"], r.taken) for r in got) == sorted(want)


def test_mixing_stage_holds_targets_in_schedule_order(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(1, 60)), "abc"[min(2, i % 7)]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal = {r.source: r.target for r in mixing.targets(mixing.sizes(docs)).collect()}
    kept = mixing.mixing_stage(spark, docs, "", block=64).collect()
    words = {s: sum(len(r.text) // 2 for r in kept if r.source == s) for s in goal}
    assert all(abs(words[s] - goal[s]) <= 60 for s in goal)
    share = np.cumsum([(len(r.text) // 2) * (r.source == "c") for r in kept]) / np.cumsum([len(r.text) // 2 for r in kept])
    assert abs(share[300:] - goal["c"] / sum(goal.values())).max() < 0.05


STAGES = {"language": langid.language_stage, "quality": quality.quality_stage, "dedup": simhash.dedup_stage, "mixing": mixing.mixing_stage, "bpe": bpe.bpe_stage}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_a_callers_columns(spark, odd, data, name):
    names = ["__copies", "__id", "__turn", "__k1", "k1", "k2", "slot", "h", "hash", "salt", "row", "component", "lang_pred", "predicted", "id", "all"]
    wide = odd.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in names})
    rows = STAGES[name](spark, wide, data).collect()
    assert all(r[c] == f"{c}:{r.doc_id if r.doc_id is not None else -1}" for r in rows for c in names)
    if name != "bpe":
        assert STAGES[name](spark, wide, data).columns == wide.columns
        assert {r.text for r in rows} <= {r.text for r in odd.collect()}
    else:
        assert len(rows) == 10
    empty = STAGES[name](spark, wide.where("false"), data)
    assert empty.count() == 0


def test_schedule_completes_sources_at_its_end(spark):
    plan = spark.createDataFrame([("a", 0, 1, 2.0), ("b", 1, 40, 80.0), ("c", 2, 300, 450.5), ("d", 3, 10**6, 1.5e6)], "source string, number int, source_size long, target double")
    for slots in (0, 100, 6100):
        got = mixing.schedule(plan, slots, 256).toPandas()
        held = np.minimum(got.words, np.array([1, 40, 300, 10**6])[got.number] - got.block * 256)
        assert held.groupby(got.number).sum().tolist() == [2, 80, 450, 1_500_000] and got.slot.is_unique
        assert (got.groupby(["number", "block", "turn"]).size() == 1).all()


def test_sharding_moves_rows_only_into_the_new_shard(spark, odd):
    got = sharding.assign(odd, sharding.tree(16)).collect()
    assert len(got) == 10 and all(r["shard"] == r.grown_shard or r.grown_shard == 16 for r in got)
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    first = {r.doc_id: r["shard"] for r in sharding.assign(ids, sharding.tree(16)).collect()}
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in sharding.tree(16)]
    second = {r.doc_id: r["shard"] for r in sharding.assign(ids, heavier).collect()}
    sizes = np.bincount(list(second.values()), minlength=16)
    assert abs(sizes[5] / 4000 - 3 / 18) < 0.03
    # subtrees whose weight stays only give rows away: rows of region 1 stay or leave for region 0
    assert all(second[i] == s or second[i] < 8 for i, s in first.items() if s >= 8)
    assert sharding.assign(odd.where("false"), sharding.tree(16)).count() == 0


def test_bpe(spark, odd):
    got = {r.doc_id: r for r in bpe.encode(odd, bpe.vocabulary_path()).collect() if r.doc_id is not None}
    assert len(got[2].ids) == 0 and got[2].decoded == "" and len(got[6].ids) > 4 * 100_000 and got[7].decoded == "one</w>"
    assert bpe.digests(odd, bpe.vocabulary_path()).where("doc_id is null").count() == 2
    assert bpe.digests(odd.where("false"), bpe.vocabulary_path()).count() == 0
    assert bpe.digests(odd, bpe.vocabulary_path()).where("doc_id = 3").first().ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_urls(spark):
    rows = [(1, "http://A.b.COM/x"), (2, None), (3, "no url"), (4, "https://example.com/en/1?q=/en/"), (5, "https://www.example.com/en/1"), (6, "http://x.net/fr/"), (7, "http://net/es/a#b"), (8, "http://com"), (9, "ftp://xcom/"), (10, "a://b://c.com/"), (10, "a://b://c.com/"), (11, "http://example.com?x=/en/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)), urls.RULES).collect()}
    assert {i: (got[i].rule, got[i].verdict) for i in got} == {
        1: ("com/", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: ("example.com/en/", "block"), 5: ("www.example.com/en/", "allow"), 6: ("net/fr/", "block"),
        7: ("net/es/", "block"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"),
    }
    assert (got[1].host, got[1].path) == ("a.b.com", "/x") and (got[3].host, got[3].path) == ("", "") and (got[10].host, got[10].path) == ("b:", "//c.com/")


def test_url_digests_that_collide_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: 7)
    rules = urls.Rules(urls.write_rules([("block", "a.com", "/"), ("allow", "b.com", "/")], str(tmp_path)))
    place = rules.find(["a.com/", "b.com/", "c.com/"])
    assert rules.text(place[0]) == "a.com/" and rules.text(place[1]) == "b.com/" and place[2] == -1


def test_simhash(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    zero = [r for r in got if r.doc_id in (2, 3, 4)]
    assert {r.fp for r in zero} == {0} and {r.component_id for r in zero} == {2}
    assert simhash.near_duplicates(odd.where("false")).count() == 0


@pytest.mark.parametrize("chunk", [8, 4096])
def test_hamming_links_connect_what_all_pairs_do(spark, chunk):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = {int(c) for c in centre}
    for c in centre:
        for _ in range(60):
            flip = 0
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                flip |= 1 << int(b)
            prints.add(int(c) ^ flip)
    prints |= {0, 1, 2**63, *(int(x) for x in rng.integers(0, 2**63, 200, dtype=np.uint64))}
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = simhash.hamming_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, chunk)
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got.get(p, p) == find(p) for p in signed)


def test_dedup_stage_keeps_one_of_each_group(spark, odd):
    kept = simhash.dedup_stage(spark, odd, "")
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 6, 7]


def test_many_rules(spark):
    """Hosts and paths of 100,000 rules, found like in a dictionary."""
    rules = [("block" if i % 3 else "allow", f"h{i}.org", "/" if i % 2 else f"/p{i % 7}/") for i in range(100_000)]
    known = {(h, p): v for v, h, p in rules}
    rows = [(i, f"http://{'www.' * (i % 2)}h{i * 97}.org/p{i * 97 % 7}/x") for i in range(2000)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    for r in got:
        i = r.page_id * 97
        fits = [p for p in (f"/p{i % 7}/", "/") if (f"h{i}.org", p) in known]
        assert r.rule == (f"h{i}.org{fits[0]}" if fits else None) and r.verdict == (known[f"h{i}.org", fits[0]] if fits else "allow")


def test_limits_are_refused(spark, odd):
    with pytest.raises(ValueError):
        langid.train(odd.select("text", "lang"), most_langs=1)
    with pytest.raises(ValueError):
        mixing.mix(odd, most_sources=2)
