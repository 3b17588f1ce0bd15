"""The registered queries against SQL or brute force, on the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from tidewell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same):
    same(name, queries.QUERIES[name], queries.SQL[name])


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").toPandas()


def held(ids, of, remainder):
    return [zlib.crc32(str(i).encode()) % of == remainder for i in ids]


def test_language(spark, data, docs):
    got = queries.QUERIES["op2_language_id"](spark, data).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(got) == len(docs) and (got.held_out == held(got.doc_id, 4, 2)).all() and got.score.between(0, 1).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.95


def test_quality(spark, data, docs):
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas()
    got = queries.QUERIES["op4_quality"](spark, data).toPandas()
    assert len(got) == len(docs) and (got.held_out == held(got.doc_id, 5, 0)).all() and (got.predicted == (got.score >= 0.3)).all()
    known = got.merge(labels, on="doc_id")
    rank = known.score.rank()
    good, bad = (known.quality == 1).sum(), (known.quality == 0).sum()
    assert (rank[known.quality == 1].sum() - good * (good + 1) / 2) / (good * bad) > 0.9


def test_mixing(spark, data, docs):
    got = queries.QUERIES["op6_mixing"](spark, data).toPandas()
    again = queries.QUERIES["op6_mixing"](spark, data).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    got = got.merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", t)) for n, t in zip(got["size"], got.text, strict=True))
    assert (got.taken <= 2 * got["size"]).all() and abs(got.taken.sum() - 1.5 * got["size"].sum()) < 0.01 * got["size"].sum()
    g = got.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (g["size"] == g.source_size).all() and (abs(g.taken - g.target) <= 0.01 * g.target + 2).all()
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(g.index))}
    left, free, want = 1.5 * g["size"].sum(), set(g.index), {}
    while over := [s for s in free if left * weight[s] / sum(weight[f] for f in free) > 2 * g["size"][s]]:
        for s in over:
            want[s] = 2 * g["size"][s]
            left -= want[s]
            free.discard(s)
    want |= {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
    assert all(want[s] == pytest.approx(g.target[s]) for s in g.index)


def test_sharding(spark, data, docs):
    got = queries.QUERIES["op7_sharding"](spark, data).toPandas().merge(docs, on="doc_id")
    assert all(s == len(t.encode()) + 1 and c == zlib.crc32(t.encode()) for s, c, t in zip(got["size"], got.text_crc32, got.text, strict=True))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and got["shard"].between(0, 15).all()
    moved = got[got["shard"] != got.grown_shard]
    assert (moved.grown_shard == 16).all() and 0 < len(moved) < len(got) / 4


def test_bpe_like_the_library(spark, data, docs):
    from tokenizers import Tokenizer

    from tidewell.llm.bpe import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path())
    library.no_padding()
    library.no_truncation()
    got = queries.QUERIES["op8_bpe"](spark, data).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        r = got.loc[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_simhash(spark, data, docs):
    got = queries.QUERIES["op10_simhash"](spark, data).toPandas().set_index("doc_id")

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = {i: fingerprint(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all(int(got.fingerprint[i], 16) == v for i, v in f.items())
    root = {i: i for i in f}
    for i in f:
        for j in f:
            if i < j and (f[i] ^ f[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                if a != b:
                    root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert all(got.component_id[i] == root[i] for i in f)


def test_pipeline_stages(spark, data, docs, tmp_path):
    import corpus_pipeline

    current = spark.read.parquet(f"{data}/documents.parquet")
    sizes = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, data).write.parquet(str(tmp_path / str(n)))
        before, current = current, spark.read.parquet(str(tmp_path / str(n)))
        sizes.append(current.count())
        if n < len(corpus_pipeline.STAGES) - 1:
            assert current.columns == before.columns
    assert sizes[0] > 0.9 * len(docs) and sizes[2] < sizes[1] <= sizes[0] and sizes[3] == sizes[4]
