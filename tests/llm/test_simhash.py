"""SimHash groups against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from heatloom.llm import simhash as S
from tests.llm.cases import CLASHES, edge_docs, edge_rows, empty_docs, lower, small


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_labels(x):
    x = np.array(x, np.uint64)
    label = np.arange(len(x))
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def same_parts(a, b):
    pairs = set(zip(map(int, a), map(int, b), strict=True))
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def balls(rng, centres, each, flips):
    out = []
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(each):
            bits = rng.choice(64, rng.integers(0, flips + 1), replace=False)
            out.append(int(c) ^ sum(1 << int(b) for b in bits))
    return np.unique(np.array(out, np.uint64))


def check(spark, rows, got):
    fps = [plain_fingerprint(r[1]) for r in rows]
    label = plain_labels(fps)
    least = {}
    for r, k in zip(rows, label, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", least.get(k)) for r, f, k in zip(rows, fps, label, strict=True)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_edge_cases(spark):
    check(spark, edge_rows(), S.near_duplicates(edge_docs(spark)).collect())


def test_small_table(spark):
    check(spark, [(r.doc_id, r.text) for r in small(spark).collect()], S.near_duplicates(small(spark)).collect())


def test_one_of_each(spark):
    docs = edge_docs(spark)
    out = S.one_of_each(docs)
    assert out.columns == docs.columns and set(CLASHES) <= set(out.columns)
    got = out.collect()
    rows = edge_rows()
    label = plain_labels([plain_fingerprint(r[1]) for r in rows])
    first = {}
    for r, k in zip(rows, label, strict=True):
        key = (r[0] is None, r[0] or 0)
        first[k] = min(first.get(k, key), key)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(first.values())


def test_empty(spark):
    assert S.near_duplicates(empty_docs(spark)).collect() == []
    assert S.one_of_each(empty_docs(spark)).collect() == []


@pytest.mark.parametrize("shape", [(400, 1, 0), (30, 12, 3), (1, 1500, 3), (3, 700, 5)])
def test_shards_find_all_links(spark, shape):
    """Random, grouped and dense fingerprints, through many small shards."""
    x = balls(np.random.default_rng(sum(shape)), *shape)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    edges = S.links(spark, df, shard=40)
    assert edges.count() <= 40 * len(x)
    root = {r.u: r.root for r in S.stars(edges).collect()}
    got = [root.get(int(v), int(v)) for v in x.view(np.int64)]
    assert same_parts(got, plain_labels(x))


@pytest.mark.parametrize("pool", [1, 16, 10_000])
def test_shard_forest(pool):
    x = np.concatenate([balls(np.random.default_rng(5), 20, 20, 2), balls(np.random.default_rng(6), 1, 600, 2)])
    x = np.unique(x)
    assert same_parts(S.shard_forest(x, np.ones(len(x), bool), pool=pool), plain_labels(x))


def test_stars_on_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.u: r.root for r in S.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}
