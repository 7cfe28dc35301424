"""Ranked search against plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from heatloom.llm import lexical_search as L
from tests.llm.cases import FOLDER, LONG, PROSE, edge_docs, edge_rows, empty_docs, lower, small


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def plain_ranked(docs, items, top=10):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    total, df = sum(n for _, _, n in counts), Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        terms = set(plain_terms(text))
        scores = []
        for d, c, n in counts:
            m = 100 - 90 + (90 * n * len(counts)) // total
            score = sum(math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [
    (1, PROSE), (2, "one two"), (2, "a b c same"), (None, "the lazy dog"), (None, "é"), (4, None), (5, ""), (6, "... --"), (7, "MIT license LICENSE"),
    (10, " ".join(LONG.split()[100:130])), (12, "not_there x9y8z7"), (30, LONG), (31, "日本語 🙂🙂 ok"),
]


def bench(spark, items):
    return spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, item string, rank int")


def many(n=3000, seed=2):
    """Documents about few subjects, so that balls are small, with copies and ties."""
    rng = random.Random(seed)
    subjects = [[f"s{k}w{i}" for i in range(60)] for k in range(12)]
    rows = []
    for i in range(n):
        k = rng.randrange(12)
        ws = [rng.choice(subjects[k]) if rng.random() < 0.7 else f"c{rng.randrange(40)}" for _ in range(rng.randint(1, 80))]
        rows.append((i, " ".join(ws)))
    items = [(j, " ".join(rng.sample(subjects[j % 12], 8)) + f" c{j}") for j in range(24)]
    return rows + rows[:50], items


def test_edge_cases(spark):
    docs = [r[:2] for r in edge_rows()]
    assert got(L.ranked(edge_docs(spark), bench(spark, ITEMS))) == plain_ranked(docs, ITEMS)


def test_blocks_of_items(spark):
    docs = [r[:2] for r in edge_rows()]
    assert got(L.ranked(edge_docs(spark), bench(spark, ITEMS[:9]), block_bytes=150)) == plain_ranked(docs, ITEMS[:9])


def test_small(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in small(spark).collect()]
    assert got(L.ranked(small(spark), bench(spark, items))) == plain_ranked(docs, items)


@pytest.mark.parametrize("grown", [1 << 23, 1 << 15], ids=["large-trees", "small-trees"])
def test_many(spark, monkeypatch, grown):
    monkeypatch.setattr(L, "GROWN", grown)
    rows, items = many()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(L.ranked(docs, bench(spark, items))) == plain_ranked(rows, items)


def planted(rows, items):
    """Profiles, counts and one tree over ``rows``, without Spark."""
    vocabulary = sorted({t for _, text in items for t in plain_terms(text)})
    number = {t: i for i, t in enumerate(vocabulary)}
    counts = [Counter(plain_terms(t)) for _, t in rows]
    df = Counter(t for c in counts for t in c)
    n = np.array([sum(c.values()) for c in counts])
    weight = np.array([math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[t] + 1))) for t in vocabulary], np.int64)
    share = np.array([(df[t] + 1) / (len(rows) + 1) for t in vocabulary])
    c = L.Collection(len(rows), int(n.sum()), weight, np.sqrt((weight + 1) * np.sqrt(share)))
    return vocabulary, number, counts, n, c


def test_bounds_hold_and_prune():
    """No document exceeds the bound of a node above it, and most leaves are never looked at."""
    rows, items = many(700)
    vocabulary, number, counts, n, c = planted(rows, items)
    lists = [sorted((number[t], k) for t, k in cnt.items() if t in number) for cnt in counts]
    keep = [i for i, x in enumerate(lists) if x]
    starts = np.append(0, np.cumsum([len(lists[i]) for i in keep]))
    terms, tf = np.array([t for i in keep for t, _ in lists[i]]), np.array([k for i in keep for _, k in lists[i]])
    entries = c.entries(np.repeat(n[keep], np.diff(starts)), tf, terms)
    (one,) = L.indexed(keep, starts, terms, entries, c.scale)
    tree = one.tree
    assert sorted(one.doc_ids) == keep
    place = np.full(len(vocabulary), -1)
    place[one.columns] = np.arange(len(one.columns))
    looked = whole = 0
    for _, text in items:
        ids = np.array(sorted({number[t] for t in plain_terms(text)}))
        at = place[ids[place[ids] >= 0]]
        wanted = np.zeros(len(one.columns), bool)
        wanted[at] = True
        bound = one.bounds(at, c.scale[ids[place[ids] >= 0]])
        scores = np.zeros(len(one.doc_ids), np.int64)
        for node, (a, b, left, _) in enumerate(tree.nodes.tolist()):
            if left < 0:
                scores[a:b] = one.leaf(node, wanted)
        least = np.sort(scores)[-10]
        for node, (a, b, left, _) in enumerate(tree.nodes.tolist()):
            assert scores[a:b].max() <= bound[node]
            if left < 0:
                whole += 1
                looked += bound[node] >= least
    assert looked < whole / 2


def test_empty(spark):
    assert L.ranked(empty_docs(spark), bench(spark, ITEMS)).collect() == []
    assert L.ranked(edge_docs(spark), bench(spark, ITEMS).limit(0)).collect() == []
    assert L.ranked(edge_docs(spark), bench(spark, [(1, None), (2, "--")])).collect() == []
