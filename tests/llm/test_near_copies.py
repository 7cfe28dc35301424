"""Near copies against the similarity of all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from heatloom.llm import near_copies as N
from tests.llm.cases import FOLDER, edge_docs, edge_rows, empty_docs, lower, small


def plain_shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain_kept(rows):
    sets = [plain_shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b):
                label[top(i)] = top(j)
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(top(i), []).append(((d is None, d or 0), d, t))
    return Counter(min(v, key=lambda x: x[0])[1] for v in groups.values())


def edited(seed=3, texts=25, copies=12):
    """Texts with copies in which up to a tenth of the words is replaced: many pairs on either side of the limit."""
    rng = random.Random(seed)
    rows = []
    for k in range(texts):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 80, 200, 400]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_finds_edited_copies(spark):
    """Every pair of similarity 0.8 or more is linked, no other, by the stage itself."""
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = P.STAGES[1][1](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    want = plain_kept(rows)
    assert len(want) < len(rows) - 150
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_copies_linked_through_one_text(spark):
    """Copies that reach the limit with one text only, whichever is the smallest of its bucket."""
    base = [f"w{i}" for i in range(204)]
    rows = [(0, " ".join(base))]
    for k in range(12):
        words = list(base)
        for i in (4, 60, 115):
            for j in range(3):
                words[i + k * 4 + j] = f"x{k}"
        rows.append((k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert want == Counter([0])
    assert plain_kept(rows[1:]) != Counter([1])
    assert Counter(r.doc_id for r in N.one_of_each(docs).collect()) == want


@pytest.mark.parametrize("make", [small, edge_docs], ids=["small", "edges"])
def test_tables(spark, make):
    docs = make(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert make is small or len(rows) == len(edge_rows())
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_keys_meet_at_the_limit():
    """Of pairs of sets with similarity 0.8, nearly all share a key."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(2000):
        h = rng.integers(0, 1 << 63, 90, np.uint64)
        a, b = band_keys(h[:81]), band_keys(h[9:])
        assert len(np.intersect1d(h[:81], h[9:])) * 5 >= len(h) * 4
        missed += not (a & b)
    assert missed <= 1


def test_signatures_let_pairs_at_the_limit_pass():
    """Pairs of similarity 0.8 differ in at most the bits allowed, pairs well below in more."""
    rng = np.random.default_rng(2)
    for same, total, passes in ((400, 500, True), (80, 100, True), (300, 500, False)):
        for _ in range(100):
            h = rng.integers(0, 1 << 63, total, np.uint64)
            cut = (total - same) // 2
            a, b = (N.one_bits(np.sort(x), np.array([len(x)])) for x in (h[: total - cut], h[cut:]))
            assert (int(np.bitwise_count(a ^ b).sum()) <= N.MAY_DIFFER) == passes


def versions(n, seed=4, words=400, edits=18):
    """Versions of one text, most pairs of which are near 0.6, and a few closer ones."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        ws = list(base)
        for j in rng.sample(range(words), edits if i % 10 else 3):
            ws[j] = f"x{i}y{j}"
        rows.append((i, " ".join(ws)))
    return rows


def test_versions_below_the_limit(spark, monkeypatch):
    """Of 400 versions most pairs are below the limit: none is lost, and few are verified."""
    rows = versions(400)
    verified = []
    plain = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, sets: (verified.append(pairs.count()), plain(pairs, sets))[1])
    kept = N.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(r.doc_id for r in kept.collect()) == plain_kept(rows)
    assert sum(verified) < 15_000


def band_keys(h):
    return set(N.band_keys(np.sort(h), np.array([len(h)])).ravel().tolist())


def test_empty(spark):
    assert N.one_of_each(empty_docs(spark)).collect() == []


def test_fingerprint_trees_let_copies_meet(spark, monkeypatch):
    """Without any other key, near copies whose fingerprints the trees link are found by the stage; far ones with near fingerprints are not."""
    monkeypatch.setattr(N, "sketch", lambda text: N.F.struct(N.F.xxhash64(text).alias("node"), N.F.size(N.F.split(text, " ")).cast("long").alias("n"), N.F.array().cast("array<bigint>").alias("bands")))
    base = [f"w{i}" for i in range(400)]
    other = [f"v{i}" for i in range(400)]
    rows = [(0, " ".join(base)), (1, " ".join([*base, "end"])), (2, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain_kept(rows) == Counter([0, 2])
    assert Counter(r.doc_id for r in P.STAGES[1][1](spark, docs, FOLDER).collect()) == Counter([0, 2])
