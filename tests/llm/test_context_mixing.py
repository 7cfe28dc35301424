"""Language-model scores: base scores by hand, the model against a plain one, held-out texts."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from heatloom.llm import context_mixing as C
from tests.llm.cases import edge_docs, edge_rows, empty_docs, lower, small


def plain_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in rows]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = collections.Counter(w for ws, h in zip(tokens, out, strict=True) if not h for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    res = []
    for (i, _), ws, h in zip(rows, tokens, out, strict=True):
        all_ = [*ws, None]
        res.append((i, h, len(all_), sum(counts[w] > 0 for w in all_), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in all_)))
    return res


def compare(got, want):
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def scored(spark):
    return C.scores(small(spark)).collect()


def test_edge_cases(spark):
    got = C.scores(edge_docs(spark)).collect()
    compare(got, plain_base([r[:2] for r in edge_rows()]))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    again = {(r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got}
    assert {(r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in C.scores(edge_docs(spark, False)).collect()} == again


def test_small_table(spark, scored):
    compare(scored, plain_base([(r.doc_id, r.text) for r in small(spark).collect()]))


def test_rare_words_score_like_hot_ones(spark, scored, monkeypatch):
    monkeypatch.setattr(C, "HOT_WORDS", 20)
    got = {r.doc_id: (round(r.score, 6), round(r.base_score, 6), r.n_known) for r in C.scores(small(spark)).collect()}
    assert got == {r.doc_id: (round(r.score, 6), round(r.base_score, 6), r.n_known) for r in scored}


def test_learning_helps(spark):
    """Held-out texts after training on a thousand documents: 2.6 bits a byte at most, and no worse than the base score by a hundredth."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in C.scores(docs).collect() if r.held_out]
    bits = -sum(r.score for r in rows) / math.log10(2)
    assert bits < 2.6 * sum(bits_of(r) for r in rows)
    assert sum(r.score for r in rows) > 1.01 * sum(r.base_score for r in rows)


def bits_of(row):
    """Bytes of a text, from its bits per byte."""
    return -row.score / math.log10(2) / row.bits_per_byte


def test_no_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = C.scores(spark.createDataFrame([(held, "a few words", "en")], "doc_id long, text string, lang string")).first()
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (True, 4, 0, 0, 0.0)
    assert abs(got.score - math.log10(0.5)) > 10 and math.isfinite(got.score)


def test_empty(spark):
    assert C.scores(empty_docs(spark)).collect() == []


def plain_slots(word, cls):
    """Contexts and bits of a word, byte by byte."""
    data = word.encode() + b" "
    rows = []
    for at, byte in enumerate(data):
        back = [data[at - k] if at >= k else 32 for k in (1, 2, 3)]
        for k in range(8):
            rows.append((tuple(back[:1]), tuple(back[:2]), tuple(back), data[:at], (data[:at], cls), (1 << k) | byte >> (8 - k) if k else 1, byte >> (7 - k) & 1))
    return rows


def test_slots_stand_for_contexts():
    """Equal contexts have equal slots and different ones nearly always different slots."""
    ws = ["the", "then", "there", "other", "é", "x" * 300, "thé", "a"]
    cls = np.array([0, 1, 0, 1, 2, 0, 0, 3])
    s = C.spell(pa.array(ws, pa.large_string()), cls)
    want = [plain_slots(w, c) for w, c in zip(ws, cls, strict=True)]
    seen: dict = {}
    back: dict = {}
    for k in range(8):
        node, bit, slots = C.bit_slots(s, k)
        flat = [row for rows in want for row in rows[k::8]]
        assert node.tolist() == [r[5] for r in flat] and bit.tolist() == [r[6] for r in flat]
        for i in range(len(C.CONTEXTS)):
            for r, slot in zip(flat, slots[i].tolist(), strict=True):
                assert seen.setdefault((i, r[i], r[5]), slot) == slot
                back.setdefault(slot, set()).add((i, r[i], r[5]))
    assert sum(len(v) > 1 for v in back.values()) < 0.02 * len(back)
    assert all(C._FIRST[i] <= x < C._FIRST[i + 1] for (i, *_), x in seen.items())


def test_model_is_a_probability():
    """Over all bytes that may follow, probabilities add up to one."""
    counts = np.random.default_rng(1).integers(0, 9, (C.SLOTS, 2)).astype(np.float32)
    words = ["abc", "abd", "b"] * 20
    m = C.fit(counts, pa.array(words, pa.string()), np.zeros(60, np.int64), np.ones(60))
    s = C.spell(pa.array(["a" + chr(c) for c in range(128)], pa.large_string()), np.zeros(128, np.int64))
    second = np.flatnonzero(np.concatenate([[False], s.word[1:] == s.word[:-1]]) & (np.arange(len(s.data)) % 3 == 1))
    cost = sum(m.cost(*C.bit_slots(s, k)) for k in range(8))[second]
    high = 1 - (2.0**-cost).sum()  # bytes from 128 on
    node, _, slots = C.bit_slots(s, 0)
    odds = m.bits(node, slots)[2]
    assert abs(high - C.one_probability(odds, node, m.refined)[second[0]]) < 1e-6


def test_weights_and_map_are_learned_from_all_training_words(spark):
    """Slopes and counts add up to those of every word of the training texts, a plain sum in one process; parts do not matter."""
    rows = [(i, f"w{i} every text has a word{i % 700} of its own", "en") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    caught = []
    plain = C.learned

    def learned(counts, summed):
        model = plain(counts, summed)
        words = collections.Counter(w for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split())
        n = np.array(list(words.values()), np.float64)
        caught.append((model, C.fit(counts, pa.array(list(words), pa.string()), np.zeros(len(n), np.int64), n), summed, n.sum()))
        less = C.without_one(counts)
        cells = summed(C.seen, 2 * 256 * (C.ODDS + 1), less, model.weights.astype(np.float64)).reshape(2, -1)
        assert cells[0].sum() == 8 * sum((len(w) + 1) * k for w, k in words.items())
        return model

    with pytest.MonkeyPatch.context() as m:
        m.setattr(C, "learned", learned)
        assert C.scores(docs).count() == len(rows)
    model, want, _, _ = caught[0]
    assert np.allclose(model.weights, want.weights, atol=1e-5) and np.allclose(model.refined, want.refined, atol=1e-5)
    assert not np.allclose(model.weights, np.tile(np.array(C.START), (64, 1)), atol=1e-2)


def in_order():
    """Texts over few words, three that are the same, and one with the words of these in another order; the last two are held out."""
    out = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 7 == 2]
    line = "one word after another in an order that is kept by all of them"
    rows = [(i, " ".join(f"w{(j * (i % 5 + 1) + i % 3) % 40}" for j in range(i % 31)), "en") for i in range(140)]
    return [*rows, *[(i, line, "fr") for i in (1000, 1001, 1002, out[0])], (out[1], " ".join(sorted(line.split())), "fr")], out


def test_words_before_count(spark, monkeypatch):
    """Counts of contexts, weights and scores are those of a plain version; the order of the words matters."""
    rows, out = in_order()
    caught = []
    learn = C.context_weights

    def weights(tokens, n_train):
        caught.append((tokens.collect(), learn(tokens, n_train)))
        return caught[0][1]

    monkeypatch.setattr(C, "context_weights", weights)
    monkeypatch.setattr(C, "GROUP", 100)
    monkeypatch.setattr(C, "HOT_WORDS", 10)
    got = {r.doc_id: r for r in C.scores(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: ["<", "<", *t.split(), ">"] for i, t, _ in rows}
    seen = collections.Counter(tuple(t[k - d : k + e]) for i, t in tokens.items() if not held(i) for k in range(2, len(t)) for d, e in ((1, 0), (1, 1), (2, 1)))
    found = {r.doc_id: r for r in caught[0][0]}
    assert found.keys() == tokens.keys()
    facts = {}
    for i, t in tokens.items():
        want = [[seen[tuple(t[k - 1 : k + 1])], seen[t[k - 1],], seen[tuple(t[k - 2 : k + 1])], seen[tuple(t[k - 2 : k])]] for k in range(2, len(t))]
        want[0][3] = sum(not held(x) for x in tokens)
        assert [list(x) for x in zip(found[i].c1, found[i].n1, found[i].c2, strict=True)] == [x[:3] for x in want]
        facts[i] = [(*x, s) for x, s in zip(want, found[i].spelled, strict=True)]

    gate = lambda n: 1 + min(int(2 * math.log2(n)), C.GATES - 1) if n > 0 else 0

    def parts(a, c1, n1, c2, n2, s):
        a1, a2 = a[0][gate(n1)], a[1][gate(n2)]
        return (1 - a2) * (1 - a1) * 10**s, (1 - a2) * a1 * c1 / max(n1, 1), a2 * c2 / max(n2, 1)

    a = [[0, *[C.SHARE] * C.GATES] for _ in range(2)]
    for _ in range(C.PASSES):
        sums = np.zeros((2, 2, C.GATES + 1))
        for i in tokens:
            for c1, n1, c2, n2, s in facts[i] if not held(i) else []:
                p = parts(a, c1 - 1, n1 - 1, c2 - 1, n2 - 1, s)
                sums[0, :, gate(n1 - 1)] += p[1] / sum(p), 1 - p[2] / sum(p)
                sums[1, :, gate(n2 - 1)] += p[2] / sum(p), 1
        a = [[0, *[min(0.999, (sums[k, 0, g] + C.HELD * C.SHARE) / (sums[k, 1, g] + C.HELD)) for g in range(1, C.GATES + 1)]] for k in range(2)]
    assert np.allclose(a, caught[0][1], atol=1e-6)
    for i in tokens:
        assert abs(sum(math.log10(sum(parts(a, *x))) for x in facts[i]) - got[i].score) < 1e-4
    same, other = got[out[0]], got[out[1]]
    assert same.base_score == pytest.approx(other.base_score) and same.score > other.score + 5


def test_packed_counts_and_keys():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 1000, 70_000):
        keys = np.unique(rnd.integers(0, 1 << 48, n, dtype=np.uint64) >> np.uint64(rnd.integers(0, 20)))
        assert (C._unpacked(C._packed(keys)) == keys).all()
        counts = rnd.integers(0, 300, n).astype(np.float64)
        counts[: n // 9] = 1e12
        assert (C._whole(C._short(counts)) == counts).all()
    keys = np.arange(70_000, dtype=np.uint64)  # more keys with the same upper bits than two bytes count
    assert (C._unpacked(C._packed(keys)) == keys).all()
