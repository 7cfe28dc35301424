"""Repeated passages against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from heatloom.llm import suffixes as S
from tests.llm.cases import edge_docs, edge_rows, empty_docs, small


def plain(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256), by scanning all windows in document order."""
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).view(np.int64))))
    seen, out = set(), {}
    for doc_id, text in order:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[doc_id, text] = (doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[r[0], r[1]] for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_edge_cases(spark):
    rows = [r[:2] for r in edge_rows()]
    assert got(S.passage_report(edge_docs(spark))) == plain(rows)


def test_small_table(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    want = plain(rows)
    assert got(S.passage_report(small(spark))) == want and any(r[2] and r[2] < r[1] for r in want)


@pytest.mark.parametrize("seed", range(4))
def test_shared_passages(spark, seed):
    """Passages of 90 to 400 bytes in many places, near copies, periodic and constant texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(14, 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 30)
            parts.insert(rng.randint(0, len(parts)), p[cut:] if rng.random() < 0.5 else p)
        rows.append((i * 2, " ".join(parts)))
    base = text(120)
    rows += [(1000 + i, base[: k] + "#" + base[k:]) for i, k in enumerate((0, 50, 99, 100, 101, 300, 301))]
    rows += [(2000, "x" * 700), (2001, "ab" * 300), (2002, "x" * 101), (2003, "abc" * 200 + "x" * 120), (2004, base + base), (2005, "x" * 99), (500, base)]
    rng.shuffle(rows)
    assert got(S.passage_report(docs_of(spark, rows))) == plain(rows)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 300)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    texts = [long, long[700:2900] + "!" + long[100:1300], long + long]
    emit = S._run_rows(100)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], names=["did", "text"])
    rows = [tuple(c) for b in emit([batch]) for c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
    covered = sorted((d, (abs(w) >> 7) + k) for _, _, d, w in rows for k in range(abs(w) & 127))
    assert covered == sorted((d, p) for d, t in zip((1, 2, 3), texts, strict=True) for p in range(len(t) - 99))


def test_spans_and_other_lengths(spark):
    rows = [(1, "abcdefghij" * 3), (2, "0" * 40 + "abcdefghij" * 2 + "1" * 40)]
    found = {r.doc_id: r.removed for r in S.repeated_passages(docs_of(spark, rows), 64).collect()}
    assert found == {1: [], 2: []}


def test_empty(spark):
    assert got(S.passage_report(empty_docs(spark))) == []
