"""Spelling variants against plain counting and comparing."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from heatloom.llm import variants as V
from tests.llm.cases import edge_docs, edge_rows, empty_docs, lower, small


def plain_counts(rows):
    out = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def plain_near(words):
    """Words one edit apart by erasing and by masking one place."""
    masked, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i], w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_report(rows):
    n = plain_counts(rows)
    near = plain_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def planted(seed=5):
    """Misspelled words in many documents, chains of forms, ties, anagrams, accents, one long word."""
    rng = random.Random(seed)
    base = ["house", "mouse", "moose", "horse", "hoarse", "nhose", "quellé", "quelle", "großer", "grosser", "abababab", "babababa", "z" * 3000]
    texts = []
    for d in range(400):
        ws = []
        for _ in range(30):
            w = rng.choice(base[:2] if rng.random() < 0.4 else base)
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abß") + w[i + 1 :]])
            ws.append(w.title() if rng.random() < 0.2 else w)
        texts.append((d if d % 50 else None, rng.choice([" ", "-", " 1×", "\n"]).join(ws)))
    return [*texts, texts[3], texts[3], (7, None), (8, "")]


def test_planted(spark):
    rows = planted()
    want = plain_report(rows)
    assert any(x[2] != x[0] and x[2] != x[1] for x in want) and max(x[4] for x in want) > 10
    assert got(V.variant_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == want


@pytest.mark.parametrize("make", [small, edge_docs], ids=["small", "edges"])
def test_tables(spark, make):
    docs = make(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert make is small or len(rows) == len(edge_rows())
    assert got(V.variant_report(docs)) == plain_report(rows)


def test_large_tables_path(shuffled):
    """The same rows where no join side is small."""
    rows = planted(6)[:120]
    assert got(V.variant_report(shuffled.createDataFrame(rows, "doc_id long, text string"))) == plain_report(rows)


def test_signatures_meet():
    """Every pair one edit apart shares a signature of its kind, over few letters, where most vectors are alike."""
    rng = random.Random(1)
    for letters in ("ab", "abcdeé", "".join(chr(c) for c in range(97, 123))):
        for _ in range(400):
            w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 12)))
            i = rng.randrange(len(w))
            for other, odd in ((w[:i] + "ö" + w[i + 1 :], 0), (w[:i] + w[i + 1 :], 1), (w[:i] + rng.choice(letters) + w[i:], 1)):
                a, b = V.signature_keys(pa.array([w, other]))
                assert any(int(k) & 1 == odd for k in np.intersect1d(a, b)), (w, other)


def test_empty(spark):
    assert V.variant_report(empty_docs(spark)).collect() == []
    assert V.variant_report(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")).collect() == []
