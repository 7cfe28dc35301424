"""The quality model: measures and cuts against plain versions, accuracy on held-out labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heatloom.llm import quality_model as Q
from tests.llm.cases import TEXTS, edge_docs, edge_rows, empty_docs, lower


def plain_measures(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = [lower(w) for w in ws]
    n, chars = max(1, len(ws)), max(1, sum(map(len, ws)))
    in_words = "".join(ws)
    letters = [sum(c.isascii() and c.isalpha() or not c.isascii() for c in w) for w in ws]
    upper = [sum(c.isascii() and c.isupper() for c in w) for w in ws]
    share = lambda marks: sum(c in marks for c in in_words) / chars
    symbols = "#*$%&<>@^~_=+{}[]\\/"
    runs = Counter(tuple(low[i : i + 4]) for i in range(len(low) - 3))
    return [
        np.log2(1 + len(ws)), sum(map(len, ws)) / n, sum(upper) / chars, share("0123456789"), share(symbols), share("|"), share("!?"), share(".,;:"),
        (len(in_words.encode()) - sum(1 for b in in_words.encode() if not 128 <= b < 192)) / chars,
        sum(u == k > 1 for u, k in zip(upper, letters, strict=True)) / n, sum(w[-1] in symbols + "|" for w in ws) / n, sum(k == 0 for k in letters) / n,
        sum(len(w) <= 3 for w in ws) / n, sum(len(w) > 15 for w in ws) / n, sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, len(set(low)) / n,
        max(Counter(low).values(), default=0) / n, sum(k for k in runs.values() if k > 1) / max(1, len(ws) - 3), len(ws) / (text.count("\n") + 1),
    ]


def test_measures():
    got = Q.measures(pa.array(TEXTS))
    assert got.shape == (len(TEXTS), len(Q.FEATURES))
    np.testing.assert_allclose(got, [plain_measures(t) for t in TEXTS], rtol=1e-12)
    assert Q.measures(pa.array([], pa.string())).shape == (0, len(Q.FEATURES)) and (Q.measures(pa.array([None, ""]))[:, :-1] == 0).all()


def test_first_cut_explains_most():
    """The first cut of a tree, and the cut of a pair, against all cuts."""
    rng = np.random.default_rng(0)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.uniform(1, 3, 9)
        best = max(range(8), key=lambda k: Q.gain(g[: k + 1].sum(), h[: k + 1].sum()) + Q.gain(g[k + 1 :].sum(), h[k + 1 :].sum()))
        one = Q.steps(g, h, 1)
        assert len(np.unique(one)) == 2 and one[best] != one[best + 1]
        assert one[0] == pytest.approx(g[: best + 1].sum() / (h[: best + 1].sum() + Q.RIDGE))
        g, h = rng.normal(size=(5, 4)), rng.uniform(1, 3, (5, 4))
        better, cells = Q.quadrants(g, h)
        plain = max(
            sum(Q.gain(g[a, b].sum(), h[a, b].sum()) for a in (slice(i), slice(i, 5)) for b in (slice(j), slice(j, 4))) for i in range(1, 5) for j in range(1, 4)
        )
        assert better == pytest.approx(plain - Q.gain(g.sum(), h.sum())) and len(np.unique(cells)) == 4


def test_pairs_learn_what_single_measures_can_not():
    """Exclusive or of two measures: no single table tells it."""
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, len(Q.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    cuts = [np.linspace(0.05, 0.95, 19)] * x.shape[1]
    model = Q.fit(x[:3000], y[:3000], cuts)
    assert (3, 7) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_scores_add_tables():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(Q.FEATURES)))
    model = Q.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), [np.array([-1.0, 0.0, 1.0])] * x.shape[1])
    for row, odds in zip(x[:50], model.odds(x[:50]), strict=True):
        place = [int(sum(c <= v for c in cut)) for cut, v in zip(model.cuts, row, strict=True)]
        plain = model.intercept + sum(t[b] for t, b in zip(model.tables, place, strict=True))
        plain += sum(t[model.coarse[i][place[i]], model.coarse[j][place[j]]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert odds == pytest.approx(plain)


def area(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scores = Q.quality_scores(docs, labels).toPandas()
    assert len(scores) == docs.count() and scores.score.between(0, 1).all() and (scores.predicted == (scores.score >= 0.7)).all()
    assert (scores.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scores.doc_id]).all()
    known = scores.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert len(known) > 800
    assert area(known.score.to_numpy(), known.quality.to_numpy()) > 0.97
    assert (known.predicted == known.quality).mean() > 0.97
    assert known[known.quality == 1].predicted.mean() > 0.97
    # labels of held-out rows are not read
    turned = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.quality_scores(docs, turned).toPandas()
    assert (again.sort_values(["doc_id", "score"]).score.to_numpy() == scores.sort_values(["doc_id", "score"]).score.to_numpy()).all()


def test_bounded_sample(spark):
    """A sample of a third of the labels still covers all documents."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.select("doc_id", Q.measured("text").alias("x"))
    x, y = Q.labelled(rows, labels, 1000)
    assert 800 < len(y) < 1200 and x.shape == (len(y), len(Q.FEATURES))


def test_edge_cases(spark):
    labels = spark.createDataFrame(
        [(0, 0, "a"), (3, 0, "b"), (3, None, "c"), (45, 1, "d"), (48, 1, "e"), (48, 0, "e"), (48, 1, "e"), (None, 1, "f"), (777, 1, "g"), (63, 0, "h")], "doc_id long, quality int, text string"
    )
    docs = edge_docs(spark)
    got = Q.quality_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_rows())
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len({r.score for r in got if r.doc_id == 45}) == 1
    assert {r.score for r in Q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(empty_docs(spark), labels).collect() == []
