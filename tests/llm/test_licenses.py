"""License scans: phrases against plain search, notices with changes, edge cases."""

import re

import pytest

from heatloom.llm import licenses as L
from tests.llm.cases import edge_docs, edge_rows, empty_docs, lower, small

MIT, ISC = L.NOTICES[0][0], L.NOTICES[1][0]


def plain(text):
    """(n_words, n_base, first, last, base labels)."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = [(i, label) for phrase, label in L.PHRASES for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(ws), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def report(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in L.license_report(docs).collect()}


def check(rows, got):
    want = sorted(((r[0], *plain(r[1])) for r in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert r.labels.split(",") == sorted(set(r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels) and (not r.n_base or r.score == 1)


def test_edge_cases(spark):
    check(edge_rows(), L.license_report(edge_docs(spark)).collect())


def test_small_table(spark):
    got = L.license_report(small(spark)).collect()
    check([(r.doc_id, r.text) for r in small(spark).collect()], got)
    assert any(r.n_base for r in got) and any("cc-by-nc" in r.labels for r in got)


def test_phrases(spark):
    texts = ["mit license mit license", "the mit. license!", "mit the license", "apache\nLICENSE general public license", "general public", "mit license " * 3000, "license mit general public general public license"]
    check(list(enumerate(texts)), report(spark, texts).values())


def test_notices(spark):
    ws = MIT.split()
    changed = " ".join([*ws[:10], "and", "also", *ws[10:25], *ws[27:40], "thing", *ws[41:]])
    texts = [MIT, "before " + changed + " after", " ".join(ws[: len(ws) // 3]), " ".join(reversed(ws)), f"{MIT} {ISC}", f"x {MIT} y {MIT}", "licensed under CC BY-SA 4.0.", "licensed under CC BY-NC 4.0"]
    got = report(spark, texts)
    assert got[0].labels == "mit" and got[0].score == 1 and got[0].n_base == 0
    assert got[1].labels == "mit" and 0.7 <= got[1].score < 1
    assert got[2].labels == got[3].labels == "" and got[2].score == 0
    assert got[4].labels == "isc,mit" and got[4].n_spans == 2 and got[5].n_spans == 2
    assert got[6].labels == "cc-by-sa" and got[7].labels == "cc-by-nc"


def test_shuffled_templates(shuffled):
    """The same where the template table is too large to broadcast."""
    docs = small(shuffled)
    got = L.license_report(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)


def test_empty(spark):
    assert L.license_report(empty_docs(spark)).collect() == []


def test_vocabulary_has_a_bound(monkeypatch):
    monkeypatch.setattr(L, "WORD_BITS", 2)
    with pytest.raises(ValueError, match="template words"):
        L.vocabulary([("a b c d e", "x")])
