"""The positional index against plain scanning."""

import hashlib
import re

import pytest

from heatloom.llm import decontamination as D
from tests.llm.cases import FOLDER, LONG, PROSE, edge_docs, edge_rows, empty_docs, lower, small


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_report(docs, items):
    windows = {}
    for i, text in items:
        ws = plain_words(text)
        for k in range(max(1, len(ws) - 9)) if ws else ():
            windows.setdefault(tuple(ws[k : k + 10]), set()).add("null" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        ws = plain_words(text)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(ws) - n + 1):
                if (of := windows.get(tuple(ws[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    found |= of
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


ITEMS = [
    (1, PROSE), (2, "one two"), (2, "a b c"), (None, "the lazy dog"), (None, "é"), (4, None), (5, ""), (6, "... --"),
    (10, " ".join(LONG.split()[100:130])), (11, "same same same"), (12, "not in there"), (30, " ".join(LONG.split()[115:140])),
]


def bench(spark, items):
    return spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, id string")


def test_edge_cases(spark):
    df = D.contamination_report(edge_docs(spark), bench(spark, ITEMS))
    assert got(df) == plain_report([r[:2] for r in edge_rows()], ITEMS)


@pytest.mark.parametrize("block", [1, 500])
def test_blocks_of_items(spark, block):
    """Test items that come in several blocks, over segments of a few documents."""
    index = D.build_index(edge_docs(spark), segment_bytes=200)
    rows = D.search(index, bench(spark, ITEMS), block_bytes=block).collect()
    mine = sorted(((r.id[0], r.n_words, r.n_hit, len(r["items"]), D.digest(r["items"]), r.n_hit > 0) for r in rows), key=repr)
    assert mine == plain_report([r[:2] for r in edge_rows()], ITEMS)


def test_small_table(spark):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    df = D.contamination_report(small(spark), items)
    want = plain_report([(r.doc_id, r.text) for r in small(spark).collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(df) == want and any(r[-1] for r in want)


def test_near(spark):
    """All four rarest terms within 20 words, in any order."""
    docs = spark.createDataFrame([(1, "delta x alpha y gamma z beta"), (2, "alpha " + "x " * 30 + "beta gamma delta"), (3, "alpha beta gamma")], "doc_id long, text string")
    rows = {r.id[0]: r.near for r in D.search(D.build_index(docs), bench(spark, [(9, "alpha beta gamma delta")])).collect()}
    assert rows == {1: ["9"], 2: [], 3: []}


@pytest.mark.parametrize("segments", [1, 3, 7])
def test_near_does_not_depend_on_segments(spark, segments):
    """The rarest terms, and the one that the others are measured from, are those of the whole index."""
    docs = [
        (1, "alpha beta gamma delta"), (2, "epsilon"), (3, "alpha beta gamma epsilon"), (4, "alpha alpha"), (5, "beta " + "x " * 15 + "gamma " + "x " * 15 + "epsilon delta"),
        (6, "gamma " + "y " * 15 + "epsilon " + "y " * 15 + "beta delta"), (7, "alpha delta delta epsilon beta gamma"),
    ]
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, segments), "doc_id long, text string")
    index = D.build_index(df)
    assert index.count() == segments
    rows = D.search(index, bench(spark, [(9, "alpha beta gamma delta epsilon")])).collect()
    ws = [plain_words(t) for _, t in docs]
    total = {w: sum(x.count(w) for x in ws) for w in ["alpha", "beta", "delta", "epsilon", "gamma"]}
    first, *others = sorted(total, key=lambda w: (total[w], w))[:4]
    want = {d for (d, _), x in zip(docs, ws, strict=True) if any(w == first and all(o in x[max(0, p - 20) : p + 21] for o in others) for p, w in enumerate(x))}
    assert {r.id[0] for r in rows if r.near} == want and 0 < len(want) < 6


def test_empty(spark):
    none = bench(spark, []).limit(0)
    assert got(D.contamination_report(empty_docs(spark), bench(spark, ITEMS))) == []
    assert got(D.contamination_report(edge_docs(spark), none)) == plain_report([r[:2] for r in edge_rows()], [])
