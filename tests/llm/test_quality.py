"""Quality rules: counts against plain Python, thresholds against exact quantiles, edge cases."""

import re

from pyspark.sql import functions as F

from heatloom.llm import quality as Q
from tests.llm.cases import edge_docs, edge_rows, empty_docs, small


def plain(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, hit = {}, set()
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(j for i in at for j in range(i, i + 8))
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_counts(spark):
    got = sorted((tuple(r)[:7] for r in Q.quality_report(edge_docs(spark)).collect()), key=repr)
    assert got == sorted(((r[0], *plain(r[1])) for r in edge_rows()), key=repr)


def test_base_failures_are_never_kept(spark):
    for docs in (edge_docs(spark), small(spark)):
        assert not [r for r in Q.quality_report(docs).collect() if r.kept and r.base_failed]


def test_filter_keeps_columns(spark):
    docs = edge_docs(spark)
    out = Q.quality_filter(docs)
    assert out.columns == docs.columns
    kept = sorted(repr(r.doc_id) for r in Q.quality_report(docs).where("kept").collect())
    assert sorted(repr(r.doc_id) for r in out.collect()) == kept


def test_empty(spark):
    assert Q.quality_report(empty_docs(spark)).collect() == []
    assert Q.quality_filter(empty_docs(spark)).collect() == []


def test_thresholds_follow_the_group(spark):
    """A group whose words are all long keeps them; the same word length fails elsewhere; a tiny group uses its language."""
    normal = "plain words of some usual size make up most of what is written here and there by anyone who likes to do so now"
    long = " ".join(f"{w}extraordinarily" for w in normal.split())
    rows = [(i, f"{normal} {i}", "en", "a") for i in range(150)] + [(1000 + i, f"{long} {i}", "en", "b") for i in range(150)]
    rows += [(2000, long, "en", "a"), (2001, long, "en", "b"), (2002, normal, "en", "tiny"), (2003, long + " ###### %%%%%% &&&&&& $$$$$$ ||||||| " * 9, "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.kept, r.failed) for r in Q.quality_report(docs).where("doc_id >= 2000 or doc_id % 1000 = 5").collect()}
    assert got[5][0] and got[1005][0] and got[2001][0]
    assert got[2000] == (False, "word_length") and got[2002][0] and not got[2003][0]


def test_sketch_quantiles(spark):
    """Quartiles from merged sketches are within the ratio of the exact ones."""
    m = Q.measured(small(spark))
    t = Q.thresholds(Q.sketches(m)).where("level = 2").first()
    exact = m.where("n_words > 0").agg(F.percentile("word_length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first().q
    hi = max(exact[2] + Q.FENCE * (exact[2] - exact[0]), exact[1] * Q.SPREAD)
    assert abs(t.hi_word_length - hi) < 0.15 * hi
