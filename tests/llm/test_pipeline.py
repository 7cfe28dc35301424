"""Every stage of the corpus pipeline against brute force on its own input; the queries against their SQL."""

import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline as P
from checks.verify import TABLES, table
from heatloom.functions.tables import materialize
from heatloom.llm import mixing, quality, token_store
from heatloom.llm.queries import ORACLES, QUERIES
from tests.llm.cases import FOLDER, edge_docs, edge_rows, empty_docs, small
from tests.llm.test_decontamination import plain_report
from tests.llm.test_near_copies import plain_kept

ROOT = Path(__file__).resolve().parents[2]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def some(rows):
    return Counter(rows)


@pytest.mark.parametrize("make", [small, edge_docs], ids=["small", "edges"])
def test_stages(spark, make):
    """What each stage keeps of what the stage before it kept."""
    docs = make(spark)
    columns = docs.columns
    report = quality.quality_report(docs).collect()
    kept = materialize(P.STAGES[0][1](spark, docs, FOLDER))
    assert kept.columns == columns and some(r.doc_id for r in kept.select("doc_id").collect()) == some(r.doc_id for r in report if r.kept)
    if make is edge_docs:
        kept = materialize(docs)  # most oddities fail the quality rules; the next stages get them as well
    one = materialize(P.STAGES[1][1](spark, kept, FOLDER))
    assert one.columns == columns and some(d for d, _ in pairs(one)) == plain_kept(pairs(kept))
    assert some(pairs(one)) <= some(pairs(kept))
    clean = materialize(P.STAGES[2][1](spark, one, FOLDER))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {t for d, t in pairs(one) if plain_report([(d, t)], items)[0][-1]}
    assert clean.columns == columns and some(pairs(clean)) == some(x for x in pairs(one) if x[1] not in bad)
    mixed = materialize(P.STAGES[3][1](spark, clean, FOLDER))
    assert mixed.columns == columns and some(pairs(mixed)) == some(pairs(clean))
    final = P.STAGES[4][1](spark, mixed, FOLDER).orderBy("start").collect()
    place = {(r.doc_id, r.source): r.slot for r in mixing.mixing_report(clean).collect()}
    source = {(r.doc_id, r.text): r.source for r in clean.collect()}
    in_files = mixed.selectExpr("doc_id", "text", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()
    assert [r.doc_id for r in final] == [r.doc_id for r in in_files]
    slots = [place[r.doc_id, source[r.doc_id, r.text]] for r in in_files]
    assert make is edge_docs or slots == sorted(slots)
    enc = token_store.encoder(__import__("public_tokenizers").path(P.TOKENIZER))
    sizes = [len(enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in in_files]
    assert [r.n_tokens for r in final] == sizes and [r.start for r in final] == [sum(sizes[:i]) for i in range(len(sizes))]


def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, f in P.STAGES:
        docs = materialize(f(spark, docs, FOLDER))
    assert some(tuple(r)[:4] for r in P.run(spark, FOLDER).collect()) == some(tuple(r)[:4] for r in docs.collect())


def test_empty(spark):
    docs = empty_docs(spark)
    for _, f in P.STAGES:
        docs = materialize(f(spark, docs, FOLDER))
        assert docs.collect() == []


def test_edge_rows_are_odd():
    assert any(r[0] is None for r in edge_rows()) and len({r[:2] for r in edge_rows()}) < len(edge_rows())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    """Registered, over whole tables, native where that is asked for, and equal to their SQL."""
    df = entry_points.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if re.match(r"op[68]_", name):
        assert not re.search(r"Python|Pandas|Arrow", plan)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES.split():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        rel = con.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == table(rel.columns, rel.fetchall())


def test_all_are_registered():
    names = list(entry_points.queries())
    assert {int(m[1]) for x in names if (m := re.match(r"op(\d+)_", x))} == set(range(1, 14)) and "pipeline" in names


def test_entry_without_the_subpackage(tmp_path):
    """The entry module imports, and the other queries are there, where ``llm`` and the pipeline are missing."""
    for p in ROOT.iterdir():
        if p.name in ("__spark_entry__.py", "checks"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "heatloom").mkdir()
    for p in (ROOT / "heatloom").iterdir():
        if p.name != "llm":
            (tmp_path / "heatloom" / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not [x for x in q if x.startswith('op')]; e.oracle_sql()"
    entry = (tmp_path / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
