"""The token store against whole-text encoding, and its Elias-Fano code against the plain sequence."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heatloom.functions.tables import new_path
from heatloom.llm import token_store as T
from heatloom.llm.text import buffers
from tests.llm.cases import TEXTS, edge_docs, edge_rows, empty_docs, small

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def expected(rows, whole):
    """(doc_id, start, n_tokens, crc) in ascending order of ids, nulls first; texts of one id in any order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*whole(text), T.END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano(steps):
    ends = np.cumsum(np.array(steps, np.int64))
    bits, low, high, samples = T.ef_encode(ends)
    assert (T.ef_decode(bits, low, high, len(ends)) == ends).all()
    assert [T.ef_select(bits, low, high, samples, i) for i in range(len(ends))] == ends.tolist()


def test_elias_fano_space():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    _, low, high, samples = T.ef_encode(ends)
    assert 8 * (len(low) + len(high) + len(samples)) < len(ends) * (3.5 + np.log2(ends[-1] / len(ends)))


ALPHABET = "aZé É's'tre'llñß×́  0123%&-<|>\n\t日œŒ🙂İſK"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), max_size=6))
def test_pieces_encode_like_whole_texts(whole, texts):
    enc = T.encoder(PATH)
    ids, n = enc.encode(*buffers(pa.array(texts, pa.string())))
    want = [whole(t) for t in texts]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_encoder_forgets(whole, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 50)
    enc = T.Encoder(PATH)
    for t in TEXTS:
        assert enc.encode(*buffers(pa.array([t], pa.string())))[0].tolist() == whole(t)


def test_edge_cases(spark, whole):
    path = new_path(spark)
    T.write_store(edge_docs(spark), path, PATH, block_ids=1000)
    got = T.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in edge_rows()), key=lambda x: (x is not None, x))
    texts = {}
    for r in edge_rows():
        texts.setdefault(r[0], []).append(r[1])
    want = {(i, e[2], e[3]) for i, ts in texts.items() for e in expected([(i, t) for t in ts], whole)}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    starts = np.cumsum([0, *[r.n_tokens for r in got]])
    assert [r.start for r in got] == starts[:-1].tolist()
    assert len({(r.shard, r.block) for r in got}) > 5


def test_select_reads_one_document(spark, whole):
    path = new_path(spark)
    T.write_store(small(spark), path, PATH, block_ids=20_000)
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    block = spark.read.schema(T.STORE).parquet(path).orderBy("shard", "block").first()
    ids = np.frombuffer(block.ids, "<u2")
    for i in (0, 1, block.n_docs - 1):
        a = T.ef_select(block.low_bits, block.low, block.high, block.samples, i - 1) if i else 0
        b = T.ef_select(block.low_bits, block.low, block.high, block.samples, i)
        assert ids[a:b].tolist() == [*whole(texts[block.doc_ids[i]]), T.END_ID]


def test_small_table(spark, whole):
    path = new_path(spark)
    T.write_store(small(spark), path, PATH)
    got = [tuple(r)[:4] for r in T.read_documents(spark, path).orderBy("doc_id").collect()]
    assert got == expected(sorted((r.doc_id, r.text) for r in small(spark).collect()), whole)


def test_empty(spark):
    path = new_path(spark)
    T.write_store(empty_docs(spark), path, PATH)
    assert T.read_documents(spark, path).collect() == []
