"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores, for each segment of whole documents (about ``SEGMENT_BYTES`` of text, built by one task without a
shuffle), the distinct terms and for each term the ascending list of its positions. A phrase is looked up in a segment by
taking the position list of its rarest term there, shifted by the term's offset in the phrase, and intersecting it with the
shifted lists of the next rarest terms until none is left or all terms agree; a segment that lacks a term is skipped. Proximity
takes an item's terms that are rarest in the whole index, counted in a pass before, and asks in each segment for positions of
the rarest one that have the others within ``slop`` words, so the segments do not change what is near.

The index is proportional to the text, lives in the shared folder and is read by segments, so no task holds more than one.
Test items are read by the driver in blocks of at most ``BLOCK_BYTES`` of text; each block is two passes over the index.

Words are runs of ASCII letters and digits and of all non-ASCII characters, after A-Z became lower case.

Defined results: a null or empty text has no words and is never contaminated; an item without words has no
window; items with a null id count under the name 'null'; items with the same id are one item; an empty benchmark
contaminates nothing; repeated documents are each reported; an empty table gives an empty table; texts and items of any length are read
whole. Other columns are not read, so they can have any name.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.tables import materialize
from heatloom.llm.places import PLACE, placed
from heatloom.llm.text import NOT_ALNUM, chunks, lowered_table, strings, words

WINDOW, SLOP, NEAR_TERMS = 10, 20, 4
SEGMENT_BYTES, BLOCK_BYTES = 8 << 20, 64 << 20
TABLE = lowered_table(NOT_ALNUM)

INDEX = (
    "segment bigint, docs array<array<bigint>>, doc_words binary, terms binary, term_ends binary, list_ends binary, positions binary"
)
_FIELDS = [
    ("segment", pa.int64()), ("docs", pa.list_(pa.list_(pa.int64()))), ("doc_words", pa.binary()), ("terms", pa.binary()),
    ("term_ends", pa.binary()), ("list_ends", pa.binary()), ("positions", pa.binary()),
]


# ---------------------------------------------------------------- index


def _segment(number: int, docs: list, data: list, lengths: list, per_doc: list) -> pa.RecordBatch:
    """Index of some documents from the bytes and lengths of their words."""
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    column = strings(np.concatenate(data) if data else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(length)]).astype(np.int64))
    column = column.dictionary_encode()
    codes, terms = column.indices.to_numpy(), column.dictionary.cast(pa.large_string())
    n = len(terms)
    at = np.argsort(codes.astype(np.int32), kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(codes, minlength=n)) if n else np.zeros(0, np.int64)
    borders = np.frombuffer(terms.buffers()[1], np.int64)[: n + 1] if n else np.zeros(1, np.int64)
    flat = terms.buffers()[2].slice(0, int(borders[-1])).to_pybytes() if n else b""
    row = [
        number, docs, np.cumsum([0, *per_doc]).astype("<i8").tobytes(), flat, borders[1:].astype("<i8").tobytes(),
        ends.astype("<i4").tobytes(), at.astype("<i4").tobytes(),
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _FIELDS, strict=True)], names=[f for f, _ in _FIELDS])


def _indexer(segment_bytes: int):
    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        docs: list = []
        data: list = []
        lengths: list = []
        per_doc: list = []
        held = 0
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for a, b, buf, off in chunks(batch.column("text")):
                if held and held + len(buf) > segment_bytes:
                    yield _segment(number, docs, data, lengths, per_doc)
                    number, docs, data, lengths, per_doc, held = number + 1, [], [], [], [], 0
                flat, borders, of_text = words(buf, off, TABLE)
                docs += ids[a:b]
                data.append(flat)
                lengths.append(np.diff(borders))
                per_doc += np.diff(of_text).tolist()
                held += len(buf)
        if docs:
            yield _segment(number, docs, data, lengths, per_doc)

    return index


def build_index(docs: DataFrame, ids: tuple[str, ...] = ("doc_id",), segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Positional index of all texts of ``docs``, which are named by the whole-number columns ``ids``, stored in the shared folder."""
    rows = docs.select(F.array(*[F.col(f"`{c}`").cast("long") for c in ids]).alias("id"), "text")
    return materialize(rows.mapInArrow(_indexer(segment_bytes), INDEX))


class Segment:
    """Lookups in one segment of the index."""

    def __init__(self, row: dict):
        self.docs = row["docs"]
        self.doc_words = np.frombuffer(row["doc_words"], "<i8")
        ends = np.frombuffer(row["term_ends"], "<i8")
        self.terms = strings(np.frombuffer(row["terms"], np.uint8), np.concatenate([[0], ends]).astype(np.int64))
        self.list_ends = np.concatenate([[0], np.frombuffer(row["list_ends"], "<i4")]).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], "<i4")

    def codes(self, vocabulary: pa.Array) -> np.ndarray:
        """Number of each word's list here, -1 for none."""
        if not len(self.terms):
            return np.full(len(vocabulary), -1)
        return pc.fill_null(pc.index_in(vocabulary, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def list(self, code: int) -> np.ndarray:
        return self.positions[self.list_ends[code] : self.list_ends[code + 1]]

    def size(self, codes: np.ndarray) -> np.ndarray:
        return self.list_ends[codes + 1] - self.list_ends[codes]

    def phrase(self, codes: np.ndarray) -> np.ndarray:
        """Positions where the phrase starts, inside one document."""
        at = None
        for offset in np.argsort(self.size(codes), kind="stable").tolist():
            listed = self.list(int(codes[offset]))
            if at is None:
                at = listed - offset
            else:
                place = np.searchsorted(listed, at + offset)
                place[place == len(listed)] = 0
                at = at[listed[place] == at + offset]
            if not len(at):
                return at
        here = np.searchsorted(self.doc_words, at, "right")
        return at[(at >= 0) & (at + len(codes) <= self.doc_words[here])] if len(at) else at

    def near(self, codes: np.ndarray, slop: int) -> np.ndarray:
        """Documents (their places) where the first term has all others within ``slop`` words."""
        at = self.list(int(codes[0])).astype(np.int64)
        doc = np.searchsorted(self.doc_words, at, "right") - 1
        for code in codes[1:].tolist():
            listed = self.list(code)
            low = np.maximum(at - slop, self.doc_words[doc])
            high = np.minimum(at + slop, self.doc_words[doc + 1] - 1)
            ok = np.searchsorted(listed, high, "right") > np.searchsorted(listed, low, "left")
            at, doc = at[ok], doc[ok]
        return np.unique(doc)


# ---------------------------------------------------------------- queries


def item_words(texts: list[str | None]) -> list[list[str]]:
    out: list[list[str]] = []
    for _, _, buf, off in chunks(pa.array(texts, pa.large_string())):
        flat, borders, of_text = words(buf, off, TABLE)
        each = strings(flat, borders).to_pylist()
        out += [each[a:b] for a, b in zip(of_text[:-1], of_text[1:], strict=True)]
    return out


def _counter(vocabulary: list[str]):
    """How often each word of the vocabulary occurs in each segment."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ = pa.array(vocabulary, pa.large_string())
        for batch in batches:
            for k in range(batch.num_rows):
                s = Segment(batch.slice(k, 1).to_pylist()[0])
                codes = s.codes(words_)
                there = np.flatnonzero(codes >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(s.size(codes[there]), pa.int64())], names=["word", "n"])

    return count


def _rarest(index: DataFrame, vocabulary: list[str], items: list[tuple[str, list[str]]], near_terms: int) -> list[np.ndarray]:
    """For each item its terms that are rarest in the whole index, rarest first; none where too few of its terms occur at all."""
    empty = [F.lit(b"").alias(c) for c in ("doc_words", "positions")]
    read = index.select(F.expr("cast(array() as array<array<bigint>>)").alias("docs"), "terms", "term_ends", "list_ends", *empty)
    total = read.mapInArrow(_counter(vocabulary), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(len(vocabulary), np.int64)
    count[total["word"].to_numpy(np.int64)] = total["n"].to_numpy(np.int64)
    number = {w: i for i, w in enumerate(vocabulary)}
    out = []
    for _, ws in items:
        ids = np.unique(np.array([number[w] for w in ws], np.int64))
        there = ids[count[ids] > 0]
        enough = len(there) >= min(near_terms, len(ids))
        out.append(there[np.argsort(count[there], kind="stable")][:near_terms] if enough else there[:0])
    return out


def _finder(items: list[tuple[str, list[str]]], vocabulary: list[str], rarest: list[np.ndarray], window: int, slop: int):
    """Looks all windows of the items up in each segment; one row per document that has any hit."""
    number = {w: i for i, w in enumerate(vocabulary)}
    windows: dict[tuple, set[int]] = defaultdict(set)  # equal windows of several items are looked up once
    for i, (_, ws) in enumerate(items):
        for s in range(max(1, len(ws) - window + 1)) if ws else ():
            windows[tuple(number[w] for w in ws[s : s + window])].add(i)
    phrases = [(np.array(k), sorted(v)) for k, v in windows.items()]
    names = [n for n, _ in items]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ = pa.array(vocabulary, pa.large_string())
        for batch in batches:
            for k in range(batch.num_rows):
                s = Segment(batch.slice(k, 1).to_pylist()[0])
                codes = s.codes(words_)
                spans: dict[int, list] = defaultdict(list)
                found: dict[int, set] = defaultdict(set)
                near: dict[int, set] = defaultdict(set)
                for ids, of in phrases:
                    mine = codes[ids]
                    if mine.min() < 0:
                        continue
                    at = s.phrase(mine)
                    for doc, p in zip((np.searchsorted(s.doc_words, at, "right") - 1).tolist(), at.tolist(), strict=True):
                        first = p - int(s.doc_words[doc])
                        spans[doc].append((first, first + len(ids)))
                        found[doc].update(names[i] for i in of)
                for i, ids in enumerate(rarest):
                    mine = codes[ids]
                    if not len(ids) or mine.min() < 0:
                        continue
                    for doc in s.near(mine, slop).tolist():
                        near[doc].add(names[i])
                docs = sorted({*spans, *near})
                segment = batch.column("segment")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment] * len(docs), pa.int64()), pa.array(docs, pa.int32()),
                        pa.array([[list(x) for x in _union(spans[d])] for d in docs], pa.list_(pa.list_(pa.int32()))),
                        pa.array([sorted(found[d]) for d in docs], pa.list_(pa.string())),
                        pa.array([sorted(near[d]) for d in docs], pa.list_(pa.string())),
                    ],
                    names=["segment", "place", "spans", "items", "near"],
                )

    return find


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _doc_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = len(r["docs"])
            sizes = np.diff(np.frombuffer(r["doc_words"], "<i8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["segment"]] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(r["docs"], pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                names=["segment", "place", "id", "n_words"],
            )


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, list[str]]]]:
    """All test items, in blocks of bounded text, one after the other through the driver."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text")
    ids: list[str] = []
    texts: list[str | None] = []
    held = 0
    for r in rows.toLocalIterator():
        if held and held + len(r.text or "") > block_bytes:
            yield list(zip(ids, item_words(texts), strict=True))
            ids, texts, held = [], [], 0
        ids.append(r.i)
        texts.append(r.text)
        held += len(r.text or "")
    if ids:
        yield list(zip(ids, item_words(texts), strict=True))


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, near_terms: int = NEAR_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per indexed document: ``id`` (array), ``n_words``, ``n_hit``, ``spans`` of hit words, ``items`` with a window that occurs, ``near`` items.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. ``near`` are the items whose ``near_terms``
    terms that are rarest in the whole index (of those that occur there; fewer for an item of fewer terms) lie within ``slop`` words of the
    rarest one; equally rare terms go by the alphabet.
    """
    hits = None
    for block in _blocks(benchmark, block_bytes):
        vocabulary = sorted({w for _, ws in block for w in ws})
        rarest = _rarest(index, vocabulary, block, near_terms)
        found = index.mapInArrow(
            _finder(block, vocabulary, rarest, window, slop), "segment bigint, place int, spans array<array<int>>, items array<string>, near array<string>"
        )
        hits = found if hits is None else hits.unionAll(found)
    docs = index.select("segment", "docs", "doc_words").mapInArrow(_doc_rows, "segment bigint, place int, id array<bigint>, n_words bigint")
    none = F.expr("cast(array() as array<string>)")
    no_span = F.expr("cast(array() as array<array<int>>)")
    if hits is None:
        return docs.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), no_span.alias("spans"), none.alias("items"), none.alias("near"))
    merged = "aggregate(array_sort(flatten(collect_list(spans))), named_struct('n', 0L, 'e', 0), (a, s) -> named_struct('n', a.n + greatest(0, s[1] - greatest(a.e, s[0])), 'e', greatest(a.e, s[1])), a -> a.n)"
    one = hits.groupBy("segment", "place").agg(
        F.expr(merged).alias("n_hit"),
        F.expr("array_sort(flatten(collect_list(spans)))").alias("spans"),
        F.expr("array_sort(array_distinct(flatten(collect_list(items))))").alias("items"),
        F.expr("array_sort(array_distinct(flatten(collect_list(near))))").alias("near"),
    )
    return docs.join(one, ["segment", "place"], "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", no_span).alias("spans"),
        F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"),
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items found and their digest, verdict, items near."""
    found = search(build_index(docs), benchmark)
    return found.select(
        F.col("id")[0].alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of a test item occurs; all columns of ``docs``."""
    rows = placed(docs)
    found = search(build_index(rows.select(*PLACE, F.col("row.text").alias("text")), tuple(PLACE)), benchmark)
    bad = materialize(found.where("n_hit > 0").select(*[F.col("id")[i].alias(c) for i, c in enumerate(PLACE)]))
    return rows.join(bad, PLACE, "left_anti").select("row.*")


def digest(items: Iterable[str]) -> str:
    """The digest of a set of item ids, as the report has it."""
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
