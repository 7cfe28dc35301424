"""Exact ranked search by inner products over sparse ball trees.

The score of a document and an item is a sum over the item's terms of w * ((10^9 tf) div (1000 tf + 8 m)): an inner product of the
document's vector of these entries and the item's 0/1 vector.

1. Items come in blocks of bounded text. One scan counts, for each document, all its terms and those of the block. The numbers of
   documents and terms and the document frequencies are added up by Spark over all documents.
2. Documents are put into ball trees, some hundred in each: a node has the mean of its vectors as centre and the largest distance
   from it as radius, and is cut in two at the median of the direction between two far vectors; a leaf has up to ``LEAF`` documents with their
   entries as integers. A task grows its trees from the stored counts one after the other and searches each before the next one.
3. No document of a node scores more for an item q than q.centre + |q| radius (Cauchy-Schwarz). Vectors are scaled place by place before
   (an item by the reciprocal), which changes no product and makes the bound tight where places vary much. Documents are nearly orthogonal,
   so the one radius of a ball is hardly smaller than a document is long, and an item has a few of its places only; each node therefore has a
   radius for each place as well, and the bound is q.centre plus the smaller of |q| radius and the sum of the radii in the item's places. All
   roundings are covered by factors that are larger than the error they can make, always upwards.
4. A task goes best first through its trees, with one list of the ``TOP`` best for each item, and stops where the bound is below the
   least of them; the bounds only save work. It starts from scores that the best leaves of a few trees reach. Scores at leaves are sums of
   64-bit integers. The lists of all tasks are merged in two steps.

Defined results: null texts and texts without terms are in no count and match nothing; null doc_ids come after all others among equal
scores; repeated rows are documents of their own; each row of items is ranked by itself, whatever its id, also a null one; an item without terms
or without a matching document gives no rows; texts and items of any length are read whole; empty tables give an empty table. Only ``doc_id``, ``text``,
``item_id`` are read, so other columns can have any name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from heatloom.functions.tables import materialize
from heatloom.llm.text import NOT_ALNUM, chunks, lowered_table, strings, words

TOP, LEAF = 10, 32
#: Bytes of item text in a block; entries of the table that a tree is grown from, and its documents at most; trees, one a task, that give the first lower bounds; lists merged in one step.
BLOCK_BYTES, GROWN, TREE_ROWS, FIRST_TREES, FAN = 1 << 20, 1 << 21, 1024, 64, 64
#: Least bound of all errors: entries are rounded to 24 bits (6e-8), sums of a million places to less than 1e-9.
UP = 1 + 1e-6
_TABLE = lowered_table(NOT_ALNUM)

def item_terms(texts: list[str | None]) -> list[list[str]]:
    """The distinct terms of each text, in alphabetical order."""
    out: list[list[str]] = []
    for _, _, buf, off in chunks(pa.array(texts, pa.large_string())):
        data, borders, per_text = words(buf, off, _TABLE)
        all_words = strings(data, borders).to_pylist()
        out += [sorted(set(all_words[a:b])) for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist(), strict=True)]
    return out


# ---------------------------------------------------------------- counting


def _profiler(vocabulary: list[str]):
    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: all its terms, and how often it has which terms of the vocabulary."""
        known = pa.array(vocabulary, pa.large_string())
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, buf, off in chunks(batch.column("text")):
                data, borders, per_text = words(buf, off, _TABLE)
                seen = strings(data, borders).dictionary_encode()
                number = pc.fill_null(pc.index_in(seen.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = number[seen.indices.to_numpy()] if len(number) else np.zeros(0, np.int64)
                text = np.repeat(np.arange(b - a), np.diff(per_text))[term >= 0]
                pair, tf = np.unique(text * max(1, len(vocabulary)) + term[term >= 0], return_counts=True)
                text, term = pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))
                lists = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), pa.array(np.diff(per_text)), pa.ListArray.from_arrays(lists, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int64))),
                    ],
                    names=["doc_id", "n", "terms", "tf"],
                )

    return profile


@dataclass
class Collection:
    """Counts over all documents, and what follows for each term of the vocabulary."""

    documents: int
    terms: int
    weight: np.ndarray  # w of each term
    scale: np.ndarray  # of its place in the vectors

    @classmethod
    def of(cls, profiles: DataFrame, size: int) -> Collection:
        total = profiles.agg(F.count(F.when(F.col("n") > 0, 1)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
        found = profiles.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # one row a term of the block
        df = np.zeros(size, np.int64)
        df[found.column("term").to_numpy()] = found.column("df").to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * total.d + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        # a place varies by about weight * root of the share of documents; the root of that balances centre and radius best
        scale = np.sqrt((weight + 1) * np.sqrt((df + 1) / (total.d + 1)))
        return cls(total.d, total.t, weight, scale)

    def entries(self, n: np.ndarray, tf: np.ndarray, term: np.ndarray) -> np.ndarray:
        """What a term adds to the score of a document of ``n`` terms, in 64-bit integers."""
        m = 100 - 90 + (90 * n * self.documents) // max(1, self.terms)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    docs: np.ndarray  # places in the rows given, leaf after leaf
    nodes: np.ndarray  # first document, document after the last, left and right child (or -1)
    centres: np.ndarray
    radii: np.ndarray
    wides: np.ndarray  # how far a place goes above the centre


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Of each row from ``point``, a few rows at a time."""
    out = np.empty(len(rows))
    for a in range(0, len(rows), 64):
        d = rows[a : a + 64].astype(np.float64) - point
        out[a : a + 64] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def grow(rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over the scaled vectors ``rows``."""
    order = np.arange(len(rows))
    nodes, centres, radii, wides = [], [], [], []

    def make(a: int, b: int) -> int:
        me = len(nodes)
        mine = rows[order[a:b]]
        centre = mine.mean(0, dtype=np.float64).astype(np.float32)
        away = distances(mine, centre)
        nodes.append([a, b, -1, -1])
        centres.append(centre)
        radii.append(float(away.max()) * UP)
        wides.append(((mine.max(0).astype(np.float64) - centre) * UP).astype(np.float32))
        if b - a > leaf and away.max() > 0:
            far = mine[int(away.argmax())]
            other = mine[int(distances(mine, far).argmax())]
            order[a:b] = order[a:b][np.argsort(mine @ (other - far), kind="stable")]
            del mine
            nodes[me][2], nodes[me][3] = make(a, (a + b) // 2), make((a + b) // 2, b)
        return me

    make(0, len(rows))
    return Tree(order, np.array(nodes, np.int64), np.array(centres, np.float32), np.array(radii), np.maximum(np.array(wides), 0))


@dataclass
class Indexed:
    """A tree with its documents: ids, and entries by leaf after leaf."""

    tree: Tree
    doc_ids: list[int | None]
    columns: np.ndarray  # term of each column
    starts: np.ndarray
    terms: np.ndarray  # column of each entry
    entries: np.ndarray

    def bounds(self, places: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """What no document of a node exceeds, for an item with terms in these columns."""
        t = self.tree
        beyond = np.minimum(np.sqrt((scale * scale).sum()) * UP * t.radii, t.wides[:, places].astype(np.float64) @ scale)
        return (t.centres[:, places].astype(np.float64) @ scale + beyond) * UP + 1

    def leaf(self, node: int, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the documents of a node."""
        a, b = self.tree.nodes[node, :2]
        cut = slice(self.starts[a], self.starts[b])
        return np.add.reduceat(np.where(wanted[self.terms[cut]], self.entries[cut], 0), self.starts[a:b] - self.starts[a])


def indexed(doc_ids: list[int | None], starts: np.ndarray, terms: np.ndarray, entries: np.ndarray, scale: np.ndarray) -> Iterator[Indexed]:
    """Trees over runs of documents whose table has at most ``GROWN`` entries; each document has an entry."""
    n = len(starts) - 1
    columns, local = np.unique(terms, return_inverse=True)
    if n > LEAF and n * len(columns) > GROWN:
        half = n // 2
        for a, b in ((0, half), (half, n)):
            cut = slice(starts[a], starts[b])
            yield from indexed(doc_ids[a:b], starts[a : b + 1] - starts[a], terms[cut], entries[cut], scale)
        return
    rows = np.zeros((n, len(columns)), np.float32)
    rows[np.repeat(np.arange(n), np.diff(starts)), local] = entries / scale[terms]
    tree = grow(rows)
    del rows
    size = np.diff(starts)[tree.docs]
    begin = np.cumsum(size) - size
    take = np.repeat(starts[tree.docs] - begin, size) + np.arange(len(terms))
    yield Indexed(tree, [doc_ids[i] for i in tree.docs.tolist()], columns, np.append(begin, len(terms)), local[take], entries[take])


def trees(batches: Iterable[pa.RecordBatch], collection: Collection, batch_rows: int = TREE_ROWS) -> Iterator[Indexed]:
    """The index of a run of counted documents; every one with a term of the block is in one tree."""
    held: list[pa.RecordBatch] = []

    def grown() -> Iterator[Indexed]:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("terms").combine_chunks()
        size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        term, tf = lists.flatten().to_numpy(), table.column("tf").combine_chunks().flatten().to_numpy()
        entries = collection.entries(np.repeat(table.column("n").to_numpy(), size), tf, term)
        yield from indexed(table.column("doc_id").to_pylist(), np.append(0, np.cumsum(size)), term, entries, collection.scale)

    for batch in batches:
        for a in range(0, batch.num_rows, batch_rows):
            held.append(batch.slice(a, batch_rows))
            if sum(x.num_rows for x in held) >= batch_rows:
                yield from grown()
                held.clear()
    if sum(x.num_rows for x in held):
        yield from grown()


# ---------------------------------------------------------------- search


def _place(doc: int | None) -> tuple[bool, int]:
    return (doc is None, doc or 0)


class Best:
    """The ``top`` best documents of an item so far: the first is the worst of them."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor = top, floor
        self.heap: list[tuple] = []

    def least(self) -> int:
        """A document with a lower score can't be among the best."""
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.top else self.floor

    def offer(self, score: int, doc: int | None) -> None:
        last, number = _place(doc)
        entry = (score, not last, -number)
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def _searcher(items: list[np.ndarray], collection: Collection, floors: list[int], top: int, first_leaves: bool = False):
    """Searches all trees, or only the best leaf for each item in the first tree of the task."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top, x) for x in floors]
        for number, one in enumerate(trees(batches, collection)):
            if first_leaves and number:
                continue
            place = np.full(len(collection.weight), -1)
            place[one.columns] = np.arange(len(one.columns))
            wanted = np.zeros(len(one.columns), bool)
            for mine, terms in zip(best, items, strict=True):
                there = terms[place[terms] >= 0]
                if not len(there):
                    continue
                at = place[there]
                wanted[at] = True
                bound = one.bounds(at, collection.scale[there])
                queue = [(-bound[0], 0)]
                while queue:
                    below, node = heapq.heappop(queue)
                    if -below < mine.least():
                        break
                    first, _, left, right = one.tree.nodes[node].tolist()
                    if left >= 0:
                        for child in (left, right):
                            heapq.heappush(queue, (-bound[child], child))
                        continue
                    scores = one.leaf(node, wanted)
                    for i in np.flatnonzero((scores >= mine.least()) & (scores > 0)).tolist():
                        mine.offer(int(scores[i]), one.doc_ids[first + i])
                    if first_leaves:
                        break
                wanted[at] = False
        rows = [(i, score, -number if there else None) for i, b in enumerate(best) for score, there, number in b.heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "score", "doc_id"]
        )

    return search


def _best_of(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each item with their ``rank``, from the lists of all tasks."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("_part", F.spark_partition_id() % FAN)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).drop("_part")


HIT = "item int, score bigint, doc_id bigint"


def search_block(docs: DataFrame, items: list[list[str]], top: int = TOP) -> DataFrame:
    """``item`` (its number in ``items``), ``rank``, ``doc_id``, ``score`` of the best documents."""
    vocabulary = sorted({t for terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    ids = [np.array([number[t] for t in terms], np.int64) for terms in items]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = materialize(rows.mapInArrow(_profiler(vocabulary), "doc_id bigint, n bigint, terms array<int>, tf array<bigint>"))
    collection = Collection.of(profiles, len(vocabulary))
    counted = profiles.where(F.size("terms") > 0)
    floors = [0] * len(items)
    some = counted.where(F.spark_partition_id() < FIRST_TREES)  # whichever they are, the scores only save work
    first = _best_of(some.mapInArrow(_searcher(ids, collection, floors, top, first_leaves=True), HIT), top)
    for r in first.where(F.col("rank") == top).collect():  # at most one row an item of the block
        floors[r["item"]] = r["score"]
    found = materialize(counted.mapInArrow(_searcher(ids, collection, floors, top), HIT))
    return _best_of(found, top)


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of all items, in blocks of bounded text, one after the other."""
    ids: list = []
    texts: list[str | None] = []
    held = 0
    for r in items.select("item_id", "text").toLocalIterator():
        if held and held + len(r.text or "") + 64 > block_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text or "") + 64
    if ids:
        yield ids, texts


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` best documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    kind = items.schema["item_id"].dataType
    names = StructType().add("item", IntegerType()).add("item_id", kind)
    out = docs.sparkSession.createDataFrame([], StructType().add("item_id", kind)).selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    for ids, texts in blocks(items, block_bytes):
        best = search_block(docs, item_terms(texts), top)
        named = docs.sparkSession.createDataFrame(list(enumerate(ids)), names)  # the ids of one block
        out = out.unionAll(best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    return out
