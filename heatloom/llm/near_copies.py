"""Near copies by exact Jaccard similarity of word shingles: two texts are linked if their sets of ``SHINGLE`` words reach ``SIMILARITY``.

1. Texts with the same set of shingles are one node. Each node has ``BANDS`` keys, every one made of the least values of its
   shingles under ``ROWS`` hash functions. Two nodes of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS: at 0.8 all
   but 3 in a million pairs do, above it more. One key more comes from the fingerprint trees of ``simhash``: nodes whose fingerprints
   are connected by links of at most ``DISTANCE`` bits share it. These keys only decide who meets; this is the only step that is not exact.
2. In each bucket of nodes with the same key all are compared with its leader, the one that meets most others in all its buckets: of
   edited copies of one text, the text itself or the least edited copy. That joins most of a group by one link a node. Then each bucket that still
   holds several components takes a leader by chance, so that a copy meets several members of a large component.
3. Of what is left, the nodes outside the largest component of a bucket are compared with all nodes of other components there, each pair in
   one of the buckets it shares. Two sets are only compared if their sizes allow the similarity and if ``BITS`` one-bit signatures do not
   rule it out: pairs of similarity 0.8 differ in a tenth of the half of them that is chance, and all but 3 in a million pass. Both happen inside the
   join, so other pairs are never rows. Pairs inside a component are never made.
4. A pair is verified on both whole sets.

What is left of the square: versions of one text that are all just below the limit to each other and to every leader pass the signatures and
are verified pair by pair.

Fingerprints of 64 bits can not do this alone: among pairs that reach 0.8 they differ in up to 11 bits, and trees prune nothing there.

Defined results: texts without words and null texts have the same, empty set; fewer words than a shingle are one shingle; a null
doc_id counts as larger than all; equal texts are one node; texts of any length are read whole; an empty table gives an empty table; other
columns can have any name. 64-bit hashes stand for shingles and for sets of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructType

from heatloom.functions.tables import materialize
from heatloom.llm import simhash
from heatloom.llm.places import PLACE, placed
from heatloom.llm.simhash import SEED, fingerprint, shingle_hashes, stars
from heatloom.llm.text import release

#: Words of a shingle, and the similarity as a fraction (0.8).
SHINGLE, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 24, 4
SKETCH = StructType().add("node", LongType()).add("n", LongType()).add("bands", ArrayType(LongType()))
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MUL = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)
#: One-bit signatures, and how many of them may differ: 4.5 deviations above the mean of pairs at the limit.
BITS = 1024
MAY_DIFFER = math.ceil(BITS * 0.1 + 4.5 * math.sqrt(BITS * 0.1 * 0.9))
_BIT_XOR = _RNG.integers(0, 1 << 32, BITS, np.uint32)
_BIT_MUL = _RNG.integers(0, 1 << 32, BITS, np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the distinct shingle hashes of each text in ascending order, and how many each has."""
    for hashes, per_text in shingle_hashes(column, SHINGLE):
        text = np.repeat(np.arange(len(per_text)), per_text)
        order = np.lexsort((hashes, text))
        h, t = hashes[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        yield h[new], np.bincount(t[new], minlength=len(per_text))


def band_keys(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The keys of each set that is not empty, one row a set."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    least = np.zeros((len(starts), BANDS * ROWS), np.uint64)
    if len(starts):
        x = (h >> np.uint64(32)).astype(np.uint32)
        for k in range(BANDS * ROWS):
            least[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], starts)
    keys = (least.reshape(-1, BANDS, ROWS) * _MIX).sum(2, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(29))


@arrow_udf(SKETCH)
def sketch(text: pa.Array) -> pa.Array:
    """Node (hash of the set of shingles), size of the set, and its keys."""
    nodes, counts, bands = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for h, sizes in shingle_sets(text):
        ends = np.cumsum(sizes)
        nodes += [xxhash.xxh64_intdigest(h[a:b].tobytes(), SEED) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        counts.append(sizes)
        bands.append(band_keys(h, sizes).ravel())
    n = np.concatenate(counts).astype(np.int64)
    borders = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(bands).view(np.int64)))
    release()
    return pa.StructArray.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(n), lists], ["node", "n", "bands"])


@arrow_udf(BinaryType())
def shingle_bytes(text: pa.Array) -> pa.Array:
    out: list[bytes] = []
    for h, sizes in shingle_sets(text):
        ends = np.cumsum(sizes)
        out += [h[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    release()
    return pa.array(out, pa.binary())


def one_bits(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``BITS`` signatures of one bit of each set that is not empty, 64 in a word."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    x = (h >> np.uint64(32)).astype(np.uint32)
    words = np.zeros((len(starts), BITS // 64), np.uint64)
    for k in range(BITS) if len(starts) else ():
        least = np.minimum.reduceat((x ^ _BIT_XOR[k]) * _BIT_MUL[k], starts) * np.uint32(0x9E3779B1)
        words[:, k // 64] |= (least >> np.uint32(31)).astype(np.uint64) << np.uint64(k % 64)
    return words


@arrow_udf(ArrayType(LongType()))
def signature(shingles: pa.Array) -> pa.Array:
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingles]
    words = np.zeros((len(sets), BITS // 64), np.uint64)
    for a in range(0, len(sets), 256):
        some = sets[a : a + 256]
        sizes = np.array([len(x) for x in some])
        words[a : a + 256][sizes > 0] = one_bits(np.concatenate(some), sizes)
    release()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)), pa.array(words.view(np.int64).ravel()))


@arrow_udf(BooleanType())
def similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two sets reach ``SIMILARITY``."""
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        both = len(np.intersect1d(p, q, assume_unique=True))
        out.append(both * SIMILARITY[1] >= (len(p) + len(q) - both) * SIMILARITY[0])
    release()
    return pa.array(out, pa.bool_())


def _fits(a: str, b: str):
    """Whether sets of these sizes can reach ``SIMILARITY``."""
    return F.least(a, b) * SIMILARITY[1] >= F.greatest(a, b) * SIMILARITY[0]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar, stored."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return materialize(both.select("u", "v", similar("a", "b").alias("same")).where("same").select("u", "v"))


def _rooted(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with their ``root`` and the largest component (``big``) of the bucket."""
    root = stars(edges).withColumnRenamed("u", "node")
    member = materialize(shared.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    parts = member.groupBy("key", "root").agg(F.count("*").alias("_n")).groupBy("key").agg(F.count("*").alias("_parts"), F.max_by("root", F.struct("_n", "root")).alias("big"))
    return materialize(member.join(parts.where("_parts > 1").select("key", "big"), "key"))


def _compared(members: DataFrame, leads: DataFrame, sets: DataFrame, tried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of members and the lead of their bucket, as compared and as found similar."""
    pairs = members.join(leads, "key").where(F.col("node") != F.col("lead.node")).where(_fits("n", "lead.n"))
    if "root" in members.columns:
        pairs = pairs.where(F.col("root") != F.col("lead.root"))
    pairs = pairs.select(F.greatest("node", "lead.node").alias("u"), F.least("node", "lead.node").alias("v")).distinct()
    pairs = materialize(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"))
    return pairs, _verified(pairs, sets)


def links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (u, v) between similar nodes that connect all that are linked; ``rows`` has the texts by place."""
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    met = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = materialize(keys.join(met, "key"))  # members of buckets of two nodes at least
    central = materialize(shared.groupBy("node").agg(F.sum("m").alias("met")))
    who = central.select("node").join(nodes.select("node", *[F.col(f"first.{c}").alias(c) for c in PLACE]), "node")
    sets = materialize(rows.select(*PLACE, F.col("row.text").alias("text")).join(who, PLACE).select("node", shingle_bytes("text").alias("shingles")))
    one = F.struct("node", "n").alias("lead")
    leads = shared.join(central, "node").groupBy("key").agg(F.max_by(one, F.struct("met", "node")).alias("lead"))
    tried, found = _compared(shared.select("key", "node", "n"), leads, sets)

    mixed = _rooted(shared.select("key", "node", "n"), found)
    inner = mixed.where("root = big")  # a member of the largest component, by chance
    leads = inner.groupBy("key").agg(F.max_by(F.struct("node", "n", "root"), F.xxhash64("node", "key")).alias("lead"))
    again, more = _compared(mixed.drop("big"), leads, sets, tried)
    tried, found = tried.unionAll(again), found.unionAll(more)

    mixed = _rooted(shared.select("key", "node", "n"), found)
    few = mixed.select("node").distinct()
    marks = materialize(sets.join(few, "node").select("node", signature("shingles").alias("bits")).join(nodes.select("node", "bands"), "node"))
    mixed = mixed.join(marks, "node")
    a = mixed.where("root <> big").select("key", "big", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "root", "bits", "bands")])
    b = mixed.select("key", *[F.col(c).alias(f"b_{c}") for c in ("node", "n", "root", "bits", "bands")])
    differ = " + ".join(f"bit_count(a_bits[{i}] ^ b_bits[{i}])" for i in range(BITS // 64))
    apart = "CASE WHEN b_root = big THEN true ELSE a_root < b_root END"
    once = "key = array_min(array_intersect(a_bands, b_bands))"
    pairs = a.join(b, "key").where(f"{apart} AND a_root <> b_root").where(_fits("a_n", "b_n")).where(f"{differ} <= {MAY_DIFFER}").where(once)
    pairs = pairs.select(F.greatest("a_node", "b_node").alias("u"), F.least("a_node", "b_node").alias("v")).distinct()
    return found.unionAll(_verified(pairs.join(tried, ["u", "v"], "left_anti"), sets))


def with_trees(nodes: DataFrame) -> DataFrame:
    """``nodes`` with one more key in ``bands``, that of the component of their fingerprint ``fp`` in the trees of ``simhash``."""
    distinct = materialize(nodes.where("n > 0").select("fp").distinct())
    root = stars(simhash.links(nodes.sparkSession, distinct)).withColumnRenamed("u", "fp")
    key = F.xxhash64(F.lit("trees"), F.coalesce("root", "fp"))
    bands = F.when(F.col("n") > 0, F.array_union("bands", F.array(key))).otherwise(F.col("bands"))
    return materialize(nodes.join(root, "fp", "left").withColumn("bands", bands).drop("fp", "root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies and, of each component, the row with the smallest doc_id; all columns of ``docs``."""
    rows = placed(docs)
    marked = materialize(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), sketch("row.text").alias("s"), fingerprint("row.text").alias("fp"), *PLACE).select("doc_id", "s.*", "fp", *PLACE))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *PLACE)
    nodes = with_trees(materialize(marked.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp"), F.min(key).alias("first"))))
    root = stars(links(rows, nodes)).withColumnRenamed("u", "node")
    least = nodes.select("node", "first").join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return rows.join(least.select(*[F.col(f"first.{c}").alias(c) for c in PLACE]), PLACE, "left_semi").select("row.*")
