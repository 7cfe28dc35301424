"""SimHash near duplicates through vantage-point trees.

1. Every text gets a 64-bit fingerprint (majority vote of the hashes of its word shingles). Equal fingerprints are one node.
2. A top tree is built on the driver from a sample of fingerprints of bounded size: each inner node has a vantage point and
   a radius, and halves its fingerprints by Hamming distance. Its leaves are shards of about ``SHARD`` fingerprints.
3. Each distinct fingerprint goes to its own shard, and as a visitor to every other shard that its ball of radius
   ``DISTANCE`` may reach: by the triangle inequality the inner side of a node only if its distance to the vantage point is at most
   radius + ``DISTANCE``, the outer side only if it is more than radius - ``DISTANCE``. So each pair meets where one of the two is at home.
4. A shard goes on halving in the same way until few are left, and compares those exactly. A ball too dense for that is
   compared through one-bit neighbours, in time linear in its size: two fingerprints differ in at most two bits if and
   only if they share one of the 65 values that differ from each in at most one bit. Pairs are joined to a forest at once;
   a shard returns one edge for each fingerprint that has a partner, never all pairs of a group.
5. Edges of all shards are contracted to stars (alternating large and small stars), which gives components.

Links at ``DISTANCE`` 2 give the exact result for any data: the sample and the tree only decide where pairs meet.

Defined results: texts without words and null texts have fingerprint zero and are linked like any other; fewer words than a
shingle are one shingle; repeated rows are linked like any copies; a null doc_id counts as larger than all (a component of
nulls only has a null id); an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from heatloom.functions.tables import materialize
from heatloom.llm.places import PLACE, placed
from heatloom.llm.text import SPACES, chunks, lowered_table, words

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Fingerprints that a shard is meant to hold; sampled fingerprints for each shard, and at most; a pool small enough to compare.
SHARD, SAMPLE_EACH, SAMPLE_MOST, POOL = 20_000, 32, 1 << 20, 256
TABLE = lowered_table(SPACES)
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


# ---------------------------------------------------------------- fingerprints


def _votes(hashes: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from the hashes of all texts: bits set in over half of a text's hashes."""
    out = np.zeros(len(per_text), np.uint64)
    ends = np.cumsum(per_text)
    full = np.flatnonzero(per_text)
    step = 1 << 17
    a = 0
    while a < len(full):  # runs of texts, so that the unpacked bits stay small
        first = int(ends[full[a]] - per_text[full[a]])
        b = max(a + 1, int(np.searchsorted(ends[full], first + step, "right")))
        part = full[a:b]
        starts = ends[part] - per_text[part] - first
        block = hashes[first : int(ends[part[-1]])]
        if b == a + 1:  # one text, perhaps a very long one
            counts = sum(np.unpackbits(block[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(block), step))[None]
        else:
            bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[part] = ((2 * counts > per_text[part][:, None]).astype(np.uint64) * _BITS).sum(1, dtype=np.uint64)
        a = b
    return out


def shingle_hashes(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the hashes of their word shingles, text after text, and how many each text has."""
    digest = xxhash.xxh64_intdigest
    for a, b, buf, off in chunks(column):
        flat, borders, of_text = words(buf, off, TABLE)
        n = np.diff(of_text)
        # words joined by single spaces, each with a space behind it
        spaced = np.insert(flat, borders[1:], 32).tobytes()
        begin = borders[:-1] + np.arange(len(borders) - 1)
        end = borders[1:] + np.arange(len(borders) - 1)
        per_text = np.where(n == 0, 0, np.maximum(1, n - shingle + 1))
        first = np.repeat(of_text[:-1] - (np.cumsum(per_text) - per_text), per_text) + np.arange(int(per_text.sum()))
        last = np.minimum(first + shingle, np.repeat(of_text[1:], per_text)) - 1
        hashes = np.fromiter((digest(spaced[i:j], SEED) for i, j in zip(begin[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
        assert b - a == len(per_text)
        yield hashes, per_text


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text of an Arrow column."""
    return np.concatenate([np.zeros(0, np.uint64), *[_votes(*part) for part in shingle_hashes(column, shingle)]])


@arrow_udf(LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    """Column form of ``fingerprints``; the 64 bits as a signed number."""
    return pa.array(fingerprints(text).view(np.int64))


# ---------------------------------------------------------------- vantage-point trees


def distance(x: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(point))


def _vantage(x: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int, float] | None:
    """Vantage point and radius that halve ``x`` with the fewest in both reaches; None if no point divides it."""
    best = None
    for p in rng.choice(x, min(len(x), 8), replace=False):
        counts = np.bincount(distance(x, p), minlength=65)
        upto = np.cumsum(counts)
        for mu in range(64):
            inner = upto[mu]
            if min(inner, len(x) - inner) * 4 < len(x):  # each side gets a quarter at least
                continue
            near = upto[min(64, mu + radius)] - (upto[mu - radius] if mu >= radius else 0)
            cost = near / len(x) + abs(2 * inner - len(x)) / len(x) / 4
            if best is None or cost < best[2]:
                best = (int(p), mu, cost)
    return best


def build_tree(sample: np.ndarray, weight: float, shard: int = SHARD, radius: int = DISTANCE, seed: int = 0) -> list[tuple[int, int, int, int]]:
    """Top tree as a list of nodes (vantage point, radius, inner child, outer child); a child below 0 is the shard ``-1 - child``.

    ``weight``: fingerprints that one of the sample stands for.
    """
    rng = np.random.default_rng(seed)
    nodes: list = []
    shards = 0

    def grow(x: np.ndarray) -> int:
        nonlocal shards
        cut = _vantage(x, radius, rng) if len(x) * weight > shard and len(x) >= 8 else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        inside = distance(x, cut[0]) <= cut[1]
        nodes[at] = (cut[0], cut[1], grow(x[inside]), grow(x[~inside]))
        return at

    grow(sample)
    return nodes


def route(x: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards of fingerprints: places in ``x``, shard, whether it is at home there."""
    place, shard, home = [], [], []
    stack = [(0 if nodes else -1, np.arange(len(x)), np.ones(len(x), bool))]
    while stack:
        node, who, mine = stack.pop()
        if not len(who):
            continue
        if node < 0:
            place.append(who)
            shard.append(np.full(len(who), -1 - node))
            home.append(mine)
            continue
        point, mu, inner, outer = nodes[node]
        d = distance(x[who], point).astype(np.int64)
        a, b = d <= mu + radius, d > mu - radius
        stack += [(inner, who[a], mine[a] & (d[a] <= mu)), (outer, who[b], mine[b] & (d[b] > mu))]
    if not place:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(place), np.concatenate(shard), np.concatenate(home)


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest node reachable from each node over the edges (a, b), on top of earlier labels."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:  # pointer jumping
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _one_bit(x: np.ndarray, who: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Joins all of ``x[who]`` that differ in at most two bits, through the values one bit away, an eighth at a time."""
    near = np.concatenate([[np.uint64(0)], _BITS])
    for part in range(8):
        keys, owner = [], []
        for flip in near:
            k = x[who] ^ flip
            mine = (np.bitwise_count(k & np.uint64(0x5555)) ^ (k >> np.uint64(59)).astype(np.uint8)) & np.uint8(7) == part
            keys.append(k[mine])
            owner.append(who[mine])
        k, o = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(k, kind="stable")
        k, o = k[order], o[order]
        same = np.flatnonzero(k[1:] == k[:-1])
        label = forest(len(x), o[same], o[same + 1], label)
    return label


def shard_forest(x: np.ndarray, home: np.ndarray, radius: int = DISTANCE, pool: int = POOL, seed: int = 1) -> np.ndarray:
    """Label of each fingerprint of a shard: equal for those joined by links of which one end is at home."""
    rng = np.random.default_rng(seed)
    label = np.arange(len(x))
    stack = [(np.flatnonzero(home), np.arange(len(x)))]
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    held = 0
    while stack:
        homes, visitors = stack.pop()
        if not len(homes):
            continue
        cut = None
        if len(homes) > pool:
            cut = _vantage(x[rng.choice(homes, min(len(homes), 2048), replace=False)], radius, rng)
            if cut is None or cut[2] > 0.8:  # too dense to divide
                if radius == 2:
                    label = _one_bit(x, visitors, label)
                    continue
                cut = None
        if cut is None:
            for i in range(0, len(homes), pool):
                some = homes[i : i + pool]
                for j in range(0, len(visitors), 1 << 14):
                    other = visitors[j : j + (1 << 14)]
                    a, b = np.nonzero(np.bitwise_count(x[some][:, None] ^ x[other][None]) <= radius)
                    a, b = some[a], other[b]
                    differ = a != b
                    found_a.append(a[differ])
                    found_b.append(b[differ])
                    held += int(differ.sum())
                    if held > 1 << 20:
                        label = forest(len(x), np.concatenate(found_a), np.concatenate(found_b), label)
                        found_a, found_b, held = [], [], 0
            continue
        point, mu, _ = cut
        dh, dv = distance(x[homes], point).astype(np.int64), distance(x[visitors], point).astype(np.int64)
        stack += [(homes[dh <= mu], visitors[dv <= mu + radius]), (homes[dh > mu], visitors[dv > mu - radius])]
    if held:
        label = forest(len(x), np.concatenate(found_a), np.concatenate(found_b), label)
    return label


# ---------------------------------------------------------------- on Spark


def _router(nodes, radius: int):
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            place, shard, home = route(x, nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(x[place].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    return deal


def _searcher(radius: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["fp"].to_numpy().view(np.uint64)
        label = shard_forest(x, pdf["home"].to_numpy(), radius)
        linked = np.flatnonzero(label != np.arange(len(x)))
        return pd.DataFrame({"u": x[linked].view(np.int64), "v": x[label[linked]].view(np.int64)})

    return search


def links(spark: SparkSession, distinct: DataFrame, radius: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """Edges (u, v) that connect all fingerprints ``fp`` of ``distinct`` (no repeats) within ``radius``, at most one a fingerprint and shard."""
    n = distinct.count()
    most = min(SAMPLE_MOST, max(4096, SAMPLE_EACH * n // shard))
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(most).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = build_tree(sample, n / max(1, len(sample)), shard, radius)
    dealt = distinct.select("fp").mapInArrow(_router(nodes, radius), "shard bigint, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInPandas(_searcher(radius), "u bigint, v bigint")


def stars(edges: DataFrame) -> DataFrame:
    """Contracts edges (u, v) to (u, root), one for each node that is not the smallest of its component.

    Each round is stored in the shared folder, so that the lineage stays short and nothing is gathered. Minima are taken before
    rows are shuffled; a node with very many neighbours is joined to one row.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s"))
    before = now.select(mark.alias("m")).first().m
    while before.n:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = now.select(mark.alias("m")).first().m
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))


def components(docs: DataFrame, radius: int = DISTANCE) -> DataFrame:
    """``root`` and ``component_id`` added to the other columns of ``docs`` (``doc_id``, ``fp``, …)."""
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = stars(links(docs.sparkSession, nodes, radius))
    rooted = nodes.join(root.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` in hex digits, ``component_id``."""
    marked = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text").alias("fp")))
    return components(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates and, of each component, the row with the smallest doc_id; all columns of ``docs``."""
    rows = placed(docs)
    marked = materialize(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), fingerprint("row.text").alias("fp"), *PLACE))
    key = F.struct(F.col("doc_id").isNull(), "doc_id", *PLACE)
    first = components(marked).groupBy("root").agg(F.min(key).alias("first")).select(*[F.col(f"first.{c}").alias(c) for c in PLACE])
    return rows.join(first, PLACE, "left_semi").select("row.*")
