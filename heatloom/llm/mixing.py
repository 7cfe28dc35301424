"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``BLOCK_ROWS`` documents, in a seeded order. With target weight w, block j of a source
(from 1) may not start before slot floor((j - 1) / w) and has to be done by slot ceil(j / w); one block runs in each
slot, always the released one with the earliest deadline. Weights are exact fractions that add up to one, so that the load
is one and every deadline is met: after any number of slots each source is less than one block off its target share, however
long the schedule is. The driver lays out the blocks, one step and one row of 40 bytes for each: blocks grow with the table where
there would be more than ``MOST_BLOCKS`` of them, so what the driver does and sends is bounded but for one row a source.

Every document is placed exactly once: none is dropped, none repeated. When a source has run out, its later slots stay
empty and the other sources keep their order and proportions.

Defined results: a null source is a source of its own; repeated rows are placed one after the other; a source without a
given weight, or with a weight of zero or less, gets the least share (one in ``UNITS``, or in ``UNITS_EACH`` for each source), and
the others divide the rest by their weights; texts of any length count as one row; an empty table gives an empty table.
Only ``doc_id``, ``source`` and (to tell rows with one id apart) ``text`` are read; other columns pass through.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.tables import materialize
from heatloom.llm.order import positions
from heatloom.llm.places import PLACE
from heatloom.llm.places import placed as placed_rows

BLOCK_ROWS, MOST_BLOCKS, SEED = 64, 1 << 18, 17
#: The least share is one in so many, or in so many for each source; target weights grow as this power of a source's size.
UNITS, UNITS_EACH, POWER = 1000, 20, 0.7
REPORTED = 1 << 40


def units(weights: dict[str | None, float], total: int) -> dict[str | None, int]:
    """Whole units in proportion to the weights that add up to ``total`` (largest remainders first); one unit at least."""
    share = {k: max(0.0, w) for k, w in weights.items()}
    least: set = set()
    while True:
        rest, left = sum(w for k, w in share.items() if k not in least), total - len(least)
        small = {k for k, w in share.items() if k not in least and w * left <= rest}
        if not small or len(small) + len(least) == len(share):
            break
        least |= small
    share = {k: 1.0 if k in least else w * left / rest if rest else left / (len(share) - len(least)) for k, w in share.items()}
    out = {k: max(1, int(v)) for k, v in share.items()}
    order = sorted(out, key=lambda k: (out[k] - share[k], k is not None, k or ""))
    for i in range(total - sum(out.values())):
        out[order[i % len(order)]] += 1
    return out


def targets(weights: dict[str | None, float]) -> dict[str | None, Fraction]:
    """Exact shares in proportion to the weights; the least share for each that has none above zero."""
    given = {k: Fraction(w) for k, w in weights.items() if w > 0}
    if not given:
        return {k: Fraction(1, len(weights)) for k in weights}
    least = Fraction(1, max(UNITS, UNITS_EACH * len(weights)))
    each = (1 - least * (len(weights) - len(given))) / sum(given.values())
    return {k: given[k] * each if k in given else least for k in weights}


def lay_out(target: dict[str | None, Fraction], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """Source, number (from 0), release, deadline and slot of every block in the order of slots: earliest deadline first among the released."""
    names = sorted(target, key=lambda k: (k is not None, k or ""))
    total = lcm(*[w.denominator for w in target.values()])
    load = [int(target[k] * total) for k in names]
    waiting = [(0, -(-total // load[i]), i, 0) for i, k in enumerate(names) if blocks[k]]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, *rest = heapq.heappop(waiting)
            heapq.heappush(ready, (*rest, release))
        deadline, i, j, release = heapq.heappop(ready)
        yield names[i], j, release, deadline, slot
        slot += 1
        if j + 1 < blocks[names[i]]:
            heapq.heappush(waiting, ((j + 1) * total // load[i], -(-(j + 2) * total // load[i]), i, j + 1))


def cycle(load: dict[str | None, int]) -> list[tuple[str | None, int]]:
    """Source and number (from 0) of the block in each slot of one cycle of whole units."""
    total = sum(load.values())
    return [(k, j) for k, j, *_ in lay_out({k: Fraction(n, total) for k, n in load.items()}, load)]


def default_weights(rows: dict[str | None, int], power: float = POWER) -> dict[str | None, float]:
    """Weights between equal shares and shares by size."""
    return {k: n**power for k, n in rows.items()}


def schedule(docs: DataFrame, names: list[str], weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """The columns ``names`` of ``docs`` with source, rank, block, weight, units, release, deadline and slot; one row per document.

    ``weight`` is the target share, ``units`` the same in parts of ``REPORTED``; ``release`` and ``deadline`` are the slots
    between which the block has to run, by the exact share.
    """
    spark = docs.sparkSession
    rows = materialize(
        docs.select(
            F.struct(*names).alias("row"),
            F.col("source").cast("string").alias("source"),
            F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "text").alias("key"),
            F.col("doc_id").cast("long").alias("doc_id"),
        )
    )
    size = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
    block_rows = max(block_rows, -(-sum(size.values()) // MOST_BLOCKS))
    given = weights if weights is not None else default_weights(size)
    target = targets({k: given.get(k, 0.0) for k in size}) if size else {}
    load = units({k: float(w) for k, w in target.items()}, REPORTED) if size else {}
    slots = _slots(target, {k: -(-n // block_rows) for k, n in size.items()})
    ranked = positions(
        rows, ["source"], F.col("key").cast("double"), -(2.0**63), 2.0**63, sum(size.values()), ["doc_id"], "rank"
    )
    ranked = ranked.withColumn("block", F.expr(f"rank div {block_rows}"))
    per_source = spark.createDataFrame([(k, float(w), load[k]) for k, w in target.items()], "u_source string, weight double, units long")
    with_units = ranked.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("u_source"))).drop("u_source")  # a row for each source
    same = F.col("a.source").eqNullSafe(F.col("b.b_source")) & (F.col("a.block") == F.col("b.b_block"))
    placed = with_units.alias("a").join(spark.createDataFrame(slots).alias("b"), same)
    return placed.select("a.row.*", "a.source", "a.rank", "a.block", "a.weight", "a.units", "b.release", "b.deadline", "b.slot", F.expr(f"a.rank % {block_rows}").alias("row_in_block"))


def _slots(target: dict[str | None, Fraction], blocks: dict[str | None, int]) -> pa.Table:
    """The schedule as a table, one row for each block."""
    names = list(target)
    number = {k: i for i, k in enumerate(names)}
    columns = [array("q") for _ in range(5)]
    for source, *rest in lay_out(target, blocks) if target else ():
        for c, v in zip(columns, (number[source], *rest), strict=True):
            c.append(v)
    of, *numbers = [np.frombuffer(c, np.int64) if c else np.zeros(0, np.int64) for c in columns]
    source = pa.array(names, pa.string()).take(pa.array(of))
    return pa.Table.from_arrays([source, *[pa.array(x) for x in numbers]], names=["b_source", "b_block", "release", "deadline", "slot"])


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All documents with their own columns, globally sorted: by slot, and within a block by rank.

    The schedule is made of narrow rows; texts are shuffled twice, to their slots and into order.
    """
    rows = placed_rows(docs)
    slots = schedule(rows.select(*PLACE, "row.doc_id", "row.source", "row.text"), PLACE, weights, block_rows)
    return rows.join(slots.select(*PLACE, "slot", "rank"), PLACE).orderBy("slot", "rank").select("row.*")


def mixing_report(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: its source with its target share, block, the slots it may run in and the one it got, and its place in the block."""
    return schedule(docs, ["doc_id"], weights, block_rows).select(
        "doc_id", "source", "weight", "units", "block", "release", "deadline", "slot", "row_in_block"
    )
