"""Repeated passages by winnowed runs of windows and hashes of whole windows.

Every byte that lies in a ``LENGTH``-byte string which also starts earlier (in a document with a smaller id, or earlier in the
same one) is removed. This takes three steps, each on what the step before has left open; there is no suffix
order, no pointer from bucket to bucket and no recursion:

1. *Initial q-gram buckets.* Each ``LENGTH``-byte window belongs to the q-gram in it with the smallest hash (the leftmost of
   equals), and to one of ``CELLS`` cells by the place of the q-gram in the window. All windows of a q-gram and cell have some bytes
   around the q-gram in common (two thirds of a window); these are the bucket. Equal windows have equal q-grams at
   equal places, so they share a bucket. Consecutive windows with the same q-gram and cell form a *run*; there is a run for
   about every 25 bytes, and only runs are shuffled and sorted, by bucket.
2. *Runs.* Inside a bucket, runs are sorted by an identifier of all that they span, from the first byte
   of their first window to the last byte of their last. Runs with the same identifier have the same windows: the
   first of them in document order leads, all others are removed whole. A bucket with one leader is settled.
3. *Windows.* Leaders that share a bucket differ somewhere in their spans, so only these are taken apart into their windows.
   Windows are grouped by two hashes of all their bytes, and again the first one stays and all others are removed. Followers of a leader have been settled in step 2 and need no second look.

Identifiers are 64-bit polynomial hashes of the bytes, with the bucket or a second hash beside them, so that 128 bits must agree.
Sorting by bucket streams: a task holds one bucket's leader at a time, however large the bucket. Very long texts are read in pieces
that overlap by a window; a run may end at a piece's border, which step 3 makes good.

Order and defined results: a null text is empty; texts are compared as UTF-8 bytes; a null doc_id is smaller than all; rows with the
same doc_id and text are one document, and each gets its result; rows with the same doc_id and different texts are
ordered by a hash of the text; texts below ``LENGTH`` bytes lose nothing; an empty table gives an empty table. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.tables import materialize
from heatloom.llm.text import chunks

LENGTH, GRAM, CELLS = 100, 32, 2
PIECE = 2 << 20

_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, (3, 256), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(buf: np.ndarray, q: int = GRAM) -> np.ndarray:
    """Hash of the ``q`` bytes (a power of two) from each place, by doubling."""
    h, size = _RANDOM[0][buf], 1
    while size < q and len(h) > size:
        h = h[:-size] * np.uint64(pow(_M1, size, 2**64)) + h[size:]
        size *= 2
    return _mixed(h) if size == q else h[:0]


def leftmost_smallest(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of each ``w`` consecutive values, the leftmost of equals."""
    x, at, size = h, np.arange(len(h), dtype=np.int64), 1
    while size < w:
        step = min(size, w - size)
        right = x[step:] < x[:-step]
        x, at = np.where(right, x[step:], x[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return at


class Spans:
    """Hashes of any span of some bytes."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, which: int):
        base = (_M1, _M2)[which]
        have = Spans.powers.get(which)
        if have is None or len(have[0]) <= len(buf):
            n = max(len(buf) + 1, PIECE + 4 * LENGTH)
            power, inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
            power[0] = inverse[0] = 1
            have = Spans.powers[which] = np.cumprod(power), np.cumprod(inverse)
        self.inverse = have[1]
        self.upto = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_RANDOM[1 + which][buf] * have[0][: len(buf)], out=self.upto[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.upto[end] - self.upto[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, place of the first byte in its text, bytes, borders; long texts in overlapping pieces."""
    for a, b, buf, off in chunks(column, PIECE):
        if len(buf) <= 2 * PIECE:
            yield a, b, 0, buf, off
        else:
            for i in range(0, len(buf) - length + 1, PIECE):
                part = buf[i : i + PIECE + length - 1]
                yield a, b, i, part, np.array([0, len(part)])


def runs(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, q: int = GRAM, cells: int = CELLS) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their smallest q-gram and cell: text number, first window, number of windows, bucket, identifier."""
    h = gram_hashes(buf, q)
    at = leftmost_smallest(h, length - q + 1) if len(buf) >= length else np.zeros(0, np.int64)
    sizes = np.maximum(0, np.diff(off) - length + 1)
    text = np.repeat(np.arange(len(off) - 1), sizes)
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    window = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(off[:-1], sizes)
    at = at[window]
    borders = np.rint(np.linspace(0, length - q + 1, cells + 1)).astype(np.int64)  # of the q-gram's place in the window
    cell = (np.searchsorted(borders, at - window, "right") - 1).astype(np.int8)
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (cell[1:] != cell[:-1])]))
    n = np.diff(np.append(cut, len(text)))
    first, gram, cell = window[cut], at[cut], cell[cut]
    spans = Spans(buf, 0)
    bucket = spans.of(gram - borders[cell], gram - borders[cell + 1] + 1 + length)
    return text[cut], first - off[text[cut]], n, bucket, spans.of(first, first + n - 1 + length)


def followers(bucket: np.ndarray, span: np.ndarray, did: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Places of the rows that have an earlier one with the same bucket and span."""
    key = bucket ^ (span << np.uint64(1))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    some = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    some = some[np.lexsort((windows[some], did[some], span[some], bucket[some]))]
    if not len(some):
        return some
    return some[1:][(bucket[some[1:]] == bucket[some[:-1]]) & (span[some[1:]] == span[some[:-1]])]


def _run_rows(length: int):
    """Runs of all texts. Followers inside a chunk are settled at once: they are marked (windows below 0) and dealt out evenly."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("did").to_numpy()
            for a, _, shift, buf, off in _pieces(batch.column("text"), length):
                text, first, n, bucket, span = runs(buf, off, length)
                did, windows = ids[a + text], ((first + shift) << 7) | n  # at most LENGTH - GRAM + 1 windows in a run
                led = followers(bucket, span, did, windows)
                bucket[led] = _mixed(did[led].view(np.uint64) * np.uint64(_M1) + windows[led].view(np.uint64))
                windows[led] = -windows[led]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(span.view(np.int64)), pa.array(did), pa.array(windows)],
                    names=["bucket", "span", "did", "windows"],
                )

    return emit


def _refine(length: int):
    """Step 2 over rows sorted by bucket, span and place: removed runs, and leaders that share a bucket."""

    def emit(did: np.ndarray, windows: np.ndarray, whole: bool) -> pa.RecordBatch:
        windows = np.abs(windows)
        first, n = windows >> 7, windows & 127
        return pa.RecordBatch.from_arrays(
            [pa.array(did), pa.array(np.full(len(did), whole)), pa.array(first.astype(np.int64)), pa.array((first + n - 1 + length).astype(np.int64))],
            names=["did", "whole", "first", "last"],
        )

    def refine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = span = None  # of the row before
        held = None  # the only leader so far of its bucket
        for batch in batches:
            if not batch.num_rows:
                continue
            b, s, did, windows = (batch.column(i).to_numpy() for i in range(4))
            marked = windows < 0
            if marked.any():
                yield emit(did[marked], windows[marked], True)
                b, s, did, windows = (x[~marked] for x in (b, s, did, windows))
                if not len(b):
                    continue
            new_bucket = np.concatenate([[bucket is None or b[0] != bucket], b[1:] != b[:-1]])
            leader = new_bucket | np.concatenate([[span is None or s[0] != span], s[1:] != s[:-1]])
            bucket, span = b[-1], s[-1]
            if not leader.all():
                yield emit(did[~leader], windows[~leader], True)
            at = np.flatnonzero(leader)
            if not len(at):
                continue
            shared = ~new_bucket[at]  # with the leader before
            shared[:-1] |= ~new_bucket[at[1:]]
            if held is not None:
                if not new_bucket[at[0]]:
                    yield emit(*held, False)
                held = None
            open_ = at[shared]
            if len(open_):
                yield emit(did[open_], windows[open_], False)
            if not shared[-1]:
                held = did[at[-1:]], windows[at[-1:]]

    return refine


def removed_bytes(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Borders (start, end) of the maximal covered runs of ``n`` bytes."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last, -1)
    covered = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
    change = np.flatnonzero(covered[1:] != covered[:-1])
    return change.reshape(-1, 2)


RESULT = "did bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<array<bigint>>"


def _result(did: int, data: bytes, first: np.ndarray, last: np.ndarray) -> dict:
    spans = removed_bytes(len(data), first, last)
    digest, at = hashlib.sha256(), 0
    for a, b in spans.tolist():
        digest.update(data[at:a])
        at = b
    digest.update(data[at:])
    return {
        "did": did, "n_bytes": len(data), "n_removed": int((spans[:, 1] - spans[:, 0]).sum()), "n_spans": len(spans),
        "kept_sha256": digest.hexdigest(), "removed": spans.tolist(),
    }


_NONE = np.zeros(0, np.int64)


def _arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


SETTLED = RESULT + ", open_text string, whole array<struct<first bigint, last bigint>>, open array<struct<first bigint, last bigint>>"


def _settle():
    """Results of texts whose runs are all settled; the others with their runs."""
    schema = _arrow(SETTLED)

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                out = []
                for r in batch.slice(i, 512).to_pylist():
                    found = r["runs"] or []
                    whole = [{"first": x["first"], "last": x["last"]} for x in found if x["whole"]]
                    if open_ := [{"first": x["first"], "last": x["last"]} for x in found if not x["whole"]]:
                        out.append({"did": r["did"], "open_text": r["text"], "whole": whole, "open": open_})
                    else:
                        first, last = (np.array([x[k] for x in whole], np.int64) for k in ("first", "last"))
                        out.append(_result(r["did"], (r["text"] or "").encode(), first, last))
                yield pa.RecordBatch.from_pylist(out, schema)

    return settle


def _window_rows(length: int):
    """The windows of open runs, with two hashes each."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                buf = np.frombuffer(r["open_text"].encode(), np.uint8)
                first = np.array([x["first"] for x in r["open"]], np.int64)
                n = np.array([x["last"] for x in r["open"]], np.int64) - length + 1 - first
                # only the bytes around the runs, in pieces, so that a very long text needs no long arrays
                order = np.argsort(first)
                first, n = first[order], n[order]
                a = 0
                while a < len(first):
                    base = int(first[a])
                    b = max(a + 1, int(np.searchsorted(first, base + PIECE, "right")))
                    part = buf[base : int((first[a:b] + n[a:b]).max()) + length - 1]
                    at = np.repeat(first[a:b] - base - (np.cumsum(n[a:b]) - n[a:b]), n[a:b]) + np.arange(int(n[a:b].sum()))
                    h1, h2 = Spans(part, 0).of(at, at + length), Spans(part, 1).of(at, at + length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.full(len(at), r["did"], np.int64)), pa.array(at + base)],
                        names=["h1", "h2", "did", "at"],
                    )
                    a = b

    return emit


def _finish(length: int):
    schema = _arrow(RESULT)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                out = []
                for r in batch.slice(i, 512).to_pylist():
                    at = np.array(r["at"] or [], np.int64)
                    first = np.concatenate([np.array([x["first"] for x in r["whole"]], np.int64), at])
                    last = np.concatenate([np.array([x["last"] for x in r["whole"]], np.int64), at + length])
                    out.append(_result(r["did"], r["open_text"].encode(), first, last))
                yield pa.RecordBatch.from_pylist(out, schema)

    return finish


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``did`` and ``text`` of each distinct document, did in document order; and, if that is not doc_id, ``did`` of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count() == 0:
        return rows.select(F.col("doc_id").alias("did"), "text"), None
    marked = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    one = marked.groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    order = one.select("doc_id", "th").repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    number = materialize(order.select("doc_id", "th", F.monotonically_increasing_id().alias("did")))
    same = lambda a: (F.col(f"{a}.doc_id").eqNullSafe(F.col("n.doc_id"))) & (F.col(f"{a}.th") == F.col("n.th"))
    texts = one.alias("o").join(number.alias("n"), same("o")).select("n.did", "o.text")
    return texts, marked.select("doc_id", "th").alias("m").join(number.alias("n"), same("m")).select("n.did", "m.doc_id")


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``removed`` (start, end) runs."""
    if not GRAM <= length <= GRAM + 126:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 126}")
    texts, back = _numbered(docs)
    found = texts.mapInArrow(_run_rows(length), "bucket bigint, span bigint, did bigint, windows bigint")
    ordered = found.repartition("bucket").sortWithinPartitions("bucket", "span", "did", "windows")
    refined = materialize(ordered.mapInArrow(_refine(length), "did bigint, whole boolean, first bigint, last bigint"))
    of_text = refined.groupBy("did").agg(F.collect_list(F.struct("whole", "first", "last")).alias("runs"))
    settled = materialize(texts.join(of_text, "did", "left").select("did", "text", "runs").mapInArrow(_settle(), SETTLED))
    open_ = settled.where("open_text IS NOT NULL")
    windows = open_.select("did", "open_text", "open").mapInArrow(_window_rows(length), "h1 bigint, h2 bigint, did bigint, at bigint")
    # stored step by step, so that the shuffle files of a step go before the next one
    firsts = materialize(windows.groupBy("h1", "h2").agg(F.min(F.struct("did", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = windows.join(firsts, ["h1", "h2"]).where("struct(did, at) <> first")
    at = materialize(later.groupBy("did").agg(F.collect_list("at").alias("at")))
    finished = open_.join(at, "did", "left").select("did", "open_text", "whole", "at").mapInArrow(_finish(length), RESULT)
    columns = [c.split()[0] for c in RESULT.split(", ")]
    result = settled.where("open_text IS NULL").select(*columns).unionByName(finished)
    if back is None:
        return result.withColumnRenamed("did", "doc_id")
    return back.join(result, "did").drop("did")


def passage_report(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
