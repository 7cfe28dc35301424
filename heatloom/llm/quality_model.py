"""Quality scores by a generalised additive model with pairwise interactions.

1. Each whole text becomes a row of measures (``FEATURES``): shares of kinds of characters and words, repeats, lengths. They are stored.
2. Cut points of each measure are quantiles over all rows that are not held out, from one distributed sketch. A value's bin is its place
   among them.
3. Cyclic boosting: round after round, each measure in turn gets a shallow tree over its bins, fitted to what all measures together do
   not explain yet; its steps are added to the measure's lookup table. Then pairs of measures are ranked by what a cut through both
   explains of the rest, and the best ``PAIRS`` get tables of their own in the same way, over coarser bins.
4. A score is the sigmoid of the intercept and one table entry for each measure and pair, added for all rows of a batch at once.

The model is fitted on the driver on a bounded sample of labelled rows (about ``FIT_ROWS``, the smallest hashes of doc_id); features, cut points
and scores cover all rows. Rows with crc32(doc_id as text) mod ``FOLDS`` = ``HELD_OUT`` give neither labels nor cut points. Only ``text`` enters a score.

Defined results: a null text is empty, an empty text has all measures zero and a score like others; a null doc_id is not held out
and has no label; labels without a quality do not count, and of several labels of one doc_id the majority counts (ties: 1), as one row; of
several texts of one doc_id the one with the smallest measures is learned from, all are scored; repeated rows are scored each; texts of any length are
measured whole; without any label all scores are 0.5; an empty table gives an empty table. Other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from heatloom.functions.tables import materialize
from heatloom.llm.text import SPACES, chunks, strings, words

FOLDS, HELD_OUT, LIMIT = 4, 2, 0.7
#: The bound of the sample that the model is fitted on, in rows; cut points of a measure and of a measure in a pair.
FIT_ROWS, CUTS, COARSE = 1 << 16, 63, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE, LEAST = 150, 60, 6, 0.1, 2.0, 1.0

FEATURES = [
    "log_words", "word_length", "upper", "digits", "symbols", "pipes", "marks", "stops", "foreign", "caps_words", "symbol_ends",
    "bare_words", "short_words", "long_words", "same_as_last", "distinct", "commonest", "repeated_runs", "words_a_line",
]
RUN = 4
_PLAIN = bytes(32 if c in SPACES else c for c in range(256))
#: Words in lower case, for comparisons.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _kind("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_DIGIT, _SYMBOL, _PIPE, _MARK, _STOP = _kind("0123456789"), _kind("#*$%&<>@^~_=+{}[]\\/"), _kind("|"), _kind("!?"), _kind(".,;:")
_LEAD = np.zeros(256, bool)
_LEAD[128:192] = True  # bytes that continue a character


def measures(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` a text."""
    out = []
    for a, b, buf, off in chunks(column):
        data, borders, per_text = words(buf, off, _PLAIN)
        n = np.diff(per_text).astype(float)
        some = np.maximum(n, 1)

        def upto(values: np.ndarray) -> np.ndarray:
            total = np.zeros(len(values) + 1, np.int64)
            np.cumsum(values, out=total[1:])
            return total

        def per_word(kind: np.ndarray, upto=upto, data=data, borders=borders) -> np.ndarray:
            return np.diff(upto(kind[data])[borders])

        def share(of_words: np.ndarray, upto=upto, per_text=per_text, some=some) -> np.ndarray:
            return np.diff(upto(of_words)[per_text]) / some

        size = np.diff(borders) - per_word(_LEAD)  # code points
        letters, upper = per_word(_LETTER) - per_word(_LEAD), per_word(_UPPER)
        chars = np.maximum(np.diff(upto(size)[per_text]), 1)

        def of_chars(counts: np.ndarray, upto=upto, per_text=per_text, chars=chars) -> np.ndarray:
            return np.diff(upto(counts)[per_text]) / chars

        last = data[borders[1:] - 1] if len(size) else np.zeros(0, np.uint8)
        code = strings(np.frombuffer(data.tobytes().translate(_LOWER), np.uint8), borders).dictionary_encode().indices.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(b - a), np.diff(per_text))
        inner = np.ones(len(code), bool)
        inner[per_text[:-1][n > 0]] = False
        same = np.zeros(len(code), bool)
        same[1:] = (code[1:] == code[:-1]) & inner[1:]
        pair, times = np.unique(text * (int(code.max(initial=0)) + 1) + code, return_counts=True)
        owner = pair // (int(code.max(initial=0)) + 1)
        most = np.zeros(b - a)
        np.maximum.at(most, owner, times)
        runs = np.maximum(n - RUN + 1, 0)
        mixed = np.zeros(max(0, len(code) - RUN + 1), np.uint64)
        for i in range(RUN):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[i : i + len(mixed)].astype(np.uint64) + np.uint64(1)
        whole = text[: len(mixed)] == text[RUN - 1 :][: len(mixed)]
        mixed, of = mixed[whole] ^ (text[: len(mixed)][whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), text[: len(mixed)][whole]
        _, inverse, times = np.unique(mixed, return_inverse=True, return_counts=True)
        again = np.bincount(of[times[inverse] > 1], minlength=b - a)
        lines = np.diff(upto(buf == 10)[off]) + 1
        out.append(
            np.stack(
                [
                    np.log2(1 + n), np.diff(upto(size)[per_text]) / some, of_chars(upper), of_chars(per_word(_DIGIT)), of_chars(per_word(_SYMBOL)), of_chars(per_word(_PIPE)),
                    of_chars(per_word(_MARK)), of_chars(per_word(_STOP)), of_chars(per_word(_LEAD)), share((upper == letters) & (letters > 1)), share(_SYMBOL[last] | _PIPE[last]),
                    share(letters == 0), share(size <= 3), share(size > 15), share(same), np.bincount(owner, minlength=b - a) / some, most / some,
                    again / np.maximum(runs, 1), n / lines,
                ],
                1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@arrow_udf(ArrayType(FloatType()))
def measured(text: pa.Array) -> pa.Array:
    rows = measures(text).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), pa.array(rows.ravel()))


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # coarse bin of each bin
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)]

    def odds(self, x: np.ndarray) -> np.ndarray:
        """The sum of all table entries of each row."""
        bins = self.bins(x)
        out = np.full(len(x), self.intercept)
        for b, t in zip(bins, self.tables, strict=True):
            out += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.odds(x))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def steps(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values of the bins by a tree of ``depth`` cuts in a row, each where it explains most; bins with little in them are not cut off."""
    total_g, total_h = g.sum(), h.sum()
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        better = gain(left_g, left_h) + gain(right_g, right_h) - gain(total_g, total_h)
        better[(left_h < LEAST) | (right_h < LEAST)] = -1
        k = int(better.argmax())
        if better[k] > 1e-9:
            return np.concatenate([steps(g[: k + 1], h[: k + 1], depth - 1), steps(g[k + 1 :], h[k + 1 :], depth - 1)])
    return np.full(len(g), total_g / (total_h + RIDGE))


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """What the best cut through both measures of a pair explains, and the values of the cells by it."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def four(c: np.ndarray) -> list[np.ndarray]:
        a, top, left = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return [a, top - a, left - a, c[-1, -1] - top - left + a]

    parts = list(zip(four(cg), four(ch), strict=True))
    better = sum(gain(x, y) for x, y in parts) - gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(better.argmax()), better.shape)
    value = [x[i, j] / (max(y[i, j], 0) + RIDGE) for x, y in parts]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(better[i, j]), out


def coarse_bins(sizes: np.ndarray) -> np.ndarray:
    """Runs of bins with about equal numbers of rows, at most ``COARSE``."""
    upto = np.cumsum(sizes) - sizes
    place = upto * COARSE // max(1, int(sizes.sum()))
    return np.unique(place, return_inverse=True)[1]


def fit(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray]) -> Model:
    """A model of the labels ``y`` (0 or 1) of rows ``x``."""
    n, k = len(y), x.shape[1]
    if not n:
        return Model(0.0, [c[:0] for c in cuts], [np.zeros(1)] * k, [np.zeros(1, np.int64)] * k, [], [])
    base = (y.sum() + 0.5) / (n + 1)
    model = Model(float(np.log(base / (1 - base))), cuts, [np.zeros(len(c) + 1) for c in cuts], [], [], [])
    bins = model.bins(x)
    odds = np.full(n, model.intercept)
    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables, strict=True):
            p = sigmoid(odds)
            add = RATE * steps(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)))
            t += add
            odds += add[b]
    model.coarse = [coarse_bins(np.bincount(b, minlength=len(t))) for b, t in zip(bins, model.tables, strict=True)]
    rough = [c[b] for c, b in zip(model.coarse, bins, strict=True)]
    width = [int(c.max()) + 1 for c in model.coarse]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell = sigmoid(odds), rough[i] * width[j] + rough[j]
        shape = (width[i], width[j])
        return np.bincount(cell, y - p, width[i] * width[j]).reshape(shape), np.bincount(cell, p * (1 - p), width[i] * width[j]).reshape(shape)

    ranked = sorted(((quadrants(*sums(i, j))[0], (i, j)) for i, j in combinations(range(k), 2)), reverse=True)
    model.pairs = [pair for better, pair in ranked[:PAIRS] if better > 1e-6]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            add = RATE * quadrants(*sums(i, j))[1]
            t += add
            odds += add[rough[i], rough[j]]
    for b, t in zip(bins, model.tables, strict=True):  # tables of measures are centred, the rest is the intercept
        mean = t[b].mean()
        t -= mean
        model.intercept += float(mean)
    return model


# ---------------------------------------------------------------- on Spark


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def cut_points(rows: DataFrame) -> list[np.ndarray]:
    """Distinct quantiles of each measure over ``rows`` (column ``x``), and the least value above the smallest one."""
    at = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    aggregates = []
    for i in range(len(FEATURES)):
        v = F.col("x")[i]
        aggregates += [F.percentile_approx(v, at, 1000).alias(f"q{i}"), F.min(v).alias(f"low{i}")]
    found = rows.agg(*aggregates).first()
    cuts = []
    for i in range(len(FEATURES)):
        q = np.unique(np.array(found[f"q{i}"] or [], np.float32)).astype(float)
        low = found[f"low{i}"]
        first = [] if low is None else [float(np.nextafter(np.float32(low), np.float32(np.inf)))]
        cuts.append(np.unique(np.concatenate([q[q > (low if low is not None else 0)], first])))
    return cuts


def labelled(rows: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Measures and labels of about ``fit_rows`` labelled rows that are not held out, all of them if there are fewer."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = materialize(known.where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")))
    n = known.count()
    if n > fit_rows:  # a place by hash below the share wanted
        known = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    # ids of the sample, at most about fit_rows of 12 bytes
    one = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    found = one.orderBy("doc_id").select("x", "y").toArrow()
    x = found.column("x").combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False) if found.num_rows else np.zeros(0)
    return x.reshape(-1, len(FEATURES)).astype(float), found.column("y").to_numpy().astype(float)


def scorer(model: Model) -> Callable[[str], Column]:
    @arrow_udf(DoubleType())
    def score(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(float)
        return pa.array(model.score(rows))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``LIMIT`` on)."""
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), measured("text").alias("x")))
    x, y = labelled(rows, labels, fit_rows)
    model = fit(x, y, cut_points(rows.where(~held_out())))
    scored = rows.select("doc_id", held_out().alias("held_out"), scorer(model)("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
