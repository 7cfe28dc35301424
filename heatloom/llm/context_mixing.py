"""Language-model scores by logistic context mixing of hashed-context bit predictors.

A text is coded as lower-cased words, each spelled bit by bit with a space behind it, and an end mark. Each bit is predicted
from several contexts (``CONTEXTS``): the last byte, two and three bytes inside the word, the word so far, and the word so far
together with the class of the document's language. A context and the bits of the byte so far are hashed to a slot with two
counts, of zeros and ones in the training texts. The predictions are stretched (log odds) and added with weights; the gate
that selects the set of weights is made of the confidence (count) of the longest contexts. The sum is squashed and refined by an
adaptive map from (bits of the byte so far, quantized odds) to what happened there. Sums of bits are log probabilities of texts.

*What is learned.* Counts come from all training texts: words are counted by class in a distributed aggregation, and each
distinct word adds its count to its slots. Weights and the adaptive map are learned from all words of all training texts as well, each
predicted without one occurrence of its own and weighted by its occurrences: tasks sum up slope and curvature of the log
probability in the weights of each gate, Spark adds them up, and a Newton step moves the weights; then the cells of the map are
counted in the same way. Sums do not depend on the order or the partitions of the words, and their number is fixed.

*Words before.* The spelling is one of three predictors of a word (or of the end): the others are what followed the word before, and the two
words before, in the training texts, each counted exactly under a hash of 48 bits. They are mixed with weights ``a`` that are chosen by a
gate, the count of the context: ``(1 - a2) * ((1 - a1) * spelled + a1 * c1 / n1) + a2 * c2 / n2``. The weights are learned by expectation
maximization on all words of all training texts, each predicted without its own occurrence in the counts of words before. So a text is worth
more in an order that the corpus has, and a passage that the corpus has twice more than one it has once.

*Where things go.* No context of the spelling reaches beyond a word, so its log probability for a word and class is the same wherever the word
stands: it is computed once for each distinct word and class, in the table of words (one row a word, partitioned by Spark). Texts are read in chunks
of about ``CHUNK`` bytes. A chunk asks for the distinct pairs and triples it holds, with its training counts, and for its words; questions are dealt by their
hash into groups of about ``GROUP`` contexts, each of which adds up its counts, finds its words in the table and answers every chunk with one number for
each question. The answers then meet the texts of their chunk. The most frequent words (at most ``HOT_WORDS``) are known from a broadcast table. The
slots of the spelling have a fixed number, the counts of words before grow with the corpus, and a task holds a chunk or a group of either.

The base score is that of words with added one: the sum over tokens (words and the end) of log10((c + 1) / (N + V + 1)).

Defined results: a null text is empty and consists of its end; a null doc_id counts as the empty id for the split; a null or rare
language shares one class; repeated rows are each counted and reported; without training texts all counts are
zero; texts of any length are coded whole; an empty table gives an empty table. Only ``doc_id``, ``text`` and ``lang`` are read, so other
columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.functions.tables import drop_stored, materialize, stored_paths
from heatloom.llm.text import SPACES, buffers, chunks, lowered_table, release, strings, words

FOLDS, HELD_OUT = 7, 2
CLASSES, HOT_WORDS = 8, 1 << 17
#: Contexts and the bits of their numbers of slots.
CONTEXTS = {"one": 16, "two": 19, "three": 20, "word": 21, "word_class": 21}
BLOCK = 1 << 13
PRIOR, ODDS = 0.1, 24
#: Weights before learning (contexts and constant), Newton steps, and the bits that weights and map count as before they move.
START, STEPS, HELD = (0.1, 0.1, 0.2, 0.3, 0.4, 0.0), 1, 20
#: Bytes of text that ask for their contexts at once, contexts that are counted in one group.
CHUNK, GROUP = 2 << 20, 1 << 20
#: Rows that go to a task's Python at once, where each text comes with lists over its tokens.
ROWS, AT_ONCE = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Gates of the words before (half powers of two of the context's count, none for an unseen one), weights before learning and steps of learning.
GATES, SHARE, PASSES = 64, 0.2, 2
TABLE = lowered_table(SPACES)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_FIRST = np.cumsum([0, *[1 << b for b in CONTEXTS.values()]])
SLOTS = int(_FIRST[-1])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0xC2B2AE3D27D4EB4F
        up, down = np.full(n + (1 << 16), base, np.uint64), np.full(n + (1 << 16), pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


# ---------------------------------------------------------------- bits


@dataclass
class Spelling:
    """Bytes of some words, each with a space behind it, and the hash of each byte's contexts."""

    data: np.ndarray
    word: np.ndarray  # number of each byte's word
    contexts: list[np.ndarray]

    @cached_property
    def mixed(self) -> list[np.ndarray]:
        return [h * _MIX for h in self.contexts]


def spell(column: pa.Array, classes: np.ndarray) -> Spelling:
    buf, off = buffers(column)
    n = len(off) - 1
    data = np.insert(buf, off[1:], 32)
    begin = off[:-1] + np.arange(n)
    size = np.diff(off) + 1
    word = np.repeat(np.arange(n), size)
    place = np.arange(len(data)) - begin[word]
    last = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint8), data[: len(data) - k]]) if len(data) >= k else 0, 32).astype(np.uint64) for k in (1, 2, 3)]
    up, down = _powers(len(data) + 1)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=upto[1:])
    first = begin[word]
    prefix = (upto[np.arange(len(data))] - upto[first]) * down[first] + place.astype(np.uint64)
    two = last[0] << np.uint64(8) | last[1]
    return Spelling(data, word, [last[0], two, two << np.uint64(8) | last[2], prefix, prefix + (classes[word].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)])


def bit_slots(s: Spelling, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For bit ``k`` of each byte: the bits before it (with a leading one), the bit, and the slot of each context (a row each)."""
    node = (np.uint64(1) << np.uint64(k)) | (s.data >> np.uint8(8 - k)).astype(np.uint64) if k else np.ones(len(s.data), np.uint64)
    bit = (s.data >> np.uint8(7 - k)) & 1
    out = np.empty((len(CONTEXTS), len(s.data)), np.int64)
    out[0] = (s.contexts[0] << np.uint64(8) | node).view(np.int64)  # no collisions
    step = node * np.uint64(0xFF51AFD7ED558CCD)
    for i, bits in enumerate(CONTEXTS.values()):
        if i:
            x = s.mixed[i] ^ step
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            x >>= np.uint64(64 - bits)
            np.add(x.view(np.int64), _FIRST[i], out=out[i])
    return node.view(np.int64), bit, out


def _pieces(column: pa.Array, classes: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int, Spelling]]:
    for a, b, _, _ in chunks(column, size):
        yield a, b, spell(column.slice(a, b - a), classes[a:b])


# ---------------------------------------------------------------- model


@dataclass
class Model:
    """Stretched predictions and confidences of all slots, weights by gate, adaptive map."""

    stretched: np.ndarray  # float16
    sure: np.ndarray  # 0 never seen, 1 to 3 by count
    weights: np.ndarray  # gate, context and constant
    refined: np.ndarray  # bits of the byte so far, quantized odds

    def bits(self, node: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched predictions (and a constant, a row each), gate, mixed odds."""
        x = np.full((len(CONTEXTS) + 1, slots.shape[1]), 0.3, np.float32)
        for i in range(len(CONTEXTS)):
            x[i] = self.stretched[slots[i]]
        gate = gates(self.sure, slots)
        odds = np.zeros(slots.shape[1], np.float32)
        for i in range(len(x)):
            odds += x[i] * self.weights[gate, i]
        return x, gate, np.clip(odds, -11, 11)

    def cost(self, node: np.ndarray, bit: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Minus the log2 probability of each bit."""
        _, _, odds = self.bits(node, slots)
        p = one_probability(odds, node, self.refined)
        return -np.log2(np.where(bit == 1, p, 1 - p))


def gates(sure: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return sure[slots[4]].astype(np.int64) * 16 + sure[slots[3]] * 4 + sure[slots[2]]


def one_probability(odds: np.ndarray, node: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Mean of the mixed and the refined probability of a one, away from 0 and 1."""
    at = (odds + 12) * (ODDS / 24)
    low = at.astype(np.int64)
    share = at - low
    fine = refined[node, low] * (1 - share) + refined[node, low + 1] * share
    p = 0.5 / (1 + np.exp(-odds.astype(np.float64))) + 0.5 * fine
    return np.clip(p, 1e-6, 1 - 1e-6)


def stretch(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((np.maximum(ones, 0) + PRIOR) / (np.maximum(zeros, 0) + PRIOR))


def confidence(n: np.ndarray) -> np.ndarray:
    return ((n > 0).astype(np.uint8) + (n >= 4) + (n >= 30)).astype(np.uint8)


def without_one(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions of each slot less a zero and less a one, side by side, and confidences of all slots less one."""
    x = np.empty((len(counts), 2), np.float16)
    x[:, 0] = stretch(counts[:, 1], counts[:, 0] - 1)
    x[:, 1] = stretch(counts[:, 1] - 1, counts[:, 0])
    return x.ravel(), confidence(counts.sum(1) - 1)


Less = tuple[np.ndarray, np.ndarray]


def _predicted(column: pa.Array, classes: np.ndarray, weight: np.ndarray, less: Less, weights: np.ndarray) -> Iterator[tuple]:
    """For each bit of the words, predicted without one occurrence of its word: node, bit, occurrences, inputs (a row each), gate, mixed odds."""
    stretched, sure = less
    for a, b, s in _pieces(column, classes):
        n = weight[a:b][s.word]
        for k in range(8):
            node, bit, slots = bit_slots(s, k)
            x = np.full((len(CONTEXTS) + 1, len(bit)), 0.3)
            for i in range(len(CONTEXTS)):
                x[i] = stretched[2 * slots[i] + bit]
            gate = gates(sure, slots)
            odds = np.zeros(len(bit))
            for i in range(len(x)):
                odds += x[i] * weights[gate, i]
            yield node, bit, n, x, gate, np.clip(odds, -11, 11)


def slope(total: np.ndarray, column: pa.Array, classes: np.ndarray, weight: np.ndarray, less: Less, weights: np.ndarray) -> None:
    """Adds the slope and the curvature of the log probability of all bits in the weights of each gate."""
    sums = total.reshape(len(weights), -1, len(CONTEXTS) + 1)
    for _, bit, n, x, gate, odds in _predicted(column, classes, weight, less, weights):
        p = 1 / (1 + np.exp(-odds))
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        x, error, curve = x[:, order], ((bit - p) * n)[order], (p * (1 - p) * n)[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=len(weights)))])
        for g in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[g], cuts[g + 1])
            sums[g, 0] += x[:, at] @ error[at]
            sums[g, 1:] += (x[:, at] * curve[at]) @ x[:, at].T


def seen(total: np.ndarray, column: pa.Array, classes: np.ndarray, weight: np.ndarray, less: Less, weights: np.ndarray) -> None:
    """Adds how many bits, and how many ones, fall into each cell of the adaptive map."""
    sums = total.reshape(2, -1)
    for node, bit, n, _, _, odds in _predicted(column, classes, weight, less, weights):
        cell = node * (ODDS + 1) + np.rint((odds + 12) * (ODDS / 24)).astype(np.int64)
        sums[0] += np.bincount(cell, n, sums.shape[1])
        sums[1] += np.bincount(cell, n * bit, sums.shape[1])


def moved(weights: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weights after one Newton step; those of rare gates stay close."""
    sums = total.reshape(len(weights), -1, len(CONTEXTS) + 1)
    return weights + np.linalg.solve(sums[:, 1:] + HELD * np.eye(len(CONTEXTS) + 1), sums[:, 0, :, None])[:, :, 0]


def learned(counts: np.ndarray, summed) -> Model:
    """The model from the counts of all slots. ``summed(add, size, less, weights)`` is what ``add`` sums up over all words that are learned from."""
    less = without_one(counts)
    weights = np.tile(np.array(START), (64, 1))
    for _ in range(STEPS):
        weights = moved(weights, summed(slope, len(weights) * (len(CONTEXTS) + 1) * (len(CONTEXTS) + 2), less, weights))
    # the map starts as the identity, which counts as some bits, and moves to what was seen
    n, ones = summed(seen, 2 * 256 * (ODDS + 1), less, weights).reshape(2, 256, -1)
    identity = 1 / (1 + np.exp(-(np.arange(ODDS + 1) * 24 / ODDS - 12)))
    refined = (ones + HELD * identity) / (n + HELD)
    return Model(stretch(counts[:, 1], counts[:, 0]).astype(np.float16), confidence(counts.sum(1)), weights.astype(np.float32), refined.astype(np.float32))


def fit(counts: np.ndarray, column: pa.Array, classes: np.ndarray, weight: np.ndarray, learn=learned) -> Model:
    """The model from counts and some words, in one process."""

    def summed(add, size: int, less: Less, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(size)
        add(total, column, classes, weight, less, weights)
        return total

    return learn(counts, summed)


# ---------------------------------------------------------------- words before


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BEGIN, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def word_hashes(column: pa.Array) -> np.ndarray:
    """64 bits for each word."""
    buf, off = buffers(column)
    up, down = _powers(len(buf) + 1)
    upto = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_RANDOM[buf] * up[: len(buf)], out=upto[1:])
    return _mixed((upto[off[1:]] - upto[off[:-1]]) * down[off[:-1]] + np.diff(off).astype(np.uint64))


def _after(values: np.ndarray, first: np.ndarray, begin) -> np.ndarray:
    """The value of the token before, ``begin`` at the first token of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = begin
    return out


class Chunk:
    """Some whole texts as tokens (words and ends), and what they ask for: distinct pairs and triples, and words that are not hot."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, classes: np.ndarray, names: pa.Array):
        flat, borders, of_text = words(buf, off, TABLE)
        column = strings(flat, borders).dictionary_encode()
        codes, n = column.indices.to_numpy().astype(np.int64), len(off) - 1
        self.size = np.diff(of_text)
        self.ends = of_text[1:] + np.arange(n)
        self.first = self.ends - self.size
        self.doc = np.repeat(np.arange(n), self.size)  # of each word
        self.words = np.arange(len(codes)) + self.doc  # the words' places among the tokens
        self.token_doc = np.repeat(np.arange(n), self.size + 1)
        known = word_hashes(column.dictionary)
        # words by class
        entry, self.entry = np.unique(codes * CLASSES + classes[self.doc], return_inverse=True)
        word, self.entry_class = entry // CLASSES, entry % CLASSES
        hot = pc.fill_null(pc.index_in(column.dictionary, value_set=names), -1).to_numpy(zero_copy_only=False) if len(names) else np.full(len(known), -1)
        self.hot = hot[word]
        asked = np.flatnonzero(self.hot < 0)
        self.asked = asked[np.lexsort((self.entry_class[asked], known[word[asked]]))]
        self.asked_hash, self.asked_class = known[word[self.asked]], self.entry_class[self.asked].astype(np.uint8)
        # contexts
        h = np.full(len(codes) + n, _END)
        h[self.words] = known[codes]
        one = _after(h, self.first, _BEGIN)
        pair = _mixed(one * _MIX + h)
        triple = _mixed(_after(one, self.first, _BEGIN) * _MIX + pair)
        self.pairs, self.pair = np.unique(pair >> np.uint64(16), return_inverse=True)
        self.triples, self.triple = np.unique(triple >> np.uint64(16), return_inverse=True)

    def mark(self) -> int:
        return _mark(self.pairs, self.triples, self.asked_hash)


def _mark(*keys: np.ndarray) -> int:
    """A number that tells whether questions and answers are about the same keys, also put together from parts."""
    return int(np.bitwise_xor.reduce([np.bitwise_xor.reduce(k) for k in keys]).view(np.int64))


def _cuts(keys: np.ndarray, groups: int) -> np.ndarray:
    """Borders of the groups in sorted keys of 48 bits."""
    return np.searchsorted((keys * np.uint64(groups)) >> np.uint64(48), np.arange(groups + 1))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys of 48 bits: how many keys have each value of the upper 16, and the lower 32."""
    if not len(keys):
        return b""
    high = (keys >> np.uint64(32)).astype(np.int64)
    n = np.bincount(high - high[0]).astype("<u4")
    small = n.max() < 1 << 16
    return np.array([high[0], len(n), small], "<u4").tobytes() + (n.astype("<u2") if small else n).tobytes() + (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    base, values, small = np.frombuffer(data, "<u4", 3)
    n = np.frombuffer(data, "<u2" if small else "<u4", values, 12)
    high = np.repeat(np.arange(values, dtype=np.uint64) + np.uint64(base), n)
    return high << np.uint64(32) | np.frombuffer(data, "<u4", offset=12 + n.nbytes).astype(np.uint64)


def _short(n: np.ndarray) -> bytes:
    """Counts, most of them in one byte: their number, a byte for each, and those that do not fit."""
    return np.array([len(n)], "<u4").tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u8").tobytes()


def _whole(data: bytes) -> np.ndarray:
    n = np.frombuffer(data, np.uint8, int(np.frombuffer(data, "<u4", 1)[0]), 4).astype(np.float64)
    n[n == 255] = np.frombuffer(data[4 + len(n) :], "<u8")
    return n


def gate(n: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then by half powers of two of its count."""
    return np.where(n > 0, 1 + np.minimum(2 * np.log2(np.maximum(n, 1)), GATES - 1).astype(np.int64), 0)


@dataclass
class Tokens:
    """Tokens of some texts with the counts of their contexts and what the spelling gives them (log10)."""

    c1: np.ndarray
    n1: np.ndarray
    c2: np.ndarray
    n2: np.ndarray
    spelled: np.ndarray

    def less_one(self) -> Tokens:
        return Tokens(self.c1 - 1, self.n1 - 1, self.c2 - 1, self.n2 - 1, self.spelled)

    def parts(self, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gates of both contexts, the weight of the spelling, and the weighted probabilities after one and after two words."""
        g1, g2 = gate(self.n1), gate(self.n2)
        a1, a2 = weights[0, g1], weights[1, g2]
        return g1, g2, (1 - a2) * (1 - a1), (1 - a2) * a1 * self.c1 / np.maximum(self.n1, 1), a2 * self.c2 / np.maximum(self.n2, 1)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token."""
        _, _, rest, p1, p2 = self.parts(weights)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(rest) + self.spelled * np.log(10), np.log(p1 + p2)) / np.log(10)

    def shares(self, weights: np.ndarray) -> np.ndarray:
        """For both contexts and each gate: how much of the tokens the context explains, and how much was open to it."""
        g1, g2, rest, p1, p2 = self.parts(weights)
        whole = np.maximum(rest * 10.0**self.spelled + p1 + p2, 1e-300)
        p1, p2 = p1 / whole, p2 / whole
        return np.stack([np.bincount(g, v, GATES + 1) for g, v in ((g1, p1), (g1, 1 - p2), (g2, p2), (g2, np.ones(len(g2))))])


def start_weights() -> np.ndarray:
    out = np.full((2, GATES + 1), SHARE)
    out[:, 0] = 0
    return out


def learn_weights(summed) -> np.ndarray:
    """Weights of the contexts of words before by gate. ``summed(weights)`` are the shares of all training tokens, each without its own occurrence."""
    weights = start_weights()
    for _ in range(PASSES):
        shares = summed(weights).reshape(2, 2, -1)
        weights = np.minimum((shares[:, 0] + HELD * start_weights()) / (shares[:, 1] + HELD), 0.999)
        weights[:, 0] = 0
    return weights


# ---------------------------------------------------------------- on Spark


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


_COUNTS = [f"n{i}" for i in range(CLASSES)]


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each chunk with their training counts by class, and a bit for each class they occur in."""
    for batch in batches:
        classes, train = batch.column("class").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
        for a, b, buf, off in chunks(batch.column("text"), 4 << 20):
            flat, borders, of_text = words(buf, off, TABLE)
            if len(borders) == 1:
                continue
            column = strings(flat, borders).dictionary_encode()
            codes, n = column.indices.to_numpy().astype(np.int64), len(column.dictionary)
            size = np.diff(of_text)
            cls, tr = np.repeat(classes[a:b], size), np.repeat(train[a:b], size)
            table = np.bincount((codes * CLASSES + cls)[tr], minlength=n * CLASSES).reshape(n, CLASSES)
            seen = np.zeros((n, CLASSES), bool)
            seen[codes, cls] = True
            mask = seen @ (1 << np.arange(CLASSES))
            yield pa.RecordBatch.from_arrays(
                [column.dictionary.cast(pa.string()), pa.array(mask.astype(np.int64)), *[pa.array(table[:, i].astype(np.int64)) for i in range(CLASSES)]],
                names=["word", "classes", *_COUNTS],
            )
        release()


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all slots from a part of the words, in blocks; empty blocks are left out."""
    counts = np.zeros(2 * SLOTS)
    for batch in batches:
        column = batch.column("word")
        table = np.stack([batch.column(c).to_numpy() for c in _COUNTS], 1)
        row, cls = np.nonzero(table)
        if not len(row):
            continue
        weight = table[row, cls].astype(np.float64)
        for a, b, s in _pieces(column.take(pa.array(row)), cls, 1 << 20):
            w = weight[a:b][s.word]
            for k in range(8):
                _, bit, slots = bit_slots(s, k)
                for i in range(len(CONTEXTS)):
                    np.add.at(counts, 2 * slots[i] + bit, w)
    for i in range(0, 2 * SLOTS, BLOCK):
        block = counts[i : i + BLOCK]
        if block.any():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([block.astype("<f4").tobytes()])], names=["first", "counts"])
    del counts
    release()


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, "<f4").astype(np.float64) for x in pdf["counts"]], axis=0)
    return pd.DataFrame({"first": [pdf["first"].iloc[0]], "counts": [total.astype("<f4").tobytes()]})


def _summing(add, size: int, shared):
    """What ``add`` sums up over a part of the words and classes of training texts; zeros are left out."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy() for c in _COUNTS], 1)
            row, cls = np.nonzero(table)
            if len(row):
                add(total, batch.column("word").take(pa.array(row)), cls, table[row, cls].astype(np.float64), *shared.value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "value"])

    return sums


def _summed(trained: DataFrame):
    """Sums over all training words: tasks send at most one row for each number that is summed up, and Spark adds those."""
    context = trained.sparkSession.sparkContext

    def summed(add, size: int, less: Less, weights: np.ndarray) -> np.ndarray:
        shared = context.broadcast((less, weights))
        parts = trained.select("word", *_COUNTS).mapInArrow(_summing(add, size, shared), "at bigint, value double")
        total = np.zeros(size)
        for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
            total[r["at"]] = r.value
        shared.destroy()
        return total

    return summed


def _score_words(model):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            mask = batch.column("classes").to_numpy()
            row, cls = np.nonzero((mask[:, None] >> np.arange(CLASSES)) & 1)
            out = np.full((batch.num_rows, CLASSES), np.nan)
            for a, b, s in _pieces(batch.column("word").take(pa.array(row)), cls):
                cost = np.zeros(len(s.data))
                for k in range(8):
                    cost += m.cost(*bit_slots(s, k))
                out[row[a:b], cls[a:b]] = -np.log10(2) * np.bincount(s.word, cost, b - a)
            flat = pa.array(out.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * CLASSES), flat)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), lists], names=["word", "c", "lp"])
            release()

    return score


@contextmanager
def _few_rows(spark) -> Iterator[None]:
    before = spark.conf.get(AT_ONCE)
    spark.conf.set(AT_ONCE, str(min(ROWS, int(before)) if int(before) > 0 else ROWS))
    try:
        yield
    finally:
        spark.conf.set(AT_ONCE, before)


def _chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The chunks of a partition with their numbers; the same each time the partition is read."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for a, b, buf, off in chunks(batch.column("text"), CHUNK):
            yield number, batch.slice(a, b - a), buf, off
            number += 1


_ASKED = "part long, chunk long, pairs binary, n_pairs binary, triples binary, n_triples binary, words binary, about binary"


def _questions(hot, groups: int):
    """What each chunk asks of each group: its pairs, triples and words, with its training counts and the words' classes."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(hot.value[0], pa.large_string())
        for number, batch, buf, off in _chunked(batches):
            c = Chunk(buf, off, batch.column("class").to_numpy(), names)
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.float64)[c.token_doc]
            rows = []
            for keys, of in ((c.pairs, c.pair), (c.triples, c.triple)):
                cuts, n = _cuts(keys, groups), np.bincount(of, train, len(keys))
                rows += [[_packed(keys[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], [_short(n[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]]
            cuts = _cuts(c.asked_hash >> np.uint64(16), groups)
            rows += [[v[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)] for v in (c.asked_hash, c.asked_class)]
            at = [p for p in range(groups) if rows[0][p] or rows[2][p] or rows[4][p]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array([number] * len(at), pa.int64()), *[pa.array([r[p] for p in at], pa.binary()) for r in rows]],
                names=["part", "chunk", "pairs", "n_pairs", "triples", "n_triples", "words", "about"],
            )
            release()

    return ask


def _word_table(groups: int):
    """The words' counts and spellings by class, dealt to the groups that are asked for them."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def dealt() -> pa.RecordBatch:
            h, c, lp = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, about = h[order], np.concatenate([c[order, None].astype("<f8").view("<f4"), lp[order]], axis=1)
            cuts = _cuts(h >> np.uint64(16), groups)
            at = np.flatnonzero(np.diff(cuts))
            blobs = [pa.array([v[cuts[p] : cuts[p + 1]].tobytes() for p in at], pa.binary()) for v in (h, about)]
            none = [pa.nulls(len(at), pa.binary())] * 4
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array([-1] * len(at), pa.int64()), *none, *blobs], names=["part", "chunk", "pairs", "n_pairs", "triples", "n_triples", "words", "about"])

        for batch in batches:
            lp = batch.column("lp").flatten().to_numpy(zero_copy_only=False).reshape(-1, CLASSES)
            held.append((word_hashes(batch.column("word")), batch.column("c").to_numpy(), lp.astype("<f4")))
            if sum(len(x[0]) for x in held) >= 1 << 18:
                yield dealt()
                held = []
        if held:
            yield dealt()

    return deal


_ANSWERS = "chunk long, part long, mark long, pairs binary, triples binary, c binary, lp binary"


def _answers(asked: pa.Table) -> pa.Table:
    """Counts of all pairs and triples that a group was asked for, and what its words are worth, for each chunk."""
    release()  # what the group before has used
    chunk = asked.column("chunk").to_numpy()
    rows, of_words = np.flatnonzero(chunk >= 0), np.flatnonzero(chunk < 0)

    def blobs(name: str, at: np.ndarray) -> list[bytes]:
        return asked.column(name).take(pa.array(at)).to_pylist()

    def counted(name: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        keys = [_unpacked(x) for x in blobs(name, rows)]
        n = [_whole(x) for x in blobs(f"n_{name}", rows)]
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate(n), len(distinct))[of]
        return keys, np.split(total, np.cumsum([len(k) for k in keys])[:-1])

    if not len(rows):
        return pa.table({"chunk": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), **{k: pa.array([], pa.binary()) for k in ("pairs", "triples", "c", "lp")}})
    (pairs, n_pairs), (triples, n_triples) = counted("pairs"), counted("triples")
    wanted = [np.frombuffer(x, np.uint64) for x in blobs("words", rows)]
    classes = [np.frombuffer(x, np.uint8) for x in blobs("about", rows)]
    h = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in blobs("words", of_words)]])
    about = np.concatenate([np.zeros((0, CLASSES + 2), "<f4"), *[np.frombuffer(x, "<f4").reshape(-1, CLASSES + 2) for x in blobs("about", of_words)]])
    order = np.argsort(h)
    h, about = h[order], about[order]
    c, lp = [], []
    for w, k in zip(wanted, classes, strict=True):
        at = np.searchsorted(h, w)
        if len(w) and (at.max() >= len(h) or (h[at] != w).any()):
            raise ValueError("a text has a word that the table of words has not: the texts changed while they were read")
        c.append(np.ascontiguousarray(about[at, :2]).view("<f8").ravel())
        lp.append(about[at, 2 + k.astype(np.int64)])
    marks = [_mark(*x) for x in zip(pairs, triples, wanted, strict=True)]
    return pa.table({
        "chunk": pa.array(chunk[rows]), "part": asked.column("part").take(pa.array(rows)), "mark": pa.array(marks, pa.int64()),
        **{k: pa.array([_short(x) for x in v], pa.binary()) for k, v in {"pairs": n_pairs, "triples": n_triples}.items()},
        **{k: pa.array([x.tobytes() for x in v], pa.binary()) for k, v in {"c": c, "lp": lp}.items()},
    })


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each chunk as one compressed value."""
    for number, batch, _, _ in _chunked(batches):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["chunk", "texts"])


_TOKENS = "doc_id long, train boolean, n_bytes long, n_words long, base double, known long, c1 array<float>, n1 array<float>, c2 array<float>, spelled array<float>"


def _answered(hot, n_train: int, p_end: float):
    """The texts of a chunk with what it was answered: one row a text, with lists over its tokens."""

    def answered(texts: pa.Table, answers: pa.Table) -> pa.Table:
        release()  # what the chunk before has used
        names, hot_c, hot_lp = hot.value
        if len(texts) != 1:
            raise ValueError("answers do not belong to one chunk: the texts changed while they were read")
        texts, answers = pa.ipc.open_stream(texts.column("texts")[0].as_buffer()).read_all(), answers.sort_by("part")
        buf, off = buffers(texts.column("text"))
        k = Chunk(buf, off, texts.column("class").to_numpy(), pa.array(names, pa.large_string()))
        pairs, triples = (np.concatenate([np.zeros(0), *[_whole(x) for x in answers.column(name).to_pylist()]]).astype(np.float32) for name in ("pairs", "triples"))
        c, lp = (np.frombuffer(b"".join(answers.column(name).to_pylist()), kind) for name, kind in (("c", "<f8"), ("lp", "<f4")))
        mark = int(np.bitwise_xor.reduce(answers.column("mark").to_numpy())) if len(answers) else 0
        if (len(pairs), len(triples), len(c), mark) != (len(k.pairs), len(k.triples), len(k.asked), k.mark()):
            raise ValueError("answers do not belong to these texts: the texts changed while they were read")
        is_hot = k.hot >= 0
        entry_c, entry_lp = np.zeros(len(k.hot)), np.zeros(len(k.hot))
        entry_c[k.asked], entry_lp[k.asked] = c, lp
        if is_hot.any():
            entry_c[is_hot], entry_lp[is_hot] = hot_c[k.hot[is_hot]], hot_lp[k.hot[is_hot], k.entry_class[is_hot]]
        n = len(texts)
        c0 = entry_c[k.entry]
        spelled, before = np.full(len(k.pair), np.log10(p_end), np.float32), np.zeros(len(k.pair), np.float32)
        spelled[k.words], before[k.words] = entry_lp[k.entry] + np.log10(1 - p_end), c0
        lists = pa.array(np.concatenate([[0], k.ends + 1]).astype(np.int32))
        tokens = [pa.ListArray.from_arrays(lists, pa.array(x)) for x in (pairs[k.pair], _after(before, k.first, n_train), triples[k.triple], spelled)]
        return pa.table({
            "doc_id": texts.column("doc_id"), "train": texts.column("train"), "n_bytes": pa.array(np.diff(off)), "n_words": pa.array(k.size.astype(np.int64)),
            "base": pa.array(np.bincount(k.doc, np.log10(c0 + 1), n)), "known": pa.array(np.bincount(k.doc, c0 > 0, n).astype(np.int64)),
            **dict(zip(("c1", "n1", "c2", "spelled"), tokens, strict=True)),
        })

    return answered


def _tokens(batches: Iterable[pa.RecordBatch], n_train: int, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, Tokens, np.ndarray]]:
    """Some texts at a time, their tokens and the text of each token."""
    for batch in batches:
        off, a = batch.column("c1").offsets.to_numpy().astype(np.int64), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
            part = batch.slice(a, b - a)
            c1, n1, c2, spelled = (part.column(x).flatten().to_numpy().astype(np.float64) for x in ("c1", "n1", "c2", "spelled"))
            yield part, Tokens(c1, n1, c2, _after(c1, off[a:b] - off[a], n_train), spelled), np.repeat(np.arange(b - a), np.diff(off[a : b + 1]))
            a = b
        release()


def _shares(weights: np.ndarray, n_train: int):
    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, GATES + 1))
        for _, tokens, _ in _tokens(batches, n_train):
            total += tokens.less_one().shares(weights)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "value"])
        release()

    return sums


def _score_tokens(weights: np.ndarray, n_train: int):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, doc in _tokens(batches, n_train):
            names = ["doc_id", "train", "n_bytes", "n_words", "base", "known"]
            lp = np.bincount(doc, tokens.score(weights), part.num_rows)
            yield pa.RecordBatch.from_arrays([*[part.column(x) for x in names], pa.array(lp)], names=[*names, "lp"])

    return score


def context_weights(tokens: DataFrame, n_train: int) -> np.ndarray:
    """Weights of the words before, learned from all training tokens; what comes to the driver is one number a gate."""

    def summed(weights: np.ndarray) -> np.ndarray:
        total = np.zeros(4 * (GATES + 1))
        shares = tokens.where("train").select("c1", "n1", "c2", "spelled").mapInArrow(_shares(weights, n_train), "at bigint, value double")
        for r in shares.groupBy("at").agg(F.sum("value").alias("value")).collect():
            total[r["at"]] = r.value
        return total

    return learn_weights(summed)


def scores(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``."""
    spark = docs.sparkSession
    # the most frequent languages have classes of their own, the rest shares the last one
    top = docs.groupBy("lang").count().where("lang IS NOT NULL").orderBy(F.desc("count"), "lang").limit(CLASSES - 1).collect()
    cls = F.lit(CLASSES - 1)
    for i, r in enumerate(top):
        cls = F.when(F.col("lang") == r.lang, i).otherwise(cls)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", cls.cast("long").alias("class"), (~held_out(F.col("doc_id"))).alias("train"))

    # words of all texts, with their training counts
    found = texts.select("text", "class", "train").mapInArrow(_count_words, "word string, classes bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    vocabulary = materialize(found.groupBy("word").agg(F.bit_or("classes").alias("classes"), *[F.sum(c).alias(c) for c in _COUNTS]).withColumn("c", F.expr(" + ".join(_COUNTS))))
    used = stored_paths()[-1:]
    trained = vocabulary.where("c > 0")
    n_words, n_distinct = trained.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train = texts.where("train").count()
    total, distinct = n_words + n_train, n_distinct + (n_train > 0)

    # counts of all slots, a fixed number, added up block by block
    blocks = trained.select("word", *_COUNTS).mapInArrow(_tables, "first bigint, counts binary").groupBy("first").applyInPandas(_add, "first bigint, counts binary")
    blocks = materialize(blocks)
    added = stored_paths()[-1:]
    counts = np.zeros(2 * SLOTS, np.float32)
    for r in blocks.toLocalIterator():
        counts[r.first : r.first + BLOCK] = np.frombuffer(r.counts, "<f4")
    drop_stored(spark, added)
    counts = counts.reshape(-1, 2)

    model = spark.sparkContext.broadcast(learned(counts, _summed(trained)))
    del counts
    scored = materialize(vocabulary.select("word", "classes", "c").mapInArrow(_score_words(model), "word string, c bigint, lp array<double>"))
    drop_stored(spark, used)
    used = stored_paths()[-1:]

    # the most frequent words go to every task: all words at least as frequent as the least that keeps them to HOT_WORDS
    steps = scored.where("c > 1").groupBy(F.expr("floor(log2(c) * 16)").alias("step")).count().orderBy(F.desc("step")).collect()
    held, limit = 0, None
    for r in steps:
        held += r["count"]
        if held > HOT_WORDS:
            break
        limit = r.step
    rows = scored.where(F.expr("floor(log2(c) * 16)") >= F.lit(limit)).collect() if limit is not None else []
    c = np.array([r.c for r in rows], np.float64)
    lp = np.array([r.lp for r in rows], np.float64).reshape(len(rows), CLASSES)
    hot = spark.sparkContext.broadcast(([r.word for r in rows], c, lp.astype(np.float32)))
    del rows

    p_end = (n_train + 0.5) / (total + 1)
    with _few_rows(spark):
        out = _scored_texts(texts, scored, used, hot, total, n_train, p_end)
    n_tokens = F.col("n_words") + 1
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), n_tokens.alias("n_tokens"), (F.col("known") + int(n_train > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(n_train + 1)) - n_tokens * float(np.log10(total + distinct + 1))).alias("base_score"),
        F.col("lp").alias("score"), "n_bytes",
    ).withColumn("bits_per_byte", -F.col("score") / float(np.log10(2)) / F.greatest("n_bytes", F.lit(1))).drop("n_bytes")


def _scored_texts(texts: DataFrame, scored: DataFrame, used: list[str], hot, total: int, n_train: int, p_end: float) -> DataFrame:
    """Texts with their log probability: pairs and triples are counted and words looked up by groups of hashes, and go back to the texts that asked."""
    spark = texts.sparkSession
    groups = min(max(8, total // GROUP), 1 << 15)
    asked = texts.select("class", "train", "text").mapInArrow(_questions(hot, groups), _ASKED)
    answers = materialize(asked.unionByName(scored.mapInArrow(_word_table(groups), _ASKED)).groupBy("part").applyInArrow(_answers, _ANSWERS))
    drop_stored(spark, used)
    used = stored_paths()[-1:]
    numbered = texts.mapInArrow(_texts, "chunk long, texts binary")
    tokens = materialize(numbered.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_answered(hot, n_train, p_end), _TOKENS))
    drop_stored(spark, used)
    used = stored_paths()[-1:]
    weights = context_weights(tokens, n_train)
    out = materialize(tokens.mapInArrow(_score_tokens(weights, n_train), "doc_id long, train boolean, n_bytes long, n_words long, base double, known long, lp double"))
    drop_stored(spark, used)
    hot.unpersist()
    return out
