"""Spelling variants by PartEnum signatures: words one edit apart, grouped under their most frequent form.

1. Runs of letters are counted text by text in tasks and added up by Spark; words of at least ``LENGTH`` code points with at least
   ``LEAST`` occurrences stay (the vocabulary).
2. The letters of a word with repeats are a set of (letter, number of the occurrence), so a binary vector. A replaced letter makes two
   vectors differ in two places, an inserted or deleted one in one place. The places are dealt to parts by a hash. Of four parts two
   differences leave two alike, of three parts one difference leaves two alike: each choice of two parts is enumerated, and
   what a word has in them is a signature. Pairs one edit apart share at least one, whatever the words (exact).
3. Syllables in another order have the same letters, so buckets by letters alone would be large. One edit also leaves the first or
   the last half of a word as it is; that half and the length belong to the signature, and each word gives one set of signatures for each half.
4. Signatures are joined by equality; each pair is verified by edit distance inside the join, so only near pairs leave it.
5. Forms are followed by pointer doubling. A form has twice the occurrences of its word, so chains end after log2(n) steps.

Defined results: a null text has no words; a null doc_id is written as the empty string in ``<doc_id>:<word>``; repeated rows count
each; of near words with equal n the smallest in code-point order is the form; very long words are compared like others; an
empty table, or one without such words, gives an empty table. Only ``doc_id`` and ``text`` are read, so other columns can have any name. 64-bit
hashes stand for signatures only to find candidates.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from heatloom.functions.tables import materialize
from heatloom.llm.text import chunks, lowered_table, strings, words

LENGTH, LEAST, DAMAGED = 5, 3, 97
#: Parts that the places of a vector are dealt to: for two differences, for one; two of them are in a signature.
PARTS_OF_TWO, PARTS_OF_ONE = 4, 3
_TABLE = lowered_table(b" ")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def letters_only(buf: np.ndarray) -> np.ndarray:
    """The bytes with a space in place of all that is not A-Z, a-z or U+00C0 to U+00FF (bytes C3 80 to C3 BF)."""
    lead = buf == 0xC3
    inside = _LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    return np.where(inside, buf, np.uint8(32))


def damaged(word: str, h: int) -> str:
    """The word without the code point that ``h`` selects."""
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their occurrences in a run of texts; each text damages some of its words."""
    for batch in batches:
        ids = ["" if x is None else str(x) for x in batch.column("doc_id").to_pylist()]
        for a, b, buf, off in chunks(batch.column("text")):
            data, borders, per_text = words(letters_only(buf), off, _TABLE)
            seen = strings(data, borders).dictionary_encode()
            long_enough = pc.utf8_length(seen.dictionary).to_numpy() >= LENGTH
            code = seen.indices.to_numpy()
            text = np.repeat(np.arange(b - a), np.diff(per_text))
            keep = long_enough[code]
            size = max(1, len(seen.dictionary))
            pair, n = np.unique(text[keep] * size + code[keep], return_counts=True)
            who, code = pair // size, pair % size
            spelled = [s.as_buffer().to_pybytes() for s in seen.dictionary]
            start = [zlib.crc32(f"{x}:".encode()) for x in ids[a:b]]
            h = np.array([zlib.crc32(spelled[c], start[t]) for t, c in zip(who.tolist(), code.tolist(), strict=True)], np.int64)
            hit = h % DAMAGED == 0
            total = np.bincount(code[~hit], n[~hit], size).astype(np.int64)
            there = np.flatnonzero(total)
            changed = [damaged(spelled[c].decode(), k) for c, k in zip(code[hit].tolist(), h[hit].tolist(), strict=True)]
            longer = np.array([len(w) >= LENGTH for w in changed], bool)
            plain = seen.dictionary.take(pa.array(there)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([plain, pa.array(changed, pa.string()).filter(pa.array(longer))]), pa.array(np.concatenate([total[there], n[hit][longer]]))], names=["word", "n"]
            )


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts, for those with at least ``least``."""
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_count, "word string, n bigint")
    return materialize(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signature_keys(column: pa.Array) -> np.ndarray:
    """The signatures of each word, one row a word; even ones are shared with words of the same length, odd ones with one letter more or less."""
    n = len(column)
    length = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    cp = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(n), length)
    first = np.cumsum(length) - length
    at = np.arange(len(cp)) - first[word]

    # the vector: sums of hashes of (letter, occurrence) in each part
    order = np.lexsort((cp, word))
    w, c = word[order], cp[order]
    new = np.ones(len(c), bool)
    new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
    begin = np.flatnonzero(new)
    occurrence = np.arange(len(c)) - np.repeat(begin, np.diff(np.append(begin, len(c))))
    place = _mix((c << np.uint64(32)) + occurrence.astype(np.uint64) + np.uint64(1))

    def parts(k: int, shift: int) -> np.ndarray:
        out = np.zeros(n * k, np.uint64)
        np.add.at(out, w * k + ((place >> np.uint64(shift)) % np.uint64(k)).astype(np.int64), _mix(place + np.uint64(shift)))
        return out.reshape(n, k)

    # the halves: sums of hashes of (letter, distance from that end)
    ahead = _mix((cp << np.uint64(32)) + at.astype(np.uint64) + np.uint64(1 << 60))
    behind = _mix((cp << np.uint64(32)) + (length[word] - 1 - at).astype(np.uint64) + np.uint64(3 << 60))

    def part_of(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        np.add.at(out, word[chosen], values[chosen])
        return out

    half, less = length // 2, (length - 1) // 2
    front, back = part_of(ahead, at < half[word]), part_of(behind, at >= half[word])
    long_front, long_back = part_of(ahead, at < less[word]), part_of(behind, at > less[word])
    keys = []

    def add(sides: tuple[np.ndarray, np.ndarray], shorter: np.ndarray, vector: np.ndarray, odd: int) -> None:
        for side in sides:
            for number, (i, j) in enumerate(combinations(range(vector.shape[1]), 2)):
                k = _mix(side + _mix(vector[:, i] * np.uint64(3) + vector[:, j] * np.uint64(5) + shorter.astype(np.uint64) * np.uint64(64) + np.uint64(number)))
                keys.append((k & ~np.uint64(1)) | np.uint64(odd))

    two, one = parts(PARTS_OF_TWO, 7), parts(PARTS_OF_ONE, 19)
    add((front, back), length, two, 0)
    add((front, back), length, one, 1)
    add((long_front, long_back), length - 1, one, 1)
    return np.stack(keys, 1) if n else np.zeros((0, 24), np.uint64)


@arrow_udf(ArrayType(LongType()))
def signatures(word: pa.Array) -> pa.Array:
    keys = signature_keys(word)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(word) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel()))


def near_pairs(vocab: DataFrame) -> DataFrame:
    """Pairs of words one inserted, deleted or replaced code point apart: ``a``, ``n_a``, ``b``, ``n_b``, each pair once."""
    keys = vocab.select("word", "n", F.explode(signatures("word")).alias("key")).withColumn("size", F.char_length("word"))
    shared = keys.groupBy("key").agg(F.min("word").alias("least"), F.max("word").alias("most")).where("least < most").select("key")
    keys = materialize(keys.join(shared, "key", "left_semi"))
    a = keys.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("size").alias("size_a"))
    b = keys.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"))
    ordered = "CASE WHEN key & 1 = 0 THEN a < b ELSE size_a < size_b END"
    pairs = a.join(b, "key").where(ordered).where("levenshtein(a, b, 1) = 1")
    return materialize(pairs.select("a", "n_a", "b", "n_b").distinct())


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and the last word that its forms lead to, from ``word`` and ``form``."""
    now = materialize(forms.select("word", F.col("form").alias("to")))
    while True:
        step = now.select(F.col("word").alias("to"), F.col("to").alias("further"))
        further = materialize(now.join(step, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        now = further.select("word", "to")
        if further.where("moved").isEmpty():
            return now.withColumnRenamed("to", "root")


def grouped(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per word of the vocabulary: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``."""
    vocab = vocabulary(docs, least)
    pairs = near_pairs(vocab)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    near = vocab.join(best, "word", "left").withColumn("more", -F.col("best.less") >= 2 * F.col("n"))
    near = materialize(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("more"), F.col("best.other")).alias("form"), F.when(F.col("more"), -F.col("best.less")).alias("form_n"),
        )
    )
    root = roots(near.where("form IS NOT NULL"))
    return near.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_report(docs: DataFrame) -> DataFrame:
    """The rows of the query: words with their form and root."""
    return grouped(docs).select("word", "form", "root", "n", "n_near", "form_n")
