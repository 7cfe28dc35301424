"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A store is a folder of Parquet files, written by Spark's committer, so that a lost executor leaves no half file and any
store that Spark writes to will do. Each row is a block of whole documents in order:

=========  ======================================================================================================
shard      number of the writing task; shards and the blocks in them follow the order of the documents
block      number of the block in its shard
doc_ids    ids of the block's documents
ids        their token ids one after the other, little-endian, ``width`` bytes each
low, high  Elias-Fano code of the documents' ends in ``ids``: ``low_bits`` low bits of each end, packed; and a bit vector
           with bit ``(end >> low_bits) + i`` set for document ``i``
samples    position in ``high`` of every ``SAMPLE``-th set bit (32 bits each), from which ``select`` starts
=========  ======================================================================================================

About ``2 + log2(ids / documents)`` bits a document take the place of a 64-bit offset table. Blocks close at
``BLOCK_IDS`` ids; a longer document has a block of its own.

Defined results: a null or empty text has its end id only; a null doc_id is kept and comes first; repeated rows are stored each; texts of any
length are encoded whole; an empty table gives an empty store and no rows. Only the id, the text and the columns of the order are read.

Tokens: white space is dropped by the tokenizer's pattern and nothing it matches reaches across it, so words are
encoded once each and looked up after that, see ``Encoder``.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.llm.order import with_totals_before
from heatloom.llm.text import SPACES, buffers, chunks

END_ID, BLOCK_IDS, SAMPLE = 2, 1 << 20, 64
#: Words that an encoder remembers; it starts afresh beyond.
REMEMBERED = 250_000

STORE = (
    "shard int, block int, doc_ids array<bigint>, n_docs int, n_ids bigint, width int, low_bits int, "
    "low binary, high binary, samples binary, ids binary"
)


# ---------------------------------------------------------------- Elias-Fano


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """The ``bits`` low bits of each value, one after the other."""
    if not bits:
        return b""
    each = (values[:, None] >> np.arange(bits)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if not bits:
        return np.zeros(n, np.int64)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return each.astype(np.int64) @ (np.int64(1) << np.arange(bits))


def ef_encode(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Code of an ascending sequence: number of low bits, low bits, high bits, select samples."""
    n = len(ends)
    top = int(ends[-1]) if n else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    at = (ends >> bits) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    high[at] = 1
    return bits, pack_bits(ends, bits), np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes()


def ef_decode(bits: int, low: bytes, high: bytes, n: int) -> np.ndarray:
    """The whole sequence."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little"))[:n]
    return ((at - np.arange(n)) << bits) | unpack_bits(low, bits, n)


def ef_select(bits: int, low: bytes, high: bytes, samples: bytes, i: int) -> int:
    """Member ``i`` of the sequence, from the sample before it and at most ``SAMPLE`` further set bits."""
    at = int(np.frombuffer(samples, "<u4")[i // SAMPLE])
    left, byte = i % SAMPLE, at // 8
    word = high[byte] >> (at % 8) << (at % 8)
    while (here := word.bit_count()) <= left:
        left -= here
        byte += 1
        word = high[byte]
    for _ in range(left):
        word &= word - 1
    at = 8 * byte + (word & -word).bit_length() - 1
    value = (at - i) << bits
    if bits:
        first = i * bits
        piece = int.from_bytes(low[first // 8 : (first + bits + 7) // 8], "little") >> (first % 8)
        value |= piece & ((1 << bits) - 1)
    return value


# ---------------------------------------------------------------- tokens


def _classes() -> np.ndarray:
    """Class of each byte: 0 white space, 1 letter (all of non-ASCII too), 2 digit, 3 other."""
    c = np.full(256, 3, np.uint8)
    c[list(SPACES)] = 0
    c[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
    c[128:] = 1
    c[list(b"0123456789")] = 2
    return c


CLASS = _classes()
#: Bytes that keep their word in one piece: contractions, special tokens, and all beyond Latin-1 letters.
ODD = np.zeros(256, bool)
ODD[[ord("'"), ord("<"), 0xC2, *range(0xC4, 0x100)]] = True
#: Lower-case ASCII and Latin-1 letters.
LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Signs by which byte-level models name the bytes that have no visible sign of their own.
BYTE_SIGNS = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 512), strict=False))


class Encoder:
    """Encodes texts with a tokenizer of the ``tokenizers`` library whose pattern splits words, digits and signs.

    Words of ASCII and Latin-1 letters, digits and signs are cut where the class changes, as the pattern cuts them, and
    lower-cased; any other word is one piece. Each distinct piece goes through the library once and is remembered.
    A piece of plain letters needs no normalizing and no pattern and goes to the library's model at once, if probes
    show that this tokenizer treats both alike.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.plain = self.tokenizer.model.tokenize
        probes = ["a", "the", "straße", "éàçñüöä", "ÿþðæ", "ingtionble", "qxzvkj" * 9]
        self.direct = all(self.model_ids(x) == self.tokenizer.encode(x, add_special_tokens=False).ids for x in probes)
        self.forget()

    def model_ids(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(BYTE_SIGNS)
        return [t.id for t in self.plain(piece)]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.store = np.zeros(1 << 16, np.uint32)
        self.borders = np.zeros(1 << 16, np.int64)

    def learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
        plain = [self.direct and LETTERS(x) is not None for x in new]
        rest = iter(self.tokenizer.encode_batch_fast([x for x, p in zip(new, plain, strict=True) if not p], add_special_tokens=False))
        ids = [self.model_ids(x) if p else next(rest).ids for x, p in zip(new, plain, strict=True)]
        n, m = len(self.known), int(self.borders[len(self.known)])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        while n + len(new) + 1 > len(self.borders):
            self.borders = np.concatenate([self.borders, np.zeros_like(self.borders)])
        while m + total > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[m : m + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.borders[n + 1 : n + len(new) + 1] = m + np.cumsum(lengths)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Place of each piece among the remembered ones."""
        if len(self.known) > REMEMBERED // 2 and len(self.known) + len(pieces) > REMEMBERED:
            self.forget()
        get = self.known.get
        if new := [x for x in pieces if get(x) is None]:
            self.learn(new)
            get = self.known.get
            if lost := [x for x in pieces if get(x) is None]:  # forgotten while learning
                self.learn(lost)
                get = self.known.get
        return np.fromiter(map(get, pieces), np.int64, len(pieces))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids."""
        data, borders, of_text = pieces(buf, off)
        if len(borders) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        column = pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), pa.py_buffer(data)).dictionary_encode()
        number = self.numbers(column.dictionary.to_pylist())[column.indices.to_numpy()]
        first, n = self.borders[number], self.borders[number + 1] - self.borders[number]
        ends = np.cumsum(n)
        ids = self.store[np.arange(ends[-1]) + np.repeat(first - (ends - n), n)]
        return ids, np.diff(np.concatenate([[0], ends])[of_text])


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces, borders between the pieces, and borders between the texts in pieces."""
    kind = CLASS[buf]
    inside = kind != 0
    word = inside.copy()  # first byte of a word
    word[1:] &= ~inside[:-1]
    begin = inside.copy()  # first byte of a piece
    begin[1:] &= kind[1:] != kind[:-1]
    at = off[1:-1]
    at = at[at < len(buf)]
    word[at] = begin[at] = inside[at]
    low = np.frombuffer(buf.tobytes().translate(_LOWER), np.uint8).copy()
    odd = ODD[buf]
    lead = np.flatnonzero(buf == 0xC3)
    if len(lead):
        lead = lead[lead + 1 < len(buf)]
        second = buf[lead + 1]
        signs = (second == 0x97) | (second == 0xB7)
        odd[lead[signs]] = True
        capital = lead[(second >= 0x80) & (second <= 0x9E) & ~signs] + 1
        low[capital] += 0x20
    strange = np.flatnonzero(odd)
    if len(strange):
        starts = np.flatnonzero(word)
        whole = np.zeros(len(starts), bool)
        whole[np.searchsorted(starts, strange, "right") - 1] = True
        cut = np.flatnonzero(begin)
        inner = whole[np.searchsorted(starts, cut, "right") - 1] & ~word[cut]
        begin[cut[inner]] = False
        ends = np.append(starts[1:], len(buf))[whole]
        spans = np.zeros(len(buf) + 1, np.int8)
        spans[starts[whole]] += 1
        np.add.at(spans, ends, -1)
        as_is = np.cumsum(spans[:-1], dtype=np.int8).astype(bool)
        low[as_is] = buf[as_is]
    starts = np.flatnonzero(begin)
    place = np.cumsum(inside, dtype=np.int64)
    borders = np.append(place[starts] - 1, place[-1] if len(place) else 0).astype(np.int64)
    return low[inside], borders, np.searchsorted(starts, off)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- store


def _block(shard: int, block: int, docs: list, ids: list[np.ndarray], lengths: list[int], width: int) -> dict:
    joined = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    ends = np.cumsum(np.array(lengths, np.int64))
    bits, low, high, samples = ef_encode(ends)
    return {
        "shard": shard, "block": block, "doc_ids": docs, "n_docs": len(docs), "n_ids": len(joined), "width": width, "low_bits": bits,
        "low": low, "high": high, "samples": samples, "ids": joined.astype("<u2" if width == 2 else "<u4").tobytes(),
    }


def _writer(tokenizer: str, end_id: int, block_ids: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(STORE))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        docs: list = []
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        held = 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for a, b, buf, off in chunks(batch.column("text")):
                flat, n = enc.encode(buf, off)
                ends = np.cumsum(n)
                with_end = np.insert(flat, ends, end_id)
                n = n + 1
                ends = np.cumsum(n)
                i = 0
                while i < b - a:
                    start = int(ends[i] - n[i])
                    j = max(i + 1, int(np.searchsorted(ends, start + block_ids - held, "right")))
                    if held and ends[i] - start + held > block_ids:
                        yield pa.RecordBatch.from_pylist([_block(shard, block, docs, ids, lengths, width)], schema)
                        block, docs, ids, lengths, held = block + 1, [], [], [], 0
                        continue
                    docs += names[a + i : a + j]
                    ids.append(with_end[start : ends[j - 1]])
                    lengths += n[i:j].tolist()
                    held += int(ends[j - 1]) - start
                    i = j
        if docs:
            yield pa.RecordBatch.from_pylist([_block(shard, block, docs, ids, lengths, width)], schema)

    return write


def write_store(docs: DataFrame, path: str, tokenizer: str, order: list[str] | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every text of ``docs`` (``doc_id``, ``text``, null text: empty) and writes the store to ``path``.

    Documents stand in ascending order of the columns ``order``, by default ``doc_id`` (nulls first; rows with the same id by
    a hash of their text, so that the order does not depend on the layout). Other columns are not read.
    """
    keys = [F.col(c) for c in order or ["doc_id"]] + [F.xxhash64("text")]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")
    rows.mapInArrow(_writer(tokenizer, end_id, block_ids), STORE).write.parquet(path)


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every document of every block, whose end the select structure of the block gives."""
    for batch in batches:
        for r in batch.to_pylist():
            ends = np.array([ef_select(r["low_bits"], r["low"], r["high"], r["samples"], i) for i in range(r["n_docs"])], np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            ids = np.frombuffer(r["ids"], "<u2" if r["width"] == 2 else "<u4").astype("<u4")
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = r["n_docs"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                    pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64()),
                ],
                names=["shard", "block", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the store: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, shard, block."""
    store = spark.read.schema(STORE).parquet(path)
    blocks = store.groupBy("shard", "block").agg(F.sum("n_ids").alias("n_ids"))
    shards = with_totals_before(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")), [], "shard", "n", "_shard").drop("n")
    bases = with_totals_before(blocks, ["shard"], "block", "n_ids", "_block").drop("n_ids").join(shards, "shard")
    docs = store.mapInArrow(_documents, "shard int, block int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(bases, ["shard", "block"]).select(
        "doc_id", (F.col("_shard") + F.col("_block") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "block"
    )


__all__ = ["BLOCK_IDS", "END_ID", "STORE", "Encoder", "buffers", "ef_decode", "ef_encode", "ef_select", "pieces", "read_documents", "write_store"]
