"""Documents with every oddity that the operators define a result for."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 1013}x{i % 91}" for i in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog while nine other animals look on and say nothing at all about it today."
TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", "one two", "One TWO", "a b c", "a b c", "A b  c\n", "é É ß Œ œ × ÷ ñandú", "it's IT'S don't <|endoftext|> <|ENDOFTEXT|>x",
    "x1y22z333 %%% a&&b c--d 3.14", "é Å  nbsp em — “quoted”", "日本語 テキスト 🙂🙂 ok", "\x00\x1f\x7f ctrl", PROSE, PROSE, PROSE.upper(), PROSE + " " + PROSE,
    "\n".join([PROSE] * 6), PROSE.replace("nine", "ten"), "same " * 200, LONG, LONG, LONG.replace("w7x", "v7x"), "z" * 5000,
    "Released under the MIT License. MIT license, apache-license; the GNU General  Public\nLicense version 3", "line\nline\nline\n\n \nother\nother",
]
#: Names that operators use inside.
CLASHES = ["row", "fp", "uid", "id", "segment", "n_words", "words", "kept", "shard", "slot", "root", "size", "lang_", "_bucket", "_row", "_k0", "t", "block"]


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source): null ids, repeated rows, an id with two texts, null groups."""
    rows = [(i * 3, t, [None, "en", "fr"][i % 3], [None, "s0", "s0", "s1"][i % 4]) for i, t in enumerate(TEXTS)]
    return [*rows, rows[15], rows[15], (6, "another text with the same id", "en", "s0"), (None, PROSE, "en", "s0"), (None, None, None, None)]


def edge_docs(spark, clashes: bool = True):
    rows = edge_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(CLASHES)}).repartition(3) if clashes else df.repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
