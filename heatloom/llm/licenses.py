"""License scans by diagonal voting.

Templates (short phrases and license notices) are cut into word k-grams. All rolling k-grams of every text are joined by Spark
to the positions of equal k-grams in the templates; each pair votes for a diagonal, its position in the text less that
in the template. Votes are counted per text, template and diagonal; neighbouring diagonals, as a few inserted or missing words
make them, are merged to spans; a span is verified by the share of the template's k-grams that it holds in order, and
where spans of several templates overlap, the best one stays. A phrase has to be whole: all its k-grams on one diagonal.

A k-gram's hash packs the numbers of its words in the templates' vocabulary, so that equal hashes mean equal words. Text words
outside the vocabulary have no number, and k-grams with such a word are equal to none and end in the task that reads
them. The template table has one row for each template word; Spark broadcasts it if it is small and shuffles otherwise.

Words are runs of ASCII letters and digits and of all non-ASCII characters, after A-Z became lower case.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated rows are each
reported, an empty table gives an empty table; texts of any length are read whole. Other columns than ``doc_id`` and ``text`` are not
read, so they can have any name; a null doc_id is reported like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatloom.functions.tables import materialize
from heatloom.llm.text import NOT_ALNUM, chunks, lowered_table, strings, words

# Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Notices of common licenses, and their labels.
NOTICES = [
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        "apache",
    ),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "gpl",
    ),
    ("licensed under the GNU General Public License, version 3", "gpl-3.0"),
    (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation",
        "lgpl",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at",
        "mpl-2.0",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software",
        "unlicense",
    ),
    ("licensed under CC BY 4.0", "cc-by"),
    ("licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "cc-by-nc"),
]

#: Words of a k-gram of a phrase, of a notice; bits of a word's number.
PHRASE_GRAM, NOTICE_GRAM, WORD_BITS = 2, 4, 15
#: Share of a template's k-grams that a span must hold; steps between diagonals that may be merged; words between merged votes.
COVER, STEP, GAP = 0.7, 4, 12
TABLE = lowered_table(NOT_ALNUM)


def split_words(text: str) -> list[str]:
    flat, borders, _ = words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), TABLE)
    return strings(flat, borders).to_pylist()


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    out = sorted({w for t, _ in templates for w in split_words(t)})
    if len(out) >= 1 << WORD_BITS:
        raise ValueError("more template words than WORD_BITS can number")
    return out


def grams(numbers: np.ndarray, k: int) -> np.ndarray:
    """Packed k-grams starting at each word, -1 where a word has no number."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, known = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        out = (out << WORD_BITS) | numbers[j : j + n]
        known &= numbers[j : j + n] >= 0
    out[~known] = -1
    return out


def template_table(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """A row for each k-gram of each template: size of its grams, hash, template, its position, number of grams, label."""
    rows = []
    for kind, (k, templates) in enumerate([(PHRASE_GRAM, phrases), (NOTICE_GRAM, notices)]):
        number = {w: i for i, w in enumerate(vocabulary(templates))}
        for i, (text, label) in enumerate(templates):
            g = grams(np.array([number[w] for w in split_words(text)], np.int64), k)
            rows += [(k, int(h), 2 * i + kind, p, len(g), label, kind == 0) for p, h in enumerate(g.tolist())]
    return spark.createDataFrame(rows, "k int, hash bigint, template int, at int, n_grams int, label string, base boolean")


def _scanner(vocabularies: list[tuple[int, list[str]]]):
    """Per document its number of words and the k-grams made of template words only."""
    kinds = [(k, pa.array(v, pa.large_string())) for k, v in vocabularies]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, buf, off in chunks(batch.column("text")):
                flat, borders, of_text = words(buf, off, TABLE)
                n = len(borders) - 1
                column = strings(flat, borders).dictionary_encode()
                codes = column.indices.to_numpy()
                at, hashes, sizes = [], [], []
                for k, known in kinds:
                    number = pc.fill_null(pc.index_in(column.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    g = grams(number[codes] if n else np.zeros(0, np.int64), k)
                    here = np.flatnonzero(g >= 0)
                    # not across the end of a text
                    here = here[here + k <= of_text[np.searchsorted(of_text, here, "right")]] if len(here) else here
                    at.append(here)
                    hashes.append(g[here])
                    sizes.append(np.full(len(here), k, np.int32))
                at_, hash_, size_ = np.concatenate(at), np.concatenate(hashes), np.concatenate(sizes)
                order = np.argsort(at_, kind="stable")
                at_, hash_, size_ = at_[order], hash_[order], size_[order]
                cuts = np.searchsorted(at_, of_text)
                first = np.repeat(of_text[:-1], np.diff(cuts))
                found = pa.StructArray.from_arrays(
                    [pa.array(size_), pa.array(hash_), pa.array((at_ - first).astype(np.int64))], names=["k", "hash", "pos"]
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(np.diff(of_text).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), found)],
                    names=["doc_id", "n_words", "grams"],
                )

    return scan


def scanned(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Stored table: ``uid`` (row number), ``doc_id``, ``n_words``, ``grams``."""
    scan = _scanner([(PHRASE_GRAM, vocabulary(phrases)), (NOTICE_GRAM, vocabulary(notices))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(scan, "doc_id bigint, n_words bigint, grams array<struct<k int, hash bigint, pos bigint>>")
    return materialize(found.withColumn("uid", F.monotonically_increasing_id()))


def diagonals(scan: DataFrame, templates: DataFrame) -> DataFrame:
    """Votes by text, template and diagonal: their number, first and last position."""
    votes = scan.where(F.size("grams") > 0).select("uid", F.explode("grams").alias("g")).select("uid", "g.*")
    # a null key would match nothing either way; the templates are one row for each of their words
    pairs = votes.join(templates, ["k", "hash"])
    return pairs.groupBy("uid", "template", "base", "label", "n_grams", "k", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )


def spans(votes: DataFrame, cover: float = COVER, step: int = STEP, gap: int = GAP) -> DataFrame:
    """Verified spans: text, template, label, whether a phrase, first word, last word, share of the template's k-grams."""
    phrase = votes.where("base AND votes = n_grams").select("uid", "template", "label", "base", "first", (F.col("last") + F.col("k") - 1).alias("last"), F.lit(1.0).alias("score"))
    order = Window.partitionBy("uid", "template").orderBy("first", "diagonal")
    chained = (F.col("first") - F.lag("last").over(order) <= gap) & (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= step)
    runs = votes.where("NOT base").withColumn("new", F.when(chained, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("uid", "template", "label", "base", "n_grams", "k", "run").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    score = F.least(F.lit(1.0), F.col("votes") / F.greatest("n_grams", F.col("last") - F.col("first") + 1))
    held = merged.withColumn("score", score).where(F.col("score") >= cover).withColumn("last", F.col("last") + F.col("k") - 1)
    by_place = Window.partitionBy("uid").orderBy("first", "last", "template")
    reach = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    placed = held.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("place", F.sum("new").over(by_place))
    best = F.max("votes").over(Window.partitionBy("uid", "place"))
    notice = placed.withColumn("best", best).where("votes = best").select("uid", "template", "label", "base", "first", "last", "score")
    return phrase.unionByName(notice)


def license_report(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document: words, places of phrases, labels of phrases, of all spans, best score, number of spans."""
    scan = scanned(docs, phrases, notices)
    found = spans(diagonals(scan, template_table(docs.sparkSession, phrases, notices)))
    labels = lambda only: F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("label")))), ",")
    base = F.col("base")
    each = found.groupBy("uid").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.lit(True)).alias("labels"),
        F.max("score").alias("score"),
        F.count("*").alias("n_spans"),
    )
    joined = scan.select("uid", "doc_id", "n_words").join(each, "uid", "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
