"""Quality rules with thresholds from quantile sketches of each language and source; DataFrame functions only.

Every text is measured once. For each language and source the measures go into a mergeable sketch: counts of buckets
whose borders grow by a fixed ratio, so that a quantile is right within that ratio, and sketches of sources add up to that of
their language and of the corpus. A measure fails if it lies beyond Tukey's far fence, ``FENCE`` interquartile ranges from
the nearer quartile of its own group, and beyond a least distance (``SLACK``, ``SPREAD``) that keeps ordinary variation in
groups without any spread. A group of fewer than ``LEAST_ROWS`` documents uses the sketch of its language, then of all.

Defined results: a null text counts as empty, which has no words and fails; a null language or source is a group
like any other (the one named ''); repeated rows are measured and counted as often as they occur; texts of any length
are measured whole; an empty table gives an empty table. Only ``text``, ``lang`` and ``source`` are read; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions.tables import materialize

#: Ratio between bucket borders, quartile distance of the far fence, rows below which a wider group counts.
RATIO, FENCE, LEAST_ROWS = 1.02, 3.0, 100
#: Thousandths that a share must pass besides the fence: symbols and capitals among characters, repeated lines, repeated words.
SLACK = {"symbols": 25, "capitals": 300, "dup_lines": 400, "repeats": 300}
#: Mean characters of a word (in hundredths) must also be this many times off the median.
SPREAD = 1.5
MEASURES = [*SLACK, "word_length"]
SPACE = r"[\\x20\\x09-\\x0D]+"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words(words: str, window: int = 8) -> str:
    """SQL: how many words lie in a window of ``window`` words that occurs twice or more in the array ``words``.

    Windows are hashed; where all hashes differ nothing is repeated. Else (hash, position) is sorted, positions whose
    neighbour has the same hash are kept, and the words that their windows cover are added up in order.
    """
    hashes = f"transform(sequence(1, size({words}) - {window - 1}), i -> xxhash64(slice({words}, i, {window})))"
    alike = "(get(s, j - 1).h = p.h OR get(s, j + 1).h = p.h)"
    at = f"sort_array(transform(filter(s, (p, j) -> coalesce({alike}, false)), p -> p.i))"
    covered = f"aggregate(q, named_struct('n', 0, 'e', 0), (a, i) -> named_struct('n', a.n + i + {window} - greatest(a.e, i), 'e', i + {window}), a -> a.n)"
    sorted_ = "sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))"
    slow = _let(sorted_, "s", _let(at, "q", covered))
    test = f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {slow} END"
    return f"CASE WHEN size({words}) < {window} THEN 0 ELSE {_let(hashes, 'h', test)} END"


def base_measures(text: str) -> dict[str, Column]:
    """Columns of the basic counts of the text column ``text``, by stages: each dict uses the one before."""
    t = f"coalesce({text}, '')"
    return {
        "words": F.expr(f"filter(split({t}, '{SPACE}'), w -> w <> '')"),
        "lines": F.expr(f"filter(split({t}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
        "n_chars": F.expr(f"char_length({t})"),
        "n_symbols": F.expr(f"regexp_count({t}, '[#*$%&|<>]')").cast("long"),
        "n_capitals": F.expr(f"regexp_count({t}, '[A-Z]')").cast("long"),
    }


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, or all), the group (``lang``, ``source``), counts, measures and ``base_failed``."""
    m = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        *[c.alias(n) for n, c in base_measures("text").items()],
    )
    m = m.select(
        "row", "lang", "source", "n_symbols", "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.expr("char_length(array_join(words, ''))").cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("size(lines) - size(array_distinct(lines))").cast("long").alias("n_dup_lines"),
        F.expr(repeated_words("words")).cast("long").alias("n_repeat_words"),
    )
    share = lambda part, of, by=1000: F.expr(f"CASE WHEN {of} = 0 THEN 0 ELSE {by} * {part} div {of} END")
    return m.select(
        "*",
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_capitals", "word_chars").alias("capitals"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("word_chars", "n_words", 100).alias("word_length"),
        F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words").alias("base_failed"),
    )


def sketches(m: DataFrame) -> DataFrame:
    """Sketch of every measure: rows by level (0 language and source, 1 language, 2 all), group, measure and bucket."""
    pairs = F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).cast("long").alias("v")) for x in MEASURES])
    bucket = F.expr(f"CASE WHEN p.v <= 0 THEN 0 ELSE 1 + cast(ceil(ln(p.v) / ln({RATIO}D)) as bigint) END")
    fine = (
        m.where("n_words > 0")
        .select("lang", "source", F.explode(pairs).alias("p"))
        .groupBy("lang", "source", F.col("p.measure").alias("measure"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    levels = F.expr("array(struct(0 AS level, lang AS l, source AS s), struct(1 AS level, lang AS l, '' AS s), struct(2 AS level, '' AS l, '' AS s))")
    merged = fine.select("measure", "bucket", "n", F.explode(levels).alias("g"))
    return merged.groupBy("g.level", F.col("g.l").alias("lang"), F.col("g.s").alias("source"), "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Per level and group: ``n`` documents, and for each measure ``lo_`` and ``hi_``, beyond which a document fails."""
    group = Window.partitionBy("level", "lang", "source", "measure")
    run = sketch.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("all"))
    value = F.expr(f"CASE WHEN bucket = 0 THEN 0D ELSE pow({RATIO}D, bucket - 1) END")
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("all")), value))
    quartiles = run.groupBy("level", "lang", "source", "measure").agg(
        F.first("all").alias("n"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3")
    )
    cols = []
    for x in MEASURES:
        far = F.expr(f"q3 + {FENCE}D * (q3 - q1)"), F.expr(f"q1 - {FENCE}D * (q3 - q1)")
        hi = F.greatest(far[0], F.lit(float(SLACK[x]))) if x in SLACK else F.greatest(far[0], F.expr(f"q2 * {SPREAD}D"))
        lo = F.lit(-1.0) if x in SLACK else F.least(far[1], F.expr(f"q2 / {SPREAD}D"))
        mine = F.col("measure") == x
        cols += [F.max(F.when(mine, hi)).alias(f"hi_{x}"), F.max(F.when(mine, lo)).alias(f"lo_{x}")]
    return quartiles.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *cols)


def group_thresholds(m: DataFrame) -> DataFrame:
    """One row per language and source: the thresholds of the narrowest level with ``LEAST_ROWS`` documents."""
    t = thresholds(sketches(m))
    names = [c for c in t.columns if c[:3] in ("hi_", "lo_")]
    level = {i: t.where(F.col("level") == i).select("lang", "source", "n", F.struct(*names).alias("t")) for i in range(3)}
    joined = (
        level[0].alias("a").join(level[1].alias("b"), F.col("a.lang") == F.col("b.lang")).crossJoin(F.broadcast(level[2].alias("c")))  # one row
    )
    best = F.expr(f"CASE WHEN a.n >= {LEAST_ROWS} THEN a.t WHEN b.n >= {LEAST_ROWS} THEN b.t ELSE c.t END")
    return joined.select("a.lang", "a.source", best.alias("t"))


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All of ``measured`` plus ``kept`` and ``failed`` (names of the measures beyond their thresholds, comma-joined).

    The measures are stored, so that texts are read once. So are the thresholds: their size is then known when the join is
    planned, and rows are shuffled only if there are too many groups to broadcast.
    """
    m = materialize(measured(docs, keep))
    t = materialize(group_thresholds(m))
    beyond = [F.when((F.col(x) > F.col(f"t.hi_{x}")) | (F.col(x) < F.col(f"t.lo_{x}")), F.lit(x)) for x in MEASURES]
    out = m.join(t, ["lang", "source"], "left").withColumn("failed", F.concat_ws(",", *beyond)).drop("t")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(docs).where("kept").select("row.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: basic counts, verdicts and the measures that failed."""
    return judged(docs, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )
