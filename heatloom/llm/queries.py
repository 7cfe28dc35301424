"""The queries ``opN_<name>``: thin calls of the operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heatloom.functions.tables import new_path
from heatloom.llm import context_mixing, decontamination, html_text, lexical_search, licenses, mixing, quality, quality_model, sharding, simhash, suffixes, token_store, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql is not None:
            ORACLES[name] = sql
        return make

    return register


QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT id, i, array_to_string(words[i:i + 7], ' ') AS s FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS c FROM win) WHERE c > 1) GROUP BY id),
c AS (SELECT w.id, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON w.id = rep.id),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        CASE WHEN word_chars = 0 THEN 0 ELSE 1000 * n_symbols // word_chars END AS symbols,
        CASE WHEN word_chars = 0 THEN 0 ELSE 1000 * n_capitals // word_chars END AS capitals,
        CASE WHEN n_lines = 0 THEN 0 ELSE 1000 * n_dup_lines // n_lines END AS dup_lines,
        CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_repeat_words // n_words END AS repeats,
        CASE WHEN n_words = 0 THEN 0 ELSE 100 * word_chars // n_words END AS word_length FROM c),
p AS (SELECT id, lang, source, unnest([{", ".join(f"{{'measure': '{x}', 'v': {x}}}" for x in quality.MEASURES)}]) AS p FROM m WHERE n_words > 0),
b AS (SELECT lang, source, p.measure AS measure, CASE WHEN p.v <= 0 THEN 0 ELSE 1 + ceil(ln(p.v) / ln({quality.RATIO}))::BIGINT END AS bucket, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT 0 AS level, lang, source, measure, bucket, n FROM b UNION ALL SELECT 1, lang, '', measure, bucket, sum(n) FROM b GROUP BY ALL
        UNION ALL SELECT 2, '', '', measure, bucket, sum(n) FROM b GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
        CASE WHEN bucket = 0 THEN 0 ELSE pow({quality.RATIO}, bucket - 1) END AS v FROM s),
q AS (SELECT level, lang, source, measure, any_value(total) AS n, min(v) FILTER (upto >= ceil(0.25 * total)) AS q1, min(v) FILTER (upto >= ceil(0.5 * total)) AS q2,
        min(v) FILTER (upto >= ceil(0.75 * total)) AS q3 FROM run GROUP BY ALL),
f AS (SELECT level, lang, source, measure, n, CASE measure {" ".join(f"WHEN '{k}' THEN greatest(q3 + {quality.FENCE} * (q3 - q1), {v})" for k, v in quality.SLACK.items())}
        ELSE greatest(q3 + {quality.FENCE} * (q3 - q1), q2 * {quality.SPREAD}) END AS hi,
        CASE WHEN measure = 'word_length' THEN least(q1 - {quality.FENCE} * (q3 - q1), q2 / {quality.SPREAD}) ELSE -1 END AS lo FROM q),
t AS (SELECT a.lang, a.source, a.measure, CASE WHEN a.n >= {quality.LEAST_ROWS} THEN a.hi WHEN b.n >= {quality.LEAST_ROWS} THEN b.hi ELSE c.hi END AS hi,
        CASE WHEN a.n >= {quality.LEAST_ROWS} THEN a.lo WHEN b.n >= {quality.LEAST_ROWS} THEN b.lo ELSE c.lo END AS lo
        FROM f a JOIN f b ON a.level = 0 AND b.level = 1 AND a.lang = b.lang AND a.measure = b.measure JOIN f c ON c.level = 2 AND a.measure = c.measure),
v AS (SELECT id, lang, source, unnest([{", ".join(f"{{'measure': '{x}', 'k': {i}, 'v': {x}}}" for i, x in enumerate(quality.MEASURES))}]) AS p FROM m),
bad AS (SELECT id, string_agg(p.measure, ',' ORDER BY p.k) AS failed FROM v JOIN t ON v.lang = t.lang AND v.source = t.source AND v.p.measure = t.measure
        WHERE p.v > hi OR p.v < lo GROUP BY id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed FROM m LEFT JOIN bad ON m.id = bad.id
"""


@query("op8_adaptive_quality", QUALITY_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query("op2_elias_fano_store")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_documents(spark, path)


@query("op4_simhash_trees")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_positional_index")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_license_diagonals")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


@query("op6_stratified_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_report(table(spark, sf_dir, "documents"))


@query("op10_pfair_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op3_tag_path_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op9_repeated_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passage_report(table(spark, sf_dir, "documents"))


@query("op5_context_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scores(table(spark, sf_dir, "documents"))


@query("op12_partenum_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_report(table(spark, sf_dir, "documents"))


@query("op11_additive_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_all FROM d WHERE len(terms) > 0),
i AS (SELECT DISTINCT id, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS id, item_id, {_TERMS} AS terms FROM benchmark)),
tf AS (SELECT id, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT id, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
       WHERE term IN (SELECT term FROM i) GROUP BY id, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
p AS (SELECT i.id AS item, item_id, tf.id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_all))))::BIGINT AS score
      FROM i JOIN tf ON i.term = tf.term JOIN w ON w.term = i.term, s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0) WHERE rank <= 10
"""


@query("op13_ball_tree_search", SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
