"""The ten operators' queries over the standard tables, and their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, licenses, lines, mixing, quality, rules, simjoin, tokens, toxicity
from .classify import bucket
from .storage import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.apply_bitmaps(docs, lines.dedup_lines(docs), keep=["doc_id"]).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, 0.7, keep=["doc_id"]).select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def domain() -> Column:
    """The domain of a source of the standard tables, by the last digit of its name."""
    digit = F.substring(F.col("source"), -1, 1)
    return F.when(digit.isin(*"0123"), "web").when(digit.isin(*"456"), "books").otherwise("forums")


MIX = mixing.Mix({"domain": {"web": 5, "books": 3, "forums": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}}, share=(3, 5), max_epochs=4, seed=42)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX, domain())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.similar_documents(table(spark, sf_dir, "documents"), 3, 90, 100)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, 0.5, keep=["doc_id"]).select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def vocabulary_path() -> str:
    named = os.environ.get("TESSERA_UNIGRAM_MODEL")
    if named:
        return named
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokens.sentencepiece_vocabulary(vocabulary_path())
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_line_dedup, op3_quality_classifier, op4_source_mixing, op5_license_scan, op6_ngram_join, op7_toxicity, op8_decontamination, op9_quality_rules, op10_token_counts)}

#: Characters [\\x20\\x09-\\x0D] in DuckDB.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2_SQL = f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), often AS (
  SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.largest AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def mixing_sql(mix: mixing.Mix) -> str:
    """The same budgets and choice, level by level."""
    weigh = lambda level: "CASE " + level + "".join(f" WHEN '{n}' THEN {w}" for n, w in sorted(mix.weights.get(level, {}).items())) + " ELSE 1 END" if mix.weights.get(level) else "1"
    steps, path = [], []
    for depth, level in enumerate(mixing.LEVELS):
        up, path = list(path), [*path, level]
        cols = ", ".join(path)
        join = "CROSS JOIN root p" if not up else "JOIN share_" + up[-1] + " p USING (" + ", ".join(up) + ")"
        by = ("PARTITION BY " + ", ".join(up)) if up else ""
        steps.append(f"""
node_{level} AS (SELECT {cols}, q.available, {weigh(level)} AS weight, q.available * {mix.max_epochs} AS capacity, p.budget AS budget FROM (SELECT {cols}, sum(n_tokens) AS available FROM doc GROUP BY {cols}) q {join}),
fill_{level} AS (SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM node_{level} WINDOW o AS ({by} ORDER BY capacity / weight, {level})),
mark_{level} AS (SELECT *, capacity * w_rest <= (budget - c_before) * weight AS is_full FROM fill_{level}),
open_{level} AS (SELECT *, budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by}) AS remains, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS w_open, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by} ORDER BY {level} ROWS UNBOUNDED PRECEDING) AS w_to FROM mark_{level}),
share_{level} AS (SELECT {cols}, available, CASE WHEN is_full THEN capacity ELSE (remains * w_to) // greatest(w_open, 1) - (remains * (w_to - weight)) // greatest(w_open, 1) END AS budget FROM open_{level})""")
    spaced = f"translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"
    return f"""
WITH doc AS (
  SELECT doc_id, CASE WHEN right(source, 1) IN ('0','1','2','3') THEN 'web' WHEN right(source, 1) IN ('4','5','6') THEN 'books' ELSE 'forums' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(list_filter(string_split({spaced}, ' '), lambda x: x <> '')) AS n_tokens FROM documents
), root AS (SELECT coalesce(sum(n_tokens), 0) * {mix.share[0]} // {mix.share[1]} AS budget FROM doc),{','.join(steps)},
leaf AS (SELECT domain, lang, source, budget // available AS epochs, budget % available AS remainder FROM share_source WHERE available > 0),
ordered AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{mix.seed}', domain, lang, source, CAST(epochs AS VARCHAR), CAST(doc_id AS VARCHAR))), CAST(doc_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) - n_tokens AS before
  FROM doc JOIN leaf USING (domain, lang, source) WHERE n_tokens > 0
), taken AS (SELECT *, greatest(0, least(n_tokens, remainder - before)) AS last_tokens FROM ordered)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS BIGINT) AS epochs, CAST(last_tokens AS BIGINT) AS last_tokens, CAST(epochs * n_tokens + last_tokens AS BIGINT) AS taken_tokens
FROM taken WHERE epochs * n_tokens + last_tokens > 0
"""


ORACLES = {"op2_line_dedup": OP2_SQL, "op4_source_mixing": mixing_sql(MIX)}
