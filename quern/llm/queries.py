"""Queries of this package: each applies one operator to its whole table and takes its digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quern.plans.catalog import Query

from quern.llm import bpe, language, mixing, multiset, pii, quality_model, quality_rules, sharding, simhash, site_style
from quern.llm.common import remainder, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@register
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(docs.filter(~held))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@register
def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return quality_model.classify(docs, learned).select("doc_id", held.alias("held_out"), "score", "predicted")


#: The key of the queries; a user of ``pii`` passes a secret one.
SURROGATE_KEY = b"quern-public-demonstration-key"


@register
def op3_pii_surrogates(spark, sf_dir):
    return pii.checked(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


@register
def op4_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@register
def op5_quality_rules(spark, sf_dir):
    kept = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *kept)


def _rules_sql() -> str:
    """The same counts and thresholds, from one row for each word."""
    ratio = {
        "mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words", "stop_ratio": "(n_stop_words + 1) / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines", "capital_ratio": "n_capitals / word_chars", "stutter_ratio": "n_stutters / n_words",
    }
    passed = " AND ".join(f"coalesce({ratio[r.measure]}, 0) BETWEEN {r.least}::DOUBLE AND {r.most}::DOUBLE" for r in quality_rules.RULES)
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_SET)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
v AS (
  SELECT r, i, x, lag(x) OVER o AS b,
    x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS s
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM v WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
gaps AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS g FROM twice),
rep AS (SELECT r, sum(g)::BIGINT AS n_repeat_words FROM gaps GROUP BY r),
one AS (
  SELECT r, count(*) FILTER (WHERE x IN ({stops})) AS n_stop_words, count(*) FILTER (WHERE x = b) AS n_stutters FROM v GROUP BY r),
c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{quality_rules.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_capitals,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_stutters, 0) AS n_stutters
  FROM d LEFT JOIN rep USING (r) LEFT JOIN one USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passed} AS kept FROM f"""


ORACLES["op5_quality_rules"] = _rules_sql()


@register
def op6_simhash(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash.as_hex(out["fp"]).alias("fingerprint"), "component_id")


@register
def op7_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).drop("text")


@register
def op8_multiset_fingerprint(spark, sf_dir):
    return multiset.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op9_main_text(spark, sf_dir):
    return site_style.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "decided_by")


@register
def op10_shards(spark, sf_dir):
    return sharding.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
