"""DuckDB SQL for the text analysis and the rankings, written from their definitions and apart from the Spark code."""

from __future__ import annotations

from quern.config import BM25Config, IndexConfig, TextConfig
from quern.functions.text import STEMS, stopwords

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[ \t\n\x0B\f\r]+"
PUNCTUATION = ".,!?;:\"''()[]{}<>"


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _once(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def stem(w: str) -> str:
    fixed = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEMS.items())
    plural = "CASE WHEN strlen(a) < 4 THEN a WHEN a LIKE '%sses' THEN left(a, length(a) - 2) WHEN a LIKE '%ies' THEN left(a, length(a) - 3) || 'i' WHEN a LIKE '%s' AND a NOT LIKE '%ss' THEN left(a, length(a) - 1) ELSE a END"
    ending = "CASE WHEN strlen(b) >= 5 AND b LIKE '%ing' THEN regexp_replace(left(b, length(b) - 3), 'nn$', 'n') WHEN strlen(b) >= 4 AND b LIKE '%ed' THEN left(b, length(b) - 2) ELSE b END"
    last = r"regexp_replace(c, '([^aeiou])y$', '\1i')"
    rules = _once(lower(w), "a", _once(plural, "b", _once(ending, "c", last)))
    return f"CASE WHEN strlen({w}) < 3 THEN {w} ELSE CASE {lower(w)} {fixed} ELSE {rules} END END"


def tokenized(c: TextConfig, table: str, id: str, text: str = "text") -> str:
    """SELECT of (id, toks)."""
    ok = lambda x: f"strlen({x}) BETWEEN {max(1, c.min_length)} AND {c.max_length}" + (f" AND NOT regexp_full_match({x}, '[0-9]+')" if c.remove_numbers else "")
    strip = lambda x: f"trim({x}, '{PUNCTUATION}')"
    cut = f"list_filter(list_transform(regexp_split_to_array({text}, '{SPACES}'), lambda x: {strip('x')}), lambda x: {ok('x')})"
    whole = f"CASE WHEN regexp_matches({text}, '[^ \\t\\n\\x0B\\f\\r]') AND {ok(strip(text))} THEN [{strip(text)}] ELSE []::VARCHAR[] END"
    case = f"list_transform(t, lambda x: {lower('x')})" if c.lowercase else "t"
    return f"SELECT {id}, {case} AS toks FROM (SELECT {id}, CASE WHEN len(a) > 0 THEN a ELSE w END AS t FROM (SELECT {id}, {cut} AS a, {whole} AS w FROM {table}))"


def processed(c: TextConfig, table: str, id: str, text: str = "text") -> str:
    x = "toks"
    if c.remove_stopwords:
        x = f"list_filter({x}, lambda x: x NOT IN ({_list(stopwords(c.language))}))"
    if c.stem:
        x = f"list_transform({x}, lambda w: {stem('w')})"
    x = f"list_filter({x}, lambda x: strlen(x) BETWEEN {c.min_length} AND {c.max_length})"
    return f"SELECT {id}, {x} AS toks FROM ({tokenized(c, table, id, text)})"


def index_ctes(c: IndexConfig, table: str = "documents", id: str = "doc_id") -> str:
    """docs, stats, corpus, postings and terms, as CTEs."""
    k1, b = (c.k1, c.b) if isinstance(c, BM25Config) else (1.2, 0.75)
    return f"""
docs AS MATERIALIZED ({processed(c.text, table, id)}),
stats AS (SELECT {id} AS doc_id, len(toks) AS term_count, len(list_distinct(toks)) AS unique_terms FROM docs),
corpus AS (SELECT count(*) AS n_docs, coalesce(avg(term_count), 0) AS avgdl FROM stats),
counted AS (SELECT term, {id} AS doc_id, count(*) AS tf FROM (SELECT {id}, unnest(toks) AS term FROM docs) GROUP BY ALL HAVING count(*) >= {c.min_term_frequency}),
postings AS MATERIALIZED (SELECT term, doc_id, tf FROM counted QUALIFY row_number() OVER (PARTITION BY term ORDER BY doc_id) <= {c.max_postings_per_term}),
terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf, ln((max(n_docs) + 1.0) / count(*)) + 1 AS idf,
  CASE WHEN count(*) < max(n_docs) THEN ln(1 + (max(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) WHEN count(*) = max(n_docs) THEN 0.01 ELSE 0.0 END AS idf_bm25
  FROM postings, corpus GROUP BY term),
lengths AS (SELECT doc_id, term_count, unique_terms, CASE WHEN avgdl > 0 THEN 1 - {b} + {b} * term_count / avgdl ELSE 1.0 END AS norm FROM stats, corpus)"""


WEIGHTS = {
    "tfidf": "p.tf * t.idf * ln(1 + q.qtf)",
    "bm25": "t.idf_bm25 * p.tf * ({k1} + 1) / (p.tf + {k1} * l.norm) * ln(1 + q.qtf)",
    "bm25_tfidf": "p.tf * t.idf_bm25 * q.qtf",
}


def ranked(c: IndexConfig, method: str, queries: str = "(SELECT item_id AS query_id, text FROM benchmark)", digits: int = 6) -> str:
    weight = WEIGHTS[method].format(k1=getattr(c, "k1", 1.2))
    start = c.delta if method == "bm25" else 0.0
    score = "CASE WHEN best > 0 THEN score / best ELSE score END" if c.normalize_scores else "score"
    return f"""
WITH {index_ctes(c)},
asked AS ({processed(c.text, queries, "query_id")}),
qcount AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(toks) AS term FROM asked) GROUP BY ALL),
q AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms FROM qcount),
scored AS (SELECT q.query_id, p.doc_id, q.n_terms, count(*) AS matched, sum({weight}) + {start} AS score
  FROM postings p JOIN q USING (term) JOIN terms t USING (term) JOIN lengths l ON l.doc_id = p.doc_id GROUP BY ALL),
chosen AS (SELECT query_id, doc_id, score FROM (SELECT *, bool_or(matched = n_terms) OVER (PARTITION BY query_id) AS full_match FROM scored) WHERE matched = n_terms OR NOT full_match),
placed AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total_results, max(score) OVER (PARTITION BY query_id) AS best,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM chosen WHERE score >= {c.score_threshold})
SELECT query_id, rank, doc_id, round({score}, {digits}) AS score, total_results FROM placed WHERE rank <= {c.max_results}"""
