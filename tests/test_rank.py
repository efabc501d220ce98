import math

import pytest

from quern.config import BM25_PRESETS, BM25Config, ConfigError, IndexConfig, TEXT_PRESETS, VectorConfig, hybrid_preset
from quern.operators import index as I
from quern.operators import rank as R
from test_text import process

DOCS = [
    (1, "Machine learning finds patterns in data"),
    (2, "Deep learning is a part of machine learning"),
    (3, "Cooking pasta needs salt and water"),
    (4, ""),
    (5, "learning learning learning"),
]
QUERIES = [(1, "machine learning"), (2, "salt unknownword"), (3, "learning learning"), (4, "nothingknown"), (5, "the of")]


def brute(c, method):
    toks = {d: process(t, c.text) for d, t in DOCS}
    n, avg = len(DOCS), sum(map(len, toks.values())) / len(DOCS)
    df = {}
    for t in toks.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = {}
    for q, text in QUERIES:
        qt = process(text, c.text)
        terms = {x: qt.count(x) for x in qt}
        hits = {d: [x for x in terms if x in t] for d, t in toks.items()}
        full = [d for d, h in hits.items() if terms and len(h) == len(terms)]
        scored = []
        for d in full or [d for d, h in hits.items() if h]:
            s = c.delta if method == "bm25" else 0.0
            for x in hits[d]:
                tf, qf = toks[d].count(x), terms[x]
                bm = math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) if df[x] < n else 0.01
                if method == "tfidf":
                    s += tf * (math.log((n + 1) / df[x]) + 1) * math.log(1 + qf)
                elif method == "bm25":
                    s += bm * tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * len(toks[d]) / avg)) * math.log(1 + qf)
                else:
                    s += tf * bm * qf
            if s >= c.score_threshold:
                scored.append((-round(s, 9), d, s))
        scored.sort()
        best = scored[0][2] if scored else 0
        for r, (_, d, s) in enumerate(scored[: c.max_results], 1):
            out[q, r] = (d, s / best if c.normalize_scores and best > 0 else s, len(scored))
    return out


@pytest.mark.parametrize("method", ["tfidf", "bm25", "bm25_tfidf"])
@pytest.mark.parametrize("c", [BM25Config(), BM25Config(normalize_scores=False, max_results=2, score_threshold=0.4)])
def test_rankings(spark, method, c):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score, r.total_results) for r in R.search(docs, queries, c, method).collect()}
    want = brute(c, method)
    assert got.keys() == want.keys()
    for k, (d, s, n) in want.items():
        assert got[k][0] == d and got[k][2] == n and got[k][1] == pytest.approx(s, abs=1e-9)


def test_index_grows_and_shrinks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    c = IndexConfig()
    whole = I.build_index(docs, c)
    parts = I.build_index(docs.filter("doc_id <= 2"), c).add(docs.filter("doc_id > 2"))
    rows = lambda ix: sorted(map(tuple, ix.term_stats().collect()))
    assert rows(whole) == rows(parts)
    less = whole.remove(spark.createDataFrame([(5,)], "doc_id long"))
    assert rows(less) == rows(I.build_index(docs.filter("doc_id <> 5"), c))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    assert R.search(none, queries, BM25Config()).count() == 0
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert R.search(docs, queries.limit(0), BM25Config()).count() == 0


def test_cap_and_least_frequency(spark):
    docs = spark.createDataFrame([(i, "alpha alpha beta") for i in range(6)], "doc_id long, text string")
    p = I.build_index(docs, IndexConfig(min_term_frequency=2, max_postings_per_term=3)).postings.collect()
    assert sorted((r.term, r.doc_id, r.tf) for r in p) == [("alpha", i, 2) for i in range(3)]


def test_settings():
    assert BM25_PRESETS["precision"].k1 == 2.0 and TEXT_PRESETS["minimal"].max_length == 100
    assert hybrid_preset("qa").validate().fusion == "max"
    with pytest.raises(ConfigError):
        VectorConfig(metric="hamming").validate()
    with pytest.raises(ConfigError):
        BM25Config(b=2).validate()


@pytest.mark.parametrize("c", [BM25Config(), BM25Config(min_term_frequency=2, max_postings_per_term=2), BM25Config(max_postings_per_term=None)])
@pytest.mark.parametrize("most", [20_000, 1])
def test_a_stored_index_ranks_alike(spark, tmp_path, monkeypatch, c, most):
    """With terms looked up by value, and joined; changed and pruned after it was read."""
    monkeypatch.setattr(R, "MOST_TERMS", most)
    monkeypatch.setattr(I, "MOST_TERMS", most)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    built = I.build_index(docs, c, once=True)
    built.save(f"file://{tmp_path}/ix")
    ix = I.Index.load(spark, f"file://{tmp_path}/ix")
    assert ix.config == c
    rows = lambda df: sorted(map(repr, df.collect()))
    for method in R.METHODS:
        assert rows(R.METHODS[method](ix, queries)) == rows(R.search(docs, queries, c, method)) == rows(R.METHODS[method](I.build_index(docs, c), queries))
    assert rows(R.diagnostics(ix, queries)) == rows(R.diagnostics(built, queries))
    assert rows(ix.term_stats()) == rows(built.term_stats()) and rows(ix.doc_lengths()) == rows(I.build_index(docs, c).doc_lengths())
    less = ix.remove(spark.createDataFrame([(5,)], "doc_id long"))
    assert rows(less.term_stats()) == rows(I.build_index(docs.filter("doc_id <> 5"), c).term_stats()) or c.max_postings_per_term == 2
    top = ix.prune_vocabulary(2)
    assert {r.term for r in top.term_stats().collect()} == {r.term for r in built.frequent_terms(2).collect()} == {r.term for r in top.postings.collect()}


def test_results_by_metadata(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    from pyspark.sql import functions as F

    found = R.search(docs, spark.createDataFrame(QUERIES, "query_id long, text string"), BM25Config())
    facts = docs.select("doc_id", F.create_map(F.lit("odd"), (F.col("doc_id") % 2 == 1).cast("string")).alias("metadata"))
    kept = R.with_metadata(found, facts, {"odd": "true"}).collect()
    whole = {(r.query_id, r.doc_id): r for r in found.collect()}
    assert kept and all(r.doc_id % 2 == 1 and whole[r.query_id, r.doc_id] == r for r in kept)
    assert [r.doc_id for r in R.top_k(found, 1).orderBy("query_id").collect()] == [r.doc_id for r in found.filter("rank = 1").orderBy("query_id").collect()]
