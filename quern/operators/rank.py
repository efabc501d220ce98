"""Ranking of a batch of queries against a corpus: TF-IDF, BM25 and TF-IDF with BM25's weights.

A query's candidates are the documents with all its terms; only if there is none, those with any. Scores below the
threshold go, the rest are counted and ranked (ties by id), cut, and divided by the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.config import BM25Config, IndexConfig
from quern.functions.text import process
from quern.operators.index import MOST_TERMS, Index, matched_index
from quern.operators.store import by_metadata


#: Pairs of a query and a term that are broadcast.
MOST_PAIRS = 200_000


def query_terms(queries: DataFrame, c: IndexConfig, id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, qtf, n_terms); queries without a term give no row."""
    tokens = queries.select(F.col(id).alias("query_id"), F.explode(process(F.col(text), c.text)).alias("term"))
    counted = tokens.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return counted.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))


def _hits(index: Index, terms: DataFrame) -> DataFrame:
    """Postings of the query terms with df and idf; statistics are of these terms only, over all documents."""
    if index.terms is None:
        own = index.only(terms.select("term").distinct()).postings.select("term", "doc_id", "tf", "dl")
        if index.config.max_postings_per_term is None:  # a term may have any number: counted in partial sums
            df = own.groupBy("term").agg(F.count("*").alias("df"))
            return own.join(index.with_idf(df).join(terms, "term"), "term")
        # postings are dealt by term when they are capped: counting beside them saves computing them twice for a join
        counted = own.withColumn("df", F.count("*").over(Window.partitionBy("term")))
        return index.with_idf(counted).join(terms, "term")
    postings, stats = index.postings, index.terms
    pairs = terms.limit(MOST_PAIRS + 1).toArrow()
    small = pairs.num_rows <= MOST_PAIRS
    if small:
        terms = terms.sparkSession.createDataFrame(pairs)  # a local relation: the queries are analysed once
    if small and not index.matched:
        asked = pairs["term"].unique().to_pylist()
        if len(asked) <= MOST_TERMS:  # by value, so that pages of other terms are not read
            postings, stats = postings.filter(F.col("term").isin(asked)), stats.filter(F.col("term").isin(asked))
    weighed = index.with_idf(stats).join(terms, "term")
    return postings.select("term", "doc_id", "tf", "dl").join(F.broadcast(weighed) if small else weighed, "term")


def _candidates(scored: DataFrame) -> DataFrame:
    full = F.col("matched") == F.col("n_terms")
    any_full = F.max(full).over(Window.partitionBy("query_id"))
    return scored.withColumn("_any", any_full).filter(full | ~F.col("_any")).drop("_any")


def nine_digits(score: str) -> Column:
    """What scores are compared by, as a whole number: sums in another order differ in later digits."""
    return F.rint(F.col(score) * 1e9)


def finish(scored: DataFrame, c: IndexConfig) -> DataFrame:
    """(query_id, rank, doc_id, score, total_results) from (query_id, doc_id, score)."""
    per_query = Window.partitionBy("query_id")
    order = per_query.orderBy(F.desc(nine_digits("score")), "doc_id")
    kept = scored.filter(F.col("score") >= c.score_threshold)
    ranked = kept.withColumns({"total_results": F.count("*").over(per_query), "best": F.max("score").over(per_query), "rank": F.row_number().over(order).cast("long")})
    score = F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(F.col("score")) if c.normalize_scores else F.col("score")
    return ranked.filter(F.col("rank") <= c.max_results).select("query_id", "rank", "doc_id", score.alias("score"), "total_results")


def _scored(index: Index, queries: DataFrame, weight: Column, start: float, lengths: bool, id: str, text: str) -> DataFrame:
    hits = _hits(index, query_terms(queries, index.config, id, text))
    if lengths:
        hits = index.with_norm(hits, "dl")  # a posting carries its document's length: no join with the documents
    return _candidates(hits.groupBy("query_id", "doc_id", "n_terms").agg(F.count("*").alias("matched"), (F.sum(weight) + start).alias("score")))


def tfidf(index: Index, queries: DataFrame, id: str = "query_id", text: str = "text") -> DataFrame:
    weight = F.col("tf") * F.col("idf") * F.log1p(F.col("qtf").cast("double"))
    return finish(_scored(index, queries, weight, 0.0, False, id, text), index.config)


def bm25(index: Index, queries: DataFrame, id: str = "query_id", text: str = "text") -> DataFrame:
    """``delta`` is added once for each document."""
    c = index.config
    if not isinstance(c, BM25Config):
        raise TypeError("bm25 needs an index with a BM25Config")
    tf = F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * F.col("norm"))
    return finish(_scored(index, queries, F.col("idf_bm25") * tf * F.log1p(F.col("qtf").cast("double")), c.delta, True, id, text), c)


def bm25_tfidf(index: Index, queries: DataFrame, id: str = "query_id", text: str = "text") -> DataFrame:
    return finish(_scored(index, queries, F.col("tf") * F.col("idf_bm25") * F.col("qtf"), 0.0, False, id, text), index.config)


METHODS = {"tfidf": tfidf, "bm25": bm25, "bm25_tfidf": bm25_tfidf}


def search(docs: DataFrame, queries: DataFrame, c: IndexConfig, method: str = "bm25", doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Ranks without a stored index: only the queries' terms are counted, in one pass over the documents."""
    terms = query_terms(queries, c, query_id, text)
    return METHODS[method](matched_index(docs, terms, c, doc_id, text), queries, query_id, text)


def diagnostics(index: Index, queries: DataFrame, id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, query_terms_count, candidate_docs) of every query: its different terms, and the documents compared."""
    terms = query_terms(queries, index.config, id, text)
    found = _candidates(_hits(index, terms).groupBy("query_id", "doc_id", "n_terms").agg(F.count("*").alias("matched")))
    n_docs = found.groupBy("query_id").agg(F.count("*").alias("candidate_docs"))
    n_terms = terms.groupBy("query_id").agg(F.count("*").alias("query_terms_count"))
    every = queries.select(F.col(id).alias("query_id")).join(n_terms, "query_id", "left").join(n_docs, "query_id", "left")
    return every.na.fill(0, ["query_terms_count", "candidate_docs"])


def normalized_tf(index: Index) -> DataFrame:
    """Postings with tf / (tf + k1 * length normalization)."""
    c = index.config if isinstance(index.config, BM25Config) else BM25Config()
    return index.with_norm(index.postings, "dl").withColumn("normalized_tf", F.col("tf") / (F.col("tf") + c.k1 * F.col("norm"))).drop("norm")


def top_k(results: DataFrame, k: int) -> DataFrame:
    """The best k of each query again, by score."""
    order = Window.partitionBy("query_id").orderBy(F.desc(nine_digits("score")), "doc_id")
    return results.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def average_score(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"))


def with_metadata(results: DataFrame, docs: DataFrame, wanted: dict[str, str], id: str = "doc_id", metadata: str = "metadata") -> DataFrame:
    """The results whose document has these values; ranks and ``total_results`` stay those of the whole result."""
    found = by_metadata(docs.select(F.col(id).alias("doc_id"), F.col(metadata)), wanted, metadata).select("doc_id")
    return results.join(found, "doc_id", "left_semi").select(*results.columns)


__all__ = ["average_score", "bm25", "bm25_tfidf", "diagnostics", "finish", "normalized_tf", "query_terms", "search", "tfidf", "top_k", "with_metadata"]
