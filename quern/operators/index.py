"""Inverted index tables of a corpus, and their form as files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.config import BM25Config, IndexConfig, TextConfig
from quern.functions.text import process
from quern.sources.tables import dealt, kept

#: Query terms that are looked up by value, beyond by a join.
MOST_TERMS = 20_000


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, tf, dl[, positions]) with the document's length dl, doc_stats(doc_id, term_count, unique_terms), corpus(n_docs, avgdl).

    ``terms`` (term, df, ttf) are there if they were counted; ``matched`` tells that all are terms of a few queries;
    ``numbers`` are the corpus row's values, if the driver knows them.
    """

    postings: DataFrame
    doc_stats: DataFrame
    corpus: DataFrame
    config: IndexConfig
    terms: DataFrame | None = None
    matched: bool = False
    numbers: tuple[int, float] | None = None

    def _beside(self, rows: DataFrame) -> DataFrame:
        """Rows with n_docs and avgdl."""
        if self.numbers is None:
            return rows.crossJoin(F.broadcast(self.corpus))  # one row
        return rows.withColumns({"n_docs": F.lit(self.numbers[0]), "avgdl": F.lit(self.numbers[1])})

    def term_stats(self) -> DataFrame:
        """(term, df, ttf, idf, idf_bm25) of the kept postings."""
        return self.with_idf(counted_terms(self.postings) if self.terms is None else self.terms)

    def with_idf(self, stats: DataFrame) -> DataFrame:
        """Adds idf (of TF-IDF) and idf_bm25 to rows with df."""
        n, df = F.col("n_docs").cast("double"), F.col("df").cast("double")
        bm25 = F.when(df < n, F.log(1 + (n - df + 0.5) / (df + 0.5))).when(df == n, F.lit(0.01)).otherwise(0.0)
        return self._beside(stats).withColumns({"idf": F.log((n + 1) / df) + 1, "idf_bm25": bm25}).drop("n_docs", "avgdl")

    def with_norm(self, rows: DataFrame, length: str) -> DataFrame:
        """Rows with the length normalization of BM25, 1 if the corpus has no token. The corpus is one row."""
        c = self.config if isinstance(self.config, BM25Config) else BM25Config()
        norm = F.when(F.col("avgdl") > 0, 1 - c.b + c.b * F.col(length) / F.col("avgdl")).otherwise(1.0)
        return self._beside(rows).withColumn("norm", norm).drop("n_docs", "avgdl")

    def doc_lengths(self) -> DataFrame:
        return self.with_norm(self.doc_stats, "term_count")

    def metadata(self) -> DataFrame:
        """One row: documents, terms, postings, occurrences, mean length."""
        p = self.postings.agg(F.count_distinct("term").alias("total_terms"), F.count("*").alias("total_postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total_tf"))
        return p.crossJoin(F.broadcast(self.corpus))

    def frequent_terms(self, limit: int = 10) -> DataFrame:
        return self.term_stats().orderBy(F.desc("ttf"), "term").limit(limit)

    def prune_vocabulary(self, most: int) -> Index:
        """Only the ``most`` most frequent terms, ties by term; documents and their lengths stay."""
        top = self.frequent_terms(most).select("term")
        terms = None if self.terms is None else self.terms.join(top, "term", "left_semi")
        return Index(self.postings.join(top, "term", "left_semi"), self.doc_stats, self.corpus, self.config, terms)

    def add(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> Index:
        """The index with further documents: postings and lengths are appended, statistics follow."""
        more = build_index(docs, self.config, id, text)
        stats = self.doc_stats.unionByName(more.doc_stats)
        return Index(_capped(self.postings.unionByName(more.postings), self.config), stats, _corpus(stats), self.config)

    def remove(self, ids: DataFrame, id: str = "doc_id") -> Index:
        gone = ids.select(F.col(id).alias("doc_id"))
        stats = self.doc_stats.join(gone, "doc_id", "left_anti")
        return Index(self.postings.join(gone, "doc_id", "left_anti"), stats, _corpus(stats), self.config)

    def only(self, terms: DataFrame) -> Index:
        """Only the postings of the terms given: what a batch of queries needs."""
        return Index(self.postings.join(terms, "term", "left_semi"), self.doc_stats, self.corpus, self.config)

    def save(self, path: str) -> None:
        """Files of the tables. All postings of a document are in one file, each file is in order of terms.

        So a ranking adds up most of a document's score before it exchanges anything, a frequent term is spread over
        all files, and the pages of terms that are not asked for are passed over.
        """
        spark = self.postings.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.postings.repartition(n, "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        counted_terms(spark.read.parquet(f"{path}/postings")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
        _corpus(spark.read.parquet(f"{path}/doc_stats")).write.mode("overwrite").parquet(f"{path}/corpus")
        config = json.dumps({"kind": type(self.config).__name__, **asdict(self.config)})
        spark.range(1).select(F.lit(config).alias("value")).write.mode("overwrite").text(f"{path}/config")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """A saved index. The driver reads its settings and the one row of the corpus."""
        held = json.loads(spark.read.text(f"{path}/config").first()["value"])
        kind = {"IndexConfig": IndexConfig, "BM25Config": BM25Config}[held.pop("kind")]
        config = kind(**held | {"text": TextConfig(**held["text"])})
        corpus = spark.read.parquet(f"{path}/corpus")
        one = corpus.first()
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return Index(read("postings"), read("doc_stats"), corpus, config, read("terms"), numbers=(one["n_docs"], one["avgdl"]))


def counted_terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))


def _corpus(doc_stats: DataFrame) -> DataFrame:
    return doc_stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("term_count"), F.lit(0.0)).alias("avgdl"))


def _capped(postings: DataFrame, c: IndexConfig) -> DataFrame:
    """The first postings of each term by id, all of them if the cap is None.

    Spark cuts each partition's ranks before it exchanges them.
    """
    if c.max_postings_per_term is None:
        return postings
    rank = F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))
    return postings.withColumn("_r", rank).filter(F.col("_r") <= c.max_postings_per_term).drop("_r")


def analyzed(docs: DataFrame, c: IndexConfig, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens)"""
    return dealt(docs.select(F.col(id), F.col(text))).select(F.col(id).alias("doc_id"), process(F.col(text), c.text).alias("tokens"))


def build_index(docs: DataFrame, c: IndexConfig = IndexConfig(), id: str = "doc_id", text: str = "text", positions: bool = False, once: bool = False) -> Index:
    """The tables of a corpus. ``once`` keeps the counted tokens as files, so that no text is analysed for each table.

    A document's length counts all its tokens, also those below the least frequency or beyond the cap.
    """
    c.validate()
    rows = analyzed(docs, c, id, text)
    stats = rows.select("doc_id", F.size("tokens").cast("long").alias("term_count"), F.size(F.array_distinct("tokens")).cast("long").alias("unique_terms"))
    dl = F.size("tokens").cast("long").alias("dl")
    # the outer form: for the inner one Catalyst adds a filter on the tokens below, which analyses each text again
    if positions:
        tokens = rows.select("doc_id", dl, F.posexplode_outer("tokens").alias("pos", "term"))
    else:
        tokens = rows.select("doc_id", dl, F.explode_outer("tokens").alias("term"))
    kinds = [F.count("*").alias("tf"), F.max("dl").alias("dl"), *([F.sort_array(F.collect_list("pos")).alias("positions")] if positions else [])]
    if once:  # a document without a token is a row without a term; rows that share an id are one document
        postings = kept(tokens.groupBy("term", "doc_id").agg(*kinds))
        stats = postings.groupBy("doc_id").agg(F.max("dl").alias("term_count"), F.count("term").alias("unique_terms"))
        postings = postings.filter(F.col("term").isNotNull())
    else:
        postings = tokens.filter(F.col("term").isNotNull()).groupBy("term", "doc_id").agg(*kinds)
    if c.min_term_frequency > 1:
        postings = postings.filter(F.col("tf") >= c.min_term_frequency)
    return Index(_capped(postings, c), stats, _corpus(stats), c)


def matched_index(docs: DataFrame, terms: DataFrame, c: IndexConfig, id: str = "doc_id", text: str = "text") -> Index:
    """The index of the terms given, from one analysis of each text: what a batch of queries needs without a stored index.

    Each document leaves its length and its tokens that are asked for, which are kept as files. Up to ``MOST_TERMS``
    terms are looked up as values; of more, the document's tokens are joined with them.
    """
    c.validate()
    rows = analyzed(docs, c, id, text)
    asked = [r["term"] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(asked) > MOST_TERMS:
        whole = build_index(docs, c, id, text, once=True)
        return Index(whole.postings.join(terms.select("term").distinct(), "term", "left_semi"), whole.doc_stats, whole.corpus, c)
    hits = F.filter("tokens", lambda t: t.isin(asked)) if asked else F.array().cast("array<string>")
    found = kept(rows.select("doc_id", F.size("tokens").cast("long").alias("term_count"), hits.alias("hits")))
    # dealt by document once: neither the counts of a document's terms nor its scores are exchanged after that
    own = found.filter(F.size("hits") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.max("term_count").alias("dl"))
    postings = own.select("doc_id", "dl", F.explode_outer("hits").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    if c.min_term_frequency > 1:
        postings = postings.filter(F.col("tf") >= c.min_term_frequency)
    stats = found.select("doc_id", "term_count")
    corpus = _corpus(stats)
    one = corpus.first()
    most = c.max_postings_per_term
    if most is not None and one["n_docs"] > most:  # only terms beyond the cap, of MOST_TERMS, are ranked by document
        beyond = [r["term"] for r in counted_terms(postings).filter(F.col("df") > most).select("term").collect()]
        if beyond:
            many = F.col("term").isin(beyond)
            postings = postings.filter(~many).unionByName(_capped(postings.filter(many), c))
    return Index(postings, stats, corpus, c, counted_terms(postings), True, (one["n_docs"], one["avgdl"]))
