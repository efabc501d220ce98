"""Queries of the text functions and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.config import BM25_PRESETS, BM25Config, IndexConfig, TEXT_PRESETS, TFIDF_PRESETS, TextConfig
from quern.functions import text as T
from quern.operators import index as I
from quern.operators import rank as R
from quern.plans import sqltext as S
from quern.plans.catalog import query
from quern.sources.tables import dealt, new_folder, table


def _docs(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _tokens(name: str, c: TextConfig) -> None:
    @query(f"tokens_{name}", f"SELECT doc_id, len(toks)::INT AS n_tokens, array_to_string(toks, ' ') AS tokens FROM ({S.processed(c, 'documents', 'doc_id')})")
    def run(spark, sf_dir):
        t = _docs(spark, sf_dir).select("doc_id", T.process(F.col("text"), c).alias("toks"))
        return t.select("doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


for _name in ("retrieval", "search", "minimal"):
    _tokens(_name, TEXT_PRESETS[_name])
_tokens("no_numbers", TextConfig(remove_numbers=True, remove_stopwords=False))


@query("tokenize_raw", f"SELECT doc_id, len(toks)::INT AS n_tokens, array_to_string(toks, ' ') AS tokens FROM ({S.tokenized(TextConfig(lowercase=False), 'documents', 'doc_id')})")
def tokenize_raw(spark, sf_dir):
    t = _docs(spark, sf_dir).select("doc_id", T.tokenize(F.col("text"), TextConfig(lowercase=False)).alias("toks"))
    return t.select("doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


@query(
    "normalize_text",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace({S.lower("text")}, '[^\w \t\n\x0B\f\r]', ' ', 'g'), '{S.SPACES}', ' ', 'g'), E' \t\n\r') AS normalized FROM documents""",
)
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query(
    "normalize_no_numbers",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({S.lower("text")}, '[^\w \t\n\x0B\f\r]', ' ', 'g'), '\b\d+\b', ' ', 'g'), '{S.SPACES}', ' ', 'g'), E' \t\n\r') AS normalized FROM documents""",
)
def normalize_no_numbers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text"), TextConfig(remove_numbers=True)).alias("normalized"))


_MINIMAL = S.processed(TEXT_PRESETS["minimal"], "documents", "doc_id")


@query("stem_vocabulary", f"SELECT DISTINCT word, {S.stem('word')} AS stem FROM (SELECT unnest(toks) AS word FROM ({_MINIMAL}))")
def stem_vocabulary(spark, sf_dir):
    t = _docs(spark, sf_dir).select(F.explode(T.process(F.col("text"), TEXT_PRESETS["minimal"])).alias("word"))
    return t.distinct().withColumn("stem", T.stem(F.col("word")))


def _ngrams(name: str, n: int) -> None:
    parts = " || '_' || ".join(f"toks[i + {k}]" for k in range(n))
    sql = f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(toks) - {n - 2}), lambda i: {parts})) AS gram FROM ({_MINIMAL}) WHERE len(toks) >= {n}) GROUP BY gram"

    @query(name, sql)
    def run(spark, sf_dir):
        t = _docs(spark, sf_dir).select(T.process(F.col("text"), TEXT_PRESETS["minimal"]).alias("toks"))
        grams = t.select(F.explode(T.ngrams(F.col("toks"), n)).alias("gram"))
        return grams.groupBy("gram").agg(F.count("*").alias("n"))


_ngrams("bigrams", 2)
_ngrams("trigrams", 3)


@query(
    "stopword_ratio",
    f"SELECT doc_id, len(toks)::BIGINT AS n_tokens, len(list_filter(toks, lambda x: x IN ({S._list(T.stopwords())})))::BIGINT AS n_stop FROM ({_MINIMAL})",
)
def stopword_ratio(spark, sf_dir):
    t = _docs(spark, sf_dir).select("doc_id", T.process(F.col("text"), TEXT_PRESETS["minimal"]).alias("toks"))
    return t.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.size(F.filter("toks", lambda x: T.is_stopword(x))).cast("long").alias("n_stop"))


@query("token_count", "SELECT doc_id, ((strlen(text) + 3) // 4)::BIGINT AS tokens FROM documents")
def token_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("snippet", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS snippet FROM documents")
def snippet(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


_INDEX = IndexConfig()


@query("term_stats", f"WITH {S.index_ctes(_INDEX)} SELECT term, df, ttf, round(idf, 6) AS idf, round(idf_bm25, 6) AS idf_bm25 FROM terms")
def term_stats(spark, sf_dir):
    t = I.build_index(table(spark, sf_dir, "documents"), _INDEX).term_stats()
    return t.select("term", "df", "ttf", F.round("idf", 6).alias("idf"), F.round("idf_bm25", 6).alias("idf_bm25"))


@query("frequent_terms", f"WITH {S.index_ctes(_INDEX)} SELECT term, df, ttf FROM terms ORDER BY ttf DESC, term LIMIT 10")
def frequent_terms(spark, sf_dir):
    return I.build_index(table(spark, sf_dir, "documents"), _INDEX).frequent_terms(10).select("term", "df", "ttf")


@query("doc_stats", f"WITH {S.index_ctes(BM25Config())} SELECT doc_id, term_count, unique_terms, round(norm, 6) AS norm FROM lengths")
def doc_stats(spark, sf_dir):
    t = I.build_index(table(spark, sf_dir, "documents"), BM25Config()).doc_lengths()
    return t.select("doc_id", "term_count", "unique_terms", F.round("norm", 6).alias("norm"))


@query(
    "index_metadata",
    f"WITH {S.index_ctes(_INDEX)} SELECT (SELECT count(DISTINCT term) FROM postings) AS total_terms, (SELECT count(*) FROM postings) AS total_postings, (SELECT coalesce(sum(tf), 0)::BIGINT FROM postings) AS total_tf, n_docs, round(avgdl, 6) AS avgdl FROM corpus",
)
def index_metadata(spark, sf_dir):
    m = I.build_index(table(spark, sf_dir, "documents"), _INDEX, once=True).metadata()
    return m.select("total_terms", "total_postings", "total_tf", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("postings_lookup", f"WITH {S.index_ctes(_INDEX)}, spots AS (SELECT doc_id, array_to_string(list_transform(list_sort(list_filter(range(len(toks)), lambda i: toks[i + 1] = 'erin')), lambda i: i::VARCHAR), ',') AS positions FROM docs) SELECT doc_id, tf, positions FROM postings JOIN spots USING (doc_id) WHERE term = 'erin'")
def postings_lookup(spark, sf_dir):
    wanted = spark.createDataFrame([("erin",)], "term string")
    p = I.build_index(table(spark, sf_dir, "documents"), _INDEX, positions=True).only(wanted).postings
    return p.select("doc_id", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


_CAPPED = IndexConfig(min_term_frequency=2, max_postings_per_term=20)


@query("postings_capped", f"WITH {S.index_ctes(_CAPPED)} SELECT term, doc_id, tf FROM postings")
def postings_capped(spark, sf_dir):
    return I.build_index(table(spark, sf_dir, "documents"), _CAPPED).postings.select("term", "doc_id", "tf")


@query("normalized_tf", f"WITH {S.index_ctes(BM25Config())} SELECT term, p.doc_id, round(tf / (tf + 1.2 * norm), 6) AS normalized_tf FROM postings p JOIN lengths l USING (doc_id)")
def normalized_tf(spark, sf_dir):
    t = R.normalized_tf(I.build_index(table(spark, sf_dir, "documents"), BM25Config()))
    return t.select("term", "doc_id", F.round("normalized_tf", 6).alias("normalized_tf"))


@query("index_incremental", f"WITH {S.index_ctes(_INDEX)} SELECT term, df, ttf FROM terms")
def index_incremental(spark, sf_dir):
    """Two batches of documents give the statistics of one."""
    docs = table(spark, sf_dir, "documents")
    first, second = docs.filter("doc_id < 500"), docs.filter("doc_id >= 500")
    return I.build_index(first, _INDEX).add(second).term_stats().select("term", "df", "ttf")


def _ranking(name: str, c: IndexConfig, method: str, sql: str | None = None, queries: str | None = None) -> None:
    source = queries or "(SELECT item_id AS query_id, text FROM benchmark)"

    @query(name, sql or S.ranked(c, method, source))
    def run(spark, sf_dir):
        asked = spark.createDataFrame(ASKED, "query_id long, text string") if queries else table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
        return R.search(table(spark, sf_dir, "documents"), asked, c, method).withColumn("score", F.round("score", 6))


#: A term of most documents, two terms, a term asked twice, a known and an unknown one, unknown ones, stop-words, nothing.
ASKED = [(1, "erin"), (2, "erin thre"), (3, "erin erin ndst"), (4, "erin qqqqzz"), (5, "zzzqq xxyyzz"), (6, "the of and"), (7, ""), (8, "Éauoua la maison"), (9, "and therhean is the is esndha")]
_ASKED_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in ASKED) + ") v(query_id, text))"

for _name, _c in BM25_PRESETS.items():
    _ranking(f"bm25_{_name}", _c, "bm25")
for _name, _c in TFIDF_PRESETS.items():
    _ranking(f"tfidf_{_name}", _c, "tfidf")
_ranking("bm25_tfidf", BM25Config(max_results=20), "bm25_tfidf")
_ranking("bm25_ad_hoc", BM25Config(max_results=25), "bm25", queries=_ASKED_SQL)
_ranking("tfidf_ad_hoc", IndexConfig(max_results=25), "tfidf", queries=_ASKED_SQL)
_ranking("bm25_threshold_raw", BM25Config(normalize_scores=False, score_threshold=6.0), "bm25")


@query("rank_summary", f"SELECT query_id, count(*) AS n, round(avg(score), 6) AS average_score FROM ({S.ranked(BM25Config(max_results=10), 'bm25', digits=9)}) GROUP BY query_id")
def rank_summary(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    r = R.search(table(spark, sf_dir, "documents"), asked, BM25Config(max_results=10), "bm25").withColumn("score", F.round("score", 9))
    n = r.groupBy("query_id").agg(F.count("*").alias("n"))
    return n.join(R.average_score(r), "query_id").select("query_id", "n", F.round("average_score", 6).alias("average_score"))


# A stored index


def stored_index(spark, sf_dir, c: IndexConfig) -> I.Index:
    """The index of the documents, written to the shared folder and read again."""
    path = new_folder(spark, "index")
    I.build_index(table(spark, sf_dir, "documents"), c, once=True).save(path)
    return I.Index.load(spark, path)


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")


def _stored(name: str, c: IndexConfig, method: str) -> None:
    @query(name, S.ranked(c, method))
    def run(spark, sf_dir):
        return R.METHODS[method](stored_index(spark, sf_dir, c), _asked(spark, sf_dir)).withColumn("score", F.round("score", 6))


_stored("bm25_stored", BM25Config(), "bm25")
_stored("tfidf_stored", TFIDF_PRESETS["retrieval"], "tfidf")
_stored("bm25_tfidf_stored", BM25Config(max_results=20), "bm25_tfidf")


@query("stored_terms", f"WITH {S.index_ctes(_CAPPED)} SELECT term, df, ttf, round(idf, 6) AS idf FROM terms")
def stored_terms(spark, sf_dir):
    return stored_index(spark, sf_dir, _CAPPED).term_stats().select("term", "df", "ttf", F.round("idf", 6).alias("idf"))


@query("stored_lengths", f"WITH {S.index_ctes(BM25Config())} SELECT doc_id, term_count, unique_terms, round(norm, 6) AS norm FROM lengths")
def stored_lengths(spark, sf_dir):
    t = stored_index(spark, sf_dir, BM25Config()).doc_lengths()
    return t.select("doc_id", "term_count", "unique_terms", F.round("norm", 6).alias("norm"))


_UNCAPPED = IndexConfig(max_postings_per_term=None)


@query("postings_uncapped", f"WITH {S.index_ctes(IndexConfig(max_postings_per_term=1 << 40))} SELECT term, doc_id, tf FROM postings")
def postings_uncapped(spark, sf_dir):
    return I.build_index(table(spark, sf_dir, "documents"), _UNCAPPED).postings.select("term", "doc_id", "tf")


@query("index_pruned", f"WITH {S.index_ctes(_INDEX)} SELECT term, df, ttf FROM terms ORDER BY ttf DESC, term LIMIT 200")
def index_pruned(spark, sf_dir):
    return I.build_index(table(spark, sf_dir, "documents"), _INDEX).prune_vocabulary(200).term_stats().select("term", "df", "ttf")


_WHOLE = BM25Config(max_results=1 << 30, score_threshold=-1e9)


@query(
    "rank_diagnostics",
    f"""SELECT query_id, query_terms_count, candidate_docs FROM (SELECT item_id AS query_id, len(list_distinct(toks))::BIGINT AS query_terms_count FROM ({S.processed(_WHOLE.text, "benchmark", "item_id")})) JOIN (
SELECT query_id, count(r.doc_id) AS candidate_docs FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN ({S.ranked(_WHOLE, "bm25")}) r USING (query_id) GROUP BY query_id) USING (query_id)""",
)
def rank_diagnostics(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    return R.diagnostics(I.matched_index(docs, R.query_terms(asked, _WHOLE), _WHOLE), asked)


@query("rank_top_k", f"SELECT query_id, rank, doc_id FROM ({S.ranked(BM25Config(max_results=50), 'bm25')}) WHERE rank <= 3")
def rank_top_k(spark, sf_dir):
    return R.top_k(R.search(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), BM25Config(max_results=50)), 3).select("query_id", "rank", "doc_id")


@query("rank_with_metadata", f"SELECT query_id, rank, doc_id, total_results FROM ({S.ranked(BM25Config(max_results=50), 'bm25')}) r JOIN documents USING (doc_id) WHERE lang = 'de'")
def rank_with_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = R.search(docs, _asked(spark, sf_dir), BM25Config(max_results=50))
    facts = docs.select("doc_id", F.create_map(F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("metadata"))
    return R.with_metadata(found, facts, {"lang": "de"}).select("query_id", "rank", "doc_id", "total_results")
