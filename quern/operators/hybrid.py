"""Fusion of a sparse and a dense ranking, and removal of near-duplicates from the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quern.config import BM25Config, HybridConfig, RetrievalError, VectorConfig
from quern.functions.columns import bind
from quern.operators.index import Index
from quern.operators.knn import knn
from quern.operators.rank import bm25, search


def _query() -> WindowSpec:
    return Window.partitionBy("query_id")


def _normalized(x: Column, how: str) -> Column:
    if how == "min_max":
        low, high = F.min(x).over(_query()), F.max(x).over(_query())
        return F.when(high - low > 1e-10, (x - low) / (high - low)).otherwise(0.5)
    if how == "z_score":
        spread = F.stddev_pop(x).over(_query())
        return F.when(spread > 1e-10, (x - F.avg(x).over(_query())) / spread).otherwise(0.0)
    whole = F.sum(x).over(_query())
    return F.when(whole > 1e-10, x / whole).otherwise(1.0 / F.count("*").over(_query()))


def merge(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Both rankings (query_id, doc_id, rank, score) side by side; what is missing in one has score 0 and rank 0."""
    s = sparse.select("query_id", "doc_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    d = dense.select("query_id", "doc_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    return s.join(d, ["query_id", "doc_id"], "full_outer").na.fill(0)


def fuse(sparse: DataFrame, dense: DataFrame, c: HybridConfig) -> DataFrame:
    """(query_id, doc_id, sparse_score, dense_score, sparse_rank, dense_rank, hybrid_score)

    Scores are normalized over the merged rows of a query, those that one ranking lacks included. Reciprocal rank
    fusion looks at ranks only.
    """
    c.validate()
    rows = merge(sparse.filter(F.col("rank") <= c.top_k_sparse), dense.filter(F.col("rank") <= c.top_k_dense))
    rows = rows.withColumns({"s": _normalized(F.col("sparse_score"), c.normalization), "d": _normalized(F.col("dense_score"), c.normalization)})
    s, d = F.col("s"), F.col("d")
    by_rank = lambda w, r: F.when(F.col(r) > 0, w / (c.rrf_k + F.col(r))).otherwise(0.0)
    score = {
        "weighted_average": c.sparse_weight * s + c.dense_weight * d,
        "rrf": by_rank(c.sparse_weight, "sparse_rank") + by_rank(c.dense_weight, "dense_rank"),
        "max": F.greatest(s, d),
        "condensation": (s + d) / 2,
    }[c.fusion]
    return rows.withColumn("hybrid_score", score).drop("s", "d")


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def white_words(text: Column) -> Column:
    """The set of white-space words, case as it is."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != ""))


_KEPT = "array<struct<doc_id:bigint,ws:array<string>>>"


def dedupe(rows: DataFrame, docs: DataFrame, c: HybridConfig, id: str = "doc_id", text: str = "text") -> DataFrame:
    """In the order of the scores, drops what is as like a kept row of its query as the threshold.

    A query has top_k_sparse + top_k_dense rows at most, so its rows fold in one array.
    """
    words = docs.join(rows.select(F.col("doc_id").alias(id)).distinct(), id, "left_semi")
    words = words.select(F.col(id).alias("doc_id"), white_words(F.col(text)).alias("ws"))
    order = F.struct((-F.round("hybrid_score", 9)).alias("o"), "doc_id", "ws")
    groups = rows.join(words, "doc_id", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(order)).alias("xs"))

    def step(kept: Column, x: Column) -> Column:
        item = F.struct(x["doc_id"].alias("doc_id"), F.coalesce(x["ws"], F.array().cast("array<string>")).alias("ws"))
        hit = F.exists(kept, lambda k: jaccard(k["ws"], item["ws"]) >= c.dedupe_threshold)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(item)))

    kept = F.aggregate("xs", F.array().cast(_KEPT), step)
    left = groups.select("query_id", F.explode(F.transform(kept, lambda k: k["doc_id"])).alias("doc_id"))
    return rows.join(left, ["query_id", "doc_id"], "left_semi")


def finish(rows: DataFrame, c: HybridConfig) -> DataFrame:
    order = _query().orderBy(F.desc(F.rint(F.col("hybrid_score") * 1e9)), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= c.top_k)


def paired(docs: DataFrame, vectors: DataFrame, id: str = "doc_id") -> DataFrame:
    """Documents with their vectors, as both are ingested together; a document or a vector alone is an error."""
    n = docs.select(id).join(vectors.select(id), id, "full_outer").count()
    both = docs.join(vectors, id)
    held = both.count()
    if n != held or docs.count() != held:
        raise RetrievalError(f"{n - held} of {n} documents and vectors are without the other, or ids repeat")
    return both


def stats(docs: DataFrame, vectors: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row: sparse_documents (the number of documents), dense_vectors, mapping_count (ids that have both)."""
    one = docs.agg(F.count("*").alias("sparse_documents")).crossJoin(F.broadcast(vectors.agg(F.count("*").alias("dense_vectors"))))
    return one.crossJoin(F.broadcast(docs.join(vectors.select(id).distinct(), id, "left_semi").agg(F.count("*").alias("mapping_count"))))


def retrieve(
    docs: DataFrame, vectors: DataFrame, queries: DataFrame, c: HybridConfig, sparse: BM25Config = BM25Config(), dense: VectorConfig = VectorConfig(), index: Index | None = None
) -> DataFrame:
    """docs (doc_id, text), vectors (doc_id, embedding), queries (query_id, text, embedding), fused on doc_id.

    A stored index of the documents, if given, takes the place of their analysis and of ``sparse``.
    """
    s = search(docs, queries, sparse, "bm25") if index is None else bm25(index, queries)
    v = VectorConfig(dense.max_vectors, dense.dimension, dense.normalize, c.top_k_dense, dense.threshold, dense.metric)
    d = knn(vectors, queries, v, "doc_id").withColumnRenamed("vec_id", "doc_id")
    rows = fuse(s, d, c)
    return finish(dedupe(rows, docs, c) if c.dedupe else rows, c)


def hashed_embedding(tokens: Column, dimension: int = 64) -> Column:
    """A unit vector of a text: tokens counted in hashed places with hashed signs. Deterministic on any machine."""
    at = lambda t: F.pmod(F.xxhash64(t), F.lit(dimension))
    sign = lambda t: F.when(F.xxhash64(t, F.lit(1)) >= 0, 1.0).otherwise(-1.0)
    placed = F.transform(tokens, lambda t: F.struct(at(t).alias("i"), sign(t).alias("s")))
    raw = lambda p: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(p, lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return bind(bind(placed, raw), lambda v: bind(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def mmr(rows: DataFrame, vectors: DataFrame, k: int, trade: float, id: str = "doc_id", embedding: str = "embedding") -> DataFrame:
    """Extension: maximal marginal relevance over each query's rows (query_id, doc_id, score), a bounded list."""
    from quern.functions.vectors import cosine, doubles

    joined = rows.join(vectors.select(F.col(id).alias("doc_id"), doubles(F.col(embedding)).alias("v")), "doc_id")
    item = F.struct("doc_id", "score", "v")
    groups = joined.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("xs"), F.count("*").alias("n"))
    kind = "array<struct<doc_id:bigint,score:double,v:array<double>>>"

    def value(x: Column, chosen: Column) -> Column:
        like = F.coalesce(F.array_max(F.transform(chosen, lambda y: cosine(x["v"], y["v"]))), F.lit(0.0))
        return trade * x["score"] - (1 - trade) * like

    def step(chosen: Column, _: Column) -> Column:
        left = F.filter("xs", lambda x: ~F.exists(chosen, lambda y: y["doc_id"] == x["doc_id"]))
        best = F.array_max(F.transform(left, lambda x: F.struct(F.round(value(x, chosen), 9).alias("m"), (-x["doc_id"]).alias("o"), x.alias("x"))))
        return F.when(F.size(left) > 0, F.concat(chosen, F.array(best["x"]))).otherwise(chosen)

    picked = groups.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast(kind), step).alias("c"))
    return picked.select("query_id", F.posexplode("c").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("long").alias("rank"), "x.doc_id", "x.score")
