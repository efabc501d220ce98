"""Queries of vectors and hybrid retrieval. Vector n stands for document n: a pairing made for these tests only."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quern.config import BM25Config, HybridConfig, VectorConfig, hybrid_preset, vector_preset
from quern.functions import vectors as V
from quern.operators import hybrid as H
from quern.operators import knn as K
from quern.plans import sqltext as S
from quern.plans.catalog import query
from quern.sources.tables import new_folder, table

_BASE = VectorConfig(dimension=64)
_Q = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0"
_UNIT = "CASE WHEN sqrt(list_dot_product({0}, {0})) > 0 THEN list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0}))) ELSE {0} END"
_METRIC = {
    "cosine": "CASE WHEN list_dot_product(v, v) * list_dot_product(q, q) > 0 THEN list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) ELSE 0.0 END",
    "dot": "list_dot_product(v, q)",
    "euclidean": "1 / (1 + list_distance(v, q))",
}


def knn_sql(c: VectorConfig, digits: int = 6) -> str:
    v, q = (_UNIT.format("e"), _UNIT.format("q")) if c.normalize else ("e", "q")
    return f"""SELECT query_id, rank, vec_id, round(score, {digits}) AS score FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (
SELECT query_id, vec_id, {_METRIC[c.metric]} AS score FROM (SELECT query_id, {q} AS q FROM ({_Q})), (SELECT vec_id, {v} AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))
WHERE score >= {c.threshold}) WHERE rank <= {c.k}"""


def _queries(spark, sf_dir):
    """The contract's query set: every vector whose id is divisible by 20, against all."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _knn(name: str, c: VectorConfig) -> None:
    @query(name, knn_sql(c))
    def run(spark, sf_dir):
        return K.knn(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), c).withColumn("score", F.round("score", 6))


_knn("knn_cosine", _BASE)
_knn("knn_euclidean", replace(_BASE, metric="euclidean"))
_knn("knn_dot_raw", replace(_BASE, metric="dot", normalize=False))
for _case in ("search", "clustering", "recommendation"):
    _knn(f"knn_preset_{_case}", vector_preset(_case, 64))
_knn("knn_negative", replace(_BASE, threshold=-1.0, k=600))


@query("knn_thresholded", f"SELECT * FROM ({knn_sql(_BASE)}) WHERE score >= 0.35")
def knn_thresholded(spark, sf_dir):
    found = K.knn(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), _BASE).withColumn("score", F.round("score", 6))
    return K.at_least(found, 0.35)


@query("nearest_one", f"SELECT vec_id, score FROM ({knn_sql(_BASE)}) WHERE query_id = 0")
def nearest_one(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.filter("vec_id = 0").first()["embedding"]
    return K.nearest(vectors, q, _BASE).withColumn("score", F.round("score", 6))


@query(
    "vector_functions",
    "SELECT a.vec_id, round(list_dot_product(x, y), 6) AS dot, round(sqrt(list_dot_product(x, x)), 6) AS magnitude, round(list_cosine_similarity(x, y), 6) AS cosine, round(list_distance(x, y), 6) AS euclidean, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))), 6) AS manhattan FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, embedding::DOUBLE[] AS y FROM embeddings) b USING (vec_id)",
)
def vector_functions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    x, y = F.col("x"), F.col("y")
    out = {"dot": V.dot(x, y), "magnitude": V.magnitude(x), "cosine": V.cosine(x, y), "euclidean": V.euclidean(x, y), "manhattan": V.manhattan(x, y)}
    return pairs.select("vec_id", *[F.round(f, 6).alias(k) for k, f in out.items()])


@query(
    "vector_arithmetic",
    f"SELECT vec_id, round(list_sum(list_transform(e, lambda x: x + x * 2)), 6) AS added, round(list_sum(list_transform(e, lambda x: x - x * 2)), 6) AS subtracted, round(list_sum(list_transform(e, lambda x: x * 0.5)), 6) AS scaled, round(list_sum({_UNIT.format('e')}), 6) AS united FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
)
def vector_arithmetic(spark, sf_dir):
    x = F.col("embedding")
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, y: s + y), 6)
    twice = V.scale(x, 2)
    out = {"added": V.add(x, twice), "subtracted": V.subtract(x, twice), "scaled": V.scale(x, 0.5), "united": V.unit(x)}
    return table(spark, sf_dir, "embeddings").select("vec_id", *[total(v).alias(k) for k, v in out.items()])


@query("knn_pairs", knn_sql(_BASE))
def knn_pairs(spark, sf_dir):
    """The form for more queries than are broadcast."""
    return K.knn(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), _BASE, most_bytes=0).withColumn("score", F.round("score", 6))


@query("vector_stored", f"SELECT vec_id, round(list_sum({_UNIT.format('e')}), 6) AS total, len(e)::INT AS size FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vector_stored(spark, sf_dir):
    e = K.stored(table(spark, sf_dir, "embeddings"), _BASE)
    return e.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("embedding").alias("size"))


@query("vector_add", "SELECT vec_id, label FROM embeddings WHERE vec_id < 300 UNION ALL SELECT 299 + row_number() OVER (ORDER BY vec_id), label FROM embeddings WHERE vec_id % 2 = 1")
def vector_add(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    new = e.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "place")
    return K.add(K.stored(e.filter("vec_id < 300"), _BASE), new, _BASE, "place").select("vec_id", "label")


@query("vector_metadata", "SELECT count(*) AS vector_count, 64::BIGINT AS dimension, 1000000::BIGINT AS max_vectors, count(*) = 0 AS is_empty FROM embeddings")
def vector_metadata(spark, sf_dir):
    return K.metadata(table(spark, sf_dir, "embeddings"), _BASE)


@query("vector_saved", "SELECT vec_id, label, len(embedding)::INT AS size FROM embeddings WHERE vec_id % 3 = 1")
def vector_saved(spark, sf_dir):
    path = new_folder(spark, "vectors")
    K.save(table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 1"), path)
    return K.load(spark, path).select("vec_id", "label", F.size("embedding").alias("size"))


@query("vector_embedded", "SELECT doc_id, len(text)::DOUBLE AS first, strlen(text)::DOUBLE AS second FROM documents WHERE text IS NOT NULL")
def vector_embedded(spark, sf_dir):
    """A caller's model, here one from texts to their numbers of characters and bytes, in batches of ten texts."""
    e = K.embed(table(spark, sf_dir, "documents").filter("text IS NOT NULL"), lambda texts: [[len(t), len(t.encode())] for t in texts], batch=10)
    return e.select("doc_id", F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second"))


@query("vector_update", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END AS label, len(embedding)::INT AS size FROM embeddings")
def vector_update(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    changes = e.filter("vec_id % 3 = 0").select("vec_id", F.lit(99).alias("label"), F.array().cast("array<float>").alias("embedding"))
    return K.update(e, changes).select("vec_id", "label", F.size("embedding").alias("size"))


@query("vector_delete", "SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0")
def vector_delete(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.delete(e, e.filter("vec_id % 7 = 0")).select("vec_id", "label")


@query("vector_lookup", "SELECT vec_id, label FROM embeddings WHERE vec_id = 42")
def vector_lookup(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id = 42").select("vec_id", "label")


@query("vector_stats", "SELECT count(*) AS size, max(len(embedding))::BIGINT AS dimension FROM embeddings")
def vector_stats(spark, sf_dir):
    return K.stats(K.checked(table(spark, sf_dir, "embeddings"), _BASE))


def _hybrid_tables(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = asked.join(e.withColumnRenamed("doc_id", "query_id"), "query_id")
    return table(spark, sf_dir, "documents").select("doc_id", "text"), e, queries


def _dense_sql(k: int) -> str:
    return f"""SELECT query_id, vec_id AS doc_id, rank, score FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (
SELECT item_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v) WHERE score >= 0) WHERE rank <= {k}"""


_DEDUPED = r""",
worded AS (SELECT query_id, s.doc_id, round(hybrid_score, 9) AS o, coalesce(list_distinct(list_filter(regexp_split_to_array(d.text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')), []) AS ws FROM scored s LEFT JOIN documents d ON s.doc_id = d.doc_id),
listed AS (SELECT query_id, list({{'doc_id': doc_id, 'ws': ws}} ORDER BY o DESC, doc_id) AS xs FROM worded GROUP BY query_id),
folded AS (SELECT query_id, list_reduce(xs[2:], lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
  CASE WHEN len(k.ws) + len(x.ws) > 0 THEN len(list_intersect(k.ws, x.ws)) / (len(k.ws) + len(x.ws) - len(list_intersect(k.ws, x.ws))) ELSE 0.0 END >= {least})) > 0 THEN acc ELSE list_append(acc, x) END, xs[1:1]) AS kept FROM listed),
kept_ AS (SELECT s.* FROM scored s JOIN (SELECT query_id, unnest(list_transform(kept, lambda k: k.doc_id)) AS doc_id FROM folded) USING (query_id, doc_id))"""


def hybrid_sql(c: HybridConfig) -> str:
    """With the removal of near-duplicates as a fold over each query's rows in order."""
    norm = {
        "min_max": "CASE WHEN max({0}) OVER w - min({0}) OVER w > 1e-10 THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE 0.5 END",
        "z_score": "CASE WHEN stddev_pop({0}) OVER w > 1e-10 THEN ({0} - avg({0}) OVER w) / stddev_pop({0}) OVER w ELSE 0.0 END",
        "sum": "CASE WHEN sum({0}) OVER w > 1e-10 THEN {0} / sum({0}) OVER w ELSE 1.0 / count(*) OVER w END",
    }[c.normalization]
    by_rank = lambda w, r: f"CASE WHEN {r} > 0 THEN {w} / ({c.rrf_k} + {r}) ELSE 0.0 END"
    score = {
        "weighted_average": f"{c.sparse_weight} * s + {c.dense_weight} * d",
        "rrf": f"{by_rank(c.sparse_weight, 'sparse_rank')} + {by_rank(c.dense_weight, 'dense_rank')}",
        "max": "greatest(s, d)",
        "condensation": "(s + d) / 2",
    }[c.fusion]
    asked = "(SELECT item_id AS query_id, b.text FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"
    return f"""
WITH sparse AS ({S.ranked(BM25Config(), "bm25", asked, 12)}), dense AS ({_dense_sql(c.top_k_dense)}),
both_ AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.score, 0) AS sparse_score, coalesce(x.rank, 0) AS sparse_rank, coalesce(y.score, 0) AS dense_score, coalesce(y.rank, 0) AS dense_rank
  FROM (SELECT * FROM sparse WHERE rank <= {c.top_k_sparse}) x FULL JOIN dense y ON x.query_id = y.query_id AND x.doc_id = y.doc_id),
normed AS (SELECT *, {norm.format("sparse_score")} AS s, {norm.format("dense_score")} AS d FROM both_ WINDOW w AS (PARTITION BY query_id)),
scored AS (SELECT *, {score} AS hybrid_score FROM normed)
{_DEDUPED.format(least=c.dedupe_threshold) if c.dedupe else ", kept_ AS (SELECT * FROM scored)"}
SELECT query_id, rank, doc_id, sparse_rank, dense_rank, round(hybrid_score, 6) AS hybrid_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 9) DESC, doc_id) AS rank FROM kept_) WHERE rank <= {c.top_k}"""


def _hybrid(name: str, c: HybridConfig, oracle: bool = True) -> None:
    @query(name, hybrid_sql(c) if oracle else None)
    def run(spark, sf_dir):
        out = H.retrieve(*_hybrid_tables(spark, sf_dir), c, dense=VectorConfig(dimension=64))
        return out.select("query_id", "rank", "doc_id", "sparse_rank", "dense_rank", F.round("hybrid_score", 6).alias("hybrid_score"))


_PLAIN = HybridConfig(dedupe=False)
for _f in ("weighted_average", "rrf", "max", "condensation"):
    _hybrid(f"hybrid_{_f}", replace(_PLAIN, fusion=_f))
for _n in ("z_score", "sum"):
    _hybrid(f"hybrid_{_n}", replace(_PLAIN, normalization=_n))
for _case in ("search", "recommendation", "qa"):
    _hybrid(f"hybrid_preset_{_case}", replace(hybrid_preset(_case), dedupe=False))
for _case in ("search", "recommendation", "qa"):
    _hybrid(f"hybrid_preset_{_case}_whole", hybrid_preset(_case))
_hybrid("hybrid_deduplicated", HybridConfig(dedupe_threshold=0.3))


@query("hybrid_stored", hybrid_sql(HybridConfig(dedupe=False)))
def hybrid_stored(spark, sf_dir):
    from quern.plans.text_queries import stored_index

    c = HybridConfig(dedupe=False)
    out = H.retrieve(*_hybrid_tables(spark, sf_dir), c, dense=VectorConfig(dimension=64), index=stored_index(spark, sf_dir, BM25Config()))
    return out.select("query_id", "rank", "doc_id", "sparse_rank", "dense_rank", F.round("hybrid_score", 6).alias("hybrid_score"))


def _some(spark, sf_dir):
    """Documents and vectors of the same ids."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").filter("doc_id < 400")
    return table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id < 400").dropDuplicates(["doc_id"]).join(e.select("doc_id"), "doc_id", "left_semi"), e


@query("hybrid_paired", "SELECT doc_id, length(text)::BIGINT AS n, len(embedding)::BIGINT AS size FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id < 400")
def hybrid_paired(spark, sf_dir):
    docs, e = _some(spark, sf_dir)
    both = H.paired(docs, e.join(docs.select("doc_id"), "doc_id", "left_semi"))
    return both.select("doc_id", F.length("text").cast("long").alias("n"), F.size("embedding").cast("long").alias("size"))


@query("hybrid_stats", "SELECT (SELECT count(*) FROM documents) AS sparse_documents, (SELECT count(*) FROM embeddings) AS dense_vectors, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS mapping_count")
def hybrid_stats(spark, sf_dir):
    return H.stats(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"))


@query(
    "jaccard_neighbours",
    r"""SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6) AS jaccard FROM (
SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS a FROM documents) JOIN (
SELECT doc_id - 1 AS doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS b FROM documents) USING (doc_id)""",
)
def jaccard_neighbours(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", H.white_words(F.col("text")).alias("a"))
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return pairs.select("doc_id", F.round(H.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("hashed_embedding")
def hashed_embedding(spark, sf_dir):
    from quern.config import TEXT_PRESETS
    from quern.functions.text import process

    e = H.hashed_embedding(process(F.col("text"), TEXT_PRESETS["retrieval"]))
    return table(spark, sf_dir, "benchmark").select("item_id", F.transform(e, lambda x: F.round(x, 6)).alias("embedding"))


@query(
    "mmr_rerank",
    f"""WITH found AS ({knn_sql(replace(_BASE, k=20), 15)}),
xs AS (SELECT query_id, list({{'doc_id': f.vec_id, 'score': score, 'v': embedding::DOUBLE[]}}) AS xs FROM found f JOIN embeddings e ON e.vec_id = f.vec_id GROUP BY query_id),
picked AS (SELECT query_id, list_reduce(range(1, 6), lambda acc, i: CASE WHEN len(acc) < len(xs) THEN list_append(acc, list_max(list_transform(
  list_filter(xs, lambda x: len(list_filter(acc, lambda y: y.x.doc_id = x.doc_id)) = 0),
  lambda x: {{'m': round(0.5 * x.score - 0.5 * coalesce(list_max(list_transform(acc, lambda y: list_cosine_similarity(x.v, y.x.v))), 0), 9), 'o': -x.doc_id, 'x': x}}))) ELSE acc END,
  list_filter([{{'m': 0.0::DOUBLE, 'o': 0::BIGINT, 'x': xs[1]}}], lambda z: false)) AS c FROM xs)
SELECT query_id, i AS rank, c[i].x.doc_id AS doc_id, round(c[i].x.score, 6) AS score FROM (SELECT query_id, c, unnest(range(1, len(c) + 1)) AS i FROM picked)""",
)
def mmr_rerank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = K.knn(e, _queries(spark, sf_dir), replace(_BASE, k=20)).select("query_id", F.col("vec_id").alias("doc_id"), "score")
    return H.mmr(found, e, 5, 0.5, "vec_id").withColumn("score", F.round("score", 6))
