"""Exact nearest neighbours of a batch of query vectors, and a table of vectors as a store.

Queries are a set of vectors given beforehand. Up to ``MOST_BYTES`` of them are sent to all executors, and one scan of
the vectors compares them in blocks of ``BLOCK`` rows; beyond, queries and vectors are both dealt to blocks, and pairs
of blocks meet in tasks of bounded size. Either way the best k of each task leave it for every query, so that the
exchange of results carries k rows for each query and task, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.config import ConfigError, VectorConfig
from quern.functions import vectors as V
from quern.sources.tables import kept

#: Query vectors compared at once; bytes of queries that are broadcast; vectors and queries of a pair of blocks beyond.
BLOCK, MOST_BYTES, PAIR_ROWS = 2048, 64 << 20, 65_536


def checked(vectors: DataFrame, c: VectorConfig, embedding: str = "embedding") -> DataFrame:
    """The rows; reading one whose size differs fails."""
    ok = F.assert_true(F.size(embedding) == c.dimension, F.lit(f"dimension {c.dimension} expected"))
    return vectors.filter(ok.isNull())


def stored(vectors: DataFrame, c: VectorConfig, embedding: str = "embedding") -> DataFrame:
    """As the store keeps them: of length 1 if so configured."""
    return vectors.withColumn(embedding, V.unit(F.col(embedding)) if c.normalize else V.doubles(F.col(embedding)))


def add(store: DataFrame, vectors: DataFrame, c: VectorConfig, order: str, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The store with the vectors: sizes are checked, ids go on after the store's largest, in the order of a column.

    More than ``max_vectors`` in all is an error, and none is added. Numbers are given by ranges of the order, so that
    no task sees all rows. The ranges are kept as files: computed again, they would have other bounds, as these come
    from a sample, and be merged in another way, as that goes by the columns read; ids would then repeat.
    """
    n, last, more = store.count(), store.agg(F.coalesce(F.max(id), F.lit(-1)).alias("m")).first()["m"], vectors.count()
    if n + more > c.max_vectors:
        raise ConfigError(f"{n + more} vectors are more than {c.max_vectors}")
    columns = dict.fromkeys([*(x for x in store.columns if x != id), embedding])
    place = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    dealt = kept(vectors.repartitionByRange(order).sortWithinPartitions(order).select(*columns, *place))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each task
    starts, at = {}, last + 1
    for p in sorted(sizes):
        starts[p], at = at, at + sizes[p]
    offset = F.element_at(F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]), F.col("_part")) if starts else F.lit(0)
    numbered = dealt.withColumn(id, (offset + F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)).cast("long"))
    new = stored(checked(numbered, c, embedding), c, embedding).select(*store.columns)
    return store.unionByName(new)


def reconfigured(store: DataFrame, old: VectorConfig, new: VectorConfig) -> VectorConfig:
    """The new settings, if they fit what is stored: the dimension of a store that is not empty stays."""
    new.validate()
    if new.dimension != old.dimension and not store.isEmpty():
        raise ConfigError("the dimension of a store that is not empty cannot change")
    return new


def save(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def embed(texts: DataFrame, model: Callable[[Column], Column] | Callable[[list[str]], list[list[float]]], text: str = "text", to: str = "embedding", batch: int | None = None) -> DataFrame:
    """The texts with the vectors of a caller's model.

    A model is a function of a column, or, if ``batch`` is given, one from a list of at most so many texts to their
    vectors, which runs in Python beside the executors. A null text has a null vector.
    """
    if batch is None:
        return texts.withColumn(to, model(F.col(text)))

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            for i in range(0, len(x), batch):
                part = x.slice(i, batch).to_pylist()
                found = iter(model([t for t in part if t is not None]))
                yield pa.array([None if t is None else [float(v) for v in next(found)] for t in part], pa.list_(pa.float64()))

    return texts.withColumn(to, run(F.col(text)))


def _similarity(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        return np.divide(x @ q.T, n, out=np.zeros(n.shape), where=n > 0)
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(np.maximum((x**2).sum(1)[:, None] + (q**2).sum(1)[None, :] - 2 * x @ q.T, 0)))
    return x @ q.T


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=x.copy(), where=n > 0)


def _top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k rows of each query, by score at nine digits, then id."""
    order = np.lexsort((vec, -np.round(score, 9), query))
    q = query[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
    keep = order[place < k]
    return query[keep], vec[keep], score[keep]


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this size, and their matrix."""
    sizes = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()])
    good = np.flatnonzero(sizes == size)
    flat = column.take(pa.array(good)).flatten()
    return good, flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(good), size)


def _best(batches: Iterator[pa.RecordBatch], blocks: list[tuple[np.ndarray, np.ndarray]], c: VectorConfig) -> Iterator[pa.RecordBatch]:
    """The best k of these vectors for each query, with all that tie with the k-th at nine digits."""
    held: list = [None] * len(blocks)
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            for size in {q.shape[1] for _, q in blocks}:
                good, x = _matrix(part.column("v"), size)
                if not len(good):
                    continue
                x = _unit(x) if c.normalize else x
                for b, (asked, queries) in enumerate(blocks):
                    if queries.shape[1] != size:
                        continue
                    scores = _similarity(x, queries, c.metric)
                    keep = scores >= c.threshold
                    if len(x) > c.k:
                        shown = np.round(np.where(keep, scores, -np.inf), 9)
                        keep &= shown >= np.partition(shown, -c.k, axis=0)[-c.k]
                    row, col = np.nonzero(keep)
                    new = asked[col], ids[good][row], scores[row, col]
                    held[b] = _top(*(new if held[b] is None else (np.concatenate(z) for z in zip(held[b], new, strict=True))), c.k)
    for found in held:
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def _blocks(rows: list[tuple[int, list[float]]], c: VectorConfig) -> list[tuple[np.ndarray, np.ndarray]]:
    """Queries of one size each, at most ``BLOCK``."""
    out = []
    for size in sorted({len(v) for _, v in rows}):
        mine = [r for r in rows if len(r[1]) == size]
        for i in range(0, len(mine), BLOCK):
            q = np.array([v for _, v in mine[i : i + BLOCK]], float)
            out.append((np.array([x for x, _ in mine[i : i + BLOCK]], np.int64), _unit(q) if c.normalize else q))
    return out


def _by_pairs(source: DataFrame, asked: DataFrame, n_vectors: int, n_queries: int, c: VectorConfig) -> DataFrame:
    """Both sides dealt to blocks; every block of the one meets every block of the other in a task of its own."""
    vs, qs = -(-n_vectors // PAIR_ROWS), -(-n_queries // PAIR_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = source.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(vs)).cast("int")).withColumn("qb", every(qs))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int")).withColumn("vb", every(vs))

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        rows = list(zip(q["query_id"].to_pylist(), q["v"].to_pylist(), strict=True))
        found = list(_best(iter(x.select(["id", "v"]).to_batches()), _blocks(rows, c), c))
        return pa.Table.from_batches(found, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(meet, FOUND)


def knn(vectors: DataFrame, queries: DataFrame, c: VectorConfig, id: str = "vec_id", query_id: str = "query_id", embedding: str = "embedding", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): vectors with score >= threshold, the best k, ties by id.

    Cosine, dot product, or 1 / (1 + distance). Vectors of another size than the query's are left out.
    """
    c.validate()
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(embedding).alias("v")).filter("v IS NOT NULL")
    source = vectors.select(F.col(id).cast("long").alias("id"), F.col(embedding).alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0)).alias("numbers")).first()
    if 8 * size["numbers"] <= most_bytes:
        sent = vectors.sparkSession.sparkContext.broadcast(_blocks([(r["query_id"], r["v"]) for r in asked.collect()], c))
        found = source.mapInArrow(lambda b: _best(b, sent.value, c), FOUND)
    else:
        found = _by_pairs(source, asked, vectors.count(), size["n"], c)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.rint(F.col("score") * 1e9)), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= c.k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, query: list[float], c: VectorConfig, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One query, in expressions: (vec_id, score), a top-k without a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = V.unit(F.col(embedding)) if c.normalize else F.col(embedding)
    q = V.unit(q) if c.normalize else q
    score = {"cosine": V.cosine(v, q), "dot": V.dot(v, q), "euclidean": 1 / (1 + V.euclidean(v, q))}[c.metric]
    found = vectors.select(F.col(id).alias("vec_id"), score.alias("score")).filter(F.col("score") >= c.threshold)
    return found.orderBy(F.desc(F.round("score", 9)), "vec_id").limit(c.k)


def at_least(results: DataFrame, threshold: float) -> DataFrame:
    """The threshold after the ranking: ranks stay."""
    return results.filter(F.col("score") >= threshold)


def update(vectors: DataFrame, changes: DataFrame, id: str = "vec_id") -> DataFrame:
    """Rows replaced by the changes with their id; a null or empty value of a change keeps the old one."""
    new = changes.select(F.col(id), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != id])
    out = vectors.join(new, id, "left")
    empty = {"string": lambda x: F.nullif(x, F.lit("")), "array": lambda x: F.when(F.size(x) > 0, x)}
    for c, kind in changes.dtypes:
        if c != id:
            x = F.col(f"_new_{c}")
            x = next((f(x) for k, f in empty.items() if kind.startswith(k)), x)
            out = out.withColumn(c, F.coalesce(x, F.col(c)))
    return out.select(*vectors.columns)


def delete(vectors: DataFrame, ids: DataFrame, id: str = "vec_id") -> DataFrame:
    return vectors.join(ids.select(id), id, "left_anti")


def stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    return vectors.agg(F.count("*").alias("size"), F.coalesce(F.max(F.size(embedding)), F.lit(0)).cast("long").alias("dimension"))


def metadata(vectors: DataFrame, c: VectorConfig) -> DataFrame:
    """One row: vector_count, dimension, max_vectors, is_empty."""
    n = F.count("*")
    return vectors.agg(n.alias("vector_count"), F.lit(c.dimension).cast("long").alias("dimension"), F.lit(c.max_vectors).cast("long").alias("max_vectors"), (n == 0).alias("is_empty"))
