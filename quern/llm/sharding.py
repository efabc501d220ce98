"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows are dealt to blocks by a hash, and the slots of the shards to chunks, both of about ``ROWS`` rows. The driver
draws how many rows of each block go to each chunk from the multivariate hypergeometric distribution that a uniform
shuffle of all rows would give, block by block, without looking at rows. Each block orders its rows by keyed hashes
(a permutation that needs no state), cuts them at its row of the matrix, the cuts are exchanged, and each chunk orders
what it got by hashes of another key. Any two runs agree, also after lost executors, as nothing depends on where rows
happen to be.

Shards' numbers of rows are at most one apart, whatever the texts: equal texts are rows like others and go to chunks
apart from each other. Blocks and chunks grow in size rather than number beyond ``MOST`` of each, so that the matrix
stays small; a large one is ordered in ranges of hashes of about ``ROWS`` rows, so that no task grows with the table.
Null texts have no bytes, a text of any length is one row. Rows that repeat another in id and text tie and are told
apart only by their place in the order, which is the same for all results as the rows are. An empty table gives no
rows. Columns with the names of results are replaced, others pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import own_name, stable

ROWS, MOST = 4096, 1024
#: numpy draws from totals below this only.
NUMPY_TOTAL = 10**9


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def chunk_sizes(n: int, shards: int, rows: int = ROWS, most: int = MOST) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of every chunk; a shard's chunks are of nearly equal size."""
    out = []
    for s, size in enumerate(shard_sizes(n, shards)):
        parts = max(1, min(-(-size // rows), most // shards))
        start = 0
        for i in range(parts):
            k = size // parts + (i < size % parts)
            out.append((s, start, k))
            start += k
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones among n drawn, for totals that numpy refuses: inversion outwards from the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = math.exp(log(good, mode) + log(bad, n - mode) - log(good + bad, n))
    u, up, down, x, y = rng.random() - p, p, p, mode, mode
    while u > 0 and (x < high or y > low):
        if x < high:
            up *= (good - x) * (n - x) / ((x + 1) * (bad - n + x + 1))
            x += 1
            u -= up
            if u <= 0:
                return x
        if y > low:
            down *= y * (bad - n + y) / ((good - y + 1) * (n - y + 1))
            y -= 1
            u -= down
            if u <= 0:
                return y
        if up + down < 1e-18:
            break
    return mode


def _row(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    if left.sum() < NUMPY_TOTAL:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for j, k in enumerate(left.tolist()):
        rest -= k
        out[j] = hypergeometric(rng, k, rest, n) if n else 0
        n -= int(out[j])
    return out


def matrix(blocks: list[int], chunks: list[int], seed: int) -> np.ndarray:
    """Rows of each block for each chunk, as a uniform shuffle would have them."""
    rng = np.random.default_rng(seed)
    left = np.array(chunks, np.int64)
    out = np.zeros((len(blocks), len(chunks)), np.int64)
    for i, n in enumerate(blocks):
        out[i] = _row(rng, left, n)
        left -= out[i]
    return out


def _ranked(rows: DataFrame, group: str, order: Column, parts: int) -> DataFrame:
    """Adds p: the place of each row in its group by the order (a struct that begins with a hash), from 0.

    A group is cut by ranges of the hash, whose numbers of rows add up, so that no task sorts a whole group.
    """
    ranged = rows.withColumns({"o": order}).withColumn("r", (F.shiftrightunsigned(F.col("o.h"), 32) * parts / F.lit(1 << 32)).cast("int"))
    n = ranged.groupBy(group, "r").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    n = n.select(group, "r", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(group, "r").orderBy("o")) - 1
    return ranged.withColumn("p", place).join(n, [group, "r"]).withColumn("p", F.col("p") + F.col("before")).drop("o", "r", "before")


def assign(docs: DataFrame, shards: int = 24, text: str = "text", id: str = "doc_id", seed: int = 23, rows: int = ROWS, most: int = MOST) -> DataFrame:
    """The rows with shard (from 0) and slot (from 0, without gaps in each shard)."""
    name = own_name(docs, "_row")
    # the caller's columns are one struct from here, so that none of their names can clash with those of the plan
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]).alias(name), F.col(id).alias("i"), F.xxhash64(F.lit(seed), F.col(text)).alias("t"))
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(seed + 1), "i", "t"))
    n = docs.count()
    blocks = max(1, min(-(-n // rows), most))
    parts = max(1, -(-n // (blocks * rows)))
    keyed = keyed.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    sizes = {r["block"]: r["n"] for r in keyed.groupBy("block").agg(F.count("*").alias("n")).collect()}
    chunks = chunk_sizes(n, shards, rows, most)
    cells = matrix([sizes.get(b, 0) for b in range(blocks)], [k for _, _, k in chunks], seed)
    held = docs.sparkSession.sparkContext.broadcast(cells.cumsum(axis=1))  # at most MOST * MOST numbers

    @F.arrow_udf("int")
    def chunk_of(block: pa.Array, place: pa.Array) -> pa.Array:
        ends, b, p = held.value, block.to_numpy(), place.to_numpy()
        out = np.empty(len(b), np.int32)
        for x in np.unique(b):
            out[b == x] = np.searchsorted(ends[x], p[b == x], side="right")
        return pa.array(out)

    by = lambda s: F.struct(F.xxhash64(F.lit(s), "h").alias("h"), F.col("i"), F.col("t"))
    cut = _ranked(keyed, "block", by(seed + 2), parts).withColumn("chunk", chunk_of("block", F.col("p").cast("long"))).drop("p", "block")
    placed = _ranked(cut, "chunk", by(seed + 3), parts)
    table = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(a).cast("long").alias("first")) for s, a, _ in chunks])
    at = F.element_at(table, F.col("chunk") + 1)
    return placed.select(f"{name}.*", at["shard"].cast("int").alias("shard"), (at["first"] + F.col("p")).cast("long").alias("slot"))


def digest(docs: DataFrame, shards: int = 24, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard); only ids, hashes and sizes are exchanged."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(id, (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(F.col(text)).alias("key"))
    out = assign(stable(narrow), shards, "key", id)
    return out.select(id, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, text: str = "text", id: str = "doc_id") -> None:
    """Parquet folders shard=0, shard=1, ... whose files hold the rows in the order of their slots.

    Rows are exchanged by range of (shard, slot), so that a shard may be written by many tasks.
    """
    placed = assign(docs, shards, text, id)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(max(n, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
