"""Pairs of neighbours in the order of an id, over a table of any size: a range exchange and one row more a range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import partitions, small_table


class Ranges:
    """Ranges of (id, hash) in the order of falling ids, null ids last; an id with many rows has several by hash."""

    def __init__(self, cuts: list[int], nulls: int) -> None:
        """cuts: ids that split the ids into parts of equal number, one given again and again if it holds many parts."""
        bounds, parts = [], [1]
        for v in sorted(set(cuts)):
            n = cuts.count(v)
            if not bounds or bounds[-1] != v:
                bounds.append(v)
                parts.append(1)
            if n > 1:
                bounds.append(v + 1)
                parts[-1:] = [n + 1, 1]
        self.bounds, self.parts = np.array(bounds, np.int64), np.array([*parts, max(1, nulls)], np.int64)
        after = np.cumsum(self.parts[-2::-1])[::-1]
        self.first = np.array([*after[1:], 0, after[0]], np.int64)

    def place(self, ids: np.ndarray, none: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.where(none, len(self.first) - 1, np.searchsorted(self.bounds, ids, side="right"))
        return (self.first[at] + (((hashes >> 32) + (1 << 31)) * self.parts[at] >> 32)).astype(np.int32)


def ranges(docs: DataFrame, id: str, n: int) -> Ranges:
    """About n ranges with about equal numbers of rows."""
    known = F.count(id)
    at = F.percentile_approx(id, [i / n for i in range(1, n)], max(10_000, 20 * n)) if n > 1 else F.lit(None).cast("array<long>")
    row = docs.agg(at.alias("x"), known.alias("known"), F.count("*").alias("n")).first()
    return Ranges(row["x"] or [], -(-n * (row["n"] - row["known"]) // max(1, row["n"])))


def with_next(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, _text, _hash, _range, _peek) dealt to ranges and sorted by falling id in each; null ids come last.

    Each range ends with a copy (_peek) of the first row of the next range, the last range with one of the very first
    row, so that who reads a range in order sees every row's next row. Rows of one id are in the order of their texts'
    hashes, then of their texts. Ids are whole numbers; others raise TypeError.
    """
    spark = docs.sparkSession
    if dict(docs.dtypes)[id] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id} must hold whole numbers, not {dict(docs.dtypes)[id]}")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).cast("long").alias("_id"), body.alias("_text"), F.xxhash64(body).alias("_hash"))
    held = ranges(rows, "_id", partitions(spark))

    @F.arrow_udf("int")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, hashes in batches:
            yield pa.array(held.place(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), hashes.to_numpy()))

    dealt = rows.withColumn("_range", place(F.col("_id"), F.col("_hash")))
    head = F.min(F.struct(F.bitwise_not("_id").alias("i"), F.col("_hash").alias("h")))
    heads = sorted((r["_range"], r["m"]["i"], r["m"]["h"]) for r in dealt.groupBy("_range").agg(head.alias("m")).collect())
    if not heads:
        return dealt.withColumn("_peek", F.lit(False))
    to = [(heads[i][0], heads[(i + 1) % len(heads)][1], heads[(i + 1) % len(heads)][2]) for i in range(len(heads))]
    named = small_table(spark, to, (("_to", pa.int32()), ("_i", pa.int64()), ("_h", pa.int64())))  # a row for each range
    firsts = rows.join(F.broadcast(named), (F.col("_hash") == F.col("_h")) & F.bitwise_not("_id").eqNullSafe(F.col("_i")))
    peeks = firsts.groupBy(F.col("_to").alias("_range"), "_id", "_hash").agg(F.min("_text").alias("_text")).select("_id", "_text", "_hash", "_range")
    both = dealt.withColumn("_peek", F.lit(False)).unionByName(peeks.withColumn("_peek", F.lit(True)))
    return both.repartition(partitions(spark), "_range").sortWithinPartitions("_range", "_peek", F.col("_id").desc_nulls_last(), "_hash", "_text")
