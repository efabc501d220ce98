"""Mixing sources to target weights by entropy balancing.

Among all rates that give every source its target in words, those nearest to taking each document once (in relative
entropy, between 0 and ``MOST`` copies) are exponential in a document's size: min(MOST, exp(lambda * size)), with one
lambda for each source. Newton steps on the dual find the lambdas. Each step is one aggregation over the table of
sizes (source, size, number), which grows with the length of texts rather than their number. A solution not yet
bracketed is reached for at distances that double; once it is, a step that leaves the bracket, or follows one that did
not halve the miss, halves the bracket instead. Steps go on until every target is met; one that cannot be is an error.
Sums are exact decimals, so reruns agree.

Rates become copies by systematic rounding along each source's documents in order of size: the copies up to any
document are the rates up to it, rounded, from a start chosen among ``STARTS`` as the nearest to the target. The words
taken are then off by less than the longest document. A group of one source and size is dealt to buckets, so that
many equal rows never meet in one task.

Null and empty texts have size 0 and are taken once. Null sources are one source, the last. Repeated rows count each;
rows that tie in id and text are interchangeable. A text of any length is one row, whole or not at all. An empty table
gives no rows. Columns named size, source_size, target, copies and taken are replaced, all others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import n_words, own_name, small_table, stable, uniform

MOST = 3
UNIT = 1 << 20
STARTS = 16
BUCKET_ROWS = 5000
KEYS = ["_none", "_source", "size", "_bucket"]


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = (1, 2, 3), most: int = MOST) -> dict[str | None, float]:
    """Shares all words among sources by weight, none above ``most`` times its own words."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    own = dict(order)
    out, left, open_ = {}, float(sum(own.values())), [s for s, _ in order]
    while open_:
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > most * own[s]]
        if not full:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: float(most * own[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def _rate(size: Column, slope: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(size * slope, F.lit(math.log(most) + 1))))


KEY_FIELDS = (("_none", pa.bool_()), ("_source", pa.string()))


def _source_rows(spark, rows: list[tuple], *fields: tuple[str, pa.DataType]) -> DataFrame:
    """A small table with a row for each source."""
    return small_table(spark, rows, (*KEY_FIELDS, *fields))


def balance(cells: DataFrame, goals: dict[tuple[bool, str], tuple[float, int, float]], most: int = MOST) -> dict[tuple[bool, str], float]:
    """The slopes. cells: (_none, _source, size, n). goals: target, words and mean size of each source."""
    spark = cells.sparkSession
    slope, low, high, reach, miss, open_ = {}, {}, {}, {}, {}, {}
    for key, (target, words, mean) in goals.items():
        if words == 0 or target >= most * words * (1 - 1e-12):
            slope[key] = 1e6  # everything as often as allowed
        elif target <= 0:
            slope[key] = -1e6
        else:
            slope[key], low[key], high[key], reach[key], miss[key], open_[key] = 0.0, -math.inf, math.inf, 0.5 / mean, math.inf, target
    amount = F.col("n") * F.col("size")
    while open_:
        at = _source_rows(spark, [(*k, slope[k]) for k in open_], ("slope", pa.float64()))
        rate = _rate(F.col("size"), F.col("slope"), most)
        inner = F.when(F.col("size") * F.col("slope") < math.log(most), amount * F.col("size") * rate).otherwise(0.0)
        sums = cells.filter("size > 0").join(at, ["_none", "_source"]).groupBy("_none", "_source")
        got = sums.agg(F.sum((amount * rate).cast("decimal(38,8)")).alias("f"), F.sum(inner.cast("decimal(38,4)")).alias("d"))
        for r in got.collect():
            key = (r["_none"], r["_source"])
            target, words, x = open_[key], float(r["f"]), slope[key]
            gap = words - target
            if abs(gap) <= 1e-9 * target + 1e-6:
                del open_[key]
                continue
            (high if gap > 0 else low)[key] = x
            reach[key] *= 2
            a, b = max(low[key], x - reach[key]), min(high[key], x + reach[key])
            if math.isfinite(low[key]) and math.isfinite(high[key]):
                a, b = low[key], high[key]
                other = (a + b) / 2
            else:
                other = a if gap > 0 else b
            step = x + math.log(target / words) * words / float(r["d"]) if words and r["d"] else math.nan
            if not a < step < b or abs(gap) > miss[key] / 2:
                step = other
            if step in (low[key], high[key]) or gap > 0 and x < -800 or gap < 0 and x > math.log(most):  # no double between, or all rates are 0 or the most
                raise ArithmeticError(f"no rates give source {key[1]!r} its {target} words; the nearest gave {words}")
            slope[key], miss[key] = step, abs(gap)
    return slope


RESULTS = ("size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", weights: Sequence[int] = (1, 2, 3), most: int = MOST, seed: int = 11) -> DataFrame:
    """The rows with size, source_size, target, copies (0 to ``most``) and taken (size times copies)."""
    spark, name = docs.sparkSession, own_name(docs, "_row")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    n = docs.count()
    buckets = 1 + n // BUCKET_ROWS
    # the caller's columns are one struct from here, so that none of their names can clash with those of the plan
    rows = docs.select(
        F.struct(*rest).alias(name),
        n_words(F.col(text)).alias("size"),
        F.col(source).isNull().alias("_none"),
        F.coalesce(F.col(source), F.lit("")).alias("_source"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id), F.col(text)), buckets).alias("_bucket"),
        F.struct(uniform(seed, F.col(id), F.col(text)), F.col(id), F.xxhash64(F.col(text))).alias("_order"),
    )
    parts = stable(rows.groupBy(*KEYS).agg(F.count("*").alias("n")), n)
    cells = stable(parts.groupBy("_none", "_source", "size").agg(F.sum("n").alias("n")), n)
    known = cells.groupBy("_none", "_source").agg(F.sum(F.col("n") * F.col("size")).alias("w"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("k")).collect()
    wanted = targets([(None if r["_none"] else r["_source"], r["w"]) for r in known], weights, most)
    goals = {(r["_none"], r["_source"]): (wanted[None if r["_none"] else r["_source"]], r["w"], r["w"] / (r["k"] or 1)) for r in known}
    slopes = balance(cells, goals, most)

    # rates in whole units, added up in order of size; then the start that comes nearest to the target
    plan = _source_rows(spark, [(*k, slopes[k]) for k in goals], ("slope", pa.float64()))
    unit = F.when(F.col("size") > 0, F.round(_rate(F.col("size"), F.col("slope"), most) * UNIT)).otherwise(UNIT).cast("long")
    along = Window.partitionBy("_none", "_source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    lined = cells.join(plan, ["_none", "_source"]).withColumn("unit", unit)
    lined = stable(lined.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("unit")).over(along), F.lit(0))).drop("slope"), n)
    starts = [int((j + 0.5) * UNIT / STARTS) for j in range(STARTS)]
    taken = [F.sum(F.col("size") * (F.shiftright(F.col("before") + F.col("n") * F.col("unit") + s, 20) - F.shiftright(F.col("before") + s, 20))).alias(f"t{j}") for j, s in enumerate(starts)]
    tried = {(r["_none"], r["_source"]): r for r in lined.groupBy("_none", "_source").agg(*taken).collect()}
    best = {k: min(range(STARTS), key=lambda j: (abs(tried[k][f"t{j}"] - goals[k][0]), j)) for k in goals}  # noqa: B023
    begin = _source_rows(
        spark, [(*k, w, t, starts[best[k]]) for k, (t, w, _) in goals.items()], ("source_size", pa.int64()), ("target", pa.float64()), ("start", pa.int64())
    )

    inside = Window.partitionBy("_none", "_source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n")
    placed = placed.join(lined.drop("n"), ["_none", "_source", "size"]).join(begin, ["_none", "_source"])
    placed = placed.select(*KEYS, "source_size", "target", "unit", (F.col("before") + F.col("start") + F.col("earlier") * F.col("unit")).alias("from"))

    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("_order"))
    end = F.col("from") + F.col("place") * F.col("unit")
    copies = (F.shiftright(end, 20) - F.shiftright(end - F.col("unit"), 20)).cast("long")
    out = rows.withColumn("place", place).join(placed, KEYS).withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(f"{name}.*", *RESULTS)


def repeat_rows(docs: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as its copies say."""
    name = own_name(docs, "_copy")
    return docs.withColumn(name, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).drop(name)
