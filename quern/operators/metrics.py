"""Metrics from rows of observations, a metric for each name, and their text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.running import running_total


def counters(rows: DataFrame, name: str, delta: str | None = None) -> DataFrame:
    return rows.groupBy(F.col(name).alias("name")).agg((F.sum(delta) if delta else F.count("*")).alias("value"))


def gauges(rows: DataFrame, name: str, value: str, ts: str, id: str) -> DataFrame:
    """The last value of each; of one time, that of the largest id."""
    return rows.groupBy(F.col(name).alias("name")).agg(F.max_by(value, F.struct(ts, id)).alias("value"))


def running_gauge(rows: DataFrame, name: str, delta: str, ts: str, id: str) -> DataFrame:
    """The value of each metric after each change. Changes of one hour are sorted together, not those of a metric."""
    return running_total(rows, name, F.date_trunc("hour", F.col(ts)), [F.asc_nulls_first(ts), F.col(id)], F.col(delta), "value")


def histograms(rows: DataFrame, name: str, value: str, quantiles: bool = False) -> DataFrame:
    """(name, count, sum, mean, min, max), 0 where nothing was observed; approximate quantiles as an extension."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    parts = {"count": F.count(value), "sum": zero(F.sum(value)), "mean": zero(F.avg(value)), "min": zero(F.min(value)), "max": zero(F.max(value))}
    if quantiles:
        parts |= {"p50": F.percentile_approx(value, 0.5), "p99": F.percentile_approx(value, 0.99)}
    return rows.groupBy(F.col(name).alias("name")).agg(*[f.alias(k) for k, f in parts.items()])


def timers(rows: DataFrame, name: str, nanoseconds: str) -> DataFrame:
    """(name, count, total_ms, avg_ms, min_ms, max_ms)"""
    ms = F.col(nanoseconds) / 1e6
    return rows.groupBy(F.col(name).alias("name")).agg(F.count(nanoseconds).alias("count"), F.sum(ms).alias("total_ms"), F.avg(ms).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))


def histogram_text(h: DataFrame) -> DataFrame:
    full = F.format_string("histogram{count=%d,sum=%.2f,min=%.2f,max=%.2f,mean=%.2f}", "count", "sum", "min", "max", "mean")
    return h.select("name", F.when(F.col("count") > 0, full).otherwise("histogram{count=0,sum=0.00}").alias("text"))


def timer_text(t: DataFrame) -> DataFrame:
    return t.select("name", F.format_string("timer{count=%d,total_ms=%.3f,avg_ms=%.3f,min_ms=%.3f,max_ms=%.3f}", "count", "total_ms", "avg_ms", "min_ms", "max_ms").alias("text"))


def counter_text(c: DataFrame) -> DataFrame:
    return c.select("name", F.format_string("counter{value=%d}", "value").alias("text"))


def gauge_text(g: DataFrame) -> DataFrame:
    return g.select("name", F.format_string("gauge{value=%.2f}", "value").alias("text"))


def prometheus(kind: str, metrics: DataFrame) -> DataFrame:
    """(name, text): the exposition block of each metric. kind: counter, gauge, histogram or timer."""
    shown = "histogram" if kind == "timer" else kind
    head = F.format_string(f"# HELP %s {kind} metric\n# TYPE %s {shown}\n", "name", "name")
    if kind in ("counter", "gauge"):
        value = F.col("value").cast("string") if kind == "counter" else F.format_string("%.6f", F.col("value"))
        body = F.concat("name", F.lit(" "), value, F.lit("\n\n"))
    else:
        total = F.col("total_ms") / 1000 if kind == "timer" else F.col("sum")
        body = F.format_string("%s_count %d\n%s_sum %.6f\n\n", F.col("name"), F.col("count"), F.col("name"), total)
    return metrics.select("name", F.concat(head, body).alias("text"))


def exposition(blocks: DataFrame) -> DataFrame:
    """One text of all blocks by name: a few for each metric, not for each observation."""
    return blocks.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "text"))), lambda x: x["text"]), "").alias("text"))


def as_json(metrics: DataFrame) -> DataFrame:
    return metrics.select("name", F.to_json(F.struct(*[c for c in metrics.columns if c != "name"])).alias("json"))


def requests(rows: DataFrame, group: str, latency: str, ok) -> DataFrame:
    """(group, total, successful, failed, min, max and mean latency, success_rate in percent)"""
    n = F.count("*")
    return rows.groupBy(group).agg(
        n.alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"), F.avg(latency).alias("avg_latency"), (100.0 * F.count_if(ok) / n).alias("success_rate"),
    )
