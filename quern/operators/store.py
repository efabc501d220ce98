"""Queries and changes of a document store: filters, order, pages, upserts, metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Operators of conditions; the last five are an extension.
OPERATORS = {
    "equals": lambda x, v: x == v,
    "contains": lambda x, v: x.contains(v),
    "starts_with": lambda x, v: x.startswith(v),
    "less_than": lambda x, v: x < v,
    "greater_than": lambda x, v: x > v,
    "not_equals": lambda x, v: x != v,
    "less_than_or_equal": lambda x, v: x <= v,
    "greater_than_or_equal": lambda x, v: x >= v,
    "ends_with": lambda x, v: x.endswith(v),
    "in": lambda x, v: x.isin(list(v)),
}


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object


@dataclass(frozen=True)
class Query:
    """A page of ``limit`` rows after the first ``offset``; no limit (None) is all of them."""

    conditions: tuple[Condition, ...] = ()
    order_by: str | None = None
    ascending: bool = True
    limit: int | None = 100
    offset: int = 0


def predicate(df: DataFrame, conditions: Sequence[Condition]) -> Column:
    """All conditions; a field that the table lacks or a row has null makes one false."""
    each = [OPERATORS[c.operator](F.col(c.field), c.value) if c.field in df.columns else F.lit(False) for c in conditions]
    return F.coalesce(reduce(lambda a, b: a & b, each, F.lit(True)), F.lit(False))


def query(df: DataFrame, q: Query, id: str = "id") -> DataFrame:
    """Filter, order (by id if nothing else is asked, and among equals), one page or all rows."""
    order = [F.col(q.order_by).asc() if q.ascending else F.col(q.order_by).desc()] if q.order_by else []
    found = df.filter(predicate(df, q.conditions)).orderBy(*order, F.col(id).asc()).offset(q.offset)
    return found if q.limit is None else found.limit(q.limit)


def count(df: DataFrame, conditions: Sequence[Condition] = ()) -> DataFrame:
    return df.filter(predicate(df, conditions)).agg(F.count("*").alias("n"))


def get(df: DataFrame, value: object, id: str = "id") -> DataFrame:
    return df.filter(F.col(id) == F.lit(value))


def upsert(df: DataFrame, changes: DataFrame, id: str = "id", version: str | None = None) -> DataFrame:
    """The latest row of each id: of the changes before the table's, by ``version`` among several changes."""
    both = df.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("_new"), *([F.desc(version)] if version else [])]
    latest = Window.partitionBy(id).orderBy(*order)
    return both.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r", "_new")


def delete(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return df.join(ids.select(id), id, "left_anti")


def by_metadata(df: DataFrame, wanted: Mapping[str, str], metadata: str = "metadata") -> DataFrame:
    """Rows whose metadata map has all these values."""
    ok = reduce(lambda a, b: a & b, [F.try_element_at(F.col(metadata), F.lit(k)) == v for k, v in wanted.items()], F.lit(True))
    return df.filter(ok)


def to_records(docs: DataFrame, id: str = "doc_id", content: str = "text", fields: Sequence[str] = ("lang", "source")) -> DataFrame:
    """Documents as flat records: id, content and meta_<key> columns."""
    return docs.select(F.col(id).cast("string").alias("id"), F.col(content).alias("content"), *[F.col(f).cast("string").alias(f"meta_{f}") for f in fields])


def to_documents(records: DataFrame) -> DataFrame:
    """Records as documents: id, content and a map of the string metadata that is there."""
    keys = [c for c in records.columns if c.startswith("meta_")]
    pairs = F.array(*[F.struct(F.lit(k.removeprefix("meta_")).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    return records.select("id", "content", F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("metadata"))


def cached_embeddings(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Texts with their cached embedding or null; the hash narrows the join, the text decides."""
    key = F.xxhash64(F.col(text))
    held = cache.select(key.alias("_key"), F.col(text).alias("_text"), "embedding")
    asked = texts.withColumn("_key", key)
    return asked.join(held, (asked["_key"] == held["_key"]) & (asked[text] == held["_text"]), "left").drop("_key", "_text")


def field_text(kind: str, x: Column) -> Column:
    """A field as text: strings quoted, doubles with six places, times in ISO form, booleans 1 or 0."""
    return {
        "string": F.concat(F.lit('"'), x, F.lit('"')),
        "double": F.format_string("%.6f", x),
        "boolean": F.when(x, "1").otherwise("0"),
        "timestamp": F.concat(F.lit('"'), F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')),
    }.get(kind, x.cast("string"))
