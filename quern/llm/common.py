"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import shared_folder

#: A word is a maximal run of other characters than these six.
SPACES = " \t\n\x0b\x0c\r"
#: Rows that a function in Python turns into objects at a time; Spark bounds a batch itself by bytes.
ROWS_AT_ONCE = 128
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def words(text: Column) -> Column:
    """Array of the words; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def n_words(text: Column) -> Column:
    """Number of words, without building them: how many words start."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


#: Narrow rows that one file of an intermediate table holds, if their number is known.
ROWS_A_FILE = 200_000


def stable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows, kept as files in the folder of spark.checkpoint.dir, so that a lost executor loses none of them.

    ``rows`` is how many narrow rows go into the last stage: it then has a task for each ``ROWS_A_FILE`` of them, but
    no more than it would have, so that small tables are not many small files (each takes four processes to write).
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).checkpoint()


def values(batches: Iterable[pa.Array], rows: int = ROWS_AT_ONCE) -> Iterator[list]:
    """The batches as lists of Python values, few rows at a time.

    Who yields a result for each list holds few whole texts and results beside Spark's batch, whatever its size.
    """
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows).to_pylist()


def structs(rows: Sequence[tuple], fields: Sequence[tuple[str, pa.DataType]]) -> pa.StructArray:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def small_table(spark: SparkSession, rows: Sequence[tuple], fields: Sequence[tuple[str, pa.DataType]]) -> DataFrame:
    """A table of the driver's rows as a local relation: no Python worker makes it, and Spark knows its size for joins."""
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: list = [None, None]


def per_worker(key: object, make: Callable[[], object]) -> object:
    """Kept in a Python worker until another operator's value takes its place, so that they don't add up."""
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        _HELD[:] = [key, make()]
    return _HELD[1]


def own_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_fields(df: DataFrame, struct: Column, names: Iterable[str]) -> DataFrame:
    """The table with the fields of a struct, computed once, in place of its columns of these names."""
    held = own_name(df, "_held")
    return df.withColumn(held, struct).withColumns({n: F.col(held)[n] for n in names}).drop(held)
