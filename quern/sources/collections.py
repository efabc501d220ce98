"""Collections of records: folders of JSON or Parquet under a base path that Spark reads and writes."""

from __future__ import annotations

import json
from dataclasses import asdict
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import config as settings


class Collections:
    """create, save, load, list, drop, backup, restore and health of a base path's collections.

    Files are handled through Hadoop's file systems, so that the base may be in any store that Spark reaches.
    """

    def __init__(self, spark: SparkSession, base: str, format: str = "json") -> None:
        self.spark, self.base, self.format = spark, base.rstrip("/"), format

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return bool(self._fs().exists(self._path(name)))

    def create(self, name: str) -> bool:
        """False if the collection is there already."""
        return not self.exists(name) and bool(self._fs().mkdirs(self._path(name)))

    def drop(self, name: str) -> bool:
        return bool(self._fs().delete(self._path(name), True))

    def names(self) -> list[str]:
        if not self._fs().exists(self._path()):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path()) if s.isDirectory())

    def save(self, name: str, rows: DataFrame) -> None:
        """Replaces the collection. Rows must not be read from it."""
        rows.write.mode("overwrite").format(self.format).save(f"{self.base}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").format(self.format).save(f"{self.base}/{name}")

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.format(self.format)
        return (reader.schema(schema) if schema is not None else reader).load(f"{self.base}/{name}")

    def backup(self, to: str, schemas: dict | None = None) -> list[str]:
        """Each collection written to another base; the names written."""
        other = Collections(self.spark, to, self.format)
        done = []
        for n in self.names():
            if self._fs().getContentSummary(self._path(n)).getFileCount():
                other.save(n, self.load(n, (schemas or {}).get(n)))
                done.append(n)
        return done

    def restore(self, source: str, schemas: dict | None = None) -> list[str]:
        return Collections(self.spark, source, self.format).backup(self.base, schemas)

    def put(self, name: str, id: str, value: dict) -> None:
        """A small entry by id, such as a configuration or the metadata of an index; an older one is replaced."""
        self.spark.range(1).select(F.lit(id).alias("id"), F.lit(json.dumps(value)).alias("value")).write.mode("overwrite").json(f"{self.base}/{name}/{quote(id, safe='')}")

    def entry(self, name: str, id: str) -> dict | None:
        where = f"{name}/{quote(id, safe='')}"
        return json.loads(self.spark.read.schema("id string, value string").json(f"{self.base}/{where}").first()["value"]) if self.exists(where) else None

    def discard(self, name: str, id: str) -> bool:
        return self.drop(f"{name}/{quote(id, safe='')}")

    def entries(self, name: str) -> list[str]:
        """The ids of all entries, in order."""
        if not self.exists(name):
            return []
        return sorted(unquote(s.getPath().getName()) for s in self._fs().listStatus(self._path(name)) if s.isDirectory())

    def save_config(self, id: str, config) -> None:
        """Any of the package's settings."""
        self.put("configs", id, {"kind": type(config).__name__, **asdict(config)})

    def config(self, id: str):
        """The settings saved under an id, of their own class, or None."""
        held = self.entry("configs", id)
        if held is None:
            return None
        kind = getattr(settings, held.pop("kind"))
        return kind(**held | ({"text": settings.TextConfig(**held["text"])} if "text" in held else {}))

    def is_healthy(self) -> bool:
        return bool(self._fs().exists(self._path()))

    def stats(self) -> DataFrame:
        """(collection, files, bytes) by the store's own listing, no file read."""
        rows = [(n, s.getFileCount(), s.getLength()) for n in self.names() for s in [self._fs().getContentSummary(self._path(n))]]
        names, files, sizes = zip(*rows, strict=True) if rows else ((), (), ())
        return self.spark.createDataFrame(pa.table({"collection": pa.array(names, pa.string()), "files": pa.array(files, pa.int64()), "bytes": pa.array(sizes, pa.int64())}))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): a row for each file, such as prompt templates."""
    return spark.read.text(path, wholetext=True)


def load_prompt(spark: SparkSession, path: str) -> str:
    """One template from a file that Spark reads."""
    return read_text(spark, path).first()["value"]


def shape(rows: DataFrame) -> DataFrame:
    """Non-null values of each column, of a whole collection in one pass."""
    return rows.agg(*[F.count(c).alias(c) for c in rows.columns])
