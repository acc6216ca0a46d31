"""A table of the latest row of each key, kept as an append-only log.

Every change is a row in files of its own, so writers never rewrite what others
wrote: two at once both keep their rows, and the later time wins for a key that
both changed. ``compact`` folds old files into one set, and only then are files
removed. A row that removes a key is a row with ``gone``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledeforge.runtime import hadoop_path

META = "at timestamp, gone boolean, write_id string"


class KeyedLog:
    """Rows of ``schema`` (a DDL string) under ``path``, keyed by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = f"{schema}, {META}"
        self.kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
        self.columns = list(self.kinds)

    def _writes(self) -> list[str]:
        """Finished writes: a folder without Spark's mark of success is one that failed or still runs."""
        fs, root = hadoop_path(self.spark, self.path)
        if not fs.exists(root):
            return []
        return sorted(s.getPath().toString() for s in fs.listStatus(root) if fs.exists(hadoop_path(self.spark, f"{s.getPath().toString()}/_SUCCESS")[1]))

    def _append(self, rows: DataFrame, at: Column, gone: bool) -> str:
        name = uuid.uuid4().hex
        out = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in self.kinds.items()), at.alias("at"), F.lit(gone).alias("gone"), F.lit(name).alias("write_id"))
        out.write.parquet(f"{self.path}/{name}")
        return name

    def put(self, rows: DataFrame, at: Column) -> str:
        """Sets the rows of some keys at a time; other keys stay as they are."""
        return self._append(rows, at, False)

    def remove(self, keys: DataFrame, at: Column) -> str:
        """Removes some keys at a time."""
        return self._append(keys.select(*self.keys), at, True)

    def history(self) -> DataFrame:
        paths = self._writes()
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        """The standing row of each key, with ``at``. At equal times a removal wins, else the write of the larger id."""
        place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("at"), F.desc("gone"), F.desc("write_id"), *(F.desc(c) for c in self.columns if c not in self.keys)))
        return self.history().withColumn("_n", place).filter((F.col("_n") == 1) & ~F.col("gone")).select(*self.columns, "at")

    def compact(self) -> None:
        """Folds what is there into one write. Writes that end meanwhile stay; a crash leaves rows twice at most, which changes no answer."""
        old = self._writes()
        if len(old) < 2:
            return
        name = uuid.uuid4().hex
        place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("at"), F.desc("gone"), F.desc("write_id"), *(F.desc(c) for c in self.columns if c not in self.keys)))
        rows = self.spark.read.schema(self.schema).parquet(*old).withColumn("_n", place).filter("_n = 1").drop("_n")
        rows.write.parquet(f"{self.path}/{name}")
        for p in old:
            fs, gone = hadoop_path(self.spark, p)
            fs.delete(gone, True)
