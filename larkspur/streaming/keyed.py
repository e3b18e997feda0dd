"""A table by key that a stream keeps up to date: a batch rewrites only the parts that hold its keys, and a batch that is replayed changes nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import get_text, names_in, put_text


class KeyedTable:
    """Rows by ``keys`` in ``parts`` parts by the keys' hash, under ``path``.

    ``data/batch=<id>/part=<n>`` holds a part as of a batch, ``versions/<id>`` which batch's files each part stands in. A batch writes the parts of its keys, each as it was with the batch's
    rows in place of older ones, and then its version; readers take the newest version, so they see whole batches only.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path, keys, parts

    def version(self) -> tuple[int, dict[int, int]]:
        """The newest batch, -1 before the first, and the batch that each part was last written by."""
        held = [int(x) for x in names_in(self.spark, f"{self.path}/versions") if x.isdigit()]
        if not held:
            return -1, {}
        return max(held), {int(k): v for k, v in json.loads(get_text(self.spark, f"{self.path}/versions/{max(held):012d}")).items()}

    def _folders(self, at: dict[int, int]) -> list[str]:
        return [f"{self.path}/data/batch={b}/part={p}" for p, b in sorted(at.items())]

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Put ``rows``, one a key, in place; whether the batch was new. Batches come in rising order, as a stream's do."""
        newest, at = self.version()
        if batch <= newest:
            return False
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        rows = rows.withColumn("part", part).persist()
        try:
            touched = {r.part for r in rows.select("part").distinct().collect()}  # at most ``parts``
            merged, old = rows, {p: b for p, b in at.items() if p in touched}
            if old:
                held = self.spark.read.schema(rows.schema).option("basePath", f"{self.path}/data").parquet(*self._folders(old)).drop("batch")
                new = rows.select("part", *(F.col(k).alias(f"_{k}") for k in self.keys))
                same = held["part"] == new["part"]
                for k in self.keys:
                    same &= held[k].eqNullSafe(new[f"_{k}"])
                merged = held.join(new, same, "left_anti").unionByName(rows)
            merged.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/batch={batch}")
        finally:
            rows.unpersist()
        put_text(self.spark, f"{self.path}/versions/{batch:012d}", json.dumps({**at, **dict.fromkeys(touched, batch)}))
        return True

    def read(self, schema) -> DataFrame:
        """The newest version; ``schema`` is that of the rows merged."""
        _, at = self.version()
        if not at:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.option("basePath", f"{self.path}/data").parquet(*self._folders(at))
        return found.select(*(F.col(f.name).cast(f.dataType) for f in schema))

    def sink(self, stream: DataFrame, progress: str):
        """A writer that merges each batch of changed rows of ``stream``, which is in update mode."""
        return stream.writeStream.outputMode("update").option("checkpointLocation", progress).foreachBatch(lambda rows, batch: self.merge(rows, batch) and None)
