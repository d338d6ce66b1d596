"""The store: immutable generations of Parquet tables behind one manifest.

A generation is written completely into a folder of its own; then the manifest, a one-row table in a numbered folder, is
written last. Readers take the highest manifest, so they see a whole generation or the one before, and a writer that
dies leaves nothing that is read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from callweave.schema import TABLES, schema


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
        return sorted(int(p.getName()) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def generation(self) -> int:
        """The number of the current generation; 0 before the first write."""
        return max(self._numbers(), default=0)

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Writes ``tables`` as the next generation; relations that aren't given are taken over by reference."""
        now = self.generation()
        new, places = now + 1, self._places(now)
        for name, df in tables.items():
            place = f"{self.folder}/gen={new}/{name}"
            df.write.mode("overwrite").parquet(place)
            places[name] = place
        self.spark.createDataFrame([(new, json.dumps(places))], "generation long, places string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifests/{new}")
        return new

    def _places(self, generation: int) -> dict[str, str]:
        if not generation:
            return {}
        return json.loads(self.spark.read.schema("generation long, places string").json(f"{self.folder}/manifests/{generation}").first().places)

    def tables(self) -> set[str]:
        """The relations that the current generation has."""
        return set(self._places(self.generation()))

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        """A relation of a generation, the current one by default; missing columns are null, a missing table is empty."""
        place = self._places(self.generation() if generation is None else generation).get(table)
        kind = schema(table) if table in TABLES else None
        if place is None:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.parquet(place) if kind is None else self.spark.read.schema(kind).parquet(place)
