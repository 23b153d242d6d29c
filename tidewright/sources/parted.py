"""Parquet tables whose parts are replaced all at once: a manifest names the live folder of each part.

A write first puts its rows into new folders, which nobody reads yet. The commit is one small file, the next manifest, created
only if no other writer has made it meanwhile; from then on readers see the new parts, and before that the old ones, whatever
happens in between. Folders that are no longer named are removed a few commits later, so running readers keep what they read.
Bytes written follow the parts that change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commits whose folders stay for readers that began before them.
KEPT = 2


class PartedTable:
    """The table at path, parted by the values of `parts` (columns that stay in the rows)."""

    def __init__(self, spark: SparkSession, path: str, parts: list[str]) -> None:
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _load(self, version: int) -> dict | None:
        """A manifest; None if it is not there or was left half-written."""
        file = self._hadoop(f"{self.path}/manifest/{version:012d}.json")
        if not self._fs.exists(file):
            return None
        stream = self._fs.open(file)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def manifest(self) -> dict:
        """{version, parts: {key: {values, folder}}, schema, note, dropped} of the last commit."""
        folder = self._hadoop(f"{self.path}/manifest")
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(folder)), reverse=True) if self._fs.exists(folder) else []
        for name in names:
            if name.endswith(".json") and (found := self._load(int(name[:-5]))):
                return found
        return {"version": -1, "parts": {}, "schema": None, "note": {}, "dropped": []}

    def write(self, rows: DataFrame) -> dict:
        """Rows in new folders, one for each part: {key: {values, folder}}. Not yet part of the table."""
        key = F.md5(F.to_json(F.struct(*self.parts), {"ignoreNullFields": "false"}))
        keyed = rows.withColumn("_part", key)
        base = f"{self.path}/data/{uuid.uuid4().hex}"
        keyed.repartition("_part").write.partitionBy("_part").parquet(base)
        values = [F.col(c).cast("string").alias(c) for c in self.parts]
        there = keyed.select("_part", *values).distinct().collect()  # a row for each part
        return {r["_part"]: {"values": [r[c] for c in self.parts], "folder": f"{base}/_part={r['_part']}"} for r in there}

    def commit(self, new: dict, gone: Callable[[list[str]], bool] = lambda values: False, schema: str | None = None, note: dict | None = None) -> int:
        """Make the parts of `new` live in place of those of the same key, and let the parts go whose values `gone` names; returns
        the number of parts that went."""
        last = self.manifest()
        kept = {k: p for k, p in last["parts"].items() if k not in new and not gone(p["values"])}
        dropped = [p["folder"] for k, p in last["parts"].items() if k not in kept]
        version = last["version"] + 1
        body = {"version": version, "parts": kept | new, "schema": schema or last["schema"], "note": last["note"] | (note or {}), "dropped": dropped}
        out = self._fs.create(self._hadoop(f"{self.path}/manifest/{version:012d}.json"), False)  # fails if another writer came first
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        old = self._load(version - KEPT)
        for folder in old["dropped"] if old else []:
            self._fs.delete(self._hadoop(folder), True)
        return sum(k not in new for k in last["parts"] if k not in kept)

    def replace(self, rows: DataFrame, note: dict | None = None) -> None:
        """The parts that rows has, as rows has them; other parts stay."""
        self.commit(self.write(rows), schema=rows.schema.json(), note=note)

    def read(self, wanted: Callable[[list[str]], bool] = lambda values: True, schema=None) -> DataFrame:
        """Rows of the live parts whose values are wanted; only their folders are read."""
        from pyspark.sql.types import StructType

        now = self.manifest()
        schema = StructType.fromJson(json.loads(now["schema"])) if now["schema"] else schema
        folders = sorted(p["folder"] for p in now["parts"].values() if wanted(p["values"]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)
