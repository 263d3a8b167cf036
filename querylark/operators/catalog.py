"""A registry of indexes: schema and versions as small JSON files, tables as Parquet, under one folder."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylark.operators.search import Index
from querylark.schema import Field, Ghost, Schema, SchemaError


def to_json(s: Schema) -> str:
    return json.dumps({"fields": [asdict(f) for f in s.fields], "default_fields": s.default_fields, "id_fields": s.id_fields, "routing": s.routing, "description": s.description, "version": s.version})


def from_json(text: str) -> Schema:
    d = json.loads(text)
    fields = []
    for f in d["fields"]:
        g = f.pop("ghost")
        if g:
            g = Ghost(g["source"], g["when"], *[tuple(g[k]) if g[k] is not None else None for k in ("within", "outside")])
        fields.append(Field(**f, ghost=g))
    return Schema(tuple(fields), tuple(d["default_fields"]), tuple(d["id_fields"]), d["routing"], d["description"], d["version"])


class Catalog:
    """Files are reached through Spark's Hadoop file system, so the folder may be on any of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path()) if fs.exists(self._path(s.getPath().getName(), "schema.json")))

    def _write(self, name: str, schema: Schema) -> None:
        out = self._fs().create(self._path(name, "schema.json"), True)
        out.write(bytearray(to_json(schema), "utf-8"))
        out.close()

    def schema(self, name: str) -> Schema:
        if name not in self.names():
            raise KeyError(f"no index '{name}'")
        return from_json(self.spark.read.text(f"{self.folder}/{name}/schema.json", wholetext=True).first()[0])

    def has_rows(self, name: str) -> bool:
        return self._fs().exists(self._path(name, "data")) and not self.spark.read.parquet(f"{self.folder}/{name}/data").isEmpty()

    def put_schema(self, name: str, schema: Schema) -> Schema:
        """A new schema; on an index that holds rows, fields that are built can't change their type or tokenizer."""
        if name in self.names():
            old = self.schema(name)
            if old.thumbprint() == schema.thumbprint():
                return old
            if self.has_rows(name):
                for f in schema.fields:
                    was = old.get(f.name)
                    if was is not None and was.indexed and (was.type, was.tokenizer, was.many) != (f.type, f.tokenizer, f.many):
                        raise SchemaError(f"index '{name}' holds documents, so field '{f.name}' can't change; rebuild it from an empty index")
            schema = Schema(schema.fields, schema.default_fields, schema.id_fields, schema.routing, schema.description, old.version + 1)
        self._write(name, schema)
        return schema

    def patch_schema(self, name: str, **changes) -> Schema:
        new = self.schema(name).patch(**changes)
        self._write(name, new)
        return new

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/data")

    def open(self, name: str) -> Index:
        return Index(name, self.spark.read.parquet(f"{self.folder}/{name}/data"), self.schema(name))

    def drop(self, name: str, keep_schema: bool = False) -> None:
        self._fs().delete(self._path(name, "data") if keep_schema else self._path(name), True)

    def rebuild(self, name: str, schema: Schema) -> Schema:
        if self.has_rows(name):
            raise SchemaError(f"index '{name}' holds documents")
        self._write(name, schema)
        return schema

    def listing(self) -> DataFrame:
        """name, version, fields, documents, bytes, thumbprint of each index."""
        rows = []
        for n in self.names():
            s = self.schema(n)
            there = self._fs().exists(self._path(n, "data"))
            rows.append((n, s.version, len(s.fields), self.spark.read.parquet(f"{self.folder}/{n}/data").count() if there else 0, self._fs().getContentSummary(self._path(n, "data")).getLength() if there else 0, s.thumbprint(), s.description))
        return self.spark.createDataFrame(rows, "name string, version int, fields int, documents long, bytes long, thumbprint string, description string")

    def totals(self) -> DataFrame:
        return self.listing().agg(F.count("*").alias("indexes"), F.sum("documents").alias("documents"), F.sum("fields").alias("fields"), F.sum("bytes").alias("bytes"))
