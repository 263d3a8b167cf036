"""CSV, TSV, semicolon files, JSON, JSON Lines, gzip, zip and HTTP, recognised by content."""

from __future__ import annotations

import csv
import gzip
import io
import itertools
import json
import os
import urllib.request
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylark.schema import TYPE_OF

PREFIX = 64 << 10
PACKED = (".gz", ".gzip", ".zip")
BAD = "_bad"
#: Bytes of files that a sampling scan reads whole.
SAMPLE_WHOLE = 1 << 30


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def prefix_of(path: str, spark: SparkSession | None = None) -> str:
    """The first 64 KB of a file's text, decompressed by its ending; of a folder those of its first file. The driver reads no more than
    that, through Hadoop's file systems, so the path may be on any of them."""
    spark = spark or SparkSession.getActiveSession()
    where, fs = _hadoop(spark, path)
    if fs.getFileStatus(where).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(where) if not s.getPath().getName().startswith(("_", ".")))
        return prefix_of(names[0], spark)
    stream = fs.open(where)
    raw = bytes(stream.readNBytes(PREFIX))
    stream.close()
    if path.endswith(PACKED[:2]):
        raw = zlib.decompressobj(31).decompress(raw, PREFIX)
    elif path.endswith(".zip"):
        raw = _first_entry(raw)
    return raw.decode("utf-8", "ignore").removeprefix("\ufeff")


def _first_entry(raw: bytes) -> bytes:
    """The beginning of a zip's first file, from its local headers."""
    at = 0
    while raw[at : at + 4] == b"PK\x03\x04":
        method, size, name, extra = (int.from_bytes(raw[at + i : at + i + n], "little") for i, n in ((8, 2), (18, 4), (26, 2), (28, 2)))
        body = at + 30 + name + extra
        if raw[at + 30 + name - 1 : at + 30 + name] != b"/":
            return zlib.decompressobj(-15).decompress(raw[body:], PREFIX) if method else raw[body : body + (size or PREFIX)]
        at = body + size
    raise ValueError("no file in the zip")


def sniff_delimiter(text: str) -> str:
    """Of semicolon, tab and comma the most frequent on the first line; in a tie the earlier of these."""
    line = text.split("\n", 1)[0]
    return max(";\t,", key=lambda d: (line.count(d), -";\t,".index(d)))


def detect_format(text: str) -> str:
    """array, jsonl, schema, document or csv, by content alone."""
    t = text.lstrip()
    if t.startswith("["):
        return "array"
    if t.startswith("{"):
        lines = [x for x in t.split("\n") if x.strip()][:2]

        def whole(x: str) -> object:
            try:
                return json.loads(x)
            except ValueError:
                return None

        if len(lines) == 2 and all(isinstance(whole(x), dict) for x in lines):
            return "jsonl"
        found = whole(t)
        return "schema" if isinstance(found, dict) and "fields" in found else "document"
    return "csv"


def typed_header(names: list[str]) -> tuple[list[str], dict[str, str]]:
    """`price.f64` is the field price of type f64; an ending that names no type is part of the name."""
    out, types = [], {}
    for n in names:
        head, dot, tail = n.strip().rpartition(".")
        if dot and head and tail.lower() in TYPE_OF:
            types[head] = TYPE_OF[tail.lower()]
            n = head
        out.append(n.strip())
    return out, types


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """All columns as strings, and the types that the header names. Short rows are filled with nulls, spare cells dropped. A quoted cell
    may hold line breaks: files that have such a cell are read one to a task, others in splits; so are .zip and .gzip files."""
    prefix = prefix_of(path, spark)
    sep = delimiter or sniff_delimiter(prefix)
    if path.endswith(PACKED[1:]):
        names, types = typed_header(next(csv.reader(io.StringIO(prefix), delimiter=sep)))
        rows = unpacked(spark, path, sep).filter("row > 1")
        return rows.select(*[F.when(F.get("cells", F.lit(i)) != "", F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)]), types
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1  # a quote that the line doesn't close
    broken = not spark.read.text(path).filter(odd).isEmpty()
    df = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("multiLine", broken).option("escape", '"').csv(path)
    names, types = typed_header(df.columns)
    return df.toDF(*names), types


def unpacked(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """file, row, cells of .gzip files and of the first entry of each .zip; without sep a line is one cell. A file is unpacked in one
    task, in batches; rows are read as CSV, so quoted line breaks stay in their cell."""

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if name.endswith(".zip"):
                    z = zipfile.ZipFile(io.BytesIO(raw))
                    source = z.open(next(n for n in z.namelist() if not n.endswith("/")))
                else:
                    source = gzip.GzipFile(fileobj=io.BytesIO(raw))
                lines = io.TextIOWrapper(source, "utf-8-sig", "replace", newline="" if sep else None)
                rows = csv.reader(lines, delimiter=sep) if sep else ([x.rstrip("\n")] for x in lines)
                for first, cells in enumerate(iter(lambda: list(itertools.islice(rows, 10_000)), [])):
                    at = [first * 10_000 + i + 1 for i in range(len(cells))]
                    yield pa.RecordBatch.from_pydict({"file": [name] * len(cells), "row": at, "cells": cells}, schema=pa.schema([("file", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "file string, row long, cells array<string>")


def unwrap(df: DataFrame) -> DataFrame:
    """A document under the only key `doc` is taken out of it."""
    kinds = dict(df.dtypes)
    return df.select("doc.*") if [c for c in df.columns if c != BAD] == ["doc"] and kinds["doc"].startswith("struct") else df


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A document, or an array of them."""
    r = spark.read.option("multiLine", True)
    return unwrap(r.schema(schema).json(path) if schema is not None else r.json(path))


def read_jsonl(spark: SparkSession, path: str, schema=None) -> tuple[DataFrame, DataFrame]:
    """(documents, bad lines). A line that is no object is bad and doesn't stop the rest."""
    if path.endswith(PACKED[1:]):
        lines = unpacked(spark, path).select(F.get("cells", F.lit(0)).alias("text"))
        kinds = schema or spark.read.json(lines.filter(F.trim("text").startswith("{")).rdd.map(lambda r: r[0])).schema
        good = F.from_json("text", kinds)
        parsed = lines.withColumn("r", good)
        return unwrap(parsed.filter(F.trim("text").startswith("{")).select("r.*")), lines.filter(~F.trim("text").startswith("{"))
    lines = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    if schema is None:
        found = spark.read.option("columnNameOfCorruptRecord", BAD).json(path)
        schema = found.drop(BAD).schema
    parsed = lines.filter(F.trim("text") != "").select("file", "text", F.try_parse_json("text").isNotNull().alias("ok"), F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("r"))
    good = F.col("ok") & F.trim("text").startswith("{")
    return unwrap(parsed.filter(good).select("r.*")), parsed.filter(~good).select("file", "text")


def fetch(url: str, folder: str, timeout: float = 60.0, spark: SparkSession | None = None) -> str:
    """An HTTP(S) source, fetched once into a folder of any of Hadoop's file systems and read from there; on a cluster the folder has to be
    one that all executors reach."""
    spark = spark or SparkSession.getActiveSession()
    name = os.path.basename(url.split("?")[0]) or "source"
    to, fs = _hadoop(spark, f"{folder}/{name}")
    if not fs.exists(to):
        part, _ = _hadoop(spark, f"{folder}/.{name}.part")
        with urllib.request.urlopen(url, timeout=timeout) as r:
            out = fs.create(part, True)
            while block := r.read(1 << 20):
                out.write(bytearray(block))
            out.close()
        fs.rename(part, to)
    return to.toString() if "://" in folder else f"{folder}/{name}"


def sample(spark: SparkSession, path: str, rows: int = 100_000, seed: int = 1) -> tuple[DataFrame, dict[str, str]]:
    """A sampling scan for profiling: whole if the files have at most SAMPLE_WHOLE bytes, else a random share of rows that is expected to
    keep `rows` of them; the number of rows is estimated from the prefix and the files' sizes, so nothing is counted first."""
    df, types = read(spark, path)
    where, fs = _hadoop(spark, path)
    size, prefix = fs.getContentSummary(where).getLength(), prefix_of(path, spark)
    if size <= SAMPLE_WHOLE:
        return df, types
    expected = size / max(1.0, len(prefix.encode()) / max(1, prefix.count("\n")))
    return df.sample(False, min(1.0, rows / expected), seed), types


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Rows of a file of any of the formats, and the types that its header names."""
    kind = detect_format(prefix_of(path, spark))
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "jsonl":
        return read_jsonl(spark, path)[0], {}
    return read_json(spark, path), {}
