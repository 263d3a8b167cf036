"""NDJSON to an index's log: each micro-batch writes its good documents with their sequence and its bad lines beside them. The
stream's checkpoint takes the place of a write-ahead log, the trigger that of a commit clock; readers see the latest row of each id."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from querylark.functions import values
from querylark.operators.writes import latest
from querylark.schema import JSON, SPARK, Schema

COMMIT_INTERVAL = "2 seconds"


def parsed(lines: DataFrame, schema: Schema) -> DataFrame:
    """text, the document r by declared types, and problem: why the line is refused, in which case r is null. A value that doesn't fit its
    field refuses its line and is named; null and missing values are none. Blank lines are left out."""
    own = lines.filter(F.trim("text") != "").withColumn("v", F.try_parse_json("text"))
    kept = [f for f in schema.fields if not f.ghost]
    values_, tests = [], [F.when(F.col("v").isNull() | ~F.trim("text").startswith("{"), F.lit("no JSON object"))]
    for f in kept:
        raw = F.try_variant_get(F.col("v"), f"$['{f.name}']", "variant")
        there = raw.isNotNull() & ~F.is_variant_null(raw)
        kind = F.schema_of_variant(raw)
        if f.many:
            several = F.when(kind.startswith("ARRAY"), F.try_variant_get(F.col("v"), f"$['{f.name}']", "array<variant>")).otherwise(F.array(raw))
            value = F.transform(several, lambda e, t=f.type: values.json_value(e, t))
            bad = F.exists(F.arrays_zip(several.alias("a"), value.alias("b")), lambda p: p["a"].isNotNull() & ~F.is_variant_null(p["a"]) & p["b"].isNull())
        else:
            value = values.json_value(raw, f.type)
            said = F.try_variant_get(raw, "$", "string")
            bad = (value.isNull() & ~F.coalesce(values.is_missing(said) | (F.trim(said) == ""), F.lit(False))) | (kind.rlike("^(OBJECT|ARRAY)") & F.lit(f.type != JSON))
        shown = F.coalesce(F.to_json(raw), F.lit(""))
        tests.append(F.when(there & bad, F.concat(F.lit(f"{f.name}: "), shown, F.lit(f" is no {f.type}"))))
        values_.append(F.when(there, value).cast(T.ArrayType(SPARK[f.type]) if f.many else SPARK[f.type]).alias(f.name))
    r = F.struct(*values_)
    own = own.withColumn("r", r).withColumn("problem", F.coalesce(*tests, F.when(F.col("r.id").isNull() | (F.col("r.id").cast("string") == ""), F.lit("id: missing"))))
    return own.withColumn("r", F.when(F.col("problem").isNull(), F.col("r"))).drop("v")


def start(spark: SparkSession, source: str, log: str, rejected: str, checkpoint: str, schema: Schema, once: bool = False, interval: str = COMMIT_INTERVAL) -> StreamingQuery:
    """Follows a folder of NDJSON files. A batch that is written again after a failure overwrites its own folder, so rows come once."""

    def write(batch: DataFrame, number: int) -> None:
        # ties within a batch: the later file and line wins; lines are numbered within a split, and splits come by size
        rows = parsed(batch.withColumn("line", F.monotonically_increasing_id()), schema).persist(StorageLevel.DISK_ONLY)  # each line is parsed once for both folders
        good = rows.filter("r is not null").select("r.*", F.struct(F.lit(number).cast("long").alias("batch"), "at", "path", "start", "line").alias("seq"))
        good.write.mode("overwrite").parquet(f"{log}/batch={number}")
        rows.filter("r is null").select("text", "problem").write.mode("overwrite").json(f"{rejected}/batch={number}")
        rows.unpersist()

    place = [F.col(f"_metadata.{n}").alias(a) for n, a in (("file_modification_time", "at"), ("file_path", "path"), ("file_block_start", "start"))]
    lines = spark.readStream.text(source).select(F.col("value").alias("text"), *place)
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def snapshot(spark: SparkSession, log: str) -> DataFrame:
    """The latest document of each id."""
    return latest(spark.read.option("basePath", log).parquet(log).drop("batch")).drop("seq")
