"""Snapshots, record queues and byte formats."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2
SIZE_LIMIT = 50 * 1024 * 1024
#: First bytes of known formats.
MAGIC = {"25504446": "pdf", "504B0304": "ofd", "FFD8FF": "image", "89504E47": "image", "424D": "image", "49492A00": "image", "4D4D002A": "image"}


def read_snapshot(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Records of a snapshot: an envelope with schemaVersion and invoices, or a bare list; pos keeps their order.

    A newer version is refused. Ids become texts.
    """
    envelope = T.StructType([T.StructField("schemaVersion", T.IntegerType()), T.StructField("invoices", T.ArrayType(record))])
    whole = spark.read.text(path, wholetext=True).select(F.ltrim(F.regexp_replace("value", "^﻿", "")).alias("v"))
    parsed = whole.select(
        F.from_json("v", envelope).alias("e"), F.when(F.col("v").startswith("["), F.from_json("v", T.ArrayType(record))).alias("bare")
    )
    newest = parsed.agg(F.max("e.schemaVersion").alias("v")).first()["v"]
    if newest is not None and newest > SCHEMA_VERSION:
        raise ValueError(f"snapshot version {newest} is newer than {SCHEMA_VERSION}")
    rows = parsed.select(F.posexplode(F.coalesce("bare", "e.invoices")).alias("pos", "r")).select("pos", "r.*")
    return rows.withColumn("id", F.col("id").cast("string"))


def write_snapshot(records: DataFrame, path: str, version: int) -> None:
    """A new version folder; readers take the highest finished one, so a broken write is never seen."""
    records.write.mode("errorifexists").parquet(f"{path}/version={version:012d}")


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Records of the highest version with a success mark; nothing else is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    done = [s.getPath().toString() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not done:
        raise FileNotFoundError(path)
    return spark.read.parquet(max(done))


def read_config(spark: SparkSession, path: str) -> dict:
    """A small JSON object of settings; empty where the file is missing or damaged."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        return {}
    try:
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (TypeError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def read_queue(spark: SparkSession, folder: str, schema: str, status: str | None = None) -> DataFrame:
    """One JSON file per record, newest name first; unreadable files are dropped, status filters if given."""
    df = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    df = df.withColumn("file_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).where("_corrupt is null").drop("_corrupt")
    return (df.where(F.col("status") == status) if status else df).orderBy(F.desc("file_name"))


def write_queue(records: DataFrame, folder: str) -> None:
    """Decision records as JSON, one folder per queue."""
    records.write.mode("append").partitionBy("queue").json(folder)


def detected_type(content: Column, name: Column) -> Column:
    """too_large over 50 MB, else by first bytes, else by extension, else unknown."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(F.length(content) > SIZE_LIMIT, "too_large")
    for magic, kind in MAGIC.items():
        out = out.when(head.startswith(magic), kind)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return out.when(ext.isin("pdf", "ofd", "xml"), ext).when(ext.isin("jpg", "jpeg", "png", "bmp", "tif", "tiff"), "image").otherwise("unknown")


def xml_fields(xml: Column, fields: dict[str, tuple[str, ...]]) -> list[Column]:
    """First non-empty value among each field's tag names, at any depth, whatever the case or prefix; null for bad XML.

    Values are taken by pattern, so a damaged document gives nulls and does not fail the job.
    """
    cols = []
    for name, tags in fields.items():
        found = [F.nullif(F.trim(F.regexp_extract(xml, rf"(?is)<(?:\w+:)?{t}(?:\s[^>]*)?>([^<]*)</", 1)), F.lit("")) for t in tags]
        value = F.coalesce(*found)
        for code, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            value = F.replace(value, F.lit(code), F.lit(mark))
        cols.append(value.alias(name))
    return cols


def versioned_envelope(rows: list[dict]) -> str:
    """A small snapshot as text, for exchange and tests."""
    return json.dumps({"schemaVersion": SCHEMA_VERSION, "invoices": rows}, ensure_ascii=False)
