"""Markdown, result tables, manifests, logs, image files, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.materials import CLASSES

IMAGES = CLASSES["image"]

def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of whole Markdown files; doc_id is the path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """dataset, metric, value of CSV results, trimmed, blank rows dropped, with their order."""
    rows = spark.read.csv(path, header=True, schema="dataset string, metric string, value string")
    rows = rows.select(*[F.trim(c).alias(c) for c in ("dataset", "metric", "value")], F.monotonically_increasing_id().alias("ord"))
    return rows.where("dataset <> '' and metric <> ''")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Claims of a JSON manifest: id, source, dataset, metric, expected, tolerance."""
    shape = "claims array<struct<id: string, source: string, dataset: string, metric: string, expected: string, tolerance: double>>"
    return spark.read.json(path, multiLine=True, schema=shape).select(F.inline("claims"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A JSONL log; bad lines are dropped, or raise if strict."""
    return spark.read.json(path, schema=schema, mode="FAILFAST" if strict else "DROPMALFORMED")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, sha256 and content of image files; files of other kinds are not opened."""
    ends = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in IMAGES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{ends}}}").load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def write_bundle(path: str, **frames: DataFrame) -> None:
    """One folder of JSON lines an array of the bundle."""
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
