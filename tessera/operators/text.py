"""Numbers, lines, blocks, sentences, labels and rules over documents(doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digits import NUMBER, clean_text, fraction_text, label, label_key, line_kind, parse_decimal, terminal_digit_text


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text), lines numbered from 1."""
    parts = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("i", "text"))
    return parts.select("doc_id", (F.col("i") + 1).alias("line"), "text")


def classified(docs: DataFrame) -> DataFrame:
    found = lines(docs)
    return found.select("*", line_kind(F.col("text")).alias("kind"), label(F.col("text")).alias("label")).withColumn("label_key", label_key(F.col("label")))


def numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, line, pos, raw, value, terminal, fraction) of number literals."""
    found = lines(docs).select("doc_id", "line", F.posexplode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("pos", "raw"))
    return found.select("*", parse_decimal(F.regexp_replace("raw", "%$", "")).alias("value"), terminal_digit_text(F.col("raw")).alias("terminal"), fraction_text(F.col("raw")).alias("fraction"))


def islands(found: DataFrame, least: int) -> DataFrame:
    """Runs of consecutive lines, by document: (doc_id, start_line, end_line, n_lines)."""
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    runs = found.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("n_lines"))
    return runs.where(F.col("n_lines") >= least).drop("island")


def tables(docs: DataFrame, with_digit: bool = False) -> DataFrame:
    """Islands of at least two lines with a pipe (and a digit, for the numeric flavour)."""
    rows = lines(docs).where(F.col("text").contains("|") & ~F.col("text").rlike(r"!\[[^\]]*\]\("))
    return islands(rows.where(F.col("text").rlike(r"\d")) if with_digit else rows, 2)


def blocks(docs: DataFrame) -> DataFrame:
    """Paragraphs: runs of non-blank lines, joined and collapsed."""
    rows = lines(docs).where("trim(text) <> ''").withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", "island").agg(F.min("line").alias("start_line"), clean_text(joined).alias("text")).drop("island")


def sentences(docs: DataFrame, least: int = 30, most: int = 5) -> DataFrame:
    """The first distinct sentences of some length; equal 180-character beginnings are one."""
    parts = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?。！？])\s+")).alias("pos", "s"))
    parts = parts.withColumn("s", F.trim("s")).where((F.length("s") >= least) & ~F.col("s").contains("!["))
    first = F.row_number().over(Window.partitionBy("doc_id", F.substring(F.lower("s"), 1, 180)).orderBy("pos"))
    kept = parts.withColumn("f", first).where("f = 1").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    return kept.where(F.col("rank") <= most).select("doc_id", "rank", "pos", "s")


def inverted_index(found: DataFrame) -> DataFrame:
    """(index_name, key, n_items) over kinds, labels and line ranges of classified lines."""
    kinds = found.select(F.lit("type").alias("index_name"), F.col("kind").alias("key"), "doc_id", "line")
    labels = found.where("label_key <> ''").select(F.lit("label").alias("index_name"), F.col("label_key").alias("key"), "doc_id", "line")
    pages = found.select(F.lit("line").alias("index_name"), F.col("line").cast("string").alias("key"), "doc_id", "line")
    return kinds.unionByName(labels).unionByName(pages).groupBy("index_name", "key").agg(F.count("*").alias("n_items"))
