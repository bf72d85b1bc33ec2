"""Tables as virtual workbooks: long cells from columns of any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unpivoted(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, row, col from 1, raw, num) of the named columns, money-like with two places.
    The literal passes through a decimal, whose text has no exponent."""
    cells = F.array(*[F.struct(F.lit(i + 1).alias("col"), F.col(c).cast("decimal(18,2)").alias("d")) for i, c in enumerate(columns)])
    out = rows.select(*keys, "row", F.explode(cells).alias("c"))
    return out.select(*keys, "row", "c.col", F.col("c.d").cast("string").alias("raw"), F.col("c.d").cast("double").alias("num")).where("num is not null")


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook a supplier, a sheet a return flag, a row a line: sheets stay small as
    the table grows, because suppliers grow with it."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_returnflag", *LINE_ORDER)
    n = F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy(*LINE_ORDER))
    rows = rows.withColumn("row", n).withColumnsRenamed({"l_suppkey": "workbook", "l_returnflag": "sheet"})
    return unpivoted(rows, ["workbook", "sheet"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
