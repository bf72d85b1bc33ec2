"""Sheet profiles: counts, digits, fractions, repeats, Benford."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digits import first_digit, fraction_cell, terminal_digit_cell


def counts(cells: DataFrame) -> DataFrame:
    """Cells, numeric cells and rows by sheet, by workbook, and in all (null keys)."""
    sheets = cells.groupBy("workbook", "sheet").agg(F.count("*").alias("n_cells"), F.count("num").alias("n_numeric"), F.countDistinct("row").alias("n_rows"))
    return sheets.rollup("workbook", "sheet").agg(F.sum("n_cells").alias("n_cells"), F.sum("n_numeric").alias("n_numeric"), F.sum("n_rows").alias("n_rows"), F.grouping_id().cast("int").alias("level"))


def terminal_digits(cells: DataFrame, by: list[str]) -> DataFrame:
    digit = cells.select(*by, terminal_digit_cell(F.col("raw")).alias("digit")).where("digit is not null")
    n = digit.groupBy(*by, "digit").agg(F.count("*").alias("n"))
    share = F.sum(F.when(F.col("digit").isin("0", "5"), F.col("n")).otherwise(0)).over(Window.partitionBy(*by)) / F.sum("n").over(Window.partitionBy(*by))
    return n.withColumn("zero_five_rate", F.round(share, 6))


def top_repeats(values: DataFrame, by: list[str], value: str, least: int, top: int) -> DataFrame:
    """The most repeated values of each group."""
    n = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)


def fractions(cells: DataFrame, by: list[str], top: int = 30) -> DataFrame:
    return top_repeats(cells.select(*by, fraction_cell(F.col("raw")).alias("fraction")), by, "fraction", 2, top)


def first_digits(values: DataFrame, v: str) -> DataFrame:
    return values.select(first_digit(F.col(v)).alias("digit")).where("digit is not null").groupBy("digit").agg(F.count("*").alias("n"))


def benford(values: DataFrame, v: str) -> DataFrame:
    """n, orders of magnitude, applicability (100 values over two orders) and the mean
    absolute deviation from log10(1 + 1/d) over the nine digits."""
    usable = values.select(F.col(v).alias("v")).where((F.abs("v") > 0) & (F.abs("v") < 1e12)).withColumn("d", first_digit(F.col("v")))
    share = [F.count_if(F.col("d") == d) / F.nullif(F.count("*"), F.lit(0)) for d in range(1, 10)]
    expected = [F.log10(F.lit(1 + 1 / d)) for d in range(1, 10)]
    gap = sum((F.abs(s - e) for s, e in zip(share, expected)), F.lit(0.0)) / 9
    orders = F.log10(F.max(F.abs("v")).cast("double") / F.min(F.abs("v")).cast("double"))
    return usable.agg(F.count("*").alias("n"), F.round(orders, 6).alias("orders"), F.round(gap, 6).alias("mad")).withColumn("applicable", (F.col("n") >= 100) & (F.col("orders") >= 2))
