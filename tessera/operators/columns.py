"""Relations between the numeric columns of a sheet, over long cells.

cells(workbook, sheet, row, col, num double[, raw]): a row a numeric cell. Sheets are
bounded; all joins are by sheet and row, never across sheets, and columns with too few
values leave before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digits import number_key, ratio_key, scaled
from tessera.params import ColumnParams, PairParams

SHEET = ["workbook", "sheet"]
PAIR = [*SHEET, "left_col", "right_col"]


def dense_columns(cells: DataFrame, least: int) -> DataFrame:
    """Cells of the columns that have at least so many values."""
    n = F.count("num").over(Window.partitionBy(*SHEET, "col"))
    return cells.where("num is not null").withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def column_pairs(cells: DataFrame) -> DataFrame:
    """(pair, row, left, right) of all column pairs of a sheet, by row: a row's cells are
    gathered once and paired in place."""
    rows = cells.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(F.struct("col", "num"))).alias("v"))
    met = F.expr("flatten(transform(v, (x, i) -> transform(slice(v, i + 2, size(v)), y -> struct(x.col as left_col, y.col as right_col, x.num as left, y.num as right))))")
    return rows.select(*SHEET, "row", F.explode(met).alias("p")).select(*SHEET, "row", "p.*")


def modal(pairs: DataFrame, group: list[str], key: str, order: str) -> DataFrame:
    """Most frequent key of a group, the first seen of equally frequent ones, and its count."""
    counts = pairs.where(F.col(key).isNotNull()).groupBy(*group, key).agg(F.count("*").alias("support_rows"), F.min(order).alias("__first"))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("support_rows"), "__first"))
    return counts.withColumn("__r", best).where("__r = 1").drop("__r", "__first")


def fixed_relations(cells: DataFrame, p: ColumnParams = ColumnParams()) -> DataFrame:
    """Modal difference (6 places, not 0) and ratio (6 places, neither 0 nor 1) of each
    column pair, with its support over all common rows; flagged at min_support."""
    pairs = column_pairs(dense_columns(cells, p.min_overlap))
    kinds = F.array(F.struct(F.lit("fixed_difference").alias("category"), scaled(F.col("left") - F.col("right"), 6).alias("relationship_value")), F.struct(F.lit("fixed_ratio").alias("category"), ratio_key(F.col("left"), F.col("right"), 6).alias("relationship_value")))
    keyed = pairs.select(*PAIR, "row", F.explode(kinds).alias("k")).select(*PAIR, "row", "k.*")
    counts = keyed.groupBy(*PAIR, "category", "relationship_value").agg(F.count("*").alias("support_rows"), F.min("row").alias("__first"))
    w = Window.partitionBy(*PAIR, "category")  # rows without a ratio count as overlap
    best = F.row_number().over(w.orderBy(F.col("relationship_value").isNull(), F.desc("support_rows"), "__first"))
    found = counts.withColumns({"overlap_rows": F.sum("support_rows").over(w), "__r": best}).where("__r = 1 and relationship_value is not null")
    trivial = ((F.col("category") == "fixed_difference") & (F.col("relationship_value") == 0)) | ((F.col("category") == "fixed_ratio") & F.col("relationship_value").isin(0, 1_000_000))
    found = found.withColumn("trivial", trivial)
    rate = F.col("support_rows") / F.col("overlap_rows")
    flagged = ~F.col("trivial") & (F.col("overlap_rows") >= p.min_overlap) & (rate >= p.min_support)
    risk = F.when(F.col("support_rows") >= 100, "high").otherwise("medium")
    return found.select(*PAIR, "category", "relationship_value", "support_rows", "overlap_rows", F.round(rate, 4).alias("support_rate"), risk.alias("risk_level"), flagged.alias("flagged"))


def duplicate_columns(cells: DataFrame, p: ColumnParams = ColumnParams()) -> DataFrame:
    """Rows on which two columns are equal, of their common rows; flagged at min_support.
    Index-like pairs (steps of one) are low, long ones high."""
    pairs = column_pairs(dense_columns(cells, p.min_overlap)).withColumn("same", F.col("left") == F.col("right"))
    by_row = Window.partitionBy(*PAIR).orderBy("row")
    step = F.when(F.col("same"), (F.col("left").try_cast("bigint") - F.lag(F.col("left").try_cast("bigint")).over(by_row) == 1).cast("int"))
    agg = pairs.withColumn("step", step).groupBy(*PAIR).agg(F.count("*").alias("overlap_rows"), F.count_if("same").alias("equal_rows"), F.avg("step").alias("steps"))
    rate = F.col("equal_rows") / F.col("overlap_rows")
    index = (F.coalesce("steps", F.lit(0.0)) >= 0.7) & (F.col("equal_rows") >= 8)
    risk = F.when(index, "low").when(F.col("equal_rows") >= 100, "high").otherwise("medium")
    flagged = (F.col("overlap_rows") >= p.min_overlap) & (rate >= p.min_support)
    return agg.select(*PAIR, "overlap_rows", "equal_rows", F.round(rate, 4).alias("support_rate"), risk.alias("risk_level"), flagged.alias("flagged"))


def index_like(cells: DataFrame) -> DataFrame:
    """(sheet, col, index_like): at least 8 values, 95 % integers, and mostly steps of one."""
    step = F.col("num").try_cast("bigint") - F.lag(F.col("num").try_cast("bigint")).over(Window.partitionBy(*SHEET, "col").orderBy("row"))
    agg = cells.where("num is not null").withColumn("step", step).groupBy(*SHEET, "col").agg(
        F.count("*").alias("n"), F.avg((F.col("num") == F.floor("num")).cast("int")).alias("whole"), F.avg((F.col("step") == 1).cast("int")).alias("ones"), (F.countDistinct("num") / F.count("*")).alias("unique"))
    ones = F.coalesce("ones", F.lit(0.0))
    return agg.select(*SHEET, "col", ((F.col("n") >= 8) & (F.col("whole") >= 0.95) & ((ones >= 0.7) | ((F.col("unique") >= 0.9) & (ones >= 0.85)))).alias("index_like"))


def informative(cells: DataFrame, min_pairs: int) -> DataFrame:
    """(sheet, col) of columns that are not of low information."""
    agg = cells.where("num is not null").groupBy(*SHEET, "col").agg(F.count("*").alias("n"), F.countDistinct("num").alias("d"))
    low = (F.col("n") >= min_pairs) & ((F.col("d") <= 3) | ((F.col("n") >= 20) & (F.col("d") / F.col("n") <= 0.1)))
    return agg.where(~low).select(*SHEET, "col")


def duplicate_rows(cells: DataFrame, positions: bool, least: int = 2) -> DataFrame:
    """Rows of a sheet with equal values: in column order with their positions (the pair
    detectors) or without (the profile, three values at least)."""
    item = F.struct("col", F.coalesce(number_key(F.col("num").try_cast("decimal(38,18)")), F.col("num").cast("string")).alias("v"))
    rows = cells.where("num is not null").groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(item)).alias("items")).where(F.size("items") >= least)
    parts = F.transform("items", lambda x: F.concat(x["col"], F.lit("="), x["v"])) if positions else F.transform("items", lambda x: x["v"])
    found = rows.groupBy(*SHEET, F.array_join(parts, "|").alias("vector")).agg(F.count("*").alias("n_rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    return found.where("n_rows > 1")


def duplicate_row_findings(cells: DataFrame, p: PairParams = PairParams()) -> DataFrame:
    """Equal rows, by column and value, of min_width values at least, some of them in a
    column that is not of low information; four of them or more are high."""
    told = cells.where("num is not null").join(informative(cells, p.min_pairs).withColumn("told", F.lit(1)), [*SHEET, "col"], "left")
    key = F.coalesce(number_key(F.col("num").try_cast("decimal(38,18)")), F.col("num").cast("string"))
    rows = told.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(F.struct("col", key.alias("v")))).alias("items"), F.max("told").alias("told")).where((F.size("items") >= p.min_width) & (F.col("told") == 1))
    vector = F.array_join(F.transform("items", lambda x: F.concat(x["col"], F.lit("="), x["v"])), "|")
    found = rows.groupBy(*SHEET, vector.alias("vector")).agg(F.count("*").alias("duplicate_row_count"), F.first(F.size("items")).alias("width"), F.array_join(F.slice(F.array_sort(F.collect_list("row")), 1, 30), ",").alias("rows"))
    return found.where("duplicate_row_count > 1").withColumn("risk_level", F.when(F.col("duplicate_row_count") < 4, "medium").otherwise("high"))


def column_findings(cells: DataFrame, labels: DataFrame | None = None, formulas: DataFrame | None = None, p: ColumnParams = ColumnParams()) -> DataFrame:
    """Equal columns that are findings, with what a report needs: risk (low for two index
    columns on the equal rows, high for 100 equal rows under different labels), confidence,
    artifact likelihood, labels, the first 20 rows, and ids by (sheet cap, then all).

    labels(workbook, sheet, col, label), formulas(workbook, sheet, col)."""
    pairs = column_pairs(dense_columns(cells, p.min_overlap)).withColumn("same", F.col("left") == F.col("right"))
    agg = pairs.groupBy(*PAIR).agg(F.count("*").alias("overlap_rows"), F.count_if("same").alias("equal_rows"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("same"), F.col("row")))), 1, 20), ",").alias("sample_rows"))
    rate = F.col("equal_rows") / F.col("overlap_rows")
    found = agg.where((F.col("overlap_rows") >= p.min_overlap) & (rate >= p.min_support))
    on_equal = pairs.where("same").join(found.select(*PAIR), PAIR, "left_semi")
    by_row = Window.partitionBy(*PAIR).orderBy("row")
    step = lambda c: F.col(c).try_cast("bigint") - F.lag(F.col(c).try_cast("bigint")).over(by_row) == 1
    steps = on_equal.select(*PAIR, "left", step("left").alias("one"))  # equal on these rows: both columns at once
    index = steps.groupBy(*PAIR).agg(F.count("*").alias("n"), F.avg((F.col("left") == F.floor("left")).cast("int")).alias("whole"), F.avg(F.col("one").cast("int")).alias("ones"), (F.countDistinct("left") / F.count("*")).alias("u"))
    ones = F.coalesce("ones", F.lit(0.0))
    index = index.select(*PAIR, ((F.col("n") >= 8) & (F.col("whole") >= 0.95) & ((ones >= 0.7) | ((F.col("u") >= 0.9) & (ones >= 0.85)))).alias("index_like"))
    found = found.join(index, PAIR, "left").withColumn("index_like", F.coalesce("index_like", F.lit(False)))
    spark = cells.sparkSession
    empty = spark.createDataFrame([], "workbook string, sheet string, col int, label string")
    for side in ("left", "right"):
        named = (labels if labels is not None else empty).select(*SHEET, F.col("col").alias(f"{side}_col"), F.col("label").alias(f"{side}_label"))
        found = found.join(named, [*SHEET, f"{side}_col"], "left")
    if formulas is not None:
        made = formulas.select(*SHEET, "col").distinct()
        for side in ("left", "right"):
            found = found.join(made.select(*SHEET, F.col("col").alias(f"{side}_col"), F.lit(True).alias(f"{side}_formula")), [*SHEET, f"{side}_col"], "left")
    involved = F.coalesce("left_formula", "right_formula", F.lit(False)) if formulas is not None else F.lit(False)
    differ = ~F.col("left_label").eqNullSafe(F.col("right_label"))
    risk = F.when(F.col("index_like"), "low").when((F.col("equal_rows") >= 100) & differ, "high").otherwise("medium")
    likely = F.when(F.col("index_like"), "high").when(involved, "medium").otherwise("unknown")
    out = found.select(*PAIR, "left_label", "right_label", "overlap_rows", "equal_rows", F.round(rate, 4).alias("support_rate"), risk.alias("risk_level"), F.when(F.col("equal_rows") == F.col("overlap_rows"), "high").otherwise("medium").alias("confidence"), likely.alias("artifact_likelihood"), "sample_rows")
    return capped(out, "DC", p.cap, F.desc("equal_rows"))


def capped(found: DataFrame, prefix: str, cap: int, order) -> DataFrame:
    """The first ``cap`` findings of each sheet and of all, with ids in that order."""
    ties = [c for c in ("left_col", "right_col") if c in found.columns]
    own = F.row_number().over(Window.partitionBy(*SHEET).orderBy(order, *ties))
    keys = [order, "workbook", "sheet", *ties]
    top = found.withColumn("__own", own).where(F.col("__own") <= cap).drop("__own").orderBy(*keys).limit(cap)
    return top.withColumn("finding_id", F.format_string("%s-%04d", F.lit(prefix), F.row_number().over(Window.orderBy(*keys))))


def referenced_columns(cells: DataFrame) -> DataFrame:
    """(sheet, col, references) of formula columns: the columns that they name, first seen first."""
    f = cells.where("formula is not null").select(*SHEET, "col", "row", F.posexplode(F.regexp_extract_all("formula", F.lit(r"\$?([A-Z]+)\$?\d+"), F.lit(1))).alias("at", "name"))
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "at", "name"))), lambda x: x["name"]))
    return f.groupBy(*SHEET, "col").agg(F.array_join(seen, ",").alias("references"))


def formula_columns(cells: DataFrame) -> DataFrame:
    """Formula count and dominant template of each column that has a formula."""
    from tessera.functions.digits import formula_pattern

    f = cells.where("formula is not null").withColumn("template", formula_pattern(F.col("formula")))
    total = f.groupBy(*SHEET, "col").agg(F.count("*").alias("formula_count"))
    return modal(f, [*SHEET, "col"], "template", "row").join(total, [*SHEET, "col"])


def column_labels(cells: DataFrame) -> DataFrame:
    """First four distinct texts in rows up to 30 of each column, joined."""
    texts = cells.where("row <= 30 and num is null and trim(value) <> ''").groupBy(*SHEET, "col", F.trim("value").alias("value")).agg(F.min("row").alias("row"))
    firsts = F.slice(F.array_sort(F.collect_list(F.struct("row", "value"))), 1, 4)
    return texts.groupBy(*SHEET, "col").agg(F.array_join(F.transform(firsts, lambda x: x["value"]), " / ").alias("label"))
