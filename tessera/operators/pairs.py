"""Reuse of values and ratios at a distance: by row offset and by pair id.

A group's rows are shuffled once; the rows within the largest offset are a window's frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digits import decimal_places, ratio_key
from tessera.operators.columns import SHEET, column_pairs, informative, modal
from tessera.params import PairParams

COLUMN = [*SHEET, "col"]


def offset_pairs(rows: DataFrame, group: list[str], order: str, value: str, max_offset: int) -> DataFrame:
    """(group, offset, order, left, right) of values that lie an offset apart. Rows are
    shuffled once, by group; those that follow within the offset are a window's frame."""
    ahead = Window.partitionBy(*group).orderBy(order).rangeBetween(1, max_offset)
    near = rows.select(*group, F.col(order), F.col(value).alias("left"), F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("right"))).over(ahead).alias("near"))
    met = near.select(*group, order, "left", F.explode("near").alias("x"))
    return met.select(*group, order, "left", (F.col("x.at") - F.col(order)).cast("int").alias("offset"), F.col("x.right").alias("right"))


def row_offset_scalar(cells: DataFrame, p: PairParams = PairParams()) -> DataFrame:
    """Modal ratio right / left at each offset of a column, over all its pairs."""
    numeric = cells.where("num is not null").join(informative(cells, p.min_pairs), COLUMN, "left_semi")
    pairs = offset_pairs(numeric, COLUMN, "row", "num", p.max_offset).withColumn("ratio", ratio_key(F.col("right"), F.col("left"), p.ratio_places))
    group = [*COLUMN, "offset"]
    overlap = pairs.groupBy(*group).agg(F.count("*").alias("overlap_rows"))
    top = modal(pairs, group, "ratio", "row").join(overlap, group)
    rate = F.col("support_rows") / F.col("overlap_rows")
    exact = F.col("ratio") == 10**p.ratio_places
    return top.select(*group, "ratio", "support_rows", "overlap_rows", F.round(rate, 4).alias("support_rate"), F.when(exact, "row_offset_exact_reuse").otherwise("row_offset_scalar_multiple").alias("category"),
                      F.when((F.col("support_rows") >= 10) & ~exact, "high").otherwise("medium").alias("risk_level"), ((F.col("support_rows") >= p.min_pairs) & (rate >= p.min_support)).alias("flagged"))


def offset_groups(scalars: DataFrame) -> DataFrame:
    """Flagged offsets regrouped across columns by (offset, ratio, category)."""
    return scalars.where("flagged").groupBy(*SHEET, "offset", "ratio", "category").agg(F.sum("support_rows").alias("support_rows"), F.sum("overlap_rows").alias("overlap_rows"), F.array_sort(F.collect_set("col")).alias("columns"), F.min("risk_level").alias("risk_level"))


def paired_ratio_reuse(cells: DataFrame, p: PairParams = PairParams()) -> DataFrame:
    """Share of rows whose column ratio recurs an offset further down."""
    numeric = cells.join(informative(cells, p.min_pairs), COLUMN, "left_semi")
    group = [*SHEET, "left_col", "right_col"]
    ratios = column_pairs(numeric.where("num is not null")).select(*group, "row", ratio_key(F.col("left"), F.col("right"), p.ratio_places).alias("ratio")).where("ratio is not null")
    pairs = offset_pairs(ratios, group, "row", "ratio", p.max_offset)
    agg = pairs.groupBy(*group, "offset").agg(F.count("*").alias("overlap_pairs"), F.count_if(F.col("left") == F.col("right")).alias("matched_pairs"))
    rate = F.col("matched_pairs") / F.col("overlap_pairs")
    return agg.select("*", F.round(rate, 4).alias("support_rate"), ((F.col("matched_pairs") >= p.min_pairs) & (rate >= p.min_support)).alias("flagged"))


def rounding_bias(cells: DataFrame, p: PairParams = PairParams()) -> DataFrame:
    """Partial copies at an offset: equal values, coarser values, and how often they were
    rounded up. cells need raw, the literal."""
    rows = cells.where("num is not null").withColumn("v", F.struct("num", decimal_places(F.col("raw")).alias("places")))
    pairs = offset_pairs(rows, COLUMN, "row", "v", p.max_offset)
    left, right = F.col("left.num"), F.col("right.num")
    coarse = (F.col("right.places") <= 2) & (F.col("left.places") >= 6)
    agg = pairs.groupBy(*COLUMN, "offset").agg(F.count("*").alias("overlap_rows"), F.count_if(left == right).alias("exact"), F.count_if(coarse).alias("rounded"), F.count_if(right > left).alias("upward"), F.count_if(left != right).alias("other"))
    n = F.col("overlap_rows")
    flagged = (n >= p.min_pairs) & (F.col("exact") / n >= 0.5) & (F.col("rounded") / n >= 0.3) & (F.col("upward") / F.greatest(F.lit(1), F.col("other")) >= 0.75)
    return agg.withColumn("flagged", flagged)


def long_pairs(rows: DataFrame, group: list[str], p: PairParams = PairParams()) -> DataFrame:
    """Ids with exactly two rows, from rows(group, pair_id, row, num): first and second
    value and their ratio; a group needs enough such ids and three quarters of all ids."""
    by_id = rows.where("num is not null").groupBy(*group, "pair_id").agg(F.count("*").alias("n"), F.min(F.struct("row", "num"))["num"].alias("first"), F.max(F.struct("row", "num"))["num"].alias("second"))
    w = Window.partitionBy(*group)
    gated = by_id.select("*", F.count("*").over(w).alias("ids"), F.count_if(F.col("n") == 2).over(w).alias("twos"))
    kept = gated.where((F.col("n") == 2) & (F.col("ids") >= p.min_pairs) & (F.col("twos") >= p.min_pairs) & (F.col("twos") * 4 >= F.col("ids") * 3))
    return kept.select(*group, "pair_id", "first", "second", ratio_key(F.col("second"), F.col("first"), p.ratio_places).alias("ratio"))


def long_ratio_reuse(pairs: DataFrame, group: list[str], p: PairParams = PairParams()) -> DataFrame:
    """Share of pair ids whose ratio recurs at id + offset."""
    met = offset_pairs(pairs.where("ratio is not null"), group, "pair_id", "ratio", p.max_offset)
    agg = met.groupBy(*group, "offset").agg(F.count("*").alias("overlap_groups"), F.count_if(F.col("left") == F.col("right")).alias("matched_groups"))
    return agg.withColumn("flagged", (F.col("matched_groups") >= p.min_pairs) & (F.col("matched_groups") / F.col("overlap_groups") >= p.min_support))


def long_ratio_enrichment(pairs: DataFrame, group: list[str], p: PairParams = PairParams()) -> DataFrame:
    """Ratios other than one that many pairs of a group share."""
    known = pairs.where("ratio is not null")
    total = known.groupBy(*group).agg(F.count("*").alias("n_pairs"))
    counts = known.groupBy(*group, "ratio").agg(F.count("*").alias("support_rows")).join(total, group)
    rate = F.col("support_rows") / F.col("n_pairs")
    flagged = (F.col("ratio") != 10**p.ratio_places) & (F.col("support_rows") >= p.min_pairs) & (rate >= 0.2)
    return counts.select(*group, "ratio", "support_rows", "n_pairs", F.round(rate, 4).alias("support_rate"), F.when(rate >= 0.5, "high").otherwise("medium").alias("risk_level"), flagged.alias("flagged"))
