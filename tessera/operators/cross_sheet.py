"""Columns that recur on other sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.columns import SHEET
from tessera.params import CrossSheetParams


#: Rows of a sheet that are compared at once (2**BLOCK), and pairs of columns that travel at once.
BLOCK, PAIRS = 10, 50_000


def _packed(cells: DataFrame, by: list[str], least: int) -> DataFrame:
    """A row a column and block of rows, with its rows and values, of the columns that have at
    least so many values."""
    names = list(dict.fromkeys([*by, *SHEET, "col"]))
    block = F.shiftright(F.col("row").cast("long"), BLOCK).alias("__block")
    row = F.col("row").cast("long").bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("short")
    packed = cells.where("num is not null").groupBy(*names, block).agg(F.collect_list(row).alias("__rows"), F.collect_list(F.col("num").cast("double")).alias("__values"), F.count("*").alias("__n"))
    packed = packed.withColumn("__n", F.sum("__n").over(Window.partitionBy(*SHEET, "col"))).where(F.col("__n") >= least).drop("__n")
    return packed.dropna(subset=[*by, "__block"])


def _met(packed: DataFrame, by: list[str]) -> DataFrame:
    """Common and equal rows of the column pairs of each case and block. A block's columns
    are compared where they meet, so only a pair's counts travel, never its rows."""
    sides = [StructField(f"{c}_{i}", packed.schema[c].dataType) for i in (1, 2) for c in (*SHEET, "col")]
    counts = [StructField(c, LongType()) for c in ("overlap_rows", "equal_rows")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def order(names):
            return [(x is not None, x) for x in names]

        def compare(case, held, kinds):
            held.sort(key=lambda x: order(x[0][:2]))
            layers = []  # columns of a sheet name, each row once
            for names, rows, values in held:
                while len(rows):
                    _, first = np.unique(rows, return_index=True)
                    layers.append((names, rows[first], values[first]))
                    rows, values = np.delete(rows, first), np.delete(values, first)
            size = 1 + max(x[1][-1] for x in layers)
            table, there = np.full((len(layers), size), np.nan), np.zeros((len(layers), size), np.float32)
            for i, (_, rows, values) in enumerate(layers):
                table[i, rows], there[i, rows] = values, 1
            sheets = [x[0][:2] for x in layers]
            after = np.array([*(i for i in range(1, len(sheets)) if sheets[i] != sheets[i - 1]), len(sheets)])
            names, waiting, n = [pa.array(x, kind) for x, kind in zip(zip(*(x[0] for x in layers)), kinds[1])], [], 0

            def batch():
                a, b, overlap, equal = map(np.concatenate, zip(*waiting))
                ends = [x.take(pa.array(at)) for at in (a, b) for x in names]
                return pa.RecordBatch.from_arrays([*(pa.array([x], kind).take(pa.array(np.zeros(len(a), np.int64))) for x, kind in zip(case, kinds[0])), *ends, pa.array(overlap), pa.array(equal)], names=[*by, *(f.name for f in (*sides, *counts))])

            for i in range(len(layers)):
                own = layers[i][1]
                for start in range(after[np.searchsorted(after, i, "right")], len(layers), 4096):
                    overlap = there[start : start + 4096, own].sum(axis=1).astype(np.int64)
                    with np.errstate(invalid="ignore"):  # what is absent or infinite equals nothing
                        equal = (np.abs(table[start : start + 4096, own] - layers[i][2]) < 1e-9).sum(axis=1)
                    at = np.flatnonzero(overlap)
                    waiting.append((np.full(len(at), i), start + at, overlap[at], equal[at]))
                    n += len(at)
                    if n > PAIRS:
                        yield batch()
                        waiting.clear()
                        n = 0
            if n:
                yield batch()

        now, held, kinds = None, [], None
        for batch in batches:
            kinds = [[batch.schema.field(c).type for c in x] for x in (by, (*SHEET, "col"))]
            ends, rows, values = batch.column("__rows").offsets.to_numpy(), batch.column("__rows").values.to_numpy(), batch.column("__values").values.to_numpy()
            cases = zip(*(batch.column(c).to_pylist() for c in (*by, "__block")))
            names = zip(*(batch.column(c).to_pylist() for c in (*SHEET, "col")))
            for i, (case, name) in enumerate(zip(cases, names)):
                if case != now and held:
                    yield from compare(now[:-1], held, kinds)
                    held = []
                now = case
                part = slice(ends[i], ends[i + 1])
                held.append((name, rows[part].copy(), values[part].copy()))
        if held:
            yield from compare(now[:-1], held, kinds)

    schema = StructType([*(packed.schema[c] for c in by), *sides, *counts])
    return packed.repartition(*by, "__block").sortWithinPartitions(*by, "__block").mapInArrow(run, schema)


def cross_sheet_duplicates(cells: DataFrame, by: list[str], p: CrossSheetParams = CrossSheetParams()) -> DataFrame:
    """Equal rows (to 1e-9) of column pairs on different sheets of a case, of their common
    rows. ``by`` names the case: columns meet within it, by row number. A sheet is its
    workbook and its name, so equally named sheets of two workbooks meet, too."""
    key = ["workbook_1", "sheet_1", "col_1", "workbook_2", "sheet_2", "col_2"]
    agg = _met(_packed(cells, by, p.min_overlap), by).groupBy(*by, *key).agg(F.sum("overlap_rows").alias("overlap_rows"), F.sum("equal_rows").alias("equal_rows"))
    rate = F.col("equal_rows") / F.col("overlap_rows")
    out = agg.where(F.col("overlap_rows") >= p.min_overlap).withColumn("support_rate", F.round(rate, 4)).withColumn("flagged", rate >= p.min_support_rate)
    return out.drop("workbook_1", "workbook_2") if "workbook" in by else out


def cross_sheet_findings(pairs: DataFrame, p: CrossSheetParams = CrossSheetParams()) -> DataFrame:
    """The first flagged pairs in the order of their columns, then by support, with ids."""
    place = [c for c in ("workbook_1", "sheet_1", "col_1", "workbook_2", "sheet_2", "col_2") if c in pairs.columns]
    top = pairs.where("flagged").orderBy(*place).limit(p.max_findings)
    n = F.row_number().over(Window.orderBy(F.desc("support_rate"), *place))
    return top.withColumn("finding_id", F.format_string("CSD-%04d", n)).withColumn("issue_category", F.lit("consistency"))


def numeric_columns(cells: DataFrame, p: CrossSheetParams = CrossSheetParams()) -> DataFrame:
    """Columns whose data rows (from row 2) are numeric often enough, with their header."""
    agg = cells.groupBy("workbook", "sheet", "col").agg(F.max(F.when(F.col("row") == 1, F.col("value"))).alias("header"), F.count_if((F.col("row") > 1) & F.col("value").isNotNull()).alias("n"), F.count_if((F.col("row") > 1) & F.col("num").isNotNull()).alias("numeric"))
    kept = agg.where((F.col("n") > 0) & (F.col("numeric") / F.col("n") >= p.min_numeric_ratio))
    return kept.withColumn("column", F.coalesce("header", F.concat(F.lit("Col_"), F.col("col"))))
