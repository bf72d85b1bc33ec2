"""Claims against results, duplicates by digest and by hash distance, findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digits import risk_rank
from tessera.params import ImageParams


def latest_results(results: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: the last one."""
    return results.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def compare_claims(claims: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """claims(key, expected string, tolerance) against results(key, value string):
    matched, mismatched, missing or unparsed, and the difference to 6 places. NaN is unparsed."""
    e, a = F.col("expected").try_cast("double"), F.col("value").try_cast("double")
    known = e.isNotNull() & a.isNotNull() & ~F.isnan(e) & ~F.isnan(a)
    status = F.when(F.col("__found").isNull(), "missing").when(~F.coalesce(known, F.lit(False)), "unparsed").when(F.abs(e - a) > F.col("tolerance"), "mismatched").otherwise("matched")
    return claims.join(results.withColumn("__found", F.lit(True)), key, "left").select(*claims.columns, "value", status.alias("status"), F.when(known, F.round(F.abs(e - a), 6)).alias("difference"))


def exact_duplicates(items: DataFrame, key: str, content: str) -> DataFrame:
    """Groups of equal content by SHA-256: least key and size, of two at least."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    return items.where(F.col(content).isNotNull()).groupBy(digest.alias("sha256")).agg(F.count("*").alias("n_items"), F.min(key).alias("first_item")).where("n_items > 1")


#: Hashes that are sent to every task, 16 bytes each; beyond, bands are joined.
HELD = 200_000


def near_hashes(items: DataFrame, key: str, bits: str, p: ImageParams = ImageParams(), size: int = 64) -> DataFrame:
    """Pairs of hashes of ``size`` bits at Hamming distance at most p.max_distance.

    Up to HELD hashes are sent to all tasks, which compare their own with them in blocks and
    return near pairs only. More are cut into four bands: near hashes differ in a quarter of
    the distance at most in one band, so each hash looks up the values so near to its own,
    an equi-join; a pair is kept at its first such band."""
    rows = items.select(F.col(key).alias("k"), F.col(bits).alias("h")).where("h is not null")
    return _compared(rows, p.max_distance) if rows.count() <= HELD else _banded(rows, p.max_distance, size)


def _compared(rows: DataFrame, most: int) -> DataFrame:
    import numpy as np

    known = rows.toArrow()
    kind = rows.schema["k"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast((known.column("k").to_pylist(), known.column("h").to_numpy()))

    def run(batches):
        import pyarrow as pa

        keys, hashes = held.value
        for batch in batches:
            for k, h in zip(batch.column("k").to_pylist(), batch.column("h").to_numpy()):
                distance = np.bitwise_count((hashes ^ h).view(np.uint64))
                near = [(k, keys[i], int(distance[i])) for i in np.flatnonzero(distance <= most) if k < keys[i]]
                if near:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*near), (batch.schema.field("k").type, batch.schema.field("k").type, pa.int32()))], names=["item_1", "item_2", "distance"])

    return rows.mapInArrow(run, f"item_1 {kind}, item_2 {kind}, distance int")


def _banded(rows: DataFrame, most: int, size: int) -> DataFrame:
    from itertools import combinations

    bands, radius = 4, most // 4
    edges = [size * i // bands for i in range(bands + 1)]
    near = lambda w: [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(w), r)]
    band = [F.shiftrightunsigned("h", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    spread = rows.select("k", "h", F.array(*band).alias("bands")).select("k", "h", "bands", F.posexplode("bands").alias("band", "v"))
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in near(b - a)]) for a, b in zip(edges, edges[1:])])
    left = spread.select("band", F.explode(F.transform(F.element_at(masks, F.col("band") + 1), lambda m: m.bitwiseXOR(F.col("v")))).alias("v"), F.col("k").alias("item_1"), F.col("h").alias("h1"), F.col("bands").alias("b1"))
    right = spread.select("band", "v", F.col("k").alias("item_2"), F.col("h").alias("h2"), F.col("bands").alias("b2"))
    pairs = left.join(right, ["band", "v"]).where("item_1 < item_2").withColumn("distance", F.bit_count(F.col("h1").bitwiseXOR(F.col("h2"))))
    first = F.expr(f"not exists(slice(arrays_zip(b1, b2), 1, band), x -> bit_count(x.b1 ^ x.b2) <= {radius})")
    return pairs.where((F.col("distance") <= most) & first).select("item_1", "item_2", "distance")


def first_candidates(pairs: DataFrame, most: int) -> DataFrame:
    """The first pairs in the order of their items, with their rank."""
    top = pairs.orderBy("item_1", "item_2").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("item_1", "item_2")))


def numbered(findings: DataFrame, prefix: str, order: list, key: str = "finding_id") -> DataFrame:
    """Sequential ids by a stated order."""
    return findings.withColumn(key, F.format_string("%s-%04d", F.lit(prefix), F.row_number().over(Window.partitionBy(F.lit(prefix)).orderBy(*order))))


def priority(findings: DataFrame) -> DataFrame:
    """Findings of at least medium risk that no artifact explains."""
    return findings.where((risk_rank(F.col("risk_level")) >= 2) & (F.coalesce("artifact_likelihood", F.lit("unknown")) != "high"))


def deduplicated(findings: DataFrame, key: str, order: str) -> DataFrame:
    """The first of findings with one id."""
    return findings.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")


def pattern_groups(findings: DataFrame) -> DataFrame:
    """By category: findings, sheets, workbooks, support, highest risk."""
    rank = risk_rank(F.col("risk_level"))
    return findings.groupBy("category").agg(F.count("*").alias("n_findings"), F.countDistinct("workbook", "sheet").alias("n_sheets"), F.countDistinct("workbook").alias("n_workbooks"), F.sum("support_rows").alias("support_rows"), F.max(rank).alias("max_risk"))


def clusters(findings: DataFrame, top: int = 6) -> DataFrame:
    """Findings by (workbook, sheet), the highest ones first."""
    agg = findings.groupBy("workbook", "sheet").agg(F.max(risk_rank(F.col("risk_level"))).alias("max_risk"), F.count("*").alias("n_findings"))
    return agg.orderBy(F.desc("max_risk"), F.desc("n_findings"), "workbook", "sheet").limit(top)


def verdict(findings: DataFrame, tasks: int = 0) -> DataFrame:
    """One row: fail, review or pass."""
    rank = risk_rank(F.col("risk_level"))
    return findings.agg(F.count("*").alias("n"), F.coalesce(F.max(rank), F.lit(0)).alias("top")).select(F.when(F.col("top") >= 4, "fail").when((F.col("n") > 0) | F.lit(tasks > 0), "review").otherwise("pass").alias("verdict"), "n")
