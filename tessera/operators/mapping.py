"""Sheets, paper paragraphs and claims: which figure a sheet holds, where the paper speaks
of it, and what agents and detectors say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digits import clean_text, risk_rank

#: Figures in sheet names and paragraphs.
SHEET_EXTENDED = r"(?i)ed\s*fig\.?\s*(\d+)([a-z]?)"
SHEET_MAIN = r"(?i)fig\.?\s*(\d+)([a-z]?)"
SHEET_MORE = r"(?i)\band\s*(\d+[a-z])"
MENTION = r"(?i)(extended data )?fig(?:\.?\s*(\d+)([a-z])?\b|\.\s*(\d+)\b)"
#: Statuses of a claim.
STATUSES = ("pending", "ran", "reused", "skipped", "warning", "failed", "not_run", "not_provided", "missing_material")
#: Rows that agents may hand in.
MOST_AGENT_ROWS = 200
PLACEHOLDER = "The source-data role mapped this claim, but no claim text was handed in."


def figure_keys(sheets: DataFrame) -> DataFrame:
    """sheets(workbook, sheet, ...) with ``keys``, an array of (kind, figure, panel,
    figure_id): extended data, or else the main figure, and every "and 3d" after it."""
    name = F.trim(F.regexp_replace(F.lower("sheet"), "source data", ""))
    blank = lambda c: F.when(c != "", c)

    def key(kind: str, figure: Column, panel: Column) -> Column:
        label = "Extended Data Fig." if kind == "extended_data" else "Fig."
        return F.struct(F.lit(kind).alias("kind"), figure.alias("figure"), panel.alias("panel"), F.concat(F.lit(label), figure, F.coalesce(panel, F.lit(""))).alias("figure_id"))

    part = lambda p, i: blank(F.regexp_extract(name, p, i))
    extended, main = part(SHEET_EXTENDED, 1), part(SHEET_MAIN, 1)
    first = F.when(extended.isNotNull(), key("extended_data", extended, part(SHEET_EXTENDED, 2))).when(main.isNotNull(), key("main_figure", main, part(SHEET_MAIN, 2)))
    more = F.transform(F.regexp_extract_all(name, F.lit(SHEET_MORE), F.lit(1)), lambda m: key("main_figure", F.regexp_extract(m, r"\d+", 0), F.regexp_extract(m, "[a-z]", 0)))
    return sheets.withColumn("keys", F.concat(F.array_compact(F.array(first)), more))


def mentions(blocks: DataFrame) -> DataFrame:
    """(kind, figure, panel, ...) of every figure mention in blocks(doc_id, start_line, text):
    each paragraph is read once, so sheets meet it by an equi-join."""
    hits = F.regexp_extract_all("text", F.lit(r"(?i)(?:extended data )?fig\.?\s*\d+[a-z]?\b"), F.lit(0))
    m = blocks.select("doc_id", "start_line", "text", F.explode(F.array_distinct(hits)).alias("m"))
    kind = F.when(F.lower("m").startswith("extended"), "extended_data").otherwise("main_figure")
    return m.select("doc_id", "start_line", "text", kind.alias("kind"), F.regexp_extract("m", r"(\d+)", 1).alias("figure"), F.lower(F.regexp_extract("m", r"\d+([A-Za-z]?)", 1)).alias("panel"), F.col("m").rlike(r"(?i)fig\.").alias("dotted")).distinct()


def paper_refs(sheets: DataFrame, blocks: DataFrame, most: int = 6) -> DataFrame:
    """(workbook, sheet, rank, start_line, text) of the paragraphs that mention a sheet's
    figure: its panel, or after a point the whole figure. The first ``most`` by key and line."""
    keys = figure_keys(sheets).select("workbook", "sheet", F.posexplode("keys").alias("ord", "k")).select("workbook", "sheet", "ord", "k.kind", "k.figure", F.coalesce("k.panel", F.lit("")).alias("own"))
    met = keys.join(mentions(blocks), ["kind", "figure"]).where((F.col("panel") == F.col("own")) | ((F.col("panel") == "") & F.col("dotted")))
    first = met.groupBy("workbook", "sheet", "doc_id", "start_line").agg(F.min("ord").alias("ord"), F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("workbook", "sheet").orderBy("ord", "doc_id", "start_line"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("workbook", "sheet", "rank", "doc_id", "start_line", F.substring("text", 1, 900).alias("text"))


def candidate_claims(refs: DataFrame, most: int = 5) -> DataFrame:
    """The first sentences of a sheet's references, of 30 characters at least, without image
    marks, equal 180-character beginnings once."""
    said = F.when(F.col("text").contains("|"), F.trim(F.regexp_extract("text", r"(?s)^[^|]*\|(.*)$", 1))).otherwise(F.col("text"))
    parts = refs.select("workbook", "sheet", "rank", F.posexplode(F.split(said, r"(?<=[.!?。！？])\s+")).alias("pos", "s")).withColumn("s", clean_text(F.col("s")))
    parts = parts.where((F.length("s") >= 30) & ~F.col("s").startswith("!") & ~F.col("s").startswith("x !"))
    place = Window.partitionBy("workbook", "sheet")
    once = parts.withColumn("again", F.row_number().over(Window.partitionBy("workbook", "sheet", F.lower(F.substring("s", 1, 180))).orderBy("rank", "pos"))).where("again = 1")
    return once.withColumn("claim", F.row_number().over(place.orderBy("rank", "pos"))).where(F.col("claim") <= most).select("workbook", "sheet", "claim", F.substring("s", 1, 700).alias("text"))


def claim_mappings(sheets: DataFrame, blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a sheet: figures, references, linked findings, confidence, status, priority.
    findings(finding_id, workbook, sheet, risk_level, artifact_likelihood)."""
    keyed = figure_keys(sheets).select("workbook", "sheet", "keys")
    refs = paper_refs(sheets, blocks).groupBy("workbook", "sheet").agg(F.count("*").alias("n_refs"))
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    weighty = (risk_rank(F.col("risk_level")) >= 2) & (F.coalesce("artifact_likelihood", F.lit("unknown")) != "high")
    linked = findings.groupBy("workbook", "sheet").agg(F.count("*").alias("n_linked"), ids(F.when(weighty, F.col("finding_id"))).alias("priority"), ids(F.col("finding_id")).alias("linked"))
    out = keyed.join(refs, ["workbook", "sheet"], "left").join(linked, ["workbook", "sheet"], "left").fillna({"n_refs": 0, "n_linked": 0, "priority": "", "linked": ""})
    some, figures = F.col("n_refs") > 0, F.array_join(F.transform("keys", lambda k: k["figure_id"]), ", ")
    order = Window.partitionBy(F.lit("CM")).orderBy("workbook", "sheet")  # a row a sheet of one case
    return out.select(
        F.format_string("CM-%04d", F.row_number().over(order)).alias("mapping_id"), "workbook", "sheet", F.when(figures != "", figures).alias("source_figure_id"), F.element_at(F.transform("keys", lambda k: k["kind"]), F.when(F.size("keys") > 0, 1)).alias("source_figure_kind"),
        "n_refs", "linked", "priority", F.when(some & (F.size("keys") > 0), "high").when(some, "medium").otherwise("low").alias("mapping_confidence"), F.when(some, "candidate_mapping").otherwise("needs_manual_mapping").alias("status"),
        F.when(F.col("priority") != "", "high").when((F.col("n_linked") > 0) | some, "medium").otherwise("low").alias("review_priority"),
    )


def claim_status(status: Column) -> Column:
    """A known status, or pending."""
    return F.when(status.isin(*STATUSES), status).otherwise("pending")


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows that agents may hand in, in their order ``ord``."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord"))).where(F.col("n") <= MOST_AGENT_ROWS)


def agent_mappings(mappings: DataFrame, deterministic: DataFrame) -> DataFrame:
    """Agents' mappings(ord, mapping_id, claim_id, confidence, needs_human_review, refs) with
    the detector's mapping that they refine, or, if there are none, the detector's own."""
    rows = _numbered(mappings)
    ids = F.format_string("ACM-%03d", "n")
    known = deterministic.select(F.col("mapping_id").alias("known"), "sheet")
    refined = rows.join(known, rows["mapping_id"] == known["known"], "left").select(F.coalesce("mapping_id", ids).alias("mapping_id"), F.coalesce("claim_id", ids).alias("claim_id"), F.coalesce("confidence", F.lit("medium")).alias("confidence"), F.lit("agent_refined_mapping").alias("status"), F.coalesce("needs_human_review", F.lit(True)).alias("needs_human_review"), "sheet")
    none = rows.agg(F.count("*").alias("handed_in")).where("handed_in = 0").drop("handed_in")
    own = deterministic.join(F.broadcast(none.select(F.lit(True).alias("fallback"))), how="cross")
    own = own.select("mapping_id", F.regexp_replace("mapping_id", "^CM-", "CL-").alias("claim_id"), F.col("mapping_confidence").alias("confidence"), "status", F.lit(True).alias("needs_human_review"), "sheet")
    return refined.unionByName(own)


def agent_claims(claims: DataFrame, mappings: DataFrame) -> DataFrame:
    """Agents' claims(ord, claim_id, text, status) and placeholders for claims that only
    mappings name: (claim_id, text, status, origin). Claims without text are dropped."""
    said = _numbered(claims).where("text <> ''").select(F.coalesce("claim_id", F.format_string("AC-%03d", "n")).alias("claim_id"), "text", claim_status(F.col("status")).alias("status"), F.lit("agent_refined").alias("origin"))
    named = _numbered(mappings).select(F.coalesce("claim_id", F.format_string("ACM-%03d", "n")).alias("claim_id")).distinct()
    missing = named.join(said, "claim_id", "left_anti").select("claim_id", F.lit(PLACEHOLDER).alias("text"), F.lit("warning").alias("status"), F.lit("agent_refined_placeholder").alias("origin"))
    return said.unionByName(missing)


def stand_in_claims(mappings: DataFrame, claims: DataFrame, most: int = 12) -> DataFrame:
    """What a role would say without an agent: the first sentence of the first mappings."""
    first = claims.where("claim = 1").select("workbook", "sheet", "text")
    return mappings.join(first, ["workbook", "sheet"]).orderBy("mapping_id").limit(most).select(F.regexp_replace("mapping_id", "^CM-", "CL-").alias("claim_id"), "mapping_id", "text", F.lit("pending").alias("status"))
