"""Findings for a report: union, order, groups, references, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digits import risk_rank

#: Pattern of a category, then tokens of category or artifact, in this order.
PATTERNS = {
    "paired_offset_ratio_reuse": ("row_offset_scalar_multiple", "long_format_paired_ratio_reuse", "long_format_within_pair_ratio_enrichment"),
    "row_vector_reuse_rounding": ("duplicate_row_vector", "row_offset_partial_copy_rounding_bias", "duplicate_numeric_columns"),
    "formula_derivation": ("formula_derived_column", "formula_derived_columns", "fixed_ratio", "fixed_difference"),
}
TOKENS = {
    "visual_forensics": ("image", "visual", "panel", "trufor", "copy_move", "cbir", "similarity"),
    "numeric_forensics": ("numeric", "benford", "number"),
    "execution_evidence": ("execution", "command", "runtime"),
}
#: Report order of the patterns (7: any other).
PATTERN_ORDER = {"paired_offset_ratio_reuse": 0, "row_vector_reuse_rounding": 1, "formula_derivation": 2, "visual_forensics": 3, "numeric_forensics": 4, "execution_evidence": 5, "other": 9}
#: Chapters of the report, in order.
CHAPTERS = ("consistency", "matching", "completeness")
SUPPORT = ("support_rows", "matched_pairs", "matched_pair_groups", "duplicate_row_count", "exact_reuse_pairs", "equal_rows")
OVERLAP = ("overlap_rows", "overlap_pairs", "overlap_pair_groups")
DETECTOR_STEPS = ("source_data_profile", "source_data_findings", "source_data_pair_forensics", "exact_image_duplicates")


def _present(df: DataFrame, names) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns] or [F.lit(None).cast("long")]


def pattern_key(category: Column, artifact: Column) -> Column:
    """The report's pattern of a finding."""
    category, where = F.coalesce(category, F.lit("")), F.lower(F.concat(F.coalesce(category, F.lit("")), F.lit("\n"), F.coalesce(artifact, F.lit(""))))
    known = [F.when(category.isin(*c), k) for k, c in PATTERNS.items()]
    told = [F.when(where.rlike("|".join(t)), k) for k, t in TOKENS.items()]
    return F.coalesce(*known, *told, F.when(category != "", F.concat(F.lit("category:"), category)), F.lit("other"))


def support_value(df: DataFrame) -> Column:
    """The first support count that a finding has, or 0."""
    return F.coalesce(*_present(df, SUPPORT), F.lit(0)).cast("long")


def support_text(df: DataFrame) -> Column:
    """support/overlap with its rate, support alone, or that none was recorded."""
    s, o = (F.coalesce(*[F.nullif(c, F.lit(0)) for c in _present(df, n)]) for n in (SUPPORT, OVERLAP))
    rate = F.coalesce(F.col("support_rate").cast("string"), F.lit("-")) if "support_rate" in df.columns else F.lit("-")
    return F.when(s.isNotNull() & o.isNotNull(), F.concat(F.lit("support "), s.cast("string"), F.lit("/"), o.cast("string"), F.lit(", rate "), rate)).when(s.isNotNull(), F.concat(F.lit("support "), s.cast("string"))).otherwise("support not recorded")


def report_findings(*sources: DataFrame) -> DataFrame:
    """Union of finding tables, earlier tables first: findings with one id are the first of
    them, those without stay. Ordered by risk, support, artifact, id with ``position``."""
    every = None
    for i, df in enumerate(sources):
        df = df.withColumn("source_ord", F.lit(i))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    again = F.row_number().over(Window.partitionBy("finding_id").orderBy("source_ord", "category"))
    once = every.withColumn("again", F.when(F.col("finding_id").isNotNull(), again).otherwise(1)).where("again = 1").drop("again")
    order = [F.desc(risk_rank(F.col("risk_level"))), F.desc(support_value(once)), F.coalesce("source_artifact", F.lit("")), F.coalesce("finding_id", F.lit("")), "category"]
    # Findings of one case: a report's worth.
    return once.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def evidence_cards(findings: DataFrame, most: int = 8) -> DataFrame:
    """The findings that get a card."""
    support = F.coalesce(F.nullif("support_rows", F.lit(0)), "equal_rows", F.lit(0)).alias("support")
    return findings.select("finding_id", "risk_level", support).orderBy(F.desc(risk_rank(F.col("risk_level"))), F.desc("support"), "finding_id").limit(most)


def mentioned(refs: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """(finding_id, key) where a reference text names a finding. Ids in a text are read off
    by their form, so that both meet by an equi-join; an id inside a longer one counts too."""
    ids = findings.select("finding_id").where("finding_id <> ''").distinct()
    tokens = refs.select(key, F.explode(F.array_distinct(F.regexp_extract_all("ref", F.lit(r"[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+"), F.lit(0)))).alias("token"))
    starts = tokens.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda n: F.substring("token", F.lit(1), n))).alias("finding_id"))
    return starts.join(ids, "finding_id").distinct()


def linked_rows(findings: DataFrame, mappings: DataFrame, claims: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per finding: claims (through mappings' references and their own) and tasks that name
    it, as sorted ids. mappings(claim_id, ref), claims(claim_id, ref), tasks(task_id, ref)."""
    through = mentioned(mappings, findings, "claim_id").join(claims.select("claim_id").distinct(), "claim_id", "left_semi")
    by_claim = through.select("finding_id", "claim_id").union(mentioned(claims, findings, "claim_id").select("finding_id", "claim_id")).distinct()
    joined = lambda df, c: df.groupBy("finding_id").agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s"))
    out = findings.select("finding_id").distinct()
    for df, c in ((by_claim, "claim_id"), (mentioned(tasks, findings, "task_id"), "task_id")):
        out = out.join(joined(df, c), "finding_id", "left")
    return out.select("finding_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("claim_ids", "task_ids")])


def _explanations(findings: DataFrame) -> Column:
    """The first two explanations of each finding, distinct in order, five at most."""
    two = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.slice("benign_explanations", 1, 2).alias("e")))), lambda x: x["e"])
    return F.slice(F.array_distinct(F.filter(F.flatten(two), lambda x: x != "")), 1, 5)


def pattern_report(findings: DataFrame) -> DataFrame:
    """Findings by pattern: ids (by risk, sheet, id), sheets, workbooks, number of categories,
    risk, explanations, in the report's order with pattern_id."""
    keyed = findings.withColumn("pattern_key", pattern_key(F.col("category"), F.col("source_artifact")))
    order = Window.partitionBy("pattern_key").orderBy(F.desc(risk_rank(F.col("risk_level"))), F.coalesce("sheet", F.lit("")), "finding_id")
    keyed = keyed.withColumn("ord", F.row_number().over(order))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "finding_id"))), lambda x: x["finding_id"]), ",")
    sorted_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = keyed.groupBy("pattern_key").agg(F.count("*").alias("n_findings"), ids.alias("finding_ids"), sorted_set("sheet").alias("sheets"), sorted_set("workbook").alias("workbooks"), F.countDistinct("category").alias("n_categories"), F.max(F.struct(risk_rank(F.col("risk_level")), "risk_level"))["risk_level"].alias("risk_level"), F.array_join(_explanations(keyed), " / ").alias("benign_explanations"))
    place = F.coalesce(*[F.when(F.col("pattern_key") == k, v) for k, v in PATTERN_ORDER.items()], F.lit(7))
    return out.withColumn("pattern_id", F.format_string("P-%03d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(place, F.desc("n_findings"), "pattern_key"))))


def cluster_report(findings: DataFrame, most: int = 6) -> DataFrame:
    """Findings by (source, anchor): the first of workbook, path or artifact, and of sheet,
    figure, panel or category; the highest and largest groups first."""
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit("-"))
    keyed = findings.withColumns({"source": first("workbook", "source_path", "source_artifact"), "anchor": first("sheet", "figure", "panel_id", "category"), "rank": risk_rank(F.col("risk_level")), "support": support_value(findings)})
    key = F.struct((-F.col("rank")).alias("r"), (-F.col("support")).alias("s"), "finding_id")
    out = keyed.groupBy("source", "anchor").agg(F.max("rank").alias("max_risk"), F.count("*").alias("n_findings"), F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["finding_id"]), ",").alias("finding_ids"))
    order = [F.desc("max_risk"), F.desc("n_findings"), "anchor", "source"]
    top = out.orderBy(*order).limit(most)
    return top.withColumn("cluster_id", F.format_string("EC-%03d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))))


def chapters(findings: DataFrame) -> DataFrame:
    """Findings by issue category, in the report's order; without one it is consistency."""
    kind = F.coalesce("issue_category", F.lit(CHAPTERS[0]))
    n = findings.groupBy(kind.alias("issue_category")).agg(F.count("*").alias("n_findings"))
    place = F.coalesce(*[F.when(F.col("issue_category") == c, i + 1) for i, c in enumerate(CHAPTERS)])
    return n.select(place.alias("chapter"), "issue_category", "n_findings").where("chapter is not null")


def finding_lines(findings: DataFrame) -> DataFrame:
    """(finding_id, locator, support): where a finding lies and what supports it."""
    named = [("cols", F.array_join("columns", ",")), *((c, F.col(c).cast("string")) for c in ("row_offset", "pair_id_offset", "figure", "panel_id", "page", "line") if c in findings.columns)]
    parts = [F.when(v != "", F.concat(F.lit(f"{n}="), v)) for n, v in named]
    locator = F.concat_ws("; ", *parts)
    return findings.select("finding_id", F.when(locator != "", locator).otherwise("-").alias("locator"), support_text(findings).alias("support"))


def first_reviews(findings: DataFrame, reviews: DataFrame, risks: DataFrame) -> DataFrame:
    """Per finding the last review(ord, finding_id, review_id) and the first risk(ord,
    risk_id, finding_id) that lists it."""
    last = reviews.groupBy("finding_id").agg(F.max_by("review_id", "ord").alias("review_id"))
    first = risks.groupBy("finding_id").agg(F.min_by("risk_id", "ord").alias("risk_id"))
    return findings.select("finding_id").distinct().join(last, "finding_id", "left").join(first, "finding_id", "left")


def claim_impact(mappings: DataFrame, claims: DataFrame, most: int = 14) -> DataFrame:
    """Mappings(ord, claim_id, refs, needs_human_review) with their claim's text, the first
    four references, the first six that name findings, and whether they need review."""
    found = F.filter("refs", lambda r: r.contains("forensics:") | F.lower(r).contains("finding"))
    top = mappings.orderBy("ord").limit(most)
    joined = top.join(claims.select("claim_id", "text"), "claim_id", "left")
    shown = lambda refs, n: F.when(F.size(refs) > 0, F.array_join(F.slice(refs, 1, n), ", ")).otherwise("-")
    return joined.select("ord", "claim_id", F.coalesce(F.substring("text", 1, 260), F.lit("-")).alias("text"), shown(F.col("refs"), 4).alias("evidence_refs"), shown(found, 6).alias("finding_refs"), F.coalesce("needs_human_review", F.lit(True)).alias("needs_review"))


def source_paths(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(finding_id, source_path): the first three different paths of the evidence refs."""
    refs = findings.select("finding_id", F.posexplode("evidence_refs").alias("ord", "evidence_id")).join(evidence.select("evidence_id", "source_path"), "evidence_id").where("source_path <> ''")
    paths = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_path"))), lambda x: x["source_path"]))
    got = refs.groupBy("finding_id").agg(F.array_join(F.slice(paths, 1, 3), ", ").alias("source_path"))
    return findings.select("finding_id").distinct().join(got, "finding_id", "left").fillna({"source_path": ""})


def evidence_items(artifacts: DataFrame, source: DataFrame, pairs: DataFrame, most: int = 100) -> DataFrame:
    """Evidence ids over artifacts(ord, name) and the two detectors' findings(ord,
    finding_id, workbook), ``most`` of each; one counter runs through all three."""
    head = lambda df, part, prefix, path, finding: df.orderBy("ord").limit(most).select(F.lit(part).alias("part"), "ord", F.lit(prefix).alias("prefix"), path.alias("source_path"), finding.alias("finding_id"))
    none = F.lit(None).cast("string")
    every = head(artifacts, 0, "EV-ART", F.col("name"), none).unionByName(head(source, 1, "EV-SD", F.col("workbook"), F.col("finding_id"))).unionByName(head(pairs, 2, "EV-PF", F.col("workbook"), F.col("finding_id")))
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "ord"))  # 300 rows at most
    return every.select(F.format_string("%s-%04d", "prefix", n).alias("evidence_id"), "source_path", "finding_id")


def canonical_findings(rule_findings: DataFrame, source: DataFrame, pairs: DataFrame, evidence: DataFrame, missing: DataFrame) -> DataFrame:
    """The case's findings: rules, both detectors with their evidence, and what is missing:
    missing(item) materials, and that nothing was executed."""
    cols = ("finding_id", "category", "risk_level", "summary", "issue_category")
    lit = lambda *v: [F.lit(x).alias(c) for x, c in zip(v, cols)]
    rules = rule_findings.select("finding_id", "category", "risk_level", "summary", F.lit("consistency").alias("issue_category"))
    found = source.unionByName(pairs, allowMissingColumns=True).select("finding_id", "category", "risk_level", F.concat("category", F.lit(" in "), "workbook", F.lit(" / "), "sheet").alias("summary"), F.lit("consistency").alias("issue_category"))
    gaps = missing.agg(F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("items")).where("items <> ''")
    gaps = gaps.select(*lit("COMP-MAT-001", "material_missing", "medium")[:3], F.concat(F.lit("missing materials: "), "items").alias("summary"), F.lit("completeness").alias("issue_category"))
    not_run = missing.sparkSession.range(1).select(*lit("COMP-EXEC-001", "execution_status_not_available", "low", "nothing was executed: not_provided", "completeness"))
    every = rules.unionByName(found).unionByName(gaps).unionByName(not_run)
    return every.join(evidence.where("finding_id is not null").select("finding_id", "evidence_id"), "finding_id", "left")


def report_verdicts(cases: DataFrame, findings: DataFrame, tasks: DataFrame, steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per case(case_id, execution_status, n_mappings, n_traces): verdict and depth. Critical
    findings fail; findings, tasks, failed or warning steps need review."""
    counts = [findings.groupBy("case_id").agg(F.count("*").alias("n_findings"), F.max(risk_rank(F.col("risk_level"))).alias("top")), tasks.groupBy("case_id").agg(F.count("*").alias("n_tasks")),
              steps.groupBy("case_id").agg(F.count("*").alias("n_steps"), F.max(F.col("status").isin("failed", "warning")).alias("trouble"), F.max(F.col("step_key").isin(*DETECTOR_STEPS)).alias("detected")), evidence.groupBy("case_id").agg(F.count("*").alias("n_evidence"))]
    out = cases
    for c in counts:
        out = out.join(c, "case_id", "left")
    out = out.fillna({"n_findings": 0, "top": 0, "n_tasks": 0, "n_steps": 0, "trouble": False, "detected": False, "n_evidence": 0})
    verdict = F.when(F.col("top") >= 4, "fail").when((F.col("n_findings") > 0) | (F.col("n_tasks") > 0) | F.col("trouble"), "warning").otherwise("pass")
    depth = F.when((F.col("n_evidence") == 0) & (F.col("n_steps") == 0), "V0").when(F.col("execution_status") == "ran", "V4").when((F.col("n_mappings") > 0) | (F.col("n_traces") > 0), "V3").when(F.col("detected"), "V2").otherwise("V1")
    return out.select("case_id", verdict.alias("verdict"), F.concat(depth, F.lit(" coverage")).alias("depth"))


def trace_counts(traces: DataFrame) -> DataFrame:
    """Role traces by status."""
    return traces.groupBy(F.coalesce("status", F.lit("-")).alias("status")).agg(F.count("*").alias("n_roles"))
