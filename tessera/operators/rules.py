"""Text rules: a folder of YAML files, matched against documents."""

from __future__ import annotations

import functools
import logging
import re
from dataclasses import dataclass
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.digits import safe_id

RULES = Path(__file__).resolve().parent.parent / "rules"
CHECKLISTS = RULES.parent / "checklists"

#: How a text shows its study type.
STUDY_TYPES = {
    "cross_sectional": r"\b(?:cross[ .-]sectional|prevalence\s+survey)\b",
    "case_control": r"\b(?:case[ .-]control|case control)\b",
    "cohort": r"\b(?:cohort|prospective\s+(?:cohort|study|follow)|longitudinal)\b",
    "rct": r"\b(?:randomi[sz]ed\s+(?:controlled\s+)?(?:trial|study|experiment)|RCT\b|clinical\s+trial)\b",
    "ecological": r"\b(?:ecological\s+study|ecological\s+analysis)\b",
    "systematic_review": r"\b(?:systematic\s+review|meta[ .-]analysis)\b",
    "observational": r"\b(?:observational|cohort|case[ .-]control|cross[ .-]sectional)\b",
    "diagnostic": r"\b(?:diagnostic\s+(?:accuracy|test|performance)|ROC\s+curve|AUC\b)\b",
    "experimental": r"\b(?:HEK293|HeLa|cell\s+line|cell\s+culture|primary\s+cells?|mice|mouse|rats?|in\s+vivo|in\s+vitro|animal\s+model)\b",
}
#: Risk of a severity.
SEVERITY_RISK = {"red": "high", "orange": "medium", "yellow": "low", "green": "info"}
#: Characters of an excerpt on both sides of a hit, and of an excerpt in the evidence text.
AROUND, QUOTED = 60, 300


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    title: str
    severity: str
    rule_type: str
    study_types: tuple[str, ...]
    keywords: tuple[tuple[str, bool], ...]  # (term, is it a pattern?)
    negatives: tuple[str, ...]
    evidence_template: str
    human_review: str
    source: str

    def patterns(self) -> list[str]:
        return [k if is_pattern else re.escape(k) for k, is_pattern in self.keywords]


def _yaml(path: Path) -> dict:
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def _rule(raw: dict, file: dict, name: str) -> Rule:
    detection = raw.get("detection") or {}
    triggers = detection.get("triggers") or {}
    words = [(k, False) if isinstance(k, str) else (k.get("pattern", ""), k.get("type") == "regex") for k in triggers.get("keywords") or []]
    return Rule(
        raw.get("id", f"{name}.unknown"), raw.get("category", file.get("category", "")), raw.get("title", ""), raw.get("severity", "yellow"), raw.get("type", file.get("type", "methodology_review")),
        tuple(triggers.get("study_types") or ()), tuple(w for w in words if w[0]), tuple(triggers.get("negative_triggers") or detection.get("negative_triggers") or ()),
        raw.get("evidence_template", ""), raw.get("human_review", ""), raw.get("source", name),
    )


def load_rules(folder: str | Path = RULES) -> list[Rule]:
    """Rules of all YAML files of a folder, by file and place; a broken file only warns."""
    out: list[Rule] = []
    for path in sorted(Path(folder).glob("*.yaml")):
        try:
            raw = _yaml(path)
            out += [_rule(r, raw, path.stem) for r in raw.get("rules") or []]
        except Exception as e:  # any broken file
            logging.getLogger(__name__).warning("no rules from %s: %s", path, e)
    return out


def load_checklists(spark: SparkSession, folder: str | Path = CHECKLISTS) -> DataFrame:
    """(checklist, place, item, section, text) of the YAML checklists of a folder."""
    rows = [(p.stem, i, str(x.get("item")), x.get("section"), x.get("text")) for p in sorted(Path(folder).glob("*.yaml")) for i, x in enumerate(_yaml(p).get("checklist") or [])]
    return spark.createDataFrame(rows, "checklist string, place int, item string, section string, text string")


def reviewer_form(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row a rule, with fields to fill in."""
    rows = [(r.rule_id, r.category, r.title, r.severity, r.rule_type, r.human_review) for r in rules]
    form = spark.createDataFrame(rows, "rule_id string, category string, title string, severity string, rule_type string, human_review_guide string")
    return form.select("*", *[F.lit("").alias(c) for c in ("score", "evidence_found", "reviewer_comment")])


def _flags(pattern: str) -> str:
    return f"(?iuU){pattern}"


def _any(patterns: list[str]) -> str:
    return _flags("(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def gate(study_type: str) -> str:
    """Pattern of a study type, or of its name if it is none of the known ones."""
    return STUDY_TYPES.get(study_type, re.escape(study_type))


def _excerpt(text: Column, pattern: str) -> Column:
    """AROUND characters on both sides of the first hit, new lines as spaces; null without one."""
    p = F.lit(_flags(pattern))
    at, hit = F.regexp_instr(text, p), F.regexp_substr(text, p)
    start = F.greatest(F.lit(1), at - AROUND)
    said = F.regexp_replace(F.substring(text, start, at + F.length(hit) + AROUND - start), "\n", " ")
    return F.regexp_replace(said, r"(?U)^\s+|\s+$", "")


def triggered(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, text, rule) of the rules, by place, that docs(doc_id, text) trigger.

    A rule needs one of its study types, if it names some, one of its keywords, if it has
    some, and none of its negatives; one with negatives alone fires on their absence. Null
    and empty texts trigger nothing. All rules are columns of one pass: texts are neither
    joined nor copied before the filter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    types = sorted({t for r in rules for t in r.study_types})
    seen = docs.select("doc_id", text.alias("text"), *[text.rlike(_flags(gate(t))).alias(f"is_{i}") for i, t in enumerate(types)])
    fires = []
    for i, r in enumerate(rules):
        holds = F.col("text") != ""
        if r.study_types:
            holds &= functools.reduce(or_, [F.col(f"is_{types.index(t)}") for t in r.study_types])
        if r.keywords:
            holds &= F.col("text").rlike(_any(r.patterns()))
        if r.negatives:
            holds &= ~F.col("text").rlike(_any([re.escape(n) for n in r.negatives]))
        fires.append(F.when(holds, F.lit(i)))
    if not rules:
        return docs.select("doc_id", text.alias("text"), F.lit(0).alias("rule")).limit(0)
    return seen.select("doc_id", "text", F.explode(F.array_compact(F.array(*fires))).alias("rule"))


def match_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rule_id, excerpts, evidence) of triggered rules; excerpts are the first hit
    of each keyword that occurs, the evidence text quotes the first one, or N/A."""
    found = triggered(docs, rules)
    excerpts, ids, templates = [], [], []
    for i, r in enumerate(rules):
        here = F.col("rule") == i
        excerpts.append(F.when(here, F.array_compact(F.array(*[_excerpt(F.col("text"), p) for p in r.patterns()])) if r.keywords else F.array().cast("array<string>")))
        ids.append(F.when(here, F.lit(r.rule_id)))
        templates.append(F.when(here, F.lit(r.evidence_template)))
    if not rules:
        return found.select("doc_id", F.lit("").alias("rule_id"), F.array().cast("array<string>").alias("excerpts"), F.lit("").alias("evidence"))
    out = found.select("doc_id", F.coalesce(*ids).alias("rule_id"), F.coalesce(*excerpts).alias("excerpts"), F.coalesce(*templates).alias("template"))
    quoted = F.when(F.size("excerpts") > 0, F.substring(F.element_at("excerpts", 1), 1, QUOTED)).otherwise("N/A")
    return out.select("doc_id", "rule_id", "excerpts", F.replace("template", F.lit("{excerpt}"), quoted).alias("evidence"))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.rule_id, r.category, r.title, r.severity, r.rule_type, r.human_review) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, category string, title string, severity string, rule_type string, human_review string")


def rule_summary(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Documents that trigger each rule, of all."""
    spark = docs.sparkSession
    counts = triggered(docs, rules).groupBy("rule").agg(F.count("*").alias("n"))
    named = spark.createDataFrame(list(enumerate(r.rule_id for r in rules)), "rule int, rule_id string")
    total = docs.agg(F.count("*").alias("n_documents"))
    return named.join(counts, "rule", "left").join(F.broadcast(total)).select("rule_id", F.coalesce("n", F.lit(0)).alias("n_triggered"), "n_documents")


def severity_summary(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Triggered rules by document: in all, by type and by severity."""
    spark = docs.sparkSession
    kinds = spark.createDataFrame([(i, r.severity, r.rule_type) for i, r in enumerate(rules)], "rule int, severity string, rule_type string")
    found = docs.select("doc_id").join(triggered(docs, rules).select("doc_id", "rule").join(F.broadcast(kinds), "rule"), "doc_id", "left")
    count = [F.count_if(F.col("rule_type") == t).alias(f"{t}_triggered") for t in ("methodology_review", "fraud_detection")] + [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("red", "orange", "yellow")]
    return found.groupBy("doc_id").agg(F.lit(len(rules)).alias("total_rules"), F.count("rule").alias("total_triggered"), *count)


def rule_findings(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Triggered rules as findings: id, category by type, risk by severity, evidence."""
    risk = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in SEVERITY_RISK.items()], F.lit("low"))
    found = match_rules(docs, rules).join(F.broadcast(rule_table(docs.sparkSession, rules)), "rule_id")
    return found.select("doc_id", F.concat(F.lit("PF-"), safe_id(F.col("rule_id"))).alias("finding_id"), F.concat(F.lit("rules."), "rule_type").alias("category"), risk.alias("risk_level"), F.col("title").alias("summary"), "rule_id", "severity", "evidence", F.size("excerpts").alias("n_excerpts"))
