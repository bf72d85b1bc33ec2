"""Checks of a submission by its manifest. User commands are never executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of severities; structural findings.
SEVERITY = {"critical": 3, "warning": 2, "info": 1}
STRUCTURAL = (("F-001", "paper_ok", "critical", "submission"), ("F-002", "repo_ok", "critical", "submission"), ("F-003", "env_ok", "warning", "environment"), ("F-004", "entry_ok", "warning", "execution"))


def submissions(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """manifests(case_id, paper, repo, environment array, entrypoints array, results) with
    what exists among files(case_id, path): paper_ok, repo_ok, env_ok, entry_ok, results_ok.
    Paths are relative to the manifest, entry points to the repository."""
    there = files.groupBy("case_id").agg(F.collect_set("path").alias("paths"))
    m = manifests.join(there, "case_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    has = lambda c: F.coalesce(F.array_contains("paths", c), F.lit(False))
    entry = F.transform(F.coalesce("entrypoints", F.array().cast("array<string>")), lambda e: F.concat("repo", F.lit("/"), e))
    repo = F.coalesce(F.exists("paths", lambda p: p.startswith(F.concat("repo", F.lit("/")))), F.lit(False))
    env = F.coalesce(F.arrays_overlap("paths", "environment"), F.lit(False))
    return m.select("case_id", has(F.col("paper")).alias("paper_ok"), repo.alias("repo_ok"), env.alias("env_ok"), ((F.size(entry) > 0) & F.coalesce(F.forall(entry, lambda e: F.array_contains("paths", e)), F.lit(False))).alias("entry_ok"), has(F.col("results")).alias("results_ok"))


def level(claims: Column | None = None) -> Column:
    """V0 to V3; without ``claims`` the preview that a precheck gives."""
    ready = F.col("env_ok") & F.col("entry_ok")
    numbers = ready & F.col("results_ok") & (claims if claims is not None else F.lit(True))
    return F.when(~F.col("paper_ok") | ~F.col("repo_ok"), "V0 Not Verifiable").when(~F.col("env_ok"), "V1 Static").when(numbers, "V3 Numerical").when(ready, "V2 Executable").otherwise("V1 Static")


def precheck(checked: DataFrame) -> DataFrame:
    flags = [F.col(c).cast("int") for c in ("paper_ok", "repo_ok", "env_ok", "entry_ok", "results_ok")]
    return checked.select("*", sum(flags[1:], flags[0]).alias("checks_passed"), F.lit(len(flags)).alias("checks_total"), level().alias("preview"))


def verification_findings(checked: DataFrame, compared: DataFrame) -> DataFrame:
    """(case_id, finding_id, severity, category): what a submission lacks, then claims that
    are missing or unparsed (warnings) or mismatched (critical), from F-101 in their order."""
    lacks = F.array(*[F.when(~F.col(ok), F.struct(F.lit(i).alias("finding_id"), F.lit(s).alias("severity"), F.lit(c).alias("category"))) for i, ok, s, c in STRUCTURAL])
    own = checked.select("case_id", F.explode(F.array_compact(lacks)).alias("f")).select("case_id", "f.*")
    from pyspark.sql import Window

    usable = compared.join(checked.where("results_ok").select("case_id"), "case_id", "left_semi").where("status <> 'matched'")
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("ord"))
    claims = usable.select("case_id", F.format_string("F-%d", n + 100).alias("finding_id"), F.when(F.col("status") == "mismatched", "critical").otherwise("warning").alias("severity"), F.lit("claim").alias("category"))
    return own.unionByName(claims)


def verification_report(checked: DataFrame, compared: DataFrame, findings: DataFrame) -> DataFrame:
    """Per case: level, overall status, findings by severity, claims checked, and the first
    finding by severity and id."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in SEVERITY.items()], F.lit(0))
    counts = findings.groupBy("case_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY], F.min(F.struct((-rank).alias("r"), "finding_id"))["finding_id"].alias("first_finding"))
    claims = compared.groupBy("case_id").agg(F.count("*").alias("n_claims"))
    out = checked.join(counts, "case_id", "left").join(claims, "case_id", "left").fillna(0, [*SEVERITY, "n_claims"])
    status = F.when(F.col("critical") > 0, "warning").when(F.col("warning") > 0, "attention").otherwise("pass")
    return out.select("case_id", level(F.col("n_claims") > 0).alias("level"), status.alias("overall_status"), *SEVERITY, F.when(F.col("results_ok"), F.col("n_claims")).otherwise(0).alias("claims_checked"), "first_finding")
