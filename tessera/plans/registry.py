"""Tools by id: phases, parameters, checks of what a planner asks for, rounds, steps."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.params import ColumnParams, CrossSheetParams, ImageParams, PairParams, Params

#: Most investigation rounds.
ROUNDS = 3


@dataclass(frozen=True)
class Tool:
    tool_id: str
    step_key: str
    title: str
    phase: str = "agent_selectable"
    selectable: bool = False
    deterministic: bool = True
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    params: type[Params] | None = None


#: Tool ids, step keys and artifacts.
TOOLS = {t.tool_id: t for t in (
    Tool("mineru.parse_pdf", "mineru", "Parse the paper", "mandatory_bootstrap", inputs=("paper.pdf",), outputs=("full.md", "mineru_manifest.json", "images/")),
    Tool("paper.evidence_ledger", "evidence_ledger", "Evidence ledger", "mandatory_bootstrap", inputs=("full.md",), outputs=("evidence_ledger.json",)),
    Tool("paper.numeric_forensics", "numeric_forensics", "Numbers of the text", "mandatory_bootstrap", inputs=("full.md",), outputs=("numeric_forensics.json",)),
    Tool("paperfraud.rule_match", "paperfraud_rules", "Text rules", "mandatory_bootstrap", inputs=("full.md",), outputs=("paperfraud_rule_matches.json",)),
    Tool("material.inventory", "material_inventory", "Files of the submission", "mandatory_bootstrap", outputs=("material_inventory.json",)),
    Tool("agent.material_plan", "agent_material_plan", "Plan of materials", "mandatory_bootstrap", deterministic=False, inputs=("material_inventory.json",), outputs=("agent_material_plan.json",)),
    Tool("source_data.profile", "source_data_profile", "Sheet profiles", selectable=True, inputs=("material_inventory.json",), outputs=("source_data_profile.json",)),
    Tool("source_data.findings", "source_data_findings", "Column relations", selectable=True, inputs=("source_data_profile.json", "full.md"), outputs=("source_data_findings.json",), params=ColumnParams),
    Tool("source_data.pair_forensics", "source_data_pair_forensics", "Offsets and pairs", selectable=True, inputs=("source_data_profile.json",), outputs=("source_data_pair_forensics.json",), params=PairParams),
    Tool("source_data.cross_sheet", "source_data_cross_sheet", "Columns across sheets", selectable=True, inputs=("source_data_profile.json",), outputs=("source_data_cross_sheet.json",), params=CrossSheetParams),
    Tool("image.exact_duplicates", "exact_image_duplicates", "Equal images", selectable=True, inputs=("images/",), outputs=("exact_image_duplicates.json",)),
    Tool("image.similarity_candidates", "image_similarity", "Similar images", selectable=True, inputs=("images/",), outputs=("image_similarity_candidates.json",), params=ImageParams),
    Tool("static_audit.bundle", "static_audit_bundle", "Bundle", "report_only", outputs=("static_audit_bundle.json",)),
    Tool("agent.review", "agent_review", "Review", "reserved", deterministic=False, outputs=("agent_review.json",)),
    Tool("agent.role.claim_extractor", "agent_claim_extractor", "Claims", "reserved", deterministic=False, outputs=("agent_claim_extractor.json",)),
    Tool("agent.role.source_data_auditor", "agent_source_data_auditor", "Source data", "reserved", deterministic=False, outputs=("agent_source_data_auditor.json",)),
    Tool("agent.role.judge", "agent_judge", "Judge", "reserved", deterministic=False, outputs=("agent_judge.json",)),
    Tool("report.render_markdown", "final_report", "Markdown report", "report_only", outputs=("final_audit_report.md",)),
    Tool("report.render_static_html", "html_report", "HTML report", "report_only", outputs=("final_audit_report.html",)),
)}
#: Names of parameters as planners write them.
ALIASES = {"max_findings_per_category": "cap", "min_duplicate_row_width": "min_width"}


def catalog(spark: SparkSession, investigation: bool = False) -> DataFrame:
    """Tools as rows; for an investigation, only those that it may choose."""
    kept = [t for t in TOOLS.values() if not investigation or (t.selectable and t.deterministic)]
    rows = [(t.tool_id, t.step_key, t.title, t.phase, t.selectable, t.deterministic, ",".join(t.inputs), ",".join(t.outputs), json.dumps({f.name: f.default for f in fields(t.params)} if t.params else {}, sort_keys=True)) for t in kept]
    return spark.createDataFrame(rows, "tool_id string, step_key string, title string, phase string, selectable boolean, deterministic boolean, inputs string, outputs string, defaults string")


def coerced(tool_id: str, params: dict) -> dict:
    """A tool's parameters with its defaults; unknown names are dropped, bounds raise."""
    kind = TOOLS[tool_id].params
    if kind is None:
        return {}
    given = {ALIASES.get(k, k): v for k, v in params.items()}
    types = {f.name: type(f.default) for f in fields(kind)}
    return {f.name: getattr(kind(**{k: types[k](v) for k, v in given.items() if k in types}), f.name) for f in fields(kind)}


def validated(action: dict) -> dict:
    """An investigation's action, normalised; raises ValueError if it can't be run."""
    tool = TOOLS.get(action.get("tool_id")) if isinstance(action, dict) else None
    if tool is None or not tool.selectable or not tool.deterministic:
        raise ValueError("not a tool that an investigation may choose")
    out = {"action_id": str(action.get("action_id") or ""), "tool_id": tool.tool_id, "params": coerced(tool.tool_id, action.get("params") or {}), "hypothesis": str(action.get("hypothesis") or "")[:1000],
           "depends_on_artifacts": [x for x in action.get("depends_on_artifacts") or [] if isinstance(x, str)][:20], "expected_evidence_type": str(action.get("expected_evidence_type") or "")[:120]}
    for key in ("hypothesis", "depends_on_artifacts", "expected_evidence_type"):
        if not out[key]:
            raise ValueError(f"an action needs {key}")
    return out


def selected(plan: dict | None) -> list[str]:
    """Tools that a plan names, by id or by the older step keys; all if it names none."""
    by_step = {t.step_key: t.tool_id for t in TOOLS.values()}
    ids = [x.get("tool_id") for x in (plan or {}).get("selected_tools") or [] if isinstance(x, dict) and x.get("tool_id") in TOOLS]
    return ids or [by_step[s] for s in (plan or {}).get("selected_steps") or [] if s in by_step] or list(TOOLS)


def signature(action: dict) -> str:
    """Equal for equal tools, parameters and artifacts in any order."""
    return hashlib.sha256(json.dumps([action["tool_id"], action["params"], sorted(action["depends_on_artifacts"])], sort_keys=True).encode()).hexdigest()


def investigate(plans: Iterable[list[dict]], artifacts: set[str], run: Callable[[dict], list[str]], seen: set[str] = frozenset()) -> tuple[list[dict], str]:
    """Rounds of actions: (records, why it stopped). Known signatures and actions whose
    artifacts are missing are rejected; a round without new artifacts is the last."""
    seen, there, records = set(seen), set(artifacts), []
    for number, actions in enumerate(plans, 1):
        if number > ROUNDS:
            break
        if not actions:
            return records, "no_more_tools"
        fresh = 0
        for raw in actions:
            action = validated(raw)
            mark = signature(action)
            missing = [a for a in action["depends_on_artifacts"] if a not in there]
            status = "duplicate" if mark in seen else "missing_artifacts" if missing else "accepted"
            made = run(action) if status == "accepted" else []
            seen.add(mark)
            fresh += len(set(made) - there)
            there |= set(made)
            records.append({"round": number, "tool_id": action["tool_id"], "signature": mark, "status": status, "outputs": made})
        if not fresh:
            return records, "no_new_artifacts"
    return records, "max_rounds_reached"


def accepted_actions(actions: DataFrame, records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The same as tables: actions(action_id, signature, needs array) that no record
    (signature) holds, the first of equal ones, all of whose artifacts(name) exist."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("signature").orderBy("action_id"))
    new = actions.join(records.select("signature"), "signature", "left_anti").withColumn("n", first).where("n = 1")
    missing = new.select("action_id", F.explode("needs").alias("name")).join(artifacts, "name", "left_anti")
    return new.join(missing.select("action_id").distinct(), "action_id", "left_anti").select("action_id", "signature")


def step(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False, retries: int = 2, pause: float = 0.0) -> tuple[DataFrame, str]:
    """A table that is built once: (table, ran or reused). Complete tables are read again
    unless forced; a build that fails is tried again after a pause that grows."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not force and done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return spark.read.parquet(path), "reused"
    for attempt in range(retries + 1):
        try:
            build().write.mode("overwrite").parquet(path)
            return spark.read.parquet(path), "ran"
        except Exception:
            if attempt == retries:
                raise
            time.sleep(pause * (attempt + 1))
    raise AssertionError


def roles(spark: SparkSession, folder: str, names: Iterable[str]) -> DataFrame:
    """(role_id, status): ok where a role's output exists, not_run where it doesn't."""
    return spark.createDataFrame([(n, "ok" if Path(folder, f"{n}.json").exists() else "not_run") for n in names], "role_id string, status string")


def extracted_json(text: str | None) -> dict | None:
    """The JSON object in an agent's output: the text itself, the text parts of event lines,
    a fenced block, or the longest balanced braces that parse."""
    parts = []
    for line in (text or "").splitlines():
        event = _object(line.strip())
        if event and event.get("type") == "text" and isinstance((event.get("part") or {}).get("text"), str):
            parts.append(event["part"]["text"])
    text = "\n".join(parts) if parts else text or ""
    if (whole := _object(text)) is not None:
        return whole
    if "```" in text and (fenced := _object(text.split("```")[1].removeprefix("json").strip())) is not None:
        return fenced
    return next((x for c in sorted(_balanced(text), key=len, reverse=True) if (x := _object(c)) is not None), None)


def _object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _balanced(text: str) -> list[str]:
    """Texts from an opening brace to the one that closes it, strings skipped."""
    out, starts, quoted, escaped = [], [], False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"' and starts:
            quoted = True
        elif c == "{":
            starts.append(i)
        elif c == "}" and starts:
            out.append(text[starts.pop() : i + 1])
    return out


def extract_json_column():
    """Column function: the object as JSON text with sorted keys, null where there is none."""

    @F.pandas_udf("string")
    def extract(output):
        import pandas as pd

        return pd.Series([None if (x := extracted_json(t)) is None else json.dumps(x, sort_keys=True, ensure_ascii=False) for t in output])

    return extract
