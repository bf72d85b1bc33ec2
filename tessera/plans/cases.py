"""Queries over a small built case: papers, files, sheets, findings, claims, manifests.

The tables of the benchmark hold no submissions, so these rows are planted; their SQL is
either the same question over the same rows or the rows that must come out.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.images import dhash_udf
from tessera.operators import claims, ledger, mapping, report, rules, text, verify
from tessera.params import ImageParams
from tessera.plans import registry
from tessera.sources import materials

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sql(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_sql, v)) + "]"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _values(columns: str, rows: list) -> str:
    """select * from these rows; columns as ``name type, ...`` in DuckDB's types."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    body = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) or "(" + ", ".join("null" for _ in names) + ")"
    return f"select {', '.join(f'{n}::{k} as {n}' for n, k in zip(names, kinds))} from (values {body}) t({', '.join(names)})" + ("" if rows else " where false")


PAPERS = [
    (-1, "A randomized controlled trial of drug X. Patients were enrolled. Multiple comparisons were made; p = 0.048 was found."), (-2, "In this cohort, univariate analysis gave a crude odds ratio.\nMissing data were common."),
    (-3, "Mice were treated with compound Z in vivo (n = 2). Data not shown."), (-4, "A cross-sectional survey: obesity causes diabetes; incidence rose. 12 patients refused. Controls were recruited."),
    (-5, "This systematic review follows PRISMA."), (-6, ""), (-7, None), (-8, "Nothing here."), (-9, "Randomised allocation was planned in an experiment, but no trial was run."),
]
PAPER_SQL = "with p as (" + _values("doc_id bigint, text varchar", PAPERS) + " union all select doc_id, text from documents)"


@functools.cache
def _rules() -> tuple:
    return tuple(rules.load_rules())


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame(PAPERS, "doc_id long, text string")
    return planted.union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _fires(r: rules.Rule) -> str:
    any_of = lambda ps: "(" + " or ".join(f"regexp_matches(text, {_sql(p)}, 'i')" for p in ps) + ")"
    parts = ["text <> ''"] + [any_of([rules.gate(t) for t in r.study_types])] * bool(r.study_types) + [any_of(r.patterns())] * bool(r.keywords)
    return " and ".join(parts + ["not " + any_of([re.escape(n) for n in r.negatives])] * bool(r.negatives))


def _quote(p: str) -> str:
    before, hit = f"length(regexp_extract(text, {_sql(f'(?is)^(.*?)(?:{p})')}, 1))", f"length(regexp_extract(text, {_sql(f'(?i){p}')}, 0))"
    said = f"substring(text, greatest(1, {before} - 59), {before} + 61 + {hit} - greatest(1, {before} - 59))"
    return f"case when regexp_matches(text, {_sql(p)}, 'i') then regexp_replace(replace({said}, chr(10), ' '), '^\\s+|\\s+$', '', 'g') end"


def _matches_sql() -> str:
    parts = []
    for r in _rules():
        quotes = ", ".join(map(_quote, r.patterns())) or "null::varchar"
        parts.append(f"select doc_id, {_sql(r.rule_id)} as rule_id, list_filter([{quotes}], x -> x is not null) as e, {_sql(r.evidence_template)} as template from p where {_fires(r)}")
    return PAPER_SQL + ", m as (" + " union all ".join(parts) + ") select doc_id, rule_id, array_to_string(e, ' ¶ ') as excerpts, replace(template, '{excerpt}', coalesce(substring(e[1], 1, 300), 'N/A')) as evidence from m"


@query(_matches_sql().replace("x -> x is not null", "lambda x: x is not null"))
def rule_matches(spark, sf_dir):
    return rules.match_rules(_papers(spark, sf_dir), list(_rules())).withColumn("excerpts", F.array_join("excerpts", " ¶ "))


@query(PAPER_SQL + ", r as (" + " union all ".join(f"select {_sql(r.rule_id)} as rule_id, coalesce(count_if({_fires(r)}), 0)::bigint as n_triggered, count(*) as n_documents from p" for r in _rules()) + ") select * from r")
def rule_summary(spark, sf_dir):
    return rules.rule_summary(_papers(spark, sf_dir), list(_rules()))


@query(PAPER_SQL + ", h as (" + " union all ".join(f"select doc_id, {_sql(r.severity)} as s, {_sql(r.rule_type)} as t from p where {_fires(r)}" for r in _rules()) + f""")
select p.doc_id, {len(_rules())}::int as total_rules, count(s) as total_triggered, coalesce(count_if(t = 'methodology_review'), 0)::bigint as methodology_review_triggered, coalesce(count_if(t = 'fraud_detection'), 0)::bigint as fraud_detection_triggered,
 coalesce(count_if(s = 'red'), 0)::bigint as red_count, coalesce(count_if(s = 'orange'), 0)::bigint as orange_count, coalesce(count_if(s = 'yellow'), 0)::bigint as yellow_count from p left join h on h.doc_id = p.doc_id group by p.doc_id""")
def rule_severity_summary(spark, sf_dir):
    return rules.severity_summary(_papers(spark, sf_dir), list(_rules()))


@query(_values("rule_id varchar, category varchar, title varchar, severity varchar, rule_type varchar, human_review_guide varchar, score varchar, evidence_found varchar, reviewer_comment varchar", [(r.rule_id, r.category, r.title, r.severity, r.rule_type, r.human_review, "", "", "") for r in _rules()]))
def reviewer_form(spark, sf_dir):
    return rules.reviewer_form(spark, list(_rules()))


@query(_values("doc_id bigint, finding_id varchar, category varchar, risk_level varchar", [
    (-3, "PF-STATS-N-LESS-THAN-3", "rules.methodology_review", "high"), (-3, "PF-STUDY-DESIGN-NO-CONTROL-GROUP", "rules.methodology_review", "high"), (-3, "PF-REPORTING-NO-ETHICS-APPROVAL", "rules.methodology_review", "high"), (-3, "PF-TEXT-DATA-AVAILABILITY-SUSPICIOUS", "rules.fraud_detection", "low"),
    (-3, "PF-STUDY-DESIGN-NO-DESIGN-DECLARATION", "rules.methodology_review", "low"), (-8, "PF-STUDY-DESIGN-NO-DESIGN-DECLARATION", "rules.methodology_review", "low"),
]))
def rule_findings(spark, sf_dir):
    planted = spark.createDataFrame([p for p in PAPERS if p[0] in (-3, -6, -7, -8)], "doc_id long, text string")
    return rules.rule_findings(planted, list(_rules())).select("doc_id", "finding_id", "category", "risk_level")


@query("select 'trial' as checklist, 12::bigint as n_items, 'title,methods,results,other' as sections")
def checklist_items(spark, sf_dir):
    found = rules.load_checklists(spark)
    sections = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"])), ",")
    return found.groupBy("checklist").agg(F.count("*").alias("n_items"), sections.alias("sections"))


FILES = [("paper.pdf", 900), ("supp/s1.pdf", 50), ("Source Data/fig1.xlsx", 10), ("Source Data/fig2.xlsm", 11), ("Source Data/raw.CSV", 5), ("tables/t.tsv", 6), ("tables/old.xls", 7), ("more/extra.xlsx", 8), ("img/a.bmp", 3), ("img/b.JPG", 4), ("x/d.rds", 2), ("x/all.tar.gz", 9), ("README", 1), ("supplement notes.txt", 1), ("src/run.py", 1), ("src/fit.R", 1), ("src/conf.yaml", 1), ("src/out.json", 1), ("full.md", 2), ("a/full.md", 2)]


def _files(spark):
    return spark.createDataFrame(FILES, "relative_path string, size_bytes long")


def _inventory(spark):
    files = _files(spark)
    return materials.inventory(files, materials.first_pdf(files))


KINDS = {"supp/s1.pdf": "pdf_supplement", "Source Data/fig1.xlsx": "structured_table_xlsx", "Source Data/fig2.xlsm": "structured_table_xlsx", "Source Data/raw.CSV": "structured_table_text", "tables/t.tsv": "structured_table_text", "tables/old.xls": "other", "more/extra.xlsx": "structured_table_xlsx", "img/a.bmp": "image", "img/b.JPG": "image", "x/d.rds": "raw_data", "x/all.tar.gz": "archive", "supplement notes.txt": "possible_data_artifact"}


@query(_values("relative_path varchar, size_bytes bigint, extension varchar, material_type varchar, directory varchar", [(p, s, p.rsplit(".", 1)[-1].lower() if "." in p else "", KINDS.get(p, "other"), p.rpartition("/")[0]) for p, s in FILES[1:]]))
def material_inventory(spark, sf_dir):
    return _inventory(spark)


@query("select * from (" + _values("counted varchar, key varchar, n_files bigint", [("material_type", k, list(KINDS.get(p, "other") for p, _ in FILES[1:]).count(k)) for k in sorted({KINDS.get(p, "other") for p, _ in FILES[1:]})]) + " union all " + _values("counted varchar, key varchar, n_files bigint", [("extension", e, n) for e, n in (("pdf", 1), ("xlsx", 2), ("xlsm", 1), ("csv", 1), ("tsv", 1), ("xls", 1), ("bmp", 1), ("jpg", 1), ("rds", 1), ("gz", 1), ("<none>", 1), ("txt", 1), ("py", 1), ("r", 1), ("yaml", 1), ("json", 1), ("md", 2))]) + ")")
def material_counts(spark, sf_dir):
    return materials.counts(_inventory(spark))


@query(_values("directory varchar, file_count bigint, xlsx_count bigint, csv_tsv_count bigint, sample_files varchar, executable boolean, confidence varchar, place int", [("Source Data", 3, 2, 1, "Source Data/fig1.xlsx,Source Data/fig2.xlsm,Source Data/raw.CSV", True, "high", 1), ("more", 1, 1, 0, "more/extra.xlsx", True, "medium", 2), ("tables", 2, 0, 1, "tables/old.xls,tables/t.tsv", False, "low", 3)]))
def candidate_roots(spark, sf_dir):
    return materials.candidate_roots(_inventory(spark))


@query("select 'source_data_xlsx' as lane_id, 'selected' as status, 'Source Data' as root, 'Source Data/raw.CSV,tables/t.tsv,x/all.tar.gz,x/d.rds' as unsupported")
def material_lane(spark, sf_dir):
    found = _inventory(spark)
    rest = materials.unsupported(found).agg(F.array_join(F.array_sort(F.collect_list("relative_path")), ",").alias("unsupported"))
    return materials.lane(materials.candidate_roots(found)).join(F.broadcast(rest), how="cross")


@query("select 20::bigint as file_count, 'src/fit.R,src/run.py' as entrypoint_candidates, 'src/conf.yaml,src/out.json' as config_candidates, 'tables/t.tsv' as result_candidates")
def repository_scan(spark, sf_dir):
    return materials.repository(_files(spark))


@query(_values("artifact_id varchar, kind varchar, file_name varchar, exists boolean, size_bytes bigint", [("md", "text", "full.md", True, 2), ("report", "html", "final.html", False, None)]).replace("exists::", '"exists"::').replace("as exists", 'as "exists"').replace("file_name, exists,", 'file_name, "exists",'))
def artifact_index(spark, sf_dir):
    return materials.artifact_index(_files(spark), spark.createDataFrame([("md", "text", "full.md"), ("report", "html", "final.html")], "artifact_id string, kind string, file_name string"))


SHEETS = [("w.xlsx", "Fig.1a"), ("w.xlsx", "ED Fig. 2b"), ("w.xlsx", "Source Data Fig 3c and 3d"), ("w.xlsx", "notes"), ("v.xlsx", "fig. 4")]
PAPER = "# Title\n\nAs shown in Fig. 1a, the treated cells grew twice as fast as others. Short one.\n\nExtended Data Fig. 2b repeats the measurement with a second antibody and more samples.\n\nFig. 1 summarises everything that was measured in the first experiment.\n\n![x](a.png) Fig.3d\n\nSee Fig. 3 for totals | Panel 3c holds the raw values of every single animal. As shown in Fig. 1a, the treated cells grew twice as fast as others.\n\nFig. 12 is another figure that no sheet of this submission is about."
FOUND = [("FD-0001", "w.xlsx", "Fig.1a", "high", None), ("FD-0002", "w.xlsx", "Fig.1a", "medium", "high"), ("DC-0001", "w.xlsx", "notes", "low", "unknown")]


def _sheets(spark):
    return spark.createDataFrame(SHEETS, "workbook string, sheet string")


def _blocks(spark):
    return text.blocks(spark.createDataFrame([(1, PAPER)], "doc_id long, text string"))


def _found(spark):
    return spark.createDataFrame(FOUND, "finding_id string, workbook string, sheet string, risk_level string, artifact_likelihood string")


@query(_values("workbook varchar, sheet varchar, ord int, kind varchar, figure varchar, panel varchar, figure_id varchar", [("w.xlsx", "Fig.1a", 0, "main_figure", "1", "a", "Fig.1a"), ("w.xlsx", "ED Fig. 2b", 0, "extended_data", "2", "b", "Extended Data Fig.2b"), ("w.xlsx", "Source Data Fig 3c and 3d", 0, "main_figure", "3", "c", "Fig.3c"), ("w.xlsx", "Source Data Fig 3c and 3d", 1, "main_figure", "3", "d", "Fig.3d"), ("v.xlsx", "fig. 4", 0, "main_figure", "4", None, "Fig.4")]))
def figure_keys(spark, sf_dir):
    return mapping.figure_keys(_sheets(spark)).select("workbook", "sheet", F.posexplode("keys").alias("ord", "k")).select("workbook", "sheet", "ord", "k.*")


@query(_values("workbook varchar, sheet varchar, rank int, start_line int", [("w.xlsx", "Fig.1a", 1, 3), ("w.xlsx", "Fig.1a", 2, 7), ("w.xlsx", "Fig.1a", 3, 11), ("w.xlsx", "ED Fig. 2b", 1, 5), ("w.xlsx", "Source Data Fig 3c and 3d", 1, 11), ("w.xlsx", "Source Data Fig 3c and 3d", 2, 9)]))
def paper_references(spark, sf_dir):
    return mapping.paper_refs(_sheets(spark), _blocks(spark)).select("workbook", "sheet", "rank", "start_line")


@query(_values("workbook varchar, sheet varchar, claim int, text varchar", [
    ("w.xlsx", "Fig.1a", 1, "1a, the treated cells grew twice as fast as others."), ("w.xlsx", "Fig.1a", 2, "1 summarises everything that was measured in the first experiment."), ("w.xlsx", "Fig.1a", 3, "Panel 3c holds the raw values of every single animal."),
    ("w.xlsx", "ED Fig. 2b", 1, "2b repeats the measurement with a second antibody and more samples."),
    ("w.xlsx", "Source Data Fig 3c and 3d", 1, "Panel 3c holds the raw values of every single animal."), ("w.xlsx", "Source Data Fig 3c and 3d", 2, "1a, the treated cells grew twice as fast as others."),
]))
def candidate_claims(spark, sf_dir):
    return mapping.candidate_claims(mapping.paper_refs(_sheets(spark), _blocks(spark)))


MAPPED = [
    ("CM-0001", "v.xlsx", "fig. 4", "Fig.4", "main_figure", 0, "", "", "low", "needs_manual_mapping", "low"), ("CM-0002", "w.xlsx", "ED Fig. 2b", "Extended Data Fig.2b", "extended_data", 1, "", "", "high", "candidate_mapping", "medium"),
    ("CM-0003", "w.xlsx", "Fig.1a", "Fig.1a", "main_figure", 3, "FD-0001,FD-0002", "FD-0001", "high", "candidate_mapping", "high"), ("CM-0004", "w.xlsx", "Source Data Fig 3c and 3d", "Fig.3c, Fig.3d", "main_figure", 2, "", "", "high", "candidate_mapping", "medium"),
    ("CM-0005", "w.xlsx", "notes", None, None, 0, "DC-0001", "", "low", "needs_manual_mapping", "medium"),
]


@query(_values("mapping_id varchar, workbook varchar, sheet varchar, source_figure_id varchar, source_figure_kind varchar, n_refs bigint, linked varchar, priority varchar, mapping_confidence varchar, status varchar, review_priority varchar", MAPPED))
def claim_mappings(spark, sf_dir):
    return mapping.claim_mappings(_sheets(spark), _blocks(spark), _found(spark))


AGENT_MAPPINGS = [(1, "CM-0003", "AC-7", "high", False), (2, None, None, None, None)]


@query(_values("mapping_id varchar, claim_id varchar, confidence varchar, status varchar, needs_human_review boolean, sheet varchar, handed_in boolean", [("CM-0003", "AC-7", "high", "agent_refined_mapping", False, "Fig.1a", True), ("ACM-002", "ACM-002", "medium", "agent_refined_mapping", True, None, True), *((m[0], m[0].replace("CM", "CL"), m[8], m[9], True, m[2], False) for m in MAPPED)]))
def agent_mappings(spark, sf_dir):
    own = claim_mappings(spark, sf_dir)
    given = spark.createDataFrame(AGENT_MAPPINGS, "ord int, mapping_id string, claim_id string, confidence string, needs_human_review boolean")
    return mapping.agent_mappings(given, own).withColumn("handed_in", F.lit(True)).union(mapping.agent_mappings(given.limit(0), own).withColumn("handed_in", F.lit(False)))


@query(_values("claim_id varchar, text varchar, status varchar, origin varchar", [("AC-1", "First.", "ran", "agent_refined"), ("AC-002", "Second.", "pending", "agent_refined"), ("AC-7", mapping.PLACEHOLDER, "warning", "agent_refined_placeholder"), ("ACM-002", mapping.PLACEHOLDER, "warning", "agent_refined_placeholder")]))
def agent_claims(spark, sf_dir):
    given = spark.createDataFrame([(1, "AC-1", "First.", "ran"), (2, None, "Second.", "odd"), (3, "AC-3", "", "ran")], "ord int, claim_id string, text string, status string")
    return mapping.agent_claims(given, spark.createDataFrame(AGENT_MAPPINGS, "ord int, mapping_id string, claim_id string, confidence string, needs_human_review boolean"))


@query(_values("claim_id varchar, mapping_id varchar, text varchar, status varchar", [("CL-0002", "CM-0002", "2b repeats the measurement with a second antibody and more samples.", "pending"), ("CL-0003", "CM-0003", "1a, the treated cells grew twice as fast as others.", "pending"), ("CL-0004", "CM-0004", "Panel 3c holds the raw values of every single animal.", "pending")]))
def stand_in_claims(spark, sf_dir):
    return mapping.stand_in_claims(claim_mappings(spark, sf_dir), candidate_claims(spark, sf_dir))


CONTENT = json.dumps({"title": 1, "content": [{"type": "text", "text": "Intro", "page_idx": 0, "bbox": [1, 2, 3, 4]}, {"type": "image", "img_path": "images/a.png", "page_no": 2, "box": {"left": 1, "top": 2, "width": 5, "height": 6}}, {"type": "table", "table_body": "<table><tr><th>a&amp;b</th><td> 1 </td></tr></table>", "page": 3, "rect": [[0, 5], [7, 1]]}, {"content": "Table S2. Totals"}, "loose"]})
MIDDLE = json.dumps({"pdf_info": [{"page_idx": 4, "page_size": [600, 800], "para_blocks": [{"type": "figure", "lines": [{"spans": [{"content": "图 3 对照"}]}], "position": {"x0": 1, "y0": 1, "x1": 2, "y1": 2}}]}, {"page": 9, "w": 10, "h": 20}]})
BLOCKS = [
    ("content", "$.content[0]", "text", "Intro", None, None, None, 1, 0, 1.0, 2.0, 3.0, 4.0, None, None), ("content", "$.content[1]", "figure", None, None, None, None, 2, 1, 1.0, 2.0, 6.0, 8.0, "images/a.png", None),
    ("content", "$.content[2]", "table", None, None, None, None, 3, 2, 0.0, 1.0, 7.0, 5.0, None, "a&b;1"), ("content", "$.content[3]", "caption", "Table S2. Totals", "table", "Table S2.", "tables2", None, None, None, None, None, None, None, None),
    ("content", "$.content[4]", "unknown", None, None, None, None, None, None, None, None, None, None, None, None),
    ("middle", "$.pdf_info[0].para_blocks[0]", "figure", "图 3 对照", "figure", "图3", "图3", 5, 4, 1.0, 1.0, 2.0, 2.0, None, None), ("middle", "$.pdf_info[0].para_blocks[0].lines[0]", "caption", "图 3 对照", "figure", "图3", "图3", None, None, None, None, None, None, None, None),
    ("middle", "$.pdf_info[0].para_blocks[0].lines[0].spans[0]", "caption", "图 3 对照", "figure", "图3", "图3", None, None, None, None, None, None, None, None),
]


def _parsed(spark):
    return spark.createDataFrame([(1, CONTENT, MIDDLE), (2, '{"a": 1}', "broken"), (3, None, None)], "doc_id long, content string, middle string")


@query(_values("doc_id bigint, source varchar, json_path varchar, kind varchar, text varchar, label_kind varchar, label varchar, label_key varchar, page int, page_index int, x0 double, y0 double, x1 double, y1 double, image varchar, rows varchar", [*((1, *b) for b in BLOCKS), (2, "content", "$", "schema_unknown", *[None] * 12)]).replace("rows::", '"rows"::').replace("as rows", 'as "rows"').replace("image, rows)", 'image, "rows")'))
def paper_blocks(spark, sf_dir):
    joined = F.array_join(F.transform("table", lambda r: F.array_join(r, ";")), "/")
    return ledger.paper_blocks(_parsed(spark)).select("doc_id", "source", "json_path", "kind", "text", "label_kind", "label", "label_key", "page", "page_index", "x0", "y0", "x1", "y1", "image", joined.alias("rows"))


@query(_values("doc_id bigint, page int, page_index int, width double, height double, origin varchar", [(1, 5, 4, 600.0, 800.0, "middle"), (1, 9, 8, 10.0, 20.0, "middle"), (1, 1, 0, None, None, "derived"), (1, 2, 1, None, None, "derived"), (1, 3, 2, None, None, "derived")]))
def paper_pages(spark, sf_dir):
    return ledger.paper_pages(_parsed(spark))


@query(_values("record_id varchar, image varchar, how varchar, image_id varchar", [("r1", "images/a.png", "path", "i1"), ("r2", "other/b.png", "name", "i2"), ("r3", "c.png", "ambiguous", None), ("r4", "d.png", "unresolved", None)]))
def image_references(spark, sf_dir):
    images = spark.createDataFrame([("i1", "images/a.png"), ("i2", "images/b.png"), ("i3", "x/c.png"), ("i4", "y/c.png")], "image_id string, relative_path string")
    return ledger.image_refs(spark.createDataFrame([("r1", "images/a.png"), ("r2", "other/b.png"), ("r3", "c.png"), ("r4", "d.png"), ("r5", None)], "record_id string, image string"), images)


@query(_values("caption_id varchar, item_id varchar, confidence varchar", [("c1", "f1", "high"), ("c2", "t1", "medium"), ("c3", None, None), ("c4", None, None), ("c5", "f4", "medium"), ("c6", None, None)]))
def caption_links(spark, sf_dir):
    items = spark.createDataFrame([("f1", "figure", "figure1", 1), ("f2", "figure", "figure2", 2), ("f3", "figure", "figure2", 2), ("t1", "table", None, 3), ("f4", "figure", None, 4)], "item_id string, kind string, label_key string, page int")
    captions = spark.createDataFrame([("c1", "figure", "figure1", 9), ("c2", "table", "table7", 3), ("c3", "figure", "figure2", 2), ("c4", None, None, 1), ("c5", "figure", "figure8", 4), ("c6", "figure", "figure9", 4)], "caption_id string, label_kind string, label_key string, page int")
    return ledger.linked_captions(captions, items)


TABLE = "Results\n\n| a | b | c |\n|---|:--:|---|\n" + "\n".join(f"| {i * i} | {i * i + 3} | {2 * i * i}% |" for i in range(1, 10)) + "\n\n| x |\n| y | z |\nno table"


@query(_values("doc_id bigint, start_line int, left_col int, right_col int, relationship varchar, value bigint, support varchar", [(1, 5, 1, 2, "fixed_difference_candidate", -30000, "9/9"), (1, 5, 1, 3, "fixed_ratio_candidate", 5000, "9/9")]))
def table_relations(spark, sf_dir):
    return ledger.table_relations(spark.createDataFrame([(1, TABLE), (2, None)], "doc_id long, text string"))


@query(_values("doc_id bigint, start_line int, line int, col int, text varchar, header boolean", [*((1, 3, 3, i + 1, c, True) for i, c in enumerate("abc")), *((1, 3, 4 + i, j + 1, v, False) for i in range(1, 10) for j, v in enumerate((str(i * i), str(i * i + 3), f"{2 * i * i}%"))), (1, 15, 15, 1, "x", False), (1, 15, 16, 1, "y", False), (1, 15, 16, 2, "z", False)]))
def table_cells(spark, sf_dir):
    return ledger.table_cells(spark.createDataFrame([(1, TABLE), (2, None)], "doc_id long, text string"))


@query(_values("doc_id bigint, n_numbers bigint, n_table bigint, scope varchar, n_scope bigint", [(1, 27, 27, "tables", 27), (2, 2, 0, "all_fallback_table_numbers_lt_20", 2)]))
def number_scope(spark, sf_dir):
    return ledger.number_scope(spark.createDataFrame([(1, TABLE), (2, "1 and 2"), (3, "none")], "doc_id long, text string"))


LEDGER_SQL = r"""with ln as (select doc_id, unnest(range(1, len(p) + 1))::int as line, unnest(p) as text from (select doc_id, string_split_regex(text, '\r?\n') as p from documents where text is not null)),
im as (select doc_id, sum(len(regexp_extract_all(text, '!\[[^\]]*\]\(([^)]+)\)')))::bigint as n from ln group by all),
pt as (select * from ln where contains(text, '|') and not regexp_matches(text, '!\[[^\]]*\]\(')),
ti as (select *, line - row_number() over (partition by doc_id order by line) as g from pt),
tb as (select doc_id, g, min(line) as first, count(*) as n from ti group by all having count(*) >= 2),
tc as (select t.doc_id, t.g, t.line, b.first, string_split(regexp_replace(regexp_replace(text, '^\|', ''), '\|$', ''), '|') as c from ti t join tb b on t.doc_id = b.doc_id and t.g = b.g),
td as (select *, len(list_filter(c, lambda x: not regexp_matches(x, '^\s*:?-{2,}:?\s*$'))) = 0 and line = first + 1 as dashes from tc),
cl as (select doc_id, sum(len(c))::bigint as n from td where not dashes group by doc_id)"""


@query(LEDGER_SQL + r""", cp as (select doc_id, count(*) as n from ln where regexp_extract(text, '(?i)\b((?:extended data |supplementary )?(?:fig(?:ure)?s?\.?|tables?)\s*s?\d+[a-z]?)', 1) <> '' or regexp_extract(text, '([图表]\s*\d+)', 1) <> '' group by doc_id),
l as (select doc_id, count(*) as n from ln group by doc_id), t as (select doc_id, count(*) as n from tb group by doc_id),
a as (select l.doc_id, l.n as n_markdown_line, coalesce(cp.n, 0) as n_caption, coalesce(im.n, 0) as n_figure, coalesce(t.n, 0) as n_table, coalesce(cl.n, 0) as n_cell from l left join cp using (doc_id) left join im using (doc_id) left join t using (doc_id) left join cl using (doc_id))
select *, n_markdown_line + n_caption + n_figure + n_table + n_cell as n_items from a""")
def ledger_stats(spark, sf_dir):
    return ledger.ledger_stats(ledger.ledger_items(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


@query("select doc_id, case when length(text) <= 300 then text else substring(text, 1, 299) || '…' end as text from documents")
def truncated_texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", ledger.truncated(F.col("text"), 300).alias("text"))


FINDING = "finding_id string, category string, risk_level string, workbook string, sheet string, support_rows long, equal_rows long, overlap_rows long, support_rate double, columns array<string>, row_offset int, source_artifact string, issue_category string, benign_explanations array<string>, figure string, panel_id string, source_path string"
FINDINGS = [
    ("ROS-0001", "row_offset_scalar_multiple", "high", "w", "s2", 12, None, 12, 1.0, ["B"], 4, "pairs.json", "consistency", ["copy", "unit", "third"], None, None, None), ("FD-0001", "fixed_difference", "medium", "w", "s1", 30, None, 40, 0.75, ["A", "B"], None, "source.json", None, ["unit", "formula"], None, None, None),
    ("DC-0001", "duplicate_numeric_columns", "high", "w", "s1", None, 50, 50, 1.0, ["A", "C"], None, "source.json", "consistency", [], None, None, None), ("IMG-1", "near_copy", "low", None, None, None, None, None, None, [], None, "image_similarity.json", "matching", ["channel"], "Fig.2", "b", None),
    ("ROS-0001", "again", "critical", "w", "s9", 1, None, 1, 1.0, [], None, "bundle.json", "consistency", [], None, None, None), ("COMP-1", "odd", "info", None, None, None, None, None, None, [], None, None, "completeness", [], None, None, "p.txt"),
]


def _findings(spark):
    return spark.createDataFrame(FINDINGS[:4], FINDING), spark.createDataFrame(FINDINGS[4:], FINDING)


def _report(spark):
    return report.report_findings(*_findings(spark))


@query(_values("position int, finding_id varchar, category varchar, pattern_key varchar, support bigint, support_text varchar", [(1, "DC-0001", "duplicate_numeric_columns", "row_vector_reuse_rounding", 50, "support 50/50, rate 1.0"), (2, "ROS-0001", "row_offset_scalar_multiple", "paired_offset_ratio_reuse", 12, "support 12/12, rate 1.0"), (3, "FD-0001", "fixed_difference", "formula_derivation", 30, "support 30/40, rate 0.75"), (4, "IMG-1", "near_copy", "visual_forensics", 0, "support not recorded"), (5, "COMP-1", "odd", "category:odd", 0, "support not recorded")]))
def report_findings(spark, sf_dir):
    df = _report(spark)
    return df.select("position", "finding_id", "category", report.pattern_key(F.col("category"), F.col("source_artifact")).alias("pattern_key"), report.support_value(df).alias("support"), report.support_text(df).alias("support_text"))


@query(_values("pattern_id varchar, pattern_key varchar, n_findings bigint, finding_ids varchar, sheets varchar, workbooks varchar, n_categories bigint, risk_level varchar, benign_explanations varchar", [("P-001", "paired_offset_ratio_reuse", 1, "ROS-0001", "s2", "w", 1, "high", "copy / unit"), ("P-002", "row_vector_reuse_rounding", 1, "DC-0001", "s1", "w", 1, "high", ""), ("P-003", "formula_derivation", 1, "FD-0001", "s1", "w", 1, "medium", "unit / formula"), ("P-004", "visual_forensics", 1, "IMG-1", "", "", 1, "low", "channel"), ("P-005", "category:odd", 1, "COMP-1", "", "", 1, "info", "")]))
def pattern_report(spark, sf_dir):
    return report.pattern_report(_report(spark))


@query(_values("cluster_id varchar, source varchar, anchor varchar, max_risk int, n_findings bigint, finding_ids varchar", [("EC-001", "w", "s1", 3, 2, "DC-0001,FD-0001"), ("EC-002", "w", "s2", 3, 1, "ROS-0001"), ("EC-003", "image_similarity.json", "Fig.2", 1, 1, "IMG-1"), ("EC-004", "p.txt", "odd", 0, 1, "COMP-1")]))
def cluster_report(spark, sf_dir):
    return report.cluster_report(_report(spark))


@query(_values("finding_id varchar, risk_level varchar, support bigint", [("DC-0001", "high", 50), ("ROS-0001", "high", 12)]))
def evidence_cards(spark, sf_dir):
    return report.evidence_cards(_report(spark), 2)


@query(_values("chapter int, issue_category varchar, n_findings bigint", [(1, "consistency", 3), (2, "matching", 1), (3, "completeness", 1)]))
def report_chapters(spark, sf_dir):
    return report.chapters(_report(spark))


@query(_values("finding_id varchar, locator varchar, support varchar", [("ROS-0001", "cols=B; row_offset=4", "support 12/12, rate 1.0"), ("FD-0001", "cols=A,B", "support 30/40, rate 0.75"), ("DC-0001", "cols=A,C", "support 50/50, rate 1.0"), ("IMG-1", "figure=Fig.2; panel_id=b", "support not recorded"), ("COMP-1", "-", "support not recorded")]))
def finding_lines(spark, sf_dir):
    return report.finding_lines(_report(spark))


@query(_values("finding_id varchar, claim_ids varchar, task_ids varchar", [("ROS-0001", "C1,C2", ""), ("FD-0001", "C1", "T1"), ("DC-0001", "", ""), ("IMG-1", "", "T2"), ("COMP-1", "", "")]))
def linked_rows(spark, sf_dir):
    two = lambda rows, c: spark.createDataFrame(rows, f"{c} string, ref string")
    return report.linked_rows(_report(spark), two([("C1", "forensics:ROS-0001"), ("C9", "FD-0001")], "claim_id"), two([("C1", "see FD-0001."), ("C2", "{'id': 'ROS-0001'}")], "claim_id"), two([("T1", "check FD-0001 now"), ("T2", "IMG-12")], "task_id"))


@query(_values("finding_id varchar, review_id varchar, risk_id varchar", [("ROS-0001", "V2", "K1"), ("FD-0001", None, "K2"), ("DC-0001", None, None), ("IMG-1", None, None), ("COMP-1", None, None)]))
def first_reviews(spark, sf_dir):
    reviews = spark.createDataFrame([(1, "ROS-0001", "V1"), (2, "ROS-0001", "V2")], "ord int, finding_id string, review_id string")
    risks = spark.createDataFrame([(1, "K1", "ROS-0001"), (2, "K2", "ROS-0001"), (2, "K2", "FD-0001")], "ord int, risk_id string, finding_id string")
    return report.first_reviews(_report(spark), reviews, risks)


@query(_values("ord int, claim_id varchar, text varchar, evidence_refs varchar, finding_refs varchar, needs_review boolean", [(1, "C1", "First claim", "a, forensics:X, b, finding 2", "forensics:X, finding 2, FINDING-3", False), (2, "C2", "-", "-", "-", True)]))
def claim_impact(spark, sf_dir):
    m = spark.createDataFrame([(1, "C1", ["a", "forensics:X", "b", "finding 2", "FINDING-3"], False), (2, "C2", [], None)], "ord int, claim_id string, refs array<string>, needs_human_review boolean")
    return report.claim_impact(m, spark.createDataFrame([("C1", "First claim")], "claim_id string, text string"))


@query(_values("finding_id varchar, source_path varchar", [("A", "x, y, z"), ("B", "")]))
def source_paths(spark, sf_dir):
    f = spark.createDataFrame([("A", ["e1", "e2", "e1b", "e3", "e4"]), ("B", ["e9"])], "finding_id string, evidence_refs array<string>")
    return report.source_paths(f, spark.createDataFrame([("e1", "x"), ("e1b", "x"), ("e2", "y"), ("e3", "z"), ("e4", "q")], "evidence_id string, source_path string"))


def _evidence(spark):
    artifacts = spark.createDataFrame([(1, "full.md"), (2, "inventory.json")], "ord int, name string")
    one = lambda rows: spark.createDataFrame(rows, "ord int, finding_id string, category string, risk_level string, workbook string, sheet string")
    source, pairs = one([(1, "FD-0001", "fixed_difference", "medium", "w", "s1")]), one([(1, "ROS-0001", "row_offset_scalar_multiple", "high", "w", "s2")])
    return artifacts, source, pairs, report.evidence_items(artifacts, source, pairs)


@query(_values("evidence_id varchar, source_path varchar, finding_id varchar", [("EV-ART-0001", "full.md", None), ("EV-ART-0002", "inventory.json", None), ("EV-SD-0003", "w", "FD-0001"), ("EV-PF-0004", "w", "ROS-0001")]))
def evidence_items(spark, sf_dir):
    return _evidence(spark)[3]


@query(_values("finding_id varchar, category varchar, risk_level varchar, issue_category varchar, evidence_id varchar", [("PF-STUDY-DESIGN-NO-DESIGN-DECLARATION", "rules.methodology_review", "low", "consistency", None), ("FD-0001", "fixed_difference", "medium", "consistency", "EV-SD-0003"), ("ROS-0001", "row_offset_scalar_multiple", "high", "consistency", "EV-PF-0004"), ("COMP-MAT-001", "material_missing", "medium", "completeness", None), ("COMP-EXEC-001", "execution_status_not_available", "low", "completeness", None)]))
def canonical_findings(spark, sf_dir):
    _, source, pairs, evidence = _evidence(spark)
    told = rules.rule_findings(spark.createDataFrame([PAPERS[7]], "doc_id long, text string"), list(_rules()))
    return report.canonical_findings(told, source, pairs, evidence, spark.createDataFrame([("source_data_xlsx",)], "item string")).drop("summary")


@query(_values("case_id int, verdict varchar, depth varchar", [(1, "fail", "V2 coverage"), (2, "warning", "V3 coverage"), (3, "pass", "V0 coverage"), (4, "warning", "V1 coverage"), (5, "pass", "V4 coverage")]))
def report_verdicts(spark, sf_dir):
    rows = lambda r, s: spark.createDataFrame(r, s)
    return report.report_verdicts(rows([(1, None, 0, 0), (2, None, 3, 0), (3, None, 0, 0), (4, None, 0, 0), (5, "ran", 1, 1)], "case_id int, execution_status string, n_mappings int, n_traces int"), rows([(1, "critical"), (1, "low")], "case_id int, risk_level string"), rows([(2, "t")], "case_id int, task string"),
                                  rows([(1, "source_data_profile", "ran"), (4, "mineru", "failed")], "case_id int, step_key string, status string"), rows([(2, "e"), (5, "e")], "case_id int, evidence_id string"))


@query(_values("status varchar, n_roles bigint", [("ok", 2), ("-", 1), ("failed", 1)]))
def role_traces(spark, sf_dir):
    return report.trace_counts(spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", None), ("d", "failed")], "role_id string, status string"))


MANIFESTS = [(1, "p.pdf", "repo", ["req.txt", "env.yml"], ["main.py"], "r.csv"), (2, "p.pdf", "repo", [], ["main.py"], "r.csv"), (3, None, "repo", ["req.txt"], [], None), (4, "p.pdf", "repo", ["req.txt"], ["main.py"], "gone.csv")]
SUBMITTED = [(1, "p.pdf"), (1, "repo/main.py"), (1, "env.yml"), (1, "r.csv"), (2, "p.pdf"), (2, "repo/x.py"), (2, "r.csv"), (3, "req.txt"), (4, "p.pdf"), (4, "repo/main.py"), (4, "req.txt")]
CLAIMS = [(1, 1, "d", "m", "1.0", 0.01), (1, 2, "d", "n", "2", 0.01), (1, 3, "d", "o", "3", 0.01), (2, 1, "d", "m", "1", 0.01), (4, 1, "d", "m", "1", 0.01)]
RESULTS = [(1, "d", "m", "1.005", 1), (1, "d", "n", "9", 1), (1, "d", "n", "2.5", 2), (2, "d", "m", "x", 1)]


def _verified(spark):
    m = spark.createDataFrame(MANIFESTS, "case_id int, paper string, repo string, environment array<string>, entrypoints array<string>, results string")
    checked = verify.submissions(m, spark.createDataFrame(SUBMITTED, "case_id int, path string"))
    results = claims.latest_results(spark.createDataFrame(RESULTS, "case_id int, dataset string, metric string, value string, ord int"), ["case_id", "dataset", "metric"], "ord").drop("ord")
    compared = claims.compare_claims(spark.createDataFrame(CLAIMS, "case_id int, ord int, dataset string, metric string, expected string, tolerance double"), results, ["case_id", "dataset", "metric"])
    return checked, compared, verify.verification_findings(checked, compared)


@query(_values("case_id int, paper_ok boolean, repo_ok boolean, env_ok boolean, entry_ok boolean, results_ok boolean, checks_passed int, checks_total int, preview varchar", [(1, True, True, True, True, True, 5, 5, "V3 Numerical"), (2, True, True, False, False, True, 3, 5, "V1 Static"), (3, False, False, True, False, False, 1, 5, "V0 Not Verifiable"), (4, True, True, True, True, False, 4, 5, "V2 Executable")]))
def precheck(spark, sf_dir):
    return verify.precheck(_verified(spark)[0])


@query(_values("case_id int, finding_id varchar, severity varchar, category varchar", [(1, "F-101", "critical", "claim"), (1, "F-102", "warning", "claim"), (2, "F-003", "warning", "environment"), (2, "F-004", "warning", "execution"), (2, "F-101", "warning", "claim"), (3, "F-001", "critical", "submission"), (3, "F-002", "critical", "submission"), (3, "F-004", "warning", "execution")]))
def verification_findings(spark, sf_dir):
    return _verified(spark)[2]


@query(_values("case_id int, level varchar, overall_status varchar, critical bigint, warning bigint, info bigint, claims_checked bigint, first_finding varchar", [(1, "V3 Numerical", "warning", 1, 1, 0, 3, "F-101"), (2, "V1 Static", "attention", 0, 3, 0, 1, "F-003"), (3, "V0 Not Verifiable", "warning", 2, 1, 0, 0, "F-001"), (4, "V2 Executable", "pass", 0, 0, 0, 0, None)]))
def verification_report(spark, sf_dir):
    return verify.verification_report(*_verified(spark))


def _png(rows: list[list[int]]) -> bytearray:
    """An 8-bit grey PNG of these rows."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    body = zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))
    return bytearray(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", body) + part(b"IEND", b""))


RAMP = [[250 - 25 * x for x in range(9)] for _ in range(8)]
NOTCHED = [[100 if (x, y) == (4, 2) else v for x, v in enumerate(r)] for y, r in enumerate(RAMP)]


@query(_values("item_1 int, item_2 int, distance int, rank int", [(1, 2, 0, 1), (1, 3, 1, 2)]))
def image_candidates(spark, sf_dir):
    """The first pairs of near images; 4 is a ramp the other way, 5 can't be decoded."""
    rows = [(1, _png(RAMP)), (2, _png([r for r in RAMP for _ in (0, 1)])), (3, _png(NOTCHED)), (4, _png([r[::-1] for r in RAMP])), (5, bytearray(b"no image"))]
    hashed = spark.createDataFrame(rows, "image int, content binary").select("image", dhash_udf()("content").alias("bits")).where("bits is not null")
    return claims.first_candidates(claims.near_hashes(hashed, "image", "bits", ImageParams()), 2)


@query(_values("case_id int, found varchar", [(1, '{"a": 1}'), (2, '{"b": [1, 2]}'), (3, '{"c": "}"}'), (4, None), (5, '{"d": {"e": 2}}'), (6, None)]))
def extracted_json(spark, sf_dir):
    said = ['{"a": 1}', 'Sure:\n```json\n{"b": [1, 2]}\n```\nDone.', 'x {"c": "}"} y {broken', "nothing", '{"type": "step"}\n' + json.dumps({"type": "text", "part": {"text": 'so {"d": {"e": 2}}'}}), None]
    return spark.createDataFrame(list(enumerate(said, 1)), "case_id int, output string").select("case_id", registry.extract_json_column()("output").alias("found"))


@query(_values("tool_id varchar, defaults varchar", [(t.tool_id, json.dumps({"source_data.findings": {"cap": 200, "min_overlap": 12, "min_support": 0.98}, "source_data.pair_forensics": {"cap": 50, "max_offset": 80, "min_pairs": 8, "min_support": 0.95, "min_width": 2, "ratio_places": 4}, "source_data.cross_sheet": {"max_findings": 50, "min_numeric_ratio": 0.5, "min_overlap": 10, "min_support_rate": 0.8}, "image.similarity_candidates": {"hash_size": 8, "max_candidates": 200, "max_distance": 8}}.get(t.tool_id, {}))) for t in registry.TOOLS.values() if t.selectable]))
def tool_catalog(spark, sf_dir):
    return registry.catalog(spark, investigation=True).select("tool_id", "defaults")


@query(_values("action_id int, signature varchar", [(2, "b"), (5, "d")]))
def accepted_actions(spark, sf_dir):
    actions = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["x", "y"]), (3, "b", ["x"]), (4, "c", ["z"]), (5, "d", ["y"])], "action_id int, signature string, needs array<string>")
    return registry.accepted_actions(actions, spark.createDataFrame([("a",)], "signature string"), spark.createDataFrame([("x",), ("y",)], "name string"))
