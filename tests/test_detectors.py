"""Fixtures of the detectors: planted relations, offsets, claims, sources."""

import json
import random
import struct
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import digits
from tessera.operators import claims, columns, cross_sheet, pairs, profile, rules, text
from tessera.params import ColumnParams, CrossSheetParams, ImageParams, PairParams
from tessera.plans import registry
from tessera.sources import files, materials, sinks, xlsx


def cells(spark, rows):
    return spark.createDataFrame([("w", "s", r, c, str(v), float(v)) for r, c, v in rows], "workbook string, sheet string, row int, col int, raw string, num double")


def test_params_raise_out_of_bounds():
    with pytest.raises(ValueError):
        ColumnParams(min_overlap=3)
    with pytest.raises(ValueError):
        PairParams(min_support=2.0)


def test_fixed_difference_and_ratio(spark):
    rows = [(r, c, v) for r in range(1, 21) for c, v in ((1, r * r), (2, r * r + 7), (3, 3 * r * r))]
    found = {(r["left_col"], r["right_col"], r["category"]): r for r in columns.fixed_relations(cells(spark, rows)).collect()}
    assert found[1, 2, "fixed_difference"]["flagged"] and found[1, 2, "fixed_difference"]["relationship_value"] == -7_000_000
    assert found[1, 3, "fixed_ratio"]["flagged"] and found[1, 3, "fixed_ratio"]["relationship_value"] == 333333
    assert not found[2, 3, "fixed_difference"]["flagged"]


def test_duplicate_columns_index_like_is_low(spark):
    rows = [(r, c, r) for r in range(1, 16) for c in (1, 2)]
    (r,) = columns.duplicate_columns(cells(spark, rows)).collect()
    assert r["flagged"] and r["equal_rows"] == 15 and r["risk_level"] == "low"
    assert {r["col"]: r["index_like"] for r in columns.index_like(cells(spark, rows)).collect()} == {1: True, 2: True}


def test_row_offset_block(spark):
    base = [3.1, 5.7, 8.2, 4.4, 9.9]
    rows = [(i + 1, 1, v) for i, v in enumerate(base)] + [(i + 6, 1, round(v * 10, 4)) for i, v in enumerate(base)]
    p = PairParams(min_pairs=4, min_support=1.0, max_offset=8)
    scalars = pairs.row_offset_scalar(cells(spark, rows), p)
    (r,) = scalars.where("flagged").collect()
    assert r["offset"] == 5 and r["ratio"] == 100_000 and r["category"] == "row_offset_scalar_multiple"
    assert pairs.offset_groups(scalars).count() == 1


def test_paired_ratio_reuse(spark):
    rows = [(i, 1, i * 1.5 + 1) for i in range(1, 11)] + [(i, 2, (i * 1.5 + 1) / (2 + (i - 1) % 5)) for i in range(1, 11)]
    found = pairs.paired_ratio_reuse(cells(spark, rows), PairParams(min_pairs=4, min_support=1.0, max_offset=6))
    assert [r["offset"] for r in found.where("flagged").collect()] == [5]


def test_rounding_bias(spark):
    vals = [1.123456, 2.234567, 3.345678, 4.456789]
    rows = [(i + 1, v) for i, v in enumerate(vals)] + [(5, 1.123456), (6, 2.234567), (7, 3.35), (8, 4.46)]
    df = spark.createDataFrame([("w", "s", r, 1, str(v), v) for r, v in rows], "workbook string, sheet string, row int, col int, raw string, num double")
    found = {r["offset"]: r for r in pairs.rounding_bias(df, PairParams(min_pairs=4, max_offset=4)).collect()}
    assert found[4]["exact"] == 2 and found[4]["rounded"] == 2 and found[4]["upward"] == 2 and found[4]["flagged"]


def test_long_pairs(spark):
    rows = [("g", i, k, v) for i in range(1, 9) for k, v in ((1, 2.0), (2, 2.0 * (1 + i % 4)))]
    df = spark.createDataFrame(rows, "grp string, pair_id long, row int, num double")
    p = PairParams(min_pairs=4, min_support=1.0, max_offset=4)
    lp = pairs.long_pairs(df, ["grp"], p)
    assert lp.count() == 8
    assert [r["offset"] for r in pairs.long_ratio_reuse(lp, ["grp"], p).where("flagged").collect()] == [4]
    assert pairs.long_ratio_enrichment(lp, ["grp"], PairParams(min_pairs=2)).where("flagged").count() == 3


def test_duplicate_rows_with_and_without_positions(spark):
    rows = [(1, 1, 5), (1, 2, 6), (1, 3, 7), (2, 1, 5), (2, 2, 6), (2, 3, 7), (3, 2, 5), (3, 3, 6), (3, 4, 7)]
    assert columns.duplicate_rows(cells(spark, rows), True).first()["n_rows"] == 2
    assert columns.duplicate_rows(cells(spark, rows), False, 3).first()["n_rows"] == 3


def test_cross_sheet_thresholds(spark):
    rows = [("c", s, r, 1, float(r if s == "a" or r <= 15 else -r)) for s in ("a", "b") for r in range(1, 21)]
    df = spark.createDataFrame([("w", "c", *x[1:]) for x in rows], "workbook string, case_id string, sheet string, row int, col int, num double")
    (r,) = cross_sheet.cross_sheet_duplicates(df, ["workbook"], CrossSheetParams(min_support_rate=0.7)).collect()
    assert r["equal_rows"] == 15 and r["support_rate"] == 0.75 and r["flagged"]
    assert not cross_sheet.cross_sheet_duplicates(df, ["workbook"]).first()["flagged"]


def test_empty_cells(spark):
    none = cells(spark, []).limit(0)
    for found in (columns.fixed_relations(none), columns.duplicate_columns(none), pairs.row_offset_scalar(none), pairs.paired_ratio_reuse(none), columns.duplicate_rows(none, True), profile.terminal_digits(none, ["sheet"])):
        assert found.count() == 0
    assert profile.benford(none, "num").first()["n"] == 0


def test_digit_functions(spark):
    raw = ["12.50", "1,234", "7.0", "1e-3", "-0.050", "x"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = df.select(digits.parse_decimal(F.col("raw")).cast("double"), digits.terminal_digit_cell(F.col("raw")), digits.fraction_cell(F.col("raw")), digits.decimal_places(F.col("raw"))).collect()
    assert [r[0] for r in got] == [12.5, 1234.0, 7.0, 0.001, -0.05, None]
    assert [r[1] for r in got] == ["0", "4", "7", "3", "0", None]
    assert [r[2] for r in got] == ["5", None, "0", None, "05", None]
    assert [r[3] for r in got] == [2, 0, 1, 3, 3, 0]
    names = spark.createDataFrame([("A", 1), ("Z", 26), ("AA", 27), ("XFD", 16384)], "n string, i int")
    for r in names.select("n", "i", digits.column_index(F.col("n")), digits.column_letters(F.col("i"))).collect():
        assert r[2] == r["i"] and r[3] == r["n"]


def test_numbers_in_text(spark):
    docs = spark.createDataFrame([(1, "p = 0.05, n=1,234 and 5% of x12 at 1.5e-3\n| 3.10 |"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["line"], r["raw"], r["terminal"], r["fraction"]) for r in text.numbers(docs).orderBy("line", "pos").collect()]
    assert got == [(1, "0.05", "5", "05"), (1, "1,234", "4", None), (1, "5%", "5", None), (1, "1.5e-3", "3", "5"), (2, "3.10", "0", "10")]


def test_lines_labels_blocks(spark):
    md = "# Title\n\nFigure 2a shows x.\nmore\n\n| a | b |\n|---|---|\n![i](p.png)\n图 3 说明"
    docs = spark.createDataFrame([(1, md)], "doc_id long, text string")
    found = {r["line"]: (r["kind"], r["label_key"]) for r in text.classified(docs).collect()}
    assert [found[i][0] for i in range(1, 10)] == ["heading", "blank", "caption", "text", "blank", "table", "table", "image", "caption"]
    assert found[3][1] == "figure2a" and found[9][1] == "图3"
    assert text.tables(docs).first()["n_lines"] == 2
    assert text.blocks(docs).count() == 3


def test_rules(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("type: t\nrules:\n- {id: r, detection: {triggers: {study_types: [rct]}, negative_triggers: [consort]}, evidence_template: 'E {excerpt}'}\n- {id: k, severity: red, detection: {triggers: {keywords: [a trial, {pattern: 'rand\\w+', type: regex}]}}, evidence_template: 'E {excerpt}'}\n")
    (tmp_path / "b.yaml").write_text("rules: [")
    own = rules.load_rules(tmp_path)
    assert [(r.rule_id, r.severity, r.rule_type) for r in own] == [("r", "yellow", "t"), ("k", "red", "t")]
    docs = spark.createDataFrame([(1, "A randomized trial."), (2, "A randomised trial with CONSORT."), (3, None), (4, "x" * 100 + " a trial\n" + "y" * 100)], "doc_id long, text string")
    got = {(r["doc_id"], r["rule_id"]): r for r in rules.match_rules(docs, own).collect()}
    assert set(got) == {(1, "r"), (1, "k"), (2, "k"), (4, "k")}
    assert got[1, "r"]["evidence"] == "E N/A" and got[1, "k"]["excerpts"] == ["A randomized trial."]
    assert got[4, "k"]["excerpts"] == ["x" * 59 + " a trial " + "y" * 59]
    assert len(rules.load_rules()) >= 40


def test_claims(spark):
    c = spark.createDataFrame([("d", "m", "1.0", 1e-4), ("d", "n", "2", 1e-4), ("d", "x", "1", 1e-4), ("d", "y", "abc", 1e-4), ("d", "z", "nan", 1e-4)], "dataset string, metric string, expected string, tolerance double")
    r = spark.createDataFrame([("d", "m", "5", 0), ("d", "m", "1.00005", 1), ("d", "n", "3", 2), ("d", "y", "1", 3), ("d", "z", "1", 4)], "dataset string, metric string, value string, ord int")
    got = {x["metric"]: x["status"] for x in claims.compare_claims(c, claims.latest_results(r, ["dataset", "metric"], "ord").drop("ord"), ["dataset", "metric"]).collect()}
    assert got == {"m": "matched", "n": "mismatched", "x": "missing", "y": "unparsed", "z": "unparsed"}


def test_near_hashes_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(12)]
    items = list(enumerate(base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base]))
    df = spark.createDataFrame(items, "k long, h long")
    got = {(r["item_1"], r["item_2"]): r["distance"] for r in claims.near_hashes(df, "k", "h", ImageParams(max_distance=4)).collect()}
    assert got == {(r["item_1"], r["item_2"]): r["distance"] for r in claims._banded(df.toDF("k", "h"), 4, 64).collect()}
    want = {(i, j): d for i, a in items for j, b in items if i < j and (d := (a ^ b).bit_count()) <= 4}
    assert got == want


def test_findings(spark):
    f = spark.createDataFrame([("w", "s", "fixed_ratio", 10, "high", None), ("w", "s", "fixed_ratio", 5, "low", None), ("w", "t", "duplicate", 7, "medium", "high")], "workbook string, sheet string, category string, support_rows long, risk_level string, artifact_likelihood string")
    assert claims.priority(f).count() == 1
    assert [r["finding_id"] for r in claims.numbered(f, "FD", [F.desc("support_rows")]).orderBy("finding_id").collect()] == ["FD-0001", "FD-0002", "FD-0003"]
    assert claims.verdict(f).first()["verdict"] == "review" and claims.verdict(f.limit(0)).first()["verdict"] == "pass"
    assert claims.clusters(f).first()["sheet"] == "s"


def workbook(path, cells_xml, strings=("hello",)):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Fig.1a" sheetId="1" state="hidden" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData><row>{cells_xml}</row></sheetData></worksheet>")


def test_xlsx(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", '<c r="A1" t="s"><v>0</v></c><c r="B1"><v>1.50</v></c><c r="C1"><f>A1*2</f><v>1E-5</v></c><c r="AA2" t="b"><v>1</v></c>')
    (tmp_path / "bad.xlsx").write_bytes(b"nothing")
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    spark.dataSource.register(xlsx.XlsxCells)
    for df in (spark.read.format("xlsx_cells").load(str(tmp_path)), xlsx.cells_from_files(spark, str(tmp_path))):
        got = {(r["workbook"], r["ref"]): r for r in df.collect()}
        assert got["a.xlsx", "A1"]["value"] == "hello" and got["a.xlsx", "A1"]["num"] is None and got["a.xlsx", "A1"]["sheet_state"] == "hidden"
        assert float(got["a.xlsx", "B1"]["num"]) == 1.5 and got["a.xlsx", "B1"]["num_scale"] == 2 and got["a.xlsx", "B1"]["num_key"] == "1.5"
        assert got["a.xlsx", "C1"]["formula"] == "A1*2" and got["a.xlsx", "AA2"]["col"] == 27 and got["a.xlsx", "AA2"]["num"] is None
        assert got["bad.xlsx", None]["error"] and len(got) == 5


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("dataset,metric,value\nd , m,1\n,,\n")
    assert [(r["dataset"], r["metric"]) for r in files.results(spark, str(tmp_path / "r.csv")).collect()] == [("d", "m")]
    (tmp_path / "m.json").write_text(json.dumps({"claims": [{"id": "c", "dataset": "d", "metric": "m", "expected": "1", "tolerance": 0.1}]}, indent=1))
    assert files.manifest(spark, str(tmp_path / "m.json")).first()["metric"] == "m"
    (tmp_path / "e.jsonl").write_text('{"event": "audit_start"}\nnot json\n{"event": "audit_end"}\n')
    assert files.json_lines(spark, str(tmp_path / "e.jsonl"), "event string").where("event is not null").count() == 2
    (tmp_path / "Source Data").mkdir()
    (tmp_path / "Source Data" / "f.xlsx").write_bytes(b"x")
    (tmp_path / "a.PNG").write_bytes(b"y")
    inv = materials.inventory(materials.listed(spark, str(tmp_path)))
    found = {r["relative_path"]: r["material_type"] for r in inv.collect()}
    assert found["Source Data/f.xlsx"] == "structured_table_xlsx" and found["a.PNG"] == "image" and found["m.json"] == "other"
    assert materials.lane(materials.candidate_roots(inv)).first()["root"] == "Source Data"
    assert materials.lane(materials.candidate_roots(inv.limit(0))).first()["status"] == "missing_material"
    (image,) = files.images(spark, str(tmp_path)).collect()
    assert image["size_bytes"] == 1
    with pytest.raises(FileNotFoundError):
        materials.first_pdf(materials.listed(spark, str(tmp_path)))
    assert materials.contained("a/../b", "/x") and not materials.contained("../y", "/x")
    assert materials.best_markdown(spark.createDataFrame([("z.md",), ("b/full.md",)], "relative_path string")) == "b/full.md"
    (tmp_path / "cases" / "c1").mkdir(parents=True)
    (tmp_path / "cases" / "c1" / "case.json").write_text('{"case_id": "c1",\n "status": "done"}')
    assert [(r["case_id"], r["folder"]) for r in materials.cases(spark, str(tmp_path / "cases")).collect()] == [("c1", "c1")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), ("<c>", None)], "name string, n int")
    body = sinks.write_document(str(tmp_path / "d.json"), {"case": "x"}, rows=df)
    assert json.loads((tmp_path / "d.json").read_text()) == body and len(body["rows"]) == 2
    assert "a\\|b" in sinks.write_markdown(str(tmp_path / "r.md"), "T", some_rows=df) and "&lt;c&gt;" in sinks.write_html(str(tmp_path / "r.html"), "T", rows=df)
    sinks.write_run_manifest(df, str(tmp_path / "run.json"), {"run": 1}, ["b", "a"])
    assert json.loads((tmp_path / "run.json").read_text())["outputs"] == ["a", "b"]
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert files.json_lines(spark, str(tmp_path / "log"), "name string").count() == 4
    grid = cells(spark, [(r, c, r * c) for r in range(1, 20) for c in range(1, 9)])
    shown = sinks.window_around(grid, spark.createDataFrame([("F", "w", "s", 10, 4)], "finding_id string, workbook string, sheet string, row int, col int"))
    assert shown.count() == 35 and shown.where("marked").count() == 1
    (tmp_path / "work").mkdir()
    assert sinks.remove_workdir(str(tmp_path / "work"), str(tmp_path)) and not sinks.remove_workdir(str(tmp_path), str(tmp_path))


def test_registry(spark, tmp_path):
    good = {"tool_id": "source_data.findings", "params": {"max_findings_per_category": 30, "odd": 1}, "hypothesis": "h", "depends_on_artifacts": ["a"], "expected_evidence_type": "numeric_pattern"}
    assert registry.validated(good)["params"] == {"min_overlap": 12, "min_support": 0.98, "cap": 30}
    for bad in ({**good, "tool_id": "agent.review"}, {**good, "params": {"min_overlap": 1}}, {**good, "hypothesis": ""}):
        with pytest.raises(ValueError):
            registry.validated(bad)
    records, why = registry.investigate([[good, good], [{**good, "params": {}, "depends_on_artifacts": ["b"]}], [{**good, "params": {"min_overlap": 20}}]], {"a"}, lambda a: ["b"])
    assert [r["status"] for r in records] == ["accepted", "duplicate", "accepted"] and why == "no_new_artifacts"
    assert registry.selected({"selected_steps": ["image_similarity", "x"]}) == ["image.similarity_candidates"] and len(registry.selected(None)) == 19
    built = []
    build = lambda: built.append(1) or spark.range(3)
    assert [registry.step(spark, str(tmp_path / "t"), build, force)[1] for force in (False, False, True)] == ["ran", "reused", "ran"] and len(built) == 2
    (tmp_path / "judge.json").write_text("{}")
    assert {r["role_id"]: r["status"] for r in registry.roles(spark, str(tmp_path), ["judge", "other"]).collect()} == {"judge": "ok", "other": "not_run"}


def test_difference_hash():
    from tessera.functions.images import difference_hash, pixels
    from tessera.plans.cases import RAMP, _png

    assert difference_hash(bytes(_png(RAMP))) == -1 and difference_hash(bytes(_png([r[::-1] for r in RAMP]))) == 0
    assert difference_hash(None) is None and difference_hash(b"zz") is None
    rgb = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes([10, 20, 30, 0, 0, 0, 255, 0])
    assert [round(float(v), 2) for v in pixels(rgb)[:, 0]] == [76.24, 21.85]


def test_column_findings(spark):
    rows = [(r, c, r * 1.5 if c < 3 else r) for r in range(1, 121) for c in (1, 2, 3, 4)]
    labels = spark.createDataFrame([("w", "s", 1, "dose"), ("w", "s", 2, "weight")], "workbook string, sheet string, col int, label string")
    found = {(r["left_col"], r["right_col"]): r for r in columns.column_findings(cells(spark, rows), labels, spark.createDataFrame([("w", "s", 4)], "workbook string, sheet string, col int")).collect()}
    assert found[1, 2]["risk_level"] == "high" and found[1, 2]["confidence"] == "high" and found[1, 2]["artifact_likelihood"] == "unknown" and found[1, 2]["sample_rows"].count(",") == 19
    assert found[3, 4]["risk_level"] == "low" and found[3, 4]["artifact_likelihood"] == "high" and {r["finding_id"] for r in found.values()} == {"DC-0001", "DC-0002"}
    big = cells(spark, [(r, c, 1e30) for r in range(1, 21) for c in (1, 2, 3)])
    assert columns.duplicate_columns(big).where("flagged").count() == 3 and columns.duplicate_rows(big, True).count() == 1 and columns.index_like(big).count() == 3
    f = spark.createDataFrame([("w", "s", 2, 3, "B1+$A$2"), ("w", "s", 1, 3, "C4*A1")], "workbook string, sheet string, row int, col int, formula string")
    assert columns.referenced_columns(f).first()["references"] == "C,A,B"


def test_equal_sheet_names_of_two_workbooks_meet(spark):
    rows = [(w, "c", "s", r, 1, float(r * r)) for w in ("a", "b") for r in range(1, 21)]
    df = spark.createDataFrame(rows, "workbook string, case_id string, sheet string, row int, col int, num double")
    found = cross_sheet.cross_sheet_duplicates(df, ["case_id"])
    (r,) = cross_sheet.cross_sheet_findings(found).collect()
    assert (r["workbook_1"], r["workbook_2"], r["equal_rows"], r["finding_id"]) == ("a", "b", 20, "CSD-0001")


def test_cross_sheet_counts_and_that_rows_of_pairs_stay_in_place(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, w, s, r * step, c, rng.choice([float("inf"), float("nan"), None, 0.5, 1.0, 1.0 + 5e-10, 2.0])) for k in ("x", "y", None) for w in (1, None, 2) for s, step in (("a", 1), ("b", 90), (None, -1)) for r in range(14) for c in (1, 2)]
    rows += [("x", 1, "a", 3, 1, 1.0), ("x", 1, "a", 3, 1, 2.0), ("x", 2, "a", None, 1, 2.0)]  # a cell thrice, one without a row
    df = spark.createDataFrame(rows, "case_id string, workbook int, sheet string, row int, col int, num double")
    monkeypatch.setattr(cross_sheet, "PAIRS", 7)
    found = cross_sheet.cross_sheet_duplicates(df, ["case_id"], CrossSheetParams(min_overlap=5))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    dense = columns.dense_columns(df, 5)
    sides = [dense.select("case_id", "row", *[F.col(c).alias(f"{c}_{i}") for c in ("workbook", "sheet", "col", "num")]) for i in (1, 2)]
    met = sides[0].join(sides[1], ["case_id", "row"]).where("struct(workbook_1, sheet_1) < struct(workbook_2, sheet_2)")
    names = [f"{c}_{i}" for i in (1, 2) for c in ("workbook", "sheet", "col")]
    want = met.groupBy("case_id", *names).agg(F.count("*").alias("overlap_rows"), F.count_if(F.abs(F.col("num_1") - F.col("num_2")) < 1e-9).alias("equal_rows")).where("overlap_rows >= 5")
    got, want = (Counter(map(tuple, x.select("case_id", *names, "overlap_rows", "equal_rows").collect())) for x in (found, want))
    assert got == want and len(got) > 50 and any(k[-1] for k in got)


def test_event_stream(spark, tmp_path):
    from tessera.streaming.events import progress, read_events

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"timestamp": "2024-01-01T00:00:01Z", "event": "audit_start"}\n{"timestamp": "2024-01-01T00:01:00Z", "event": "step_start"}\n')
    q = progress(read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("progress").count() == 2


def test_registered_offset_queries_reach_eighty_rows(spark):
    from tessera.plans.catalog import QUERIES
    from tests.conftest import SF

    found = QUERIES["row_offset_scalar_80"](spark, SF)
    assert {r["offset"] for r in found.select("offset").distinct().collect()} > set(range(1, 20))
    assert "range(1, 81)" in __import__("tessera.plans.catalog", fromlist=["x"]).ORACLE_SQL["row_offset_scalar_80"]
