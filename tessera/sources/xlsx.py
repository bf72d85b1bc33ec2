"""XLSX workbooks as long cells: a batch data source, a partition a workbook.

``spark.dataSource.register(XlsxCells)``, then ``spark.read.format("xlsx_cells")
.load(folder)``, or ``cells_from_files(spark, folder)`` where only Spark reads the store.
"""

from __future__ import annotations

import re
import zipfile
from decimal import Decimal, InvalidOperation
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "workbook string, sheet string, sheet_ord int, sheet_state string, row int, col int, ref string, cell_type string, raw string, value string, num decimal(38,18), num_scale int, num_key string, formula string, cell_ord long, error string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def split_ref(ref: str | None) -> tuple[int | None, int | None]:
    """(row, col) of a reference such as ``AB12``."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref or "")
    if not m:
        return None, None
    col = 0
    for letter in m[1]:
        col = col * 26 + ord(letter) - 64
    return int(m[2]), col


def literal(raw: str | None):
    """(decimal within 38 digits or None, places of the literal, canonical text) of a number; NaN and infinity are none."""
    try:
        v = Decimal((raw or "").strip().replace(",", ""))
    except InvalidOperation:
        return None, None, None
    if not v.is_finite():
        return None, None, None
    fits = v.adjusted() < 20 and -v.as_tuple().exponent <= 18
    return (v if fits else None), max(0, -v.as_tuple().exponent), format(v.normalize(), "f") if abs(v.adjusted()) < 60 else str(v.normalize())


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(MAIN + "t"))


def read_workbook(name: str, data: bytes):
    """Rows of SCHEMA; a broken workbook gives one row with its error."""
    blank = (None,) * 12
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            parts = set(z.namelist())
            strings = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(MAIN + "si")] if "xl/sharedStrings.xml" in parts else []
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            ordinal = 0
            for k, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(MAIN + "sheet")):
                target = (targets.get(s.get(LINK)) or "").lstrip("/")
                path = target if target.startswith("xl/") else f"xl/{target}"
                if path not in parts:
                    continue
                for c in ElementTree.fromstring(z.read(path)).iter(MAIN + "c"):
                    row, col = split_ref(c.get("r"))
                    kind, v, f = c.get("t", "n"), c.find(MAIN + "v"), c.find(MAIN + "f")
                    raw = v.text if v is not None else None
                    value = raw
                    if kind == "s" and raw and raw.strip().isdigit() and int(raw) < len(strings):
                        value = strings[int(raw)]
                    elif kind == "inlineStr":
                        raw = value = _text(c)
                    num, scale, key = literal(raw) if kind not in ("s", "str", "inlineStr", "b", "e") else (None, None, None)
                    yield (name, s.get("name"), k, s.get("state", "visible"), row, col, c.get("r"), kind, raw, value, num, scale, key, f.text if f is not None else None, ordinal, None)
                    ordinal += 1
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        yield (name, None, None, *blank, f"{type(e).__name__}: {e}")


class _Workbook(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        from pathlib import Path

        return [_Workbook(str(p)) for p in sorted(Path(self.folder).glob("*.xlsx")) if not p.name.startswith("~$")]

    def read(self, partition):
        from pathlib import Path

        p = Path(partition.path)
        yield from read_workbook(p.name, p.read_bytes())


class XlsxCells(DataSource):
    """Top-level ``*.xlsx`` of a folder without lock files."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def cells_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows through Spark's own file reader, for any store."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder).select("path", "content")

    def run(batches):
        import pandas as pd

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1]
                if not name.startswith("~$"):
                    yield pd.DataFrame(list(read_workbook(name, content)), columns=names).astype({"sheet_ord": "Int32", "row": "Int32", "col": "Int32", "num_scale": "Int32", "cell_ord": "Int64"})

    return files.mapInPandas(run, SCHEMA)
