"""Sinks: single JSON documents, appended logs, Markdown and HTML reports, manifests.

Reports and manifests are one case's: small tables that the driver collects.
"""

from __future__ import annotations

import html
import json
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _put(df: DataFrame, path: str, text: str) -> None:
    """One text file in any store that Spark writes."""
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def write_document(path: str, head: dict, **tables: DataFrame) -> dict:
    """One JSON document: ``head`` and an array a table. Tables must be reports, not corpora."""
    body = dict(head) | {name: [json.loads(r) for r in df.toJSON().collect()] for name, df in tables.items()}
    _put(next(iter(tables.values())), path, json.dumps(body, ensure_ascii=False, indent=2))
    return body


def append_log(df: DataFrame, folder: str) -> None:
    """Rows as JSON lines, added to a log; streams do the same from foreachBatch."""
    df.write.mode("append").json(folder)


def markdown_table(df: DataFrame, most: int = 100) -> str:
    cell = lambda v: re.sub(r"\s+", " ", "" if v is None else str(v)).replace("|", "\\|")
    rows = df.limit(most).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def write_markdown(path: str, title: str, **sections: DataFrame) -> str:
    parts = [f"# {title}", *(f"## {name.replace('_', ' ').capitalize()}\n\n{markdown_table(df)}" for name, df in sections.items())]
    text = "\n\n".join(parts) + "\n"
    _put(next(iter(sections.values())), path, text)
    return text


def write_html(path: str, title: str, **sections: DataFrame) -> str:
    """The same as a page; every value is escaped."""
    h = lambda v: html.escape("" if v is None else str(v), quote=True)
    out = [f"<!doctype html><meta charset=utf-8><title>{h(title)}</title><h1>{h(title)}</h1>"]
    for name, df in sections.items():
        rows = "".join("<tr>" + "".join(f"<td>{h(v)}</td>" for v in r) + "</tr>" for r in df.limit(100).collect())
        out.append(f"<h2>{h(name)}</h2><table><tr>{''.join(f'<th>{h(c)}</th>' for c in df.columns)}</tr>{rows}</table>")
    text = "\n".join(out)
    _put(next(iter(sections.values())), path, text)
    return text


def write_run_manifest(df: DataFrame, path: str, run: dict, outputs: list[str]) -> dict:
    """Run facts and outputs; written again after the report with its outputs added."""
    body = run | {"outputs": sorted(outputs)}
    _put(df, path, json.dumps(body, ensure_ascii=False, indent=2, sort_keys=True))
    return body


def window_around(cells: DataFrame, marked: DataFrame, rows: int = 3, cols: int = 2) -> DataFrame:
    """What an evidence card shows: cells(workbook, sheet, row, col, ...) around the marked
    cells(finding_id, workbook, sheet, row, col), with whether they are marked."""
    keys = ["workbook", "sheet"]
    box = marked.groupBy("finding_id", *keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    near = cells.join(box, keys).where(F.col("row").between(F.col("r0") - rows, F.col("r1") + rows) & F.col("col").between(F.col("c0") - cols, F.col("c1") + cols)).drop("r0", "r1", "c0", "c1")
    return near.join(marked.select("finding_id", *keys, "row", "col").withColumn("marked", F.lit(True)), ["finding_id", *keys, "row", "col"], "left").fillna({"marked": False})


def remove_workdir(path: str, root: str) -> bool:
    """Delete a work folder only if it lies inside ``root`` and is not it."""
    p, r = Path(path).resolve(), Path(root).resolve()
    if p == r or r not in p.parents or not p.is_dir():
        return False
    shutil.rmtree(p)
    return True
