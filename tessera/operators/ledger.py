"""Evidence ledger: blocks and pages of parsed papers, tables, images, captions, indexes."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions.digits import NUMBER, ratio_key, scaled
from tessera.operators import text as lines_of

#: Keys of parsed JSON, tried in this order.
CONTAINERS = ("content", "contents", "blocks", "data", "items", "result")
BLOCK_ARRAYS = ("layout_dets", "para_blocks", "preproc_blocks", "blocks", "spans", "lines")
TEXTS = ("text", "content", "md", "html", "caption", "title", "text_content")
IMAGES = ("img_path", "image_path", "path", "src", "file", "filename")
PAGES, INDEXES = ("page", "page_no", "page_num", "page_number"), ("page_idx", "page_index")
TYPES, BOXES = ("type", "category", "block_type", "content_type"), ("bbox", "box", "position", "rect")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
#: Labels of figures and tables.
LABEL = r"(?i)\b(fig(?:ure)?\.?|table)\s*[:.]?\s*(S?\d+[A-Za-z0-9_.-]*)"
LABEL_CJK = r"([图表])\s*(S?\d+[A-Za-z0-9_.-]*)"


def block_text(value) -> str | None:
    """Text of a block: its own, that of the first text key, or that of what it holds."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for t in map(block_text, value) if t) or None
    if isinstance(value, dict):
        own = next((value[k] for k in TEXTS if isinstance(value.get(k), str)), None)
        return own if own is not None else next((t for k in ("spans", "lines", "children") if isinstance(value.get(k), list) and (t := block_text(value[k]))), None)
    return None


def _whole(value) -> int | None:
    try:
        return None if isinstance(value, bool) or value is None else int(value)
    except (TypeError, ValueError):
        return None


def block_page(block: dict, parent=(None, None)) -> tuple[int | None, int | None]:
    """(page, index): either gives the other; without both, the parent's."""
    page, index = (_whole(next((block[k] for k in keys if k in block), None)) for keys in (PAGES, INDEXES))
    if page is None and index is None:
        return parent
    return (index + 1 if page is None else page), (index if index is not None else page - 1 if page > 0 else page)


def block_box(block: dict) -> tuple | None:
    """(x0, y0, x1, y1) of four numbers, corners, sides or an origin with a size; the hull of points."""
    for key in BOXES:
        v = block.get(key)
        if isinstance(v, dict):
            if "points" in v:
                v = v["points"]
            elif all(k in v for k in ("x0", "y0", "x1", "y1")):
                return v["x0"], v["y0"], v["x1"], v["y1"]
            elif all(k in v for k in ("left", "top", "right", "bottom")):
                return v["left"], v["top"], v["right"], v["bottom"]
            elif all(k in v for k in ("left", "top", "width", "height")):
                return v["left"], v["top"], v["left"] + v["width"], v["top"] + v["height"]
        if isinstance(v, list) and len(v) >= 4 and all(isinstance(x, (int, float)) for x in v[:4]):
            return tuple(v[:4])
        if isinstance(v, list) and v and all(isinstance(p, list) and len(p) >= 2 for p in v):
            xs, ys = [p[0] for p in v], [p[1] for p in v]
            return min(xs), min(ys), max(xs), max(ys)
    return None


def is_image(value) -> bool:
    path = value.split("?", 1)[0].lower() if isinstance(value, str) else ""
    return path.rsplit(".", 1)[-1] in IMAGE_SUFFIXES and "." in path or "/images/" in path or path.startswith("images/")


def block_image(block: dict) -> str | None:
    found = next((block[k] for k in IMAGES if is_image(block.get(k))), None)
    for k in ("image", "img"):
        if found is None and isinstance(block.get(k), dict):
            found = block_image(block[k])
        elif found is None and is_image(block.get(k)):
            found = block[k]
    return found.strip().strip("\"'") if found else None


def block_label(text: str | None) -> tuple[str, str, str] | None:
    """(kind, label, key) of the first figure or table label of a text."""
    t = (text or "").strip()
    if m := re.search(LABEL, t):
        kind = "table" if m[1].lower().startswith("table") else "figure"
        label = f"{kind.title()} {m[2]}"
    elif m := re.search(LABEL_CJK, t):
        kind, label = ("table" if m[1] == "表" else "figure"), m[1] + m[2]
    else:
        return None
    return kind, label, re.sub("[^a-z0-9一-龥]+", "", label.lower())


def block_kind(block: dict) -> str:
    """table, figure, caption, equation or text by the type's words; a label makes a caption."""
    kind = str(next((block[k] for k in TYPES if block.get(k) is not None), "")).lower()
    for name, words in (("table", ("table",)), ("figure", ("image", "figure", "fig")), ("caption", ("caption",)), ("equation", ("equation", "formula")), ("text", ("text", "paragraph", "title", "heading"))):
        if any(w in kind for w in words):
            return name
    return "caption" if block_label(block_text(block)) else "unknown"


def cells_of(line: str) -> list[str]:
    s = line.rstrip("\n").removeprefix("|")
    return s.removesuffix("|").split("|")


def _is_separator(cells: list[str]) -> bool:
    return bool(cells) and all(re.fullmatch(r"\s*:?-{2,}:?\s*", c) for c in cells)


def html_rows(value: str) -> list[list[str]]:
    rows = [[html.unescape(re.sub("<[^>]+>", "", c)).strip() for c in re.findall(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr>", value)]
    return [r for r in rows if r]


def table_rows(value) -> list[list[str]] | None:
    """Rows of a table given as lists, as objects, as HTML or as Markdown."""
    if isinstance(value, list):
        rows = []
        for x in value:
            cells = next((x[k] for k in ("cells", "row", "values") if x.get(k)), None) if isinstance(x, dict) else x
            if isinstance(cells, list):
                rows.append([str(c) if isinstance(x, list) else block_text(c) or str(c) for c in cells])
        return rows or None
    if isinstance(value, dict):
        return next((r for k in ("rows", "table_rows", "table_body", "body", "cells") if k in value and (r := table_rows(value[k]))), None)
    if isinstance(value, str):
        if "<table" in value.lower() or "<tr" in value.lower():
            return html_rows(value) or None
        lines = [x for x in value.splitlines() if "|" in x and not x.strip().lower().startswith(("![", "<img"))]
        if len(lines) >= 2:
            rows = [[c.strip() for c in cells_of(x)] for x in lines]
            return [rows[0], *rows[2:]] if _is_separator(cells_of(lines[1])) else rows
    return None


def block_rows(block: dict) -> list[list[str]] | None:
    own = next((r for k in ("table_body", "table_rows", "rows", "cells", "table") if k in block and (r := table_rows(block[k]))), None)
    return own or table_rows(block_text(block))


BLOCK = "source string, json_path string, kind string, text string, label_kind string, label string, label_key string, page int, page_index int, x0 double, y0 double, x1 double, y1 double, image string, table array<array<string>>"


def _block(source: str, path: str, block: dict, parent=(None, None)) -> tuple:
    text, box = block_text(block), block_box(block) or (None,) * 4
    label = block_label(text) or (None,) * 3
    return (source, path, block_kind(block), text, *label, *block_page(block, parent), *(None if v is None else float(v) for v in box), block_image(block), block_rows(block))


def content_blocks(data) -> list[tuple]:
    """Blocks of a content list: the array itself, that of a container key, or the first
    array of objects. None of them is a row whose kind is ``schema_unknown``."""
    found = (None, data) if isinstance(data, list) else None
    if isinstance(data, dict):
        found = next(((k, data[k]) for k in CONTAINERS if isinstance(data.get(k), list)), None)
        found = found or next(((k, v) for k, v in data.items() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v[:5])), None)
    if found is None:
        return [("content", "$", "schema_unknown", *[None] * 12)]
    return [_block("content", f"$.{found[0]}[{i}]" if found[0] else f"$[{i}]", x if isinstance(x, dict) else {"value": x}) for i, x in enumerate(found[1])]


def _walk(value, path="$") -> Iterator[tuple[str, object]]:
    todo = [(path, value)]
    while todo:
        path, node = todo.pop()
        yield path, node
        below = [(f"{path}.{k}", v) for k, v in node.items()] if isinstance(node, dict) else [(f"{path}[{i}]", v) for i, v in enumerate(node)] if isinstance(node, list) else []
        todo += reversed(below)


def is_page(node: dict) -> bool:
    return any(k in node for k in PAGES + INDEXES) and (any(isinstance(node.get(k), list) for k in BLOCK_ARRAYS) or any(k in node for k in ("width", "height", "w", "h", "page_size")))


def middle_blocks(data) -> list[tuple]:
    """Every object of any block array, with the page of the object that holds the array."""
    out = []
    for path, node in _walk(data):
        if isinstance(node, dict):
            parent = block_page(node) if is_page(node) else (None, None)
            out += [_block("middle", f"{path}.{k}[{i}]", x, parent) for k in BLOCK_ARRAYS if isinstance(node.get(k), list) for i, x in enumerate(node[k]) if isinstance(x, dict)]
    return out


def page_nodes(data) -> list[tuple]:
    """(json_path, page, page_index, width, height) of page-like objects."""
    out = []
    for path, node in _walk(data):
        if isinstance(node, dict) and is_page(node):
            size = node.get("page_size")
            pair = size[:2] if isinstance(size, list) and len(size) >= 2 else (size.get("width") or size.get("w"), size.get("height") or size.get("h")) if isinstance(size, dict) else (None, None)
            w, h = node.get("width", node.get("w")), node.get("height", node.get("h"))
            w, h = pair[0] if w is None else w, pair[1] if h is None else h
            out.append((path, *block_page(node), None if w is None else float(w), None if h is None else float(h)))
    return out


def _loaded(source: str | None):
    try:
        return json.loads(source) if source else None
    except ValueError:
        return None


@udtf(returnType=BLOCK)
class PaperBlocks:
    def eval(self, content: str, middle: str):
        for data, read in ((content, content_blocks), (middle, middle_blocks)):
            if (loaded := _loaded(data)) is not None:
                yield from read(loaded)


@udtf(returnType="json_path string, page int, page_index int, width double, height double")
class PaperPages:
    def eval(self, middle: str):
        if (loaded := _loaded(middle)) is not None:
            yield from page_nodes(loaded)


def paper_blocks(papers: DataFrame) -> DataFrame:
    """(doc_id, BLOCK...) of papers(doc_id, content, middle): two JSON texts, either may be
    null or broken and then has no blocks."""
    spark = papers.sparkSession
    spark.udtf.register("paper_blocks", PaperBlocks)
    return spark.sql("select d.doc_id, b.* from {papers} d, lateral paper_blocks(d.content, d.middle) b", papers=papers)


def paper_pages(papers: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, page_index, width, height, origin): page objects, and pages that only
    blocks name."""
    spark = papers.sparkSession
    spark.udtf.register("paper_pages", PaperPages)
    own = spark.sql("select d.doc_id, p.page, p.page_index, p.width, p.height from {papers} d, lateral paper_pages(d.middle) p", papers=papers).withColumn("origin", F.lit("middle"))
    named = (paper_blocks(papers) if blocks is None else blocks).where("page is not null or page_index is not null").select("doc_id", "page", "page_index").distinct()
    l, r = named.alias("l"), own.select("doc_id", "page", "page_index").distinct().alias("r")
    rest = l.join(r, (F.col("l.doc_id") == F.col("r.doc_id")) & F.col("l.page").eqNullSafe(F.col("r.page")) & F.col("l.page_index").eqNullSafe(F.col("r.page_index")), "left_anti")
    return own.unionByName(rest.withColumn("origin", F.lit("derived")), allowMissingColumns=True)


def image_refs(records: DataFrame, images: DataFrame) -> DataFrame:
    """records(record_id, image) with image_id and how it was found: by its path, by a file
    name that one image alone has, ambiguous, or unresolved."""
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    by_path = images.select(F.col("relative_path").alias("image"), F.col("image_id").alias("exact"))
    by_name = images.groupBy(name("relative_path").alias("name")).agg(F.count("*").alias("n"), F.min("image_id").alias("one"))
    out = records.where("image is not null").join(by_path, "image", "left").withColumn("name", name("image")).join(by_name, "name", "left")
    how = F.when(F.col("exact").isNotNull(), "path").when(F.col("n") == 1, "name").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return out.select("record_id", "image", how.alias("how"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("image_id"))


def linked_captions(captions: DataFrame, items: DataFrame) -> DataFrame:
    """captions(caption_id, label_kind, label_key, page) with the item(item_id, kind,
    label_key, page) that they caption: the only one with their label (high), else the only
    one of their kind on the page without a caption (medium). The second step is greedy in
    the order of captions, so it runs over one page and kind at a time."""
    one = items.where("label_key is not null").groupBy("kind", "label_key").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id")).where("n = 1").drop("n")
    high = captions.join(one.withColumnRenamed("kind", "label_kind"), ["label_kind", "label_key"]).select("caption_id", "item_id", F.lit("high").alias("confidence"))
    left = captions.join(high, "caption_id", "left_anti").where("label_kind in ('figure', 'table') and page is not null").select(F.col("label_kind").alias("kind"), "page", "caption_id")
    free = items.where("page is not null").join(high, "item_id", "left_anti").select("kind", "page", "item_id")

    def greedy(key, caps, its):
        import pandas as pd

        open_items, out = sorted(its["item_id"]), []
        for caption in sorted(caps["caption_id"]):
            if len(open_items) == 1:
                out.append((caption, open_items.pop(), "medium"))
        return pd.DataFrame(out, columns=["caption_id", "item_id", "confidence"])

    medium = left.groupBy("kind", "page").cogroup(free.groupBy("kind", "page")).applyInPandas(greedy, "caption_id string, item_id string, confidence string")
    return captions.select("caption_id").join(high.unionByName(medium), "caption_id", "left")


def table_cells(docs: DataFrame) -> DataFrame:
    """(doc_id, start_line, line, col, text, header) of Markdown tables: one edge pipe is cut
    on each side; a second row of dashes makes the first one a header and is left out."""
    inside = lines_of.lines(docs).alias("l").join(lines_of.tables(docs).alias("t"), (F.col("l.doc_id") == F.col("t.doc_id")) & F.col("l.line").between(F.col("t.start_line"), F.col("t.end_line")))
    cells = F.split(F.regexp_replace(F.regexp_replace("text", r"^\|", ""), r"\|$", ""), r"\|", -1)
    rows = inside.select("l.doc_id", "start_line", "line", cells.alias("cells")).withColumn("dashes", F.forall("cells", lambda c: c.rlike(r"^\s*:?-{2,}:?\s*$")))
    headed = F.max(F.when((F.col("line") == F.col("start_line") + 1) & F.col("dashes"), 1).otherwise(0)).over(Window.partitionBy("doc_id", "start_line")) == 1
    kept = rows.withColumn("headed", headed).where(~(F.col("headed") & (F.col("line") == F.col("start_line") + 1)))
    out = kept.select("doc_id", "start_line", "line", (F.col("headed") & (F.col("line") == F.col("start_line"))).alias("header"), F.posexplode("cells").alias("col", "text"))
    return out.select("doc_id", "start_line", "line", (F.col("col") + 1).alias("col"), F.trim("text").alias("text"), "header")


def cell_number(cell: Column) -> Column:
    """The number of a cell that holds exactly one; its sign of percent and commas dropped."""
    found = F.regexp_extract_all(cell, F.lit(NUMBER), F.lit(0))
    return F.when(F.size(found) == 1, F.regexp_replace(found[0], "[,%]", "").try_cast("decimal(38,18)"))


def table_relations(docs: DataFrame, least: int = 8, share: float = 0.8, most: int = 100) -> DataFrame:
    """Modal difference or ratio (four places) of the columns of tables with digits, whose
    numbers are met by place: columns of equal length, of ``least`` at least. The first
    ``most`` of a document."""
    lines = lines_of.lines(docs).alias("l")
    inside = lines.join(lines_of.tables(docs, True).alias("t"), (F.col("l.doc_id") == F.col("t.doc_id")) & F.col("l.line").between(F.col("t.start_line"), F.col("t.end_line")))
    cells = inside.select("l.doc_id", "start_line", "line", F.posexplode(F.split(F.regexp_replace("text", r"^\|+|\|+$", ""), r"\|", -1)).alias("c", "text"))
    values = cells.select("doc_id", "start_line", "line", (F.col("c") + 1).alias("col"), cell_number(F.trim("text")).alias("v")).where("v is not null")
    table = ["doc_id", "start_line"]
    values = values.withColumn("place", F.row_number().over(Window.partitionBy(*table, "col").orderBy("line"))).withColumn("n", F.count("*").over(Window.partitionBy(*table, "col"))).where(F.col("n") >= least)
    by_place = values.groupBy(*table, "place").agg(F.array_sort(F.collect_list(F.struct("col", "v", "n"))).alias("c"))
    pairs = by_place.select(*table, "place", F.explode(F.expr("flatten(transform(c, (x, i) -> transform(filter(slice(c, i + 2, size(c)), y -> y.n = x.n), y -> struct(x.col as left_col, y.col as right_col, x.v as l, y.v as r))))")).alias("p")).select(*table, "place", "p.*")
    kinds = F.array(F.struct(F.lit("fixed_difference_candidate").alias("relationship"), scaled((F.col("l") - F.col("r")).cast("double"), 4).alias("value")), F.struct(F.lit("fixed_ratio_candidate").alias("relationship"), ratio_key(F.col("l"), F.col("r"), 4).alias("value")))
    pair = [*table, "left_col", "right_col", "relationship"]
    counts = pairs.select(*pair[:-1], "place", F.explode(kinds).alias("k")).select(*pair[:-1], "place", "k.*").where("value is not null").groupBy(*pair, "value").agg(F.count("*").alias("top"), F.min("place").alias("first"))
    w = Window.partitionBy(*pair)
    best = counts.withColumns({"n": F.sum("top").over(w), "r": F.row_number().over(w.orderBy(F.desc("top"), "first"))}).where((F.col("r") == 1) & (F.col("n") >= least) & (F.col("top") / F.col("n") >= share))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_line", "left_col", "right_col", "relationship"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select(*pair, "value", F.concat(F.col("top").cast("string"), F.lit("/"), F.col("n").cast("string")).alias("support"))


def number_scope(docs: DataFrame, enough: int = 20) -> DataFrame:
    """Numbers of each document to analyse: those on table lines if there are ``enough``."""
    numbers = lines_of.numbers(docs).select("doc_id", "line")
    tables = lines_of.tables(docs, True).select("doc_id", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    marked = numbers.join(tables.withColumn("inside", F.lit(1)), ["doc_id", "line"], "left")
    agg = marked.groupBy("doc_id").agg(F.count("*").alias("n_numbers"), F.count("inside").alias("n_table"))
    scope = F.when(F.col("n_table") >= enough, "tables").otherwise("all_fallback_table_numbers_lt_20")
    return agg.select("doc_id", "n_numbers", "n_table", scope.alias("scope"), F.when(F.col("n_table") >= enough, F.col("n_table")).otherwise(F.col("n_numbers")).alias("n_scope"))


def truncated(value: Column, most: int) -> Column:
    """The value, or its beginning with an ellipsis, ``most`` code points at most."""
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, most - 1), F.lit("…")))


def ledger_items(docs: DataFrame, most: int = 500) -> DataFrame:
    """Union of a document's lines, captions, image references, tables and their cells, in
    this order, with ids that run through a document: (doc_id, item_id, kind, line, text)."""
    found = lines_of.classified(docs)
    part = lambda df, i, kind, text, col=None: df.select("doc_id", F.lit(i).alias("part"), F.lit(kind).alias("kind"), F.col("line"), (col if col is not None else F.lit(0)).alias("sub"), text.alias("text"))
    images = found.select("doc_id", "line", F.posexplode(F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))).alias("at", "target"))
    tables = lines_of.tables(docs).select("doc_id", F.col("start_line").alias("line"), "n_lines")
    every = part(found, 0, "markdown_line", F.col("text")).unionByName(part(found.where("label_key <> ''"), 1, "caption", F.col("label"))).unionByName(part(images, 2, "figure", F.col("target"), F.col("at")))
    every = every.unionByName(part(tables, 3, "table", F.col("n_lines").cast("string"))).unionByName(part(table_cells(docs), 4, "cell", F.col("text"), F.col("col")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "line", "sub"))
    return every.select("doc_id", F.format_string("ev-%06d", n).alias("item_id"), "kind", "line", truncated(F.col("text"), most).alias("text"))


def ledger_stats(items: DataFrame) -> DataFrame:
    """Items by document and kind."""
    kinds = ("markdown_line", "caption", "figure", "table", "cell")
    return items.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_items"))


def summarised(value, most: int, depth: int = 2):
    """A JSON value to a depth: 20 keys or items, longer texts cut."""
    if depth <= 0 and isinstance(value, (dict, list)):
        return f"<{type(value).__name__}>"
    if isinstance(value, str):
        return value if len(value) <= most else value[: most - 1] + "…"
    if isinstance(value, dict):
        head = {str(k): summarised(v, most, depth - 1) for k, v in list(value.items())[:20]}
        return head | ({"__truncated__": True} if len(value) > 20 else {})
    if isinstance(value, list):
        return [summarised(v, most, depth - 1) for v in value[:20]] + ([{"__truncated__": True, "remaining": len(value) - 20}] if len(value) > 20 else [])
    return value
