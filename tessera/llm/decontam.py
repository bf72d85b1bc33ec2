"""Benchmark decontamination: a hash set of the benchmark's n-grams scans documents.

Words are runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII code points.
A window is 13 consecutive words of an item, or a shorter item's whole sequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, rolling, small_batches, stage

WINDOW = 13
#: Words of the benchmark that one pass's hash set may hold; a larger benchmark takes several passes.
PASS_WORDS = 2_000_000
#: Byte map: letters lower-cased, everything outside words a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class GramSet:
    """Hash set of item windows by length; equal hashes are verified word for word."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.ids, self.grams = {}, {}  # word -> number from 1; length -> {window's numbers as bytes: items}
        for item, text in items:
            numbers = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.int32)
            size = min(WINDOW, len(numbers))
            for at in range(len(numbers) - size + 1 if size else 0):
                self.grams.setdefault(size, {}).setdefault(numbers[at : at + size].tobytes(), set()).add(item)

    def freeze(self):
        """Word map and, by window length, sorted hashes and the exact windows."""
        self.hashes = {}
        for size, grams in self.grams.items():
            rows = np.frombuffer(b"".join(grams), np.int32).reshape(-1, size)
            padded = rows.astype(np.uint64).reshape(-1)
            self.hashes[size] = np.unique(rolling(padded, size)[::size])
        return self

    def scan(self, words: list[bytes]):
        """(hit words as a boolean array, items whose windows occur)."""
        hit, items, get = np.zeros(len(words), bool), set(), self.ids.get
        numbers = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
        gaps = np.concatenate([[0], np.cumsum(numbers == 0)])
        for size, grams in self.grams.items():
            if len(numbers) < size or not (ok := np.flatnonzero(gaps[size:] == gaps[:-size])).size:
                continue
            ok = ok[np.isin(rolling(numbers.astype(np.uint64), size)[ok], self.hashes[size])]
            for at in ok:
                if found := grams.get(numbers[at : at + size].tobytes()):
                    hit[at : at + size] = True
                    items |= found
        return hit, items


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in passes of bounded size; the driver holds one at a time."""
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    held, words = [], 0
    for row in items.toLocalIterator():  # a partition at a time
        if held and words >= PASS_WORDS:
            yield held
            held, words = [], 0
        held.append((row["item_id"], bytes(row["text"])))
        words += len(words_of(bytes(row["text"])))
    yield held


HIT = "n_words long, spans array<struct<start: long, stop: long>>, items array<string>"
UNION = """aggregate(array_sort(spans), cast(array() as array<struct<start: bigint, stop: bigint>>), (a, x) -> case
    when size(a) = 0 or a[size(a) - 1].stop < x.start then array_append(a, x)
    else array_append(slice(a, 1, size(a) - 1), named_struct('start', a[size(a) - 1].start, 'stop', greatest(a[size(a) - 1].stop, x.stop))) end)"""


def _scanner(spark: SparkSession, items: list[tuple[str, bytes]]):
    held = spark.sparkContext.broadcast(items)  # bounded by PASS_WORDS

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = GramSet(held.value).freeze()
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                hit, found = grams.scan(words)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                rows.append((len(words), [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])], sorted(found)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    # Nondeterministic: the optimiser must not evaluate it twice.
    return F.pandas_udf(run, HIT).asNondeterministic()


RESULT = ("n_words", "spans", "items", "n_hit", "n_items", "items_sha256", "contaminated")


def _scanned(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...]) -> tuple[DataFrame, str]:
    """The ``carry`` columns of docs and one struct of RESULT, under a name of its own.
    Passes follow one another: each result but the last is written before the next begins."""
    small_batches(docs.sparkSession)
    body, out, before = (free_name(docs, c) for c in ("body", "found", "before"))
    found = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias(body))
    merged, passes = None, _passes(benchmark)
    items = next(passes)
    while items is not None:
        now, items = _scanner(docs.sparkSession, items), next(passes, None)
        found = found.withColumn(out, now(body))
        spans, names = F.col(out)["spans"], F.col(out)["items"]
        if merged is not None:
            spans, names = F.concat(spans, F.col(before)["spans"]), F.concat(names, F.col(before)["items"])
        merged = F.struct(F.col(out)["n_words"].alias("n_words"), spans.alias("spans"), names.alias("items"))
        if items is not None:
            found = stage(found.select(*carry, body, merged.alias(before)), "decontam")
    found = found.select(*carry, merged.alias(out)).select(*carry, F.struct(f"{out}.n_words", F.expr(UNION.replace("(spans)", f"({out}.spans)")).alias("spans"), F.array_sort(F.array_distinct(f"{out}.items")).alias("items")).alias(out))
    r = F.col(out)
    n_hit = F.aggregate(r["spans"], F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    more = F.struct(*[r[c].alias(c) for c in RESULT[:3]], n_hit.alias("n_hit"), F.size(r["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(r["items"], ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 20 >= r["n_words"])).alias("contaminated"))
    return found.select(*carry, more.alias(out)), out


def scan(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs(text, ...): the ``carry`` columns, n_words, spans, items, n_hit,
    n_items, items_sha256, contaminated.

    spans: word positions [start, stop) inside any occurrence of a window, disjoint and
    ascending. items: ids (as strings, sorted) with an occurring window; a null item_id
    is the string ``null``. contaminated: some word is hit and at least one in twenty.
    Null or wordless texts, and items, have no words and match nothing; repeated rows
    are each returned; an empty benchmark hits nothing. A benchmark above PASS_WORDS
    words is scanned in passes, one after another, whose results are merged per row.
    """
    found, r = _scanned(docs, benchmark, carry)
    return found.select(*carry, *[F.col(r)[c].alias(c) for c in RESULT])


def without_spans(text: str, spans) -> str:
    """The text without the bytes of the hit words and what stands between words of a span."""
    raw = (text or "").encode("utf-8", "replace")
    at = [m.span() for m in re.finditer(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", raw.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))]
    kept, last = [], 0
    for start, stop in spans:
        kept.append(raw[last : at[start][0]])
        last = at[stop - 1][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "replace")


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """docs, with its own columns whatever their names, without contaminated documents (``documents``), or
    with the hit spans cut out of contaminated ones (``spans``); clean texts stay as they are."""
    found, r = _scanned(docs, benchmark, tuple(docs.columns))
    if remove == "documents":
        return found.where(~F.col(r)["contaminated"]).select(*docs.columns)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, [(s["start"], s["stop"]) for s in sp]) for t, sp in zip(text, spans)])

    text = F.when(F.col(r)["contaminated"], cut(F.coalesce("text", F.lit("")), F.col(r)["spans"])).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
