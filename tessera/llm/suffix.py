"""Sparse suffix arrays: passages of over 50 words that several documents share.

A suffix is retained only at content-selected positions: where a 12-word hash is the
least of the 40 that a window of 51 words holds. Equal windows select the
same position, so every shared passage is met. The retained suffixes are sorted by their
words, and neighbours' common prefixes tell how far each matches to the right; sorted by
the words before them, read backwards, their neighbours' common prefixes tell how far each
matches to the left. A position is in a shared passage if some other document agrees with
it in so many words to the left and so many to the right that they are 51 together; the
union of a document's matches is the whole passage to its left and right end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, rolling, small_batches, stage, text_parts, trim, word_hashes

#: Words of the shortest passage, of a minimiser, and the minimisers a window holds.
PASSAGE, GRAM = 51, 12
SPAN = PASSAGE - GRAM + 1
#: Contexts that one task sorts, and contexts of one 12-word hash above which its windows are compared by their hashes.
TILE_ROWS, HOT = 20_000, 100_000


def _sliding(values, width: int, pick):
    """pick (np.minimum or np.maximum) over every run of width values, by doubling."""
    size = 1
    while 2 * size <= width:
        values, size = pick(values[: len(values) - size], values[size:]), 2 * size
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def minimisers(hashes):
    """Positions of 12-word hashes that are a window's least, and those hashes."""
    if len(hashes) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = rolling(hashes, GRAM)
    least = np.pad(_sliding(grams, SPAN, np.minimum), SPAN - 1)
    # The greatest of the minima of all windows around a position is its own hash or below it.
    at = np.flatnonzero(_sliding(least, SPAN, np.maximum) == grams)
    return at, grams[at]


def word_rows(hashes, texts: list):
    """Word hashes of each text in turn."""
    for part in text_parts(texts):
        words, counts = hashes(part)
        yield from np.split(words, np.cumsum(counts)[:-1])


def _positions(docs: DataFrame) -> DataFrame:
    """(doc_id, gid, n, tid, grams, places) a row; tid digests the words."""

    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["doc_id", "h", "gid", "n", "tid", "grams", "places"]
        hashes, gid = word_hashes(), TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for h in word_rows(hashes, batch.column("text").to_pylist()):
                at, grams = minimisers(h)
                out.append((gid, len(h), xxhash.xxh128_digest(h.tobytes()) if len(h) >= PASSAGE else None, grams.view(np.int64), at.astype(np.int32)))
                gid += 1
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *map(pa.array, zip(*out), kinds)], names=names)

    return stage(docs.mapInArrow(run, "doc_id long, h long, gid long, n long, tid binary, grams array<long>, places array<int>"), "suffix-docs")


def _contexts(wanted: DataFrame) -> DataFrame:
    """(gram, id, place, left, right, context) around each retained position of rows
    (id, tid, text, at): 32-bit word hashes, SPAN - 1 to the left and PASSAGE from it on;
    left and right say how many of them the text has."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        hashes = word_hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                for id_, tid, h, places in zip(*(batch.column(c).to_pylist() for c in ("id", "tid")), word_rows(hashes, batch.column("text").to_pylist()), batch.column("at").to_pylist()):
                    if not len(h) or xxhash.xxh128_digest(h.tobytes()) != tid:
                        continue
                    at_, n = np.sort(np.array(places, np.int64)), len(h)
                    words = np.concatenate([np.zeros(SPAN - 1, np.uint32), (h >> np.uint64(32)).astype(np.uint32), np.zeros(PASSAGE, np.uint32)])
                    table = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(words, SPAN - 1 + PASSAGE)[at_])
                    grams = rolling(h, GRAM)[at_].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams), pa.array([id_] * len(at_), pa.int64()), pa.array(at_, pa.int64()), pa.array(np.minimum(at_, SPAN - 1), pa.int64()), pa.array(np.minimum(n - at_, PASSAGE), pa.int64()), pa.array([r.tobytes() for r in table], pa.binary())],
                        names=["gram", "id", "place", "left", "right", "context"],
                    )

    return wanted.mapInArrow(run, "gram long, id long, place long, left long, right long, context binary")


def _sorted(rows):
    """(order of the rows by their words, words that each has in common with the one before
    it in that order; -1 for the first)."""
    width = rows.shape[1]
    flat = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * width}").ravel()
    order = np.argsort(flat, kind="stable")
    same = rows[order][1:] == rows[order][:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return order, np.concatenate([[-1], common])


def _classes(order, common, words: int):
    """A number for each row, equal where neighbours agree in so many words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < words)
    return out


def matches(low, high, left, right, table):
    """(fewest, most) words to the left with which each suffix has a neighbour of another
    document in PASSAGE words; -1 where none has. Rows stand for distinct contexts, low
    and high for the least and greatest document that holds one."""
    m = len(low)
    fewest, most = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    if not m:
        return fewest, most
    ahead, behind = _sorted(table[:, SPAN - 1 :]), _sorted(table[:, SPAN - 2 :: -1])
    for back in range(SPAN):
        ok = np.flatnonzero((left >= back) & (right >= PASSAGE - back))
        if not len(ok):
            continue
        both = (_classes(*ahead, PASSAGE - back) * (m + 1) + _classes(*behind, back))[ok]
        order = np.argsort(both, kind="stable")
        both, rows = both[order], ok[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        spread = np.minimum.reduceat(low[rows], first) != np.maximum.reduceat(high[rows], first)
        hit = rows[np.repeat(spread, np.diff(np.append(first, len(rows))))]
        fewest[hit] = np.where(fewest[hit] < 0, back, fewest[hit])
        most[hit] = back
    return fewest, most


_FOUND = "gram long, digest long, left long, right long, fewest long, most long"


def _table(contexts):
    return np.frombuffer(b"".join(contexts), np.uint32).reshape(-1, SPAN - 1 + PASSAGE)


def _compared(distinct: DataFrame, rows: int) -> DataFrame:
    """Rows of _FOUND from distinct contexts, suffixes with one 12-word hash in one task."""

    def run(batches):
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            columns = {c: table.column(c).to_numpy() for c in ("gram", "digest", "low", "high", "left", "right")}
            fewest, most = matches(*(columns[c] for c in ("low", "high", "left", "right")), _table(table.column("context").to_pylist()))
            at = np.flatnonzero(most >= 0)
            yield pa.RecordBatch.from_arrays([*(pa.array(columns[c][at]) for c in ("gram", "digest", "left", "right")), pa.array(fewest[at]), pa.array(most[at])], names=["gram", "digest", "left", "right", "fewest", "most"])
        trim()

    return distinct.repartition(max(8, -(-rows // TILE_ROWS)), "gram").mapInArrow(run, _FOUND)


def _hashed(distinct: DataFrame) -> DataFrame:
    """The same for hashes with very many contexts, which no task could sort: each window of
    each suffix meets its equals by a hash, in sums that combine before they are shuffled."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        names = ["gram", "digest", "left", "right", "low", "high", "back", "window"]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, out = whole.slice(at, 500), []
                table = _table(batch.column("context").to_pylist())
                for row, words in zip(zip(*(batch.column(c).to_pylist() for c in names[:6])), table):
                    for back in range(SPAN):
                        if row[2] >= back and row[3] >= PASSAGE - back:
                            start = SPAN - 1 - back
                            out.append((*row, back, xxhash.xxh64_intdigest(words[start : start + PASSAGE].tobytes()) - (1 << 63)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

    windows = distinct.select("gram", "digest", "left", "right", "low", "high", "context").mapInArrow(run, ", ".join(f"{c} long" for c in ("gram", "digest", "left", "right", "low", "high", "back", "window")))
    spread = windows.groupBy("gram", "back", "window").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x <> y").select("gram", "back", "window")
    hits = windows.join(spread, ["gram", "back", "window"])
    return hits.groupBy("gram", "digest", "left", "right").agg(F.min("back").alias("fewest"), F.max("back").alias("most"))


def repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_repeated, spans.

    Words are separated by ASCII white space, A-Z lower-cased. spans: word positions
    [start, stop) of passages of at least 51 words that some other document has too,
    disjoint and ascending; n_repeated counts their words. Rows with equal words repeat
    each other whole. Null, empty and shorter texts have no spans; every row is returned.
    Repeats inside one document alone do not count.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("h"))
    rows = _positions(texts)
    unique = stage(rows.where("tid is not null").groupBy("tid").agg(F.min("gid").alias("id"), F.count("*").alias("copies")), "suffix-unique")
    found = rows.join(unique.select("id"), rows["gid"] == unique["id"], "left_semi").select(F.col("gid").alias("id"), F.explode(F.arrays_zip("grams", "places")).alias("x")).select("id", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    several = found.groupBy("gram").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("gram")
    places = found.join(several, "gram", "left_semi").groupBy("id").agg(F.collect_list("place").alias("at"))
    wanted = stage(places.join(rows.select(F.col("gid").alias("id"), F.col("doc_id").alias("d"), F.col("h").alias("x"), "tid"), "id"), "suffix-places")
    near = stage(_contexts(texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["d"]) & (texts["h"] == wanted["x"])).select("id", "tid", "text", "at")).withColumn("digest", F.xxhash64("context")), "suffix-contexts")
    # A passage that very many documents share has few distinct contexts; they are one row here, combined map-side.
    distinct = near.groupBy("gram", "digest", "left", "right").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("context").alias("context"))
    hot = stage(near.groupBy("gram").count().where(F.col("count") > HOT).select("gram"), "suffix-hot")
    if hot.isEmpty():
        matched = _compared(distinct, near.count())
    else:
        distinct = stage(distinct, "suffix-distinct")
        matched = _compared(distinct.join(few(hot), "gram", "left_anti"), near.count()).union(_hashed(distinct.join(few(hot), "gram", "left_semi")).select("gram", "digest", "left", "right", "fewest", "most"))
    hits = near.select("gram", "digest", "left", "right", "id", "place").join(matched, ["gram", "digest", "left", "right"])
    spans = hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((F.col("place") - F.col("most")).alias("start"), (F.col("place") - F.col("fewest") + PASSAGE).alias("stop")))).alias("s"))
    union = """aggregate(s, cast(array() as array<struct<start: bigint, stop: bigint>>), (a, x) -> case
        when size(a) = 0 or a[size(a) - 1].stop < x.start then array_append(a, x)
        else array_append(slice(a, 1, size(a) - 1), named_struct('start', a[size(a) - 1].start, 'stop', greatest(a[size(a) - 1].stop, x.stop))) end)"""
    known = unique.join(spans.select("id", F.expr(union).alias("spans")), "id", "left").select("tid", "copies", "spans")
    out = rows.select("doc_id", "n", "tid").join(known, "tid", "left")
    none = F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")
    spans = F.when(F.col("copies") > 1, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")))).otherwise(F.coalesce("spans", none))
    out = out.select("doc_id", F.col("n").alias("n_words"), spans.alias("spans"))
    return out.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("n_repeated"), "spans")
