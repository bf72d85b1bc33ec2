"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Documents are sets of distinct 5-word shingles; two link when 100 * intersection >= 80 *
union, that is when their symmetric difference is at most a ninth of the sum of their
sizes. The join is exact (on 64-bit shingle hashes, sets named by 64-bit hashes) and
never meets all pairs:

1. A fixed-size sketch of document frequencies orders shingles, frequent ones last. Two
   linked sets share three of the first n - ceil(0.8 n) + 3 shingles in that order. Rows
   of a small tile (a shared shingle and a band of sizes) that meet three times are paired;
   rows of a larger one meet its least and greatest set, and all tiles with one least set
   form a group.
2. Bit counts of two bitmaps' difference bound a pair's overlap from above; what that
   admits is intersected exactly, sorted array against sorted array. Links give labels.
3. A large group that still has several labels is recentred: each set is replaced by its
   difference to the shingles that most of the group has. Linked sets differ as little in
   these as before, but what the group has in common is gone, so they are met again in
   tiles of (size band of the differences, shared difference). Such a tile has at most
   half of the group, small ones are paired, large ones are recentred in turn.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_staged, few, free_name, release, rolling, small_batches, stage, text_parts, trim, word_hashes

WORDS, LINK, OF = 5, 80, 100
#: A link's symmetric difference is at most the sum of the sizes divided by this.
NINTH = (OF + LINK) // (OF - LINK)
#: Counters of the frequency sketch (2**SKETCH); keys of a map block and of a reduce range; bucket count above which a key's rows are spread over SALTS ranges.
SKETCH, BLOCK_KEYS, RANGE_KEYS, HOT, SALTS = 20, 250_000, 2_000_000, 500_000, 64
#: Most sets of a tile that are paired at once; most sets of a group that one task compares.
PAIRED, SMALL = 4, 150
#: Keys that two linked, different sets share at least (all such sets have four shingles or more). Steps of a band of sizes.
SHARED, STEPS = 3, 4
_CHUNK = 1 << 16


def shingler():
    """A function from UTF-8 texts to their sorted distinct shingle hashes (uint64 arrays)."""
    hashes = word_hashes()

    def shingles(texts: list[bytes]):
        words, counts = hashes(texts)
        grams = rolling(words, WORDS) if len(words) >= WORDS else words
        out, at = [], 0
        for n in counts:
            own = grams[at : at + n - WORDS + 1] if n >= WORDS else rolling(words[at : at + n], n) if n else words[:0]
            own = np.sort(own)
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
            at += n
        return out

    return shingles


def frequencies(docs: DataFrame):
    """Counts of documents by shingle bucket, over all documents; 2**SKETCH numbers."""

    def count(batches):
        import pyarrow as pa

        shingles, counts, seen = shingler(), np.zeros(1 << SKETCH, np.uint32), False
        for batch in batches:
            for texts in text_parts(batch.column("text").to_pylist()):
                got = np.concatenate(shingles(texts))
                np.add.at(counts, (got >> np.uint64(64 - SKETCH)).astype(np.int64), 1)
                seen = True
        if seen:
            chunks = np.minimum(counts, 65535).astype("<u2").reshape(-1, _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], names=["chunk", "counts"])
        trim()

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, "<u2" if len(counts) == 2 * _CHUNK else "<u8").astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.astype("<u8").tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    sums = docs.mapInArrow(count, schema).withColumn("salt", F.spark_partition_id() % 16)
    for by in (("chunk", "salt"), ("chunk",)):
        sums = sums.repartition(*by).select("chunk", "counts").mapInArrow(add, schema).withColumn("salt", F.lit(0))
    total = np.zeros((1 << SKETCH) // _CHUNK * _CHUNK, np.uint64).reshape(-1, _CHUNK)
    for r in sums.select("chunk", "counts").collect():  # 16 chunks
        total[r["chunk"]] += np.frombuffer(r["counts"], "<u8")
    return total.reshape(-1)


def ranks(counts):
    """Frequency class of each bucket: 0 for what chance explains, more for frequent ones;
    64 is added where a key may be hot."""
    mean = counts.mean()
    over = (counts - mean) / (4 * np.sqrt(mean) + 1e-9)
    classes = np.where(over < 1, 0, 1 + np.log2(np.maximum(over, 1))).clip(0, 62).astype(np.uint8)
    return classes + np.where(counts > HOT, 64, 0).astype(np.uint8)


def prefix(shingles, classes):
    """The first n - ceil(0.8 n) + SHARED shingles in the order of (class, hash), as 64-bit keys."""
    n = len(shingles)
    if not n:
        return shingles
    order = (classes[(shingles >> np.uint64(64 - SKETCH)).astype(np.int64)] & 63).astype(np.uint64) << np.uint64(58) | shingles >> np.uint64(6)
    length = min(n, n - -(-LINK * n // OF) + SHARED)
    return np.partition(order, length - 1)[:length].copy()


def hot(keys, classes):
    """Which keys lie in a bucket of very many documents."""
    return classes[(keys >> np.uint64(58 - SKETCH) & np.uint64((1 << SKETCH) - 1)).astype(np.int64)] >= 64


def step(n: int) -> int:
    """Step of a size: those of sets that link differ by STEPS at most."""
    return int(STEPS * np.log(n) / np.log(OF / LINK) + 1e-9)


def banded(keys, bands):
    """Keys (as int64) that differ by band, too."""
    mixed = (keys ^ bands.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ mixed >> np.uint64(32)).view(np.int64)


def bitmap(shingles) -> bytes:
    """Hashed bitmap of at least four bits a shingle (a power of two, 64 at least)."""
    width = 1 << max(6, int(4 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(shingles * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="big").tobytes()


def fold(words, width: int):
    """Bitmaps (rows of uint64) halved by OR of neighbouring bits' blocks until they have ``width`` words.
    Positions are the hash's top bits, so a half as wide bitmap is the OR of bit pairs."""
    while words.shape[1] > width:
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="big")
        words = np.packbits(bits[:, ::2] | bits[:, 1::2], axis=1, bitorder="big").view(np.uint64)
    return words


def enough(inter, a, b):
    return OF * inter >= LINK * (a + b - inter)


def may_link(na, nb, differ):
    """Can sets of these sizes, whose bitmaps differ in so many bits, link? Each differing
    bit stands for an element outside the intersection."""
    most = np.minimum(np.minimum(na, nb), (na + nb - differ) // 2)
    return enough(most, na, nb)


#: What ``_met`` returns: documents (a: the set's id), pairs to compare, pairs of a tile's least set and another, rows (key, id) of hot keys.
DOCUMENT, PAIR, STAR, MEMBER = 0, 1, 2, 3
_FOUND = "kind int, a long, b long, doc_id long, n int, h long"


def _met(docs: DataFrame, classes, ranges: int) -> DataFrame:
    """Rows of _FOUND. Keys travel packed by ranges of their hash, once; copies of a set
    are one entry a map block and one after it, so they fill no range."""
    held = docs.sparkSession.sparkContext.broadcast(classes)  # 2**SKETCH bytes

    def emit(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        names, kinds = ["r", "doc_id", "id", "n", "h", "keys", "ids", "steps"], [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        salt = ranges + TaskContext.get().partitionId() % SALTS
        shingles, keys, ids, steps, held_keys, seen = shingler(), [], [], [], 0, set()
        width = (1 << 64) // ranges + 1

        def packed():
            sizes = [len(x) for x in keys]
            k, o, b = np.concatenate(keys), np.repeat(np.array(ids, np.int64), sizes), np.repeat(np.array(steps, "<u2"), sizes)
            r = np.where(hot(k, held.value), salt, (k * np.uint64(0x9E3779B97F4A7C15) // np.uint64(width)).astype(np.int64)).astype(np.int32)
            order = np.argsort(r, kind="stable")
            r, k, o, b = r[order], k[order].astype("<u8"), o[order].astype("<i8"), b[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(r)]])
            n = len(starts)
            return pa.RecordBatch.from_arrays([pa.array(r[starts], kinds[0]), *(pa.nulls(n, x) for x in kinds[1:5]), *(pa.array([x[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()) for x in (k, o, b))], names=names)

        for batch in batches:
            own, sizes = [], []
            for s in (s for part in text_parts(batch.column("text").to_pylist()) for s in shingles(part)):
                id_ = int(xxhash.xxh64_intdigest(s.tobytes())) - (1 << 63) if len(s) else None
                own.append(id_)
                sizes.append(len(s))
                if len(s) and id_ not in seen:
                    seen.add(id_)
                    keys.append(prefix(s, held.value))
                    ids.append(id_)
                    steps.append(step(len(s)))
                    held_keys += len(keys[-1])
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(n) % 997, kinds[0]), batch.column("doc_id"), pa.array(own, kinds[2]), pa.array(sizes, kinds[3]), batch.column("h"), *(pa.nulls(n, x) for x in kinds[5:])], names=names)
            if held_keys > BLOCK_KEYS:
                yield packed()
                keys, ids, steps, held_keys, seen = [], [], [], 0, set()
        if keys:
            yield packed()
        trim()

    def meet(batches):
        import pyarrow as pa
        import pyarrow.compute as pc  # a worker need not have it from an earlier task

        blocks: dict[int, list] = {}

        def table(kind, a, b, times=None):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()) if times is None else pa.array(times, pa.int32()), pa.nulls(n, pa.int64())], names=["kind", "a", "b", "doc_id", "n", "h"])

        for batch in batches:
            here = batch.filter(pc.less(batch.column("r"), 0))
            if here.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([DOCUMENT] * here.num_rows, pa.int32()), here.column("id"), pa.nulls(here.num_rows, pa.int64()), here.column("doc_id"), here.column("n"), here.column("h")], names=["kind", "a", "b", "doc_id", "n", "h"])
            rest = batch.filter(pc.greater_equal(batch.column("r"), 0))
            for r, *packs in zip(*(rest.column(c).to_pylist() for c in ("r", "keys", "ids", "steps"))):
                blocks.setdefault(r, []).append(packs)
        for r in list(blocks):
            here = blocks.pop(r)
            keys, ids, steps = (np.frombuffer(b"".join(x[i] for x in here), kind) for i, kind in enumerate(("<u8", "<i8", "<u2")))
            if r >= ranges:
                both, doubled = (np.concatenate([banded(keys, steps // STEPS + i) for i in (0, 1)]), np.concatenate([ids, ids]))
                a, b = _unique(both, doubled)
                yield table(MEMBER, a, b)
                continue
            (a, b, times), stars = _tile_pairs(keys, ids, steps.astype(np.int64))
            yield table(PAIR, a, b, times)
            yield table(STAR, *stars)
        trim()

    sent = docs.mapInArrow(emit, "r int, doc_id long, id long, n int, h long, keys binary, ids binary, steps binary")
    return stage(sent.repartition(ranges, "r").mapInArrow(meet, _FOUND), "ngram-met", by="kind")


def _unique(a, b):
    """Distinct rows of two columns, sorted by both."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _tile_pairs(keys, ids, steps):
    """((a, b, keys in which they meet), (least id of a tile, id)) of the tiles that keys and
    bands make. A set is in the tiles of its own band of sizes and of the next larger one;
    two sets meet in the tile of the larger one's band. Rows of a tile above PAIRED meet its
    greatest id as if in enough keys."""
    band = steps // STEPS
    tile = np.concatenate([banded(keys, band), banded(keys, band + 1)])
    ids, steps, upper = np.concatenate([ids, ids]), np.concatenate([steps, steps]), np.concatenate([band, band + 1])
    order = np.lexsort((ids, tile))
    tile, ids, steps, upper = tile[order], ids[order], steps[order], upper[order]
    new = np.ones(len(tile), bool)
    new[1:] = (tile[1:] != tile[:-1]) | (ids[1:] != ids[:-1])
    tile, ids, steps, upper = tile[new], ids[new], steps[new], upper[new]
    first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(tile)))
    group = np.repeat(np.arange(len(first)), sizes)
    small, met = sizes <= PAIRED, []
    for distance in range(1, min(PAIRED, len(group))):
        x = np.flatnonzero(small[group[distance:]] & (group[distance:] == group[:-distance]))
        y = x + distance
        ok = (np.abs(steps[x] - steps[y]) <= STEPS) & (np.maximum(steps[x], steps[y]) // STEPS == upper[x])
        met.append((ids[x[ok]], ids[y[ok]]))
    a, b = (np.concatenate(x) for x in zip(*met)) if met else (ids[:0], ids[:0])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(a)))
    at = np.flatnonzero(~small[group])
    low, high = ids[first[group[at]]], ids[(first + sizes - 1)[group[at]]]
    tops = _unique(ids[at][high != ids[at]], high[high != ids[at]])
    return (np.concatenate([a[start], tops[0]]), np.concatenate([b[start], tops[1]]), np.concatenate([times, np.full(len(tops[0]), SHARED)])), _unique(low, ids[at])


def _difference(p: bytes, q: bytes) -> int:
    a, b = np.frombuffer(p, np.uint64)[None], np.frombuffer(q, np.uint64)[None]
    width = min(a.shape[1], b.shape[1])
    return int(np.bitwise_count(fold(a, width) ^ fold(b, width)).sum())


def _sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Staged pairs (a, b) with the named columns of both sets. Few pairs are sent to the
    sets, so that only the sets that they name are shuffled."""
    left = sets.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns]).join(few(pairs), "a")
    right = sets.join(few(pairs.select(F.col("b").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, "b")


def _linking(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The staged pairs (a, b) that link: those that the bitmaps admit, intersected exactly."""

    @F.pandas_udf("boolean")
    def admitted(na, nb, ba, bb):
        import pandas as pd

        return pd.Series([bool(may_link(x, y, _difference(p, q))) for x, y, p, q in zip(na, nb, ba, bb)])

    @F.pandas_udf("boolean")
    def links(p, q):
        import pandas as pd

        def one(x, y):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            return bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))

        return pd.Series([one(x, y) for x, y in zip(p, q)])

    sized = F.least("n_a", "n_b") * OF >= F.greatest("n_a", "n_b") * LINK
    near = stage(_sides(pairs, sets, "n", "bits").where(sized & admitted("n_a", "n_b", "bits_a", "bits_b")).select("a", "b"), "ngram-near")
    return stage(_sides(near, sets, "shingles").where(links("shingles_a", "shingles_b")).select("a", "b"), "ngram-links")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, root) of components after more links; a root is its component's least id."""
    if labels is None:
        return components(links)
    left, right = (labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    short = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    roots = components(short)
    moved = labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return stage(moved.select("node", F.coalesce("to", "root").alias("root")).union(roots), "ngram-labels")


#: A set's side in a group: it meets the other side only, or all.
LOWER, UPPER, BOTH = 0, 1, 2


def _mixed(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, id, side, label, members) of the groups (cid, id, side) with several labels and,
    where sides differ from BOTH, two sides. Equal groups (by number, least, greatest and sum
    of members) are one."""
    named = groups.join(labels, groups["id"] == labels["node"], "left").select("cid", "id", "side", F.coalesce("root", "id").alias("label"))
    named = stage(named, "ngram-named")
    sums = [F.count("*").alias("members"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id", "side")).alias("mark")]
    ends = [f(c).alias(f"{n}_{c}") for c in ("label", "side") for n, f in (("least", F.min), ("most", F.max))]
    several = named.groupBy("cid").agg(*sums, *ends).where((F.col("least_label") != F.col("most_label")) & ((F.col("least_side") == BOTH) | (F.col("least_side") != F.col("most_side"))))
    several = several.groupBy("members", "lo", "hi", "mark").agg(F.min("cid").alias("cid")).select("cid", "members")
    out = stage(named.join(several, "cid"), "ngram-mixed")
    drop_staged(named)
    return out


def _close(n, bits: list, label, side):
    """Pairs (i, j) of rows of one group that have different labels, meet by their sides,
    and may link by their sizes and the bit counts of their bitmaps. One row is compared
    with all others at a time."""
    words = np.array([len(b) // 8 for b in bits])
    tables = {}
    for width in np.unique(words):
        rows = np.flatnonzero(words == width)
        own = np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(-1, width)
        tables[width] = rows, own, fold(own, width // 2) if width > 1 else own
    for i in range(len(n)):
        for width, shift in ((words[i], 1), (2 * words[i], 2)):
            if width not in tables:
                continue
            rows, own = tables[width][0], tables[width][shift]
            ok = (label[rows] != label[i]) & ((side[rows] == BOTH) | (side[rows] != side[i])) & (OF * np.minimum(n[rows], n[i]) >= LINK * np.maximum(n[rows], n[i]))
            if shift == 1:  # each pair of one width once
                ok &= rows > i
            at = np.flatnonzero(ok)
            if len(at):
                differ = np.bitwise_count(own[at] ^ tables[words[i]][1][np.searchsorted(tables[words[i]][0], i)]).sum(axis=1)
                for j in rows[at[may_link(n[rows[at]], n[i], differ)]]:
                    yield i, j


def _small_pairs(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that ``_close`` finds in the groups of SMALL members at most. Such a
    group is compared in one task, and only pairs that the bitmaps admit leave it."""

    def run(batches):
        import pyarrow as pa

        held: list = []

        def close():
            ids, sides, labels, n, bits = zip(*held)
            n, labels, sides = (np.array(x, np.int64) for x in (n, labels, sides))
            return [(max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in _close(n, bits, labels, sides)]

        def rows(found):
            a, b = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        now, found = None, []
        for batch in batches:
            for cid, *row in zip(*(batch.column(c).to_pylist() for c in ("cid", "id", "side", "label", "n", "bits"))):
                if cid != now and held:
                    found += close()
                    held.clear()
                now = cid
                held.append(row)
            if len(found) > 10_000:
                yield rows(found)
                found = []
        if held:
            found += close()
        if found:
            yield rows(found)
        trim()

    small = mixed.where(F.col("members") <= SMALL).select("cid", "id", "side", "label").join(sets.select("id", "n", "bits"), "id")
    return small.repartition("cid").sortWithinPartitions("cid").mapInArrow(run, "a long, b long").distinct()


def _recentred(large: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and smaller groups (cid, id, side) of large groups (cid, id, label, members).

    The centre of a group holds the shingles that more than half of its sets have. With D
    a set's difference to the centre and margin = n - NINTH * |D|, two sets with margins
    that sum to 0 or more link (their difference is at most |Da| + |Db|), and then both
    link with the set of greatest margin: these are the links. Any others that link share
    an element of D, by the prefix argument in the order (lacked by the set, hash): these
    are the groups. Elements that a set lacks, which many of a group may lack, make groups
    only with the sizes of both differences, in which the two sizes meet.
    """
    held = stage(sets.select("id", "n", "shingles").join(few(large), "id").select("cid", "id", "n", "members", "shingles"), "ngram-held")
    centres = stage(_centres(held), "ngram-centres")

    def differ(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch, out = whole.slice(at, 64), []
                for cid, id_, n, s, centre in zip(*(batch.column(c).to_pylist() for c in ("cid", "id", "n", "shingles", "centre"))):
                    s, centre = np.frombuffer(s, "<u8"), np.frombuffer(centre or b"", "<u8")
                    more, less = np.setdiff1d(s, centre, assume_unique=True), np.setdiff1d(centre, s, assume_unique=True)
                    out.append((cid, id_, n, n - NINTH * (len(more) + len(less)), max(1, len(centre) // 8), len(more), np.concatenate([more, less]).astype("<u8").tobytes()))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out), kinds)), names=["cid", "id", "n", "margin", "width", "more", "d"])
        trim()

    deltas = stage(held.join(centres, "cid", "left").select("cid", "id", "n", "shingles", "centre").mapInArrow(differ, "cid long, id long, n int, margin long, width int, more int, d binary"), "ngram-deltas")
    drop_staged(held, centres)
    best = deltas.groupBy("cid").agg(F.max(F.struct("margin", "id")).alias("top")).select("cid", F.col("top.margin").alias("top"), F.col("top.id").alias("to"))
    near = deltas.select("cid", "id", "margin").join(best, "cid").where("margin + top >= 0 and id <> to")
    links = stage(near.select(F.greatest("id", "to").alias("a"), F.least("id", "to").alias("b")).distinct(), "ngram-links")

    def keys(batches):
        import pyarrow as pa

        names = ("cid", "id", "n", "margin", "width", "more", "d", "top")
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                cids, ids, sides = [], [], []
                for cid, id_, n, margin, width, more, d, top in zip(*(whole.slice(at, 64).column(c).to_pylist() for c in names)):
                    d = np.frombuffer(d, "<u8")
                    for low, high, side, start, stop in _bands(n, len(d), more, margin, width, top):
                        seed = (cid * 0x9E3779B97F4A7C15 + low * 0xD6E8FEB86659FD93 + high * 0xBF58476D1CE4E5B9) % (1 << 64)
                        key = (d[start:stop] ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
                        cids.append(((key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
                        ids.append(np.full(stop - start, id_, np.int64))
                        sides.append(np.full(stop - start, side, np.int8))
                if cids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (cids, ids, sides)], names=["cid", "id", "side"])
        trim()

    groups = stage(deltas.join(best, "cid").select("cid", "id", "n", "margin", "width", "more", "d", "top").mapInArrow(keys, "cid long, id long, side byte"), "ngram-keys")
    drop_staged(deltas)
    return links, groups


def _centres(held: DataFrame) -> DataFrame:
    """(cid, centre) of rows (cid, members, shingles): what more than half of a group's sets
    have, sorted. Elements are counted in each task before they are shuffled."""

    def count(batches):
        import pyarrow as pa

        waiting: dict[int, list] = {}
        size = 0

        def counted():
            for cid, own in waiting.items():
                elements, counts = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([cid] * len(elements), pa.int64()), pa.array(elements.view(np.int64)), pa.array(counts, pa.int64())], names=["cid", "element", "k"])

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                for cid, s in zip(batch.column("cid").to_pylist(), batch.column("shingles").to_pylist()):
                    waiting.setdefault(cid, []).append(np.frombuffer(s, "<u8"))
                    size += len(s) // 8
                if size > 1_000_000:
                    yield from counted()
                    waiting.clear()
                    size = 0
        yield from counted()
        trim()

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            for cid, centre in zip(batch.column("cid").to_pylist(), batch.column("centre")):
                yield pa.RecordBatch.from_arrays([pa.array([cid], pa.int64()), pa.array([np.sort(centre.values.to_numpy().view(np.uint64)).astype("<u8").tobytes()], pa.binary())], names=["cid", "centre"])

    counts = held.select("cid", "shingles").mapInArrow(count, "cid long, element long, k long").groupBy("cid", "element").agg(F.sum("k").alias("k"))
    members = held.select("cid", "members").distinct()
    return counts.join(members, "cid").where("2 * k > members").groupBy("cid").agg(F.collect_list("element").alias("centre")).mapInArrow(packed, "cid long, centre binary")


def _bands(n: int, d: int, more: int, margin: int, width: int, top: int):
    """(lower, upper band, side, start, stop) of the elements by which a set of n shingles meets
    partners that no known link joins to it. It differs from the centre in d elements, the
    first ``more`` of which the centre lacks: these are met in one range, whatever the
    partner's band (0, 0); the rest for each band of differences that a partner may be in."""
    far = n * (OF - LINK) // LINK  # the most in which it differs from a partner
    least = max(1, d - far)
    if margin + top >= 0:  # linked with the set of greatest margin: only others matter
        least = max(least, int((n * LINK / OF + top) / NINTH - 1e-9) + 1)
    own, longest = d // width, 0
    for band in range(least // width, (d + far) // width + 1):
        size = max(least, band * width)
        share = max(1, -(-(d + size - far) // 2))
        if share <= min(d, band * width + width - 1):
            length = d - share + 1
            longest = max(longest, length)
            if length > more:
                yield min(own, band) + 1, max(own, band) + 1, (own > band) if own != band else BOTH, more, length
    if min(longest, more):
        yield 0, 0, BOTH, 0, min(longest, more)


def _active_sets(texts: DataFrame, rows: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, n, bits, shingles) of the sets that are in a pair, from the text of one row each."""
    active = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = few(stage(sets.join(active, "id", "left_semi").select("id", F.col("at.doc_id").alias("d"), F.col("at.h").alias("x")), "ngram-wanted"))
    full = _arrays(texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["d"]) & (texts["h"] == wanted["x"])).select("id", "text"))
    if not rows.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        full = full.dropDuplicates(["id"])  # repeated rows: one stands for its set
    return stage(full, "ngram-sets-full")


def join(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, text_hash.

    Words are separated by ASCII white space, A-Z lower-cased. A text with fewer than
    five words is one shingle; a null, empty or blank text has none, links with nothing
    and is its own component. component_id is the smallest non-null doc_id that links
    reach (null if there is none). Repeated rows and doc_ids are each returned.
    """
    return _joined(docs).drop("root")


def _joined(docs: DataFrame) -> DataFrame:
    """Rows of ``join`` with ``root``, which names the component itself whatever its doc_ids
    are (null for rows without words)."""
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("h"))
    counts = frequencies(texts.select("text"))
    ranges = int(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), counts.sum() // 5 // RANGE_KEYS))
    met = _met(texts, ranks(counts), ranges)
    rows = met.where(F.col("kind") == DOCUMENT).select("doc_id", F.col("a").alias("id"), "n", "h")
    at = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h"))
    sets = stage(rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("low"), at.alias("at")), "ngram-sets")
    keyed = met.where(F.col("kind") == MEMBER).select("a", "b")
    stars = met.where(F.col("kind") == STAR).select("a", "b").union(keyed.join(keyed.groupBy("a").agg(F.min("b").alias("low")), "a").select(F.col("low").alias("a"), "b"))
    groups = stage(stars.distinct().select(F.col("a").alias("cid"), F.col("b").alias("id"), F.lit(BOTH).cast("byte").alias("side")), "ngram-groups")
    pairs = met.where(F.col("kind") == PAIR).select("a", "b", "n").union(groups.where("cid <> id").select("cid", "id", F.lit(SHARED)))
    pairs = pairs.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.sum("n").alias("n"))
    pairs = stage(pairs.where(F.col("n") >= SHARED).select("a", "b"), "ngram-pairs")
    full = _active_sets(texts, rows, sets, pairs)
    labels = _merged(None, _linking(pairs, full))
    while True:  # each turn's groups have at most half of the sets of the one before
        release(spark)
        mixed = _mixed(groups, labels)
        drop_staged(groups)
        large = mixed.where(F.col("members") > SMALL)
        links = _linking(stage(_small_pairs(mixed, full), "ngram-pairs"), full)
        last = large.isEmpty()
        if not last:
            near, groups = _recentred(large, full)
            links = links.union(near)
        labels = _merged(labels, links)
        if last:
            break
    drop_staged(full)
    placed = sets.join(labels, sets["id"] == labels["node"], "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    known = placed.select("id", "root").join(lows, "root").select("id", "root", "component_id")
    component = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(known, "id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("h").alias("text_hash"), "root")


def _arrays(wanted: DataFrame) -> DataFrame:
    """(id, n, bits, shingles) of rows (id, text) whose set has that id."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        shingles = shingler()
        for batch in batches:
            out, sets = [], (s for part in text_parts(batch.column("text").to_pylist()) for s in shingles(part))
            for id_, s in zip(batch.column("id").to_pylist(), sets):
                if xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) == id_:
                    out.append((id_, len(s), bitmap(s), s.astype("<u8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))), names=["id", "n", "bits", "shingles"])
        trim()

    return wanted.mapInArrow(run, "id long, n int, bits binary, shingles binary")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs, with its own columns, with one row of each component: that of its smallest
    doc_id (null after all others; of equal ones the smallest text hash, and of wholly
    repeated rows any one). Rows without words stay, all of them."""
    found = stage(join(docs).where("n_shingles > 0").groupBy("doc_id", "component_id", "text_hash").agg(F.count("*").alias("copies")), "ngram-found")
    # A component's rows carry its smallest doc_id; several may where doc_ids repeat.
    heads = found.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias("d")).agg(F.min("text_hash").alias("first"))
    marked = found.join(heads, found["doc_id"].eqNullSafe(heads["d"]), "left")
    stays = F.expr("doc_id <=> component_id and text_hash = first")
    losers = marked.where(~F.coalesce(stays, F.lit(False))).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"))
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    kept = docs.join(losers, docs["doc_id"].eqNullSafe(F.col("__d")) & (text == F.col("__h")), "left_anti")
    again = marked.where(stays & (F.col("copies") > 1)).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"))
    if again.isEmpty():
        return kept
    same = docs["doc_id"].eqNullSafe(F.col("__d")) & (text == F.col("__h"))
    return kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, with its own columns, with one row of each component, told apart by the
    component itself: ``deduplicate`` takes components of one component_id for one. The row
    is that of the smallest doc_id (null after all others; of equal ones the smallest text
    hash, and of wholly repeated rows any one). Rows without words stay, all of them."""
    found = stage(_joined(docs).where("n_shingles > 0").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies")), "ngram-found")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    heads = found.groupBy("root").agg(F.min(order).alias("head"))
    marked = found.join(heads, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")))
    d, h = free_name(docs, "d"), free_name(docs, "h")
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    same = docs["doc_id"].eqNullSafe(F.col(d)) & (text == F.col(h))
    losers, again = (marked.where(x).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)) for x in (~F.col("stays"), F.col("stays") & (F.col("copies") > 1)))
    kept = docs.join(losers, same, "left_anti")
    if again.isEmpty():
        return kept
    return kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
