"""Scoring by a log-bilinear language model trained with noise-contrastive estimation.

The model predicts a token's entry from the two before it. Entries are the end of a text,
the most frequent words, each its own, and hashed slots for all other words; both grow
with the square root of the corpus's tokens. The first K - 1 entries are classes of their
own, the rest form groups: a class is predicted first, then the entry inside its group.
As contexts, too, entries of groups have their own vectors beside their group's. Inside
a slot a word has its smoothed share of the slot's counts, so token probabilities are
normalised over the whole vocabulary. Parts of the training documents train copies of
their own in one pass; copies are averaged by their tokens (a grouped entry's vectors by
how often the copy met it), so all data take part. This is done in turns over a third of
the texts each, every turn from the average of the one before, and no copy trains on few
tokens, so that the result hardly depends on how the corpus is partitioned.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage
from .langid import remainder

#: Classes, dimensions, noise words a batch, tokens a batch, learning rate, and the most words that are looked up in memory.
K, DIM, NOISE, BATCH, RATE, HEAD = 64, 12, 32, 8192, 0.2, 150_000
#: Steps that a copy makes in a turn at least, if batches of LEAST tokens allow.
STEPS, LEAST = 128, 128
#: Noise entries a token inside its group, entries a packed row of a copy, and what a grouped entry's sums of squares start with.
INNER_NOISE, CHUNK, START = 2, 1024, 1e-7
#: Tokens that a copy trains on at least, and turns in which copies start from their common average.
COPY_TOKENS, TURNS = 200_000, 3
#: The end of a text as a word: white space, so that no word equals it; its entry.
END, STOP = b"\n", 0


class Entries:
    """Entry of a word: its own, or the slot that its CRC-32 gives. ``named`` numbers words
    from 1 in their order, ``slots`` is a power of two."""

    def __init__(self, named: dict, slots: int):
        self.named, self.first, self.mask = _array(named), len(named) + 1, slots - 1

    def of(self, words):
        """Entries of an Arrow array of words."""
        own = _places(words, self.named)
        out, rest = (own + 1).astype(np.int32), np.flatnonzero(own < 0)
        out[rest] = self.first + (_crc32(words)[rest] & np.uint32(self.mask)).astype(np.int32)
        return out


def _array(words):
    """Words as an Arrow array."""
    import pyarrow as pa

    return pa.array(list(words), pa.binary())


def _places(words, known):
    """Place of each word of an Arrow array in one of distinct words, -1 without one."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(words, value_set=known.cast(words.type)), -1).to_numpy()


#: Words of more bytes than this are hashed one by one.
LONG = 64
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def _crc32(words):
    """CRC-32 of each word of an Arrow array: of all words by their first byte, then the
    second, and so on, the longest words first."""
    import pyarrow as pa

    _, places, raw = words.buffers()
    ends = np.frombuffer(places, np.int64 if pa.types.is_large_binary(words.type) else np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw, sizes = np.frombuffer(raw or b"", np.uint8), np.diff(ends)
    order = np.argsort(LONG - np.minimum(sizes, LONG), kind="stable")
    at, short = ends[:-1][order].astype(np.int64), np.minimum(sizes, LONG)
    many = len(words) - np.cumsum(np.bincount(short, minlength=LONG + 1))[:LONG]  # words of more bytes than 0, 1, ...
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for i, n in enumerate(many):
        if not n:
            break
        now = crc[:n]
        crc[:n] = _CRC[(now ^ raw[at[:n] + i]) & np.uint32(255)] ^ now >> np.uint32(8)
    out = np.empty(len(words), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(sizes > LONG):
        out[i] = zlib.crc32(words[int(i)].as_buffer())
    return out


class LogBilinear:
    """Score of class w after (a, b): (first[a] + second[b]) . out[w] + bias[w], the sum in
    brackets being that of the classes and of the grouped entries' own vectors; score of an
    entry inside its group: the same sum . inner[w] + inner_bias[w]. The first ``alone``
    entries are classes, the rest lie in groups of equal size (without it, all are classes)."""

    rate = RATE
    NAMES = ("first", "second", "out", "bias")
    OWN = ("own_first", "own_second", "inner", "inner_bias")

    def __init__(self, unigram, alone: int | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        unigram = np.asarray(unigram, np.float64)
        self.alone = len(unigram) if alone is None else min(alone, len(unigram))
        rest = unigram[self.alone :]
        self.size = max(1, math.isqrt(max(len(rest) - 1, 0)) + 1)
        starts = np.arange(0, len(rest), self.size)
        self.unigram = np.concatenate([unigram[: self.alone], np.add.reduceat(rest, starts)]) if len(rest) else unigram
        k = len(self.unigram)
        for name in self.NAMES[:3]:
            setattr(self, name, rng.normal(0, 0.1, (k, DIM)).astype(np.float32))
        self.bias = np.log(self.unigram).astype(np.float32)
        for name in self.OWN[:3]:
            setattr(self, name, np.zeros((len(rest), DIM), np.float32))
        self.share = (rest / self.unigram[self.alone + np.arange(len(rest)) // self.size]).astype(np.float32) if len(rest) else np.zeros(0, np.float32)
        self.inner_bias = np.log(self.share)

    def pack(self, names=NAMES, rows=slice(None)):
        return np.concatenate([getattr(self, n)[rows].ravel() for n in names])

    def unpack(self, flat, names=NAMES, rows=slice(None)):
        at = 0
        for n in names:
            old = getattr(self, n)[rows]
            getattr(self, n)[rows] = np.asarray(flat[at : at + old.size], np.float32).reshape(old.shape)
            at += old.size
        return self

    def classes(self, w):
        """Class of each entry."""
        return np.where(w < self.alone, w, self.alone + (w - self.alone) // self.size)

    def context(self, a, b):
        """Vectors of the entries before a token."""
        r = self.first.take(self.classes(a), axis=0)  # rows are copied faster by take than by an index
        r += self.second.take(self.classes(b), axis=0)
        for table, x in ((self.own_first, a), (self.own_second, b)):
            grouped = np.flatnonzero(x >= self.alone)
            r[grouped] = r.take(grouped, axis=0) + table.take(x.take(grouped) - self.alone, axis=0)
        return r

    def train(self, a, b, w, rng):
        """One step of noise-contrastive estimation on a batch: tell each class from NOISE
        classes drawn from the unigram distribution, and each grouped entry from INNER_NOISE
        entries of its group; Adagrad."""
        k = len(self.unigram)
        if not hasattr(self, "sums"):
            self.sums = {n: np.full(getattr(self, n).shape, 1e-3, np.float32) for n in self.NAMES}
            self.sums |= {n: np.full(getattr(self, n).shape, START, np.float32) for n in self.OWN}
            self.shift = (np.log(self.unigram) + np.log(NOISE)).astype(np.float32)
            self.inner_shift = self.inner_bias + np.float32(np.log(INNER_NOISE))
            self.cumulative = np.cumsum(self.unigram)
            self.inner_cumulative = np.concatenate([[0], np.cumsum(self.share, dtype=np.float64)])
            self.met = np.zeros(len(self.share), np.float32)
        noise = np.minimum(np.searchsorted(self.cumulative, rng.random(NOISE) * self.cumulative[-1]), k - 1)
        r, c = self.context(a, b), self.classes(w)
        out = self.out.take(c, axis=0)
        real = np.einsum("ij,ij->i", r, out) + self.bias.take(c) - self.shift.take(c)
        fake = r @ self.out[noise].T + self.bias[noise] - self.shift[noise]
        g, h = _sigmoid(real) - 1, _sigmoid(fake)
        out *= g[:, None]
        dr = out + h @ self.out[noise]
        grouped = np.flatnonzero(w >= self.alone)
        if len(grouped):
            dr[grouped] = dr.take(grouped, axis=0) + self._train_inner(r.take(grouped, axis=0), w.take(grouped) - self.alone, len(w), rng)
        grads = {"first": _rows(self.classes(a), dr, k), "second": _rows(self.classes(b), dr, k), "out": _rows(c, g[:, None] * r, k), "bias": np.bincount(c, g, k)}
        np.add.at(grads["out"], noise, h.T @ r)
        np.add.at(grads["bias"], noise, h.sum(axis=0))
        for n, grad in grads.items():
            grad = (grad / len(w)).astype(np.float32)
            self.sums[n] += grad * grad
            setattr(self, n, getattr(self, n) - self.rate * grad / np.sqrt(self.sums[n]))
        for n, x in (("own_first", a), ("own_second", b)):
            own = np.flatnonzero(x >= self.alone)
            self._step(x.take(own) - self.alone, {n: dr.take(own, axis=0) / len(w)})

    def _train_inner(self, r, w, n: int, rng):
        """The step inside the groups for entries w after r; the gradient of r."""
        low = w // self.size * self.size
        edges = self.inner_cumulative.take(low), self.inner_cumulative.take(np.minimum(low + self.size, len(self.share)))
        draws = edges[0][:, None] + rng.random((len(w), INNER_NOISE)) * (edges[1] - edges[0])[:, None]
        last = np.minimum(low + self.size, len(self.share)) - 1
        noise = np.clip(np.searchsorted(self.inner_cumulative, draws, "right") - 1, low[:, None], last[:, None])
        x = np.concatenate([w[:, None], noise], axis=1)
        v = self.inner.take(x, axis=0)
        s = _sigmoid(np.einsum("ij,ikj->ik", r, v) + self.inner_bias.take(x) - self.inner_shift.take(x))
        s[:, 0] -= 1
        self.met += np.bincount(w, minlength=len(self.met)).astype(np.float32)
        dr = np.einsum("ik,ikj->ij", s, v)
        s /= n
        self._step(x.ravel(), {"inner": (s[:, :, None] * r[:, None, :]).reshape(-1, DIM), "inner_bias": s.reshape(-1, 1)})
        return dr

    def _step(self, index, values: dict):
        """Adagrad on the tables' rows that occur."""
        if not len(index):
            return
        short = index.astype(np.uint16) if len(self.share) <= 1 << 16 else index  # sorted by radix
        order = np.argsort(short, kind="stable")
        index = index[order]
        starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        rows = index[starts]
        for name, own in values.items():
            grad = np.add.reduceat(own.take(order, axis=0), starts, axis=0).astype(np.float32)
            table, sums = (t.reshape(len(t), -1) for t in (getattr(self, name), self.sums[name]))
            now = sums.take(rows, axis=0) + grad * grad
            sums[rows] = now
            table[rows] = table.take(rows, axis=0) - self.rate * grad / np.sqrt(now)

    def log10(self, a, b, w, block: int = 512):
        """log10 of the entries' probabilities; a context's normaliser is computed once a call."""
        e = self.alone + len(self.share)
        pairs, at = np.unique(a.astype(np.int64) * e + b, return_inverse=True)
        r, c = _with(self.context(pairs // e, pairs % e), 1), self.classes(w)
        out, z = _with(self.out, self.bias), np.empty(len(pairs), np.float32)
        for i in range(0, len(pairs), block):
            z[i : i + block] = _normaliser(out @ r[i : i + block].T)
        s = np.einsum("ij,ij->i", r.take(at, axis=0), out.take(c, axis=0)) - z.take(at)
        grouped = np.flatnonzero(c >= self.alone)
        grouped = grouped[np.argsort(c[grouped].astype(np.uint16) if len(self.out) <= 1 << 16 else c[grouped], kind="stable")]
        inner, r, own, group = _with(self.inner, self.inner_bias), r.take(at.take(grouped), axis=0), w.take(grouped) - self.alone, c.take(grouped) - self.alone
        inside = np.empty(len(grouped), np.float32)
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(group) else ()
        for start, stop in zip(edges[:-1], edges[1:]):
            low = group[start] * self.size
            for i in range(start, stop, block):
                part = slice(i, min(i + block, stop))
                t = inner[low : low + self.size] @ r[part].T
                inside[part] = t[own[part] - low, np.arange(t.shape[1])]
                inside[part] -= _normaliser(t)
        s[grouped] += inside
        return s.astype(np.float64) / np.log(10)


def _with(rows, last):
    """Rows with one more number, so that a product adds a bias."""
    return np.concatenate([rows, np.broadcast_to(np.asarray(last, np.float32), len(rows))[:, None]], axis=1)


def _normaliser(s):
    """Logarithms of the sums of the columns' exponentials; overwrites its argument."""
    top = s.max(axis=0)
    s -= top
    return top + np.log(np.exp(s, out=s).sum(axis=0))


def _sigmoid(x):
    """Overwrites its argument."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _rows(index, values, k: int):
    """Sums of the values' rows by index."""
    return np.stack([np.bincount(index, v, k) for v in values.T], axis=1)


def _words(column):
    """Of a binary Arrow column: its distinct words (an Arrow array, A-Z lower-cased), the
    place there of each word in turn, and how many words each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = pa.large_string() if pa.types.is_large_binary(column.type) else pa.string()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.view(kind)))
    words = lists.flatten()
    real = pc.not_equal(pc.binary_length(words), 0)  # white space at a text's ends leaves empty pieces
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()]
    coded = words.filter(real).dictionary_encode()
    return coded.dictionary.view(column.type), coded.indices.to_numpy(), np.diff(upto)


def _sequences(words, counts):
    """Entries (a, b, w) of all tokens from the entries of all words and the words a text,
    and where each text ends."""
    ends = np.cumsum(counts + 1)
    w, inside = np.full(ends[-1], STOP, np.int32), np.ones(ends[-1], bool)
    inside[ends - 1] = False
    w[inside] = words
    stop = np.full(1, STOP, np.int32)
    b = np.concatenate([stop, w[:-1]])
    a = np.concatenate([stop, b[:-1]])
    start = ends[:-1]
    b[start] = STOP
    a[start] = STOP
    second = start + 1
    a[second[second < len(a)]] = STOP
    return a, b, w, ends


def _joined(batches, rows: int = 2000, most: int = 8 << 20):
    """Arrow batches joined to so many rows or bytes: contexts recur in larger batches."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all tokens of docs(text), ends included; partly summed before the shuffle."""

    def run(batches):
        import pyarrow as pa

        held, n, ends = [], 0, 0
        for batch in _joined(batches):
            if not batch.num_rows:
                continue
            words, at, texts = _words(batch.column("text"))
            held.append(pa.table([words.cast(pa.binary()), pa.array(np.bincount(at, minlength=len(words)), pa.int64())], names=["word", "c"]))
            n, ends = n + len(words), ends + len(texts)
            if n > 800_000:
                held = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])]
                n = held[0].num_rows
                if n > 400_000:
                    yield from held.pop().to_batches()
                    n = 0
        if ends:
            held.append(pa.table([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"]))
            yield from pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"]).to_batches()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What scoring keeps in memory: sizes, the most frequent words, and the entries;
    bounded by HEAD and the square root of the tokens."""

    def __init__(self, counts: DataFrame):
        band = F.floor(F.log2("c") * 8).cast("int")
        rows = counts.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("band")).collect()  # a few hundred
        self.n, self.v = sum(r["c"] for r in rows), sum(r["n"] for r in rows)
        entries = max(510, math.isqrt(self.n) // 4)
        self.slots = 1 << (entries - 1).bit_length()
        low, own = self._lowest(rows, max(HEAD, entries)), self._lowest(rows, entries)
        head = counts.where(band >= low).toPandas() if rows else None
        self.head = dict(zip(map(bytes, head["word"]), head["c"].tolist())) if rows else {}
        bands = counts.where((band >= own) & (F.col("word") != F.lit(END))).toPandas() if rows else None
        named = sorted(zip(bands["c"].tolist(), map(bytes, bands["word"])), key=lambda x: (-x[0], x[1])) if rows else []
        self.named = {w: i + 1 for i, (_, w) in enumerate(named)}
        # All words without an entry of their own, counted by slot.
        c, v = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int64)
        slot = F.crc32("word").bitwiseAND(F.lit(self.slots - 1))
        for r in counts.where((band < own) & (F.col("word") != F.lit(END))).groupBy(slot.alias("slot")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
            c[r["slot"]], v[r["slot"]] = r["c"], r["v"]
        mass = np.concatenate([[self.head.get(END, 0)], [c for c, _ in named], c]) + 0.5
        self.unigram = mass / mass.sum()
        #: log10 of what a slot's words share, one word that no training row has included; 0 for words of their own entry.
        self.shared = np.concatenate([np.zeros(len(named) + 1), np.log10(c + 0.1 * (v + 1))])

    @staticmethod
    def _lowest(rows, most: int) -> int:
        """The lowest band such that it and all above have ``most`` words at most."""
        low, held = 1 << 30, 0
        for r in rows:
            held += r["n"]
            if held > most:
                break
            low = r["band"]
        return low


def fit(docs: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    """The model after TURNS averages of the copies that parts of docs(text) train. Copies
    are at most as many as the square root of the tokens allows, so that their size stays in
    proportion to the corpus; with few tokens there is one copy and one turn."""
    copies = max(1, min(vocabulary.n // COPY_TOKENS, max(32, math.isqrt(vocabulary.n) // 140)))
    model, turns = LogBilinear(vocabulary.unigram, K - 1), TURNS if copies > 1 else 1
    batch = max(LEAST, min(BATCH, vocabulary.n // (copies * turns * STEPS)))
    for turn in range(turns):
        own = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(turns)) == turn)
        _averaged(own.coalesce(copies), vocabulary, model, RATE / (1 + turn), batch)
    return model


def _averaged(docs: DataFrame, vocabulary: Vocabulary, model: LogBilinear, rate: float, size: int) -> None:
    """Set the model to the average of copies of it, one trained on each partition."""
    held = docs.sparkSession.sparkContext.broadcast((vocabulary.named, vocabulary.slots, vocabulary.unigram, model.pack(), model.pack(model.OWN)))  # bounded by the square root of the tokens
    kinds = "chunk int, copy int, weights binary, model binary"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        named, slots, unigram, flat, own = held.value
        entries, model, rng, kept, n = Entries(named, slots), LogBilinear(unigram, K - 1).unpack(flat), np.random.default_rng(3), [], 0
        model.unpack(own, model.OWN)
        model.rate = rate
        for batch in _joined(batches):
            if batch.num_rows:
                words, at, counts = _words(batch.column("text"))
                kept.append(_sequences(entries.of(words)[at], counts)[:3])
            if sum(len(k[2]) for k in kept) >= 8 * size:
                n += _train(model, kept, rng, size)
                kept = []
        if kept:
            n += _train(model, kept, rng, size)

        def row(chunk, weights, flat):
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([flat.astype("<f4").tobytes()], pa.binary())], names=["chunk", "copy", "weights", "model"])

        if n:
            yield row(-1, np.array([n]), model.pack())
            for chunk, at in enumerate(range(0, len(model.share), CHUNK)):
                rows = slice(at, at + CHUNK)
                yield row(chunk, model.met[rows] + 1e-3, model.pack(model.OWN, rows))

    def average(key, pdf):
        import pandas as pd

        total, mean = 0, 0
        for _, weights, flat in sorted(zip(pdf["copy"], pdf["weights"], pdf["model"])):
            weights, flat = np.frombuffer(weights, "<f4").astype(np.float64), np.frombuffer(flat, "<f4")
            # Tables of rows of DIM numbers, the biases last.
            spread = np.concatenate([np.tile(np.repeat(weights, DIM), 3), weights]) if key[0] >= 0 else weights
            total, mean = total + spread, mean + spread * flat
        return pd.DataFrame({"chunk": [key[0]], "model": [(mean / total).astype("<f4").tobytes()]})

    for r in docs.mapInArrow(run, kinds).groupBy("chunk").applyInPandas(average, "chunk int, model binary").collect():  # one model
        flat, at = np.frombuffer(r["model"], "<f4"), r["chunk"] * CHUNK
        model.unpack(flat) if r["chunk"] < 0 else model.unpack(flat, model.OWN, slice(at, at + CHUNK))
    held.unpersist()


def _train(model: LogBilinear, kept: list, rng, size: int) -> int:
    a, b, w = (np.concatenate(x) for x in zip(*kept))
    order = rng.permutation(len(w))
    for at in range(0, len(w), size):
        i = order[at : at + size]
        model.train(a.take(i), b.take(i), w.take(i), rng)
    return len(w)


def score(docs: DataFrame, mod: int = 10) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities of the whole text).

    Training rows are those whose crc32(doc_id) mod ``mod`` is not 0. Null and empty
    texts are the end token alone. Repeated rows are each returned (and counted). With
    no training row every count is 0 and both scores are those of the smoothing alone.
    Words beyond the HEAD most frequent ones get their counts by a join, never by a
    broadcast; only their log sums meet again by row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), (remainder(mod) == 0).alias("held_out"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = stage(word_counts(train), "lm-counts")
    vocabulary = Vocabulary(counts)
    model = fit(train, vocabulary)
    # Bounded by HEAD and the square root of the tokens, and plain values: workers need not have this package.
    held = spark.sparkContext.broadcast((vocabulary.head, vocabulary.named, vocabulary.slots, vocabulary.unigram, vocabulary.shared, model.pack(), model.pack(model.OWN)))

    def run(batches):
        import pyarrow as pa

        head, named, slots, unigram, shared, flat, own = held.value
        entries, m = Entries(named, slots), LogBilinear(unigram, K - 1).unpack(flat)
        m.unpack(own, m.OWN)
        stop_log = float(np.log10(head.get(END, 0) + 0.1))
        known, held_counts = _array(head), np.array([*head.values(), -1], np.int64)  # the last for words without a place
        for whole in _joined(batches):
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                distinct, at, counts = _words(batch.column("text"))
                entry = entries.of(distinct)
                a, b, w, ends = _sequences(entry[at], counts)
                model = np.add.reduceat(m.log10(a, b, w) - shared[w], ends - counts - 1)
                c = held_counts[_places(distinct, known)]
                row, found, log = np.repeat(np.arange(len(counts)), counts), c >= 0, np.log10(np.maximum(c, 0) + 0.1)

                def total(values):
                    return np.bincount(row, values[at], len(counts))

                # Words without a count here: (row, word) once, with how often.
                rare = np.flatnonzero(~found[at])
                tail, times = np.unique(row[rare] * np.int64(len(distinct)) + at[rare], return_counts=True)
                edges = pa.array(np.searchsorted(tail, np.arange(len(counts) + 1) * np.int64(len(distinct))), pa.int32())
                tail = distinct.take(pa.array(tail % max(len(distinct), 1)))
                columns = [counts + 1, total(found).astype(np.int64) + int(END in head), total(found * log) + stop_log, model, total(found * (entry >= entries.first) * log)]
                lists = [pa.ListArray.from_arrays(edges, x) for x in (tail, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns), *lists], names=["doc_id", "held_out", "n_tokens", "known", "base", "model", "other", "tail", "times"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, other double, tail array<binary>, times array<int>")
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = found.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    # Words of the training rows all have a count; those of held-out rows alone have none.
    sums = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"))
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    all_mass = float(np.log10(vocabulary.n + 0.1 * (vocabulary.v + 1)))
    return found.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * all_mass).alias("base_score"), (F.col("model") + F.col("other") + logs).alias("score"),
    )
