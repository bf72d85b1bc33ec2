"""Token-id files with directly addressable codes.

An id is split into 8-bit chunks. Level k of a file holds the k-th chunk of every id
that has one, a bitmap with one continuation bit an entry, and a rank directory (ones
before each block of 512 bits), so any token is reached by one rank query a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, small_batches, stage

#: Bits of a rank block, and the ids after which a file is closed (documents stay whole).
RANK_BITS, FILE_IDS = 512, 2_000_000
MAGIC = b"DACT0001"


def encode_ids(ids) -> bytes:
    """Ids (unsigned, below 2**32) to one file: magic, count, levels, then each level as
    entry count, chunks, continuation bits (little-endian), rank directory."""
    import numpy as np

    left, out, levels = np.asarray(ids, np.uint32), [], 0
    while levels == 0 or len(left):
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        rank = np.concatenate([[0], np.cumsum(blocks)]).astype("<u8")
        out += [np.uint64(len(left)).tobytes(), (left & 255).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()]
        left, levels = left[more] >> 8, levels + 1
    return b"".join([MAGIC, np.array([len(ids), levels], "<u8").tobytes(), *out])


class Codes:
    """Reader of one file: ``codes[i]`` is the i-th id, ``codes.all()`` every id."""

    def __init__(self, blob: bytes):
        import numpy as np

        if blob[:8] != MAGIC:
            raise ValueError("not a token-id file")
        self.n, levels = (int(x) for x in np.frombuffer(blob, "<u8", 2, 8))
        self.levels, at = [], 24
        for _ in range(levels):
            n = int(np.frombuffer(blob, "<u8", 1, at)[0])
            sizes = (n, (n + 7) // 8, 8 * (-(-n // RANK_BITS) + 1))
            parts = []
            at += 8
            for size in sizes:
                parts.append(blob[at : at + size])
                at += size
            self.levels.append((np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u8")))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        import numpy as np

        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunk, bits, rank in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            inside = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i, shift = int(rank[block]) + int(inside.sum()), shift + 8
        return value

    def all(self):
        import numpy as np

        out = np.zeros(self.n, np.uint32)
        where = np.arange(self.n)
        for k, (chunk, bits, _) in enumerate(self.levels):
            out[where] |= chunk.astype(np.uint32) << np.uint32(8 * k)
            where = where[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)]
        return out


#: Fixed value: the pattern of a pre-tokenizer that drops white space, so that words can be encoded alone.
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encoder(tokenizer_json: str, limit: int = 1_200_000):
    """A function from UTF-8 texts to their ids, as one array and counts by text.

    Where the tokenizer drops white space between pre-tokens, the library encodes each
    piece between ASCII white space once (plain ASCII pieces by their letter runs,
    digits and other runs, which is how its pattern cuts them) and the ids are looked up
    afterwards; the caches are bounded. Other tokenizers encode whole texts.
    """
    import json
    import os
    import re
    from itertools import chain
    from unicodedata import is_normalized

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer, shape = Tokenizer.from_str(tokenizer_json), json.loads(tokenizer_json)
    cuts = [p.get("pattern", {}).get("Regex") for p in (shape.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    special = [t for t in shape.get("added_tokens", []) if t["special"] and not t["normalized"]]
    lowers = "Lowercase" in [n["type"] for n in (shape.get("normalizer") or {}).get("normalizers", [])]

    def whole(texts: list[bytes]):
        got = [e.ids for e in tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.array([x for g in got for x in g], np.uint32), np.array([len(g) for g in got], np.int64)

    if WORDWISE not in cuts or not special or not lowers:
        return whole

    mark, mark_id = special[0]["content"], special[0]["id"]
    alone = tuple(t["content"].encode() for t in special)
    suffix = shape["model"].get("end_of_word_suffix") or ""
    ends_word = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    for token, i in tokenizer.get_vocab().items():
        ends_word[i] = bool(suffix) and token.endswith(suffix)
    runs = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+").findall
    # Texts of ASCII and Latin letters, which normalisation leaves alone, are cut into pre-tokens at once.
    latin = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
    plainly = re.compile(f"[\t-\r -~{latin}]*").fullmatch
    control = re.compile(rb"[\x1c-\x1f]").search
    pretokens = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{latin}]+|[0-9]|[^\\sa-z0-9{latin}]+").findall

    def cut_text(text: bytes):
        if not any(a in text for a in alone):
            if text.isascii():
                if not control(text):
                    return pretokens(text.decode().lower())
            elif plainly(whole_text := text.decode("utf-8", "replace")):
                return pretokens(whole_text.lower())
        return text.split()
    ended = re.compile(r"([^\W\d_]+)([,.;:!?()]+)").fullmatch

    class Known(dict):
        def __missing__(self, word):
            new.append(word)
            self[word] = n = len(self)
            return n

    known, new, ids_of, odd = Known(), [], {}, set()
    flat, size, start = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut(word: bytes):
        """Single pre-tokens of a word, or the word itself where that is not plain to see."""
        if word.isascii():
            if b"'" not in word and b"<" not in word:
                return runs(word.lower())
        else:
            text = word.decode("utf-8", "replace")
            m = ended(text) or ended(text + ".")
            if m and m[1].isalpha() and m[1].lower().isalpha() and is_normalized("NFC", m[1]):
                return (word,) if m[1] == text else (m[1].encode(), m[2].encode())
        odd.add(word)
        return (word,)

    def as_text(piece) -> str:
        return piece if type(piece) is str else piece.decode("utf-8", "replace")

    def marked(part: list[bytes]):
        ids = tokenizer.encode(mark.join(map(as_text, part)), add_special_tokens=False).ids
        start = 0
        for p, stop in zip(part, [*np.flatnonzero(np.array(ids) == mark_id).tolist(), len(ids)]):
            ids_of[p] = ids[start:stop]
            start = stop + 1

    def joined(pieces: list):
        """(ids, stops) of single pre-tokens in one call of the library; stops is None if
        they can't be told apart. A pre-token's last token alone ends with the word suffix."""
        for e, part in zip(tokenizer.encode_batch_fast([" ".join(map(as_text, p)) for p in pieces], add_special_tokens=False), pieces):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(ends_word[ids]) + 1
            yield part, ids, stops if len(stops) == len(part) else None

    def learn():
        nonlocal flat, size, start
        grown, lengths, places, held = [flat], np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), len(flat)
        texts = [i for i, w in enumerate(new) if type(w) is str]
        at = 0
        for part, ids, stops in joined([[new[i] for i in texts[k : k + 500]] for k in range(0, len(texts), 500)]):
            own = np.array(texts[at : at + len(part)])
            at += len(part)
            if stops is None:
                marked(part)
                found = [ids_of[p] for p in part]
                stops = np.cumsum([len(f) for f in found])
                ids = np.array([x for f in found for x in f], np.uint32)
            lengths[own] = np.diff(stops, prepend=0)
            places[own] = held + stops - lengths[own]
            grown.append(ids)
            held += len(ids)
        words = [i for i, w in enumerate(new) if type(w) is not str]
        cuts = [cut(new[i]) for i in words]
        missing = list({p: None for p in chain.from_iterable(cuts) if p not in ids_of})
        single = [p for p in missing if p not in odd]
        for part, ids, stops in joined([single[k : k + 500] for k in range(0, len(single), 500)]):
            if stops is None:
                marked(part)
            else:
                ids_of.update(zip(part, (x.tolist() for x in np.split(ids, stops[:-1]))))
        rest = [p for p in missing if p in odd]
        plain = [p for p in rest if not any(a in p for a in alone)]
        for k in range(0, len(plain), 500):
            marked(plain[k : k + 500])
        for p in rest:
            if p not in ids_of:
                ids_of[p] = tokenizer.encode(as_text(p), add_special_tokens=False).ids
        for i, parts in zip(words, cuts):
            ids = [x for p in parts for x in ids_of[p]]
            lengths[i], places[i] = len(ids), held
            grown.append(np.array(ids, np.uint32))
            held += len(ids)
        flat, size, start = np.concatenate(grown), np.concatenate([size, lengths]), np.concatenate([start, places])
        new.clear()
        odd.clear()
        ids_of.clear()

    def ids(texts: list[bytes]):
        nonlocal flat, size, start
        if len(known) > limit:
            known.clear()
            flat, size, start = flat[:0], size[:0], start[:0]
        words = [cut_text(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        rows = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, counts.sum())
        if new:
            learn()
        n = size[rows]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        sums, edges = np.concatenate([[0], ends]), np.cumsum(counts)
        return flat[np.repeat(start[rows] - ends + n, n) + np.arange(total)], sums[edges] - sums[edges - counts]

    return ids


def worker_encoder(tokenizer_json: str):
    """The worker process's encoder, kept from task to task with its bounded cache."""
    import sys
    import types

    held = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker"))
    if getattr(held, "source", None) != tokenizer_json:
        held.source, held.encode = tokenizer_json, encoder(tokenizer_json)
    return held.encode


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """(doc_id, n_tokens, width, ids, crc): ids little-endian in ``width`` bytes each."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file of fixed size

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = worker_encoder(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, rows = whole.slice(at, 512), []
                every, counts = encode(batch.column("text").to_pylist())
                stops = np.cumsum(counts)
                every = np.insert(every, stops, np.uint32(end_id)).astype("<u4")
                for stop, count, i in zip(stops, counts, range(len(counts))):
                    ids = every[stop - count + i : stop + i + 1]
                    small = ids.max() < 65536
                    rows.append((len(ids), 2 if small else 4, (ids.astype("<u2") if small else ids).tobytes(), zlib.crc32(ids.tobytes())))
                n, width, data, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(width, pa.int32()), pa.array(data, pa.binary()), pa.array(crc, pa.int64())], names=["doc_id", "n_tokens", "width", "ids", "crc"])

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text")).mapInArrow(run, "doc_id long, n_tokens long, width int, ids binary, crc long")


def write_files(tokens: DataFrame, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write files in ascending doc_id order (null first, ties by content): rows of
    (part, seq, n_ids, doc_ids, counts, blob), a file a row, in a table at ``path``. The
    table's ``codec`` is one of Parquet's: with ``uncompressed`` a file's codes are read
    where they lie, without decoding anything, and take a fifth more disk."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["part", "seq", "n_ids", "doc_ids", "counts", "blob"]
        held, docs, part, seq = [], [], 0, 0

        def file():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(h) for h in held]], pa.list_(pa.int64())), pa.array([encode_ids(ids)], pa.binary())], names=names)

        total = 0
        for batch in batches:
            for doc_id, width, data, p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "width", "ids", "part"))):
                part = p
                held.append(np.frombuffer(data, f"<u{width}"))
                docs.append(doc_id)
                total += len(held[-1])
                if total >= FILE_IDS:
                    yield file()
                    held, docs, total, seq = [], [], 0, seq + 1
        if held:
            yield file()

    ids = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    ranged = tokens.repartitionByRange(max(1, -(-ids // FILE_IDS)), "doc_id", "n_tokens", "crc").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "n_tokens", "crc")
    files = ranged.select("doc_id", "width", "ids", "part").mapInArrow(run, "part int, seq int, n_ids long, doc_ids array<long>, counts array<long>, blob binary")
    return stage(files, "token-files", path, codec)


def read_files(files: DataFrame) -> DataFrame:
    """Per document from the files alone: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, seq, doc_ids, counts, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_ids", "counts", "blob"))):
                ids = Codes(blob).all().astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, counts)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    # One narrow row a file; sums run over files, never over documents.
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    manifest = files.select("part", "seq", "n_ids").select("part", "seq", F.coalesce(before, F.lit(0)).alias("before"))
    found = files.mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(manifest, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, tokenizer_path: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Tokenise docs(doc_id, text), write files, read them back.

    A null or empty text has the end id alone; equal doc_ids lie side by side, ordered
    by content, repeated rows each with their own place; an empty table writes no file.
    """
    tokens = stage(tokenize(docs, tokenizer_path), "token-ids", codec="zstd")
    files = write_files(tokens, path, codec)
    drop_staged(tokens)
    return read_files(files)


def token_at(spark: SparkSession, path: str, i: int) -> int:
    """The i-th token of the corpus from the files at ``path``: the file's place from the
    files' counts, then one rank query a level, without decoding the rest."""
    files = spark.read.parquet(path)
    before = F.sum("n_ids").over(Window.orderBy("part", "seq"))  # one narrow row a file
    at = files.select("part", "seq", "n_ids").select("part", "seq", "n_ids", before.alias("upto")).where(F.col("upto") > i).orderBy("upto").first()
    if i < 0 or at is None:
        raise IndexError(i)
    row = files.where((F.col("part") == at["part"]) & (F.col("seq") == at["seq"])).select("blob").first()
    return Codes(bytes(row["blob"]))[i - at["upto"] + at["n_ids"]]
