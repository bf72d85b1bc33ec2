"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It labels every byte
position; a document's probabilities are the mean over its positions. Texts are read
whole, in windows of WINDOW bytes that the network enters afresh.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, trim

#: Bytes of a window, hidden units a direction, training windows a step and steps.
WINDOW, HIDDEN, BATCH, STEPS, RATE = 64, 12, 192, 220, 0.012
#: The fit's documented bound: labelled documents of each language, and slices of each document.
FIT_DOCS, FIT_SLICES, FIT_BYTES = 600, 3, 160
LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Gates r, z and candidate n; the embedding is folded into a byte table a direction."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
            self.p["o" + d] = rng.normal(0, 0.3, (len(labels), hidden)).astype(np.float32)
        self.p["bias"] = np.zeros((len(labels), 1), np.float32)

    def _run(self, windows, d: str, keep: list | None = None):
        """Hidden states (time, hidden, batch) of one direction; keep gathers what training needs."""
        k, u, x = self.hidden, self.p["u" + d], self.p["x" + d]
        t = windows.shape[1]
        states = np.empty((t, k, len(windows)), np.float32)
        h = np.zeros((k, len(windows)), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a, e = u @ h, np.ascontiguousarray(x[windows[:, i]].T)
            g = _sigmoid(a[: 2 * k] + e[: 2 * k])
            n = np.tanh(e[2 * k :] + g[:k] * a[2 * k :])
            if keep is not None:
                keep.append((i, h, g, n, a[2 * k :]))
            h = n + g[k:] * (h - n)
            states[i] = h
        return states

    def positions(self, windows):
        """Probabilities (time, label, batch) at every position."""
        f, b = self._run(windows, "f"), self._run(windows, "b")
        s = np.matmul(self.p["of"], f) + np.matmul(self.p["ob"], b) + self.p["bias"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    def gradients(self, windows, labels):
        """Gradients of the mean cross-entropy over positions, by backpropagation through time."""
        k, p, grad, kept, states = self.hidden, self.p, {}, {"f": [], "b": []}, {}
        for d in "fb":
            states[d] = self._run(windows, d, kept[d])
        s = np.matmul(p["of"], states["f"]) + np.matmul(p["ob"], states["b"]) + p["bias"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        loss = -np.log(s[:, labels, np.arange(len(labels))] + 1e-9).mean()
        s[:, labels, np.arange(len(labels))] -= 1
        s /= s.shape[0] * s.shape[2]
        grad["bias"] = s.sum(axis=(0, 2))[:, None]
        for d in "fb":
            grad["o" + d] = np.einsum("tlb,thb->lh", s, states[d], optimize=True)
            outer = np.matmul(p["o" + d].T, s)
            du, dx = np.zeros_like(p["u" + d]), np.empty((windows.shape[1], 3 * k, len(windows)), np.float32)
            dh = np.zeros((k, len(windows)), np.float32)
            for i, before, g, n, a in reversed(kept[d]):
                dh = dh + outer[i]
                r, z = g[:k], g[k:]
                dn = dh * (1 - z) * (1 - n * n)
                dr, dz = dn * a * r * (1 - r), dh * (before - n) * z * (1 - z)
                da = np.concatenate([dr, dz, dn * r])
                du += da @ before.T
                dx[i] = np.concatenate([dr, dz, dn])
                dh = dh * z + p["u" + d].T @ da
            grad["u" + d] = du
            at = windows.T.reshape(-1)
            flat = dx.transpose(1, 0, 2).reshape(3 * k, -1)
            grad["x" + d] = np.stack([np.bincount(at, row, 256) for row in flat], axis=1)
        return loss, grad

    def fit(self, windows, labels, steps: int = STEPS, seed: int = 11):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        groups = [np.flatnonzero(labels == c) for c in range(len(self.labels))]
        groups = [g for g in groups if len(g)]
        for step in range(1, steps + 1):
            at = np.concatenate([rng.choice(g, BATCH // len(groups) + 1) for g in groups])
            _, grad = self.gradients(windows[at], labels[at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - 0.9 * step / steps)
            for k in self.p:
                g = (grad[k] * min(1, 1 / (norm + 1e-9))).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[bytes], block: int = 2048):
        """(probabilities, positions by label) of each text, a row each; every position counts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        data = np.frombuffer(b"".join(t + b" " * (-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
        valid = np.full(len(data), WINDOW)
        last = np.cumsum(windows) - 1
        valid[last[sizes > 0]] = ((sizes - 1) % WINDOW + 1)[sizes > 0]
        total = np.zeros((len(texts), len(self.labels)))
        marks = np.zeros((len(texts), len(self.labels)), np.int64)
        for at in range(0, len(data), block):
            p = self.positions(data[at : at + block])
            inside = np.arange(WINDOW)[:, None] < valid[at : at + block]
            label = p.argmax(axis=1)
            p *= inside[:, None]
            pooled, own = p.sum(axis=0), owner[at : at + block]
            for c in range(len(self.labels)):
                total[:, c] += np.bincount(own, pooled[c], len(texts))
                marks[:, c] += np.bincount(own, ((label == c) & inside).sum(axis=0), len(texts)).astype(np.int64)
        return total / np.maximum(sizes, 1)[:, None], marks


def remainder(n: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def fit(docs: DataFrame) -> BiGRU | None:
    """Train on docs(doc_id, text, lang) whose crc32(doc_id) mod 5 is not 0.

    Bounded: of each language the FIT_DOCS different documents with the lowest digests of
    doc_id and text, and of each FIT_SLICES slices of FIT_BYTES characters. Digest
    thresholds from the number of different texts by language leave about twice as many
    to pick from, at any size; repeated rows are one, so none of these can be many.
    """
    usable = docs.where((remainder(5) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    text = F.xxhash64("text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct(F.struct("doc_id", text), 0.03).alias("n")).orderBy("lang").collect()}  # a row a language
    if not counts:
        return None
    digest = F.conv(F.substring(F.md5(F.concat(F.lit("fit:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    odds = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, (2 * FIT_DOCS + 50) / max(n, 1))))])
    length = F.length("text")
    slices = F.array(*[F.substring("text", (1 + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.lit(1), length - FIT_BYTES))).cast("int"), F.lit(FIT_BYTES)) for i in range(FIT_SLICES)])
    picked = usable.select("lang", "doc_id", "text", digest.alias("u")).where(F.col("u") < F.element_at(odds, F.col("lang"))).select("lang", "u", slices.alias("slices"))
    rows = sorted(picked.dropDuplicates(["lang", "u"]).collect(), key=lambda r: (r["lang"], r["u"]))  # about 2 * FIT_DOCS a language
    labels, seen, windows, marks = sorted({r["lang"] for r in rows}), {}, [], []
    if not labels:
        return None
    for r in rows:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] > FIT_DOCS:
            continue
        for piece in r["slices"]:
            raw = piece.encode("utf-8", "replace")
            for at in range(0, max(1, len(raw) - WINDOW + 1), WINDOW):
                windows.append(raw[at : at + WINDOW].ljust(WINDOW))
                marks.append(labels.index(r["lang"]))
    return BiGRU(labels).fit(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array(marks))


def identify(docs: DataFrame, model: BiGRU | None, carry: tuple[str, ...] = ("doc_id",), keep=None) -> DataFrame:
    """The ``carry`` columns of docs(text, ...) with lang_pred, score and positions; or, with
    ``keep``, a condition on these three as a struct, only the ``carry`` columns where it holds.

    score: the label's mean probability over all byte positions; positions: how many
    each label (ascending) takes. A null text, or one without a letter, is ``und`` with
    score 0, as is everything if no labelled row was there to learn from. Repeated
    rows are each returned; equal texts get equal labels.
    """
    small_batches(docs.sparkSession)
    # A network of fixed size, as plain values: workers need not have this package.
    held = docs.sparkSession.sparkContext.broadcast(model and (model.labels, model.hidden, model.p))

    def run(batches):
        import os

        import pandas as pd

        os.environ.setdefault("OMP_NUM_THREADS", "1")
        net = None
        if held.value:
            net = BiGRU(*held.value[:2])
            net.p = held.value[2]
        for texts in batches:
            out = []
            for at in range(0, len(texts), 128):
                part = [bytes(t) if t is not None else b"" for t in texts.iloc[at : at + 128]]
                known = [net is not None and bool(LETTER.search(t.decode("utf-8", "replace"))) for t in part]
                read = iter(zip(*net.predict([t for t, k in zip(part, known) if k]))) if any(known) else iter(())
                for k in known:
                    if not k:
                        out.append(("und", 0.0, []))
                        continue
                    p, marks = next(read)
                    out.append((net.labels[int(p.argmax())], round(float(min(1.0, p.max())), 6), marks.tolist()))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "positions"])
        trim()

    udf, text, r = _iterator_udf(run, "lang_pred string, score double, positions array<long>"), free_name(docs, "body"), free_name(docs)
    found = docs.select(*carry, F.col("text").cast("string").cast("binary").alias(text)).withColumn(r, udf(text))
    return found.select(*carry, f"{r}.lang_pred", f"{r}.score", f"{r}.positions") if keep is None else found.where(keep(F.col(r))).select(*carry)


def known(docs: DataFrame, least: float) -> DataFrame:
    """docs, with its own columns whatever their names, without the rows whose language the
    network can't tell (no letter) or finds less likely than ``least``. Learns from docs
    itself; without labelled rows nothing is likely or not, and only rows without a letter go."""
    model = fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return identify(docs, model, tuple(docs.columns), lambda r: (r["lang_pred"] != "und") & (r["score"] >= least))


def _iterator_udf(run, schema: str):
    from collections.abc import Iterator

    import pandas as pd

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(batches)

    typed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(typed, schema).asNondeterministic()
