"""Language identification by a byte convolutional network.

Bytes of lower-cased text are embedded; filters of three widths run over
windows of fixed length, each filter's greatest response is kept, and a softmax
over languages reads those.  Trained in numpy on windows drawn from all over the
labelled texts that are not held out; applied to every window of every text.  A convolution over embedded bytes is a sum of
table entries, so application looks pairs of bytes up instead of multiplying.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, table

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: The bound of the training sample: windows a language, of at most as many labelled rows, whole
#: texts drawn from alike; with more than ``SAMPLE_LANGS`` languages each has fewer, none has none.
SAMPLE_WINDOWS, SAMPLE_LANGS = 1024, 256
STEPS, BATCH, RATE, SEED = 500, 64, 0.01, 7


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # 256, EMBED
    filters: list[np.ndarray]  # a width: width * EMBED, FILTERS
    out: np.ndarray  # len(WIDTHS) * FILTERS + 1, langs


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one padded with zeros, and the bytes each holds."""
    n = max(1, -(-len(data) // WINDOW))
    x = np.zeros(n * WINDOW, dtype=np.uint8)
    x[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    held = np.full(n, WINDOW, dtype=np.float64)
    held[-1] = len(data) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), held


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = SEED) -> Model | None:
    """Fits the network by Adam on random windows of the texts, languages drawn evenly.  No text: no model."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng, of = np.random.default_rng(seed), {k: [] for k in langs}
    for t, y in zip(texts, labels):
        of[y].append(windows(t)[0])
    rows = {k: np.concatenate(x) for k, x in of.items()}
    p = [rng.normal(0, 0.3, (256, EMBED)), *(rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS), np.zeros((len(WIDTHS) * FILTERS + 1, len(langs)))]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        y = rng.integers(len(langs), size=BATCH)
        x = np.stack([rows[langs[k]][rng.integers(len(rows[langs[k]]))] for k in y])
        e, feats, kept = p[0][x], [], []
        for w, f in zip(WIDTHS, p[1:-1]):
            n = WINDOW - w + 1
            cols = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
            r = cols @ f
            top = r.argmax(axis=1)
            feats.append(np.maximum(np.take_along_axis(r, top[:, None], 1)[:, 0], 0))
            kept.append((top, cols))
        h = np.concatenate([*feats, np.ones((BATCH, 1))], axis=1)
        d = _softmax(h @ p[-1])
        d[np.arange(BATCH), y] -= 1
        d /= BATCH
        grads = [np.zeros_like(p[0]), *(None for _ in WIDTHS), h.T @ d]
        back = d @ p[-1].T
        for k, w in enumerate(WIDTHS):
            top, cols = kept[k]
            g = back[:, k * FILTERS : (k + 1) * FILTERS] * (feats[k] > 0)
            at = np.take_along_axis(cols, top[:, :, None], 1)  # batch, filter, width * embed
            grads[1 + k] = np.einsum("bf,bfe->ef", g, at)
            ge = (g[:, :, None] * p[1 + k].T[None]).reshape(BATCH, FILTERS, w, EMBED)
            byte = x[np.arange(BATCH)[:, None, None], top[:, :, None] + np.arange(w)]
            np.add.at(grads[0], byte.ravel(), ge.reshape(-1, EMBED))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] - RATE * (1 - step / (steps + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Model(langs, p[0], p[1:-1], p[-1])


class Reader:
    """Applies a model through tables of pairs of bytes."""

    def __init__(self, model: Model):
        self.model, self.parts = model, []
        for w, f in zip(WIDTHS, model.filters):
            one = [(model.embed @ f[j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(w)]
            self.parts.append([(one[j][:, None] + one[j + 1][None]).reshape(-1, FILTERS) if j + 1 < w else one[j] for j in range(0, w, 2)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.model.langs)))
        for at in range(0, len(x), 256):
            part = x[at : at + 256].astype(np.int32)
            pair = part[:, :-1] << 8 | part[:, 1:]
            feats = []
            for w, tables in zip(WIDTHS, self.parts):
                n = WINDOW - w + 1
                r = tables[0][pair[:, :n]]
                for j, t in enumerate(tables[1:], 1):
                    r += t[(pair if len(t) > 256 else part)[:, 2 * j : 2 * j + n]]
                feats.append(np.maximum(r.max(axis=1), 0))
            h = np.concatenate([*feats, np.ones((len(part), 1), np.float32)], axis=1)
            out[at : at + 256] = _softmax(h.astype(np.float64) @ self.model.out)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score, rows, held, spans = ["und"] * len(texts), [0.0] * len(texts), [], [], []
        for i, t in enumerate(texts):
            if t and any(c.isalpha() for c in t):
                x, n = windows(t.lower().encode())
                spans.append((i, len(x)))
                rows.append(x)
                held.append(n)
        if not rows:
            return lang, score
        p = self.probabilities(np.concatenate(rows)) * np.concatenate(held)[:, None]
        ends = np.cumsum([n for _, n in spans])
        sums = np.add.reduceat(p, np.r_[0, ends[:-1]], axis=0)
        for (i, _), s in zip(spans, sums / sums.sum(axis=1, keepdims=True)):
            lang[i], score[i] = self.model.langs[int(s.argmax())], float(min(s.max(), 1.0))
        return lang, score


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _drawn(n: int):
    """(y, b, h, w): windows of lower-cased texts; of a task's windows of one label
    and bucket the one with the least hash."""

    def run(batches):
        least: dict[tuple[str, int], tuple[int, bytes]] = {}
        for b in pieces(batches, 2 << 20):
            for y, h, t in zip(*(c.to_pylist() for c in b.columns)):
                data = t.lower().encode()
                for i in range(0, len(data), WINDOW):
                    w = data[i : i + WINDOW]
                    x = xxhash.xxh64_intdigest(w, (h + i) & 0xFFFFFFFFFFFFFFFF)
                    key, x = (y, x % n), x >> 1
                    if key not in least or (x, w) < least[key]:
                        least[key] = x, w
        if least:
            yield pa.record_batch([pa.array([k[0] for k in least]), pa.array([k[1] for k in least], pa.int64()), pa.array([v[0] for v in least.values()], pa.int64()), pa.array([v[1] for v in least.values()], pa.binary())], ["y", "b", "h", "w"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from the labelled rows that are not held out, of every label they
    have and of whole texts.  Every window falls into one of SAMPLE_WINDOWS
    buckets of its label by hash and the least of each is taken (see SAMPLE_* for
    many labels), so at most so many windows and rows reach the driver.  Null and
    empty texts teach nothing; no labelled text: no model."""
    rows = docs.where(F.col(lang_col).isNotNull() & (_remainder(id_col) != 2) & (F.col(text_col) != "")).select(F.col(lang_col).alias("y"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"))
    n = rows.select("y").distinct().count()
    buckets = max(1, SAMPLE_WINDOWS * min(n, SAMPLE_LANGS) // max(n, 1))
    drawn = rows.mapInArrow(_drawn(buckets), "y string, b long, h long, w binary").groupBy("y", "b").agg(F.min(F.struct("h", "w")).alias("m"))
    sample = sorted((r["y"], r["b"], bytes(r["w"])) for r in drawn.select("y", "b", "m.w").collect())
    return train([w for _, _, w in sample], [y for y, _, _ in sample])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row per row, from the whole text alone, however long.

    ``und`` with score 0 where the text is null or has no letter, or where
    there was nothing to learn from; repeated rows and null ids are read like any
    other, no rows give none; other columns of ``docs`` are never read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model and (model.langs, model.embed, model.filters, model.out))

    def run(batches):
        reader = Reader(Model(*held.value)) if held.value else None
        for b in pieces(batches, 2 << 20):
            texts = b.column(1).to_pylist()
            lang, score = reader.predict(texts) if reader else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = predict(docs, fit(docs))
    return rows.select("doc_id", (_remainder("doc_id") == 2).alias("held_out"), "lang_pred", "score")
