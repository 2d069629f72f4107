"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads the UTF-8 bytes of a text in both directions, labels every position with a distribution over the
languages, and pools these into one for the document. It is trained by backpropagation through time on a bounded sample of
labelled documents: windows of bytes, every position of which bears its document's label. Texts are read whole, as
consecutive segments side by side, so that one matrix product moves thousands of segments on by one byte; each segment starts
from the zero state, as the training windows do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, materialize, table, unused

HIDDEN = 8
SEGMENT = 64
#: Documents of each language in the training sample, and windows taken from each, at most.
SAMPLE_DOCS, WINDOWS = 1_500, 4
STEPS, BATCH, RATE = 350, 256, 0.02
#: Segments that go through the network at once.
CHUNK = 1_024
#: The pipeline keeps documents of at least this score.
KEEP_SCORE = 0.4


def softsign(a: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the network's squashing function; cheaper than tanh."""
    return a / (1 + np.abs(a))


class Gru:
    """One direction; gates are (softsign + 1) / 2. Weights: input (256 + padding, 3H) with bias, recurrent (H, 3H)."""

    def __init__(self, rng: np.random.Generator, h: int):
        self.h = h
        self.wx = (rng.standard_normal((257, 3 * h)) * 0.3).astype(np.float32)
        self.wh = (rng.standard_normal((h, 3 * h)) / np.sqrt(h) * 0.7).astype(np.float32)
        self.params = [self.wx, self.wh]

    def step(self, xa: np.ndarray, s: np.ndarray) -> tuple:
        h = self.h
        ha = s @ self.wh[:, : 2 * h]
        ha += xa[:, : 2 * h]
        g = 0.5 * softsign(ha) + 0.5
        z, r = g[:, :h], g[:, h:]
        rs = r * s
        c = rs @ self.wh[:, 2 * h :]
        c = softsign(c + xa[:, 2 * h :])
        new = c - s
        new *= z
        new += s
        return new, z, r, rs, c

    def run(self, x: np.ndarray) -> np.ndarray:
        """States (length, H, segments) after each byte of ``x`` (length, segments). The gates' half is folded into the
        weights of the reset state."""
        h = self.h
        gates = self.wx.T.copy()
        wg, wc = self.wh[:, : 2 * h].T.copy(), (self.wh[:, 2 * h :] * 0.5).T.copy()
        n = x.shape[1]
        out = np.empty((len(x), h, n), np.float32)
        s = np.zeros((h, n), np.float32)
        xa, g, c, rs = (np.empty((k * h, n), np.float32) for k in (3, 2, 1, 1))
        z, r, xg, xc = g[:h], g[h:], xa[: 2 * h], xa[2 * h :]
        for t in range(len(x)):
            np.take(gates, x[t], axis=1, out=xa, mode="clip")
            np.matmul(wg, s, out=g)
            g += xg
            np.abs(g, out=xg)
            xg += 1
            g /= xg
            g += 1
            np.multiply(r, s, out=rs)
            np.matmul(wc, rs, out=c)
            c += xc
            np.abs(c, out=xc)
            xc += 1
            c /= xc
            c -= s
            c *= z
            c *= 0.5
            s = np.add(s, c, out=out[t])
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        s, tape, out = np.zeros((x.shape[1], self.h), np.float32), [], []
        for t in range(len(x)):
            new, z, r, rs, c = self.step(self.wx[x[t]], s)
            tape.append((x[t], s, z, r, rs, c))
            out.append(new)
            s = new
        return np.stack(out), tape

    def backward(self, dout: np.ndarray, tape: list) -> list[np.ndarray]:
        """Backpropagation through time: gradients of the parameters from those of the states."""
        h = self.h
        gx, gh = np.zeros_like(self.wx), np.zeros_like(self.wh)
        ds = np.zeros(dout.shape[1:], np.float32)
        for t in range(len(tape) - 1, -1, -1):
            x, s, z, r, rs, c = tape[t]
            d = ds + dout[t]
            dc = d * z * (1 - np.abs(c)) ** 2
            drs = dc @ self.wh[:, 2 * h :].T
            dz = d * (c - s) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = drs * s * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            da = np.concatenate([dz, dr], axis=1)
            ds = d * (1 - z) + drs * r + da @ self.wh[:, : 2 * h].T
            gh[:, : 2 * h] += s.T @ da
            gh[:, 2 * h :] += rs.T @ dc
            np.add.at(gx, x, np.concatenate([da, dc], axis=1))
        return [gx, gh]


class Network:
    """Both directions and the softmax over their states at each position. About 13,000 numbers."""

    PAD = 256

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs, self.key = langs, uuid.uuid4().hex
        self.ahead, self.back = Gru(rng, hidden), Gru(rng, hidden)
        self.wo = (rng.standard_normal((2 * hidden, len(langs))) * 0.3).astype(np.float32)
        self.bo = np.zeros(len(langs), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.params, *self.back.params, self.wo, self.bo]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients for segments ``x`` (length, segments) of labels ``y``: each position that isn't padding."""
        f, tape_f = self.ahead.forward(x)
        b, tape_b = self.back.forward(x[::-1])
        states = np.concatenate([f, b[::-1]], axis=2)
        logits = states @ self.wo + self.bo
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        real = (x != self.PAD).astype(np.float32)
        n = max(1.0, float(real.sum()))
        at = (np.arange(len(x))[:, None], np.arange(x.shape[1])[None, :], y[None, :])
        loss = float(-(np.log(p[at] + 1e-9) * real).sum() / n)
        d = p
        d[at] -= 1
        d *= (real / n)[:, :, None]
        h = self.ahead.h
        ds = d @ self.wo.T
        gwo = states.reshape(-1, 2 * h).T @ d.reshape(-1, d.shape[2])
        return loss, [*self.ahead.backward(ds[:, :, :h], tape_f), *self.back.backward(ds[::-1, :, h:], tape_b), gwo, d.sum((0, 1))]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (length, languages, segments) of every position of ``x`` (length, segments)."""
        h = self.ahead.h
        logits = np.matmul(self.wo[:h].T, self.ahead.run(x))
        logits += np.matmul(self.wo[h:].T, self.back.run(x[::-1])[::-1])
        logits += self.bo[:, None]
        np.clip(logits, -40, 40, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each whole text; all equal for an empty one."""
        n_segments = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
        sums = np.zeros((len(texts), len(self.langs)))
        owner = np.repeat(np.arange(len(texts)), n_segments)
        if len(owner):
            flat = np.full(len(owner) * SEGMENT, self.PAD, np.int16)
            at = np.concatenate([[0], np.cumsum(n_segments)]) * SEGMENT
            for a, t in zip(at.tolist(), texts, strict=False):
                flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
            grid = flat.reshape(-1, SEGMENT)
            for a in range(0, len(grid), CHUNK):
                x = np.ascontiguousarray(grid[a : a + CHUNK].T)
                p = self.positions(x)
                p *= (x != self.PAD)[:, None, :]
                np.add.at(sums, owner[a : a + CHUNK], p.sum(0).T)
        total = sums.sum(1, keepdims=True)
        return np.divide(sums, total, out=np.full_like(sums, 1 / len(self.langs)), where=total > 0)


def windows_of(texts: list[str], labels: list[int], rng: np.random.Generator, per_doc: int = WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for t, label in zip(texts, labels, strict=True):
        raw = t.encode("utf-8", "surrogatepass")
        for _ in range(min(per_doc, -(-len(raw) // SEGMENT))):
            a = int(rng.integers(0, max(1, len(raw) - SEGMENT + 1)))
            row = np.full(SEGMENT, Network.PAD, np.int16)
            piece = np.frombuffer(raw[a : a + SEGMENT], np.uint8)
            row[: len(piece)] = piece
            x.append(row)
            y.append(label)
    return np.array(x).T if x else np.zeros((SEGMENT, 0), np.int16), np.array(y, np.int64)


def fit(langs: list[str], texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 11) -> Network:
    """Adam on random batches, with as many windows of each language in a batch."""
    rng = np.random.default_rng(seed)
    net = Network(langs, seed=seed)
    x, y = windows_of(texts, labels, rng)
    own = [np.flatnonzero(y == k) for k in range(len(langs))]
    own = [o for o in own if len(o)]
    if not own:
        return net
    m = [np.zeros_like(p) for p in net.parameters()]
    v = [np.zeros_like(p) for p in net.parameters()]
    for k in range(1, steps + 1):
        pick = np.concatenate([rng.choice(o, BATCH // len(own) + 1) for o in own])
        _, grads = net.gradients(x[:, pick], y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - k / (steps + 1)))
        for p, g, a, b in zip(net.parameters(), grads, m, v, strict=True):
            g = g / max(1.0, norm)
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return net


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Network:
    """Takes ``sample_docs`` different texts of each language at most, the first by hash, and fits. Rows with a null text or
    label are left out; a repeated text takes one place."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    keyed = rows.withColumn("h", F.xxhash64("text"))
    first = keyed.select("lang", "h").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= sample_docs)
    first = materialize(first.select("lang", "h"), "sample")  # ``sample_docs`` rows of two values a language
    langs = sorted(r["lang"] for r in first.select("lang").distinct().collect())
    if not langs:
        return Network([])
    # of a long text, the sample takes WINDOWS pieces spread over it
    piece = F.lit(4 * SEGMENT)
    size = F.length("text")
    spread = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.substring("text", (F.greatest(F.lit(0), size - piece) * i / max(1, WINDOWS - 1)).cast("int") + 1, piece))
    sample = keyed.join(F.broadcast(first), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", F.explode(F.array_distinct(spread)).alias("text"))
    got = sample.toPandas().sort_values(["lang", "text"])
    return fit(langs, got["text"].tolist(), [langs.index(x) for x in got["lang"]])


_OUT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predict_language(docs: DataFrame, net: Network, text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds struct ``out``: lang (``und`` for null and for texts without a letter, with score 0) and score (its pooled
    probability) of each whole text. A column named ``out`` is replaced; other columns and repeated rows stay as they are. An
    empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(_OUT)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for s in texts:
            lang, score = ["und"] * len(s), [0.0] * len(s)
            todo = [i for i, t in enumerate(s) if model.langs and t and any(map(str.isalpha, t))]
            a = 0
            while a < len(todo):  # about a megabyte at a time
                b, size = a, 0
                while b < len(todo) and (b == a or size < 1_000_000):
                    size += len(s.iloc[todo[b]])
                    b += 1
                p = model.pooled([s.iloc[i].encode("utf-8", "surrogatepass") for i in todo[a:b]])
                for i, row in zip(todo[a:b], p, strict=True):
                    k = int(row.argmax())
                    lang[i], score[i] = model.langs[k], min(1.0, float(row[k]))
                a = b
            yield pd.DataFrame({"lang": lang, "score": score})

    return docs.withColumn(out, predict(F.col(text_col)))


def training_docs(docs: DataFrame) -> DataFrame:
    return docs.where((fold_of() != 2) & F.col("lang").isNotNull()).select("text", "lang")


def keep_identified(docs: DataFrame, net: Network, least: float = KEEP_SCORE) -> DataFrame:
    """The documents with a language of at least the score ``least``, with the columns they came with. Null texts and those
    without a letter go; repeated rows are judged alike. A network that has learned no language, as there were no labels,
    keeps whatever has a letter."""
    if not net.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = unused(docs, "language")
    found = F.col(out)
    return predict_language(docs, net, out=out).where((found["lang"] != "und") & (found["score"] >= least)).select(docs.columns)


def op4_language_id(spark, sf_dir):
    """SQL can't express it: tests hold the pooling against one position at a time, and the query against the labels of the
    held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict_language(docs.drop("lang"), train(training_docs(docs)))
    return found.select("doc_id", (fold_of() == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
