"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by the shape of its text; gated
attention weighs the passages, and the weighted representation gives the document's score. Only
document labels are learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, stored

#: Words of a passage, and labelled documents that the model is fitted to at most (in expectation:
#: a hash of the id selects the share of them that gives this number). Their passages are at most about
#: PASSAGES (60 MB on the driver), else fewer documents are taken; a document with more than a
#: sixteenth of that is not learned from.
PASSAGE, SAMPLE, PASSAGES = 48, 12_000, 400_000
THRESHOLD = 0.7
_MARKS = "!|%&*$#.,?:;<>{}=@/\\_-"
WIDTH = 15 + len(_MARKS)


def encode(text: str | None) -> np.ndarray:
    """A row of features for each passage of the whole text; one row of zeros for a text without words."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    whole, seen, rows = len(words), set(), []
    common = Counter(words).most_common(1)[0][1] / whole
    distinct = len(set(words)) / whole
    for at in range(0, whole, PASSAGE):
        part = words[at : at + PASSAGE]
        n, s, own = len(part), " ".join(part), set(part)
        chars = len(s)
        letters = [w for w in part if w.isalpha()]
        rows.append(
            [
                chars / n / 10,
                len(own) / n,
                len(own & seen) / len(own),
                max(map(len, part)) / 30,
                sum(a == b for a, b in zip(part, part[1:], strict=False)) / n,
                sum(map(str.isupper, part)) / n,
                sum(map(str.istitle, part)) / n,
                len(letters) / n,
                sum(map(str.isdigit, s)) / chars,
                len(s.encode()) / chars - 1,
                max(Counter(part).values()) / n,
                sum(len(w) == 1 for w in part) / n,
                np.log1p(whole) / 10,
                common,
                distinct,
                *(s.count(c) / n for c in _MARKS),
            ]
        )
        seen |= own
    return np.array(rows, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """h = tanh(x W + b); weights = softmax(u . (tanh(h V) * sigmoid(h G))); score = sigmoid(c . sum(weights h) + d)."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.25, (hidden, gate)), "G": rng.normal(0, 0.25, (hidden, gate)), "u": np.zeros(gate), "c": np.zeros(hidden), "d": np.zeros(1)}

    def _forward(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["G"])
        e = np.exp(np.clip((t * g) @ p["u"], -30, 30))
        a = e / np.repeat(np.add.reduceat(e, starts), lengths)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, g, a, z, _sigmoid(z @ p["c"] + p["d"])

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(b) for b in bags])
        x = np.clip((np.concatenate(bags) - self.mean) / self.scale, -8, 8)
        return self._forward(x, np.cumsum(lengths) - lengths, lengths)[-1]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0, dtype=float), np.maximum(every.std(0, dtype=float), 1e-3)
        rng, p = np.random.default_rng(1), self.p
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                lengths = np.array([len(bags[i]) for i in some])
                starts = np.cumsum(lengths) - lengths
                x = np.clip((np.concatenate([bags[i] for i in some]) - self.mean) / self.scale, -8, 8)
                h, t, g, a, z, y = self._forward(x, starts, lengths)
                dy = (y - labels[some]) / len(some)
                dz = np.repeat(dy[:, None] * p["c"], lengths, axis=0)
                da = (dz * h).sum(1)
                ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), lengths))
                dt, dg = ds[:, None] * p["u"] * g * (1 - t * t), ds[:, None] * p["u"] * t * g * (1 - g)
                dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["G"].T) * (1 - h * h)
                grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "G": h.T @ dg, "u": (t * g).T @ ds, "c": z.T @ dy, "d": dy.sum(keepdims=True)}
                step += 1
                for k in p:
                    gk = grad[k] + decay * p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
                    p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def held_out(id_col: str) -> Column:
    return F.pmod(id_crc(id_col), F.lit(4)) == 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> Model:
    """Fit to at most about ``sample`` labelled documents with ``passages`` passages, outside the held-out fold.

    Labels that repeat for an id are averaged; null labels and ids are skipped. Without a label of
    both kinds the model gives the share of label 1, or one half.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null").filter(~held_out("id"))
    own = stored(own.groupBy("id").agg(F.avg("y").alias("y")), "labels")
    share = min(1.0, sample / max(1, own.count()))
    picked = own.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    @F.pandas_udf("binary")
    def bag(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode(t).tobytes())

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # about ``sample`` rows are broadcast
    bags = stored(own.select("id", "y", bag("text").alias("bag")), "bags").withColumn("n", F.length("bag") / (4 * WIDTH)).filter(F.col("n") <= passages // 16)
    total = bags.agg(F.sum("n").alias("n")).first().n or 0
    # Repeated rows and long texts count in ``total``, so what is collected is bounded in bytes.
    kept = bags.filter(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 20)) < F.lit(int(min(1.0, passages / max(1, total)) * (1 << 20))))
    rows = kept.orderBy("id", "bag").select("y", "bag").toPandas()
    model = Model()
    if len(rows):
        y = rows.y.to_numpy()
        if y.min() < y.max():
            model.fit([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows.bag], y)
        else:
            model.p["d"][0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row, every passage of it read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for texts in parts:
            yield pd.Series(np.concatenate([own.score([encode(t) for t in texts.iloc[i : i + 512]]) for i in range(0, len(texts), 512)]) if len(texts) else [], dtype=float)

    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Learn from ``labels`` and score all of ``docs``.

    Cases: null, empty and blank texts are one passage of zeros and have its score; long texts have as
    many passages as it takes and every one is read; repeated rows each give a row and each count in
    learning; without labels every score is one half; a null id counts as empty text for the fold and has no
    label; other columns are not read.
    """
    return scored(docs, learn(docs, labels, id_col, text_col, label_col), id_col, text_col)
