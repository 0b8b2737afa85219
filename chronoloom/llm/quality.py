"""Quality classifier (operator 3): random-indexing word vectors, pooled, and a two-layer numpy network.

Tokens (letter runs, digit runs, symbol runs) fall into hashed buckets; two shapes are tokens of
their own: a word that repeats the one before, and a word in capitals. Every bucket has a sparse random
index vector; its word vector is the sum of the index vectors of its neighbours over all documents
(integers, so the sum is the same in any order). A document is the mean of the unit word vectors of
its tokens. A two-layer network, fitted on a bounded sample of labelled rows, gives a logit, and a
temperature fitted on rows kept out of the fit calibrates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of

BUCKETS, WIDTH, NONZERO, SLICES = 4096, 48, 4, 64
AGAIN, CAPS = 0, 1
_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class _Buckets(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[token] = 2 + xxhash.xxh32_intdigest(token.lower()) % (BUCKETS - 2)
        return value


_buckets = _Buckets()


def tokens(text: str | None) -> np.ndarray:
    """Buckets of a text's tokens: a repeated token is AGAIN, and CAPS follows a word in capitals."""
    found = _TOKENS.findall(text or "")
    ids = np.fromiter(map(_buckets.__getitem__, found), np.int32, len(found))
    if len(ids) > 1:
        again = np.flatnonzero(ids[1:] == ids[:-1]) + 1
        ids[again] = AGAIN
    caps = [i + 1 for i, t in enumerate(found) if len(t) > 1 and t.isupper()]
    return np.insert(ids, caps, CAPS) if caps else ids


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries of every bucket's index vector."""
    rng = np.random.default_rng(7)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame, window: int = 2) -> np.ndarray:
    """Unit word vectors of all buckets from all texts. Task sums meet slice by slice, in two levels."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        for batch in small_batches(batches, 4 << 20):
            lists = [t for x in texts_of(batch) if len(t := tokens(x))]
            if not lists:
                continue
            ids = np.concatenate(lists)
            doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            for step in range(1, window + 1):
                near = doc[step:] == doc[:-step]
                for own, other in ((ids[step:][near], ids[:-step][near]), (ids[:-step][near], ids[step:][near])):
                    for j in range(NONZERO):
                        total += np.bincount(own * WIDTH + places[other, j], signs[other, j], BUCKETS * WIDTH)
        if total.any():
            rows = total.astype(np.int64).reshape(SLICES, -1)
            part = int(np.abs(rows[0]).sum()) % 64
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["slice", "part", "sums"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": frame["slice"][:1], "sums": [sum(np.frombuffer(s, np.int64) for s in frame["sums"]).tobytes()]})

    parts = docs.select("text").mapInArrow(add, "slice int, part int, sums binary")
    half = parts.groupBy("slice", "part").applyInPandas(meet, "slice int, sums binary")
    rows = half.groupBy("slice").applyInPandas(meet, "slice int, sums binary").collect()
    out = np.zeros((SLICES, BUCKETS * WIDTH // SLICES))
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["sums"], np.int64)
    out = out.reshape(BUCKETS, WIDTH)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean word vector, the share of AGAIN and CAPS in it as of any token."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, text in enumerate(texts):
        ids = tokens(text)
        if len(ids):
            out[i] = np.bincount(ids, minlength=BUCKETS).astype(np.float32) @ vectors / len(ids)
    return out


class Network:
    """tanh(x W1 + b1) W2 + b2, fitted by Adam on the log loss; sigmoid(logit / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        kept = rng.random(len(z)) < 0.8
        kept |= len(z) < 50
        shape = [(z.shape[1], hidden), (hidden,), (hidden,), ()]
        self.p = [rng.normal(0, 0.2, s) if len(s) == 2 or k == 2 else np.zeros(s) for k, s in enumerate(shape)]
        m, v, t = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape], 0
        a, b = z[kept], y[kept]
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(a)), max(1, len(a) // 128)):
                w1, b1, w2, b2 = self.p
                h = np.tanh(a[at] @ w1 + b1)
                g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - b[at]) / len(at)
                back = np.outer(g, w2) * (1 - h * h)
                grads = [a[at].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ g + 1e-4 * w2, g.sum()]
                t += 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] = self.p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        out = ~kept if (~kept).any() else kept
        logits, wanted = self.logits(x[out]), y[out]
        loss = lambda s: np.mean(np.logaddexp(0, logits / s) - wanted * logits / s)
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def learn_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    keep = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    wanted = labels.where(keep & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    return wanted


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    The network learns from about ``sample_rows`` labelled ids at most, those of the smallest hashes,
    none of them held out, with one document for each: where several share an id, the one of the least
    vector. An id with several labels has the larger. Word vectors come from all texts. Null and empty
    texts get the score of a document of no tokens; a null doc_id is scored, has no label and isn't held out.
    Without two classes to learn from, as in an empty table, every score is the mean label, or 0.5.
    Repeated rows repeat; other columns are ignored.
    """
    wanted = learn_rows(docs, labels)
    n = wanted.count()
    share = min(1.0, sample_rows / max(1, n))
    picked = wanted.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_003)) / 1_000_003.0 < share)
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            rows = pooled(texts_of(batch), vectors.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "x"])

    # sample_rows bounds the broadcast side and, with one vector an id, what the driver gets
    fit_rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id").select("text", "doc_id", "quality")
    single = fit_rows.mapInArrow(features, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    sample = single.select("quality", "x").toPandas().sort_values(["x", "quality"])
    y = sample["quality"].to_numpy(float)
    x = np.stack([np.frombuffer(r, np.float32) for r in sample["x"]]).astype(float) if len(y) else np.zeros((0, WIDTH))
    constant = None if len(set(y)) == 2 else float(y.mean()) if len(y) else 0.5
    model = docs.sparkSession.sparkContext.broadcast(None if constant is not None else Network(x, y))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            texts = texts_of(batch)
            found = np.full(len(texts), constant) if constant is not None else model.value.scores(pooled(texts, vectors.value).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
