"""Language identification (operator 10): expectation-maximisation over language proportions.

Byte four-grams, hashed to 2**16 buckets, are counted per language over a bounded sample of the
labelled rows. A document is taken as a mixture: EM estimates its language proportions from the
n-gram likelihoods, and the set of languages is the one of the best penalised likelihood (each
further language costs ``penalty`` * log(n-grams)). The prediction is the language of the largest
proportion in that set and the score its proportion. One map over the scan; no shuffle of texts.

Where rows are to be rejected (``accepted``), the mixture has one component more: noise, under which
every bucket is equally likely. Text that no learned language explains better is noise for the most part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of

BUCKETS = 1 << 16
_LETTER = re.compile("[A-Za-z]")


def grams(text: str) -> np.ndarray:
    """The hashed byte four-grams of a lower-cased text, one space around it."""
    data = b" " + text.lower().encode("utf-8", "replace") + b"  "
    four = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (len(data) - 3, 4), (1, 1))
    return (np.ascontiguousarray(four).view("<u4")[:, 0] * np.uint32(0x9E3779B1)) >> np.uint32(16)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def fit(labelled: DataFrame, per_language: int = 3000, most: int = 512) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of each bucket, from about ``per_language`` rows of each.

    The sample is the rows of the smallest hashes of doc_id. The driver holds one vector of 512 KB for a
    language, so the ``most`` languages of most rows (ties: the first in order) are learned and rows of others
    left out, as are rows without text or lang. A null doc_id has a hash like any other.
    """
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return [], np.zeros((0, BUCKETS), np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])[F.col("lang")]
    uniform = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in small_batches(batches):
            for text, lang in zip(texts_of(batch), texts_of(batch, "lang")):
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang] += np.bincount(grams(text), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["lang", "counts"])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": frame.lang[:1], "counts": [sum(np.frombuffer(c, np.int64) for c in frame["counts"]).tobytes()]})

    parts = rows.where(uniform < share).select("text", "lang").mapInArrow(add, "lang string, counts binary")
    summed = {r.lang: np.frombuffer(r["counts"], np.int64) for r in parts.groupBy("lang").applyInPandas(total, "lang string, counts binary").collect()}
    langs = sorted(summed)
    table = np.stack([summed[k] for k in langs]) + 0.05
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def mixtures(texts: list[str], log_p: np.ndarray, penalty: float = 2.0, rounds: int = 8) -> np.ndarray:
    """Language proportions (rows: texts) of the chosen language sets; the EM steps run over all texts at once."""
    found = [np.unique(grams(t), return_counts=True) for t in texts]
    bucket, count = np.concatenate([g for g, _ in found]), np.concatenate([c for _, c in found]).astype(np.float32)
    starts = np.cumsum([0, *[len(g) for g, _ in found[:-1]]])
    sizes = np.array([len(g) for g, _ in found])
    n = np.add.reduceat(count, starts)
    lp = log_p.T[bucket]
    single = np.add.reduceat(lp * count[:, None], starts)
    out = np.zeros(single.shape, np.float32)
    out[np.arange(len(texts)), single.argmax(axis=1)] = 1
    best = single.max(axis=1)
    languages = log_p.shape[0]
    if languages < 2:
        return out
    top = lp.max(axis=1, keepdims=True)
    p = np.exp(lp - top)
    base = np.add.reduceat(top[:, 0] * count, starts)

    def em(p, count, starts, sizes, theta, steps):
        for _ in range(steps):
            w = p * np.repeat(theta, sizes, axis=0)
            w *= (count / np.maximum(w.sum(axis=1), 1e-30))[:, None]
            theta = np.add.reduceat(w, starts)
            theta /= theta.sum(axis=1, keepdims=True)
        mixed = np.log(np.maximum((p * np.repeat(theta, sizes, axis=0)).sum(axis=1), 1e-30)) * count
        return theta, np.add.reduceat(mixed, starts)

    theta, full = em(p, count, starts, sizes, np.full(single.shape, 1 / languages, np.float32), rounds)
    cost = penalty * np.log(n + 1)
    order = np.argsort(-theta, axis=1, kind="stable")
    best_penalised = best
    for k in range(2, languages + 1):
        more = np.flatnonzero(base + full - cost * (k - 1) > best_penalised)  # the full mixture bounds any set of k
        if not len(more):
            break
        allowed = np.zeros(single.shape, np.float32)
        np.put_along_axis(allowed, order[:, :k], 1, axis=1)
        pick = np.repeat(np.isin(np.arange(len(texts)), more), sizes)
        part_sizes = sizes[more]
        start = theta[more] * allowed[more] + 1e-6 * allowed[more]
        start /= start.sum(axis=1, keepdims=True)
        fitted, likelihood = em(p[pick], count[pick], np.cumsum([0, *part_sizes[:-1]]), part_sizes, start, rounds)
        value = base[more] + likelihood - cost[more] * (k - 1)
        better = value > best_penalised[more]
        out[more[better]] = fitted[better]
        best_penalised[more[better]] = value[better]
    return out


def with_noise(langs: list[str], log_p: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The learned languages and, as ``und``, noise: every bucket equally likely."""
    return [*langs, "und"], np.vstack([log_p, np.full((1, BUCKETS), -np.log(BUCKETS), np.float32)])


def judged(texts: list, langs: list[str], log_p: np.ndarray) -> tuple[list[str], list[float], list[int]]:
    """Prediction, score and number of languages of each text; ties between languages go to the first in order."""
    pred, score, n = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
    able = [i for i, t in enumerate(texts) if langs and has_letter(t)]
    if able:
        shares = mixtures([texts[i] for i in able], log_p)
        for i, k, s, m in zip(able, shares.argmax(axis=1), shares.max(axis=1), (shares > 0.01).sum(axis=1)):
            pred[i], score[i], n[i] = langs[k], min(1.0, float(s)), int(m)
    return pred, score, n


def predict(docs: DataFrame, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score and n_langs for every row.

    A text that is null or has no letter, and any text if no language was learned, gives ``und``
    with score 0. Whole texts are used; repeated rows repeat; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            pred, score, n = judged(texts_of(batch), langs, model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int32())], ["doc_id", "lang_pred", "score", "n_langs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int")


def fitting(batches: Iterator[pa.RecordBatch], log_p: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """The rows with a letter of which noise, the last of ``log_p``, holds 1 - ``least`` at most; all with a letter if it is alone.

    Batches are of 256 KB, since EM takes about sixty times that and the worker goes on to the stages that follow.
    """
    for batch in small_batches(batches, 1 << 18):
        texts = texts_of(batch)
        good = np.array([has_letter(t) for t in texts], bool)
        if len(log_p) > 1 and good.any():
            good[good] = mixtures([texts[i] for i in np.flatnonzero(good)], log_p)[:, -1] <= 1 - least
        yield batch.filter(pa.array(good, pa.bool_()))


def accepted(docs: DataFrame, least: float = 0.1) -> DataFrame:
    """The rows of ``docs``, all columns, that are written in the learned languages; the others go. Fits on ``docs`` itself.

    A row stays if the learned languages hold at least ``least`` of its n-grams by the proportions that EM
    estimates beside noise (``with_noise``), in whatever mixture; numbers, addresses and code are noise for the
    most part, which is why ``least`` is small. Texts that are null or have no letter go. Where
    no language can be learned, no row is rejected for that: all rows with a letter stay. A text in a language
    that was not learned goes if it shares too little with those that were.
    """
    langs, log_p = fit(docs.where(~held_out(4, 2)))
    model = docs.sparkSession.sparkContext.broadcast(with_noise(langs, log_p)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fitting(batches, model.value, least)

    return docs.mapInArrow(run, docs.schema)


def held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict every row; held_out marks the others."""
    langs, log_p = fit(docs.where(~held_out(4, 2)))
    return predict(docs, langs, log_p).withColumn("held_out", F.coalesce(held_out(4, 2), F.lit(False)))
