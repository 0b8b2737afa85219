"""Substring dedup (operator 4): compressed FM-indexes over shards of passages that may repeat.

A window is 35 consecutive words. Its anchor is the least of its ten-word hashes, so equal windows
have equal anchors; neighbouring windows with one anchor are a region of at most 26 windows. Only
regions whose anchor stands elsewhere too can repeat. Equal regions are counted before any text
moves; where an anchor has different regions, one copy of each goes to the shard of its
anchor, and the shard's task builds an FM-index (wavelet matrix) over them, streams the regions that
stand once through it by backward search, and reports the windows whose matches weigh two or more.
An anchor of more than ``hot`` different regions (a common passage in many contexts) would fill one
shard; its windows are counted by hash instead, which spreads them, exactly and without a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, hash_words, released, row_hashes, signed, small_batches, spread_join, texts_of, written
from .fm_index import repeated_windows

WINDOW, GRAM = 35, 10
NONE = -(2**63)
ROW = ["doc_id", "th", "tg"]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashed(text: str | None) -> np.ndarray:
    return hash_words((text or "").encode("utf-8", "surrogatepass"))[0]


def regions(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(anchor, start, n_windows, region hash) arrays of the regions of one document."""
    n = len(hashes) - window + 1
    if n < 1:
        return None
    spans = Spans(hashes)
    first = np.arange(len(hashes) - gram + 1)
    grams = spans.of(first, first + gram)
    least, width = first, 1
    across = window - gram + 1
    while 2 * width <= across:  # position of the leftmost least gram among ``width`` from each place
        left, right = least[:-width], least[width:]
        least = np.where(grams[left] <= grams[right], left, right)
        width *= 2
    left, right = least[:n], least[across - width :][:n]
    least = np.where(grams[left] <= grams[right], left, right)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.concatenate([start, [n]]))
    return grams[least[start]], start, count, spans.of(start, start + count + window - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, tg, text): 128 bits of the text tell rows of one doc_id apart; a null doc_id is the least long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.coalesce("id", F.lit(NONE)).alias("doc_id"), *row_hashes("text"), "text")


def _occurrences(keyed: DataFrame) -> DataFrame:
    names = ["anchor", *ROW, "start", "n", "region"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            row, parts = [batch.column(k).to_numpy() for k in range(3)], []
            for i, text in enumerate(texts_of(batch)):
                if (found := regions(_hashed(text))) is not None:
                    parts.append((i, *found))
            if parts:
                rows = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                anchor, start, count, region = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), *(pa.array(c[rows]) for c in row), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(signed(region))], names)

    return keyed.mapInArrow(run, "anchor long, doc_id long, th long, tg long, start int, n int, region long")


def _contents(asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """The asked regions with their words' hashes (binary), and each window's hash where they are hot."""
    fields = ["anchor", "region", "n", "weight", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            out: dict[str, list] = {k: [] for k in (*fields, "words", "windows")}
            for text, wanted in zip(texts_of(batch), batch.column(1).to_pylist()):
                hashes = _hashed(text)
                spans = Spans(hashes)
                for w in wanted:
                    s, n = w["start"], w["n"]
                    for k in fields:
                        out[k].append(w[k])
                    out["words"].append(None if w["hot"] else hashes[s : s + n + WINDOW - 1].tobytes())
                    at = np.arange(s, s + n)
                    out["windows"].append(signed(spans.of(at, at + WINDOW)).tolist() if w["hot"] else None)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    lists = asked.groupBy(*ROW).agg(F.collect_list(F.struct("start", *fields)).alias("wanted"))
    return keyed.join(lists, ROW).select("text", "wanted").mapInArrow(run, "anchor long, region long, n int, weight long, hot boolean, words binary, windows array<long>")


def _searched(pieces: DataFrame, shards: int) -> DataFrame:
    """(anchor, region, flags) of the pieces of weight 1 that repeat in part: an FM-index per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def close() -> pa.RecordBatch:
            anchors, found, weights, words = zip(*held)
            weights = np.array(weights)
            asked = np.flatnonzero(weights == 1)
            flags = repeated_windows([np.frombuffer(w, np.uint64) for w in words], weights, asked, WINDOW) if len(asked) else []
            hits = [(anchors[i], found[i], f) for i, f in zip(asked.tolist(), flags) if f]
            return pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in range(3)], ["anchor", "region", "flags"])

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if len(held) >= 4096 and row[0] != held[-1][0]:  # an anchor stays whole; an index stays small
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    dealt = pieces.select("anchor", "region", "weight", "words").repartition(shards, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, region long, flags long")


def repeated_spans(keyed: DataFrame, hot: int = 100) -> DataFrame:
    """(doc_id, th, tg, spans): starts of regions and the bits of their windows that repeat, for rows that have any."""
    seen = written(_occurrences(keyed))
    twice = written(seen.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1"))
    again = written(spread_join(seen, twice, ["anchor"]).drop("times"))
    released(seen, twice)
    kinds = again.groupBy("anchor", "region", "n").agg(F.count("*").alias("weight"), F.min(F.struct(*ROW, "start")).alias("at"))
    kinds = written(kinds.select("anchor", "region", "n", "weight", "at.*"))
    mixed = written(kinds.groupBy("anchor").agg(F.count("*").alias("times"), F.min("weight").alias("least")).where("times > 1 AND least = 1"))
    asked = spread_join(kinds, mixed, ["anchor"]).withColumn("hot", F.col("times") > hot)
    pieces = written(_contents(asked, keyed))
    shards = max(1, -(-pieces.where("NOT hot").count() // 4096))
    found = _searched(pieces.where("NOT hot"), shards)
    windows = pieces.where("hot").select("anchor", "region", "weight", F.posexplode("windows").alias("bit", "window"))
    common = written(windows.groupBy("anchor", "window").agg(F.sum("weight").alias("total"), F.count("*").alias("times")).where("total > 1"))
    counted = spread_join(windows.where("weight = 1"), common, ["anchor", "window"]).groupBy("anchor", "region").agg(F.sum(F.expr("shiftleft(1L, bit)")).alias("flags"))
    whole = kinds.where("weight > 1").select("anchor", "region", F.expr("shiftleft(1L, n) - 1").alias("flags"), F.col("weight").alias("times"))
    flagged = written(whole.unionByName(found.unionByName(counted).withColumn("times", F.lit(1).cast("long"))))
    released(kinds, mixed, pieces, common)
    return spread_join(again, flagged, ["anchor", "region"]).groupBy(*ROW).agg(F.collect_set(F.struct("start", "flags")).alias("spans"))


def covered(n: int, spans: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """Which of n words a flagged window covers."""
    edge = np.zeros(n + 1, np.int64)
    for start, flags in spans:
        while flags:
            bit = (flags & -flags).bit_length() - 1
            edge[start + bit] += 1
            edge[start + bit + window] -= 1
            flags &= flags - 1
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (the kept words, joined by one space), n_words and n_removed for every document.

    A word goes if a window of 35 words that covers it also starts anywhere else in the table, the same
    document included. Null and empty texts have no words; texts of fewer than 35 words keep all.
    Repeated rows repeat each other and go both; an empty table gives no rows; other columns are
    ignored. Whole texts are used.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            kept, total, removed = [], [], []
            for text, found in zip(texts_of(batch), batch.column(2).to_pylist()):
                words = _words(text)
                total.append(len(words))
                if found:
                    gone = covered(len(words), [(f["start"], f["flags"]) for f in found])
                    words = [words[i] for i in np.flatnonzero(~gone)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    doc_id = F.when(F.col("doc_id") != NONE, F.col("doc_id")).alias("doc_id")
    rows = keyed.join(spans, ROW, "left").select(doc_id, "text", "spans")
    return rows.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")
