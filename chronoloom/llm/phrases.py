"""Phrase collocation mining (operator 13): SETM over occurrence relations, then scores of the candidates.

An occurrence relation R_k holds, sorted by place, where each frequent phrase of k words stands; a place is a word's position in
a block of one language, and a piece's end skips one, so that neighbouring positions lie in one piece. A row of the relation is
a block: its places, a number for the phrase at each place, and the phrases of these numbers. R_k is made from R_(k-1) by a
merge join with itself: phrases at neighbouring places, which share all but their outer words, make one of k words. Its groups are
counted over (block, group, count) that the blocks have summed before, so that a group has at most one count for each block; the
semi-join with the frequent groups comes before the next length and uses the same exchange.

Groups are counted by hashes of 44 bits, which can only count too much: they drop no frequent phrase. What is left is counted again
by its words, so all figures are exact. Texts move once, as R_1; longer relations hold frequent phrases only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_words, mix, released, small_batches, written

#: Words of a block, about: bounds a task's memory, not the result.
BLOCK = 1 << 19
#: Words for each range of hashes: bounds what a task counts at once.
RANGE = 1 << 20
_LOWER = bytes(range(256)).lower()
_BREAK, _GAP = 10, 32
_TABLE = bytes(_BREAK if b in b".,;:!?\n\v\f\r" else _GAP if b == 9 else _LOWER[b] for b in range(256))
#: A row is a block; n is the number of its places, the rest is compressed.
RELATION = "block long, lang string, n long, at binary, phrase binary, phrases binary"


def _packed(block: int, lang: str, at: np.ndarray, phrase: np.ndarray, phrases: list[bytes]) -> tuple:
    """A row of a relation: places as steps, which compress well; phrases one a line."""
    press = zstandard.ZstdCompressor(level=1).compress
    return block, lang, len(at), press(np.diff(at, prepend=0).astype("<i4").tobytes()), press(phrase.astype("<i4").tobytes()), press(b"\n".join(phrases))


def _unpacked(at: bytes, phrase: bytes, phrases: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    spread = zstandard.ZstdDecompressor().decompress
    return np.cumsum(np.frombuffer(spread(at), "<i4"), dtype=np.int64), np.frombuffer(spread(phrase), "<i4"), spread(phrases).split(b"\n")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["block", "lang", "n", "at", "phrase", "phrases"])


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Places, numbers and words of a text in which ``_TABLE`` has been applied."""
    numbers: dict[bytes, int] = {}
    number = np.array([numbers.setdefault(w, len(numbers)) for w in text.split()], np.int64)
    raw = np.frombuffer(text, np.uint8)
    inside = (raw != _GAP) & (raw != _BREAK)
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
    piece = np.searchsorted(np.flatnonzero(raw == _BREAK), starts)
    return np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0), number, list(numbers)


def occurrences(docs: DataFrame) -> DataFrame:
    """R_1 with all words, before any is found frequent: blocks of one language, each of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            at, number, words = words_of(b"\n".join(held.pop(lang)))
            sizes.pop(lang)
            if len(at):
                yield _rows([_packed(0, lang, at, number, words)])

        for batch in small_batches(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                if sizes[lang] > 6 * BLOCK:
                    yield from close(lang)
            while sum(sizes.values()) > 24 * BLOCK:
                yield from close(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from close(lang)

    texts = docs.where("text IS NOT NULL AND text <> ''").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    rows = texts.mapInArrow(run, RELATION)
    return rows.withColumn("block", F.monotonically_increasing_id())


def _hashed(phrases: list[bytes], lang: str) -> np.ndarray:
    """64-bit hashes of phrases with their language."""
    text = b"\n".join(p.replace(b" ", b"\0") for p in phrases)
    salt = mix(hash_words(lang.encode("utf-8", "surrogatepass") or b"-")[0].sum(keepdims=True, dtype=np.uint64))
    return mix(hash_words(text)[0] ^ salt)


def _joined(at: np.ndarray, phrase: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge join of sorted places with their neighbours: places, and the phrases there and one place on. k = 1: all as they are."""
    if k == 1:
        return at, phrase, phrase
    next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[next_to], phrase[next_to], phrase[next_to + 1]


def _group(hashes: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    return hashes[left] if k == 1 else mix(hashes[left] * np.uint64(0x9E3779B97F4A7C15) + (hashes[right] ^ np.uint64(k)))


def _deltas(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(numbers, prepend=numbers[:1]).tobytes()) if len(numbers) else b""


def _numbers(packed: bytes, first: int, kind: str = "<u8") -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind).copy()
    steps[0] = first
    return np.cumsum(steps, dtype=steps.dtype)


def _frequent(relation: DataFrame, k: int, least: int, words: int) -> DataFrame:
    """(block, groups): the groups of each block that are frequent in all, by hash.

    Blocks send their sorted groups and counts in packed pieces, by ranges of the hash; a range is about ``RANGE`` different groups, of which
    each block sends one count, so a frequent group is no larger there than another. A task sums the pieces of a range and
    tells each block which of its groups are frequent.
    """
    bits = max(1, (words // RANGE).bit_length())
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for block, lang, *packed in zip(*[batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)]):
                at, phrase, phrases = _unpacked(*packed)
                _, left, right = _joined(at, phrase, k)
                groups, n = np.unique(_group(_hashed(phrases, lang), left, right, k), return_counts=True)
                groups &= ~np.uint64((1 << 20) - 1)  # 44 bits are plenty to part groups, and pack better
                cuts = np.flatnonzero(np.diff(groups >> shift)) + 1
                pieces = [(g, c) for g, c in zip(np.split(groups, cuts), np.split(n, cuts)) if len(g)]
                press = zstandard.ZstdCompressor(level=1).compress
                columns = [[int(g[0] >> shift) for g, _ in pieces], [block] * len(pieces), [int(g[:1].view(np.int64)[0]) for g, _ in pieces], [_deltas(g >> np.uint64(20)) for g, _ in pieces], [press(c.astype("<u4").tobytes()) for _, c in pieces]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["range", "block", "least", "groups", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            parts = [_numbers(groups, (first % (1 << 64)) >> 20) for _, first, groups, _ in held]
            counts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(c), "<u4") for *_, c in held]
            flat, n = np.concatenate(parts), np.concatenate(counts).astype(np.int64)
            order = np.argsort(flat, kind="stable")
            groups, first = np.unique(flat[order], return_index=True)
            often = groups[np.add.reduceat(n[order], first) >= least]
            told = [(block, part[np.isin(part, often)]) for (block, *_), part in zip(held, parts)]
            told = [(block, part) for block, part in told if len(part)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in told], pa.int64()), pa.array([part.tobytes() for _, part in told], pa.binary())], ["block", "groups"])

        for batch in small_batches(batches):
            for where, *row in zip(*[batch.column(c).to_pylist() for c in range(5)]):
                if where != now:
                    if held:
                        yield close()
                    now, held = where, []
                held.append(row)
        if held:
            yield close()

    pieces = relation.mapInArrow(run, "range long, block long, least long, groups binary, counts binary").repartition("range").sortWithinPartitions("range")
    return pieces.mapInArrow(count, "block long, groups binary").groupBy("block").agg(F.collect_list("groups").alias("groups"))


def _extended(relation: DataFrame, k: int, least: int, words: int) -> DataFrame:
    """R_k of frequent groups from R_(k-1)."""
    frequent = _frequent(relation, k, least, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for r in range(batch.num_rows):
                block, lang, *packed, groups = (batch.column(c)[r].as_py() for c in (0, 1, 3, 4, 5, 6))
                at, phrase, phrases = _unpacked(*packed)
                at, left, right = _joined(at, phrase, k)
                group = _group(_hashed(phrases, lang), left, right, k) >> np.uint64(20)
                order = np.sort(np.frombuffer(b"".join(groups), "<u8"))
                stays = order[np.minimum(np.searchsorted(order, group), len(order) - 1)] == group
                at, pair = at[stays], left[stays].astype(np.int64) << 32 | right[stays]
                pairs, number = np.unique(pair, return_inverse=True)
                ends = (pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()
                made = [phrases[i] if k == 1 else phrases[i] + b" " + phrases[j].rpartition(b" ")[2] for i, j in zip(*ends)]
                yield _rows([_packed(block, lang, at, number, made)])

    return relation.join(frequent, "block").select("block", "lang", "n", "at", "phrase", "phrases", "groups").mapInArrow(run, RELATION)


def _counted(relation: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of a relation, by their words: exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for lang, *packed in zip(*[batch.column(c).to_pylist() for c in (1, 3, 4, 5)]):
                _, phrase, made = _unpacked(*packed)
                n = np.bincount(phrase, minlength=len(made))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(made), pa.string()), pa.array([x.decode("utf-8", "surrogatepass") for x in made], pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "f"])

    return relation.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(f"f >= {least}")


def phrase_counts(docs: DataFrame, longest: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): (lang, k, phrase, f) of the phrases of up to ``longest`` words with f >= ``least``, and (lang, n) of all words."""
    relation = written(occurrences(docs))
    totals = written(relation.groupBy("lang").agg(F.sum("n").alias("n")))
    words = totals.agg(F.sum("n")).first()[0] or 0
    counts = []
    for k in range(1, longest + 1):
        longer = written(_extended(relation, k, least, words))
        released(relation)
        relation = longer
        counts.append(written(_counted(relation, least).withColumn("k", F.lit(k))))
    released(relation)
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found, totals


def _parts(start: str, length: str):
    """``length`` words of a phrase from ``start`` (from 1)."""
    return F.array_join(F.slice("words", F.expr(start), F.expr(length)), " ")


def collocations(docs: DataFrame, top: int = 2000, longest: int = 4, least: int = 30) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language.

    A-Z are lower-cased; texts split at ``.,;:!?`` and line ends into pieces and these at spaces and tabs into words. Phrases of 2 to
    ``longest`` words that occur a >= ``least`` times within pieces, overlaps included, are scored by their lowest cut (l and r: counts of its
    parts; ties to the shortest first part) as floor(2000000 * a / (l + r)), in whole numbers. A phrase inside a longer one with 80 % of
    its count is dropped. Ties of score go by a, then by the phrase's UTF-8 bytes. A null lang is ``und``; null and
    empty texts have no words; repeated rows and doc_ids count each; an empty table gives no rows; other columns are ignored.
    """
    counts, totals = phrase_counts(docs, longest, least)
    rows = counts.where("k > 1").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))
    cuts = rows.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _parts("1", "cut").alias("first"), _parts("cut + 1", "size(words) - cut").alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))

    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    holders = rows.where("k > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer"))
    most = holders.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = F.coalesce(F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * 80, F.lit(False))
    kept = lowest.join(most, ["lang", "phrase"], "left").where(~held).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
