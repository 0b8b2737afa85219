"""Line dedup (operator 2): a deletion-neighbourhood join over word sequences, earliest line kept.

Two lines repeat each other if their words are equal, or if both have at least ``near_words`` words and
one inserted, deleted or changed word makes them equal. Equal lines meet by a 128-bit hash. For
the others, a line emits its words' hash and the hashes of itself without one word; a changed word makes
two variants without the same place equal, an inserted one makes a variant equal to the other line. One
edit leaves the first or the last half of a line alone, so lines of which no half stands in another
line of fitting length emit nothing, and the others only the variants of the other half. Equal
variants are joined by the earliest line of each key, an aggregate, never as pairs; what matches is
verified as an edit distance of one between the words themselves. Halves, variants and lines that very many
rows have are joined where those rows stand (``spread_join``), so that none fills a task. Lines go by a number
there, not by document, text hashes and place, which would be most of what is moved; the numbers of lines with
variants are in the order of the lines, so the smallest is the earliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, hash_words, mix, released, row_hashes, signed, small_batches, spread_join, texts_of, written

NEAR = 8
_SALT = np.uint64(0x5851F42D4C957F2D)
LAST = 2**63 - 1


#: What names a row: its doc_id, and 128 bits of its text, which tell rows of one doc_id, or without one, apart.
ROW = ["doc_id", "th", "tg"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, tg, text): a null doc_id counts as the last one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.coalesce("id", F.lit(LAST)).alias("doc_id"), *row_hashes("text"), "text")


def at():
    """What names a line."""
    return F.struct("doc_id", "line_no", "th", "tg")


def half_keys(spans: Spans, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Keys of a line's halves: first and last as of its own length, then as of a line one word longer."""
    out = []
    for length in (n, n - 1):
        half = length // 2
        tag = mix(length.astype(np.uint64))
        out += [mix(spans.of(start, start + half) + tag), mix(spans.of(start + n - (length - half), start + n) ^ tag)]
    return out


def _lines(keyed: DataFrame) -> DataFrame:
    names = [*ROW, "line_no", "n", "h", "g", "halves"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            row = [batch.column(k).to_numpy() for k in range(3)]
            texts = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts_of(batch)]
            data = b"".join(texts)
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
            tops = np.cumsum([0, *map(len, texts)])
            owner = np.searchsorted(tops, ends, side="right") - 1
            number = np.arange(len(ends)) - np.searchsorted(ends, tops[owner])
            hashes, at = hash_words(data)
            until = np.searchsorted(at, ends)
            start = np.concatenate([[0], until[:-1]])
            n = until - start
            some = n > 0
            owner, number, n, start = owner[some], number[some], n[some], start[some]
            first, second = Spans(hashes), Spans(hashes ^ _SALT)
            keys = np.stack(half_keys(first, start, np.maximum(n, 1)), axis=1)
            valid = np.stack([n >= NEAR, n >= NEAR, n > NEAR, n > NEAR], axis=1)
            halves = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(valid.sum(axis=1))]).astype(np.int32)), pa.array(signed(keys[valid])))
            columns = [*(c[owner] for c in row), number.astype(np.int32), n.astype(np.int32), signed(first.of(start, start + n)), signed(second.of(start, start + n))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), halves], names)

    return keyed.mapInArrow(run, "doc_id long, th long, tg long, line_no int, n int, h long, g long, halves array<long>")


def variant_keys(hashes: np.ndarray, shared: int) -> list[tuple[int, np.ndarray]]:
    """(kind, keys) of a line; ``shared`` has a bit for each of its four half keys that stands elsewhere.

    Kind 0: without word j, keyed by j too (a changed word); 1: the whole; 2: without word j (an
    inserted word).
    """
    n = len(hashes)
    powers = Spans(hashes)
    sums, unit = powers.sums, Spans.unit
    j = np.arange(n)
    without = sums[j] + (sums[n] - sums[j + 1]) * unit
    out = []
    if shared & 3:
        at = j[(j >= n // 2) if not shared & 2 else (j < n // 2) if not shared & 1 else slice(None)]
        out += [(0, mix(without[at] ^ mix(at.astype(np.uint64) + np.uint64(n << 32)))), (1, mix(sums[[n]] + np.uint64(n)))]
    if shared & 12:
        half = (n - 1) // 2
        at = j[(j >= half) if not shared & 8 else (j <= half) if not shared & 4 else slice(None)]
        out.append((2, np.unique(mix(without[at] + np.uint64(n - 1)))))
    return out


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance of two word sequences is one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _variants(asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """(id, doc_id, line_no, th, tg, line, kinds, keys) of the asked lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            rows = []
            for doc, th, tg, text, wanted in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                for w in wanted:
                    line = lines[w["line_no"]]
                    made = variant_keys(hash_words(line)[0], w["shared"])
                    kinds = np.concatenate([np.full(len(k), kind, np.int32) for kind, k in made])
                    rows.append((w["id"], doc, w["line_no"], th, tg, line.decode("utf-8", "surrogatepass"), kinds, signed(np.concatenate([k for _, k in made]))))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["id", "doc_id", "line_no", "th", "tg", "line", "kinds", "keys"])

    lists = asked.groupBy(*ROW).agg(F.collect_list(F.struct("line_no", "shared", "id")).alias("wanted"))
    # texts are shuffled at every size, so that small runs show what large ones move; a table this narrow would be broadcast by its compressed size
    rows = keyed.join(lists.hint("merge"), ROW).select(*ROW, "text", "wanted")
    return rows.mapInArrow(run, "id long, doc_id long, line_no int, th long, tg long, line string, kinds array<int>, keys array<long>")


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [one_edit(a.encode().split(), b.encode().split()) for a, b in zip(texts_of(batch, "line"), texts_of(batch, "other"))]
            yield batch.filter(pa.array(good, pa.bool_()))

    left = pairs.join(lines.select("id", *ROW, "line_no", "line"), "id")
    both = left.join(lines.select(F.col("id").alias("first"), F.col("doc_id").alias("keep_doc_id"), F.col("line_no").alias("keep_line_no"), F.col("line").alias("other")), "first")
    flat = both.select(*ROW, "line_no", "keep_doc_id", "keep_line_no", "line", "other")
    return flat.mapInArrow(run, flat.schema).groupBy(*ROW, "line_no").agg(F.min(F.struct("keep_doc_id", "keep_line_no")).alias("keep"))


def _decided(keyed: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, th, tg, line_no, keep_doc_id, keep_line_no, edits) of every line that an earlier one repeats.

    Also the written tables it is read from, for release.
    """
    seen = written(_lines(keyed))
    firsts = seen.groupBy("h", "g", "n").agg(F.min(at()).alias("first"), F.min("halves").alias("halves"), F.count("*").alias("times"))
    firsts = written(firsts.withColumn("number", F.monotonically_increasing_id()))
    distinct = firsts.where(f"n >= {NEAR}").select("number", F.posexplode("halves").alias("bit", "half"))
    twice = written(distinct.groupBy("half").agg(F.count("*").alias("times")).where("times > 1"))
    shared = spread_join(distinct, twice, ["half"]).groupBy("number").agg(F.sum(F.expr("shiftleft(1, bit)")).cast("int").alias("shared"))
    asked = firsts.select("number", "first.*").join(shared, "number").orderBy("doc_id", "line_no", "th", "tg")
    asked = written(asked.select(F.monotonically_increasing_id().alias("id"), *ROW, "line_no", "shared"))  # in the order of at()
    lines = written(_variants(asked, keyed))
    rows = lines.select("id", F.explode(F.arrays_zip("kinds", "keys")).alias("v")).select("id", "v.kinds", "v.keys")
    least = written(rows.groupBy("keys").agg(*[F.min(F.when(F.col("kinds") == k, F.col("id"))).alias(f"m{k}") for k in range(3)], F.count("*").alias("times")).where("times > 1"))
    other = F.when(F.col("kinds") == 0, F.col("m0")).when(F.col("kinds") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = spread_join(rows, least, ["keys"]).select("id", other.alias("first")).where("first < id").distinct()
    near = _verified(pairs, lines).select(at().alias("first"), "keep")
    # lines that stand once and are near none leave here, before all lines are joined
    groups = written(firsts.select("h", "g", "n", "first", "times").join(near, "first", "left").where("times > 1 OR keep IS NOT NULL"))
    is_first = at() == F.col("first")
    found = spread_join(seen, groups, ["h", "g", "n"]).where(~is_first | F.col("keep").isNotNull()).select(
        *ROW,
        "line_no",
        F.when(is_first, F.col("keep.keep_doc_id")).otherwise(F.col("first.doc_id")).alias("keep_doc_id"),
        F.when(is_first, F.col("keep.keep_line_no")).otherwise(F.col("first.line_no")).alias("keep_line_no"),
        F.when(is_first, 1).otherwise(0).alias("edits"),
    )
    released(twice, asked, least, lines, firsts)  # groups is written
    return found, [seen, groups]


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), keep_doc_id, keep_line_no and edits (0 or 1) of every line to remove.

    A line goes if an earlier one (by doc_id, then line) has the same words, white space aside, or is
    one word edit away and both have at least eight words; the earliest such line is named. Lines
    without words never go. Null texts have no lines; a null doc_id counts as the last. Rows
    of equal doc_id and text are one document, so the same line stays in each; rows of one doc_id, or of none,
    with different texts are different documents (by line, then by the text's hash). An empty table
    gives no rows; other columns are ignored.
    """
    found, _ = _decided(_keyed(docs))
    return found.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "line_no", F.when(F.col("keep_doc_id") != LAST, F.col("keep_doc_id")).alias("keep_doc_id"), "keep_line_no", "edits")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, each text without its repeated lines; rows left without words by that go."""
    keyed = _keyed(docs)
    found, tables = _decided(keyed)
    gone = written(found.groupBy(*ROW).agg(F.collect_set("line_no").alias("gone")))
    released(*tables)
    row = F.struct("*").alias("row")
    rows = docs.select(row.withField("text", F.lit(None).cast("string")).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), *row_hashes(F.coalesce("text", F.lit(""))), F.split("text", "\n").alias("lines"))
    rows = rows.join(gone, ROW, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    text = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    out = rows.select(F.col("row").withField("text", F.when(F.col("lines").isNotNull(), text)).alias("row"), F.col("gone").isNull().alias("whole"))
    return out.where(F.col("whole") | F.col("row.text").rlike("\\S")).select("row.*")
