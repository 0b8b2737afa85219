"""N-gram Jaccard join (operator 6): an exact metric-space join by pivots, regions, windows and recursion.

Documents are sets of five-word shingles under the Jaccard distance; equal sets are one class. Unrelated
documents all lie at distance 1 from each other, so the first pivots are single shingles {s}: a set is nearer
than 1 to {s} only if it holds s. In one global order (frequent shingles last) a link can cross only into the
regions of a set's first n - ceil(0.8 n) + 1 shingles, its window. With n // 10 shingles more, two linked
sets share 1 + ceil(0.8 n) // 10 of their windows at least, so a set with fewer that any other set holds is linked
with nothing and leaves before any text moves. In each region left, the class of which others hold most is
its document pivot p; regions of one pivot are joined as one.

Small regions are joined inside a task, about one pivot after the other. A large one gets several
pivots, and exact distances to all of them: sets within 0.2 of a pivot are linked with it and one
component; every set falls into the Voronoi cell of its nearest pivot, cells are cut into blocks, and a
block meets another one only where the triangle inequality about every pivot allows a distance of
0.2: those windows replicate it. Pairs of blocks are joined as small regions are, but for what is one component already.
Where boilerplate holds a region together (many sets near each other, linked with no pivot) no pivot parts it; there
the shingles that most hold are set aside, each set's need is lowered by what they can give, and the filter by shared
shingles runs again over what is left, recursively.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_words, mix, released, signed, small_batches, spread_join, texts_of, written
from .components import components

K, PERCENT = 5, 80
#: The window's surplus is n // SURPLUS shingles.
SURPLUS = 10
#: Pivots of a large region.
PIVOTS = 8
#: Members of a crowded region by which its common shingles are told.
SAMPLE = 32
#: Least sizes of the bands of a crowded region: four to a factor of 1.25.
_BANDS = np.unique(np.ceil(1.25 ** (np.arange(400) / 4)).astype(np.int64))
_ODD = mix(np.arange(1, K + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's five-word shingles (fewer words: the whole as one)."""
    h, _ = hash_words((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    k = min(K, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += h[i : i + n] * _ODD[i]
    return np.unique(mix(total))


def linked(inter, left, right):
    return 100 * inter >= PERCENT * (left + right - inter)


def region_links(sets: list[np.ndarray], side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that, with the components known before, connect exactly the sets that chains of links connect.

    Where ``side`` has two values, only sets of different sides meet. Sets of one ``label`` (from 0) are known
    to be one component. Shingles of one set alone are in no intersection; a set that holds less than 0.8 of
    its size in others can't link and is left out. Pivots go by falling overlap with the region. A pivot meets
    only the sets after it that are not in its component yet and that the triangle inequality about the first
    pivot lets link to it.
    """
    side = np.zeros(len(sets), np.int64) if side is None else side
    label = np.full(len(sets), -1) if label is None else label
    crossed = bool(side.min() != side.max())
    sizes = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(sets)
    values, counts = np.unique(flat, return_counts=True)
    values, counts = values[counts > 1], counts[counts > 1]
    if not len(values):
        return []
    code = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    held = values[code] == flat
    common = np.add.reduceat(np.where(held, counts[code], 1), first) / sizes
    codes = [code[i : i + n][held[i : i + n]] for i, n in zip(first, sizes)]
    n_held = np.array([len(c) for c in codes])
    order = np.argsort(common, kind="stable")[::-1]
    order = order[100 * n_held[order] >= PERCENT * sizes[order]]
    component, away = np.where(label >= 0, len(sets) + label, np.arange(len(sets))), np.zeros(len(sets))
    in_pivot = np.zeros(len(values), bool)
    edges: list[tuple[int, int]] = []
    for k, pivot in enumerate(order[:-1]):
        rest = order[k + 1 :]
        if k:
            meets = (component[rest] != component[pivot]) & (np.abs(away[rest] - away[pivot]) <= 0.2 + 1e-9)
            rest = rest[meets & (side[rest] != side[pivot])] if crossed else rest[meets]
        if not len(rest):
            continue
        in_pivot[codes[pivot]] = True
        starts = np.concatenate([[0], np.cumsum(n_held[rest])[:-1]])
        inter = np.add.reduceat(in_pivot[np.concatenate([codes[i] for i in rest])].astype(np.int64), starts)
        in_pivot[codes[pivot]] = False
        if k == 0:
            away[rest] = 1 - inter / (sizes[pivot] + sizes[rest] - inter)
        near = rest[linked(inter, sizes[pivot], sizes[rest])]
        near = near[(component[near] != component[pivot]) & ((not crossed) | (side[near] != side[pivot]))]
        edges += [(int(pivot), int(i)) for i in near]
        component[np.isin(component, component[near])] = component[pivot]
    return edges


def _sets(docs: DataFrame) -> DataFrame:
    """kind 0: (row, doc_id, n, a, b, text), a set's size and 128-bit hash; kind 1: (n, a), shingles frequent in a task."""
    names = ["kind", "doc_id", "n", "a", "b", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([*held.values(), np.zeros(0, np.uint64)]), return_counts=True)
            many = counts >= 8
            n = int(many.sum())
            return pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(counts[many], pa.int64()), pa.array(signed(values[many]), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names)

        size = 0
        for batch in small_batches(batches, 4 << 20):
            sets = [shingles(t) for t in texts_of(batch)]
            a = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            b = np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(a), pa.int64()), pa.array(signed(b), pa.int64()), batch.column(1)], names)
            for key, s in zip(a.tolist(), sets):
                size += len(s) if key not in held else 0
                held[key] = s
            if size > 2_000_000:
                yield frequent()
                held, size = {}, 0
        yield frequent()

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind int, doc_id long, n long, a long, b long, text string")
    return written(found.select(F.monotonically_increasing_id().alias("row"), "*"))


def _window_rows(sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, cls, salt, first): the window of each set and its surplus; ``first`` is false for the surplus.

    ``frequent`` shingles (rarest first) come last in the order; they are shared anyhow, so their rows are dealt
    over many tasks by a salt from 1, others have salt 0. A task gives the rows of equal sets once. The filter
    drops nothing, but keeps the planner from adding a different one to each use, so that both share one pass.
    """
    order = np.argsort(frequent)
    shared = sets.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = shared.value
        seen: set[int] = set()
        for batch in small_batches(batches, 4 << 20):
            keys, owners, salts, firsts = [], [], [], []
            for cls, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                if cls in seen:
                    continue
                seen.add(cls)
                s = shingles(text)
                window = len(s) - -(-PERCENT * len(s) // 100) + 1
                taken = window + len(s) // SURPLUS
                salt = np.zeros(len(s), np.int32)
                if len(late):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    hot = late[at] == s
                    if hot.any():
                        s = np.concatenate([s[~hot], s[hot][np.argsort(rank[at[hot]])]])
                        salt[len(s) - int(hot.sum()) :] = 1 + cls % 64
                keys.append(s[:taken])
                salts.append(salt[:taken])
                owners.append(np.full(len(keys[-1]), cls, np.int64))
                firsts.append(np.arange(len(keys[-1])) < window)
            if keys:
                columns = [signed(np.concatenate(keys)), np.concatenate(owners), np.concatenate(salts), np.concatenate(firsts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "cls", "salt", "first"])

    rows = sets.where("n > 0").select("a", "text").mapInArrow(run, "key long, cls long, salt int, first boolean")
    return rows.where("key IS NOT NULL AND cls IS NOT NULL AND salt IS NOT NULL AND first IS NOT NULL").repartition("key", "salt")


def _candidates(sets: DataFrame, reps: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, rep, n, share) of the windows of all classes that may link; share is how much of its window others hold.

    A class stays if other classes hold as many shingles of its window as any partner must. Regions are cut
    by set size: linked sets differ in size by a quarter at most, the triangle inequality about the empty
    set. Sizes fall into bands of a factor 1.25, and every row goes to its own band and to the next.
    """
    rows = _window_rows(sets, frequent)
    some = F.max("first").alias("some")  # the same columns in both uses of ``rows``
    blocks = rows.groupBy("key", "salt").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), some).where("some IS NOT NULL AND (least <> most OR salt > 0)")
    shared = written(rows.join(blocks.select("key", "salt"), ["key", "salt"]).distinct())
    held = shared.groupBy("cls").agg(F.count("*").alias("held"))
    able = held.join(reps.select(F.col("a").alias("cls"), "rep", "n"), "cls").where(f"held >= 1 + ({PERCENT} * n + 99) div 100 div {SURPLUS}")
    able = able.select("cls", "rep", "n", F.expr("cast(1000 * held div n as int)").alias("share"))
    band = F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9).cast("int")
    banded = shared.where("first").join(able, "cls").select("key", "rep", "n", "share", F.explode(F.array(band, band + 1)).alias("band"))
    banded = written(banded.select(F.xxhash64("key", "band").alias("key"), "rep", "n", "share"))
    released(shared)
    return banded


def _members(rows: DataFrame) -> DataFrame:
    """(p, rep, n, times, weight): the members of each document pivot's region, its count and sum of n.

    The pivot of a shingle's region is the class of which others hold most: the middle of a
    group of near copies rather than its edge.
    """
    pivots = rows.groupBy("key").agg(F.max(F.struct("share", "rep")).alias("top"), F.count("*").alias("times")).where("times > 1")
    pivots = written(pivots.select("key", F.col("top.rep").alias("p"), "times"))
    members = written(spread_join(rows.select("key", "rep", "n"), pivots, ["key"]).select("p", "rep", "n").distinct())
    sizes = written(members.groupBy("p").agg(F.count("*").alias("times"), F.sum("n").alias("weight")).where("times > 1"))
    sized = written(spread_join(members, sizes, ["p"]))
    released(rows, pivots, members, sizes)
    return sized


def _joined(members: DataFrame) -> DataFrame:
    """Links (u, v) inside parts: members (part, side, label, rep, text), each part whole in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            sides, labels, reps, sets = zip(*held)
            edges = region_links(list(sets), np.array(sides), np.array(labels))
            return pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in edges], pa.int64()), pa.array([reps[j] for _, j in edges], pa.int64())], ["u", "v"])

        for batch in small_batches(batches, 4 << 20):
            for part, side, label, rep, text in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if part != now:
                    if len(held) > 1:
                        yield close()
                    now, held = part, []
                held.append((side, label, rep, shingles(text)))
        if len(held) > 1:
            yield close()

    return members.select("part", "side", "label", "rep", "text").repartition("part").sortWithinPartitions("part").mapInArrow(run, "u long, v long")


def _dealt(members: DataFrame, texts: DataFrame, first: int, small: int, weight: int) -> DataFrame:
    """(p, salt, k, rep, text), sorted within tasks: each region's members (k = 0) in shares, ``first`` of them (k < 0) before each share."""
    order = Window.partitionBy("p").orderBy((F.col("rep") != F.col("p")), F.xxhash64("rep"))
    leading = members.withColumn("k", F.row_number().over(order)).where(f"k <= {first}")
    tasks = F.ceil(F.greatest(F.col("times") / small, F.col("weight") / weight)).cast("int")
    shares = members.select("p", F.pmod(F.xxhash64("rep"), tasks).cast("int").alias("salt"), F.lit(0).alias("k"), "rep")
    asked = leading.select("p", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"), (F.col("k") - first - 1).alias("k"), "rep")
    rows = shares.unionByName(asked).join(texts, "rep").select("p", "salt", "k", "rep", "text")
    return rows.repartition("p", "salt").sortWithinPartitions("p", "salt", "k")


def _star(members: DataFrame, texts: DataFrame, small: int, weight: int) -> DataFrame:
    """(p, rep, n, near, label, home, d): distances d of each member to the region's pivots, the nearest, and the linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots = None, []
        for batch in small_batches(batches, 4 << 20):
            out = []
            for p, salt, k, rep, text in zip(*[batch.column(c).to_pylist() for c in range(5)]):
                if (p, salt) != now:
                    now, pivots = (p, salt), []
                s = shingles(text)
                if k < 0:
                    pivots.append((rep, s))
                    continue
                inter = np.array([len(np.intersect1d(s, q, assume_unique=True)) for _, q in pivots])
                sizes = np.array([len(q) for _, q in pivots])
                d = 1 - inter / (len(s) + sizes - inter)
                near = np.flatnonzero(linked(inter, len(s), sizes))
                out.append((p, rep, len(s), [pivots[i][0] for i in near], int(near[0]) if len(near) else -1, int(d.argmin()), d.tolist()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["p", "rep", "n", "near", "label", "home", "d"])

    found = _dealt(members, texts, PIVOTS, small, weight).mapInArrow(run, "p long, rep long, n long, near array<long>, label int, home int, d array<double>")
    return written(found)


def _residual(members: DataFrame, texts: DataFrame, small: int, weight: int) -> DataFrame:
    """(key, rep, n, share) of crowded regions: the shingles by which their members may still link.

    C, the shingles that half of ``SAMPLE`` members hold, stands for the region's boilerplate. Of the overlap
    that sets x and y need, C gives no more than the smaller of |x & C| and |y & C|, so what is left of the need falls on
    their other shingles, whatever C is: it decides cost, not links. A set meets its smaller or equal partners in bands of size,
    each with a least need; in one order of the shingles outside C, the rarest of the sample first, two linked sets
    share one of their first rest - need + 1. Where C alone may meet the need, all of them count, and a key of the band
    itself joins the sets for which this holds. A key without a set of its own band, or with one set, links nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sample, values, counts = None, [], None, None
        for batch in small_batches(batches, 1 << 20):
            keys, reps, sizes, homes = [], [], [], []
            for p, salt, k, rep, text in zip(*[batch.column(c).to_pylist() for c in range(5)]):
                if (p, salt) != now:
                    now, sample, values = (p, salt), [], None
                s = shingles(text)
                if k < 0:
                    sample.append(s)
                    continue
                if values is None:
                    values, counts = np.unique(np.concatenate(sample), return_counts=True)
                at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                often = np.where(values[at] == s, counts[at], 0)
                common = 2 * often >= len(sample)
                n, held = len(s), int(common.sum())
                rest = s[~common][np.argsort(often[~common], kind="stable")]
                least = -(-PERCENT * n // 100)
                own = int(np.searchsorted(_BANDS, n, "right"))
                for band in range(int(np.searchsorted(_BANDS, least, "right")), own + 1):
                    need = -(-PERCENT * (n + max(least, int(_BANDS[band - 1]))) // (100 + PERCENT)) - held
                    place = mix(mix(np.array([p], np.int64).view(np.uint64)) + np.uint64(band))
                    taken = mix(rest[: len(rest) - max(need, 1) + 1] + place) if need <= len(rest) else rest[:0]
                    taken = np.concatenate([taken, place]) if need <= 0 else taken
                    keys.append(taken)
                    reps.append(np.full(len(taken), rep, np.int64))
                    sizes.append(np.full(len(taken), n, np.int64))
                    homes.append(np.full(len(taken), band == own))
            if keys:
                columns = [signed(np.concatenate(keys)), np.concatenate(reps), np.concatenate(sizes), np.concatenate(homes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "rep", "n", "home"])

    rows = written(_dealt(members, texts, SAMPLE, small, weight).mapInArrow(run, "key long, rep long, n long, home boolean"))
    keys = written(rows.groupBy("key").agg(F.count("*").alias("times"), F.max("home").alias("home")).where("times > 1 AND home").select("key", "times"))
    kept = written(spread_join(rows, keys, ["key"]).select("key", "rep", "n"))
    shares = kept.groupBy("rep").agg(F.count("*").cast("int").alias("share"))
    found = written(kept.join(shares, "rep").select("key", "rep", "n", "share"))
    released(rows, keys, kept)
    return found


def _large(members: DataFrame, texts: DataFrame, small: int, weight: int) -> DataFrame:
    """Links (u, v) of large regions, by the distances of all members to several pivots.

    A region is crowded where more than 2 * ``small`` members are linked with none of its pivots: such sets are parted by
    ``_residual`` into regions of their own, again and again while that halves their rows. Other regions, and what
    it parts no more, meet by blocks.
    """
    links, before = [], None
    while True:
        star = _star(members, texts, small, weight)
        links.append(star.select(F.explode("near").alias("u"), F.col("rep").alias("v")))
        sizes = written(star.groupBy("p").agg(F.count("*").alias("times"), F.sum("n").alias("weight"), F.sum((F.col("label") < 0).cast("long")).alias("open")))
        star = spread_join(star, sizes, ["p"])
        crowded = f"open > {2 * small}"
        rows = sizes.where(crowded).agg(F.sum("times")).first()[0] or 0
        if not rows or (before is not None and 2 * rows > before):
            return reduce(DataFrame.unionByName, [*links, _voronoi(star, texts, small, weight)])
        links.append(_voronoi(star.where(f"NOT {crowded}"), texts, small, weight))
        parted = _members(_residual(star.where(crowded).select("p", "rep", "n", "times", "weight"), texts, small, weight))
        inside = f"times <= {small} AND weight <= {weight}"
        labels = star.where("label >= 0").groupBy("rep").agg(F.min(F.element_at("near", 1)).alias("label"))
        own = parted.where(inside).join(labels, "rep", "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long")))
        links.append(_joined(own.join(texts, "rep").select(F.col("p").alias("part"), F.lit(0).alias("side"), "label", "rep", "text")))
        members, before = parted.where(f"NOT ({inside})"), rows


def _voronoi(star: DataFrame, texts: DataFrame, small: int, weight: int) -> DataFrame:
    """Links (u, v) between blocks of Voronoi cells that no pivot of the region parts; those with pivots are known."""
    cell = ["p", "label", "home", "band"]
    home = F.when(F.col("label") >= 0, F.col("label")).otherwise(F.col("home"))
    placed = star.select("p", "rep", "n", "label", home.alias("home"), F.floor(10 * F.get("d", home)).cast("int").alias("band"), "d")
    cells = written(placed.groupBy(*cell).agg(F.count("*").alias("times"), F.sum("n").alias("weight")))
    blocks = F.ceil(F.greatest(2 * F.col("times") / small, 2 * F.col("weight") / weight)).cast("int")
    placed = spread_join(placed, cells, cell).withColumn("block", F.struct("label", "home", "band", F.pmod(F.xxhash64("rep"), blocks).alias("i")))
    placed = written(placed.select("p", "block", "rep", "label", "d"))
    ranges = placed.groupBy("p", "block").agg(*[f(F.get("d", F.lit(k))).alias(f"{name}{k}") for k in range(PIVOTS) for f, name in ((F.min, "lo"), (F.max, "hi"))])
    left, right = ranges.alias("l"), ranges.alias("r")
    meets = (F.col("l.p") == F.col("r.p")) & (F.col("l.block") <= F.col("r.block"))
    for k in range(PIVOTS):  # no pivot parts them; absent pivots are null
        for one, other in (("l", "r"), ("r", "l")):
            meets &= F.coalesce(F.col(f"{one}.lo{k}") - F.col(f"{other}.hi{k}") <= 0.2 + 1e-9, F.lit(True))
    apart = (F.col("l.block.label") < 0) | (F.col("l.block.label") != F.col("r.block.label"))
    pairs = left.join(right, meets & apart).select("l.p", F.col("l.block").alias("one"), F.col("r.block").alias("other"))
    pairs = pairs.withColumn("part", F.xxhash64("p", "one", "other"))
    sides = pairs.select("p", "part", F.lit(0).alias("side"), F.col("one").alias("block")).unionByName(pairs.where("one <> other").select("p", "part", F.lit(1).alias("side"), F.col("other").alias("block")))
    parts = placed.select("p", "block", "rep", "label").join(sides, ["p", "block"]).join(texts, "rep")
    return _joined(parts)


def jaccard_links(docs: DataFrame, small: int = 280, weight: int = 600_000, frequent: int = 16_384) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links): (row, doc_id, n, a, b) of each row of docs; (a, b, n, rep, least, times) of each class
    of equal sets: its first row, smallest doc_id and count; and links (u, v) between reps.

    Regions of more than ``small`` sets or ``weight`` shingles are joined by Voronoi cells: the bounds set a
    task's memory, not the result. ``frequent`` bounds the shingles that come last; any order gives the same links.
    """
    found = _sets(docs)
    often = found.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(frequent).collect()
    hot = np.array([r.a for r in reversed(often)], np.int64).view(np.uint64)
    sets = written(found.where("kind = 0").select("row", "doc_id", "n", "a", "b"))  # the texts go once they are copied
    reps = written(sets.where("n > 0").groupBy("a", "b", "n").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("times")))
    rows = _candidates(found.where("kind = 0"), reps, hot)
    members = _members(rows)
    texts = written(found.where("kind = 0").select(F.col("row").alias("rep"), "text").join(members.select("rep").distinct(), "rep"))
    released(found)
    inside = f"times <= {small} AND weight <= {weight}"
    links = _joined(members.where(inside).join(texts, "rep").select(F.col("p").alias("part"), F.lit(0).alias("side"), F.lit(-1).alias("label"), "rep", "text"))
    large = members.where(f"NOT ({inside})")
    if not large.isEmpty():
        some = written(texts.join(large.select("rep").distinct(), "rep"))
        links = links.unionByName(_large(large, some, small, weight))
    links = written(links.where("u <> v").distinct())
    released(members, texts)
    return sets, reps, links


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for every row of ``docs``.

    Null, empty and blank texts have no shingles and are alone: their component_id is their doc_id. Equal texts
    are linked at once, whatever their number. Rows are told apart by a number of their own: repeated rows give
    repeated rows, rows of one doc_id with different texts link each for itself, and a row without a doc_id
    links like others; a component of such rows alone has a null component_id. An empty table gives no rows; other
    columns are ignored. Whole texts are used.
    """
    sets, reps, links = jaccard_links(docs)
    found = components(links)
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("times"))
    classes = written(spread_join(named.select("a", "b", "n", "component", F.col("times").alias("rows")), written(least), ["component"]).select("a", "b", "n", "component_id", F.col("rows").alias("times")))
    some = spread_join(sets.where("n > 0"), classes, ["a", "b", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
