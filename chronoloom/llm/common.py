"""What several training-data operators share: shared-folder tables, word splitting and hashing.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout; ``bytes.split()`` cuts at exactly these six
characters and ``bytes.lower()`` folds exactly A-Z, so both run at C speed on UTF-8 bytes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else by ``setCheckpointDir``."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-")  # one machine, as in tests
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables made by ``written``, once all that is to come from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def hot_from(total: int, parts: int = 1000, many: int = 1_000_000, most: int = 500_000) -> float:
    """More rows than this make a key hot, of ``total``: more than one in ``parts``, or than ``many``.

    Fewer than ``total`` divided by it can be hot; of huge tables it is raised until that is ``most``, a bound for a broadcast.
    """
    return min(total / parts, max(many, total / most))


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], **bounds: int) -> DataFrame:
    """``rows`` joined with ``values``: a row for each key and, as ``times``, how many rows have it at least.

    Keys of many rows would fill a task. ``hot_from`` bounds the number of such keys, whatever the data, so their
    values are broadcast and their rows stay where they are; the others are shuffled. ``values`` must be a written
    table of narrow rows.
    """
    least = hot_from(values.agg(F.sum("times")).first()[0] or 0, **bounds)
    hot = values.where(F.col("times") > least)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rest.join(values.where(F.col("times") <= least), keys).unionByName(rows.join(F.broadcast(hot), keys))


def row_hashes(text) -> list:
    """th and tg: two 64-bit hashes of a text with different seeds, which tell texts apart as one of 128 bits does."""
    return [F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("tg")]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that the low and high bits of sums are usable as keys."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words and bytes up to which powers are kept in a worker; longer runs make their own and give them back.
_KEPT = 1 << 18


@lru_cache(maxsize=2)
def _kept(base: np.uint64) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(_KEPT, base))])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n - 1, at least."""
    return _kept(base) if n <= _KEPT else np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base))])


class Spans:
    """Hashes of any span of a word-hash sequence in constant time (prefix polynomial, mod 2**64)."""

    unit = _INVERSE

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.down = _powers(_INVERSE, n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * _powers(_BASE, n + 1)[:n])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (np.asarray(end) - np.asarray(start)).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + length)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


_GAP = re.compile(rb"[ \t-\r]")


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start positions of the words of a text, from prefix sums over pieces of its bytes."""
    hashes, starts, at = [], [], 0
    while at < len(data) or not hashes:
        gap = _GAP.search(data, at + _KEPT - 1)  # a piece ends at a white space
        end = gap.start() if gap and len(data) - at > _KEPT else len(data)
        h, start = _hash_piece(data[at:end])
        hashes.append(h)
        starts.append(start + at)
        at = max(end, at + 1)
    return np.concatenate(hashes), np.concatenate(starts)


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[0::2], edges[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(_BASE, n + 1)[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64)), start


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, so that a task's memory is bounded."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
