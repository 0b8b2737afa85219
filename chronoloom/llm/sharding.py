"""Sharding (operator 8): proportional stratified interleaving, law ``rows``; DataFrame functions only.

Rows are shuffled by a seeded hash within their source and ranked there; the fractional rank
(rank + 1/2) / rows-of-source interleaves all sources in proportion, and equal cuts of that order
give every shard the mixture of the whole. A global rank never sorts a source in one task: hashes
(or fractions) fall into buckets, a prefix sum over the bucket counts gives each bucket its offset,
and rows are numbered inside small buckets only. Only ids, sizes and checksums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def _positions(rows: DataFrame, group: list[str], order: list[Column], total: bool) -> DataFrame:
    """Adds pos (rank from 0 by bucket ``b``, then ``order``, within ``group``) and, if asked, n_group."""
    counts = rows.groupBy(*group, "b").agg(F.count("*").alias("n"))
    per = Window.partitionBy(*group) if group else Window.partitionBy()
    offsets = counts.withColumn("off", F.coalesce(F.sum("n").over(per.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        offsets = offsets.withColumn("n_group", F.sum("n").over(per))
    inside = F.row_number().over(Window.partitionBy(*group, "b").orderBy(*order)) - 1
    return rows.join(offsets.drop("n"), [*group, "b"]).withColumn("pos", F.col("off") + inside).drop("off", "b")


def _copies(rows: DataFrame) -> DataFrame:
    """Numbers equal rows from 0 (copy). They are alike, so they are counted for each task that read them and told apart anew:
    a group of any size is one row a task until then, and what one task read is all that one task brings back.
    """
    keys = rows.columns
    counts = rows.withColumn("task", F.spark_partition_id()).groupBy(*keys, "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).repartition(*keys, "task")
    return offsets.select(*keys, F.explode(F.sequence("off", F.col("off") + F.col("n") - 1)).alias("copy"))


def stratified_shards(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_rows: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and source for every row of ``docs``.

    Row counts of shards differ by one at most; slots of a shard run from 0 without gaps. A null
    source is a stratum of its own; a null text has size 1 and the checksum of the empty text.
    Repeated rows and ids are rows like others, and repeats are spread as others are, with or without a doc_id; an empty table gives no rows; other columns are
    ignored. grown_shard is null under this law. Equal texts are not kept together: a group larger
    than a shard could not be under the law.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    hashed = [F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    r = F.when(F.col("copy") == 0, F.xxhash64(*hashed)).otherwise(F.xxhash64(*hashed, F.col("copy")))
    rows = written(_copies(plain).withColumn("r", r).drop("copy"))
    n = rows.count()
    buckets = max(16, min(65_536, n // bucket_rows))
    rows = rows.withColumn("stratum", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
    rows = rows.withColumn("b", F.floor((F.shiftrightunsigned("r", 1) / F.lit(float(1 << 63))) * buckets).cast("int"))
    ties = [F.col(c) for c in ("r", "doc_id", "text_crc32", "size")]
    ranked = _positions(rows, ["stratum"], ties, total=True).withColumn("fraction", (F.col("pos") + 0.5) / F.col("n_group")).drop("pos")
    ranked = ranked.withColumn("b", F.floor(F.col("fraction") * buckets).cast("int"))
    placed = _positions(ranked, [], [F.col("fraction"), F.col("stratum"), *ties], total=False)
    shard = F.expr(f"pos * {shards} div {max(1, n)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("pos") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
