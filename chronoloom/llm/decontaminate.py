"""Benchmark decontamination (operator 5): size-partitioned MinHash containment search; DataFrame functions only.

Every benchmark item is a set of five-word shingles; one of fewer words is a single shingle, its whole sequence. Items fall into size partitions (powers of
two); an item's sketch holds its bottom-m MinHash values, with m set by the upper size of its
partition so that a document that contains 0.8 of the item's shingles holds at least one value of
the sketch: candidates lose nothing, however long the document. Documents stream their shingles
past the sketches; those with a hit then stream them past the items whose sketch they hit, for the
exact share of shingles, compared as strings. Only hits are shuffled. The items are broadcast while their shingles number at most
``broadcast_rows``; beyond that, both sides are shuffled by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 5
_SPACES = " \t\n\x0b\x0c\r"


def _words(text: str):
    return F.split(F.btrim(F.lower(text), F.lit(_SPACES)), "[ \\t\\n\\x0B\\f\\r]+")


def _shingles(rows: DataFrame, keys: list[str], text: str, sizes: list[int]) -> DataFrame:
    """(keys, h, joined): a row for each window of as many words as one of ``sizes``, its words lower-cased."""
    words = rows.select(*keys, _words(text).alias("words")).where("words[0] <> ''")
    out = None
    for k in sizes:
        windows = words.where(F.size("words") >= k).select(*keys, "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("i"))
        parts = [F.col("words")[F.col("i") + j] for j in range(k)]
        made = windows.select(*keys, F.xxhash64(*parts).alias("h"), F.concat_ws(" ", *parts).alias("joined"))
        out = made if out is None else out.unionByName(made)
    return out


def _hits(seen: DataFrame, keys: list[str], items: DataFrame, small: bool, also=True) -> DataFrame:
    """Rows of items for each equal shingle of ``seen``, with its keys; ``also`` is part of the join."""
    items = F.broadcast(items) if small else items
    return seen.alias("s").join(items.alias("i"), (F.col("s.h") == F.col("i.h")) & (F.col("joined") == F.col("shingle")) & also).select(*keys, "i.*")


def sketches(benchmark: DataFrame, share_percent: int = 80) -> DataFrame:
    """item_id, h, shingle, n_item, k and in_sketch for each distinct shingle (of k words) of each item."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL")
    long = F.size(_words("text")) >= K
    whole = rows.where(~long).select("item_id", _words("text").alias("words")).where("words[0] <> ''")
    parts = [F.get("words", F.lit(j)) for j in range(K - 1)]  # nulls after the end are left out of the hash, as in a shorter window
    short = whole.select("item_id", F.xxhash64(*parts).alias("h"), F.concat_ws(" ", "words").alias("shingle"), F.size("words").alias("k"))
    distinct = _shingles(rows.where(long), ["item_id"], "text", [K]).select("item_id", "h", F.col("joined").alias("shingle"), F.lit(K).alias("k")).unionByName(short).distinct()
    item = Window.partitionBy("item_id")
    sized = distinct.withColumn("n_item", F.count("*").over(item)).withColumn("bottom", F.row_number().over(item.orderBy("h", "shingle")))
    upper = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1).cast("long") - 1
    values = upper - F.ceil(upper * share_percent / 100) + 1
    return sized.select("item_id", "h", "shingle", "n_item", "k", (F.col("bottom") <= values).alias("in_sketch"))


def contained_items(docs: DataFrame, benchmark: DataFrame, share_percent: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment for each document that holds 0.8 of an item's shingles.

    An item of fewer than five words is held where its words stand in a row. Null, empty and blank texts match
    nothing, nor do items without an id. Rows of one doc_id (or item_id) count as one set; rows without a
    doc_id are told apart by their texts, and those of equal texts give one row. Empty tables give no rows;
    other columns are ignored.
    """
    items = sketches(benchmark, share_percent)
    counted = items.limit(broadcast_rows + 1).groupBy("k").count().collect()
    sizes, small = sorted(r["k"] for r in counted) or [K], sum(r["count"] for r in counted) <= broadcast_rows
    if not small:
        sizes = sorted(r["k"] for r in items.select("k").distinct().collect())
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("?"), F.md5("text"))).alias("key"), F.col("doc_id").cast("long"), "text").where("text IS NOT NULL")
    values = items.where("in_sketch").select("item_id", "h", "shingle")
    found = written(_hits(_shingles(docs.select("key", "text"), ["key"], "text", sizes), ["key"], values, small).groupBy("key").agg(F.collect_set("item_id").alias("candidates")))
    keys = ["key", "doc_id"]
    seen = _shingles(docs.join(found, "key"), [*keys, "candidates"], "text", sizes)
    hits = _hits(seen, [*keys, "candidates"], items.drop("k"), small, F.array_contains("candidates", F.col("item_id")))
    once = hits.groupBy(*keys, "item_id", "h", "shingle").agg(F.max("n_item").alias("n_item"))
    pairs = once.groupBy(*keys, "item_id").agg(F.max("n_item").alias("n_item"), F.count("*").alias("n_shared"))
    return pairs.where(100 * F.col("n_shared") >= share_percent * F.col("n_item")).select(
        "doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )
