"""Diffs and source files: parsing, filtering, grouping, splitting and token budgets.

Grouping and splitting move paths and token counts only; texts join last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, group_key, is_binary_path, not_ignored
from ..sources.tables import materialized
from .folds import folded


def parse_diff(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file_ord, path, diff, tokens): a row a file; headers without a plain new path are dropped."""
    parts = diffs.select(*keys, F.posexplode(F.split("diff", "(?m)^diff --git ")).alias("file_ord", "part"))
    parts = parts.where(F.col("part").rlike(r"\S")).withColumn("path", F.regexp_extract("part", r"\Aa/\S+\s+b/(\S+)", 1)).where("path <> ''")
    text = F.concat(F.lit("diff --git "), "part")
    return parts.select(*keys, "file_ord", "path", text.alias("diff"), estimate_tokens(text).alias("tokens"))


def filter_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    return files.where(not_ignored("path", patterns))


def group_by_directory(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_key, n_files, total_tokens, first_ord)."""
    return files.groupBy(*keys, group_key("path").alias("chunk_key")).agg(F.count("*").alias("n_files"), F.sum("tokens").alias("total_tokens"), F.min("file_ord").alias("first_ord"))


def split_oversized(files: DataFrame, keys: list[str], max_tokens: int) -> DataFrame:
    """Files with the chunk_key they end in: too large a chunk is regrouped by the next path component.

    A chunk that would give one subgroup only stays whole, even if deeper levels could split it. Every file names the
    chunks that it would go through, from its group down to its own path, and one aggregation over (keys, group, chunk) tells which of
    them divide, whatever the depth. A file ends in the first of its chunks that doesn't, or as a chunk of its own. Paths and counts move; the
    files themselves are joined once, at the end.
    """
    group = group_key("path")
    below = F.when(F.col("group_key") == ".", F.lit("")).otherwise(F.concat("group_key", F.lit("/")))
    names = F.split(F.expr("substring(path, length(below) + 1)"), "/")
    deeper = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.concat("below", F.array_join(F.slice(names, F.lit(1), n), "/")))
    trail = F.when(F.col("path") == F.col("group_key"), F.array("path")).otherwise(F.concat(F.array("group_key"), deeper))
    rows = files.withColumn("group_key", group).withColumn("below", below).withColumn("trail", trail).drop("below")
    steps = rows.select(*keys, "group_key", "tokens", F.posexplode("trail").alias("level", "chunk_key"), F.col("trail").alias("t"))
    steps = steps.withColumn("sub", F.coalesce(F.get("t", F.col("level") + 1), F.get("t", F.col("level")))).drop("t")
    sizes = steps.groupBy(*keys, "group_key", "level", "chunk_key").agg(F.sum("tokens").alias("total"), F.min("sub").alias("a"), F.max("sub").alias("b"))
    divides = sizes.where((F.col("total") > max_tokens) & (F.col("a") != F.col("b"))).select(*keys, "group_key", "level", "chunk_key", F.lit(True).alias("divides"))
    # chunks that divide are few: only their files look further
    numbered = materialized(rows.withColumn("_row", F.monotonically_increasing_id()))
    looked = numbered.select(*keys, "group_key", "_row", F.posexplode("trail").alias("level", "chunk_key")).join(divides, [*keys, "group_key", "level", "chunk_key"], "left")
    ends = looked.groupBy("_row").agg(F.min(F.when(F.col("divides").isNull(), F.struct("level", "chunk_key")))["chunk_key"].alias("chunk_key"))
    ended = numbered.join(ends, "_row", "left").withColumn("chunk_key", F.coalesce("chunk_key", "path"))
    return ended.drop("_row", "group_key", "trail")


def chunks_of(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.groupBy(*keys, "chunk_key").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("total_tokens"))


def chunk_diff(files: DataFrame, keys: list[str], max_tokens: int, patterns: list[str]) -> DataFrame:
    """Chunks of the changes whose files exceed ``max_tokens`` in all; other changes need none and have no rows."""
    kept = filter_ignored(files, patterns)
    large = kept.groupBy(*keys).agg(F.sum("tokens").alias("t")).where(F.col("t") > max_tokens).select(*keys)
    return chunks_of(split_oversized(kept.join(large, keys, "left_semi"), keys, max_tokens), keys)


def _line_lengths(content: Column) -> Column:
    return F.transform(F.split(content, "\n"), lambda x: F.length(x).cast("long"))


def _runs(lengths: Column, limit: int) -> Column:
    """(starts, tokens) of greedy runs of lines: lines are added while a quarter of the length fits, at least one each; a fold over lengths."""
    long = F.lit(0).cast("long")
    zero = F.struct(F.array().cast("array<int>").alias("starts"), long.alias("size"), F.lit(0).alias("k"), long.alias("done"))

    def quarter(size: Column) -> Column:
        return F.ceil(size / 4).cast("long")

    def add(state: Column, n: Column) -> Column:
        full = (state["k"] == 0) | (quarter(state["size"] + n + 1) > limit)
        starts = F.when(full, F.array_append(state["starts"], state["k"])).otherwise(state["starts"])
        size, done = F.when(full, n + 1).otherwise(state["size"] + n + 1), F.when(full, state["done"] + quarter(state["size"])).otherwise(state["done"])
        return F.struct(starts.alias("starts"), size.alias("size"), (state["k"] + 1).alias("k"), done.alias("done"))

    return F.aggregate(lengths, zero, add, lambda state: F.struct(state["starts"].alias("starts"), (state["done"] + quarter(state["size"])).alias("tokens")))


def split_large_file(files: DataFrame, keys: list[str], max_file_tokens: int) -> DataFrame:
    """(keys, part_ord, path, content, tokens): parts of whole lines, named path:first-last; small files stay as they are.

    The greedy packing resets at each part; it is a fold over a file's line lengths where the file stands, so nothing is
    shuffled. ``keys`` name a file; a null content has no rows. No limit (0) splits nothing.
    """
    max_file_tokens = max_file_tokens or (1 << 62)
    rows = files.select(*keys, "path", "content", estimate_tokens("content").alias("tokens"))
    lines = F.split("content", "\n")
    big = rows.where(F.col("tokens") > max_file_tokens).withColumn("starts", _runs(_line_lengths(F.col("content")), max_file_tokens)["starts"])
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size(lines)))
    runs = big.select(*keys, "path", "content", F.posexplode(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b"))).alias("part_ord", "r"))
    text = F.concat(F.array_join(F.slice(lines, F.col("r.a") + 1, F.col("r.b") - F.col("r.a")), "\n"), F.lit("\n"))
    parts = runs.select(*keys, "part_ord", F.concat("path", F.lit(":"), F.col("r.a") + 1, F.lit("-"), F.col("r.b")).alias("path"), text.alias("content"), estimate_tokens(text).alias("tokens"))
    return rows.where(F.col("tokens") <= max_file_tokens).select(*keys, F.lit(0).alias("part_ord"), "path", "content", "tokens").unionByName(parts)


def budget_fits(tokens: list[int], budget: int, total: int = 0, adds: list[int] | None = None) -> tuple[list[bool], int]:
    """The fold itself: what fits is added (as ``adds``, where that differs), what doesn't is passed over."""
    out = []
    for t, more in zip(tokens, adds or tokens):
        out.append(total + t <= budget)
        total += more if out[-1] else 0
    return out, total


def admit_within_budget(files: DataFrame, keys: list[str], budget: int, adds: str = "tokens") -> DataFrame:
    """Adds admitted: in listing order, a file enters unless it would exceed the budget; later, smaller ones still may.

    ``adds``: the column of what an admitted file adds to the total. The running total depends on what was skipped, so the files of
    a tree are folded in order. No budget (0) admits all.
    """
    if not budget:
        return files.withColumn("admitted", F.lit(True))

    def fold(pairs: list, total: int) -> tuple[list[bool], int]:
        return budget_fits([p["t"] or 0 for p in pairs], budget, total, [p["a"] or 0 for p in pairs])

    paired = files.withColumn("_pair", F.struct(F.col("tokens").alias("t"), F.col(adds).alias("a")))
    return folded(paired, keys, ["file_ord"], "_pair", "admitted", fold).drop("_pair")


def read_tree_chunks(files: DataFrame, keys: list[str], patterns: list[str], budget: int, max_file_tokens: int, max_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(files with chunk_key, skipped paths) of source trees; a file that is split counts towards the budget as its parts do."""
    readable = files.where(~is_binary_path("path") & not_ignored("path", patterns))
    sized = readable.where("content IS NOT NULL").withColumn("tokens", estimate_tokens("content"))
    parted = F.when(F.col("tokens") > max_file_tokens, _runs(_line_lengths(F.col("content")), max_file_tokens)["tokens"]) if max_file_tokens else F.lit(None)
    sized = sized.withColumn("adds", F.coalesce(parted, "tokens"))
    admitted = materialized(admit_within_budget(sized.select(*keys, "file_ord", "path", "tokens", "adds"), keys, budget, "adds"))
    parts = split_large_file(files.join(admitted.where("admitted").select(*keys, "file_ord"), [*keys, "file_ord"], "left_semi"), [*keys, "file_ord"], max_file_tokens)
    skipped = admitted.where("NOT admitted").select(*keys, "path").unionByName(readable.where("content IS NULL").select(*keys, "path"))
    chunked = split_oversized(parts.select(*keys, "file_ord", "part_ord", "path", "tokens"), keys, max_tokens)
    return chunked, skipped


def accepted_diffs(stats: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Keys of the changes whose diffstat, times ten, stays within the budget; no budget (0) accepts all."""
    return stats.where(F.lit(budget == 0) | (estimate_tokens("stat") * 10 <= budget)).select(*keys).distinct()


def read_diff_chunks(files: DataFrame, stats: DataFrame, keys: list[str], patterns: list[str], budget: int, max_tokens: int, max_file_tokens: int = 0) -> DataFrame:
    """Chunked diff files of the accepted changes; with ``max_file_tokens``, larger diffs of a file (``diff``) are split into runs of lines first."""
    fits = accepted_diffs(stats, keys, budget)
    kept = files.where(~is_binary_path("path") & not_ignored("path", patterns)).join(fits, keys, "left_semi")
    if max_file_tokens:
        kept = split_large_file(kept.withColumnRenamed("diff", "content"), [*keys, "file_ord"], max_file_tokens)
    return split_oversized(kept, keys, max_tokens)


def reconciliation_source(diff_chunks: DataFrame, accepted: DataFrame, tree_chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of the diff where it was ``accepted`` (none, if it has none), else those of the tree.

    A change without a diff to read, such as a first reconciliation, is not among the accepted ones.
    """
    names = [*keys, "path", "chunk_key", "tokens"]
    told = diff_chunks.join(accepted.select(*keys), keys, "left_semi")
    rest = tree_chunks.join(accepted.select(*keys), keys, "left_anti")
    return told.select(*names, F.lit("diff").alias("mode")).unionByName(rest.select(*names, F.lit("tree").alias("mode")))


def render_source_chunk(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_key, file_name, text) of each chunk."""
    text = F.concat(F.lit("--- "), "path", F.lit(" ---\n"), "content")
    lists = files.groupBy(*keys, "chunk_key").agg(F.array_sort(F.collect_list(F.struct("file_ord", text.alias("t")))).alias("l"))
    name = F.concat(F.lit("source/"), F.replace("chunk_key", F.lit("/"), F.lit("--")), F.lit(".txt"))
    return lists.select(*keys, "chunk_key", name.alias("file_name"), F.array_join(F.col("l.t"), "\n\n").alias("text"))


def diffstat(diff_files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, added, removed): change lines after each file's first hunk header."""
    lines = F.split(F.expr("substring(diff, nullif(instr(diff, '\n@@'), 0) + 1)"), "\n")

    def changes(sign: str):
        return F.coalesce(F.size(F.filter(lines, lambda x: x.startswith(sign))), F.lit(0))

    counted = diff_files.select(*keys, "path", F.when(F.instr("diff", "\n@@") > 0, changes("+")).otherwise(0).alias("a"), F.when(F.instr("diff", "\n@@") > 0, changes("-")).otherwise(0).alias("r"))
    return counted.groupBy(*keys, "path").agg(F.sum("a").alias("added"), F.sum("r").alias("removed"))
