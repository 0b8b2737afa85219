"""Changelog entries and specification modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHANGELOG_SHA, estimate_tokens, sha8


def parse_changelog(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entry_ord, sha8, entry): cut before each heading line; an entry without a sha has null."""
    rows = texts.select(*keys, F.posexplode(F.split("text", "(?=\n## )")).alias("entry_ord", "entry"))
    found = F.regexp_extract("entry", f"## ({CHANGELOG_SHA})", 1)
    return rows.select(*keys, "entry_ord", F.when(found != "", found).alias("sha8"), "entry")


def changelog_shas(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sha8) of every heading at a line start."""
    return texts.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(f"(?m)^## ({CHANGELOG_SHA})"), F.lit(1))).alias("sha8"))


def unique_entries(trunk: DataFrame, branch: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of the branch whose sha no heading of the trunk has; seven and eight digits never match each other."""
    return parse_changelog(branch, keys).where("sha8 IS NOT NULL").join(changelog_shas(trunk, keys).distinct(), [*keys, "sha8"], "left_anti")


def merge_changelogs(trunk: DataFrame, branch: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the trunk's changelog, the branch's own entries in order, and the entry of the merge."""
    own = unique_entries(trunk, branch, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("entry_ord", "entry"))).alias("l")).select(*keys, F.array_join(F.col("l.entry"), "").alias("own"))
    rows = trunk.join(own, keys, "left").join(merges, keys)
    text = F.concat("text", F.coalesce("own", F.lit("")), F.lit("\n## "), sha8("merge_sha"), F.lit(" (merge)\n\n"), "merge_text", F.lit("\n"))
    return rows.select(*keys, text.alias("text"))


def running_changelog(steps: DataFrame, inherited: DataFrame) -> DataFrame:
    """(repo_id, segment_id, text) at each segment's tip: the inherited text, then every entry on lines of its own."""
    w = steps.groupBy("repo_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "entry"))).alias("l"))
    rows = w.join(inherited, ["repo_id", "segment_id"], "left")
    return rows.select("repo_id", "segment_id", F.concat(F.coalesce("text", F.lit("")), F.array_join(F.transform("l.entry", lambda e: F.concat(F.lit("\n"), e, F.lit("\n"))), "")).alias("text"))


def resolve_module(paths: DataFrame, modules: DataFrame, ext: str = ".md", by: str = "repo_id") -> DataFrame:
    """(by, path, module_path): the nearest known module on the way up from a path's directory, else the master.

    Only different directories climb; their paths join the outcome.
    """
    placed = paths.select(by, "path").distinct().withColumn("folder", F.regexp_replace("path", r"(?s)(\A|/)[^/]*\z", ""))
    folders = placed.where("folder <> ''").select(by, "folder").distinct().withColumn("parts", F.split("folder", "/"))
    up = folders.select(by, "folder", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.concat(F.array_join(F.slice("parts", F.lit(1), n), "/"), F.lit(ext)))).alias("depth", "module_path"))
    found = up.join(modules.select(by, "module_path").distinct(), [by, "module_path"]).groupBy(by, "folder").agg(F.max_by("module_path", "depth").alias("module_path"))
    return placed.join(found, [by, "folder"], "left").select(by, "path", F.coalesce("module_path", F.lit(f"_master{ext}")).alias("module_path"))


def resolve_first(paths: DataFrame, modules: DataFrame, ext: str = ".md") -> DataFrame:
    """(repo_id, sha, module_path) of ordered paths (path_ord): the first that resolves to a module, else the master."""
    rows = paths.join(resolve_module(paths, modules, ext), ["repo_id", "path"])
    hit = F.col("module_path") != f"_master{ext}"
    first = F.min_by(F.when(hit, F.col("module_path")), F.when(hit, F.col("path_ord")))
    return rows.groupBy("repo_id", "sha").agg(F.coalesce(first, F.lit(f"_master{ext}")).alias("module_path"))


def relevant_specs(changes: DataFrame, modules: DataFrame, keys: list[str], ext: str = ".md", by: str = "repo_id") -> DataFrame:
    """(keys, module_path, content): the master and each touched module that has content."""
    touched = changes.join(resolve_module(changes, modules, ext, by), [by, "path"]).select(by, *keys, "module_path")
    wanted = touched.unionByName(changes.select(by, *keys, F.lit(f"_master{ext}").alias("module_path"))).distinct()
    return wanted.join(modules, [by, "module_path"]).where((F.col("module_path") == f"_master{ext}") | (F.col("content") != "")).select(*keys, "module_path", "content")


def upsert_modules(base: DataFrame, updates: DataFrame, ext: str = ".md") -> DataFrame:
    """The latest content of every module, of equal versions the greater; '_master' names the master too."""
    rows = base.unionByName(updates).withColumn("module_path", F.when(F.col("module_path") == "_master", F.lit(f"_master{ext}")).otherwise(F.col("module_path")))
    return rows.groupBy("repo_id", "module_path").agg(F.max(F.struct("version", "content"))["content"].alias("content"), F.max("version").alias("version"))


def spec_total_tokens(modules: DataFrame) -> DataFrame:
    return modules.groupBy("repo_id").agg(F.sum(estimate_tokens("content")).alias("total_tokens"))


def assemble_module_spec(relevant: DataFrame, keys: list[str], ext: str = ".md") -> DataFrame:
    """(keys, text): the master section, then the module sections, by path."""
    is_master = F.col("module_path") == f"_master{ext}"
    part = F.concat(F.lit("### Module: "), "module_path", F.lit("\n\n"), "content", F.lit("\n"))
    lists = relevant.groupBy(*keys).agg(F.max(F.when(is_master, F.col("content"))).alias("master"), F.array_sort(F.collect_list(F.when(~is_master, F.struct("module_path", part.alias("t"))))).alias("l"))
    more = F.when(F.size("l") > 0, F.concat(F.lit("\n\n## Relevant Module Specifications\n\n"), F.array_join(F.col("l.t"), "\n"))).otherwise("")
    return lists.select(*keys, F.concat(F.lit("## Master Specification\n\n"), F.coalesce("master", F.lit("")), more).alias("text"))
