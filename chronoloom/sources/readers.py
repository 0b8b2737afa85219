"""Sources and sinks. Extraction from version control happens upstream; inputs are files and tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEP, REC = "<<SEP>>", "<<REC>>"
_STEP = "originalSha:string,`{derived}`:string,model:string,costUsd:double,timestamp:string"
STATE = (
    "version int, repoPath string, targetRef string, rootCommit string, config map<string,string>, "
    "segments array<struct<id:string,type:string,commits:array<string>,dependsOn:array<string>,forkPoint:string,mergesInto:string>>, "
    "segmentProgress map<string,struct<status:string,completedSteps:array<struct<" + _STEP + ">>,currentSpec:string,currentChangelog:string>>, "
    "shaMap map<string,string>, "
    "completedMerges array<struct<mergeSha:string,`{derived}`:string,trunkSegmentId:string,branchSegmentId:string,timestamp:string>>, "
    "`{head}` string, totalCostUsd double, totalSteps long, "
    "reconciliations array<struct<atStep:long,atSha:string,model:string,costUsd:double,findingsCount:long,skipped:boolean,timestamp:string>>, "
    "lastReconciliationStep long, lastReconciliationSha string, cumulativeDiffTokensSinceLastReconciliation long, "
    "_corrupt_record string"
)


def _repo_of_file() -> Column:
    """The file's name, or that of a folder ``repo=<name>`` that holds it."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"/repo=([^/]*)/[^/]*$", 1)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(folder != "", plain(plain(folder))).otherwise(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(repo, log_pos, record): the non-blank records of each file (one file a repository), newest first.

    Spark cuts large files into splits, each read by a task. Records are numbered inside their split, and what the
    splits before hold is added, so that a large log needs no task of its own.
    """
    lines = spark.read.option("lineSep", REC).text(path).select(_repo_of_file().alias("repo"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    rows = lines.where(F.col("value").rlike(r"\S"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("file", "split").agg(F.count("*").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    inside = F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1
    return rows.join(offsets, ["file", "split"]).select("repo", (F.col("off") + inside).alias("log_pos"), F.regexp_replace("value", r"\A\s+", "").alias("record"))


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """sha, parents, subject and date of a delimited log; records of fewer than four fields are dropped."""
    fields = F.split("record", SEP)
    rows = _records(spark, path).withColumn("f", fields).where(F.size("f") >= 4)
    parents = F.filter(F.split(F.col("f")[1], " "), lambda p: p != "")
    return rows.select("repo", F.col("f")[0].alias("sha"), parents.alias("parents"), F.col("f")[2].alias("message"), F.to_timestamp(F.trim(F.col("f")[3])).alias("author_date"), "log_pos")


def read_tagged_log(spark: SparkSession, path: str) -> DataFrame:
    """sha and body (all after the first separator); records without a separator are skipped."""
    at = F.instr("record", SEP)
    return _records(spark, path).where(at > 0).select("repo", F.expr(f"substring(record, 1, instr(record, '{SEP}') - 1)").alias("sha"), F.expr(f"substring(record, instr(record, '{SEP}') + {len(SEP)})").alias("body"), "log_pos")


def diffs_of_commits(commits: DataFrame, diffs: DataFrame) -> DataFrame:
    """Each commit with its diff against its first parent; a root's diff has a null from_sha."""
    first = commits.select("repo_id", F.col("sha").alias("to_sha"), F.get("parents", F.lit(0)).alias("first_parent"))
    same = (first.repo_id == diffs.repo_id) & (first.to_sha == diffs.to_sha) & first.first_parent.eqNullSafe(diffs.from_sha)
    return first.join(diffs, same).select(first.repo_id, diffs.from_sha, first.to_sha, "diff")


def read_source_tree(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, file_ord, path, content) of the files below ``path``, one folder a repository (no pattern).

    file_ord numbers a repository's paths by their bytes, as a recursive listing gives them; only names are
    sorted. content is null where the bytes are not UTF-8: such a file is skipped later on.
    """
    root = re.sub(r"^file:/+", "/", path.rstrip("/"))
    below = F.expr(f"substring(path, instr(path, {_literal(root + '/')}) + {len(root) + 1})")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("below", below)
    named = files.where(F.instr("below", "/") > 0).withColumns({"repo_id": F.split_part("below", F.lit("/"), F.lit(1)), "name": F.expr("substring(below, instr(below, '/') + 1)")})
    order = named.select("repo_id", "name", (F.row_number().over(Window.partitionBy("repo_id").orderBy("name")) - 1).alias("file_ord"))
    return named.join(order, ["repo_id", "name"]).select("repo_id", "file_ord", F.col("name").alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_state(spark: SparkSession, path: str, derived: str = "derivedSha", head: str = "branchHead") -> DataFrame:
    """State documents, one a file, with the file's name as repo; unparseable ones count as absent.

    ``derived`` and ``head`` are the names that the files give to a step's derived sha and to the branch head.
    """
    schema = STATE.replace("{derived}", derived).replace("{head}", head)
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("repo", _repo_of_file())
    rows = rows.where("_corrupt_record IS NULL").drop("_corrupt_record")
    return rows if head == "branchHead" else rows.withColumnRenamed(head, "branchHead")


def steps_of_state(state: DataFrame, derived: str = "derivedSha") -> DataFrame:
    """(repo, segment_id, seq, original_sha, derived_sha, model, cost, ts): the ledger that state documents hold."""
    kept = state.select("repo", F.explode("segmentProgress").alias("segment_id", "p"))
    rows = kept.select("repo", "segment_id", F.posexplode("p.completedSteps").alias("seq", "s"))
    return rows.select("repo", "segment_id", F.col("seq").cast("long"), F.col("s.originalSha").alias("original_sha"), F.col("s")[derived].alias("derived_sha"), "s.model", F.col("s.costUsd").alias("cost"), F.to_timestamp("s.timestamp").alias("ts"))


def segments_of_state(state: DataFrame) -> DataFrame:
    """(repo, segment_id, type, creation_ord, n_commits, status) of state documents; no progress: pending."""
    rows = state.select("repo", "segmentProgress", F.posexplode("segments").alias("creation_ord", "s"))
    status = F.coalesce(F.try_element_at("segmentProgress", F.col("s.id"))["status"], F.lit("pending"))
    return rows.select("repo", F.col("s.id").alias("segment_id"), "s.type", "creation_ord", F.size("s.commits").alias("n_commits"), status.alias("status"))


def merges_of_state(state: DataFrame, derived: str = "derivedSha") -> DataFrame:
    rows = state.select("repo", F.posexplode("completedMerges").alias("ord", "m"))
    return rows.select("repo", F.col("m.mergeSha").alias("merge_sha"), F.col("m")[derived].alias("derived_sha"), F.col("m.trunkSegmentId").alias("trunk_dep"), F.col("m.branchSegmentId").alias("branch_dep"), "ord", F.to_timestamp("m.timestamp").alias("ts"))


def reconciliations_of_state(state: DataFrame) -> DataFrame:
    rows = state.select("repo", F.posexplode("reconciliations").alias("ord", "r"))
    return rows.select("repo", F.col("r.atStep").alias("at_step"), F.col("r.atSha").alias("at_sha"), "r.model", F.col("r.costUsd").alias("cost"), F.col("r.findingsCount").alias("n_findings"), "r.skipped", "ord", F.to_timestamp("r.timestamp").alias("ts"))


def sha_map_of_state(state: DataFrame) -> DataFrame:
    return state.select("repo", F.explode("shaMap").alias("original_sha", "derived_sha"))


def state_documents(repos: DataFrame, segments: DataFrame, segment_commits: DataFrame, deps: DataFrame, progress: DataFrame, ledger: DataFrame, mapping: DataFrame, merges: DataFrame, reconciliations: DataFrame, derived: str = "derivedSha", head: str = "branchHead") -> DataFrame:
    """One state document a repository, nested as the files hold it, from flat tables keyed by repo (the inverse of ``read_state``).

    ``repos``: the scalar fields of ``STATE`` and config; ``ledger``: steps in order of seq; ``progress``: status, spec and
    changelog of each segment; ``mapping``, ``merges`` and ``reconciliations`` as the ``_of_state`` functions give them, the
    last two with ord for their order. Arrays are in order, maps in the order of their keys; a document holds one repository, as its file does.
    """
    none = lambda rows, c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def ordered(rows: DataFrame, keys: list[str], by: str, value, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), value.alias("v")))).alias("l")).select(*keys, F.col("l.v").alias(name))

    key = ["repo", "segment_id"]
    parts = segments.join(ordered(segment_commits, key, "ordinal", F.col("sha"), "commits"), key, "left").join(ordered(deps, key, "dep_ord", F.col("dep_id"), "needs"), key, "left")
    parts = parts.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("commits", "needs")})
    one = F.struct(F.col("segment_id").alias("id"), "type", "commits", F.col("needs").alias("dependsOn"), F.col("fork_from").alias("forkPoint"), F.col("merges_into").alias("mergesInto"))
    listed = ordered(parts, ["repo"], "creation_ord", one, "segments")
    step = F.struct(F.col("original_sha").alias("originalSha"), F.col("derived_sha").alias(derived), "model", F.col("cost").cast("double").alias("costUsd"), stamp.alias("timestamp"))
    steps = ordered(ledger, key, "seq", step, "completedSteps")
    told = progress.select(*key, "status", "spec", "changelog").join(steps, key, "left").withColumn("completedSteps", none(steps, "completedSteps"))
    held = F.struct("segment_id", F.struct("status", "completedSteps", F.col("spec").alias("currentSpec"), F.col("changelog").alias("currentChangelog")))
    told = told.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(held))).alias("segmentProgress"))
    shas = mapping.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("original_sha", "derived_sha")))).alias("shaMap"))
    merge = F.struct(F.col("merge_sha").alias("mergeSha"), F.col("derived_sha").alias(derived), F.col("trunk_dep").alias("trunkSegmentId"), F.col("branch_dep").alias("branchSegmentId"), stamp.alias("timestamp"))
    done = ordered(merges, ["repo"], "ord", merge, "completedMerges")
    check = F.struct(F.col("at_step").alias("atStep"), F.col("at_sha").alias("atSha"), "model", F.col("cost").cast("double").alias("costUsd"), F.col("n_findings").alias("findingsCount"), "skipped", stamp.alias("timestamp"))
    checks = ordered(reconciliations, ["repo"], "ord", check, "reconciliations")
    out = repos
    for more in (listed, told, shas, done, checks):
        out = out.join(more, "repo", "left")
    arrays = {c: none(out, c) for c in ("segments", "completedMerges", "reconciliations")}
    maps = {c: F.coalesce(F.col(c), F.create_map().cast(out.schema[c].dataType)) for c in ("segmentProgress", "shaMap")}
    names = ["version", "repoPath", "targetRef", "rootCommit", "config", "segments", "segmentProgress", "shaMap", "completedMerges", head, "totalCostUsd", "totalSteps", "reconciliations"]
    names += ["lastReconciliationStep", "lastReconciliationSha", "cumulativeDiffTokensSinceLastReconciliation"]
    return out.withColumns(arrays | maps).withColumnRenamed("branchHead", head).select("repo", *names)


def write_state(documents: DataFrame, path: str) -> None:
    """Each document of ``state_documents`` as JSON in a file of its own, in the folder ``repo=<repo>`` below ``path``."""
    held = documents.select("repo", F.to_json(F.struct(*[c for c in documents.columns if c != "repo"]), {"ignoreNullFields": "false"}).alias("value"))
    held.repartition("repo").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("repo").text(path)


def write_outputs(df: DataFrame, path: str, buckets: int = 64, kind: str = "parquet") -> None:
    """Writes by a hash of the repository, so that one large repository is not one directory per row group."""
    out = df.withColumn("repo_bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets)))
    out.write.mode("overwrite").partitionBy("repo_bucket").format(kind).save(path)


def spec_file_map(modules: DataFrame) -> DataFrame:
    """Output path of every module of a specification."""
    return modules.withColumn("output_path", F.concat(F.lit("spec/"), "module_path"))


def read_spec_versions(files: DataFrame, ext: str = ".md", changelog: str = "changelog.md") -> DataFrame:
    """spec, changelog and error of each version: one file, or the master if no module stands beside it.

    White space around the spec goes, the changelog stays as it is. Modules are files with ``ext`` in the spec folder itself.
    """
    def at(path):
        return F.max(F.when(F.col("path") == path, F.col("content")))

    module = F.col("path").rlike(rf"\Aspec/[^/]+{re.escape(ext)}\z") & (F.col("path") != f"spec/_master{ext}")
    grouped = files.groupBy("repo_id", "sha").agg(at(f"spec{ext}").alias("single"), at(f"spec/_master{ext}").alias("master"), at(changelog).alias("changelog"), F.count_if(module).alias("others"))
    error = F.when(F.col("single").isNotNull(), None).when(F.col("master").isNull(), "missing").when(F.col("others") > 0, "modules")
    bare = F.regexp_replace(F.coalesce("single", "master"), r"(?U)\A[\s\x{FEFF}]+|[\s\x{FEFF}]+\z", "")
    return grouped.select("repo_id", "sha", F.when(error.isNull(), bare).alias("spec"), F.coalesce("changelog", F.lit("")).alias("changelog"), error.alias("error"))
