"""Step ledger: progress, totals, lineage, resume points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import original_sha

R = "repo_id"


def segment_progress(segments: DataFrame, ledger: DataFrame, status_events: DataFrame) -> DataFrame:
    """(repo_id, segment_id, status, steps, spec, changelog): pending until a step; an explicit status overrides."""
    steps = ledger.groupBy(R, "segment_id").agg(F.count("*").alias("steps"), F.max_by("spec", "seq").alias("spec"), F.max_by("changelog", "seq").alias("changelog"))
    told = status_events.groupBy(R, "segment_id").agg(F.max_by("status", "seq").alias("told"))
    rows = segments.select(R, "segment_id").join(steps, [R, "segment_id"], "left").join(told, [R, "segment_id"], "left")
    status = F.coalesce("told", F.when(F.col("steps") > 0, "in-progress").otherwise("pending"))
    return rows.select(R, "segment_id", status.alias("status"), F.coalesce("steps", F.lit(0)).alias("steps"), "spec", "changelog")


def ledger_totals(ledger: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """(repo_id, total_steps, total_cost): costs of steps and reconciliations, as decimals."""
    rows = ledger.select(R, F.lit(1).alias("s"), F.col("cost").cast("decimal(18,6)").alias("c")).unionByName(reconciliations.select(R, F.lit(0).alias("s"), F.col("cost").cast("decimal(18,6)").alias("c")))
    return rows.groupBy(R).agg(F.sum("s").alias("total_steps"), F.sum("c").alias("total_cost"))


def sha_map(ledger: DataFrame) -> DataFrame:
    """(repo_id, original_sha, derived_sha): the step written last wins, by ts where the ledger has it, then by seq, then the greater sha."""
    order = [c for c in ("ts", "seq", "derived_sha") if c in ledger.columns]
    return ledger.groupBy(R, "original_sha").agg(F.max(F.struct(*order))["derived_sha"].alias("derived_sha"))


def sha_map_from_log(tagged_log: DataFrame) -> DataFrame:
    """(repo_id, original_sha, derived_sha) of tagged bodies; the one nearest the tip wins."""
    rows = tagged_log.withColumn("original_sha", original_sha("body")).where("original_sha IS NOT NULL")
    return rows.groupBy(R, "original_sha").agg(F.min_by("sha", "log_pos").alias("derived_sha"))


def reset_segments(ledger: DataFrame, reset: DataFrame) -> DataFrame:
    return ledger.join(reset.select(R, "segment_id"), [R, "segment_id"], "left_anti")


def find_anchor(tagged_log: DataFrame, limit: int = 100) -> DataFrame:
    """(repo_id, anchor, original_sha, commits_beyond_anchor, error) from the first ``limit`` commits of each log."""
    w = Window.partitionBy(R).orderBy("log_pos")
    heads = tagged_log.select(R, "sha", "log_pos", original_sha("body").alias("o")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)
    rows = heads.withColumn("k", F.col("nth") - 1)
    out = rows.groupBy(R).agg(F.min_by(F.when(F.col("o").isNotNull(), F.col("sha")), F.when(F.col("o").isNotNull(), F.col("k"))).alias("anchor"), F.min_by("o", F.when(F.col("o").isNotNull(), F.col("k"))).alias("original_sha"), F.min(F.when(F.col("o").isNotNull(), F.col("k"))).alias("commits_beyond_anchor"))
    return out.withColumn("error", F.when(F.col("anchor").isNull(), "no anchor"))


def dangling_steps(ledger: DataFrame, commits: DataFrame) -> DataFrame:
    """Steps whose original commit is no longer in the graph."""
    return ledger.select(R, F.col("original_sha").alias("sha")).join(commits.select(R, "sha"), [R, "sha"], "left_anti")


def valid_prefix(ledger: DataFrame, segment_commits: DataFrame) -> DataFrame:
    """(repo_id, segment_id, valid): whether a segment's steps are its first commits, in order."""
    w = Window.partitionBy(R, "segment_id").orderBy("seq")
    steps = ledger.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))
    rows = steps.join(segment_commits.select(R, "segment_id", "ordinal", "sha"), [R, "segment_id", "ordinal"], "left")
    return rows.groupBy(R, "segment_id").agg(F.bool_and(F.coalesce(F.col("sha") == F.col("original_sha"), F.lit(False))).alias("valid"))


def seed_progress(segment_commits: DataFrame, ancestry: DataFrame, mapping: DataFrame) -> DataFrame:
    """(repo_id, segment_id, n_done, n_commits, status, unmapped) of the segments an anchor's ancestry touches."""
    sizes = segment_commits.groupBy(R, "segment_id").agg(F.count("*").alias("n_commits"), F.max("ordinal").alias("last"))
    done = segment_commits.join(ancestry.select(R, "sha"), [R, "sha"], "left_semi").groupBy(R, "segment_id").agg(F.count("*").alias("n_done"))
    rows = segment_commits.join(done.join(sizes, [R, "segment_id"]), [R, "segment_id"]).where("ordinal < n_done")
    rows = rows.join(mapping.select(R, F.col("original_sha").alias("sha"), F.lit(1).alias("m")), [R, "sha"], "left")
    needed = (F.col("n_done") < F.col("n_commits")) | (F.col("ordinal") == F.col("last"))
    out = rows.groupBy(R, "segment_id", "n_done", "n_commits").agg(F.count(F.when(needed & F.col("m").isNull(), 1)).alias("unmapped"))
    return out.withColumn("status", F.when(F.col("n_done") == F.col("n_commits"), "complete").otherwise("in-progress"))


def remaining_work(segment_commits: DataFrame, ledger: DataFrame) -> DataFrame:
    """(repo_id, segment_id, remaining): commits not done yet; segments with none left have no row."""
    done = ledger.select(R, "segment_id", F.col("original_sha").alias("sha"))
    return segment_commits.join(done, [R, "segment_id", "sha"], "left_anti").groupBy(R, "segment_id").agg(F.count("*").alias("remaining"))


def segment_tips(ledger: DataFrame) -> DataFrame:
    """The last step of each segment."""
    last = ledger.groupBy(R, "segment_id").agg(F.max_by(F.struct("seq", "original_sha", "derived_sha", "spec", "changelog"), "seq").alias("t"))
    return last.select(R, "segment_id", "t.*")


def overall_head(tips: DataFrame, segments: DataFrame) -> DataFrame:
    """(repo_id, derived_sha): the tip of the last trunk segment."""
    on = segments.where("type = 'trunk'").select(R, "segment_id", "creation_ord")
    return tips.join(on, [R, "segment_id"]).groupBy(R).agg(F.max_by("derived_sha", "creation_ord").alias("derived_sha"))


def derived_parents(segment_commits: DataFrame, mapping: DataFrame, deps: DataFrame, merges: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo_id, segment_id, ordinal, sha, parents): derived parents mirror the topology."""
    w = Window.partitionBy(R, "segment_id").orderBy("ordinal")
    rows = segment_commits.join(mapping.select(R, F.col("original_sha").alias("sha"), "derived_sha"), [R, "sha"], "left").withColumn("before", F.lag("derived_sha").over(w))
    tip = tips.select(R, "segment_id", F.col("derived_sha").alias("tip"))
    first = deps.where("dep_ord = 0").select(R, "segment_id", F.col("dep_id").alias("d")).join(tip.select(R, F.col("segment_id").alias("d"), F.col("tip").alias("dep_tip")), [R, "d"]).drop("d")
    both = merges.join(tip.select(R, F.col("segment_id").alias("trunk_dep"), F.col("tip").alias("t")), [R, "trunk_dep"]).join(tip.select(R, F.col("segment_id").alias("branch_dep"), F.col("tip").alias("b")), [R, "branch_dep"]).select(R, "segment_id", F.array("t", "b").alias("pair"))
    rows = rows.join(first, [R, "segment_id"], "left").join(both, [R, "segment_id"], "left")
    parents = F.when((F.col("ordinal") == 0) & F.col("pair").isNotNull(), F.col("pair")).when(F.col("ordinal") == 0, F.array_compact(F.array("dep_tip"))).otherwise(F.array_compact(F.array("before")))
    return rows.select(R, "segment_id", "ordinal", "sha", parents.alias("parents"))


def record_merges(ledger: DataFrame, merges: DataFrame) -> DataFrame:
    """(repo_id, merge_sha, derived_sha, trunk_dep, branch_dep) of the merges that have been done."""
    return merges.join(sha_map(ledger).withColumnRenamed("original_sha", "merge_sha"), [R, "merge_sha"]).select(R, "merge_sha", "derived_sha", "trunk_dep", "branch_dep")


def resume_mode(repos: DataFrame, states: DataFrame, anchors: DataFrame, seeded: DataFrame) -> DataFrame:
    """(repo_id, mode, total_commits, n_segments, completed, remaining, cost_so_far, commits_beyond_anchor).

    A usable state file (``states``: total_steps, total_cost), else a derived branch (``seeded``: n_done of each segment
    that ``seed_progress`` found; it has cost nothing yet), else fresh, with no figures of completed work. ``repos`` holds
    total_commits, n_segments and total_steps.
    """
    s = states.groupBy(R).agg(F.max("total_steps").alias("s_steps"), F.max("total_cost").alias("s_cost"), F.lit(True).alias("s"))
    a = anchors.where("anchor IS NOT NULL").select(R, F.col("commits_beyond_anchor").alias("beyond"), F.lit(True).alias("a"))
    n = seeded.groupBy(R).agg(F.sum("n_done").alias("a_steps"))
    rows = repos.join(s, R, "left").join(a, R, "left").join(n, R, "left")
    rows = rows.withColumn("mode", F.when(F.col("s"), "state-file").when(F.col("a"), "derived-branch").otherwise("fresh"))
    state, branch = F.col("mode") == "state-file", F.col("mode") == "derived-branch"
    rows = rows.withColumn("completed", F.when(state, F.coalesce("s_steps", F.lit(0))).when(branch, F.coalesce("a_steps", F.lit(0))))
    cost = F.when(state, F.coalesce("s_cost", F.lit(0))).when(branch, F.lit(0)).cast(states.schema["total_cost"].dataType)
    return rows.select(R, "mode", "total_commits", "n_segments", "completed", (F.col("total_steps") - F.col("completed")).alias("remaining"), cost.alias("cost_so_far"), F.when(branch, F.col("beyond")).alias("commits_beyond_anchor"))
