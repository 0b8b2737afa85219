"""Planning statistics: work by type and model, cost ranges and wall-clock estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_duration, model_for_step

R = "repo_id"
# fixed values: price range a step, and seconds a step
PRICES = [("sonnet", "0.01", "0.05"), ("opus", "0.05", "0.25"), ("haiku", "0.002", "0.01")]
OTHER = ("0.01", "0.10")
SECONDS = (45, 90)


def segment_type_stats(segments: DataFrame) -> DataFrame:
    """(repo_id, type, n_segments, n_commits); a null type is the repository's total."""
    rolled = segments.rollup(R, "type").agg(F.count("*").alias("n_segments"), F.sum("n_commits").alias("n_commits"))
    return rolled.where("repo_id IS NOT NULL")


def _step_kinds(segment_commits: DataFrame, segments: DataFrame, commits: DataFrame) -> DataFrame:
    rows = segment_commits.join(segments.select(R, "segment_id", "type"), [R, "segment_id"]).join(commits.select(R, "sha", F.size("parents").alias("n")), [R, "sha"])
    kind = F.when(F.col("n") == 0, "initial-commit").when((F.col("n") > 1) & (F.col("type") == "trunk"), "merge").otherwise("evolve")
    return rows.withColumn("kind", kind)


def model_distribution(segment_commits: DataFrame, segments: DataFrame, commits: DataFrame, default: str = "sonnet", large: str = "opus") -> DataFrame:
    """(repo_id, model, steps): roots and trunk merges take the large model."""
    rows = _step_kinds(segment_commits, segments, commits)
    return rows.groupBy(R, model_for_step("kind", default, large).alias("model")).agg(F.count("*").alias("steps"))


def merge_points(segment_commits: DataFrame, segments: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, merge_points): trunk commits of several parents; repositories without one have a row of 0."""
    rows = _step_kinds(segment_commits, segments, commits)
    return rows.groupBy(R).agg(F.count_if(F.col("kind") == "merge").alias("merge_points"))


def cost_estimate(distribution: DataFrame, done: DataFrame) -> DataFrame:
    """(repo_id, low, high): all completed steps are taken off every model's count."""
    prices = distribution.sparkSession.createDataFrame(PRICES, "model string, low string, high string")
    rows = distribution.join(F.broadcast(prices), "model", "left").join(done.select(R, "done"), R, "left")
    left = F.greatest(F.lit(0), F.col("steps") - F.least("steps", F.coalesce("done", F.lit(0))))
    price = lambda c, other: F.coalesce(c, F.lit(other)).cast("decimal(10,4)")
    return rows.groupBy(R).agg(F.sum(left * price("low", OTHER[0])).cast("decimal(18,4)").alias("low"), F.sum(left * price("high", OTHER[1])).cast("decimal(18,4)").alias("high"))


def setup_stats(segments: DataFrame, distribution: DataFrame, critical: DataFrame, done: DataFrame, merges: DataFrame, concurrency: int = 4) -> DataFrame:
    """One row a repository: counts by type and model, steps, remaining, cost so far, critical path, cost and wall-clock ranges.

    ``done`` holds (repo_id, done, cost) of the ledger, ``merges`` the ``merge_points``; a repository without steps is no resume.
    """
    kinds = segments.groupBy(R, "type").agg(F.count("*").alias("n_segments"), F.sum("n_commits").alias("n_commits"))
    total = kinds.groupBy(R).agg(
        F.sum("n_segments").alias("n_segments"),
        F.sum("n_commits").alias("total_steps"),
        F.array_sort(F.collect_list(F.struct("type", "n_segments", "n_commits"))).alias("by_type"),
    )
    models = distribution.groupBy(R).agg(F.array_sort(F.collect_list(F.struct("model", "steps"))).alias("by_model"))
    rows = total.join(models, R, "left").join(merges.select(R, "merge_points"), R, "left").join(done.select(R, "done", "cost"), R, "left")
    rows = rows.join(critical, R, "left").join(cost_estimate(distribution, done), R, "left")
    rows = rows.withColumns({"done": F.coalesce("done", F.lit(0)), "cost_so_far": F.coalesce("cost", F.lit(0).cast(done.schema["cost"].dataType))}).drop("cost")
    rows = rows.withColumns({"remaining": F.greatest(F.lit(0), F.col("total_steps") - F.col("done")), "is_resume": F.col("done") > 0})
    rounds = F.greatest("critical_path", F.ceil(F.col("remaining") / concurrency))
    rows = rows.withColumn("wall_low", (rounds * SECONDS[0]).cast("long")).withColumn("wall_high", (rounds * SECONDS[1]).cast("long"))
    return rows.withColumn("wall_text", F.concat_ws(" - ", format_duration("wall_low"), format_duration("wall_high")))
